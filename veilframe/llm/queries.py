"""The queries of this subpackage, by name, and their oracle SQL where SQL can express them."""

from __future__ import annotations

from importlib import import_module

# name -> (module, SQL constant or None)
ENTRIES = {
    "op1_exact_dedup": ("exact_dedup", "OP1_SQL"),
    "op2_simhash": ("simhash", None),
    "op3_line_dedup": ("line_dedup", None),
    "op4_token_files": ("token_files", None),
    "op5_toxicity": ("toxicity", None),
    "op6_bpe": ("bpe", None),
    "op7_pii": ("pii", None),
    "op8_nearest": ("ann", "OP8_SQL"),
    "op9_token_counts": ("token_counts", None),
    "op10_packing": ("packing", None),
    "op11_quality": ("quality", None),
    "op12_ranked_search": ("ranked_search", "OP12_SQL"),
    "op13_filter_audit": ("filter_audit", "OP13_SQL"),
}


def queries() -> dict:
    return {name: getattr(import_module(f"veilframe.llm.{module}"), name) for name, (module, _) in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(import_module(f"veilframe.llm.{module}"), sql)
            for name, (module, sql) in ENTRIES.items() if sql}
