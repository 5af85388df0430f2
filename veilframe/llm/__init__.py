"""Operators for preparing language-model training data (dedup, tokens, filters, packing)."""
