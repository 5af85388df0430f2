"""Imports every query family so that the registry is complete."""

from __future__ import annotations

from veilframe.plans import (  # noqa: F401
    audit_queries, cache_queries, keys_queries, pii_queries, prompt_queries, rate_queries, sealing_queries,
    flow_queries, history_queries, leak_queries, stream_queries,
)
from veilframe.plans.registry import REGISTRY
from veilframe.session import ship_package


def _shipping(build):
    def run(spark, sf_dir):
        ship_package(spark)
        return build(spark, sf_dir)
    run.__name__ = getattr(build, "__name__", "query")
    run.__doc__ = build.__doc__
    return run


def queries():
    return {name: _shipping(e.build) for name, e in REGISTRY.items()}


def oracle_sql():
    return {name: e.oracle for name, e in REGISTRY.items() if e.oracle is not None}
