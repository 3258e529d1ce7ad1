"""Registered queries: one per operator of the inventory.

Each callable takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
landed tables (through the fixture views). ``reportlake.plans.oracle`` holds
the DuckDB SQL for the same name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}


def query(name: str):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        return fn
    return deco


def all_queries() -> dict[str, QueryFn]:
    # Import the modules that register queries.
    from reportlake.plans import q_history, q_catalog, q_frames, q_blocks, q_sources  # noqa: F401
    from reportlake.plans import q_schedule, q_maintenance, q_streaming, q_reports  # noqa: F401
    return dict(QUERIES)
