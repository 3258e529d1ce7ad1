"""Summarise the physical plan of every registered query.

    python tools/plan_report.py [--sf /root/testdata/sf0.01] > PLANS.md

Per query: shuffles, join strategies, aggregate kinds, windows, Python
stages, and red flags (single-partition exchanges, windows without a
partition, nested-loop or cartesian joins). Plans are the initial adaptive plans (before runtime re-planning).
"""

from __future__ import annotations

import argparse
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from reportlake.session import get_spark  # noqa: E402

PATTERNS = {
    "shuffle": r"Exchange hashpartitioning|Exchange rangepartitioning",
    "single": r"Exchange SinglePartition",
    "bcast": r"BroadcastExchange",
    "bhj": r"BroadcastHashJoin",
    "smj": r"SortMergeJoin",
    "shj": r"ShuffledHashJoin",
    "bnlj": r"BroadcastNestedLoopJoin",
    "cartesian": r"CartesianProduct",
    "hash_agg": r"\bHashAggregate",
    "sort_agg": r"SortAggregate",
    "window": r"\bWindow \[",
    "open_window": r"\bWindow \[[^\n]*?windowspecdefinition\([^,()]* (?:ASC|DESC)",
    "group_limit": r"WindowGroupLimit",
    "python": r"ArrowEvalPython|BatchEvalPython|FlatMapGroupsInPandas|MapInPandas|MapInArrow",
    "scans": r"FileScan parquet|Scan ExistingRDD|Scan json",
}


def summarise(p: str) -> dict[str, int]:
    return {k: len(re.findall(v, p)) for k, v in PATTERNS.items()}


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    a = ap.parse_args()
    from reportlake.plans.registry import all_queries

    spark = get_spark("local[2]", **{"spark.sql.shuffle.partitions": "8"})
    qs = all_queries()
    print("# Physical plans of the registered queries\n")
    print(f"Generated by `tools/plan_report.py` at `{a.sf}` (initial adaptive plans; AQE may still turn a")
    print("shuffle join into a broadcast join at runtime when the measured side is small).\n")
    cols = list(PATTERNS)
    print("| query | " + " | ".join(cols) + " |")
    print("|---|" + "---|" * len(cols))
    for name in sorted(qs):
        try:
            df = qs[name](spark, a.sf)
            p = df._jdf.queryExecution().executedPlan().toString()
        except Exception as e:  # noqa: BLE001
            print(f"| {name} | error: {type(e).__name__} |")
            continue
        s = summarise(p)
        print(f"| {name} | " + " | ".join(str(s[c]) for c in cols) + " |")
    spark.stop()


if __name__ == "__main__":
    main()
