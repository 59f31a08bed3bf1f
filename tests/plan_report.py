"""Static plan shape of the headline queries (AQE off, so the plan is the
one Catalyst chose before runtime re-planning).

Usage: python tests/plan_report.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

COUNTS = [
    ("exchanges", "Exchange hashpartitioning"),
    ("reused", "ReusedExchange"),
    ("broadcast joins", "BroadcastHashJoin"),
    ("sort-merge joins", "SortMergeJoin"),
    ("hash aggs", "HashAggregate"),
    ("sort aggs", "SortAggregate"),
    ("group limits", "WindowGroupLimit"),
    ("python", "FlatMapGroupsInPandas"),
    ("cartesian/BNLJ", "CartesianProduct|BroadcastNestedLoopJoin"),
]


def main() -> None:
    import bench
    from basketry.plans.queries import QUERIES
    from basketry.session import build_session
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[8]", shuffle_partitions=16, extra={"spark.sql.adaptive.enabled": "false"})
    print("# Plan shapes of the headline queries\n")
    print(f"Generated by `tests/plan_report.py` on `{sf_dir}` with AQE off (static plans; AQE may later turn "
          "sort-merge joins into broadcast joins from measured sizes and split skewed partitions).\n")
    print("| query | " + " | ".join(c for c, _ in COUNTS) + " |")
    print("| --- |" + " --- |" * len(COUNTS))
    for name in bench.HEADLINE:
        df = QUERIES[name](spark, sf_dir)
        plan = df._jdf.queryExecution().executedPlan().toString()
        row = []
        for _, pat in COUNTS:
            row.append(str(sum(plan.count(p) for p in pat.split("|"))))
        print(f"| {name} | " + " | ".join(row) + " |")


if __name__ == "__main__":
    main()
