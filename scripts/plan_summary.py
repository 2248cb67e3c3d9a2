"""Print operator counts of the formatted physical plan of registered queries.

usage: python scripts/plan_summary.py [sf_dir] [name ...]
Queries that stage facts run their checkpoint jobs while being built; the
plan shown is the one that reads the staged tables.
"""

import collections
import re
import sys

sys.path.insert(0, __file__.rsplit("/scripts/", 1)[0])

from srclens.plans.registry import queries  # noqa: E402
from srclens.session import local_session  # noqa: E402

OPS = ["Exchange", "BroadcastExchange", "Sort", "Window", "HashAggregate", "ObjectHashAggregate",
       "SortAggregate", "SortMergeJoin", "BroadcastHashJoin", "Generate", "Scan parquet", "Scan ExistingRDD"]


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or ["py_high_complexity", "go_high_complexity", "repo_score"]
    spark = local_session(8)
    qs = queries()
    for name in names:
        plan = qs[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        counts = collections.Counter()
        for line in plan.splitlines():
            op = re.sub(r"^[\s:+\-*]*", "", line)
            for o in OPS:
                if op.startswith(o):
                    counts[o] += 1
                    break
        pushed = sorted(set(re.findall(r"PushedFilters: \[([^\]]*)\]", plan)))
        print(name, dict(counts), "pushed:", pushed)


if __name__ == "__main__":
    main()
