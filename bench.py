"""Headline benchmark: prints one JSON line with per-query wall times.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list, default the headline set).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from srclens.plans.registry import queries  # noqa: E402
from srclens.session import local_session  # noqa: E402

HEADLINE = ["py_high_complexity", "py_god_class", "go_high_complexity", "go_god_struct",
            "go_concrete_dep", "repo_score", "py_doc_branch_keywords"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [q for q in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if q]
    spark = local_session(cpus, shuffle_partitions=max(8, int(cpus) if cpus.isdigit() else 8))
    qs = queries()
    # Untimed warm-up so JVM start-up does not land on the first query.
    spark.read.parquet(f"{sf_dir.rstrip('/')}/region.parquet").count()
    times: dict[str, float] = {}
    for name in names:
        t0 = time.time()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
