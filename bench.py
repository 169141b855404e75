"""Benchmark the headline queries; prints ONE JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list, default the headline set), BENCH_REPEAT (default 2),
BENCH_WARMUP_DIR (default /root/testdata/sf0.001; an untimed pass warms the JVM),
BENCH_SHUFFLE_PARTITIONS (default BENCH_CPUS).

Each query is executed in full with the ``noop`` sink (every row is produced, nothing is
collected to the driver); the best of BENCH_REPEAT runs is reported.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["corpus_prompts", "corpus_prompts_novel", "vote_softmax", "class_report",
            "latency_report", "route_notes", "tfidf_top_terms", "validate_records",
            "corpus_split", "age_boxplot"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    names = [q for q in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if q]

    from casebook.plans.catalog import QUERIES
    from casebook.session import build_session

    parts = int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", str(cpus)))   # one per core locally
    spark = build_session(f"local[{cpus}]", shuffle_partitions=parts,
                          extra={"spark.driver.memory": "16g"})
    # Untimed warm-up on the smallest data set: JIT and code generation, no data caching.
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm_dir):
        for name in names:
            QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
            spark.catalog.clearCache()
    times: dict[str, float] = {}
    for name in names:
        best = None
        for _ in range(repeat):
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
            spark.catalog.clearCache()
        times[name] = round(best, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times,
                      "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus}))


if __name__ == "__main__":
    main()
