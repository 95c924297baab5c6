"""Headline benchmark: runs the flagship and representative operators at $BENCH_SF_DIR on local[$BENCH_CPUS]
and prints one JSON line {"metric", "value", "unit", "queries", "sf"}.

Each query is fully materialised (written to the ``noop`` sink, so no result column is pruned) and timed after an untimed warm-up (the flagship on
sf0.001: JVM JIT and Python workers); the value is the sum of the per-query wall times.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import Observation  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from pairforge.plans.registry import QUERIES  # noqa: E402
from pairforge.session import get_session  # noqa: E402

HEADLINE = ["t1_manifest", "e3_dataset_summary", "b1_parse_records", "a1_read_manifest", "c1_ring_negatives",
            "c2_interleave", "e1_summarize_manifest", "d1_missing_media", "h5_modality_batches",
            "h3_shuffled_batches", "f3_rank_shards", "l3_evaluate_pairs", "l4_mnrl_negatives", "l6_ir_metrics",
            "d6_retrieval_topk"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n in QUERIES]
    spark = get_session(f"local[{cpus}]", shuffle_partitions=int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/documents.parquet").count()  # JVM/session warm-up
    warm = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm):
        QUERIES["t1_manifest"](spark, warm).count()  # untimed: JIT and Python worker start
    times: dict[str, float] = {}
    rows: dict[str, int] = {}
    for name in names:
        t0 = time.perf_counter()
        seen = Observation()
        df = QUERIES[name](spark, sf_dir).observe(seen, F.count(F.lit(1)).alias("rows"))  # counted as they are written
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        rows[name] = seen.get["rows"]
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "headline_total_wall", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "rows": rows, "sf": float(m.group(1)) if m else sf_dir, "cpus": int(cpus)}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
