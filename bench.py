"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is run to completion with the ``noop`` sink (every row is
computed, nothing is collected) after one warm-up query that starts the JVM.
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from stepcorpus.plans.registry import load_all  # noqa: E402
from stepcorpus.session import get_session  # noqa: E402

HEADLINE = [
    "stage1_samples", "stage2_samples", "stage3_samples", "t1_build_vocab", "t2_decode", "t9_locate_steps",
    "t5_assistant_spans", "f1_first_n", "f4_validity_report", "b1_exact_split", "b4_pad_batch_steps",
    "b5_schedule", "j5_pool_patches", "j6_project", "m3_token_nll", "m6_top_k_softmax", "m11_retained_checkpoints",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = get_session(cores=cpus, shuffle_partitions=int(cpus) * 2 if cpus.isdigit() else 16,
                        driver_memory=os.environ.get("BENCH_DRIVER_MEMORY", "16g"))
    reg = load_all()
    reg["f2_has_image_url"].build(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    times = {}
    for name in names:
        t0 = time.time()
        reg[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
