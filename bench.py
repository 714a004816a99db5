"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full through a no-op sink (every row computed, no
collect).  Like the reference's throughput benchmark, which warms the encoder
up before timing, every query runs once untimed (JIT, code generation, Python
worker start-up) and is then timed on a second run.  The encoder throughput
job (hashing encoder over every document) is reported alongside.  Prints one
JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from labelforge.plans.queries import QUERIES  # noqa: E402
from labelforge.session import build_session  # noqa: E402

HEADLINE = [
    "quality_report",
    "email_clean",
    "dedup_first",
    "balance_classes",
    "stratified_split",
    "shuffle_order",
    "label_crosswalk",
    "dominant_label",
    "vote",
    "combine_languages",
    "class_report",
    "report_summary",
    "weighted_log_loss",
    "embed_texts",
    "pc_compat",
    "no_improve",
    "run_summary",
    "model_comparison",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", shuffle_partitions=max(cpus, 8),
                          extra={"spark.driver.memory": "16g"})
    # Warm-up: JVM code paths and one Python worker per core (worker start-up
    # is process launch, not query work).
    QUERIES["value_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    spark.range(0, 1024, 1, cpus).mapInPandas(lambda it: it, "id long") \
        .write.format("noop").mode("overwrite").save()
    times, cold = {}, {}
    for name in names:
        for run in ("cold", "warm"):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            elapsed = round(time.perf_counter() - start, 3)
            (cold if run == "cold" else times)[name] = elapsed
    throughput = QUERIES["encode_throughput"](spark, sf_dir).first()
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf,
                      "cold_total_sec": round(sum(cold.values()), 3),
                      "encode_sentences_per_second": throughput["sentences_per_second"],
                      "encode_sentences": throughput["num_sentences_processed"]}))
    spark.stop()


if __name__ == "__main__":
    main()
