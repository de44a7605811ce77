"""Seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], as one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from quillspar.plans import catalogue

HEADLINES = ("vec_topk", "chunk_windows", "bm25_topk", "bm25_filtered", "hybrid_topk", "param_dedupe", "compare_missing", "import_plan", "move_reconcile", "hash_dedupe", "job_counters", "retry_order", "first5_evidence", "highlight")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in HEADLINES:
        began = time.time()
        catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
