"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from millrace.plans import catalogue

HEADLINE = ["tpch_q01", "tpch_q03", "tpch_q05", "tpch_q06", "tpch_q07", "tpch_q08", "tpch_q10", "tpch_q13_like", "tpch_q14", "tpch_q16_like", "tpch_q18", "tpch_q19_like", "tpch_q21_like", "tpch_q22_like", "agg_basic", "agg_rollup", "win_rank_family", "win_rows_frame", "topk", "join_left"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = catalogue.queries(), {}
    queries["tpch_q01"](spark, sf_dir).collect()  # the JVM starts here
    for name in HEADLINE:
        began = time.perf_counter()
        queries[name](spark, sf_dir).toArrow()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
