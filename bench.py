"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line, the best of two runs after a warm-up."""

import json
import os
import time

from pyspark.sql import SparkSession

from tiersift.plans.queries import QUERIES

HEADLINE = "dense_topk bm25_topk rrf_hybrid parent_promote cross_query_rrf hier_sections neighbor_context session_prior5".split()


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        times = []
        for _ in range(3):
            start = time.time()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.time() - start)
        took[name] = round(min(times[1:]), 3)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
