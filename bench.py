"""Times the headline queries; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from strandmill.plans import registry

HEADLINE = ("exact_topk", "regroup_results", "r_precision", "average_precision", "exhaustive_scores", "masked_cutoffs", "chunk_windows", "kmer_search", "quantized_search", "pca_search", "rabitq_search", "ivf_search", "quantiles", "interval_overlap")


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries, out = registry.queries(), {}
    queries[HEADLINE[0]](spark, sf).write.format("noop").mode("overwrite").save()  # starts the JVM's compiler and the Python workers; not timed
    for name in HEADLINE:
        began = time.time()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        out[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(out.values()), 3), "unit": "sec", "queries": out, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
