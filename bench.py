"""Time the headline queries; one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from rideframe import catalogue

HEADLINE = ["route_signal", "windowed_gradient", "dynamic_radius", "step_stats", "way_change_runs", "edge_index", "edge_lookup", "missing_edges", "segment_features", "greedy_merge", "normalized_power", "extension_canonical"]


def main() -> None:
    cpus, data = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        f = catalogue.queries()[name]
        f(spark, data).write.format("noop").mode("overwrite").save()
        begin = time.time()
        f(spark, data).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - begin, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(data.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
