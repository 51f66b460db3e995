"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the
local cores. Arguments, if any, choose the queries.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from urbanweave.plans.catalogue import QUERIES

HEADLINE = [
    "clean_rule_counts",
    "quality_report",
    "trip_cast_clean",
    "load_dedup",
    "describe_trips",
    "feature_table",
    "trip_cells",
    "summary",
    "neighborhoods",
    "neighborhood_detail",
    "flow_hourly",
    "flow_seasonal",
    "flow_rush",
    "temporal_report",
    "top_origins",
    "cell_labels",
    "od_edges",
    "node_strength",
    "edges_top",
    "pagerank",
    "betweenness",
    "top_hexagons",
    "communities",
]


def main(names: list[str]) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("urbanweave-bench")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", os.environ.get("BENCH_SHARED", tempfile.mkdtemp(prefix="urbanweave-bench-")))
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start the JVM's code paths and the Python workers before the clock runs.
    QUERIES["trip_cells"](spark, sf_dir).write.format("noop").mode("overwrite").save()

    times = {}
    for name in names or HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main(sys.argv[1:])
