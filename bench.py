"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from cladeworks.operators import common_names, grouping, ladder, resolve
from cladeworks.plans import driver_views
from cladeworks.sources.backbone import accepted

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def group_entries(spark):
    return grouping.group_entries(driver_views.many_entries(spark, SF))


def resolve_end_to_end(spark):
    entries = driver_views.many_entries(spark, SF)
    groups = grouping.group_entries(entries)
    final = resolve.force_failed(resolve.final_attempts(groups, driver_views.responses(ladder.lookups(groups))))
    return resolve.output_rows(entries, final)


def _named(spark, climb):
    entries = driver_views.many_entries(spark, SF)
    names = common_names.prioritize_vernacular(driver_views.vernacular(spark, SF))
    return common_names.add_common_names(entries, accepted(driver_views.taxa(spark, SF)), names, climb)


def common_names_on(spark):
    return _named(spark, True)


def common_names_off(spark):
    return _named(spark, False)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.codegen.hugeMethodLimit", "8000").getOrCreate()
    )  # fmt: skip  # the JVM interprets methods of more than 8000 bytes, so Spark should not generate them
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for query in (group_entries, resolve_end_to_end, common_names_on, common_names_off):
        runs = []
        for _ in range(4):  # a warm-up and three that count
            began = time.time()
            query(spark).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        took[query.__name__] = round(statistics.median(runs[1:]), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF, "cpus": CPUS}))
    spark.stop()


if __name__ == "__main__":
    main()
