"""Materialised frames leave no shuffle files behind."""

import time

from pyspark.sql import functions as F

from tidemark.functions.storage import CLEAN_SHUFFLES, keep


def shuffle_files(spark) -> set[str]:
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {name for f in files.split("\n") if (name := f.rsplit("/", 1)[-1]).startswith("shuffle_") and name.endswith(".data")}


def left_over(spark, before: set[str], at_most: int) -> int:
    """New shuffle files, after some seconds at most: they are removed in the background."""
    for _ in range(50):
        if len(shuffle_files(spark) - before) <= at_most:
            break
        time.sleep(0.2)
    return len(shuffle_files(spark) - before)


def test_shuffle_files_go_when_the_rows_are_written(spark):
    before, said = shuffle_files(spark), spark.conf.get(CLEAN_SHUFFLES)
    counted = spark.range(1000).repartition(5).groupBy((F.col("id") % 7).alias("k")).count()
    kept = keep(counted)
    assert left_over(spark, before, 0) == 0
    assert {r["k"]: r["count"] for r in kept.collect()} == {r["k"]: r["count"] for r in counted.collect()}
    assert spark.conf.get(CLEAN_SHUFFLES) == said
