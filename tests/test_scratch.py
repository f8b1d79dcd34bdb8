"""Intermediate tables leave no files of the shuffles that made them."""

import os
import time

from pyspark.sql import functions as F

from cragline.sources import scratch


def _shuffle_files(spark):
    jvm = spark.sparkContext._jvm
    dirs = [str(d) for d in jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    return {f for top in dirs for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_") and f.endswith(".data")}


def test_shuffle_files_go_when_a_table_is_written(spark):
    before, setting = _shuffle_files(spark), spark.conf.get(scratch.CLEANUP, None)
    rows = spark.range(5000).groupBy((F.col("id") % 700).alias("k")).agg(F.count("*").alias("n"))
    table = scratch.cut(rows.join(rows.withColumnRenamed("n", "m"), "k"))
    ends = time.monotonic() + 20  # files are removed in the background
    while (left := _shuffle_files(spark) - before) and time.monotonic() < ends:
        time.sleep(0.1)
    assert not left
    assert table.count() == 700 and rows.count() == 700
    assert spark.conf.get(scratch.CLEANUP, None) == setting
    scratch.discard(table)
