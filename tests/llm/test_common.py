from __future__ import annotations

import time

from pyspark.sql import functions as F

from riskframe.llm.common import FREED, cut


def shuffles(spark) -> set[str]:
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {name for name in disk.getAllBlocks().mkString(" ").split() if name.startswith("shuffle_")}


def test_cut_leaves_no_shuffle_files(spark):
    counted = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    setting, before = spark.conf.get(FREED), shuffles(spark)
    kept = cut(counted)
    until = time.time() + 10
    while shuffles(spark) - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffles(spark) - before
    assert spark.conf.get(FREED) == setting
    # readers of the frame itself go on with their own shuffles
    again = sorted(map(tuple, counted.collect()))
    assert again == sorted(map(tuple, kept.collect())) == sorted(map(tuple, counted.collect()))
    assert sum(n for _, n in again) == 1000
