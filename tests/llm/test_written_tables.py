"""A written table leaves no shuffle files behind, and the session's own setting stays."""

import time

from pyspark.sql import functions as F

from chainframe.llm.common import CLEANUP, written


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in (files.apply(i).getName() for i in range(files.length())) if name.startswith("shuffle_")}


def test_shuffles_go_with_the_write(spark):
    before, setting = shuffle_files(spark), spark.conf.get(CLEANUP)
    counted = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    kept = written(counted)
    assert spark.conf.get(CLEANUP) == setting
    until = time.time() + 20
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert kept.agg(F.sum("n")).first()[0] == 1000
    assert counted.count() == 7
