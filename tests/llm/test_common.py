import os
import time

import pytest
from pyspark.sql import functions as F

from tagscope.llm import common


def shuffle_files(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for top in dirs for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}


def left_by_a_step(spark, before, seconds=10):
    """Shuffle files that are still there some seconds later (they are deleted in the background)."""
    end = time.time() + seconds
    while (left := shuffle_files(spark) - before) and time.time() < end:
        time.sleep(0.1)
    return left


@pytest.mark.parametrize("value", [None, "false", "true"])
def test_staged_leaves_no_shuffle_files(spark, value):
    was = spark.conf.get(common._CLEANUP, None)
    spark.conf.unset(common._CLEANUP) if value is None else spark.conf.set(common._CLEANUP, value)
    own = spark.conf.get(common._CLEANUP, None)
    try:
        before = shuffle_files(spark)
        df = spark.range(3000).withColumn("k", F.col("id") % 700).repartition(3, "k")
        df = df.join(df.groupBy("k").count(), "k")
        got = common.staged(df, "test-files")
        assert not left_by_a_step(spark, before)
        assert spark.conf.get(common._CLEANUP, None) == own
        assert got.count() == df.count() == 3000        # the same frame can run once more
        with pytest.raises(Exception):
            common.staged(df.select(F.raise_error(F.lit("stop"))), "test-files")
        assert spark.conf.get(common._CLEANUP, None) == own
        common.drop_staged(got)
    finally:
        spark.conf.unset(common._CLEANUP) if was is None else spark.conf.set(common._CLEANUP, was)
