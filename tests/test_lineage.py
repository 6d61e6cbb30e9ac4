"""What written tables leave behind."""

from pyspark.sql import functions as F

from skein.lineage import _CLEANUP, cut, release


def shuffles(spark):
    return {int(k) for k in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().keys().mkString(",").split(",") if k}


def test_written_tables_leave_no_shuffle_files(spark):
    before = shuffles(spark)
    table = cut(spark.range(1000).select((F.col("id") % 7).alias("u"), "id"))
    for _ in range(3):
        table = cut(table.groupBy("u").agg(F.min("id").alias("id")).join(table.select("u"), "u"), table)
    assert shuffles(spark) <= before and spark.conf.get(_CLEANUP, None) is None
    assert table.count() == 1000
    release(table)
