from pyspark.sql import functions as F

from flowhorizon import session
from flowhorizon.catalog import bindings as B


def test_partitions_follow_the_rows(spark, sf, monkeypatch):
    """The groups behind a shuffle go to as many partitions as the rows ask for, not to the fixed number of the session."""
    monkeypatch.setattr(B, "FLOWS_A_PARTITION", 20, raising=False)
    monkeypatch.setattr(B, "SHUFFLE_BYTES", "512b", raising=False)
    least = "spark.sql.adaptive.coalescePartitions.minPartitionSize"
    session.tune(spark)
    advisory = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set(least, "1b")
    spread = B.flows(spark, sf).groupBy("source_ip", "timestamp").count().select(F.spark_partition_id().alias("p")).distinct().count()
    spark.conf.unset(least)
    assert spread > int(spark.conf.get("spark.sql.shuffle.partitions"))
    session.tune(spark)  # the next query starts with the settings of the session
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == advisory
    assert spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) is None


def test_a_small_table_is_left_to_the_session(spark, sf):
    session.tune(spark)
    session.size_shuffles(spark, 3, 1, "1m")
    assert spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) is None
