"""Enterprise flow logs without header (nine columns) and red-team authentication lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalars import parse_port, protocol_name
from ..schema import coerce_flows

FLOW_DDL = (
    "time string, duration string, src string, src_port string, dst string, dst_port string, "
    "protocol string, packets string, bytes string"
)


def read_host_flows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FLOW_DDL).csv(path)


def select_host_flows(
    raw: DataFrame, computers: list[str] | DataFrame | None = None, time_range: tuple[int, int] | None = None
) -> DataFrame:
    """Inclusive time slice and "either end is one of these computers".

    A short list becomes ``isin``; a table of names (column ``computer``) becomes two semi-joins.
    """
    if time_range is not None:
        raw = raw.filter(F.col("time").try_cast("bigint").between(*time_range))
    if computers is None:
        return raw
    if isinstance(computers, DataFrame):
        names = computers.select(F.col("computer").alias("_c")).distinct()
        by_src = raw.join(names, F.col("src") == F.col("_c"), "left_semi")
        rest = raw.join(names, F.col("src").eqNullSafe(F.col("_c")), "left_anti")
        return by_src.unionByName(rest.join(names, F.col("dst") == F.col("_c"), "left_semi"))
    return raw.filter(F.col("src").isin(computers) | F.col("dst").isin(computers))


def host_flows_to_flows(raw: DataFrame) -> DataFrame:
    """Seconds since the log's start as time from the epoch; de-identified ports are NULL."""
    seconds = F.col("time").try_cast("bigint")
    packets, size = F.col("packets").try_cast("double"), F.col("bytes").try_cast("double")
    flows = raw.select(
        F.timestamp_seconds(seconds).alias("timestamp"),
        F.col("src").alias("source_ip"),
        F.col("dst").alias("destination_ip"),
        parse_port(F.col("src_port")).alias("source_port"),
        parse_port(F.col("dst_port")).alias("destination_port"),
        protocol_name(F.col("protocol"), "authlog").alias("protocol"),
        F.col("duration").try_cast("double").alias("flow_duration"),
        packets.alias("packet_count"),
        size.alias("byte_count"),
        F.lit(None).cast("string").alias("dataset_label"),
        F.when(packets > 0, size / packets).alias("packet_size_mean"),
        seconds.alias("lanl_time_s"),
        F.lit("lanl_2015").alias("source_dataset"),
    )
    return coerce_flows(flows)


def read_redteam(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("time bigint, user string, src string, dst string").csv(path)
