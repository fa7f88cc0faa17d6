"""Endpoint event logs (eCAR JSON lines) and process ground truth."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalars import host_key, parse_local_time, protocol_name
from ..schema import coerce_flows

EVENT_DDL = (
    "timestamp string, hostname string, pid string, object string, action string, objectID string, "
    "properties struct<src_ip:string,src_port:string,dest_ip:string,dest_port:string,l4protocol:string,"
    "direction:string,image_path:string,size:string>"
)
TELEMETRY_PORT = 9092


def read_ecar(spark: SparkSession, path: str) -> DataFrame:
    """FLOW events with their file. Lines are filtered on text before any JSON is parsed."""
    text = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json*")
        .text(path)
        .withColumn("file", F.col("_metadata.file_path"))
        .filter(F.col("value").contains('"FLOW"'))
    )
    parsed = text.select("file", F.from_json("value", EVENT_DDL).alias("e")).select("file", "e.*")
    return parsed.filter(F.col("object") == "FLOW")


def ecar_flow_objects(events: DataFrame, keep_telemetry: bool = False, order: list[str] = ("timestamp",)) -> DataFrame:
    """One row per (file, flow object) with a START: its first START and the bytes of its MESSAGEs.

    Both come out of one aggregation, so starts and messages are shuffled once. A flow without a
    sized message has NULL bytes. Sensor upload traffic is dropped unless kept.
    """
    start, message = F.col("action") == "START", F.col("action") == "MESSAGE"
    fields = F.struct("timestamp", "hostname", "pid", "properties")
    rank = F.struct(*order, "hostname", "pid", "properties")
    size = F.col("properties.size").try_cast("double")
    flows = (
        events.filter(start | message)
        .groupBy("file", "objectID")
        .agg(
            F.min_by(F.when(start, fields), F.when(start, rank)).alias("s"),
            F.sum(F.when(message & ~F.isnan(size), size)).alias("byte_count"),
            F.count(F.when(start, 1)).alias("starts"),
        )
        .filter("starts > 0")
        .select("file", "objectID", F.col("s.timestamp").alias("ts"), "s.hostname", "s.pid", "s.properties.*", "byte_count")
        .drop("size")
    )
    if keep_telemetry:
        return flows
    port = F.col("dest_port").try_cast("double")
    return flows.filter(F.coalesce(port != TELEMETRY_PORT, F.lit(True)))


def ecar_to_flows(objects: DataFrame, hosts: list[str] | None = None) -> DataFrame:
    """Canonical flows in local clock time, with host key, pid, direction and image path."""
    flows = objects.select(
        parse_local_time(F.col("ts")).alias("timestamp"),
        F.col("src_ip").alias("source_ip"),
        F.col("dest_ip").alias("destination_ip"),
        F.col("src_port").alias("source_port"),
        F.col("dest_port").alias("destination_port"),
        protocol_name(F.col("l4protocol"), "ecar").alias("protocol"),
        F.lit(None).cast("double").alias("flow_duration"),
        F.lit(None).cast("double").alias("packet_count"),
        "byte_count",
        F.lit(None).cast("string").alias("dataset_label"),
        host_key(F.col("hostname")).alias("optc_host"),
        F.col("direction").alias("optc_direction"),
        F.col("pid").try_cast("bigint").alias("pid"),
        "image_path",
        F.lit("optc").alias("source_dataset"),
    )
    if hosts:
        flows = flows.filter(F.col("optc_host").isin([h.lower() for h in hosts]))
    return coerce_flows(flows)


def parse_ground_truth(raw: DataFrame) -> DataFrame:
    """(gt_no, host, pid, start, end, scenario); ``Infinity`` ends are open, bad rows are dropped."""
    open_end = F.lower(F.trim("end")) == "infinity"
    return raw.select(
        "gt_no",
        host_key(F.col("host")).alias("host"),
        F.trim("pid").try_cast("bigint").alias("pid"),
        parse_local_time(F.trim("start")).alias("start"),
        F.when(~open_end, parse_local_time(F.trim("end"))).alias("end"),
        "scenario",
    ).filter(F.col("pid").isNotNull() & F.col("start").isNotNull())


def read_ground_truth(spark: SparkSession, paths: dict[int, str]) -> DataFrame:
    """``paths`` maps scenario number to its headerless CSV (host, pid, start, end)."""
    parts = [
        spark.read.schema("host string, pid string, start string, end string")
        .csv(p)
        .withColumns({"scenario": F.lit(n), "_line": F.monotonically_increasing_id()})
        for n, p in sorted(paths.items())
    ]
    # scenario first, then line: one sortable number per row
    joined = reduce(lambda a, b: a.unionByName(b), parts).withColumn(
        "gt_no", F.struct("scenario", "_line", "host", "pid", "start")
    )
    return parse_ground_truth(joined)
