"""Argus bidirectional flow files (``*.binetflow``, plain or gzip)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalars import label_family, parse_port, scenario_id
from ..schema import coerce_flows

COLUMNS = [
    "StartTime", "Dur", "Proto", "SrcAddr", "Sport", "Dir", "DstAddr", "Dport", "State",
    "sTos", "dTos", "TotPkts", "TotBytes", "SrcBytes", "Label",
]
FLAG_LETTERS = {"syn": "S", "ack": "A", "rst": "R", "fin": "F", "psh": "P", "urg": "U"}


def read_argus(spark: SparkSession, path: str, scenarios: list[int] | None = None) -> DataFrame:
    """Text columns plus ``ctu_scenario`` from the file name; files of no known scenario are left out."""
    raw = (
        spark.read.option("header", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.binetflow*")
        .schema(", ".join(f"{c} string" for c in COLUMNS))
        .csv(path)
        .withColumn("ctu_scenario", scenario_id(F.col("_metadata.file_name")))
        .filter(F.col("ctu_scenario").isNotNull())
    )
    return raw.filter(F.col("ctu_scenario").isin(scenarios)) if scenarios else raw


def argus_to_flows(raw: DataFrame) -> DataFrame:
    def number(c):
        return F.trim(F.col(c)).try_cast("double")

    proto = F.upper(F.trim("Proto"))
    state = F.coalesce(F.trim("State"), F.lit(""))
    total, packets = number("TotBytes"), number("TotPkts")
    flags = {
        f"{name}_count": (state.contains(letter) & (proto == "TCP")).cast("double").alias(f"{name}_count")
        for name, letter in FLAG_LETTERS.items()
    }
    flows = raw.select(
        F.try_to_timestamp(F.trim("StartTime"), F.lit("yyyy/MM/dd HH:mm:ss.SSSSSS")).alias("timestamp"),
        F.trim("SrcAddr").alias("source_ip"),
        F.trim("DstAddr").alias("destination_ip"),
        parse_port(F.col("Sport")).alias("source_port"),
        parse_port(F.col("Dport")).alias("destination_port"),
        proto.alias("protocol"),
        number("Dur").alias("flow_duration"),
        packets.alias("packet_count"),
        total.alias("byte_count"),
        number("SrcBytes").alias("fwd_byte_count"),
        F.when(total.isNotNull() & number("SrcBytes").isNotNull(), F.greatest(total - number("SrcBytes"), F.lit(0.0))).alias(
            "bwd_byte_count"
        ),
        F.when(packets > 0, total / packets).alias("packet_size_mean"),
        label_family(F.coalesce("Label", F.lit(""))).alias("dataset_label"),
        F.trim("Label").alias("ctu_label"),
        "ctu_scenario",
        *flags.values(),
        F.lit("ctu_13").alias("source_dataset"),
    )
    return coerce_flows(flows)
