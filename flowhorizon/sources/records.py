"""Exported flow records: nfdump CSV and decoded NetFlow / IPFIX records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.lookups import PROTOCOL_NAMES, map_column
from ..functions.scalars import FLAG_BITS, protocol_name
from ..schema import coerce_flows

NFDUMP_NEEDED = ["ts", "te", "sa", "da", "sp", "dp", "pr", "flg", "ipkt", "ibyt"]
UNLABELED = "UNLABELED"
# letters of the last six characters of the flag mask, left to right
MASK_BITS = [32, 16, 8, 4, 2, 1]


def read_nfdump(spark: SparkSession, path: str) -> DataFrame:
    """Text columns of ``nfdump -o csv``; the header is read once for the column names."""
    raw = (
        spark.read.option("header", True)
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .csv(path)
    )
    missing = [c for c in NFDUMP_NEEDED if c not in raw.columns]
    if missing:
        raise ValueError(f"not nfdump CSV: missing columns {missing}")
    return raw


def nfdump_to_records(raw: DataFrame) -> DataFrame:
    """Flow records; the trailing summary block is dropped and two-way rows give a reversed record."""
    rows = raw.filter(F.col("sa").isNotNull() & F.col("da").isNotNull() & F.col("ts").rlike(r"^\d{4}-\d{2}-\d{2}"))
    numbers = map_column({name.upper(): int(code) for code, name in PROTOCOL_NAMES["packets"].items()})
    pr = F.upper(F.trim("pr"))
    digits = F.when(pr.rlike(r"^\d+$"), pr.try_cast("int"))
    proto = F.coalesce(F.try_element_at(numbers, pr), digits, F.lit(0))

    def seconds(c):
        return F.unix_micros(F.try_to_timestamp(F.col(c))) / 1e6

    duration = F.col("td").try_cast("double") if "td" in raw.columns else F.lit(None).cast("double")
    mask = F.substring(F.trim("flg"), -6, 6)
    bits = F.lit(0)
    for i, bit in enumerate(MASK_BITS):
        bits = bits + F.when(F.substring(mask, i + 1, 1) != ".", bit).otherwise(0)
    start = seconds("ts")
    base = rows.select(
        start.alias("start"),
        F.coalesce(start + duration, seconds("te")).alias("end"),
        "sa",
        "da",
        F.when(proto.isin(6, 17), F.col("sp").try_cast("int")).alias("sp"),
        F.when(proto.isin(6, 17), F.col("dp").try_cast("int")).alias("dp"),
        proto.alias("proto"),
        F.when(proto == 6, bits).alias("tcp_flags"),
        F.col("ipkt").try_cast("bigint").alias("ipkt"),
        F.col("ibyt").try_cast("bigint").alias("ibyt"),
        *(
            [F.col("opkt").try_cast("bigint").alias("opkt"), F.col("obyt").try_cast("bigint").alias("obyt")]
            if "opkt" in raw.columns
            else [F.lit(0).cast("bigint").alias("opkt"), F.lit(0).cast("bigint").alias("obyt")]
        ),
    )
    # both directions of a row in one pass instead of a union of two scans
    one = F.struct(F.col("sa").alias("src"), F.col("da").alias("dst"), F.col("sp").alias("sport"), F.col("dp").alias("dport"),
                   F.col("ipkt").alias("packets"), F.col("ibyt").alias("bytes"))
    two = F.struct(F.col("da").alias("src"), F.col("sa").alias("dst"), F.col("dp").alias("sport"), F.col("sp").alias("dport"),
                   F.col("opkt").alias("packets"), F.col("obyt").alias("bytes"))
    ways = F.when(F.col("opkt") > 0, F.array(one, two)).otherwise(F.array(one))
    return base.withColumn("w", F.explode(ways)).select("start", "end", "w.*", "proto", "tcp_flags")


def records_to_flows(records: DataFrame) -> DataFrame:
    """Unidirectional canonical flows; flag counts are presence (0/1), NULL without flags."""
    packets = F.greatest(F.col("packets"), F.lit(0)).cast("double")
    size = F.col("bytes").cast("double")
    zero = F.lit(0.0)
    flags = [
        (F.col("tcp_flags").bitwiseAND(F.lit(bit)) > 0).cast("double").alias(f"{name}_count")
        for name, bit in FLAG_BITS.items()
    ]
    flows = records.select(
        F.timestamp_micros(F.round(F.col("start") * 1e6).cast("bigint")).alias("timestamp"),
        F.col("src").alias("source_ip"),
        F.col("dst").alias("destination_ip"),
        F.col("sport").alias("source_port"),
        F.col("dport").alias("destination_port"),
        protocol_name(F.col("proto"), "packets").alias("protocol"),
        F.greatest(zero, F.col("end") - F.col("start")).alias("flow_duration"),
        packets.alias("packet_count"),
        size.alias("byte_count"),
        packets.alias("fwd_packet_count"),
        zero.alias("bwd_packet_count"),
        size.alias("fwd_byte_count"),
        zero.alias("bwd_byte_count"),
        F.when(packets > 0, size / packets).alias("packet_size_mean"),
        F.lit(UNLABELED).alias("dataset_label"),
        *flags,
        F.lit("netflow").alias("source_dataset"),
    )
    return coerce_flows(flows)
