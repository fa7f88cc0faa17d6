"""The driver tables seen as this library's inputs.

No network captures come with the test data, so ``events`` plays the flow log, ``lineitem`` the
scored predictions and ``orders`` the alert table. Every binding is a projection of a whole table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.lookups import label_table
from ..operators import labels as L
from ..operators.cleaning import flow_features
from ..operators.sequences import build_sequences
from ..operators.splits import temporal_split
from ..operators.windows import host_windows
from ..plans.scan import spread_rows, spread_small
from ..session import ensure_checkpoint_dir, size_shuffles
from ..sinks.tables import stage

WINDOW = 6 * 3600
STRIDE = 3 * 3600
LENGTH = 10
#: a flow is five values in two windows, each a group of the merge behind a shuffle
FLOWS_A_PARTITION = 20_000
SHUFFLE_BYTES = "16m"
HOSTS = 150  # modulus of the peer address


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one, for files that a query writes and reads back."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/flowhorizon-files/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread_small(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical unlabelled flows from ``events``."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    size_shuffles(spark, events.count(), FLOWS_A_PARTITION, SHUFFLE_BYTES)
    return flow_columns(spread_rows(events))


def flow_columns(e: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    attack = (
        F.when((F.col("event_type") == "error") & (F.col("value") >= 80), "DoS Hulk")
        .when((F.col("event_type") == "signup") & (F.col("value") >= 120), "FTP-Patator")
        .otherwise("BENIGN")
    )
    return e.select(
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.concat(F.lit("h"), F.col("user_id").cast("string")).alias("source_ip"),
        F.concat(F.lit("h"), ((F.col("user_id") + k) % HOSTS).cast("string")).alias("destination_ip"),
        (k + 1024).alias("source_port"),
        k.alias("destination_port"),
        F.when(k % 3 == 0, "UDP").otherwise("TCP").alias("protocol"),
        (F.col("value") / 10).alias("flow_duration"),
        (1 + k % 20).cast("double").alias("packet_count"),
        (F.col("value") * 100).alias("byte_count"),
        (k % 3).cast("double").alias("syn_count"),
        attack.alias("dataset_label"),
    )


def labelled_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.map_labels(flows(spark, sf_dir), label_table(spark, "cic_ids2017"), fixed_table=True)


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host windows as a written stage table: later plans scan it several times."""
    return stage(host_windows(flow_features(labelled_flows(spark, sf_dir)), WINDOW, STRIDE), "windows")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_sequences(windows(spark, sf_dir), LENGTH, 1, 1, WINDOW, STRIDE)


def staged_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(sequences(spark, sf_dir), "sequences")


def split_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal_split(staged_sequences(spark, sf_dir))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored predictions from ``lineitem``: label y, score p on a grid of about a thousand values."""
    li = table(spark, sf_dir, "lineitem")
    y = F.when(F.col("l_returnflag") == "R", 1).otherwise(0)
    raw = (F.col("l_orderkey") * 37 + F.col("l_partkey") * 13 + F.col("l_linenumber") * 101) % 797 + y * 204
    split = F.when(F.col("l_orderkey") % 5 < 3, "train").when(F.col("l_orderkey") % 5 == 3, "val").otherwise("test")
    return li.select(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("host_id"),
        F.concat_ws("-", F.lit("stage"), (F.col("l_partkey") % 5).cast("string")).alias("cls"),
        y.alias("y"),
        (raw / 1001.0).alias("p"),
        (F.col("l_linestatus") == "O").alias("is_onset"),
        F.col("l_shipdate").cast("timestamp").alias("target_window_start"),
        split.alias("split"),
    )
