"""Host communication graph per window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.lookups import MODEL_FEATURES
from ..plans.grid import assign_windows, check_grid, origin_column
from .sequences import BLOCK_ROWS, blocked_windows


def window_pairs(
    flows: DataFrame, window_seconds: float = 60, stride_seconds: float = 30, origin=None
) -> DataFrame:
    """Distinct undirected host pairs (a < b) per window; self-loops are dropped.

    With long windows pairs are made unique per stride-long pane before they are copied into many
    windows; with few windows per pair one distinct is cheaper than two shuffles.
    """
    window_us, stride_us = check_grid(window_seconds, stride_seconds)
    start = origin_column(flows, origin)
    src, dst = F.col("source_ip").cast("string"), F.col("destination_ip").cast("string")
    pairs = flows.filter(src != dst).select(
        F.least(src, dst).alias("a"),
        F.greatest(src, dst).alias("b"),
        (F.unix_micros(F.col("timestamp").cast("timestamp")) - start).alias("_off"),
    )
    if window_us % stride_us == 0:
        pane = F.floor(F.col("_off") / F.lit(stride_us)).cast("bigint")
        pairs = pairs.select("a", "b", (pane * stride_us).alias("_off")).distinct()
    return assign_windows(pairs, F.col("_off"), window_us, stride_us).select("window_idx", "a", "b").distinct()


def window_neighbours(
    flows: DataFrame,
    windows: DataFrame | None = None,
    window_seconds: float = 60,
    stride_seconds: float = 30,
    origin=None,
) -> DataFrame:
    """(window_idx, host_id, peer) in both directions, so hosts that only receive are included.

    ``windows`` keeps only the window indices that occur in that table.
    """
    pairs = window_pairs(flows, window_seconds, stride_seconds, origin)
    if windows is not None:
        pairs = pairs.join(windows.select("window_idx").distinct(), "window_idx", "left_semi")
    ends = F.explode(F.array(F.struct(F.col("a").alias("h"), F.col("b").alias("p")),
                             F.struct(F.col("b").alias("h"), F.col("a").alias("p"))))
    # pairs are distinct and ordered, so both directions are distinct without another shuffle
    return pairs.select("window_idx", ends.alias("e")).select(
        "window_idx", F.col("e.h").alias("host_id"), F.col("e.p").alias("peer")
    )


def degrees(neighbours: DataFrame) -> DataFrame:
    return neighbours.groupBy("host_id", "window_idx").agg(F.count(F.lit(1)).alias("degree"))


def neighbour_features(
    neighbours: DataFrame, windows: DataFrame, names: list[str] = MODEL_FEATURES
) -> DataFrame:
    """Per (host, window): degree over all peers and the mean features of the peers that have a
    window row of their own. A popular peer makes the join skewed, not the result; AQE splits it."""
    names = [n for n in names if n in windows.columns]
    feats = windows.select(
        F.col("host_id").alias("peer"), "window_idx", *[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in names],
        F.lit(1).alias("_has"),
    )
    return (
        neighbours.join(feats, ["peer", "window_idx"], "left")
        .groupBy("host_id", "window_idx")
        .agg(
            F.count(F.lit(1)).alias("degree"),
            F.count("_has").alias("peers_with_features"),
            *[F.coalesce(F.avg(n), F.lit(0.0)).alias(n) for n in names],
        )
    )


def neighbour_sequences(
    windows: DataFrame,
    features: DataFrame,
    sequence_length: int = 10,
    stride_seconds: float = 30,
    names: list[str] = MODEL_FEATURES,
    block: int = BLOCK_ROWS,
) -> DataFrame:
    """Per sequence: neighbour means and degree aligned to every step (zeros without peers)."""
    names = [n for n in names if n in features.columns]
    side = features.select(
        "host_id", "window_idx", "degree", F.array(*[F.col(n).cast("float") for n in names]).alias("_near")
    )
    zeros = F.array_repeat(F.lit(0.0).cast("float"), len(names))
    rows = windows.select("host_id", "window_idx", "window_start", "window_end").join(
        side, ["host_id", "window_idx"], "left"
    )
    stride_us = check_grid(stride_seconds, stride_seconds)[1]
    blocked = blocked_windows(
        rows,
        [F.coalesce("_near", zeros).alias("near"), F.coalesce("degree", F.lit(0)).alias("degree")],
        stride_us,
        sequence_length - 1,
        0,
        block,
    )
    past = W.partitionBy("host_id", "_block").orderBy("row_idx").rowsBetween(-(sequence_length - 1), 0)
    framed = blocked.withColumns(
        {"neighbours": F.collect_list("near").over(past), "degrees": F.collect_list("degree").over(past)}
    ).filter(F.col("_own") & (F.col("row_idx") >= sequence_length - 1))
    first = (F.col("row_idx") - (sequence_length - 1)).cast("string")
    return framed.select(F.concat("host_id", F.lit("_seq_"), first).alias("sequence_id"), "host_id", "neighbours", "degrees")


def graph_summary(with_neighbours: DataFrame) -> DataFrame:
    """Mean degree over all steps and the share of steps with neighbour features."""
    per = with_neighbours.select(
        F.array_size("degrees").alias("steps"),
        F.aggregate("degrees", F.lit(0).cast("bigint"), lambda a, d: a + d).alias("degree_sum"),
        F.array_size(F.filter("neighbours", lambda v: F.exists(v, lambda x: x != 0))).alias("covered"),
    )
    return per.agg(
        (F.sum("degree_sum") / F.sum("steps")).alias("mean_degree"),
        (F.sum("covered") / F.sum("steps")).alias("share_with_neighbour_features"),
    )
