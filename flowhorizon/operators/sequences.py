"""Fixed-length window sequences with strictly future targets.

Windows get their position inside the host by a segmented scan, then are copied into position
blocks with a halo, so the row frames below run per (host, block): a host with a very long
history is spread over many tasks and the result is the same as one ordered pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.lookups import MODEL_FEATURES, STAGE_ORDER, WINDOW_FEATURES
from ..functions.vectors import pick
from ..plans.grid import check_grid
from ..plans.scan import row_index, with_halo

SEGMENT_WINDOWS = 4096
BLOCK_ROWS = 2048


def _feature_names(windows: DataFrame, features: list[str] | None) -> list[str]:
    names = [c for c in (features or WINDOW_FEATURES) if c in windows.columns]
    if not names:
        raise ValueError("no feature columns in the window table")
    return names


def _vector(names: list[str]) -> Column:
    return F.array(*[F.coalesce(F.col(c).cast("float"), F.lit(0.0).cast("float")) for c in names])


def blocked_windows(
    windows: DataFrame, columns: list[Column], stride_us: int, before: int, after: int, block: int = BLOCK_ROWS
) -> DataFrame:
    """Windows with ``row_idx`` in the host, copied into position blocks with a halo."""
    slim = windows.select(
        F.col("host_id").cast("string").alias("host_id"),
        F.unix_micros(F.col("window_start").cast("timestamp")).alias("_us"),
        "window_start",
        "window_end",
        *columns,
    )
    segment = F.floor(F.col("_us") / F.lit(stride_us * SEGMENT_WINDOWS))
    return with_halo(row_index(slim, ["host_id"], ["_us"], segment), "row_idx", before, after, block)


def build_sequences(
    windows: DataFrame,
    sequence_length: int = 10,
    forecast_horizon: int = 1,
    stride: int = 1,
    window_seconds: float = 60,
    stride_seconds: float = 30,
    features: list[str] | None = None,
    block: int = BLOCK_ROWS,
) -> DataFrame:
    """Every run of ``sequence_length`` windows per host with its ``forecast_horizon``-th window
    that starts strictly after the run's end. Runs without such a window are left out.

    At most ``window // stride`` later windows can overlap the end of a run, so the target is
    always among the next ``window // stride + horizon`` rows and the frame stays bounded.
    """
    _check(sequence_length, forecast_horizon, stride)
    window_us, stride_us = check_grid(window_seconds, stride_seconds)
    names = _feature_names(windows, features)
    ahead = window_us // stride_us + forecast_horizon
    rows = blocked_windows(
        windows,
        [
            _vector(names).alias("features"),
            "attack_present",
            "dominant_class",
            "dominant_stage",
            "stage_distribution",
            "label_confidence",
        ],
        stride_us,
        sequence_length - 1,
        ahead,
        block,
    )
    by_host = W.partitionBy("host_id", "_block").orderBy("row_idx")
    past = by_host.rowsBetween(-(sequence_length - 1), 0)
    later = F.collect_list(
        F.struct(
            F.col("window_start").alias("start"), F.col("window_end").alias("end"), "features",
            "attack_present", "dominant_class", "dominant_stage", "stage_distribution", "label_confidence",
        )
    ).over(by_host.rowsBetween(1, ahead))
    framed = rows.withColumns(
        {
            "_inputs": F.collect_list("features").over(past),
            "_start": F.min("window_start").over(past),
            "_attacked": F.max("attack_present").over(past),
            "_later": later,
        }
    ).filter(F.col("_own") & (F.col("row_idx") >= sequence_length - 1))
    first = F.col("row_idx") - (sequence_length - 1)
    if stride > 1:
        framed = framed.filter(first % stride == 0)
    end = F.col("window_end")
    target = F.get(F.filter("_later", lambda w: w["start"] > end), F.lit(forecast_horizon - 1))
    hit = framed.withColumn("_t", target).filter(F.col("_t").isNotNull())
    return hit.select(
        F.concat("host_id", F.lit("_seq_"), first.cast("string")).alias("sequence_id"),
        "host_id",
        F.col("host_id").alias("target_host_id"),
        F.col("_start").alias("seq_start_time"),
        F.col("window_end").alias("seq_end_time"),
        F.col("_t.start").alias("target_window_start"),
        F.col("_t.end").alias("target_window_end"),
        F.lit(forecast_horizon).alias("forecast_horizon"),
        F.lit(sequence_length).alias("sequence_length"),
        F.col("_inputs").alias("sequence_features"),
        F.col("_t.features").alias("target_features"),
        F.col("_t.attack_present").alias("target_attack_present"),
        F.col("_t.dominant_class").alias("target_dominant_class"),
        F.col("_t.dominant_stage").alias("target_dominant_stage"),
        F.col("_t.stage_distribution").alias("target_stage_distribution"),
        F.col("_t.label_confidence").alias("target_label_confidence"),
        ((F.col("_t.attack_present") == 1) & (F.col("_attacked") == 0)).alias("target_is_onset"),
    )


def _check(length: int, horizon: int, stride: int) -> None:
    if length < 1 or horizon < 1 or stride < 1:
        raise ValueError("sequence_length, forecast_horizon and stride must be at least 1")


def inference_sequences(
    windows: DataFrame,
    sequence_length: int = 10,
    features: list[str] | None = None,
    stride_seconds: float = 30,
    block: int = BLOCK_ROWS,
) -> DataFrame:
    """Every run of ``sequence_length`` windows per host; no target, no labels needed."""
    _check(sequence_length, 1, 1)
    names = features or MODEL_FEATURES
    missing = [c for c in names if c not in windows.columns]
    if missing:
        raise ValueError(f"window table lacks feature columns {missing}")
    stride_us = check_grid(stride_seconds, stride_seconds)[1]
    rows = blocked_windows(windows, [_vector(names).alias("features")], stride_us, sequence_length - 1, 0, block)
    past = W.partitionBy("host_id", "_block").orderBy("row_idx").rowsBetween(-(sequence_length - 1), 0)
    framed = rows.withColumns(
        {"_inputs": F.collect_list("features").over(past), "_start": F.min("window_start").over(past)}
    ).filter(F.col("_own") & (F.col("row_idx") >= sequence_length - 1))
    first = (F.col("row_idx") - (sequence_length - 1)).cast("string")
    return framed.select(
        F.concat("host_id", F.lit("_seq_"), first).alias("sequence_id"),
        "host_id",
        F.col("_start").alias("seq_start_time"),
        F.col("window_end").alias("seq_end_time"),
        F.col("_inputs").alias("sequence_features"),
    )


def future_windows(
    windows: DataFrame,
    horizons: int,
    window_seconds: float = 60,
    stride_seconds: float = 30,
    features: list[str] | None = None,
    block: int = BLOCK_ROWS,
) -> DataFrame:
    """Per window: feature vectors of the next ``horizons`` windows that start after it ends."""
    if horizons < 1:
        raise ValueError("horizons must be at least 1")
    window_us, stride_us = check_grid(window_seconds, stride_seconds)
    names = features or MODEL_FEATURES
    missing = [c for c in names if c not in windows.columns]
    if missing:
        raise ValueError(f"window table lacks feature columns {missing}")
    ahead = window_us // stride_us + horizons
    rows = blocked_windows(windows, [_vector(names).alias("features")], stride_us, 0, ahead, block)
    frame = W.partitionBy("host_id", "_block").orderBy("row_idx").rowsBetween(1, ahead)
    later = F.collect_list(F.struct(F.col("window_start").alias("start"), "features")).over(frame)
    end = F.col("window_end")
    return (
        rows.withColumn("_later", later)
        .filter("_own")
        .select(
            "host_id",
            "window_end",
            F.slice(F.transform(F.filter("_later", lambda w: w["start"] > end), lambda w: w["features"]), 1, horizons).alias(
                "future_features"
            ),
        )
    )


def multi_horizon_targets(sequences: DataFrame, windows: DataFrame, horizons: int, **grid) -> DataFrame:
    """Attach ``future_features`` (up to K vectors) and ``future_count`` to sequences.

    A sequence ends where its last input window ends, so the anchor is an equi-join.
    """
    future = future_windows(windows, horizons, **grid).withColumnRenamed("window_end", "seq_end_time")
    joined = sequences.join(future, ["host_id", "seq_end_time"], "left")
    return joined.withColumn("future_count", F.coalesce(F.array_size("future_features"), F.lit(0)))


def horizon_off(rtol: float = 1e-4, atol: float = 1e-3, stored: list[str] = WINDOW_FEATURES, names: list[str] = MODEL_FEATURES) -> Column:
    """True where the first future window (features ``names``) differs from the row's own target (features ``stored``)."""
    expected = pick(F.col("target_features"), stored, names)
    got = F.get("future_features", F.lit(0))
    off = F.exists(
        F.zip_with(got, expected, lambda a, b: F.abs(a - b) > F.lit(atol) + F.lit(rtol) * F.abs(b)), lambda x: x
    )
    return (F.col("future_count") > 0) & off


def horizon_mismatches(
    with_future: DataFrame, rtol: float = 1e-4, atol: float = 1e-3, stored: list[str] = WINDOW_FEATURES, names: list[str] = MODEL_FEATURES
) -> DataFrame:
    """Sequences whose first future window (features ``names``) differs from their own target (features ``stored``)."""
    return with_future.filter(horizon_off(rtol, atol, stored, names))


def unknown_stages(sequences: DataFrame) -> DataFrame:
    """Distinct target stages outside the canonical order."""
    stage = F.col("target_dominant_stage")
    return sequences.filter(~stage.isin(STAGE_ORDER)).select("target_dominant_stage").distinct()


def chronology_violations(sequences: DataFrame, windows: DataFrame | None = None) -> DataFrame:
    """One row of counts that must all be zero."""
    out = sequences.agg(
        F.count(F.when(F.col("target_window_start") <= F.col("seq_end_time"), 1)).alias("overlapping_targets"),
        F.count(F.when(F.col("seq_end_time") <= F.col("seq_start_time"), 1)).alias("inverted_inputs"),
        F.count(F.when(F.col("target_host_id") != F.col("host_id"), 1)).alias("foreign_targets"),
    )
    if windows is None:
        return out
    twice = windows.groupBy("host_id", "window_start").count().filter("count > 1").agg(F.count(F.lit(1))).scalar()
    return out.withColumn("repeated_windows", twice)


def select_model_inputs(sequences: DataFrame, sequence_length: int | None = None) -> DataFrame:
    """Drop the label-derived features; ``raise_error`` on rows of the wrong shape."""
    required = [
        "sequence_features", "target_features", "target_attack_present",
        "target_dominant_class", "target_dominant_stage", "split",
    ]
    missing = [c for c in required if c not in sequences.columns]
    if missing:
        raise ValueError(f"sequence table lacks columns {missing}")
    width = len(WINDOW_FEATURES)
    good = F.forall("sequence_features", lambda v: F.array_size(v) == width) & (
        F.array_size("target_features") == width
    )
    if sequence_length is not None:
        good = good & (F.array_size("sequence_features") == sequence_length)
    at = [WINDOW_FEATURES.index(n) for n in MODEL_FEATURES]
    inputs = F.transform("sequence_features", lambda v: F.slice(v, at[0] + 1, len(at)))
    return sequences.withColumn(
        "model_inputs",
        F.when(good, inputs).otherwise(F.raise_error(F.lit("sequence or target has an unexpected shape"))),
    )


def filter_sequences(
    sequences: DataFrame, ids: DataFrame | None = None, split: str | None = None, limit: int | None = None
) -> DataFrame:
    """By id table (left-semi), by split, or the first ``limit`` rows in id order.

    Ids that no sequence has are an error.
    """
    if ids is not None:
        absent = [r[0] for r in missing_ids(sequences, ids).orderBy("sequence_id").limit(20).collect()]
        if absent:
            raise ValueError(f"sequences not found, first {absent}")
        sequences = sequences.join(ids.select("sequence_id"), "sequence_id", "left_semi")
    if split is not None:
        sequences = sequences.filter(F.col("split") == split)
    return sequences.orderBy("sequence_id").limit(limit) if limit else sequences


def missing_ids(sequences: DataFrame, ids: DataFrame) -> DataFrame:
    return ids.select("sequence_id").join(sequences.select("sequence_id"), "sequence_id", "left_anti")


def last_window_rule(column: str = "sequence_features", names: list[str] = WINDOW_FEATURES) -> Column:
    """1 when the last input window already shows attack flows. Reads labels: reference only."""
    at = names.index("attack_flow_ratio")
    return (F.element_at(column, -1)[at] > 0).cast("int")
