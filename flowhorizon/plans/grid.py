"""The sliding-window grid: integer microseconds from the data's own first timestamp."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MICROS = 1_000_000


def grid_origin(flows: DataFrame, timestamp: str = "timestamp") -> Column:
    """Microseconds of the earliest timestamp, as a scalar subquery over one column."""
    return flows.agg(F.min(F.unix_micros(F.col(timestamp).cast("timestamp")))).scalar()


def origin_column(flows: DataFrame, origin, timestamp: str = "timestamp") -> Column:
    """``origin`` may be None (use the data), microseconds, or a timestamp string."""
    if origin is None:
        return grid_origin(flows, timestamp)
    if isinstance(origin, int):
        return F.lit(origin).cast("bigint")
    return F.unix_micros(F.lit(str(origin)).cast("timestamp"))


def check_grid(window_seconds: float, stride_seconds: float) -> tuple[int, int]:
    if not window_seconds or window_seconds <= 0 or not stride_seconds or stride_seconds <= 0:
        raise ValueError("window and stride must be positive")
    return round(window_seconds * MICROS), round(stride_seconds * MICROS)


def window_range(offset: Column, window_us: int, stride_us: int) -> tuple[Column, Column]:
    """First and last index of the windows that contain an offset (microseconds, >= 0).

    Window k covers ``[k*stride, k*stride + window)``; windows before the origin do not exist.
    With a stride above the window, an offset in a gap gives first > last.
    """
    last = F.floor(offset / F.lit(stride_us)).cast("bigint")
    # floor((offset - window) / stride) + 1, written with whole numbers only
    first = F.when(offset < window_us, F.lit(0).cast("bigint")).otherwise(
        (offset - window_us - F.pmod(offset - window_us, F.lit(stride_us))) / stride_us + 1
    )
    return first.cast("bigint"), last


def assign_windows(
    df: DataFrame, offset: Column, window_us: int, stride_us: int, name: str = "window_idx"
) -> DataFrame:
    """One row per (input row, window that contains it)."""
    first, last = window_range(offset, window_us, stride_us)
    if window_us == stride_us:
        return df.withColumn(name, last)
    ranged = df.withColumns({"_first": first, "_last": last})
    if stride_us > window_us:
        ranged = ranged.filter(F.col("_first") <= F.col("_last"))
    return ranged.withColumn(name, F.explode(F.sequence("_first", "_last"))).drop("_first", "_last")


def at_micros(micros: Column) -> Column:
    return F.timestamp_micros(micros)
