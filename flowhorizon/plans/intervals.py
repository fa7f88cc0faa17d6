"""Point-in-interval joins without nested loops.

Spark plans a range predicate as a nested-loop join. Here every interval is put on the time
level whose bucket width is just above its length, so it touches at most two buckets, and every
point is looked up once per level in use (at most 64). The join is then an equi-join on
(keys, level, bucket) that shuffles, can be skew-split by AQE, and becomes a broadcast join only
when Spark's own size check says so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    keys: list[tuple[str, str]],
    point_us: str,
    start_us: str,
    end_us: str,
    base_seconds: int = 600,
) -> DataFrame:
    """Inner join of points and intervals with ``start <= point <= end`` (microsecond columns).

    ``keys`` are (point column, interval column) pairs. Columns of both sides are kept, so
    their names must differ.
    """
    base = base_seconds * 1_000_000
    length = (F.col(end_us) - F.col(start_us) + 1) / F.lit(float(base))
    level = F.greatest(F.ceil(F.log2(F.greatest(length, F.lit(1.0)))), F.lit(0)).cast("int")
    spans = intervals.filter(F.col(end_us) >= F.col(start_us)).withColumn("_lvl", level)
    levels = spans.agg(F.array_sort(F.collect_set("_lvl")).alias("l")).scalar()  # <= 64 values

    def bucket(column):
        return F.floor(column / (F.lit(float(base)) * F.pow(F.lit(2.0), F.col("_lvl")))).cast("bigint")

    left = points.withColumn("_plvl", F.explode(levels)).withColumn(
        "_pbkt", F.floor(F.col(point_us) / (F.lit(float(base)) * F.pow(F.lit(2.0), F.col("_plvl")))).cast("bigint")
    )
    right = spans.withColumn("_bkt", F.explode(F.sequence(bucket(F.col(start_us)), bucket(F.col(end_us)))))
    on = (
        (F.col("_plvl") == F.col("_lvl"))
        & (F.col("_pbkt") == F.col("_bkt"))
        & (F.col(point_us) >= F.col(start_us))
        & (F.col(point_us) <= F.col(end_us))
    )
    for a, b in keys:
        on = on & (F.col(a) == F.col(b))
    return left.join(right, on, "inner").drop("_plvl", "_pbkt", "_lvl", "_bkt")
