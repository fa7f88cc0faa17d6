"""Table comparison and unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def schema_differences(a: DataFrame, b: DataFrame) -> list[str]:
    left = {f.name: f.dataType.simpleString() for f in a.schema}
    right = {f.name: f.dataType.simpleString() for f in b.schema}
    out = [f"{n}: {left.get(n)} / {right.get(n)}" for n in sorted({*left, *right}) if left.get(n) != right.get(n)]
    if not out and a.columns != b.columns:
        out.append("column order differs")
    return out


def table_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that occur more often on one side, with both multiplicities; empty when equal.

    One shuffle over both tables: identical rows are counted together instead of two set
    differences.
    """
    names = a.columns
    sides = a.select("*", F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(
        b.select(*names).select("*", F.lit(0).alias("_a"), F.lit(1).alias("_b"))
    )
    counted = sides.groupBy(*names).agg(F.sum("_a").alias("left_rows"), F.sum("_b").alias("right_rows"))
    return counted.filter(F.col("left_rows") != F.col("right_rows"))


def diff_summary(a: DataFrame, b: DataFrame) -> DataFrame:
    d = table_diff(a, b)
    extra = F.col("left_rows") - F.col("right_rows")
    return d.agg(
        F.coalesce(F.sum(F.greatest(extra, F.lit(0))), F.lit(0)).alias("only_left"),
        F.coalesce(F.sum(F.greatest(-extra, F.lit(0))), F.lit(0)).alias("only_right"),
    ).withColumns({"left_total": a.agg(F.count(F.lit(1))).scalar(), "right_total": b.agg(F.count(F.lit(1))).scalar()})


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Union by name; columns that a table lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
