"""First match among overlapping intervals by a segment tree.

The bounds of a key's intervals cut its time axis into pieces. A binary tree stands over the pieces; an interval is split
into its canonical nodes, two a level at most, and a node keeps only its first interval, so what overlaps is settled
before any point is looked at. A piece then takes the first of the winners on its way to the root. A point belongs to the last
piece that begins at or before it, found in one ordered scan. Work is (bounds x levels) rows plus one row per
point, however many intervals cover it, and no key has to fit one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..sinks.tables import stage
from .scan import row_index, running

SEGMENT_US = 86_400_000_000
FOREVER = 1 << 62


def canonical(lo: Column, hi: Column) -> Column:
    """Nodes (level, node) that together are the pieces ``lo`` .. ``hi - 1``; node ``n`` of a level holds the pieces
    ``n * 2 ** level`` .. ``(n + 1) * 2 ** level - 1``."""

    levels = F.sequence(F.lit(0), F.floor(F.log2(hi - lo)).cast("int"))

    def nodes(level: Column) -> Column:
        span = F.pow(F.lit(2.0), level).cast("bigint")
        left, right = F.ceil(lo / span), F.floor(hi / span)
        node = lambda n: F.struct(level.alias("level"), n.cast("bigint").alias("node"))
        return F.array(
            F.when((left < right) & (left % 2 == 1), node(left)), F.when((left < right) & (right % 2 == 1), node(right - 1))
        )

    return F.array_compact(F.flatten(F.transform(levels, nodes)))


def pieces(intervals: DataFrame, keys: list[str], start: str, end: str, rule: str, order: str) -> DataFrame:
    """(keys, ``_at``, ``_rule``): from ``_at`` microseconds on, until the key's next piece, ``_rule`` is the first rule by
    ``order`` whose interval (both ends included) holds; NULL where none does. Keys that are NULL match nothing."""
    spans = intervals.filter((F.col(end) >= F.col(start)) & F.expr(" and ".join(f"`{k}` is not null" for k in keys)))
    spans = spans.select(*keys, F.col(start).alias("_s"), (F.col(end) + 1).alias("_e"), F.col(rule).alias("_rule"), F.col(order).alias("_o"))
    marks = spans.select(*keys, F.explode(F.array("_s", "_e")).alias("_at")).distinct()
    ranked = stage(row_index(marks, keys, ["_at"], F.floor(F.col("_at") / SEGMENT_US), "_rank"), "bounds")
    low = ranked.select(*keys, F.col("_at").alias("_s"), F.col("_rank").alias("_lo"))
    high = ranked.select(*keys, F.col("_at").alias("_e"), F.col("_rank").alias("_hi"))
    placed = spans.join(low, [*keys, "_s"]).join(high, [*keys, "_e"])
    nodes = placed.withColumn("_n", F.explode(canonical(F.col("_lo"), F.col("_hi"))))
    best = nodes.groupBy(*keys, F.col("_n.level").alias("_level"), F.col("_n.node").alias("_node")).agg(
        F.min_by("_rule", "_o").alias("_rule"), F.min("_o").alias("_o")
    )
    best = stage(best, "nodes")
    deepest = best.agg(F.coalesce(F.max("_level"), F.lit(0))).scalar()
    up = ranked.withColumn("_level", F.explode(F.sequence(F.lit(0), deepest)))
    up = up.withColumn("_node", F.floor(F.col("_rank") / F.pow(F.lit(2.0), F.col("_level"))).cast("bigint"))
    return up.join(best, [*keys, "_level", "_node"], "left").groupBy(*keys, "_at").agg(F.min_by("_rule", "_o").alias("_rule"))


def first_at(points: DataFrame, found: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Points (keys, ``at`` microseconds) that lie in a piece with a rule, and that rule as ``_hit``."""
    none = F.lit(None).cast(found.schema["_rule"].dataType)
    starts = found.select(*keys, F.col("_at").alias(at), F.lit(0).alias("_kind"), F.struct("_at", "_rule").alias("_mark"))
    asks = points.select(*keys, at, F.lit(1).alias("_kind"), F.when(F.lit(False), F.struct(F.lit(0).cast("bigint").alias("_at"), none.alias("_rule"))).alias("_mark"))
    scanned = running(
        starts.union(asks), keys, [at, "_kind"], [("_segment", F.floor(F.col(at) / SEGMENT_US))], {"_last": ("max", "_mark")}
    )
    hit = scanned.filter((F.col("_kind") == 1) & F.col("_last._rule").isNotNull())
    return hit.select(*keys, at, F.col("_last._rule").alias("_hit"))
