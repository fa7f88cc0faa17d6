"""Exact, linearly interpolated quantiles that scale past one reducer's memory.

``percentile`` keeps every distinct value of a group in one buffer. For grid-valued columns
(window times, gaps) that is fine after counting equal values first: :func:`grid_quantiles`.
For free doubles :func:`select_ranks` finds order statistics by radix selection: a double becomes
a whole number in the same order, values are counted by its highest 16 bits, only the bucket that holds
a wanted rank is opened and counted by the next 16, and after four rounds the bucket is one value.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..sinks.tables import stage
from .scan import join_keys

DIGIT, ROUNDS = 16, 4


def grid_quantiles(df: DataFrame, value: str, fractions: list[float], groups: list[str] = ()) -> DataFrame:
    """One row per group: ``quantiles`` array of ``value`` (NULLs ignored)."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_n"))
    q = F.percentile(value, F.array(*[F.lit(float(f)) for f in fractions]), F.col("_n"))
    return counted.groupBy(*groups).agg(q.alias("quantiles"))


def ordered_key(x: Column) -> Column:
    """A 64-bit whole number in the order of the double ``x``: exponent above mantissa, sign in front; both zeros are 0
    and NaN is above infinity, as Spark sorts it.

    The exponent from the logarithm may be off by one and is set right by the mantissa, which the division by a power of
    two leaves exact.
    """
    size = F.abs(x.cast("double"))
    near = F.least(F.greatest(F.floor(F.log2(size)), F.lit(-1022)), F.lit(1023)).cast("int")
    scaled = size / F.pow(F.lit(2.0), near)
    step = F.when(scaled >= 2, 1).when((scaled < 1) & (near > -1022), -1).otherwise(0)
    exponent = near + step
    mantissa = (size / F.pow(F.lit(2.0), exponent) * F.lit(2.0**52)).cast("bigint")
    key = F.shiftleft((exponent + 1022).cast("bigint"), 52) + mantissa
    key = F.when(size == 0, F.lit(0).cast("bigint")).when(size == float("inf"), F.lit(2047 << 52)).otherwise(key)
    return F.when(F.isnan(size), F.lit((1 << 63) - 1)).when(x < 0, -key).otherwise(key)


def same(left: DataFrame, right: DataFrame, keys: list[str], *more: Column) -> Column:
    """Join condition on equal keys, NULL being equal to NULL."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys] + list(more), F.lit(True))


def select_ranks(df: DataFrame, value: str, ranks: DataFrame, groups: list[str], weight: str | None = None) -> DataFrame:
    """Stored order statistics: for every row (``groups``, ``rank``) of ``ranks``, with ranks from 0, the ``value`` of
    that rank among the group's values, how many are ``below`` it and how many are ``equal`` to it.

    ``weight`` says how many times a row counts, once by default. Ranks outside the group have no row. ``df`` is read
    once: equal values are counted and stored with their key, and the rounds read that. Each round combines its counts
    before they are shuffled; a group's buckets of one round are at most 65,536 rows, however many values there are.
    """
    times = F.sum(weight) if weight else F.count(F.lit(1))
    counted = df.filter(F.col(value).isNotNull()).groupBy(*groups, F.col(value).cast("double").alias("_x")).agg(times.alias("_w"))
    rows = stage(counted.withColumn("_key", ordered_key(F.col("_x"))), "values")
    opened = ranks.select(*groups, F.col("rank"), F.lit(0).cast("bigint").alias("_prefix"), F.lit(0).cast("bigint").alias("_base")).distinct()
    for k in range(ROUNDS):
        shift = 64 - DIGIT * (k + 1)
        above = F.shiftright("_key", shift + DIGIT) if k else F.lit(0).cast("bigint")
        known = rows.withColumns({"_above": above, "_bucket": F.shiftright("_key", shift)})
        wanted = opened.select(*groups, "_prefix").distinct()
        inside = known.join(wanted, same(known, wanted, groups, known["_above"] == wanted["_prefix"]), "left_semi")
        counts = inside.groupBy(*groups, "_above", "_bucket").agg(F.sum("_w").alias("_c"), F.min("_x").alias("_least"))
        order = W.partitionBy(*groups, "_above").orderBy("_bucket")
        counts = counts.withColumn("_end", F.sum("_c").over(order.rowsBetween(W.unboundedPreceding, 0)))
        opened = opened.drop("_c", "_least")
        on = same(opened, counts, groups, opened["_prefix"] == counts["_above"])
        place = opened["rank"] - opened["_base"]
        hit = opened.join(counts, on).filter((place < counts["_end"]) & (place >= counts["_end"] - counts["_c"]))
        keep = [opened[g].alias(g) for g in groups] + [opened["rank"], counts["_bucket"].alias("_prefix")]
        opened = stage(
            hit.select(*keep, (opened["_base"] + counts["_end"] - counts["_c"]).alias("_base"), "_c", "_least"), "ranks"
        )
    return opened.select(
        *groups, "rank", F.col("_least").alias("value"), F.col("_base").alias("below"), F.col("_c").alias("equal")
    )


def select_union_ranks(
    df: DataFrame, value: str, ranks: list[tuple], group: str, part: str, members: list[list], weight: str
) -> list[tuple]:
    """Order statistics of many overlapping sets at once: set ``s`` holds the rows whose ``part`` is one of ``members[s]``.

    ``ranks`` lists (set, group, rank), and (set, group, rank, value) come back, ranks outside a set left out. The rows
    are counted by part and never copied into the sets: as in :func:`select_ranks` a round counts the opened buckets by
    16 bits more, and each bucket's counts, at most 65,536 for every part, are summed for all sets in one matrix.
    """
    parts = sorted({p for m in members for p in m})
    at = {p: i for i, p in enumerate(parts)}
    inside = np.zeros((len(members), len(parts)))
    for s, m in enumerate(members):
        inside[s, [at[p] for p in m]] = 1
    slim = df.filter(F.col(value).isNotNull() & F.col(part).isin(parts))
    rows = stage(slim.select(group, part, F.col(value).cast("double").alias("_x"), F.col(weight).alias("_w"), ordered_key(F.col(value)).alias("_key")), "values")
    opened = [(s, g, r, 0, 0) for s, g, r in ranks]  # set, group, rank, prefix, rows before the prefix
    for k in range(ROUNDS):
        shift = 64 - DIGIT * (k + 1)
        above = F.shiftright("_key", shift + DIGIT) if k else F.lit(0).cast("bigint")
        asked: dict[tuple, list] = {}
        for s, g, r, prefix, before in opened:
            asked.setdefault((g, prefix), []).append((s, r, before))
        wanted = df.sparkSession.createDataFrame(list(asked), f"{group} int, _above bigint")
        known = rows.withColumns({"_above": above, "_bucket": F.shiftright("_key", shift)}).join(F.broadcast(wanted), [group, "_above"])
        counts = known.groupBy(group, "_above", part, "_bucket").agg(F.sum("_w").alias("_c"), F.min("_x").alias("_least"))

        def place(table: pa.Table) -> pa.Table:
            buckets, back = np.unique(table["_bucket"].to_numpy(), return_inverse=True)
            each = np.zeros((len(parts), len(buckets)))
            index = np.array([at[p] for p in table[part].to_pylist()])
            np.add.at(each, (index, back), table["_c"].to_numpy())
            least = np.full(len(buckets), np.inf)
            np.fmin.at(least, back, table["_least"].to_numpy())
            ends = np.cumsum(inside @ each, axis=1)
            g, prefix = table[group][0].as_py(), table["_above"][0].as_py()
            out = []
            for s, r, before in asked[g, prefix]:
                b = int(np.searchsorted(ends[s], r - before, side="right"))
                if b < len(buckets):
                    out.append((s, g, r, int(buckets[b]), before + int(ends[s, b - 1] if b else 0), float(least[b])))
            names = ["s", "g", "r", "prefix", "before", "least"]
            return pa.table({n: pa.array([o[i] for o in out], pa.float64() if n == "least" else pa.int64()) for i, n in enumerate(names)})

        placed = counts.groupBy(group, "_above").applyInArrow(place, "s bigint, g bigint, r bigint, prefix bigint, before bigint, least double")
        found = [tuple(r) for r in placed.collect()]
        opened = [r[:5] for r in found]
    return [(s, g, r, least) for s, g, r, _, _, least in found]


def exact_quantiles(df: DataFrame, value: str, fractions: list[float], groups: list[str]) -> DataFrame:
    """One row per (group, fraction): ``fraction``, ``quantile``, ``n``. ``df`` is read twice, so give it stored."""
    sizes = df.filter(F.col(value).isNotNull()).groupBy(*groups).agg(F.count(F.lit(1)).alias("n"))
    wanted = sizes.withColumn("fraction", F.explode(F.array(*[F.lit(float(f)) for f in fractions])))
    wanted = stage(wanted.withColumn("place", (F.col("n") - 1) * F.col("fraction")), "fractions")
    ends = F.explode(F.array(F.floor("place"), F.ceil("place"))).alias("rank")
    found = select_ranks(df, value, wanted.select(*groups, ends), groups)
    return between(wanted, found, groups).select(*groups, "fraction", "quantile", "n")


def between(wanted: DataFrame, found: DataFrame, groups: list[str], place: str = "place", out: str = "quantile") -> DataFrame:
    """Add the linear interpolation at ``place`` of the order statistics around it."""
    low = found.select(*groups, F.col("rank").alias("_r"), F.col("value").alias("_a"))
    high = found.select(*groups, F.col("rank").alias("_s"), F.col("value").alias("_b"))
    ends = wanted.withColumns({"_r": F.floor(place), "_s": F.ceil(place)})
    both = join_keys(join_keys(ends, low, [*groups, "_r"]), high, [*groups, "_s"])
    part = F.col(place) - F.floor(F.col(place))
    between = F.when(part == 0, F.col("_a")).otherwise(F.col("_a") + (F.col("_b") - F.col("_a")) * part)
    return both.withColumn(out, between).drop("_r", "_s", "_a", "_b")
