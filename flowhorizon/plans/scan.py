"""Ordered scans that never put one whole key into one task.

A window over ``partitionBy(key)`` gives a key with a third of the rows to a single task.
The helpers below cut every key into ordered segments, scan inside the segments, and add what
came before from per-segment totals. Only the totals table, smaller by the segment length, is
scanned per key; ``segments`` may list several levels, finest first, to split that one too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

_COMBINE = {
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "max": (F.max, lambda a, b: F.greatest(a, b)),  # greatest/least skip NULLs
    "min": (F.min, lambda a, b: F.least(a, b)),
}


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    segments: list[tuple[str, Column]],
    values: dict[str, tuple[str, str]],
) -> DataFrame:
    """Add exclusive running aggregates over all rows of the same key before the current row.

    ``segments`` are (name, expression) pairs, finest first; each expression must be a
    non-decreasing function of the first order column. ``values`` maps an output column to
    (``sum`` | ``max`` | ``min``, input column).
    """
    if not segments:
        frame = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
        return df.withColumns({out: _before(kind, F.col(col), frame) for out, (kind, col) in values.items()})
    name, expr = segments[0]
    df = df.withColumn(name, expr)
    upper = [n for n, _ in segments[1:]]
    frame = W.partitionBy(*keys, name).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    inner = df.withColumns({f"_in_{out}": _before(kind, F.col(col), frame) for out, (kind, col) in values.items()})
    totals = (
        df.withColumns(dict(segments[1:]))
        .groupBy(*keys, name, *upper)
        .agg(*[_COMBINE[kind][0](col).alias(f"_tot_{out}") for out, (kind, col) in values.items()])
    )
    offsets = running(
        totals,
        keys,
        [name],
        [(n, F.col(n)) for n in upper],
        {f"_off_{out}": (kind, f"_tot_{out}") for out, (kind, _) in values.items()},
    )
    # every (key, segment) of the rows is in the totals, so an inner join keeps all rows
    offsets = offsets.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col(name).alias(f"_k_{name}"), *[f"_off_{o}" for o in values]
    )
    on = None
    for k in [*keys, name]:
        term = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        on = term if on is None else on & term
    joined = inner.join(offsets, on, "inner")
    out = {o: _COMBINE[kind][1](F.col(f"_off_{o}"), F.col(f"_in_{o}")) for o, (kind, _) in values.items()}
    drop = [f"_k_{k}" for k in [*keys, name]] + [f"_in_{o}" for o in values] + [f"_off_{o}" for o in values]
    return joined.withColumns(out).drop(*drop, name)


def _before(kind: str, col: Column, frame) -> Column:
    value = _COMBINE[kind][0](col).over(frame)
    return F.coalesce(value, F.lit(0)) if kind == "sum" else value


def join_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, NULL being equal to NULL; the keys come from the left side."""
    renamed = right.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(renamed[f"_k_{k}"])
    return left.join(renamed, on, how).drop(*[f"_k_{k}" for k in keys])


def row_index(
    df: DataFrame, keys: list[str], order: list[str], segment: Column, name: str = "row_idx"
) -> DataFrame:
    """0-based position of each row inside its key, by ``order``."""
    one = df.withColumn("_one", F.lit(1).cast("bigint"))
    return running(one, keys, order, [("_seg", segment)], {name: ("sum", "_one")}).drop("_one")


def with_halo(
    df: DataFrame, position: str, before: int, after: int, block: int, name: str = "_block"
) -> DataFrame:
    """Copy rows into fixed-size position blocks so that row frames never leave a block.

    Row ``p`` belongs to block ``p // block``; it is also copied to neighbour blocks whose own
    rows look up to ``before`` rows back or ``after`` rows ahead. ``_own`` marks the original.
    """
    p = F.col(position)
    first = F.greatest(F.floor((p - after) / block), F.lit(0))
    last = F.floor((p + before) / block)
    return df.withColumn(name, F.explode(F.sequence(first.cast("bigint"), last.cast("bigint")))).withColumn(
        "_own", F.col(name) == F.floor(p / block)
    )


def with_time_halo(
    df: DataFrame, micros: str, back_micros: int, span_micros: int, name: str = "_span"
) -> DataFrame:
    """Like :func:`with_halo` for frames that look back a fixed time: rows are copied to the later
    time spans that can still see them. ``span_micros`` should be well above ``back_micros``."""
    t = F.col(micros)
    first = F.floor(t / span_micros).cast("bigint")
    last = F.floor((t + back_micros) / span_micros).cast("bigint")
    return df.withColumn(name, F.explode(F.sequence(first, last))).withColumn("_own", F.col(name) == first)


def spread_small(df: DataFrame) -> DataFrame:
    """Deal a table with fewer splits than cores out to all cores.

    Only inputs of a few splits qualify (a large table has more splits than cores and is returned
    as it is), so what moves is at most ``cores x spark.sql.files.maxPartitionBytes``.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: rows a task of :func:`spread_rows` takes
ROWS_A_TASK = 100_000


def row_tasks(stored: DataFrame, rows: int = ROWS_A_TASK) -> int:
    """Tasks for a stored table that give each at most about ``rows`` rows; counting Parquet reads its footers only."""
    return max(stored.sparkSession.sparkContext.defaultParallelism, -(-stored.count() // rows))


def spread_rows(stored: DataFrame, rows: int = ROWS_A_TASK) -> DataFrame:
    """Deal a stored table out by its number of rows, where every row becomes many groups of a map-side aggregate.

    Splits follow the compressed size, so well packed rows would come by the million to a task, and its aggregate's memory
    would grow with the table.
    """
    tasks = row_tasks(stored, rows)
    return stored.repartition(tasks) if stored.rdd.getNumPartitions() < tasks else stored
