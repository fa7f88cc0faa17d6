"""Orbits of a jump function over ordered rows, without one task seeing a whole key.

Where a cut depends on the cut before it (a flow begins, and its begin decides where it ends), each row
knows the row a cut *there* would lead to. The cuts are the rows reached from row 0. Rows come in blocks; a block is
a transducer that maps each row at which it may be entered to the row at which it is left. Maps of neighbouring blocks are
composed pairwise into a tree, and on the way back down each node learns where it is entered, so that every block
can mark its own cuts. Rounds are the logarithm of the number of blocks of the longest key.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..sinks.tables import stage
from .scan import join_keys

BLOCK = 16_384
GROUP = 50_000  # rows a task handles at once, about


def _runs(block: np.ndarray) -> np.ndarray:
    """Position at which the run of each row's block ends; rows are sorted by block."""
    last = np.flatnonzero(np.append(block[1:] != block[:-1], True)) + 1
    return last[np.searchsorted(last, np.arange(len(block)), side="right")]


def _dealt(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Rows with the hash of their block, and whole blocks dealt out to groups of about ``GROUP`` rows."""
    hashed = rows.withColumn("_bid", F.xxhash64(*keys, "_block"))
    return hashed.withColumn("_group", F.pmod("_bid", F.lit(max(1, n // GROUP))))


def _sorted(table):
    """The group's rows by block and position, with where each would jump to among them."""
    bid, i, to = (table.column(c).to_numpy() for c in ("_bid", "_i", "_next"))
    order = np.lexsort((i, bid))
    bid, i, to = bid[order], i[order], to[order]
    ends = _runs(bid) if len(bid) else bid
    return order, bid, i, to, np.arange(len(i)) + (to - i), ends


def block_exits(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """(keys, ``_i``, ``_exit``): where the block of row ``_i`` is left when it is entered there."""
    schema = rows.select(*keys, "_i", F.col("_next").alias("_exit")).schema

    def run(table):
        import pyarrow as pa

        order, _, _, to, target, ends = _sorted(table)
        out, target, ends = to.tolist(), target.tolist(), ends.tolist()
        for p in range(len(out) - 1, -1, -1):
            if target[p] < ends[p]:
                out[p] = out[target[p]]
        kept = table.take(pa.array(order)).select([*keys, "_i"])
        return kept.append_column("_exit", pa.array(out, pa.int64()))

    return _dealt(rows, keys, n).groupBy("_group").applyInArrow(run, schema)


def mark_entered(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """(keys, ``_i``) of the rows reached in their block from its ``_entry``."""
    schema = rows.select(*keys, "_i").schema

    def run(table):
        import pyarrow as pa

        order, bid, i, _, target, ends = _sorted(table)
        entry = table.column("_entry").to_numpy()[order]
        hit, target, ends = [], target.tolist(), ends.tolist()
        for first in np.flatnonzero(np.append(True, bid[1:] != bid[:-1])).tolist() if len(bid) else []:
            p = first + int(entry[first] - i[first])
            while p < ends[first]:
                hit.append(p)
                p = target[p]
        return table.take(pa.array(order[hit])).select([*keys, "_i"])

    return _dealt(rows, keys, n).groupBy("_group").applyInArrow(run, schema)


def reached(jumps: DataFrame, keys: list[str], block: int | None = None) -> DataFrame:
    """Rows (keys, ``_i``) reached from row 0 of every key. ``jumps`` (keys, ``_i``, ``_next``) numbers the rows of a key
    from 0 without gaps, ``_next`` is behind ``_i``; one behind the last row ends the orbit."""
    block = block or BLOCK
    rows = stage(jumps.select(*keys, "_i", "_next", F.floor(F.col("_i") / block).alias("_block")), "jumps")
    n, most = rows.agg(F.count(F.lit(1)), F.coalesce(F.max("_block"), F.lit(0)) + 1).first()
    levels = max(0, int(most) - 1).bit_length()
    maps = [stage(block_exits(rows, keys, n), "exits")] if levels else []
    for level in range(1, levels):
        size = block << level
        below = maps[-1]
        inner = F.floor(F.col("_exit") / size) == F.floor(F.col("_i") / size)  # left for the node's other half
        onward = below.select(*keys, F.col("_i").alias("_at"), F.col("_exit").alias("_then"))
        asked = below.withColumn("_at", F.when(inner, F.col("_exit")))
        maps.append(stage(join_keys(asked, onward, [*keys, "_at"], "left").select(*keys, "_i", F.coalesce("_then", "_exit").alias("_exit")), "exits"))
    nodes = rows.filter("_i = 0").select(*keys, F.lit(0).cast("bigint").alias("_node"), F.lit(0).cast("bigint").alias("_entry"))
    for level in range(levels - 1, -1, -1):
        half = block << level
        middle = (F.col("_node") * 2 + 1) * half
        left = maps[level].select(*keys, F.col("_i").alias("_entry"), "_exit")
        # an entry behind the middle passes the left half by; else the right half is entered where the left one is left
        met = join_keys(nodes, left, [*keys, "_entry"], "left").withColumn(
            "_right", F.when(F.col("_entry") >= middle, F.col("_entry")).otherwise(F.col("_exit"))
        )
        one = met.filter(F.col("_entry") < middle).select(*keys, (F.col("_node") * 2).alias("_node"), "_entry")
        two = met.filter(F.col("_right") < middle + half).select(*keys, (F.col("_node") * 2 + 1).alias("_node"), F.col("_right").alias("_entry"))
        nodes = stage(one.union(two), "entries")
    entered = join_keys(rows, nodes.withColumnRenamed("_node", "_block"), [*keys, "_block"])
    return mark_entered(entered, keys, n)
