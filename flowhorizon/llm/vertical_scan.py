"""Hard negatives by a vertical branch-and-bound scan.

Vectors are packed into blocks of columns, one column of integers per dimension with its least and greatest value. An
anchor reads the columns in the order of its own descending magnitudes. What the unread columns can still add to a
row's inner product lies between the sums of their least and greatest contributions in the row's block; rows whose
range of possible scores meets no range that is wanted leave the anchor's candidate bitmap, and the scores of those
left become exact with the last column.

Two scans: the first finds every anchor's positives (the best rows of its label), the second, for every positive, the best
rows of other labels whose score lies in that positive's window. A range ends early where enough rows are certain to be
better. Anchors, in blocks, meet rows, in lanes of blocks, in groups of bounded size: what a group returns
is at most the wanted number of rows for each of its anchors, and these are ranked again over all lanes.

Scores are exact integers: a component x becomes floor(``SCALE`` * x), limited to the range in which the inner product
of its vector's length fits 64 bits.

Defined results: rows with a null label, a null or empty vector, or a null or non-finite component take no part;
vectors of another length than the anchor's have no score with it; a row without id can be found, after all
ids of its score, but is no anchor; repeated rows are rows of their own, as anchors and as what is
found; an anchor without positives or without rows in a window has no row; an empty table gives an empty result;
other columns are not looked at.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import stored

SCALE, POSITIVES, NEGATIVES = 256, 5, 10
LEAST, MOST = 30, 90  # of a hundred parts of the positive's score
BLOCK_ROWS, ANCHOR_ROWS, LANE_ROWS = 2048, 256, 16384
STEP = 8  # columns read between two looks at the bitmap
NO_ID = (1 << 63) - 1  # stands for a null id, behind all others

BLOCK = "block bigint, dim int, rows int, ids binary, labels binary, columns binary, low binary, high binary"
FOUND = "anchor bigint, anchor_id bigint, wanted int, row bigint, id bigint, score bigint"


def names_of(ddl: str) -> list[str]:
    return [field.split()[0] for field in ddl.split(", ")]


def usable_numbers(v):
    """Not null, not empty and only finite numbers; a zero vector takes part."""
    return F.coalesce((F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))), F.lit(False))


def packed(vectors: DataFrame, id_col: str, vector: str, label: str) -> DataFrame:
    """Stored blocks of columns. Labels are numbered by hash, so that they fit a column whatever their type."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(F.col(label).cast("string")).alias("label"), F.col(vector).cast("array<double>").alias("v"))

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        open_blocks: dict[int, list] = {}
        # a row's name is its block's and its place; a block has fewer than 2 ** 12 rows
        names = itertools.count(TaskContext.get().partitionId() << 33, 1 << 12)

        def flush(dim: int):
            parts = open_blocks.pop(dim)
            ids, labels, columns = (np.concatenate(x, axis=-1) for x in zip(*parts))
            low, high = columns.min(axis=1), columns.max(axis=1)
            values = [next(names), dim, len(ids), *(x.tobytes() for x in (ids, labels, columns, low, high))]
            kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, kinds)], names_of(BLOCK))

        for batch in batches:
            ids = batch.column("id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
            labels = batch.column("label").to_numpy(zero_copy_only=False)
            v = batch.column("v")
            flat, sizes = v.flatten().to_numpy(zero_copy_only=False), np.asarray(v.value_lengths())
            starts = np.cumsum(sizes) - sizes
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                limit = math.isqrt(((1 << 63) - 1) // dim)
                with np.errstate(over="ignore"):
                    x = np.clip(np.floor(flat[starts[at][None, :] + np.arange(dim)[:, None]] * SCALE), -limit, limit)
                for k in range(0, len(at), BLOCK_ROWS):
                    cut = at[k : k + BLOCK_ROWS]
                    open_blocks.setdefault(dim, []).append((ids[cut], labels[cut], x[:, k : k + BLOCK_ROWS].astype(np.int64)))
                    if sum(len(p[0]) for p in open_blocks[dim]) >= BLOCK_ROWS:
                        yield flush(dim)
        for dim in list(open_blocks):
            yield flush(dim)

    return stored(rows.mapInArrow(run, BLOCK), "scan-blocks")


ANCHOR = "anchor bigint, anchor_id bigint, label bigint, dim int, v array<bigint>"


def anchors_of(blocks: DataFrame, every: int) -> DataFrame:
    """Stored anchors: the rows whose id is divisible by ``every``; ``anchor`` is the row's place in the blocks."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                ids, labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
                columns = np.frombuffer(row["columns"], np.int64).reshape(row["dim"], -1)
                at = np.flatnonzero((ids % every == 0) & (ids != NO_ID))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["block"] + at), pa.array(ids[at]), pa.array(labels[at]), pa.array([row["dim"]] * len(at), pa.int32()), pa.array(columns[:, at].T.tolist(), pa.list_(pa.int64()))],
                    names_of(ANCHOR),
                )

    return stored(blocks.select("block", "dim", "ids", "labels", "columns").mapInArrow(run, ANCHOR), "scan-anchors")


class Lane:
    """The blocks of a group as one table of columns, with the least and greatest value of each column and block."""

    def __init__(self, rows: list[dict]):
        dim = rows[0]["dim"]
        read = lambda r, c: np.frombuffer(r[c], np.int64)
        sizes = np.array([r["rows"] for r in rows])
        self.names = np.concatenate([r["block"] + np.arange(r["rows"]) for r in rows])
        self.ids, self.labels = (np.concatenate([read(r, c) for r in rows]) for c in ("ids", "labels"))
        self.columns = np.concatenate([read(r, "columns").reshape(dim, -1) for r in rows], axis=1)
        self.low, self.high = (np.stack([read(r, c) for r in rows]) for c in ("low", "high"))
        self.block = np.repeat(np.arange(len(rows)), sizes)

    def remaining(self, v: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per block and number of columns read, the least and the most that the unread ones add."""
        a, b = self.low[:, order] * v[order], self.high[:, order] * v[order]
        tail = lambda x: np.concatenate([np.cumsum(x[:, ::-1], axis=1)[:, ::-1], np.zeros((len(x), 1), np.int64)], axis=1)
        return tail(np.minimum(a, b)), tail(np.maximum(a, b))

    def scan(self, v: np.ndarray, candidates: np.ndarray, windows: np.ndarray, k: int) -> list[np.ndarray]:
        """For each window (least, most) the rows of the ``k`` best scores in it, best first, equal ones by id; more
        than ``k`` only where repeated ids tie. ``candidates`` is the bitmap to start from."""
        order = np.argsort(-np.abs(v), kind="stable")
        least, most = self.remaining(v, order)
        bitmap, score = candidates.copy(), np.zeros(len(self.ids), np.int64)
        floor = windows[:, 0].copy()
        for start in range(0, len(v), STEP):
            read = order[start : start + STEP]
            at = np.flatnonzero(bitmap)
            if not len(at):
                break
            for d in read.tolist():
                score[at] += v[d] * self.columns[d, at]
            end = start + len(read)
            low, high = score[at] + least[self.block[at], end], score[at] + most[self.block[at], end]
            keep = np.zeros(len(at), bool)
            for w, (_, top) in enumerate(windows.tolist()):
                sure = low[(low >= windows[w, 0]) & (high <= top)]
                if len(sure) >= k:
                    floor[w] = max(floor[w], np.partition(sure, len(sure) - k)[len(sure) - k])
                keep |= (high >= floor[w]) & (low <= top)
            bitmap[at] = keep
        at = np.flatnonzero(bitmap)
        out = []
        for w, (_, top) in enumerate(windows.tolist()):
            own = at[(score[at] >= floor[w]) & (score[at] <= top)]
            out.append((own[np.lexsort((self.names[own], self.ids[own], -score[own]))][:k], score))
        return out


def scanned(blocks: DataFrame, anchors: DataFrame, k: int, same_label: bool) -> DataFrame:
    """Per anchor and window the ``k`` best rows of each lane. ``anchors`` hold ``windows``, pairs of least and most."""
    n_rows, n_anchors = blocks.agg(F.sum("rows")).first()[0] or 0, anchors.count()
    lanes, groups = max(1, n_rows // LANE_ROWS), max(1, n_anchors // ANCHOR_ROWS)
    rows = blocks.withColumn("lane", F.pmod(F.xxhash64("block"), F.lit(lanes)))
    rows = rows.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    asks = anchors.withColumn("group", F.pmod(F.xxhash64("anchor"), F.lit(groups)).cast("int"))
    asks = asks.withColumn("lane", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(lanes - 1).cast("bigint"))))

    def meet(rows, asks):
        import pyarrow as pa

        out: list[list] = [[], [], [], [], [], []]
        if rows.num_rows and asks.num_rows:
            lane = Lane(rows.to_pylist())
            for a in asks.to_pylist():
                fits = lane.labels == a["label"] if same_label else lane.labels != a["label"]
                windows = np.array(a["windows"], np.int64).reshape(-1, 2)
                for w, (own, score) in enumerate(lane.scan(np.array(a["v"], np.int64), fits & (lane.names != a["anchor"]), windows, k)):
                    out[0] += [a["anchor"]] * len(own)
                    out[1] += [a["anchor_id"]] * len(own)
                    out[2] += [w] * len(own)
                    for column, x in zip(out[3:], (lane.names, lane.ids, score)):
                        column += x[own].tolist()
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return pa.table([pa.array(x, t) for x, t in zip(out, kinds)], names_of(FOUND))

    return rows.groupBy("dim", "group", "lane").cogroup(asks.groupBy("dim", "group", "lane")).applyInArrow(meet, FOUND)


def best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of every anchor and window over all lanes, with ``rank`` from 1."""
    order = W.partitionBy("anchor", "wanted").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, id_col="vec_id", vector="embedding", label="label", every: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score of every anchor and positive."""
    blocks = packed(vectors.filter(usable_numbers(F.col(vector)) & F.col(label).isNotNull()), id_col, vector, label)
    anchors = anchors_of(blocks, every)
    everything = F.array(F.lit(-NO_ID).cast("bigint"), F.lit(NO_ID).cast("bigint"))
    positives = stored(best(scanned(blocks, anchors.withColumn("windows", everything), POSITIVES, True), POSITIVES), "scan-positives")
    # hundredths of a score in whole numbers, hundreds and rest apart, so that no product overflows
    rest, hundreds = F.pmod("score", F.lit(100)), F.expr("(score - pmod(score, 100)) div 100")
    least = hundreds * LEAST + F.ceil(rest * LEAST / 100).cast("bigint")
    most = hundreds * MOST + F.floor(rest * MOST / 100).cast("bigint")
    windows = positives.withColumn("least", least).withColumn("most", most)
    per_anchor = windows.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "least", "most"))).alias("w"))
    windows_of = F.flatten(F.transform("w", lambda w: F.array(w["least"], w["most"])))
    asks = stored(anchors.join(per_anchor, "anchor").withColumn("windows", windows_of).drop("w"), "scan-windows")
    negatives = best(scanned(blocks, asks, NEGATIVES, False), NEGATIVES)
    pairs = positives.select("anchor", (F.col("rank") - 1).alias("wanted"), F.col("id").alias("positive"), F.col("score").alias("positive_score"))
    named = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return negatives.join(pairs, ["anchor", "wanted"]).select(
        "anchor_id", named("positive").alias("positive_id"), "rank", named("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
