"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by its ``PREFIX`` nearest of ``PIVOTS`` reference points, random unit vectors drawn from a
fixed seed for each dimension. The inverted lists are keyed by label, dimension and two of these pivots, so
whatever a list holds shares at least ``2`` of them with each other; a pair is counted in the first list it
shares and nowhere else. Retrieved pairs are verified with the cosine in double precision.

All vectors are indexed; equal vectors of one label once, with their number. Long lists are cut into blocks
and two blocks meet in a task, which returns per vector the number of links and one link towards its local
component, never the pairs. So a large group of near copies costs blocks, not rows.

Defined results: vectors that are null, empty or zero or hold null or non-finite numbers, and rows with a null
label, have no links and are their own component; vectors of different length do not link; equal rows link
with each other; an empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import block_pairs, stored
from .components import components

PIVOTS, PREFIX, BLOCK, LEAST = 512, 8, 1024, 0.98


def usable(v: Column) -> Column:
    """Not null, not empty, only finite numbers, not all zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))
    return F.coalesce((F.size(v) > 0) & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0), F.lit(False))


def references(dim: int) -> np.ndarray:
    g = np.random.default_rng(dim).standard_normal((PIVOTS, dim))
    return g / np.linalg.norm(g, axis=1, keepdims=True)


def nearest(vectors: np.ndarray) -> np.ndarray:
    """The ``PREFIX`` nearest pivots of each row, nearest first; equal distances by number."""
    s = vectors @ references(vectors.shape[1]).T
    return np.argsort(-s, axis=1, kind="stable")[:, :PREFIX]


def postings(prefixes: np.ndarray) -> np.ndarray:
    """List keys of each row: all pairs of its pivots, in one ascending row."""
    a, b = np.triu_indices(prefixes.shape[1], 1)
    x, y = prefixes[:, a], prefixes[:, b]
    return np.sort(np.minimum(x, y) * PIVOTS + np.maximum(x, y), axis=1)


def units(arrays) -> np.ndarray:
    v = np.stack([np.asarray(a, np.float64) for a in arrays])
    v = v / np.abs(v).max(axis=1, keepdims=True)  # no overflow or underflow in the norm
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def indexed(vectors: DataFrame) -> DataFrame:
    """Stored (node, label, v, copies, dim, keys) of the different usable vectors."""

    @F.pandas_udf("array<int>")
    def keys_of(v):
        import pandas as pd

        out = pd.Series([None] * len(v), dtype=object)
        dims = v.map(len)
        for d in dims.unique():
            at = np.flatnonzero(dims.to_numpy() == d)
            found = postings(nearest(units(v.iloc[at])))
            for i, k in zip(at, found):
                out.iloc[i] = k.astype(np.int32)
        return out

    one = vectors.filter("ok").groupBy("node").agg(
        F.first("label").alias("label"), F.first("v").alias("v"), F.count("*").alias("copies")
    )
    return stored(one.withColumn("dim", F.size("v")).withColumn("keys", keys_of("v")), "pivot-index")


def links(index: DataFrame, least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """Stored (node, linked, root) parts: rows linked within a group, and a node of the local component."""
    flat = index.select("node", "label", "dim", F.explode("keys").alias("key"))
    lists = flat.groupBy("label", "dim", "key").agg(F.count("*").alias("n")).filter("n > 1")
    cells = stored(flat.join(lists, ["label", "dim", "key"]), "pivot-lists")
    dealt = block_pairs(cells, ["label", "dim", "key"], "n", "node", block)
    dealt = dealt.join(index.select("node", "v", "keys", "copies"), "node")

    def meet(pdf):
        import pandas as pd

        nodes, linked, roots = [], [], []
        for (_, _, key, i, j), part in pdf.groupby(["label", "dim", "key", "i", "j"], sort=False):
            x = part if i == j else part[part["block"] == i]
            y = part if i == j else part[part["block"] == j]
            if not len(x) or not len(y) or len(part) < 2:
                continue
            near = units(x["v"]) @ units(y["v"]).T >= least
            if i == j:
                np.fill_diagonal(near, False)
            rows = np.flatnonzero(near.any(axis=1))
            if not len(rows):
                continue
            kx, ky = np.stack(x["keys"].to_numpy()), np.stack(y["keys"].to_numpy())
            for r in rows:  # keep a pair only in the first list that both stand in
                c = np.flatnonzero(near[r])
                before = ky[c][:, None, :] == kx[r][kx[r] < key][None, :, None]
                near[r, c[before.any(axis=(1, 2))]] = False
            nx, ny = x["node"].to_numpy(), y["node"].to_numpy()
            wx, wy = x["copies"].to_numpy(), y["copies"].to_numpy()
            label = components_of(near, i == j)
            names = np.concatenate([nx, ny]) if i != j else nx
            for side, own, count in ((0, nx, near @ wy),) if i == j else ((0, nx, near @ wy), (len(nx), ny, near.T @ wx)):
                at = np.flatnonzero(count)
                nodes += own[at].tolist()
                linked += count[at].tolist()
                roots += names[label[at + side]].tolist()
        columns = {"node": (nodes, object), "linked": (linked, "int64"), "root": (roots, object)}
        return pd.DataFrame({k: pd.Series(v, dtype=kind) for k, (v, kind) in columns.items()})

    keep = dealt.select("group", "label", "dim", "key", "i", "j", "block", "node", "v", "keys", "copies")
    return stored(keep.groupBy("group", "i", "j").applyInPandas(meet, "node string, linked long, root string"), "pivot-links")


def components_of(near: np.ndarray, square: bool) -> np.ndarray:
    """Smallest position of each row's component; the columns follow the rows unless both are the same."""
    n, m = near.shape
    a = np.arange(n)
    b = a if square else np.arange(n, n + m)
    while True:
        up = np.minimum(a, np.where(near, b[None, :], n + m).min(axis=1, initial=n + m))
        down = up if square else np.minimum(b, np.where(near, up[:, None], n + m).min(axis=0, initial=n + m))
        if (up == a).all() and (down == b).all():
            return a if square else np.concatenate([a, b])
        a, b = up, down


def near_vectors(df: DataFrame, id_col="vec_id", vector="embedding", label="label", least: float = LEAST) -> DataFrame:
    """One row per row of ``df``: id, n_links, component_id and kept."""
    rows = df.select(F.col(id_col).alias("id"), F.col(vector).alias("v"), F.col(label).alias("label"))
    rows = rows.withColumn("ok", usable(F.col("v")) & F.col("label").isNotNull())
    text = F.concat_ws(",", F.col("label").cast("string"), F.col("v").cast("array<string>"))
    rows = stored(rows.withColumn("node", F.when(F.col("ok"), F.md5(text))), "vectors")
    index = indexed(rows)
    parts = links(index, least)
    counts = parts.groupBy("node").agg(F.sum("linked").alias("linked"))
    stars = components(parts.select("node", "root"), "pivot-stars").withColumnRenamed("component", "root")
    own = rows.select("id", "node").join(index.select("node", "copies"), "node", "left")
    own = own.join(counts, "node", "left").join(stars, "node", "left").withColumn("root", F.coalesce("root", "node"))
    own = stored(own, "vector-rows")
    names = own.filter(F.col("root").isNotNull()).groupBy("root").agg(F.min("id").alias("component_id"))
    own = own.join(names, "root", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    n = F.coalesce("linked", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))
    return own.select(
        F.col("id").alias(id_col), n.cast("bigint").alias("n_links"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )
