"""MinHash near-dedup with Order MinHash, verified by banded alignment.

A text is the sequence of its shingles of ``SHINGLE`` words; a shingle that repeats is labelled with its
occurrence number. Each of ``SKETCHES`` hash functions takes the ``TAKEN`` smallest labelled shingles and keeps
them in text order, so two texts share a sketch only if they agree on shingles and on their order, which
follows edit similarity. Texts of up to ``SHORT`` shingles also get sketches of ``SHORT_TAKEN``. Equal
sketches make candidates, and an alignment verifies them: with ``L`` the longest common subsequence of
the two shingle sequences, ``L / (n + m - L)`` must reach ``SIMILARITY``. Only matches within the band of
diagonals that such a similarity allows are looked at, which changes nothing about the decision.

Equal texts form one class before anything else. Texts of one bucket are first compared with the bucket's leader
only, the text that shares most buckets. Buckets that this leaves in several components are then read in
blocks, and every pair of two components whose upper bound reaches the similarity is aligned as well. So
every pair that shares a bucket is linked, or already connected, or certainly below the similarity.

Defined results: texts are compared as lower-case words of letters and digits; texts of fewer words than a shingle
are one shingle; null texts and texts without a word are alone in their class; a class is named by its smallest
id; rows that repeat one id are classed by their own texts; an empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import block_pairs, plain_words, stored
from .components import components

SHINGLE, SIMILARITY = 5, 0.8
SKETCHES, TAKEN = 30, 6
SHORT, SHORT_TAKEN, SHORT_SKETCHES = 40, 2, 15
BITS, BLOCK = 4096, 512


def word_ids(words: list[str]) -> np.ndarray:
    ids: dict[str, int] = {}
    return np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: list[str], known: dict[str, int]) -> np.ndarray:
    """64-bit hashes of the shingles in text order; ``known`` keeps hashes of words."""
    import xxhash

    h = []
    for w in words:
        v = known.get(w)
        if v is None:
            v = known[w] = xxhash.xxh64_intdigest(w)
        h.append(v)
    h = np.array(h, np.uint64)
    k = min(SHINGLE, len(h))
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(out)])
    return out


def labelled(h: np.ndarray) -> np.ndarray:
    """Hashes that also tell the first, second, ... occurrence of a shingle apart."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    first = np.append(True, s[1:] != s[:-1])
    at = np.arange(len(s))
    nth = np.empty(len(s), np.uint64)
    nth[order] = at - np.maximum.accumulate(np.where(first, at, 0))
    return mix64(h + nth * np.uint64(0xD6E8FEB86659FD93))


SEEDS = mix64(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def sketch(h: np.ndarray) -> list[int]:
    """Bucket keys of one text: each a hash of the smallest labelled shingles in text order."""
    base, keys = labelled(h), []
    for j, seed in enumerate(SEEDS):
        v = (base ^ seed) * np.uint64(0x9E3779B97F4A7C15)
        v ^= v >> np.uint64(32)
        plans = [(0, TAKEN)] + ([(1, SHORT_TAKEN)] if len(h) <= SHORT and j < SHORT_SKETCHES else [])
        for kind, taken in plans:
            at = np.argpartition(v, taken - 1)[:taken] if len(v) > taken else np.arange(len(v))
            at.sort()  # text order
            key = np.uint64(j * 2 + kind + 1)
            for x in h[at].tolist():
                key = (int(key) * 0x9E3779B97F4A7C15 + x) & 0xFFFFFFFFFFFFFFFF
                key = (key ^ (key >> 29)) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
            keys.append(int(key) - (1 << 64) if int(key) >> 63 else int(key))
    return keys


def shingles(text: str) -> list[int]:
    """Shingles of a plain text as integers that are equal for equal shingles within this process."""
    words = text.split(" ")
    k = min(SHINGLE, len(words))
    return [hash(tuple(words[i : i + k])) for i in range(len(words) - k + 1)]


def alignment(a: list[int], b: list[int], least: float = SIMILARITY) -> float:
    """``L / (n + m - L)`` of the best alignment in the band; a smaller bound where it cannot reach ``least``.

    The common subsequence is found with one bit row over ``a`` (Hyyro's recurrence), of which only the bits
    within the band around the current diagonal may match.
    """
    n, m = len(a), len(b)
    need = int(np.ceil(least * (n + m) / (1 + least) - 1e-9))
    if min(n, m) < need:
        return min(n, m) / max(n, m)
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    common = sum(1 for x in b if x in places)
    if common < need:
        return common / (n + m - common)
    width = n + m - 2 * need  # matches farther off the diagonal would leave more than that unmatched
    band = (1 << (2 * width + 1)) - 1
    full = (1 << n) - 1
    row = full
    for j, x in enumerate(b):
        hit = places.get(x)
        if hit is None:
            continue
        hit &= band << (j - width) if j >= width else band >> (width - j)
        u = row & hit
        if u:
            row = ((row + u) | (row - u)) & full
    length = n - row.bit_count()
    return length / (n + m - length)


def prepared(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """Stored rows (id, h: 128 bits of the plain text, words, keys); no keys for texts without a word."""

    @F.pandas_udf("array<bigint>")
    def keys_of(words):
        import pandas as pd

        known: dict[str, int] = {}
        out = []
        for text in words:
            if len(known) > 100_000:
                known.clear()
            out.append(sketch(shingle_hashes(text.split(" "), known)) if text else [])
        return pd.Series(out)

    rows = docs.select(F.col(id_col).alias("id"), plain_words(F.col(text)).alias("words"))
    rows = rows.withColumn("h", F.unhex(F.md5("words")))
    return stored(rows.withColumn("keys", keys_of("words")), "omh-rows")


def buckets(rows: DataFrame) -> DataFrame:
    """(key, h) of all buckets with two texts or more, equal texts once."""
    one = rows.filter(F.size("keys") > 0).groupBy("h").agg(F.first("keys").alias("keys"))
    flat = one.select("h", F.explode("keys").alias("key"))
    many = flat.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    return stored(flat.join(many, "key").select("key", "h", "n"), "omh-buckets")


def leader_pairs(cells: DataFrame) -> DataFrame:
    """(a, b): every text with the leader of each of its buckets, once."""
    weight = cells.groupBy("h").agg(F.sum("n").alias("w"))
    lead = cells.join(weight, "h").groupBy("key").agg(F.max(F.struct("w", "h")).alias("best"))
    pairs = cells.join(lead.select("key", F.col("best.h").alias("lead")), "key").filter(F.col("h") != F.col("lead"))
    return pairs.select(F.greatest("h", "lead").alias("a"), F.least("h", "lead").alias("b")).distinct()


def shared_texts(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """Stored (h, words, n, bits) of the texts in any bucket. ``bits`` marks ``h mod BITS`` of every labelled shingle."""

    @F.pandas_udf("n int, bits binary")
    def marks(words):
        import pandas as pd

        n, bits, known = [], [], {}
        for text in words:
            if len(known) > 100_000:
                known.clear()
            h = labelled(shingle_hashes(text.split(" "), known))
            row = np.zeros(BITS, np.uint8)
            row[(h % np.uint64(BITS)).astype(np.int64)] = 1
            n.append(len(h))
            bits.append(np.packbits(row).tobytes())
        return pd.DataFrame({"n": n, "bits": bits})

    nodes = cells.select("h").distinct()
    texts = rows.select("h", "words").join(nodes, "h", "left_semi").dropDuplicates(["h"])
    return stored(texts.withColumn("m", marks("words")).select("h", "words", "m.n", "m.bits"), "omh-texts")


def verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Stored pairs whose alignment reaches the similarity."""

    @F.pandas_udf("double")
    def similarity(a, b):
        import pandas as pd

        return pd.Series([alignment(shingles(x), shingles(y), least) for x, y in zip(a, b)], dtype="float64")

    texts = texts.select("h", "words")
    first, second = texts.toDF("a", "_x"), texts.toDF("b", "_y")
    found = pairs.join(first, "a").join(second, "b").withColumn("similarity", similarity("_x", "_y"))
    return stored(found.filter(F.col("similarity") >= least).select("a", "b", "similarity"), "omh-links")


def open_pairs(cells: DataFrame, parts: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Pairs of one bucket and different components that could reach the similarity.

    Buckets that lie in one component are done. The others are cut into blocks of about ``BLOCK`` texts, and a
    task sees two blocks at a time; small buckets share a group. ``|A minus B|`` is at least the number of
    marks of A that B lacks, which bounds the similarity from above, so no link can be lost here, and only
    pairs whose bound passes leave the task.
    """
    own = cells.join(parts.toDF("h", "c"), "h", "left").withColumn("c", F.coalesce("c", "h"))
    mixed = own.groupBy("key").agg(F.min("c").alias("_lo"), F.max("c").alias("_hi")).filter(F.col("_lo") != F.col("_hi"))
    own = stored(own.join(mixed.select("key"), "key"), "omh-open")
    own = block_pairs(own, ["key"], "n", "h", BLOCK).join(texts.select("h", F.col("n").alias("size"), "bits"), "h")

    def near(pdf):
        import pandas as pd

        out = []
        for (_, i, j), part in pdf.groupby(["key", "i", "j"], sort=False):
            x = part if i == j else part[part["block"] == i]
            y = part if i == j else part[part["block"] == j]
            if len(x) and len(y):
                bits = [np.frombuffer(b"".join(p["bits"]), np.uint64).reshape(len(p), -1) for p in (x, y)]
                size = [p["size"].to_numpy(np.int64) for p in (x, y)]
                apart = x["c"].to_numpy()[:, None] != y["c"].to_numpy()[None, :]
                hx, hy = x["h"].to_numpy(), y["h"].to_numpy()
                for r in range(len(x)):
                    lack = np.bitwise_count(bits[0][r] & ~bits[1]).sum(axis=1)
                    more = np.bitwise_count(~bits[0][r] & bits[1]).sum(axis=1)
                    common = np.minimum(size[0][r] - lack.astype(np.int64), size[1] - more.astype(np.int64))
                    fits = apart[r] & (common >= least * (size[0][r] + size[1] - common) - 1e-9)
                    out += [(max(hx[r], h), min(hx[r], h)) for h in hy[fits]]
        return pd.DataFrame(out, columns=["a", "b"])

    keep = own.select("group", "key", "i", "j", "block", "h", "c", "size", "bits")
    return keep.groupBy("group", "i", "j").applyInPandas(near, "a binary, b binary").distinct()


def text_classes(rows: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(h, class) of all texts that share a class with another text."""
    cells = buckets(rows)
    texts = shared_texts(rows, cells)
    links = verified(stored(leader_pairs(cells), "omh-pairs"), texts, least)
    parts = stored(components(links.select("a", "b"), "omh-stars"), "omh-parts")
    links = links.union(verified(stored(open_pairs(cells, parts, texts, least), "omh-pairs"), texts, least))
    return stored(components(links.select("a", "b"), "omh-stars"), "omh-classes").toDF("h", "class")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: id, class_id (smallest id of its class) and h, its text."""
    rows = prepared(docs, id_col, text)
    classes = text_classes(rows, least)
    # a text without a word is alone: its class is the row's own id
    solid = F.size("keys") > 0
    own = rows.select("id", "h", solid.alias("solid")).join(classes, "h", "left").withColumn("class", F.coalesce("class", "h"))
    names = own.filter("solid").groupBy("class").agg(F.min("id").alias("class_id"))
    own = own.join(names, "class", "left").withColumn("class_id", F.when(F.col("solid"), F.col("class_id")).otherwise(F.col("id")))
    return own.select("id", "class_id", "h")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One document of each class, the one with the smallest id, with all its columns."""
    names = near_classes(docs, id_col, text, least)
    # among rows that repeat the id, one of equal text stays; a text without a word stays as often as it occurs
    kept = names.filter(F.col("id").eqNullSafe(F.col("class_id"))).groupBy("id", "h").agg(F.count("*").alias("_rows"))
    kept = stored(kept.toDF("_id", "_h", "_rows"), "omh-kept")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.md5(plain_words(F.col(f"`{text}`"))).alias("_md5"))
    on = F.col(f"_doc.`{id_col}`").eqNullSafe(F.col("_id")) & (F.unhex("_md5") == F.col("_h"))
    found = rows.join(kept, on)
    single = (F.col("_rows") == 1) | (F.col("_md5") == F.md5(F.lit("")))
    once = found.filter(~single).dropDuplicates(["_id", "_h"])
    return found.filter(single).select("_doc.*").union(once.select("_doc.*"))
