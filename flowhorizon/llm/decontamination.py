"""Benchmark decontamination by pigeonhole edit matching.

A test item of ``n`` words may differ from a passage of a document by ``k = floor(n * (1 - similarity))``
word edits. Cut into ``k + 1`` pieces, at least one piece of it then stands unchanged in the passage. All
pieces go into one automaton; a document's hits name the items and the places to look at, and Myers'
bit-parallel distance, with words as symbols, verifies the surroundings of each hit.

Test items are taken in blocks of at most ``BLOCK_WORDS`` words, so what goes to the tasks is bounded
however many items there are; every block is matched against all documents. Texts are compared as
lower-case words of letters and digits.

Defined results: null and empty texts and items without a word match nothing; items too short for an edit
(``k = 0``) match where they stand exactly; an item that repeats is reported under each of its ids; a
document repeated under one id gives one row per row of the table; other columns are not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .common import plain_words, stored

SIMILARITY = 0.8
BLOCK_WORDS = 1_000_000


def pieces(words: list[str], k: int) -> list[tuple[int, list[str]]]:
    """``k + 1`` pieces of nearly equal length with their offsets."""
    n = len(words)
    cuts = [n * i // (k + 1) for i in range(k + 2)]
    return [(a, words[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


def budget(n: int, similarity: float) -> int:
    return int(n * (1 - similarity) + 1e-9)


def best_match(pattern_bits: dict, m: int, text: list, k: int) -> tuple[int, int] | None:
    """(distance, end) of the best approximate occurrence of a pattern in ``text``, if within ``k`` (Myers 1999).

    ``pattern_bits`` maps a symbol to the bits of its places in the pattern. The row is as long as the
    pattern; Python integers carry any length.
    """
    ones, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = ones, 0, m, None
    for j, symbol in enumerate(text):
        eq = pattern_bits.get(symbol, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & ones), pv & xh
        score += 1 if ph & high else -1 if mh & high else 0
        ph, mh = (ph << 1) & ones, (mh << 1) & ones  # row 0 is free: an occurrence may begin anywhere
        pv, mv = mh | (~(xv | ph) & ones), ph & xv
        if score <= k and (best is None or score < best[0]):
            best = (score, j + 1)
    return best


class Matcher:
    """Automaton over the pieces of a block of items."""

    def __init__(self, items: list[tuple[int, str]], similarity: float):
        import ahocorasick

        self.items, found = [], {}
        for item_id, text in items:
            words = text.split()
            k, bits = budget(len(words), similarity), {}
            for i, w in enumerate(words):
                bits[w] = bits.get(w, 0) | 1 << i
            for at, piece in pieces(words, k):
                found.setdefault(" " + " ".join(piece) + " ", []).append((len(self.items), at, len(piece)))
            self.items.append((item_id, len(words), k, bits))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in found.items():
            self.automaton.add_word(piece, owners)
        if found:
            self.automaton.make_automaton()

    def match(self, text: str) -> list[tuple[int, int, int]]:
        """(item id, distance, last word of the passage) of every item found in a plain text."""
        if not text or not len(self.automaton):
            return []
        windows: dict[int, list] = {}
        padded, done, word = f" {text} ", 0, 0
        for end, owners in self.automaton.iter(padded):
            word += padded.count(" ", done, end)  # blanks before the closing one: the words up to here
            done = end
            for item, at, size in owners:
                _, n, k, _ = self.items[item]
                start = word - size - at
                windows.setdefault(item, []).append((max(0, start - k), start + n + k))
        out, words = [], text.split() if windows else []
        for item, spans in windows.items():
            item_id, n, k, bits = self.items[item]
            best, spans = None, sorted(spans)
            while spans:
                lo, hi = spans.pop(0)
                while spans and spans[0][0] <= hi:  # overlapping surroundings are read once
                    hi = max(hi, spans.pop(0)[1])
                found = best_match(bits, n, words[lo:hi], k)
                if found and (best is None or found[0] < best[0]):
                    best = (found[0], lo + found[1])
            if best:
                out.append((item_id, *best))
        return out


def known_items(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """Stored test items (item, words, key); equal texts have one key."""
    plain = benchmark.select(F.col(item_id).alias("item"), plain_words(F.col(text)).alias("words")).filter("words <> ''")
    return stored(plain.withColumn("key", F.md5("words")), "benchmark-items")


def blocks(items: DataFrame, most: int = BLOCK_WORDS):
    """Lists of (key, plain text) of at most about ``most`` words each, read one block at a time; equal texts once."""
    texts = stored(items.select("key", "words").distinct(), "benchmark-texts")
    total = texts.agg(F.sum(F.size(F.split("words", " ")))).first()[0] or 0
    n = -(-int(total) * 2 // most) if total > most else 1
    for b in range(n):
        part = texts.filter(F.pmod(F.xxhash64("key"), F.lit(n)) == b) if n > 1 else texts
        yield sorted(((r.key, r.words) for r in part.collect()), key=lambda x: x[1])


def passages(docs: DataFrame, benchmark: DataFrame, keep=("doc_id",), text="text", item_id="item_id", item_text="text", similarity=SIMILARITY) -> DataFrame:
    """One row per document and item found in it: ``keep`` columns, item_id, distance in words, last_word."""
    keep = list(keep)
    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "_key string, distance int, last_word int"])
    plain = docs.select(*keep, plain_words(F.col(text)).alias("_words"))

    def search(packed):
        def run(batches):
            import pyarrow as pa

            matcher = Matcher(packed.value, similarity)
            for batch in batches:
                hits = [(i, *hit) for i, t in enumerate(batch.column("_words").to_pylist()) for hit in matcher.match(t)]
                rows = batch.select(keep).take(pa.array([h[0] for h in hits], pa.int64()))
                found = [pa.array([h[1] for h in hits], pa.string())] + [pa.array([h[k] for h in hits], pa.int32()) for k in (2, 3)]
                yield pa.RecordBatch.from_arrays([*rows.columns, *found], [*keep, "_key", "distance", "last_word"])

        return run

    send = docs.sparkSession.sparkContext.broadcast
    items = known_items(benchmark, item_id, item_text)
    hits = reduce(DataFrame.union, [plain.mapInArrow(search(send(b)), schema) for b in blocks(items)])
    named = items.select(F.col("key").alias("_of"), F.col("item").alias("item_id"))
    return hits.join(named, hits["_key"] == named["_of"]).select(*[hits[c] for c in keep], named["item_id"], hits["distance"], hits["last_word"])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text="text", item_id="item_id", item_text="text", similarity=SIMILARITY) -> DataFrame:
    """Documents in which no item stands, with all their columns."""
    columns, schema = docs.columns, docs.schema
    out = docs
    for texts in blocks(known_items(benchmark, item_id, item_text)):
        packed = docs.sparkSession.sparkContext.broadcast(texts)

        def run(batches, packed=packed):
            import pyarrow as pa

            matcher = Matcher(packed.value, similarity)
            for batch in batches:
                clean = [not matcher.match(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
                rows = batch.filter(pa.array(clean, pa.bool_()))
                yield pa.RecordBatch.from_arrays(rows.columns[:-1], columns)

        names = [F.col(f"`{c}`") for c in columns]
        out = out.select(*names, plain_words(F.col(f"`{text}`")).alias("_words")).mapInArrow(run, schema)
    return out
