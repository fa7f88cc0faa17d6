"""Language-model scoring with a hierarchical Pitman-Yor model of word pairs.

Tokens are seated in context restaurants, one per preceding word (the end token stands before a text). A token joins
a table of its word or opens a new one; the tables of all context restaurants are the customers of one
parent restaurant, that of the empty context, whose own new tables draw from a uniform base over the ``V`` known words
and one unknown word. So ``p(w | u) = (c_uw - d t_uw) / (theta + c_u) + (theta + d t_u) / (theta + c_u) * p(w)``, and
alike for the parent.

Seating is sampled in sweeps. Given the tables of each context and the parent's probabilities, the pairs are
independent: a sweep draws the tables of every (context, word) pair by seating its customers one after the other, then
those of every word in the parent, in parallel over all pairs and words of the corpus. The totals of a restaurant are
those of the sweep before, so this is the parallel form of the Gibbs sampler and an approximation of the one that moves
one customer at a time; the tests hold its mean against that one. After ``BURN_IN`` sweeps ``SAMPLES`` states are kept;
a token's probability is the mean of its predictive probabilities in them. All training tokens are seated.

Scale: texts are packed once into blocks of about ``BLOCK_BYTES``, which number their words. Words get their place in a
part of the vocabulary, by 64 bits of hash; pairs meet their counts in buckets by the hash of both words, so that a
frequent word's pairs are spread over all of them. A pair seen once has one table whatever happens, so only pairs seen
more often, and their words, take part in the sweeps. A block builds its pairs again when it is scored and gets
back what differs: counts and tables of its pairs and words, not probabilities. The number of buckets and parts
follows the corpus. What travels between two of them is one packed row; only totals reach the driver.

Defined results: a null or empty text is its end token alone; repeated rows are scored alike and each
teaches if its id does; a word unknown in training counts as the unknown word; after a word unknown in training the
parent decides; without training tokens every token has probability 1, the only word being the unknown one; a very long
text is a block of its own; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import fold, short_shuffles, stored

LEAST_PARTS = 8  # least number of buckets of pairs and of parts of the vocabulary
BLOCK_BYTES = 8_000_000
BURN_IN, SAMPLES = 2, 3
THETA = 1.0


# ---- packing ---------------------------------------------------------------------------------------------


def tokens_of(text) -> list[bytes]:
    """Words split at ASCII white space with A-Z lower-cased, then the end, an empty word."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    words.append(b"")
    return words


BLOCK = (
    "block bigint, ids array<{id}>, held array<boolean>, sizes array<int>, tokens binary, "
    "parts array<struct<part:int,words:binary,trained:binary>>"
)
#: places of a block's words in a part and their training counts; the row without a block holds the part's totals
PLACE = "block bigint, part int, at binary, c binary, stats array<bigint>"
MESSAGE = "bucket int, block bigint, context binary, word binary, trained binary"
BUCKET = (
    "bucket int, stats array<bigint>, context binary, word binary, n binary, "
    "asks array<struct<block:bigint,codes:binary,at:binary>>, "
    "words array<struct<part:int,at:binary,active:binary,once:binary,all:binary>>"
)
PART = "part int, size int, once array<binary>, all array<binary>, asks array<struct<bucket:int,at:binary>>"
#: tables as context, customers and tables in the parent, of every word of a part
STATE = "part int, t binary, k binary, o binary, sums array<bigint>"
DOWN = "bucket int, part int, t binary, k binary, o binary"
#: sums of a bucket's tables by word and by context; the row without a part holds the tables themselves
UP = "part int, bucket int, k binary, t binary, tables binary"
PAIRS = "block bigint, bucket int, codes binary, n binary, tables binary"
WORDS = "block bigint, part int, at binary, c binary, states array<binary>"


def squeeze(a: np.ndarray) -> bytes:
    """Integers by byte planes, so that the empty high bytes vanish."""
    import zlib

    a = np.ascontiguousarray(a)
    return zlib.compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes() if len(a) else b"", 1)


def unsqueeze(raw: bytes, kind: str) -> np.ndarray:
    import zlib

    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def rising(a: np.ndarray) -> bytes:
    """Ascending integers by their steps."""
    return squeeze(np.diff(a, prepend=0).astype("<i8"))


def risen(raw: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(raw, "<i8"))


def joined(rows: list[dict], column: str, read) -> np.ndarray:
    """One column of several packed rows, one after the other."""
    return np.concatenate([read(r[column]) for r in rows]) if rows else np.zeros(0, np.int64)


def whole(raw: bytes) -> np.ndarray:
    return unsqueeze(raw, "<i8")


def cut_at(labels: np.ndarray):
    """(label, slice) of every run of ascending labels."""
    for k in np.unique(labels).tolist():
        yield k, slice(*np.searchsorted(labels, [k, k + 1]).tolist())


def sums_of(at: np.ndarray, x: np.ndarray, size: int) -> np.ndarray:
    return np.bincount(at, x, minlength=size).astype(np.int64)


def arrow(ddl: str):
    """Arrow schema of a Spark one; asked for on the driver and sent along."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def batch_of(rows: list, schema):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema.names)


def table_of(rows: list, schema):
    import pyarrow as pa

    return pa.Table.from_batches([batch_of(rows, schema)])


def bucket_of(context: np.ndarray, word: np.ndarray, buckets: int) -> np.ndarray:
    mixed = (context.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (word.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return ((mixed ^ (mixed >> np.uint64(29))) % np.uint64(buckets)).astype(np.int64)


def pack(docs: DataFrame) -> tuple[DataFrame, int]:
    """Stored blocks of documents (columns id, text, held), and the number of parts. A block numbers its words by part
    and hash; it holds its texts as such numbers, and the hashes and training counts of its words by part.

    The number of parts follows the size of the corpus, so a part's share of all words or pairs fits a task.
    """
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    n_parts, ddl = max(LEAST_PARTS, int(size) // BLOCK_BYTES), BLOCK.format(id=docs.schema["id"].dataType.simpleString())
    schema = arrow(ddl)

    def run(batches):
        import itertools
        import uuid
        from collections import defaultdict

        import xxhash

        state: dict = {}

        def fresh():
            index = defaultdict(itertools.count(1).__next__, {b"": 0})  # a word's number, given when first asked for
            state.update(index=index, parts=[], sizes=[], ids=[], held=[], bytes=0)

        def flush():
            hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in state["index"]), np.uint64, len(state["index"]))
            part = (hashes % np.uint64(n_parts)).astype(np.int64)
            order = np.lexsort((hashes, part))
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            tokens = rank[np.concatenate(state["parts"])]
            taught = np.repeat(~np.array(state["held"], bool), state["sizes"])
            trained = np.bincount(tokens[taught], minlength=len(rank))
            hashes, part = hashes[order], part[order]
            parts = [{"part": k, "words": hashes[at].tobytes(), "trained": squeeze(trained[at])} for k, at in cut_at(part)]
            # a task that runs again makes new names, but only one of its results is stored
            name = uuid.uuid4().int >> 65
            return batch_of([[name, state["ids"], state["held"], state["sizes"], squeeze(tokens.astype("<u4")), parts]], schema)

        fresh()
        for batch in batches:
            for i, text, held in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "held"))):
                words = tokens_of(text)
                state["parts"].append(np.fromiter(map(state["index"].__getitem__, words), np.int32, len(words)))
                state["sizes"].append(len(words))
                state["ids"].append(i)
                state["held"].append(held)
                state["bytes"] += len(text or "") + 1
                if state["bytes"] >= BLOCK_BYTES:
                    yield flush()
                    fresh()
        if state["ids"]:
            yield flush()

    return stored(docs.select("id", "text", "held").mapInArrow(run, ddl), "lm-blocks"), n_parts


def placed(blocks: DataFrame) -> DataFrame:
    """Stored: the places of every block's words in the parts of the vocabulary, with their training counts."""
    schema = arrow(PLACE)

    def merge(key, table):
        rows = table.to_pylist()
        lists = [np.frombuffer(r["words"], np.uint64) for r in rows]
        words, at = np.unique(np.concatenate(lists), return_inverse=True)
        c = sums_of(at, joined(rows, "trained", whole), len(words))
        part, ends = key[0].as_py(), np.cumsum([len(x) for x in lists])
        out = [[r["block"], part, rising(x), squeeze(c[x]), None] for r, x in zip(rows, np.split(at, ends[:-1]))]
        out.append([None, part, None, None, [len(words), int((c > 0).sum()), int(c.sum())]])
        return table_of(out, schema)

    parts = blocks.select("block", F.explode("parts").alias("x")).select("block", "x.*")
    return stored(parts.groupBy("part").applyInArrow(merge, PLACE), "lm-places")


def block_pairs(row: dict, places: np.ndarray, n_parts: int):
    """A block's (context, word) pairs by bucket: their words' places, their buckets, their training counts, each
    token's pair, and the pairs as numbers of the block's words. ``places`` are those of its words, in their order."""
    tokens, sizes = unsqueeze(row["tokens"], "<u4").astype(np.int64), np.array(row["sizes"], np.int64)
    # each text ends with the end token, which thus also stands before the next text and, around the corner, the first
    pairs, at = np.unique(np.roll(tokens, 1) * len(places) + tokens, return_inverse=True)
    trained = np.bincount(at[np.repeat(~np.array(row["held"], bool), sizes)], minlength=len(pairs))
    context, word = pairs // len(places), pairs % len(places)
    bucket = bucket_of(places[context], places[word], n_parts)
    order = np.argsort(bucket, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return bucket[order], context[order], word[order], trained[order], rank[at]


def places_of(rows: list[dict]) -> np.ndarray:
    """Place of each of a block's words: its part in the high half, its number there in the low one."""
    return np.concatenate([np.int64(r["part"]) << 32 | risen(r["at"]) for r in rows])


def counted(blocks: DataFrame, places: DataFrame, n_parts: int) -> DataFrame:
    """Stored buckets of pairs: those seen at least twice with their counts, which of its pairs each block asks for, and
    by word how often it ends or begins a known pair and one that was seen once.

    A bucket numbers the words of its pairs seen at least twice; ``at`` and ``active`` tell which those are.
    """
    up_schema, schema = arrow(MESSAGE), arrow(BUCKET)

    def send(own, told):
        rows, out = sorted(told.to_pylist(), key=lambda r: r["part"]), []
        for row in own.to_pylist():
            places = places_of(rows)
            bucket, context, word, trained, _ = block_pairs(row, places, n_parts)
            out += [[k, row["block"], rising(places[context[x]]), squeeze(places[word[x]]), squeeze(trained[x])] for k, x in cut_at(bucket)]
        return table_of(out, up_schema)

    def merge(key, table):
        rows = table.to_pylist()
        contexts = [risen(r["context"]) for r in rows]
        c, w, trained = np.concatenate(contexts), joined(rows, "word", whole), joined(rows, "trained", whole)
        words, numbers = np.unique(np.concatenate([c, w]), return_inverse=True)
        size, (context, word) = len(words), numbers.reshape(2, -1)
        pairs, at = np.unique(context * size + word, return_inverse=True)
        n = sums_of(at, trained, len(pairs))
        context, word = pairs // size, pairs % size
        often, once, known = n > 1, n == 1, n > 0
        rank = np.cumsum(often) - 1
        asks, ends = [], np.cumsum([len(x) for x in contexts])
        for r, x in zip(rows, np.split(at, ends[:-1])):
            asks.append({"block": r["block"], "codes": squeeze(np.minimum(n[x], 2).astype(np.uint8)), "at": rising(rank[x][often[x]])})
        ends_with = lambda b: sums_of(word, b, size)
        begins_with = lambda b: sums_of(context, b, size)
        active = ends_with(often) + begins_with(often) > 0
        told, sums = [], [(ends_with(b), begins_with(b)) for b in (once, known)]
        for k, x in cut_at(words >> 32):
            one, every = (squeeze(np.concatenate([a[x], b[x]])) for a, b in sums)
            told.append({"part": k, "at": rising(words[x] & 0xFFFFFFFF), "active": squeeze(active[x].astype(np.uint8)), "once": one, "all": every})
        number = np.cumsum(active) - 1
        packed = [squeeze(x.astype("<i8")) for x in (number[context[often]], number[word[often]], n[often])]
        return table_of([[key[0].as_py(), [int(once.sum()), int((n == 2).sum())], *packed, asks, told]], schema)

    sent = blocks.select("block", "held", "sizes", "tokens").groupBy("block").cogroup(
        places.filter(F.col("block").isNotNull()).select("block", "part", "at").groupBy("block")
    )
    return stored(sent.applyInArrow(send, MESSAGE).groupBy("bucket").applyInArrow(merge, BUCKET), "lm-pairs")


def vocabulary(pairs: DataFrame, places: DataFrame) -> DataFrame:
    """Stored parts: which words each bucket's frequent pairs hold, and of every word the number of pairs it ends and
    begins, of those seen once and of all."""
    schema = arrow(PART)

    def merge(own, told):
        rows, out = sorted(told.to_pylist(), key=lambda r: r["bucket"]), []
        for row in own.to_pylist():
            size = row["stats"][0]
            at = [risen(r["at"]) for r in rows]
            both = lambda c: [np.split(whole(r[c]), 2) for r in rows]
            total = lambda c: [squeeze(sum((sums_of(x, y[i], size) for x, y in zip(at, both(c))), np.zeros(size, np.int64))) for i in (0, 1)]
            asks = [{"bucket": r["bucket"], "at": rising(x[unsqueeze(r["active"], "u1") > 0])} for r, x in zip(rows, at)]
            out.append([row["part"], size, total("once"), total("all"), asks])
        return table_of(out, schema)

    own = places.filter(F.col("block").isNull()).select("part", "stats").groupBy("part")
    told = pairs.select("bucket", F.explode("words").alias("x")).select("bucket", "x.*")
    return stored(own.cogroup(told.groupBy("part")).applyInArrow(merge, PART), "lm-words")


# ---- seating ---------------------------------------------------------------------------------------------


SPAN, SEATED = 4096, 1_000_000  # customers of one dish, and of all, that are seated at once


def reseat(count: np.ndarray, open_weight: np.ndarray, discount: float, rng) -> np.ndarray:
    """Tables of ``count`` customers of one dish, seated one after the other: the j-th opens a table with odds
    ``open_weight`` to ``j - discount * tables``.

    Every customer has a random number of its own. Who opens a table is first found as if no other customer of the span
    did, then again with the tables so found, until nothing changes: tables only make new ones likelier, so
    this ends at what seating one by one with these numbers gives.
    """
    count, tables = np.asarray(count, np.int64), np.minimum(count, 1).astype(np.float64)
    seated = np.minimum(count, 1)
    while True:
        waiting = np.flatnonzero(count > seated)
        if not len(waiting):
            return tables
        sizes = np.minimum(count[waiting] - seated[waiting], SPAN)
        for at, size in in_batches(waiting, sizes):
            owner, first = np.repeat(np.arange(len(at)), size), np.cumsum(size) - size
            j = np.arange(len(owner)) - first[owner] + seated[at][owner]
            a = open_weight[at][owner]
            # u * (a + j - d * t) < a, for t tables before the customer
            least = (a + j - a / np.maximum(rng.random(len(owner)), 1e-300)) / discount - tables[at][owner]
            opens = least < 0
            while True:
                total = np.cumsum(opens)
                before = total - opens - (total[first] - opens[first])[owner]
                now = least < before
                if (now == opens).all():
                    break
                opens = now
            tables[at] += np.add.reduceat(opens, first, dtype=np.int64)
            seated[at] += size


def in_batches(at: np.ndarray, sizes: np.ndarray):
    """Cuts of ``at`` of at most about ``SEATED`` customers."""
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // SEATED)) + 1
    return zip(np.split(at, cuts), np.split(sizes, cuts))


class Shared:
    """What all words share in a state: the parent's customers and tables, ``V`` and the discounts."""

    def __init__(self, customers: float, tables: float, words: int, d: float, d0: float):
        self.customers, self.tables, self.words, self.d, self.d0 = customers, tables, words, d, d0

    def base(self) -> float:
        """The parent's probability of a word without customers."""
        return (THETA + self.d0 * self.tables) / (THETA + self.customers) / (self.words + 1)

    def parent(self, k: np.ndarray, o: np.ndarray) -> np.ndarray:
        """The parent's probability of words with ``k`` customers at ``o`` tables."""
        return np.maximum(k - self.d0 * o, 0) / (THETA + self.customers) + self.base()

    def rest(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        """What a context with ``c`` customers at ``t`` tables leaves to the parent."""
        return (THETA + self.d * t) / (THETA + c)

    def seat_parent(self, k: np.ndarray, rng) -> np.ndarray:
        return reseat(k, np.full(len(k), (THETA + self.d0 * self.tables) / (self.words + 1)), self.d0, rng)

    def seat_pairs(self, n: np.ndarray, t: np.ndarray, p: np.ndarray, rng) -> np.ndarray:
        """Tables of pairs whose context has ``t`` tables and whose word has probability ``p`` in the parent."""
        return reseat(n, (THETA + self.d * t) * p, self.d, rng)


def pair_tables(row: dict, told: list[dict], shared: Shared, seed: int) -> np.ndarray:
    """Tables of a bucket's frequent pairs in the sweep ``seed``, given the state before it."""
    told = sorted(told, key=lambda r: r["part"])
    t, k, o = (joined(told, c, whole) for c in "tko")
    context, word, n = (whole(row[c]) for c in ("context", "word", "n"))
    p = shared.parent(k, o)
    return shared.seat_pairs(n, t[context], p[word], np.random.default_rng([seed, row["bucket"], 1]))


def first_state(parts: DataFrame) -> DataFrame:
    """Stored: one table for every pair, and one in the parent for every word."""
    schema = arrow(STATE)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                k, t = (whole(x) for x in row["all"])
                o = np.minimum(k, 1)
                stats = [int(k.sum()), int(o.sum()), int((k == 1).sum()), int((k == 2).sum())]
                yield batch_of([[row["part"], squeeze(t), squeeze(k), squeeze(o), stats]], schema)

    return stored(parts.select("part", "all").mapInArrow(run, STATE), "lm-state")


def told_down(parts: DataFrame, state: DataFrame) -> DataFrame:
    """What a state says of the words each bucket asks for."""
    schema = arrow(DOWN)

    def run(own, told):
        out = []
        for state in told.to_pylist():
            values = [whole(state[c]) for c in "tko"]
            for row in own.to_pylist():
                for ask in row["asks"]:
                    at = risen(ask["at"])
                    out.append([ask["bucket"], row["part"], *(squeeze(x[at]) for x in values)])
        return table_of(out, schema)

    return parts.select("part", "asks").groupBy("part").cogroup(state.select("part", "t", "k", "o").groupBy("part")).applyInArrow(run, DOWN)


def sweep(pairs: DataFrame, parts: DataFrame, state: DataFrame, shared: Shared, seed: int) -> tuple[DataFrame, DataFrame]:
    """Stored tables of every pair, and stored state after reseating every pair and then every word in the parent."""
    up_schema, schema = arrow(UP), arrow(STATE)

    def up(own, told):
        rows, out = sorted(told.to_pylist(), key=lambda r: r["part"]), []
        for row in own.to_pylist():
            tables = pair_tables(row, rows, shared, seed)
            cuts = np.cumsum([len(whole(r["t"])) for r in rows])
            sums = lambda c: np.split(sums_of(whole(row[c]), tables, cuts[-1] if len(cuts) else 0), cuts[:-1])
            out += [[r["part"], row["bucket"], squeeze(k), squeeze(t), None] for r, k, t in zip(rows, sums("word"), sums("context"))]
            out.append([None, row["bucket"], None, None, squeeze(tables.astype(np.int64))])
        return table_of(out, up_schema)

    def settle(own, told):
        sums, out = {r["bucket"]: r for r in told.to_pylist()}, []
        for row in own.to_pylist():
            k, t = (whole(x).copy() for x in row["once"])
            for ask in row["asks"]:
                if ask["bucket"] in sums:
                    at = risen(ask["at"])
                    k[at] += whole(sums[ask["bucket"]]["k"])
                    t[at] += whole(sums[ask["bucket"]]["t"])
            o = shared.seat_parent(k, np.random.default_rng([seed, row["part"], 2])).astype(np.int64)
            out.append([row["part"], squeeze(t), squeeze(k), squeeze(o), [int(k.sum()), int(o.sum())]])
        return table_of(out, schema)

    own = pairs.select("bucket", "context", "word", "n").groupBy("bucket")
    rose = stored(own.cogroup(told_down(parts, state).groupBy("bucket")).applyInArrow(up, UP), "lm-tables")
    sums = rose.filter(F.col("part").isNotNull()).select("part", "bucket", "k", "t").groupBy("part")
    done = parts.select("part", "once", "asks").groupBy("part").cogroup(sums).applyInArrow(settle, STATE)
    return rose.filter(F.col("part").isNull()).select("bucket", "tables"), stored(done, "lm-state")


def summed(table: DataFrame, column: str, size: int) -> list[int]:
    out = [0] * size
    for k, x in table.select(F.posexplode(column)).groupBy("pos").agg(F.sum("col")).collect():
        out[k] = x
    return out


def train(pairs: DataFrame, parts: DataFrame, words: int) -> list[tuple[DataFrame, DataFrame, Shared]]:
    """The kept states of the sampler: tables of the pairs, state of the words, and what all words share."""
    once, twice = summed(pairs, "stats", 2)
    share = lambda a, b: float(np.clip(a / max(1, a + 2 * b), 0.05, 0.95))
    state = first_state(parts)
    customers, tables, k1, k2 = summed(state, "sums", 4)
    d, d0 = share(once, twice), share(k1, k2)
    shared, states = Shared(customers, tables, words, d, d0), []
    for seed in range(1, BURN_IN + SAMPLES + 1):
        rose, state = sweep(pairs, parts, state, shared, seed)
        shared = Shared(*summed(state, "sums", 2), words, d, d0)
        states.append((rose, state, shared))
    return states[BURN_IN:]


# ---- scoring ---------------------------------------------------------------------------------------------


def told_pairs(pairs: DataFrame, states: list) -> DataFrame:
    """For every block and bucket: how often each asked pair was seen (two standing for more), and of those seen more
    often the count and the tables, summed over the kept states."""
    schema = arrow(PAIRS)

    def run(own, told):
        kept, out = [whole(r["tables"]) for r in told.to_pylist()], []
        for row in own.to_pylist():
            n, tables = whole(row["n"]), sum(kept)
            for ask in row["asks"]:
                at = risen(ask["at"])
                out.append([ask["block"], row["bucket"], ask["codes"], squeeze(n[at]), squeeze(tables[at])])
        return table_of(out, schema)

    rose = reduce(DataFrame.union, [tables for tables, _, _ in states])
    return pairs.select("bucket", "n", "asks").groupBy("bucket").cogroup(rose.groupBy("bucket")).applyInArrow(run, PAIRS)


def told_words(places: DataFrame, states: list) -> DataFrame:
    """For every block and part: the training counts of its words, and their tables and customers in the kept states."""
    schema, kept = arrow(WORDS), range(len(states))

    def run(own, told):
        by = {r["s"]: r for r in told.to_pylist()}
        values = [whole(by[s][c]) for s in kept for c in "tko"]
        out = []
        for row in own.to_pylist():
            at = risen(row["at"])
            out.append([row["block"], row["part"], row["at"], row["c"], [squeeze(x[at]) for x in values]])
        return table_of(out, schema)

    rows = reduce(DataFrame.union, [states[s][1].select("part", "t", "k", "o", F.lit(s).alias("s")) for s in kept])
    own = places.filter(F.col("block").isNotNull()).select("block", "part", "at", "c").groupBy("part")
    return own.cogroup(rows.groupBy("part")).applyInArrow(run, WORDS)


def predicted(n, tables, c, states: list[np.ndarray], context, word, shared: list[Shared]) -> np.ndarray:
    """Mean over the kept states of the probability of pairs with ``n`` customers, at ``tables`` tables over all states.
    ``c`` are the customers of words as contexts, ``states`` their t, k and o, state after state."""
    d, kept = shared[0].d, len(shared)
    mean = (n - d * tables / kept) / (THETA + c[context])
    for s, own in enumerate(shared):
        t, k, o = states[3 * s : 3 * s + 3]
        mean += own.rest(c, t)[context] * own.parent(k, o)[word] / kept
    return mean


OUT = "id {id}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def score_texts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", folds: int = 5, held: int = 1) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    with short_shuffles(docs.sparkSession):
        return scored(docs, id_col, text, folds, held)


def scored(docs: DataFrame, id_col: str, text: str, folds: int, held: int) -> DataFrame:
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"), (fold(F.col(f"`{id_col}`"), folds) == held).alias("held"))
    blocks, n_parts = pack(rows)
    places = placed(blocks)
    _, v, n = summed(places, "stats", 3)
    pairs = counted(blocks, places, n_parts)
    parts = vocabulary(pairs, places)
    states = train(pairs, parts, v)
    ddl = OUT.format(id=rows.schema["id"].dataType.simpleString())
    schema, shared = arrow(ddl), [x for _, _, x in states]

    def score(block, answer):
        told = answer.to_pylist()
        by_part = sorted((r for r in told if r["part"] is not None), key=lambda r: r["part"])
        by_bucket = sorted((r for r in told if r["part"] is None), key=lambda r: r["bucket"])
        out = []
        for row in block.to_pylist():
            _, context, word, _, at = block_pairs(row, places_of(by_part), n_parts)
            c = joined(by_part, "c", whole)
            state = [np.concatenate([whole(r["states"][i]) for r in by_part]) for i in range(3 * len(shared))]
            seen = joined(by_bucket, "codes", lambda raw: unsqueeze(raw, "u1")).astype(np.int64)
            tables, often = seen * len(shared), seen > 1  # a pair seen once has one table in every state
            seen[often], tables[often] = (joined(by_bucket, x, whole) for x in ("n", "tables"))
            tables[seen == 1] = len(shared)
            p = predicted(seen, tables, c, state, context, word, shared)
            count = c[word]
            base = np.log10((count + 0.5) / (n + 0.5 * (v + 1)))
            sizes = np.array(row["sizes"], np.int64)
            first = np.cumsum(sizes) - sizes
            sums = [np.add.reduceat(x[at], first) for x in ((count > 0).astype(np.int64), base, np.log10(np.minimum(p, 1.0)))]
            out += zip(row["ids"], row["held"], sizes.tolist(), *(x.tolist() for x in sums))
        return table_of(out, schema)

    answers = told_pairs(pairs, states).unionByName(told_words(places, states), allowMissingColumns=True)
    own = blocks.select("block", "ids", "held", "sizes", "tokens").groupBy("block")
    out = own.cogroup(answers.groupBy("block")).applyInArrow(score, ddl)
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n).cast("bigint").alias("train_tokens"), "base_score", "score"
    )
