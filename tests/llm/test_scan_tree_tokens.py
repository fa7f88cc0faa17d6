"""Hard negatives, source divergence and tokenization against brute force."""

import math
import random
import re
import struct
from collections import Counter, defaultdict

import numpy as np
import pytest

from flowhorizon.llm import divergence, queries, tokenization, vertical_scan

# ---- hard negatives ----

VECTORS = "vec_id bigint, embedding array<float>, label int, score string, anchor int"


def negatives_by_hand(rows, every=100, positives=5, negatives=10):
    """All scores, by Python integers."""
    fine = lambda v: v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v)
    rows = [(i, [math.floor(256 * float(np.float32(x))) for x in v], y) for i, v, y in rows if y is not None and fine(v)]
    out = []
    by = lambda r: (-r[1], r[0] is None, r[0])
    for at, (i, v, y) in enumerate(rows):
        if i is None or i % every:
            continue
        scored = [(j, sum(a * b for a, b in zip(v, w)), z) for k, (j, w, z) in enumerate(rows) if k != at and len(w) == len(v)]
        for pid, ps, _ in sorted((r for r in scored if r[2] == y), key=by)[:positives]:
            window = [r for r in scored if r[2] != y and 30 * ps <= 100 * r[1] <= 90 * ps]
            out += [(i, pid, k, nid, ps, ns) for k, (nid, ns, _) in enumerate(sorted(window, key=by)[:negatives], 1)]
    return Counter(out)


def vector_rows(n, dim=9, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((4, dim))
    rows = []
    for i in range(n):
        y = int(rng.integers(4))
        rows.append((i, (0.6 * centres[y % 2] + 0.5 * rng.standard_normal(dim)).round(1).astype(np.float32).tolist(), y))
    return rows


@pytest.mark.parametrize("sizes", [(2048, 16384, 256), (16, 32, 3)])
def test_negatives_equal_brute_force(spark, monkeypatch, sizes):
    for name, size in zip(("BLOCK_ROWS", "LANE_ROWS", "ANCHOR_ROWS"), sizes):
        monkeypatch.setattr(vertical_scan, name, size)
    rows = vector_rows(300)
    rows += [(None, rows[7][1], 1), (None, rows[8][1], 2), (3000, None, 1), (3100, [], 1), (3200, [0.1, None], 1)]
    rows += [(3300, [float("nan")] * 9, 1), (3400, rows[1][1], None), (3500, [0.5, 0.25], 1), (3501, [0.5, 0.2], 1), (3502, [0.4, 0.1], 2)]
    rows += [(3600, [0.0] * 9, 0), (40, rows[40][1], rows[40][2]), rows[100], (3700, [1e30] * 9, 9)]
    df = spark.createDataFrame([(*r, "s", 1) for r in rows[:-1]], VECTORS).repartition(3)
    got = Counter(tuple(r) for r in vertical_scan.hard_negatives(df, every=20).collect())
    assert got == negatives_by_hand(rows[:-1], every=20) and len(got) > 100
    # components beyond the range of whole numbers are limited to it
    assert vertical_scan.hard_negatives(spark.createDataFrame([(*r, "s", 1) for r in rows], VECTORS), every=20).count() > 100


def test_negatives_of_an_empty_table(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert vertical_scan.hard_negatives(empty).count() == 0
    one = spark.createDataFrame([(0, [1.0], 1, "s", 1)], VECTORS)
    assert vertical_scan.hard_negatives(one).count() == 0


def test_scan_drops_rows_before_the_last_column():
    """The bitmap shrinks on the way: rows whose bounds miss the window are not read to the end."""
    rng = np.random.default_rng(1)
    x = rng.integers(-3, 4, (16, 400))
    x[0, :200] = 500
    row = {"block": 0, "dim": 16, "rows": 400, "ids": np.arange(400).tobytes(), "labels": np.zeros(400, np.int64).tobytes()}
    row |= {"columns": x.tobytes(), "low": x.min(axis=1).tobytes(), "high": x.max(axis=1).tobytes()}
    lane, v = vertical_scan.Lane([row]), np.array([100] + [1] * 15)
    (own, score), = lane.scan(v, np.ones(400, bool), np.array([[-(1 << 62), 1 << 62]]), 5)
    true = v @ x
    assert own.tolist() == sorted(range(400), key=lambda i: (-true[i], i))[:5]
    assert (score[200:] != true[200:]).any() and (score[own] == true[own]).all()


# ---- source divergence ----

DOCS = "doc_id bigint, text string, lang string, source string, term string, n int"


def divergence_by_hand(rows, documents, top=50):
    own, seen = defaultdict(Counter), defaultdict(Counter)
    groups = {(g or "", s or "") for _, g, s in rows}
    for text, g, s in rows:
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        own[g or "", s or ""].update(words)
        seen[g or ""].update(set(words))
    out = []
    for g, s in groups:
        kept = [w for w, d in seen[g].items() if d >= documents]
        total = lambda c: sum(c[w] for w in kept)
        share = lambda c, w: 1 + 1_000_000_000 * (c[w] + 5) // (total(c) + 5 * len(kept))
        lang = sum((c for (h, _), c in own.items() if h == g), Counter())
        pairs = [(t, sum(abs(share(own[g, s], w) - share(own[g, t], w)) for w in kept)) for h, t in groups if h == g and t != s]
        terms = [(w, share(own[g, s], w) - share(lang, w)) for w in kept if own[g, s][w] and share(own[g, s], w) > share(lang, w)]
        order = lambda x: (-x[1], x[0].encode())
        out += [(g, s, "pair", t, v, k) for k, (t, v) in enumerate(sorted(pairs, key=order), 1)]
        out += [(g, s, "term", t, v, k) for k, (t, v) in enumerate(sorted(terms, key=order)[:top], 1)]
    return Counter(out)


@pytest.mark.parametrize("small", [False, True])
def test_divergence_equals_brute_force(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(divergence, "PIECE", 5)
        monkeypatch.setattr(divergence, "HELD", 7)
    rng = random.Random(4)
    words = ["Ab", "ab", "äb", "ÄB", "ßx", "z", "zz", "日本", "q", "r'r", "x1y", "n\x00m", "ünder", "w" * 50]
    rows = [(" ".join(rng.choices(words[: rng.randint(2, 14)], k=rng.randint(0, 30))), rng.choice(["en", "de"]), rng.choice("ABCD")) for _ in range(120)]
    rows += [(None, "en", "E"), ("", "en", None), ("lonely words here", "fr", "A"), ("other", "fr", "B"), ("x", None, None), ("z z", "it", "A")]
    rows += [("z " * 3000 + "q" * 30_000, "en", "A")] * 3
    df = spark.createDataFrame([(i, *r, "t", 1) for i, r in enumerate(rows)], DOCS).repartition(5)
    got = Counter(tuple(r) for r in divergence.audit(df, documents=3).collect())
    assert got == divergence_by_hand(rows, 3) and {r[2] for r in got} == {"pair", "term"}


def test_divergence_of_an_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS)).count() == 0


def test_shared_paths_are_added_once_per_node_and_ancestor(spark):
    rows = spark.createDataFrame(
        [("l", [("a", 1, 10, 5), ("b", 2, 7, 4)], 3), ("l", [("a", 1, 10, 5), ("c", 1, 9, 2)], 2)],
        "lang string, path array<struct<source:string,n:bigint,p:bigint,z:bigint>>, m bigint",
    )
    got = {(r.s, r.t, r.p): int(r.amount) for r in divergence.corrections(rows.coalesce(1).sortWithinPartitions("lang", "path")).collect()}
    assert got == {("a", None, 10): 5, ("b", None, 7): 3, ("c", None, 9): 2, ("a", "b", None): 3 * (3 - 6 - 2 + 1), ("a", "c", None): 2 * (1 - 8 - 4 + 3)}


# ---- tokenization ----


@pytest.fixture(scope="module")
def path():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


ODD = [None, "", " ", "aaaaaaaaaaaaa", "  \n\n x\t\t y  ", "<|endoftext|>", "a<|endoftext|> <|endoftext|>b", "日本語 テキスト", "I'll don't", "x" * 50_000]
ODD += ["ab " * 20_000, "\U0001f600\U0001f468‍\U0001f469", "\x00\x1c\x85 é", "֊ՙ\U00018e01\U0001255012 !֋", "same", "same"]


def odd_texts():
    rng = random.Random(9)
    some = lambda: chr(rng.choice([rng.randint(0, 0xD7FF), rng.randint(0xE000, 0x2FFFF), rng.randint(32, 126)]))
    close = "abcdeéß 'st12\n\t.,—日語"
    return ODD + ["".join(some() for _ in range(rng.randint(0, 30))) for _ in range(300)] + ["".join(rng.choices(close, k=rng.randint(0, 60))) for _ in range(300)]


def test_tokens_equal_the_library(spark, path):
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(path)
    texts = odd_texts()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, ids string, n_tokens int")
    vocabulary = tokenization.read_vocabulary(path)
    encoded = tokenization.encode(docs, vocabulary, ["doc_id"])
    assert encoded.columns == ["doc_id", "n_tokens", "ids"]
    got = {r.doc_id: r for r in tokenization.decode(encoded, vocabulary, ["doc_id", "ids", "n_tokens"]).collect()}
    for i, want in enumerate(library.encode_batch([t or "" for t in texts], add_special_tokens=False)):
        assert list(struct.unpack(f"<{got[i].n_tokens}I", got[i].ids)) == want.ids
        assert got[i].text == library.decode(want.ids, skip_special_tokens=False) == (texts[i] or "")


def test_tokens_of_the_table(spark, sf, path):
    import hashlib

    library = pytest.importorskip("tokenizers").Tokenizer.from_file(path)
    texts = {r.doc_id: r.text or "" for r in queries.table(spark, sf, "documents").collect()}
    got = queries.QUERIES["op13_tokenization"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        digest = lambda raw: hashlib.sha256(raw).hexdigest()
        assert r.n_tokens == len(ids) and r.ids_sha256 == digest(struct.pack(f"<{len(ids)}I", *ids))
        assert r.decoded_sha256 == digest(library.decode(ids, skip_special_tokens=False).encode())


def test_tokens_of_an_empty_table_and_unknown_ids(spark, path):
    vocabulary = tokenization.read_vocabulary(path)
    assert tokenization.encode(spark.createDataFrame([], "doc_id bigint, text string"), vocabulary, ["doc_id"]).count() == 0
    ids = spark.createDataFrame([(1, bytearray(struct.pack("<2I", 64, 900_000))), (2, None)], "k int, ids binary")
    assert [r.text for r in tokenization.decode(ids, vocabulary, ["k"]).orderBy("k").collect()] == ["a�", ""]


def merged(word, ranks):
    """The merges one at a time, the earliest first and in it the leftmost."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while True:
        at = min(((ranks[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks), default=None)
        if at is None:
            return parts
        parts[at[1] : at[1] + 2] = [parts[at[1]] + parts[at[1] + 1]]


def test_automaton_of_random_merges_equals_merging():
    """Every word over three letters, for merge lists in which each half is there before the whole."""
    rng = random.Random(2)
    for _ in range(40):
        labels, pairs = [b"a", b"b", b"c"], []
        while len(pairs) < 12:
            p = (rng.choice(labels), rng.choice(labels))
            if p not in pairs and p[0] + p[1] not in labels and len(p[0] + p[1]) < 9:
                pairs.append(p)
                labels.append(p[0] + p[1])
        ids = {w: i for i, w in enumerate(labels)}
        automaton = tokenization.Automaton(ids, [(ids[a], ids[b], ids[a + b]) for a, b in pairs])
        ranks = {p: i for i, p in enumerate(pairs)}
        for _ in range(300):
            word = bytes(rng.choices(b"abc", k=rng.randint(1, 14)))
            assert [labels[i] for i in automaton.encode(word)] == merged(word, ranks)
