"""Toxicity, language, secrets and LM scoring: edge cases, brute force and held-out accuracy."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from flowhorizon.llm import languages, pitman_yor, queries, secret_scan, toxicity

SCHEMA = "doc_id bigint, text string, lang string, score string, word int"
ODD = [(900, None, "en"), (901, "", "en"), (902, " \n\t ", "en"), (903, "w" * 200_000, "en"), (904, "x y " * 60_000, None), (905, "12 34", "de"), (905, "12 34", "de"), (None, "no id", "en")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "s", 1) for r in rows], SCHEMA)


def fold(i, n):
    return zlib.crc32(("" if i is None else str(i)).encode()) % n


# ---- toxicity ----


def toxic_rows(n=500):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdeiou"), 4)) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        text = rng.choice(words, rng.integers(5, 120)).tolist()
        if i % 5 == 0:
            text[int(rng.integers(len(text)))] = rng.choice(["zzgrim", "zzgrum", "zzgral"])
        rows.append((i, " ".join(text), "en"))
        labels.append((i, int(i % 5 == 0)))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = toxic_rows()
    docs = frame(spark, rows + ODD)
    known = spark.createDataFrame(labels + [(3, None), (None, 1), (9999, 1)], "doc_id bigint, toxic int")
    got = toxicity.toxicity(docs, known).collect()
    assert len(got) == len(rows) + len(ODD) and all(0 <= r.score <= 1 for r in got)
    held = [(r.score, r.doc_id % 5 == 0) for r in got if r.doc_id is not None and r.doc_id < 500 and fold(r.doc_id, 4) == 2]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.9
    assert len({r.score for r in got if r.doc_id == 905}) == 1
    assert len({r.score for r in got if r.doc_id in (900, 901, 902)}) == 1
    kept = toxicity.drop_toxic(docs, known)
    assert kept.columns == docs.columns
    clean = sum(r.score < 0.3 for r in got)
    assert kept.count() == clean


def test_toxicity_without_labels(spark):
    docs, none = frame(spark, ODD), spark.createDataFrame([], "doc_id bigint, toxic int")
    assert {r.score for r in toxicity.toxicity(docs, none).collect()} == {0.5}
    assert toxicity.toxicity(frame(spark, []), none).count() == 0


def test_windows_cover_everything():
    for n in range(0, 200):
        at = list(toxicity.starts(n))
        assert at[0] == 0 and at[-1] + toxicity.WINDOW >= n
        assert all(b - a <= toxicity.STRIDE for a, b in zip(at, at[1:]))


def test_gradients():
    rng = np.random.default_rng(0)
    words = ["<none>", "abc", "bcd", "worse", "so"]
    net = toxicity.Net(words[1:4], 1)
    for k, v in net.p.items():
        net.p[k] = v.astype(np.float64) + 0.1 * rng.standard_normal(v.shape)
    net.p["word"][0] = 0
    at = rng.integers(0, 5, (6, 3))
    mask = np.arange(6)[:, None] < np.array([6, 3, 1])[None]
    y = np.array([1.0, 0.0, 1.0])

    def loss():
        x = net.inputs(words)[0]
        gates = np.concatenate([x @ net.p[f"W{d}"] + net.p[f"c{d}"] for d in "fb"], axis=1)
        z = net.run(gates[at], mask)
        return float(np.mean(np.logaddexp(0, z) - y * z))

    grads = net.gradients(words, at, mask, y)
    for key in ("Wf", "Ub", "v", "w", "cf", "word", "b"):
        i = tuple(rng.integers(0, s) for s in net.p[key].shape)
        if key == "word":
            i = (1, 2)
        old = net.p[key][i]
        net.p[key][i] = old + 1e-2
        up = loss()
        net.p[key][i] = old - 1e-2
        down = loss()
        net.p[key][i] = old
        assert abs((up - down) / 2e-2 - grads[key][i]) < 2e-3, key


# ---- language ----


def test_languages(spark, sf):
    got = queries.QUERIES["op9_language_id"](spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    held = got.filter("held_out").join(docs, "doc_id")
    assert held.filter("lang = lang_pred").count() >= 0.97 * held.count()
    assert got.filter("score < 0 or score > 1").count() == 0


def test_languages_odd(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 5)]
    docs = frame(spark, rows + ODD)
    out = languages.identify(docs, languages.prototypes(docs.filter("doc_id < 900")), ["doc_id", "word"])
    got = {r.doc_id: r.lang_pred for r in out.collect()}
    assert [got[i] for i in (900, 901, 902, 905)] == ["und"] * 4 and got[0] == "en" and got[1] == "de"
    assert got[903] in ("en", "de") and out.count() == len(rows) + len(ODD)
    none = languages.identify(docs, languages.prototypes(docs.filter("false")), ["doc_id"])
    assert {(r.lang_pred, r.score) for r in none.collect()} == {("und", 0.0)}


def test_cosine_is_of_the_bundles():
    texts = ["Ein Hund, ein Haus.", "the house"]
    bundles, some = languages.Encoder().bundles(texts)

    def brute(t):
        low, v = re.sub(r"[^a-zäöü]+", " ", f" {t.lower()} "), np.zeros(languages.DIM)
        for i in range(len(low) - 2):
            a, b, c = (languages.letter_vector(ord(x)).astype(int) for x in low[i : i + 3])
            v += np.roll(a, 2) * np.roll(b, 1) * c
        return v

    assert (bundles == np.stack([brute(t) for t in texts])).all() and some.all()


def test_long_texts_in_pieces_and_blocks(monkeypatch):
    """Pieces of a text and blocks of trigrams give the sums of the whole."""
    rng = np.random.default_rng(4)
    text = "".join(rng.choice(list("abcdefghij äöü  ..,"), 3000))
    whole, _ = languages.Encoder().bundles([text])
    monkeypatch.setattr(languages, "GRAMS", 7)
    assert (languages.Encoder().bundles([text])[0] == whole).all()
    for most in (1, 2, 50, 999):
        monkeypatch.setattr(languages, "SLICE_CHARS", most)
        assert (languages.Encoder().bundles([text])[0] == whole).all()


def test_long_text_of_many_letters_stays_small():
    import tracemalloc

    letters = [chr(0x4E00 + i) for i in range(5000)]
    text = "".join(np.random.default_rng(1).choice(letters, 600_000))
    tracemalloc.start()
    languages.Encoder().bundles([text])
    assert tracemalloc.get_traced_memory()[1] < 500 << 20
    tracemalloc.stop()


# ---- secrets ----

PLAIN = [
    ("assign", re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 8),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile("[0-9a-f]+"), 0, 32),
]
TRICKY = [
    'ä PassWord = "abcdEFGH" token:short api_key=12345678 APIKEY : zzzzzzzz', "AKIAABCDEFGHIJKL AKIAAB", "f" * 31 + " " + "a0" * 40,
    "\u212aey toKen=\u017fecret=aaaaaaaa", "token=token=token=abcdefgh", "secret='" + "x" * 100_000 + "'", None, "", "passwd:" + "0123456789abcdef" * 3,
    "ghp_" + "A" * 36 + " -----BEGIN RSA PRIVATE KEY-----",
]


def brute_spans(text):
    found = [(m.start(), k, m.end()) for k, (_, rx, g, n) in enumerate(PLAIN) for m in rx.finditer(text or "") if len(m.group(g)) >= n]
    return ",".join(f"{PLAIN[k][0]}:{a}:{b}" for a, k, b in sorted(found))


def test_secrets(spark, tmp_path):
    rows = [(i, t, "en") for i, t in enumerate(TRICKY)] + ODD
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op7_secrets"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    by_id = {i: t for i, t, _ in rows}
    for r in got:
        want = brute_spans(by_id[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), r.doc_id
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s.startswith(k) for s in want.split(",")) for k in ("assign", "access", "hex")]
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))
    extra = next(r for r in got if r.doc_id == 9).spans
    assert "repo:0:40" in extra and "pem:41:72" in extra


def test_secrets_of_the_table(spark, sf):
    got = {r.doc_id: r.base_sha256 for r in queries.QUERIES["op7_secrets"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        assert got[r.doc_id] == hashlib.sha256(brute_spans(r.text).encode()).hexdigest()


@pytest.mark.parametrize(
    "pattern, query",
    [
        ("abcd", ("and", ("abc", "bcd"))),
        ("(abc|xyz)", ("or", ("abc", "xyz"))),
        ("[0-9a-f]{32,}", None),
        ("ab?cd", ("or", ("abc", "acd"))),
        ("x*foo", "foo"),
        ("(foo)+bar", ("and", ("foo", "bar"))),
        ("(foo)?", None),
    ],
)
def test_trigram_queries(pattern, query):
    got = secret_scan.trigram_query(pattern)
    if pattern == "ab?cd":
        assert got == ("or", (("and", ("abc", "bcd")), "acd"))
    else:
        assert got == query


# ---- language model ----


def tokens(t):
    return [w.decode() for w in (t or "").encode().lower().split()] + [None]


def test_lm_base_and_held_out(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.QUERIES["op8_lm_scoring"](spark, sf).collect()}
    count = Counter(w for i, t in docs.items() if fold(i, 5) != 1 for w in tokens(t))
    n, v = sum(count.values()), len(count)
    assert len(got) == len(docs)
    for i, t in docs.items():
        words = tokens(t)
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(i, 5) == 1, len(words), sum(count[w] > 0 for w in words), n)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and r.score < 0
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_odd(spark):
    rows = [(i, "the cat sat on the mat", "en") for i in range(20)] + ODD
    got = pitman_yor.score_texts(frame(spark, rows)).collect()
    assert len(got) == len(rows) and all(math.isfinite(r.score) and r.score <= 0 for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (900, 901, 902)} == {1}
    assert pitman_yor.score_texts(frame(spark, [])).count() == 0
    nothing = pitman_yor.score_texts(frame(spark, [(i, "a b", "en") for i in range(40) if fold(i, 5) == 1])).collect()
    assert nothing and {(r.train_tokens, r.base_score, r.score) for r in nothing} == {(0, 0.0, 0.0)}


def test_lm_is_a_distribution():
    """Probabilities of all known words and the unknown one sum to one in every context."""
    rng = np.random.default_rng(0)
    word, context = np.repeat(np.arange(200), 3), np.tile([0, 1, 2], 200)
    n = rng.integers(1, 90, len(word))
    c, kept, states, shared = np.bincount(context, n), 3, [], pitman_yor.Shared(600, 200, 200, 0.6, 0.5)
    t, k, o = np.full(3, 200), np.full(200, 3), np.ones(200)
    total, used = np.zeros(len(n)), []
    for sweep in range(5):
        tables = shared.seat_pairs(n, t[context], shared.parent(k, o)[word], rng)
        t, k = np.bincount(context, tables), np.bincount(word, tables)
        o = shared.seat_parent(k, rng)
        shared = pitman_yor.Shared(k.sum(), o.sum(), 200, 0.6, 0.5)
        if sweep >= 2:
            states += [t, k, o]
            used.append(shared)
            total += tables
    here = pitman_yor.predicted(n, total, c, states, context, word, used)
    nothing = np.mean([x.rest(c, t) * x.base() for x, t in zip(used, states[::3])], axis=0)
    for u in range(3):
        assert abs(here[context == u].sum() + nothing[u] - 1) < 1e-9
    parent = [x.parent(k, o).sum() + x.base() for x, k, o in zip(used, states[1::3], states[2::3])]
    assert np.allclose(parent, 1)


def test_seating_matches_one_by_one():
    """Mean and spread of the tables, at small and large counts, against seating one customer after the other."""
    rng = np.random.default_rng(1)
    for a, d, c in [(3.0, 0.5, 400), (0.2, 0.8, 2), (0.05, 0.3, 63), (40.0, 0.6, 130), (1e-9, 0.5, 50), (0.7, 0.05, 1)]:
        runs = 4000
        fast = pitman_yor.reseat(np.full(runs, c), np.full(runs, a), d, rng)
        slow = np.ones(runs)
        for j in range(1, c):
            slow += rng.random(runs) * (a + j - d * slow) < a
        assert abs(fast.mean() - slow.mean()) < 0.03 * slow.mean() and abs(fast.std() - slow.std()) < 0.1 * slow.std() + 0.02
        assert fast.min() >= 1 and fast.max() <= c


def test_seating_in_spans_and_batches(monkeypatch):
    """Whatever is seated at once, the customers' own numbers decide as one by one."""
    rng = np.random.default_rng(5)
    count, a = rng.integers(0, 60, 300), 10 ** rng.uniform(-3, 2, 300)
    monkeypatch.setattr(pitman_yor, "SPAN", 1 << 40)
    monkeypatch.setattr(pitman_yor, "SEATED", 1 << 40)
    got = pitman_yor.reseat(count, a, 0.7, np.random.default_rng(9))
    u = np.random.default_rng(9).random(int(np.maximum(count - 1, 0).sum()))
    want, k = [], 0
    for n, b in zip(count, a):
        t = min(n, 1)
        for j in range(1, n):
            t += u[k] * (b + j - 0.7 * t) < b
            k += 1
        want.append(t)
    assert got.tolist() == want
    for span, seated in ((7, 50), (1, 10), (100, 3)):
        monkeypatch.setattr(pitman_yor, "SPAN", span)
        monkeypatch.setattr(pitman_yor, "SEATED", seated)
        again = pitman_yor.reseat(count, a, 0.7, np.random.default_rng(9))
        assert (again >= np.minimum(count, 1)).all() and (again <= count).all() and abs(again.sum() - got.sum()) < 0.05 * got.sum()


class OneByOne:
    """The sampler that moves one customer at a time between explicit tables."""

    def __init__(self, seats, words, d, d0, rng):
        self.seats, self.words, self.d, self.d0, self.rng = seats, words, d, d0, rng
        self.tables, self.parent = {}, {}

    def base(self):
        return (1 + self.d0 * sum(map(len, self.parent.values()))) / (1 + sum(map(sum, self.parent.values()))) / (self.words + 1)

    def below(self, w):
        own = self.parent.get(w, [])
        return (sum(own) - self.d0 * len(own)) / (1 + sum(map(sum, self.parent.values()))) + self.base()

    def rest(self, u):
        own = [x for (c, _), x in self.tables.items() if c == u]
        return (1 + self.d * sum(map(len, own))) / (1 + sum(map(sum, own)))

    def p(self, u, w):
        own = self.tables.get((u, w), [])
        customers = sum(sum(x) for (c, _), x in self.tables.items() if c == u)
        return (sum(own) - self.d * len(own)) / (1 + customers) + self.rest(u) * self.below(w)

    def put(self, at, d, fresh):
        weights = [x - d for x in at] + [fresh]
        k = self.rng.choices(range(len(weights)), weights)[0]
        if k < len(at):
            at[k] += 1
        else:
            at.append(1)
        return k == len(weights) - 1

    def take(self, at):
        k = self.rng.choices(range(len(at)), at)[0]
        at[k] -= 1
        if not at[k]:
            del at[k]
            return True
        return False

    def sweep(self, first):
        for u, w in self.seats:
            if not first and self.take(self.tables[u, w]):
                self.take(self.parent[w])
            opens = (1 + self.d * sum(len(x) for (c, _), x in self.tables.items() if c == u)) * self.below(w)
            if self.put(self.tables.setdefault((u, w), []), self.d, opens):
                self.put(self.parent.setdefault(w, []), self.d0, (1 + self.d0 * sum(map(len, self.parent.values()))) / (self.words + 1))


def test_lm_mean_equals_one_by_one(spark):
    """The query's whole path on a tiny corpus against the mean of the sequential sampler."""
    import random

    rng, rows = random.Random(7), []
    for i in range(40):
        w = [rng.choice("abcdefgh")]
        while len(w) < 9:
            w.append(rng.choice([w[-1], chr(ord(w[-1]) % 8 + 97), rng.choice("abcdefgh")]))
        rows.append((i, " ".join(w), "en"))
    rows += [(100 + i, t, "en") for i, t in enumerate(["a b c", "h a never", "never", "q q q", "d e f g h"])]
    seats = [(u, w) for i, t, _ in rows if fold(i, 5) != 1 for u, w in zip([None] + tokens(t), tokens(t))]
    n = Counter(seats)
    share = lambda counts: min(0.95, max(0.05, counts[1] / max(1, counts[1] + 2 * counts[2])))
    d, d0 = share(Counter(n.values())), share(Counter(Counter(w for _, w in n).values()))
    sampler, sums, kept = OneByOne(seats, len({w for _, w in seats}), d, d0, rng), Counter(), 60
    asked = {(u, w) for _, t, _ in rows for u, w in zip([None] + tokens(t), tokens(t))}
    for sweep in range(20 + kept):
        sampler.sweep(sweep == 0)
        if sweep >= 20:
            sums.update({pair: sampler.p(*pair) / kept for pair in asked})
    got = {r.doc_id: r for r in pitman_yor.score_texts(frame(spark, rows)).collect()}
    for i, t, _ in rows:
        want = sum(math.log10(sums[u, w]) for u, w in zip([None] + tokens(t), tokens(t)))
        assert abs(got[i].score - want) / got[i].n_tokens < 0.05


def test_lm_keeps_ids_as_they_are(spark):
    docs = spark.createDataFrame([("a-1", "x y", 1), ("a-1", "x y", 2), (None, None, 3)], "doc_id string, text string, score int")
    got = pitman_yor.score_texts(docs).collect()
    assert sorted((r.doc_id or "", r.n_tokens) for r in got) == [("", 1), ("a-1", 3), ("a-1", 3)]


def test_lm_knows_word_order(spark):
    """Held-out texts score better than the same words shuffled, and a seen pair better than an unseen one."""
    rng = np.random.default_rng(3)
    follows = {w: rng.integers(0, 60, 2) for w in range(60)}
    held = (i for i in range(100_000, 200_000) if fold(i, 5) == 1)
    rows, pairs = [], []
    for i in range(300):
        words = [int(rng.integers(60))]
        while len(words) < 80:
            words.append(int(rng.choice(follows[words[-1]])))
        rows.append((i, " ".join(f"w{w}" for w in words), "en"))
        if fold(i, 5) == 1:
            pairs.append((i, next(held)))
            rows.append((pairs[-1][1], " ".join(f"w{w}" for w in rng.permutation(words)), "en"))
    seen, unseen = [(next(held), f"w0 w{w}", "en") for w in follows[0]], (next(held), "w0 never", "en")
    got = {r.doc_id: r.score for r in pitman_yor.score_texts(frame(spark, [*rows, *seen, unseen])).collect()}
    assert len(pairs) > 20 and all(got[a] > got[b] + 10 for a, b in pairs)
    assert got[unseen[0]] < min(got[i] for i, _, _ in seen)
