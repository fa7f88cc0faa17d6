"""Near duplicates of texts and vectors, components, decontamination and URLs against brute force."""

import numpy as np
import pytest

from flowhorizon.llm import components, decontamination, order_minhash, pivots, queries, urls
from flowhorizon.llm.common import plain_words


def find(parent, x):
    while parent.get(x, x) != x:
        x = parent[x]
    return x


def joined(pairs):
    parent = {}
    for a, b in pairs:
        x, y = find(parent, a), find(parent, b)
        parent[max(x, y)] = min(x, y)
    return parent


def test_components(spark):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, 2000 + i) for i in range(300)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = joined(links)
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: find(parent, x) for x in nodes}


# ---- texts ----


def texts():
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for k in range(60):
        base = rng.choice(words, rng.integers(8, 200)).tolist()
        rows.append(" ".join(base))
        for _ in range(int(rng.integers(0, 5))):
            copy = list(base)
            for _ in range(int(rng.integers(0, 1 + len(copy) // 40))):
                at, kind = int(rng.integers(len(copy))), rng.integers(3)
                if kind == 0:
                    copy[at] = str(rng.choice(words))
                elif kind == 1:
                    copy.insert(at, str(rng.choice(words)))
                elif len(copy) > 6:
                    del copy[at]
            rows.append(" ".join(copy))
    group = rng.choice(words, 150).tolist()  # a large group around one text, whose members differ among themselves
    for i in range(250):
        copy = list(group)
        copy[int(rng.integers(150))] = f"x{i}"
        copy[int(rng.integers(150))] = f"y{i}"
        rows.append(" ".join(copy))
    rows += ["same text here"] * 40 + ["Same, TEXT here!", "same text", "", None, "  ", "!!", "a b c d e", "a b c d e f"]
    rows.append(" ".join(rng.choice(words, 20_000)))
    return [(i, t, "z", 1) for i, t in enumerate(rows)]


def plain(t):
    import re

    return re.sub(r"[^a-z0-9]+", " ", (t or "").lower()).strip()


def test_near_classes_equal_brute_force(spark):
    rows = texts()
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, words string, h int")
    own = {i: plain(t) for i, t, *_ in rows}
    shingles = {i: order_minhash.shingles(t) for i, t in own.items() if t}
    holders = {}
    for i, s in shingles.items():
        for x in set(s):
            holders.setdefault(x, []).append(i)
    candidates = {(a, b) for v in holders.values() for b in v for a in v if a < b}
    near = [(a, b) for a, b in candidates if order_minhash.alignment(shingles[a], shingles[b]) >= 0.8]
    parent = joined(near)
    got = {r.id: r.class_id for r in order_minhash.near_classes(docs).collect()}
    assert len(got) == len(rows)
    assert got == {i: find(parent, i) if own[i] else i for i in own}
    kept = order_minhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in got if got[i] == i)


def test_near_classes_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert order_minhash.near_classes(docs).count() == 0
    assert order_minhash.drop_near_copies(docs).count() == 0


def test_alignment_equals_dynamic_programming():
    rng = np.random.default_rng(7)
    for _ in range(300):
        a = rng.integers(0, 30, rng.integers(1, 60)).tolist()
        b = list(a)
        for _ in range(int(rng.integers(0, 8))):
            at = int(rng.integers(len(b)))
            b[at : at + int(rng.integers(0, 2))] = rng.integers(0, 30, int(rng.integers(0, 2))).tolist()
            b = b or [1]
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        want = row[-1] / (len(a) + len(b) - row[-1])
        got = order_minhash.alignment(a, b)
        assert (got >= 0.8) == (want >= 0.8 - 1e-12)
        if want >= 0.8:
            assert abs(got - want) < 1e-12


# ---- vectors ----


@pytest.mark.parametrize("block", [1024, 16])
def test_vectors_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(pivots, "BLOCK", block)
    rng = np.random.default_rng(9)
    rows = []
    for _ in range(40):
        c = rng.standard_normal(32)
        for _ in range(int(rng.integers(1, 12))):
            rows.append(((c + 0.08 * rng.standard_normal(32)).tolist(), int(rng.integers(0, 2))))
    rows += [(rows[0][0], rows[0][1])] * 30
    rows += [(None, 1), ([], 1), ([0.0] * 32, 1), ([float("nan")] + [1.0] * 31, 1), ([None] + [1.0] * 31, 0), (rows[3][0], None), ([1.0, 2.0], 0), ([2.0, 4.0], 0), ([1e30] * 32, 1), ([1e-30] * 32, 1)]
    df = spark.createDataFrame([(i, v, y, 1, "x") for i, (v, y) in enumerate(rows)], "vec_id long, embedding array<double>, label int, copies int, node string")
    ok = [i for i, (v, y) in enumerate(rows) if y is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    pairs = []
    for k, a in enumerate(ok):
        for b in ok[k + 1 :]:
            (u, lu), (w, lw) = rows[a], rows[b]
            if lu == lw and len(u) == len(w):
                u, w = np.array(u) / max(np.abs(u)), np.array(w) / max(np.abs(w))
                if u @ w / np.sqrt((u @ u) * (w @ w)) >= 0.98:
                    pairs.append((a, b))
    parent = joined(pairs)
    n = np.bincount(np.array(pairs).ravel(), minlength=len(rows))
    got = {r.vec_id: r for r in pivots.near_vectors(df).collect()}
    assert len(got) == len(rows) and len(pairs) > 300
    missed = sum(int(n[i]) - got[i].n_links for i in got)
    assert 0 <= missed <= 0.02 * len(pairs) * 2
    if not missed:
        assert all(got[i].component_id == find(parent, i) and got[i].kept == (find(parent, i) == i) for i in got)


def test_vectors_of_an_empty_table(spark):
    assert pivots.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


# ---- benchmark ----


def distance_to_best_passage(item, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item):
        new = [i + 1]
        for j, y in enumerate(text):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_passages_equal_brute_force(spark):
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(words, rng.integers(1, 40)))) for i in range(25)] + [(25, None), (26, ""), (27, "..."), (28, "w1 w2 w3"), (29, "w1 w2 w3")]
    rows = []
    for i in range(150):
        text = rng.choice(words, rng.integers(0, 80)).tolist()
        if i % 2:
            passage = items[int(rng.integers(25))][1].split()
            for _ in range(int(rng.integers(0, 1 + len(passage) // 3))):
                at = int(rng.integers(len(passage))) if passage else 0
                passage[at : at + int(rng.integers(0, 2))] = rng.choice(words, int(rng.integers(0, 2))).tolist()
            at = int(rng.integers(len(text) + 1))
            text[at:at] = passage
        rows.append((i, " ".join(text).upper() + ".", 1, "x"))
    rows += [(500, None, 1, "x"), (501, "", 1, "x"), (502, "w1, w2; W3", 1, "x"), (502, "w1, w2; W3", 1, "x"), (503, "q " * 50_000, 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int, distance string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.passages(docs, bench).collect()
    want = []
    for i, t, *_ in rows:
        text = plain(t).split()
        for k, item in items:
            item = plain(item).split()
            if item and (d := distance_to_best_passage(item, text)) <= decontamination.budget(len(item), 0.8):
                want.append((i, k, d))
    assert sorted((r.doc_id, r.item_id, r.distance) for r in got) == sorted(want) and len(want) > 60
    hit = {i for i, _, _ in want}
    clean = decontamination.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, *_ in rows if i not in hit)


def test_blocks_of_items_change_nothing(spark, monkeypatch):
    rows = [(i, f"a{i} b{i} c{i} d{i} e{i} f{i}") for i in range(60)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(rows, "item_id long, text string")
    monkeypatch.setattr(decontamination.blocks, "__defaults__", (40,))
    assert len(list(decontamination.blocks(decontamination.known_items(bench, "item_id", "text")))) > 3
    got = decontamination.passages(docs, bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(i, i) for i in range(60)]
    assert decontamination.drop_contaminated(docs, bench).count() == 0


def test_repeated_items_are_matched_once(spark):
    """Equal items are one pattern, and still one row each."""
    docs = spark.createDataFrame([(1, "x a b c d e f y"), (2, "nothing here")], "doc_id long, text string")
    bench = spark.createDataFrame([(i % 3, "A b, c d e f!") for i in range(300)] + [(9, None)], "item_id long, text string")
    assert [len(b) for b in decontamination.blocks(decontamination.known_items(bench, "item_id", "text"))] == [1]
    got = decontamination.passages(docs, bench).groupBy("doc_id", "item_id").count().collect()
    assert {(r.doc_id, r.item_id): r["count"] for r in got} == {(1, i): 100 for i in range(3)}


def test_passages_without_a_benchmark(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.passages(docs, bench).count() == 0
    assert decontamination.drop_contaminated(docs, bench).count() == 1


# ---- urls ----

RULES = queries.URL_RULES


def rule_of(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host) :]
    for c in "?#":
        path = path.split(c)[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fits, key=len) if fits else None


URLS = [None, "", "no scheme", "http://", "http://A.Example.NET/en/x?y=/de/#z", "https://example.com/de/1", "x://example.comx/de/", "http://net", "http://net/", "http://foo.net?x/",
        "http://a.org/fr/b#c", "HTTP://b.example.net/EN/", "http://ÄÖ.net/ü", "a://b://c.net/", "http://x.net/" + "p" * 60_000, "http://\n.net/"]


def test_urls(spark):
    rows = [(i, u, "r") for i, u in enumerate(URLS)] + [(4, URLS[4], "r"), (None, "http://q.org/de/", "r")]
    rows += [(100 + i, f"http://good{i}.org/fr/{i}", "r") for i in range(60)] + [(300 + i, f"http://bad-casino{i}.net/win", "r") for i in range(60)]
    rows += [(600, "http://bad-casino.com/win", "r"), (601, "http://good.com/fr/1", "r")]
    got = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string, rule string"), RULES).collect()
    assert len(got) == len(rows)
    by_id = {i: u for i, u, _ in rows}
    for r in got:
        host, path, rule = rule_of(by_id[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == RULES[rule] if rule else r.verdict in ("allow", "block")
    assert {r.page_id: r.verdict for r in got if r.page_id in (600, 601)} == {600: "block", 601: "allow"}
    empty = urls.filter_urls(spark.createDataFrame([], "page_id long, url string"), RULES)
    assert empty.count() == 0


def test_url_likelihood_matches_counting():
    train, text = ["ab/0", "abc/0", "b"], "abq"
    model = urls.Model(counted(train))
    slots, owner, real = urls.gram_slots([text])
    got = model.log_likelihood(slots, real).sum()
    pad, want = "\x02" * urls.ORDER, 0.0
    full = [pad + u + "\x03" for u in train]
    for i, x in enumerate(text + "\x03"):
        seen, p = pad + text[:i], 1 / 256
        for n in range(1, urls.ORDER + 1):
            context = seen[len(seen) - n + 1 :]
            spots = [(s, j) for s in full for j in range(urls.ORDER, len(s)) if s[j - n + 1 : j] == context]
            p = (sum(s[j] == x for s, j in spots) + urls.BLEND * p) / (len(spots) + urls.BLEND)
        want += np.log(p)
    assert abs(got - want) < 1e-9


def counted(train):
    sums = np.zeros((urls.ORDER + 1, 1 << urls.SLOTS), np.int64)
    slots, _, real = urls.gram_slots(train)
    sums[0, 0] = real.sum()
    start = np.append(real[1:] & ~real[:-1], False)
    for n in range(1, urls.ORDER + 1):
        sums[n] = np.bincount(slots[n][real], minlength=1 << urls.SLOTS) + np.bincount(slots[n][start], minlength=1 << urls.SLOTS)
    return sums


def test_plain_words(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("Ça va?!  ÉTÉ_1",), (None,)], "t string").select(plain_words(F.col("t")).alias("p"))
    assert [r.p for r in rows.collect()] == ["ça va été 1", ""]
