"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as its own embedding (words of the training windows) joined with its character vector (any
word): mean embeddings of its hashed character trigrams and of its hashed beginnings. A forward and a backward GRU read a window of ``WINDOW`` words,
attention pools their states, and a logistic output scores the window. Whole documents are cut into
overlapping windows, every one of them is scored, and the document takes its highest window, mapped to a
probability by a logistic fit on the training documents.

The network is fitted on the driver from a bounded sample: at most ``SAMPLE`` labelled documents of the
learning folds and two windows of each (the one whose words speak most for the label, and a seeded other).
Everything else runs over all rows, in tasks that hold one slice of documents at a time.

Defined results: null and empty texts are scored as a window without words; repeated rows get equal
scores; rows of ``labels`` with a null label or id teach nothing, of several labels of one id the highest counts and of
several texts the first in order; words of equal weight come in order; a text of any length is cut into windows
like the others; without any label every score is 0.5; an empty table gives an empty result. Other columns of the input are not looked at.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import fold, stored

WINDOW, STRIDE = 32, 16
SAMPLE = 6000
HIDDEN, WORD_DIM, CHAR_DIM, TRIGRAMS = 12, 12, 12, 1 << 15
PREFIXES = (3, 4, 5)
SLICE_CHARS = 600_000
UNNAMED, DECAY = 0.3, 0.02
PIECES = str.maketrans({c: " " for c in ".,;:!?\"()[]{}"})


def words_of(text) -> list[str]:
    return text.lower().translate(PIECES).split() if text else []


def starts(n: int) -> range:
    """First words of the overlapping windows of a text of ``n`` words; they cover all of it."""
    return range(0, max(1, n - (WINDOW - STRIDE)), STRIDE)


def char_rows(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed character trigrams of all words with boundary marks, where each word's begin, and its hashed beginnings."""
    marked = "".join(f"\x02{w}\x03" for w in words)
    c = np.frombuffer(marked.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    lengths = np.fromiter((len(w) for w in words), np.int64, len(words))
    first = np.concatenate(([0], np.cumsum(lengths + 2)[:-1]))
    h = (c[:-2] * 7919 + c[1:-1]) * 7919 + c[2:]
    inside = np.ones(len(h) + 2, bool)
    inside[first + lengths] = inside[first + lengths + 1] = False
    spread = lambda x: ((x * 2654435761) >> 11) % TRIGRAMS
    starts, run = [], np.zeros(len(words), np.int64)
    for k in range(PREFIXES[-1] + 1):
        run = (run * 104729 + c[first + np.minimum(k, lengths + 1)]) & 0x3FFFFFFF
        if k in PREFIXES:
            starts.append(spread(run + k))
    return spread(h)[inside[: len(h)]], np.concatenate(([0], np.cumsum(lengths)[:-1])), np.stack(starts, axis=1)


def char_vectors(words: list[str], table: np.ndarray, beginnings: np.ndarray) -> np.ndarray:
    rows, first, starts = char_rows(words)
    lengths = np.diff(np.append(first, len(rows)))
    mean = np.add.reduceat(table[rows], first, axis=0) / lengths[:, None].astype(np.float32)
    return mean + beginnings[starts].mean(axis=1)


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class Net:
    """Parameters, forward pass, and gradients of one batch of windows."""

    def __init__(self, vocabulary: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        init = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.index = {w: i + 1 for i, w in enumerate(vocabulary)}
        dim = WORD_DIM + CHAR_DIM
        self.p = {
            "word": (rng.standard_normal((len(vocabulary) + 1, WORD_DIM)) * 0.05).astype(np.float32),
            "char": (rng.standard_normal((TRIGRAMS, CHAR_DIM)) * 0.05).astype(np.float32),
            "start": (rng.standard_normal((TRIGRAMS, CHAR_DIM)) * 0.05).astype(np.float32),
            "v": np.zeros(2 * HIDDEN, np.float32), "w": init(2 * HIDDEN), "b": np.zeros(1, np.float32),
        }
        for d in "fb":
            self.p |= {f"W{d}": init(dim, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32), f"U{d}": init(HIDDEN, 3 * HIDDEN)}
        self.p["word"][0] = 0

    @classmethod
    def of(cls, index: dict, parameters: dict) -> "Net":
        """Network of stored parts; only such plain parts are broadcast, so workers need no installed package."""
        net = cls.__new__(cls)
        net.index, net.p = index, parameters
        return net

    def inputs(self, words: list[str], unnamed=None) -> tuple[np.ndarray, np.ndarray]:
        ids = np.fromiter((self.index.get(w, 0) for w in words), np.int64, len(words))
        if unnamed is not None:
            ids[unnamed] = 0
        return np.concatenate([self.p["word"][ids], char_vectors(words, self.p["char"], self.p["start"])], axis=1), ids

    def gates(self, words: list[str]) -> np.ndarray:
        """Input side of all gates of both directions, per word: computed once, used at every occurrence."""
        x, _ = self.inputs(words)
        return np.concatenate([x @ self.p[f"W{d}"] + self.p[f"c{d}"] for d in "fb"], axis=1).astype(np.float32)

    def run(self, g: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Window logits; ``g`` is time x windows x gates, ``mask`` time x windows."""
        T, N, H = *mask.shape, HIDDEN
        states, tape = np.empty((T, N, 2 * H), np.float32), {}
        for k, d in enumerate("fb"):
            h, U, at = np.zeros((N, H), np.float32), self.p[f"U{d}"], k * 3 * H
            for t in range(T) if d == "f" else range(T - 1, -1, -1):
                gh, gi = h @ U, g[t, :, at : at + 3 * H]
                rz = gi[:, : 2 * H] + gh[:, : 2 * H]
                np.negative(rz, out=rz)
                np.exp(np.minimum(rz, 30, out=rz), out=rz)
                rz += 1
                np.reciprocal(rz, out=rz)
                n = np.tanh(gi[:, 2 * H :] + rz[:, :H] * gh[:, 2 * H :])
                new = n + rz[:, H:] * (h - n)
                m = mask[t][:, None]
                new = new if m.all() else np.where(m, new, h)
                if keep:
                    tape[d, t] = (h, rz, n, gh[:, 2 * H :])
                h = states[t, :, k * H : (k + 1) * H] = new
        e = np.where(mask, states @ self.p["v"], np.float32(-1e9))
        a = np.exp(e - e.max(axis=0)) * mask
        a /= np.maximum(a.sum(axis=0), 1e-9)
        pooled = np.einsum("tn,tnh->nh", a, states)
        logit = pooled @ self.p["w"] + self.p["b"][0]
        return (logit, states, tape, a, pooled) if keep else logit

    def gradients(self, words: list[str], at: np.ndarray, mask: np.ndarray, y: np.ndarray, unnamed=None) -> dict:
        H, p = HIDDEN, self.p
        x, ids = self.inputs(words, unnamed)
        gates = np.concatenate([x @ p[f"W{d}"] + p[f"c{d}"] for d in "fb"], axis=1)
        g = gates[at]
        logit, states, tape, a, pooled = self.run(g, mask, keep=True)
        dl = ((sigmoid(logit) - y) / len(y)).astype(np.float32)
        out = {"w": pooled.T @ dl, "b": np.array([dl.sum()], np.float32)}
        dpool = dl[:, None] * p["w"]
        da = np.einsum("tnh,nh->tn", states, dpool)
        de = a * (da - (a * da).sum(axis=0))
        out["v"] = np.einsum("tn,tnh->h", de, states)
        ds = a[:, :, None] * dpool + de[:, :, None] * p["v"]
        dg = np.zeros_like(g)
        for k, d in enumerate("fb"):
            U, dU, dh, T = p[f"U{d}"], np.zeros_like(p[f"U{d}"]), np.zeros((len(y), H), np.float32), len(mask)
            for t in range(T - 1, -1, -1) if d == "f" else range(T):
                h, rz, n, ghn = tape[d, t]
                m = mask[t][:, None]
                dh = dh + ds[t, :, k * H : (k + 1) * H]
                own = dh * m
                r, z = rz[:, :H], rz[:, H:]
                dn = own * (1 - z) * (1 - n * n)
                dz = own * (h - n) * z * (1 - z)
                dr = dn * ghn * r * (1 - r)
                dg[t, :, k * 3 * H : (k + 1) * 3 * H] = np.concatenate([dr, dz, dn], axis=1)
                dgh = np.concatenate([dr, dz, dn * r], axis=1)
                dU += h.T @ dgh
                dh = dh * (1 - m) + own * z + dgh @ U.T
            out[f"U{d}"] = dU
        flat = np.zeros((len(words), 6 * H), np.float32)
        np.add.at(flat, at.ravel(), dg.reshape(-1, 6 * H))
        dx = np.zeros_like(x)
        for k, d in enumerate("fb"):
            part = flat[:, k * 3 * H : (k + 1) * 3 * H]
            out[f"W{d}"], out[f"c{d}"] = x.T @ part, part.sum(axis=0)
            dx += part @ p[f"W{d}"].T
        for k in ("word", "char", "start"):
            out[k] = np.zeros_like(p[k])
        np.add.at(out["word"], ids, dx[:, :WORD_DIM])
        out["word"][0] = 0
        rows, first, starts = char_rows(words)
        lengths = np.diff(np.append(first, len(rows)))
        np.add.at(out["char"], rows, np.repeat(dx[:, WORD_DIM:] / lengths[:, None], lengths, axis=0))
        np.add.at(out["start"], starts, np.repeat(dx[:, None, WORD_DIM:] / len(PREFIXES), len(PREFIXES), axis=1))
        return out


def fit(windows: list[list[str]], labels: list[int], epochs: int = 5, batch: int = 64, rate: float = 0.008, seed: int = 5) -> Net:
    """Adam on the cross-entropy of the windows, with weight decay; words lose their own embedding at random, so that characters count."""
    seen: dict[str, int] = {}
    for words in windows:
        for w in set(words):
            seen[w] = seen.get(w, 0) + 1
    net = Net(sorted(w for w, n in seen.items() if n >= 8), seed)
    m, v = ({k: np.zeros_like(a) for k, a in net.p.items()} for _ in range(2))
    step = 0
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for lo in range(0, len(order), batch):
            part = order[lo : lo + batch]
            index: dict[str, int] = {"": 0}
            at, mask = np.zeros((WINDOW, len(part)), np.int64), np.zeros((WINDOW, len(part)), bool)
            for j, i in enumerate(part):
                for t, w in enumerate(windows[i][:WINDOW]):
                    at[t, j], mask[t, j] = index.setdefault(w, len(index)), True
            words = [w or "\x04" for w in index]
            grad = net.gradients(words, at, mask, y[part], rng.random(len(words)) < UNNAMED)
            step += 1
            for k, g in grad.items():
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                net.p[k] *= 1 - rate * DECAY
                net.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)
    return net


class Scorer:
    """Highest window logit of whole texts. Gate inputs of words seen are kept, up to ``room`` words."""

    def __init__(self, net: Net, room: int = 80_000):
        self.net, self.room = net, room
        self.clear()

    def clear(self):
        self.index, self.table, self.used = {"\x04": 0}, np.zeros((1024, 6 * HIDDEN), np.float32), 1
        self.table[:1] = self.net.gates(["\x04"])

    def rows(self, words: list[str]) -> np.ndarray:
        if len(self.index) > self.room:
            self.clear()
        index = self.index
        new = [w for w in set(words) if w not in index]
        if new:
            need = self.used + len(new)
            if need > len(self.table):
                self.table = np.concatenate([self.table, np.zeros((max(need, len(self.table)), 6 * HIDDEN), np.float32)])
            self.table[self.used : need] = self.net.gates(new)
            index.update(zip(new, range(self.used, need)))
            self.used = need
        return np.fromiter((index[w] for w in words), np.int64, len(words))

    def __call__(self, texts: list) -> np.ndarray:
        out = np.empty(len(texts))
        lo = 0
        while lo < len(texts):
            hi, chars = lo, 0
            while hi < len(texts) and (hi == lo or chars + len(texts[hi] or "") <= SLICE_CHARS):
                chars += len(texts[hi] or "")
                hi += 1
            out[lo:hi] = self.slice(texts[lo:hi])
            lo = hi
        return out

    def slice(self, texts: list, windows: int = 2048) -> np.ndarray:
        split = [words_of(t) for t in texts]
        ids = np.append(self.rows([w for words in split for w in words]), np.zeros(WINDOW, np.int64))
        first, left, doc, base = [], [], [], 0
        for k, words in enumerate(split):
            for s in starts(len(words)):
                first.append(base + s)
                left.append(len(words) - s)
                doc.append(k)
            base += len(words)
        first, left, doc = np.array(first), np.array(left), np.array(doc)
        logits = np.empty(len(first), np.float32)
        steps = np.arange(WINDOW)[:, None]
        for lo in range(0, len(first), windows):
            part = slice(lo, lo + windows)
            mask = steps < left[None, part]
            at = np.where(mask, ids[np.minimum(first[None, part] + steps, len(ids) - 1)], 0)
            logits[part] = self.net.run(self.table[at], mask)
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, doc, logits)
        return best


def telling_words(docs: DataFrame, limit: int = 400) -> dict[str, float]:
    """Words and beginnings of words that stand in more documents with label 1 than chance allows (a bounded list)."""
    words = F.split(F.lower(F.translate("text", ".,;:!?\"()[]{}", " " * 13)), r"\s+")
    parts = [F.transform(words, lambda w, n=n: F.concat(F.substring(w, 1, n), F.lit("*"))) for n in PREFIXES]
    marks = F.array_distinct(F.concat(words, *parts))
    counts = docs.select("toxic", F.explode(marks).alias("w")).groupBy("w").agg(
        F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("n")
    )
    total = docs.agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("n")).first()
    if not total or not total.p or not total.n:
        return {}
    rate = total.p / (total.p + total.n)
    expected = (F.col("p") + F.col("n")) * rate
    z = (F.col("p") - expected) / F.sqrt(expected * (1 - rate) + 0.5)
    top = counts.filter((F.col("p") >= 3) & (F.col("w") != "")).withColumn("z", z)
    return {r.w: r.z for r in top.filter("z > 3").orderBy(F.desc("z"), "w").limit(limit).collect()}


def training_windows(docs: DataFrame, odds: dict[str, float]) -> tuple[list[list[str]], list[int]]:
    """Two windows per sampled document, chosen in the tasks."""

    def pick(batches):
        import zlib

        import pandas as pd

        for pdf in batches:
            rows = []
            for i, text, toxic in zip(pdf["doc_id"], pdf["text"], pdf["toxic"]):
                words = words_of(text)
                at = list(starts(len(words)))
                worth = {w: max(odds.get(m, 0.0) for m in (w, *(f"{w[:n]}*" for n in PREFIXES))) for w in set(words)}
                gain = [sum(worth[w] for w in set(words[s : s + WINDOW])) for s in at]
                best = max(range(len(at)), key=gain.__getitem__)
                for k in {best, zlib.crc32(i.encode()) % len(at)} if not toxic else {best}:
                    rows.append((i, k, " ".join(words[at[k] : at[k] + WINDOW]), int(toxic)))
            yield pd.DataFrame(rows, columns=["doc_id", "k", "words", "toxic"])

    got = docs.select("doc_id", "text", "toxic").mapInPandas(pick, "doc_id string, k int, words string, toxic int")
    rows = sorted((r.doc_id, r.k, r.words, r.toxic) for r in got.collect())
    return [r[2].split() for r in rows], [r[3] for r in rows]


def scored(docs: DataFrame, net: Net, a: float, b: float, extra: list[str] = ()) -> DataFrame:
    """Rows of doc_id, ``extra`` columns, score."""
    packed = docs.sparkSession.sparkContext.broadcast((net.index, net.p, a, b))

    def score(batches):
        import pyarrow as pa

        index, parameters, a, b = packed.value
        run = Scorer(Net.of(index, parameters))
        for batch in batches:
            logit = run(batch.column("text").to_pylist())
            kept = [batch.column(c) for c in batch.schema.names if c != "text"]
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sigmoid(a * logit + b))], [*names, "score"])

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in ["doc_id", *extra]) + ", score double"
    return docs.select("doc_id", *extra, "text").mapInArrow(score, schema)


def platt(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Logistic fit of the label on the document logit, by damped Newton steps with a slight pull to slope 1."""
    loss = lambda t: np.logaddexp(0, t[0] * x + t[1]).sum() - (y * (t[0] * x + t[1])).sum() + 0.05 * (t[0] - 1) ** 2
    at = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = sigmoid(at[0] * x + at[1])
        w = p * (1 - p)
        g = np.array([((p - y) * x).sum() + 0.1 * (at[0] - 1), (p - y).sum()])
        h = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
        step, now = np.linalg.solve(h, g), loss(at)
        while loss(at - step) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        at = at - step
    a, b = at
    return max(float(a), 1e-3), float(b)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = 4, held: int = 2) -> tuple[Net, float, float]:
    """Network and calibration from at most ``sample`` labelled documents of the learning folds."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max(F.col("toxic").cast("int")).alias("toxic")
    )
    drawn = known.filter(fold(F.col("doc_id"), folds) != held).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # at most ``sample`` ids, so the hint has a fixed bound
    learn = own.join(F.broadcast(drawn), "doc_id").groupBy(F.col("doc_id").cast("string").alias("doc_id"))
    # of several texts of one id the first in order teaches, in every run
    learn = stored(learn.agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")), "toxicity-sample")
    # a fifth of the sample only calibrates, so that what the network learnt by heart does not count
    rest = F.xxhash64(F.lit("calibrate"), "doc_id") % 5 == 0
    windows, y = training_windows(learn.filter(~rest), telling_words(learn.filter(~rest)))
    if len(set(y)) < 2:
        return Net([]), 0.0, 0.0
    net = fit(windows, y)
    rows = sorted((r.doc_id, r.toxic, r.score) for r in scored(learn.filter(rest), net, 1.0, 0.0, ["toxic"]).collect())
    p = np.clip(np.array([r[2] for r in rows]), 1e-9, 1 - 1e-9)
    a, b = platt(np.log(p / (1 - p)), np.array([r[1] for r in rows], float))
    return net, a, b


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """doc_id, score, predicted for every row of ``docs``."""
    net, a, b = train(docs, labels, **options)
    out = scored(docs.select("doc_id", "text"), net, a, b)
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """Documents scored below the threshold, with all their columns."""
    net, a, b = train(docs, labels, **options)
    packed = docs.sparkSession.sparkContext.broadcast((net.index, net.p, a, b))

    def keep(batches):
        import pyarrow as pa

        index, parameters, a, b = packed.value
        run = Scorer(Net.of(index, parameters))
        for batch in batches:
            logit = run(batch.column("text").to_pylist())
            yield batch.filter(pa.array(sigmoid(a * logit + b) < threshold))

    return docs.mapInArrow(keep, docs.schema)
