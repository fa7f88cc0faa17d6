"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, fixed by its code point. A trigram is bound by multiplying
its letters' vectors after rotating them by their place in the trigram, a text is the bundle (sum) of its
trigrams, and a language is the bundle of its training texts. A text gets the language whose prototype has
the largest cosine with it. Letters are lower-cased, and every run of other characters is one word mark.

Training is a sum of integer vectors per language, so Spark adds the partial bundles of all tasks exactly and
in any order. The prototypes (languages x ``DIM`` numbers) are what the tasks get back.

Defined results: null texts and texts without a letter are ``und`` with score 0, as is every text when
nothing was learnt; training rows with a null language or text teach nothing; equal cosines go to the first
language in code point order; score is the cosine, at least 0. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

DIM = 1024
SLICE_CHARS = 400_000
GRAMS = 4096  # different trigrams whose vectors are held at once
UNKNOWN = "und"


def letter_vector(code: int) -> np.ndarray:
    return (np.random.default_rng(code + 1).integers(0, 2, DIM) * 2 - 1).astype(np.int8)


class Encoder:
    """Bundles of texts."""

    def __init__(self):
        self.letters: dict[int, np.ndarray] = {}
        self.is_letter = np.zeros(0x110000, np.int8) - 1  # unknown until met

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        for c in codes.tolist():
            if c not in self.letters:
                self.letters[c] = letter_vector(c)
        return np.stack([self.letters[c] for c in codes.tolist()])

    def letters_of(self, text: str, after_mark: bool = False):
        """Code points with every run of other characters as one blank, which of the raw ones are letters, and which
        raw ones are kept; after a mark, leading others belong to that run."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        met = np.flatnonzero(np.bincount(codes, minlength=1))
        for c in met[self.is_letter[met] < 0].tolist():
            self.is_letter[c] = chr(c).isalpha()
        letter = self.is_letter[codes] == 1
        keep = letter | np.append(not after_mark, letter[:-1])  # the first of every run of other characters
        return np.where(letter, codes, 32), letter, keep

    def bundles(self, texts: list[str], rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Sum of the trigram vectors of each text, exact whole numbers, and which texts have a letter. Texts of one of
        ``rows`` are summed into that row. A long text is read in pieces that carry on the last two letters."""
        rows = np.arange(len(texts)) if rows is None else rows
        total, some = np.zeros((int(rows.max()) + 1 if len(rows) else 0, DIM)), np.zeros(len(texts), bool)
        if len(texts) == 1 and len(texts[0]) > SLICE_CHARS:
            low = f" {texts[0].lower()} "
            carry, after = np.zeros(0, np.int64), False
            for at in range(0, len(low), SLICE_CHARS):
                codes, letter, keep = self.letters_of(low[at : at + SLICE_CHARS], after)
                run = np.concatenate([carry, codes[keep]])
                self.add(total, run[:-2], run[1:-1], run[2:], np.full(max(0, len(run) - 2), rows[0]))
                carry, after, some[0] = run[-2:], not letter[-1], some[0] or letter.any()
            return total, some
        low = [f" {t.lower()} " for t in texts]
        codes, letter, keep = self.letters_of("".join(low))
        doc = np.repeat(np.arange(len(low)), [len(t) for t in low])
        keep |= np.append(True, doc[1:] != doc[:-1])
        some = np.bincount(doc[letter], minlength=len(low)) > 0
        codes, doc = codes[keep], doc[keep]
        inside = doc[:-2] == doc[2:]
        self.add(total, codes[:-2][inside], codes[1:-1][inside], codes[2:][inside], rows[doc[:-2][inside]])
        return total, some

    def add(self, total: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray, row: np.ndarray) -> None:
        """Add trigrams (a, b, c) to their rows, in blocks of different trigrams, so that memory does not grow with their
        number. A block's sums are below 2 ** 24 and thus exact in single precision."""
        if not len(a):
            return
        alphabet = np.flatnonzero(np.bincount(np.concatenate([a, b[-1:], c[-1:]])))
        small = np.zeros(int(alphabet[-1]) + 1, np.int64)
        small[alphabet] = np.arange(len(alphabet))
        k, v = len(alphabet), self.vectors(alphabet)
        gram = (small[a] * k + small[b]) * k + small[c]
        grams, at = np.unique(gram, return_inverse=True) if k**3 > 5_000_000 else self.dense(gram, k**3)
        if len(grams) <= GRAMS:
            blocks = [(0, slice(None))]
        else:
            order = np.argsort(at, kind="stable")
            at, row = at[order], row[order]
            edges = np.searchsorted(at, range(0, len(grams) + GRAMS, GRAMS))
            blocks = [(i * GRAMS, slice(lo, hi)) for i, (lo, hi) in enumerate(zip(edges, edges[1:]))]
        for first, part in blocks:
            own = grams[first : first + GRAMS]
            bound = np.roll(v, 2, axis=1)[own // (k * k)] * np.roll(v, 1, axis=1)[own // k % k] * v[own % k]
            counts = np.bincount(row[part] * len(own) + at[part] - first, minlength=len(total) * len(own))
            total += counts.reshape(len(total), len(own)).astype(np.float32) @ bound.astype(np.float32)

    @staticmethod
    def dense(gram: np.ndarray, size: int):
        met = np.flatnonzero(np.bincount(gram, minlength=size))
        place = np.zeros(size, np.int32)
        place[met] = np.arange(len(met))
        return met, place[gram]


def slices(texts: list, most: int = SLICE_CHARS):
    """Ranges of texts of about ``most`` characters; a longer text is a range of its own."""
    lo = 0
    while lo < len(texts):
        hi, chars = lo, 0
        while hi < len(texts) and hi - lo < 256 and (hi == lo or chars + len(texts[hi]) <= most):
            chars += len(texts[hi])
            hi += 1
        yield lo, hi
        lo = hi


def prototypes(docs: DataFrame) -> dict[str, np.ndarray]:
    """Language -> bundle of all its training texts (columns text and lang)."""

    def bundle(batches):
        import pyarrow as pa

        enc, sums = Encoder(), {}
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for lo, hi in slices(texts):
                own, rows = np.unique(np.array(langs[lo:hi], object), return_inverse=True)
                total, _ = enc.bundles(texts[lo:hi], rows)
                for lang, v in zip(own.tolist(), total):
                    sums[lang] = sums.get(lang, 0) + v.astype(np.int64)
        names = sorted(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([sums[n].tolist() for n in names], pa.list_(pa.int64()))], ["lang", "v"]
        )

    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    parts = known.mapInArrow(bundle, "lang string, v array<bigint>")
    totals = parts.select("lang", F.posexplode("v")).groupBy("lang", "pos").agg(F.sum("col").alias("s"))
    out: dict[str, np.ndarray] = {}
    for r in totals.collect():  # languages x DIM rows
        out.setdefault(r.lang, np.zeros(DIM))[r.pos] = r.s
    return out


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], keep: list[str]) -> DataFrame:
    """``keep`` columns of every row with lang_pred and score."""
    names = sorted(n for n, v in profiles.items() if np.any(v))
    unit = np.stack([profiles[n] / np.linalg.norm(profiles[n]) for n in names], axis=1) if names else np.zeros((DIM, 0))

    def predict(batches):
        import pyarrow as pa

        enc = Encoder()
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            langs, scores = [], []
            for lo, hi in slices(texts):
                vec, some = enc.bundles(texts[lo:hi])
                size = np.linalg.norm(vec, axis=1)
                cos = (vec @ unit) / np.maximum(size, 1e-9)[:, None]
                for i in range(hi - lo):
                    best = int(cos[i].argmax()) if names and some[i] else -1
                    langs.append(names[best] if best >= 0 else UNKNOWN)
                    scores.append(float(min(1.0, max(0.0, cos[i, best]))) if best >= 0 else 0.0)
            kept = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"]
            )

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", lang_pred string, score double"
    return docs.select(*keep, "text").mapInArrow(predict, schema)
