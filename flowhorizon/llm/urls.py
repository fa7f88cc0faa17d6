"""URL filter: rules first, then the likelihood ratio of two character models.

Rules name a host and a path prefix; a rule fits its host and all subdomains, and the longest fitting rule
decides. What rules decide is also what the models learn from: one variable-order Markov model of accepted
and one of rejected URLs. A model predicts a character from its longest context seen so far, blended
order by order with the shorter ones, ``(count + BLEND * shorter) / (context + BLEND)``. The mean
log-likelihood difference per character is compared with a threshold calibrated on a fifth of the decided
URLs (by hash of the URL) that the counts leave out: the one with the best balanced accuracy.

Counts live in ``1 << SLOTS`` hashed slots per order, whatever the corpus, so the model that goes to the
tasks has a fixed size. All decided URLs are counted.

Defined results: a null URL or one without ``://`` has an empty host and path; URLs that no rule decides are
allowed when only one side, or neither, has examples; repeated rows get equal verdicts; equal to the
threshold counts as allowed. Digits count as one character and letters are lower-cased for the models.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

ORDER, SLOTS, BLEND, BINS = 6, 18, 2.0, 0.01
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(after_scheme(F.coalesce(url, F.lit(""))), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(F.coalesce(url, F.lit(""))), r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """Longest rule that fits, else null. ``rules`` maps ``host/path`` to ``allow`` or ``block``."""
    choice = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        choice = F.when(fits, rule).otherwise(choice)
    return choice


def verdict_of(rule: Column, rules: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for r, verdict in rules.items():
        out = F.when(rule == r, verdict).otherwise(out)
    return out


def judge_by_rules(pages: DataFrame, id_col: str, url: str, rules: dict[str, str]) -> DataFrame:
    """id, _url (what the models read), host, path, rule, verdict (null where no rule fits)."""
    text = F.regexp_replace(F.lower(after_scheme(F.coalesce(F.col(url), F.lit("")))), "[0-9]", "0")
    out = pages.select(F.col(id_col), text.alias("_url"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    out = out.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    return out.withColumn("verdict", verdict_of(F.col("rule"), rules))


def gram_slots(urls: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Slots of the grams of orders 0..ORDER that end at every character, owner of the character, and a mask of
    positions to predict (every character of a URL and the mark of its end)."""
    marked = "".join("\x02" * ORDER + u + "\x03" for u in urls)
    c = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    lengths = np.array([len(u) + ORDER + 1 for u in urls], np.int64)
    first = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(urls)), lengths)
    real = np.arange(len(c)) - first[owner] >= ORDER
    slots, h = [np.zeros(len(c), np.int64)], np.zeros(len(c), np.int64)
    for n in range(1, ORDER + 1):
        moved = np.zeros_like(c)
        moved[n - 1 :] = c[: len(c) - n + 1]
        h = h * 1000003 + moved + 1
        slots.append((((h ^ (h >> 29)) * 668265261) >> 17) & ((1 << SLOTS) - 1))
    return slots, owner, real


class Model:
    """Counts by order and slot for one side."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts.astype(np.float64)  # (ORDER + 1) x slots

    def log_likelihood(self, slots, real) -> np.ndarray:
        p = np.full(int(real.sum()), 1 / 256)
        at = np.flatnonzero(real)
        for n in range(1, ORDER + 1):
            context = self.counts[n - 1][slots[n - 1][at - 1]]
            p = (self.counts[n][slots[n][at]] + BLEND * p) / (context + BLEND)
        return np.log(np.minimum(p, 1.0))


def count_grams(decided: DataFrame) -> np.ndarray:
    """Counts of accepted and rejected grams: 2 x (ORDER + 1) x slots, summed by Spark over all tasks."""

    def count(batches):
        import pandas as pd

        sums = np.zeros((2, ORDER + 1, 1 << SLOTS), np.int64)
        for pdf in batches:
            for side in (0, 1):
                urls = pdf.loc[pdf["side"] == side, "_url"].tolist()
                for lo in range(0, len(urls), 4096):
                    slots, _, real = gram_slots(urls[lo : lo + 4096])
                    # a context is counted where it is followed by a predicted character
                    sums[side, 0, 0] += int(real.sum())
                    for n in range(1, ORDER + 1):
                        sums[side, n] += np.bincount(slots[n][real], minlength=1 << SLOTS)
                        start = np.append(real[1:] & ~real[:-1], False)
                        sums[side, n] += np.bincount(slots[n][start], minlength=1 << SLOTS)
        at = np.flatnonzero(sums.any(axis=0).ravel())
        flat = sums.reshape(2, -1)[:, at]
        yield pd.DataFrame({"slot": at, "accepted": flat[0], "rejected": flat[1]})

    parts = decided.select("side", "_url").mapInPandas(count, "slot long, accepted long, rejected long")
    rows = parts.groupBy("slot").agg(F.sum("accepted").alias("a"), F.sum("rejected").alias("r")).toPandas()
    out = np.zeros((2, (ORDER + 1) << SLOTS), np.int64)
    out[0, rows["slot"]], out[1, rows["slot"]] = rows["a"], rows["r"]
    return out.reshape(2, ORDER + 1, 1 << SLOTS)


def ratios(rows: DataFrame, counts: np.ndarray, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``ratio``, the mean log-likelihood difference per character."""
    packed = rows.sparkSession.sparkContext.broadcast(counts)

    def score(batches):
        import pyarrow as pa

        accepted, rejected = (Model(c) for c in packed.value)
        for batch in batches:
            urls, out = batch.column("_url").to_pylist(), []
            for lo in range(0, len(urls), 4096):
                slots, owner, real = gram_slots(urls[lo : lo + 4096])
                diff = accepted.log_likelihood(slots, real) - rejected.log_likelihood(slots, real)
                own = owner[real]
                out.append(np.bincount(own, diff) / np.bincount(own))
            ratio = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(ratio)], [*keep, "ratio"])

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", ratio double"
    return rows.select(*keep, "_url").mapInArrow(score, schema)


def threshold(held: DataFrame) -> float:
    """Cut with the best balanced accuracy on (side, ratio) rows, read from a histogram of fixed width."""
    bins = held.groupBy(F.floor(F.greatest(F.least(F.col("ratio"), F.lit(20.0)), F.lit(-20.0)) / BINS).alias("bin")).agg(
        F.sum(F.when(F.col("side") == 0, 1).otherwise(0)).alias("a"), F.sum(F.when(F.col("side") == 1, 1).otherwise(0)).alias("r")
    )
    rows = sorted((r.bin, r.a, r.r) for r in bins.collect())
    a, r = sum(x[1] for x in rows), sum(x[2] for x in rows)
    if not a or not r:
        return 0.0
    best, cut, below_a, below_r = 1.0, rows[0][0], 0, 0
    for at, na, nr in rows:
        below_a, below_r = below_a + na, below_r + nr
        right = (a - below_a) / a + below_r / r
        if right > best:
            best, cut = right, at + 1
    return cut * BINS


def filter_urls(pages: DataFrame, rules: dict[str, str], id_col: str = "page_id", url: str = "url") -> DataFrame:
    """id, host, path, rule, verdict and ratio of every row."""
    rows = judge_by_rules(pages, id_col, url, rules)
    decided = rows.filter(F.col("verdict").isNotNull()).withColumn("side", F.when(F.col("verdict") == "allow", 0).otherwise(1))
    held = F.xxhash64("_url") % 5 == 0
    counts = count_grams(decided.filter(~held))
    both = counts[:, 0, 0].all()
    cut = threshold(ratios(decided.filter(held), counts, ["side"])) if both else 0.0
    out = ratios(rows, counts, [id_col, "host", "path", "rule", "verdict"])
    own = F.when(F.lit(not both) | (F.col("ratio") >= cut), "allow").otherwise("block")
    return out.withColumn("verdict", F.coalesce("verdict", own))
