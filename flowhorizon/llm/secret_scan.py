"""Secret scan over a trigram inverted index.

Every rule is a regular expression. From its syntax tree comes a Boolean query over trigrams that any match
must contain: a literal of three or more characters demands all of its trigrams, a sequence demands what
its parts demand, alternatives demand one of theirs. A rule that demands nothing is scanned for in full.

The corpus is indexed in segments, as search engines do: a segment is a slice of documents held by a task,
its index maps each trigram that any rule asks for to the sorted list of documents with it. Queries are
answered by intersecting and uniting posting lists, and only the documents found are verified with the
expression. Trigrams are taken from ASCII-lower-cased text, so one index serves rules in either case.

Defined results: null and empty texts have no spans; spans count code points, the end exclusive; matches of
a rule are leftmost and do not overlap; repeated rows are scanned alike; other columns are not looked at.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

try:
    from re import _constants as sre, _parser
except ImportError:  # older Python
    import sre_constants as sre
    import sre_parse as _parser

SEGMENT_CHARS = 1_000_000
MOST_STRINGS = 32


@dataclass(frozen=True)
class Rule:
    """``group`` is the group whose length must reach ``least`` (0: the whole match)."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    ignore_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.ignore_case else 0))


BASE = [
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]{32,}"),
]
MORE = [
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("repo", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
]


def lower(s: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def grams(literal: str) -> list[str]:
    """Trigrams of a literal that the index can hold (ASCII, no NUL)."""
    low = lower(literal)
    return sorted({g for i in range(len(low) - 2) if (g := low[i : i + 3]).isascii() and "\0" not in g})


def conjunction(parts):
    flat: dict = {}
    for p in parts:
        if p is not None:
            flat.update(dict.fromkeys(p[1] if isinstance(p, tuple) and p[0] == "and" else [p]))
    return None if not flat else next(iter(flat)) if len(flat) == 1 else ("and", tuple(flat))


def disjunction(parts):
    parts = list(dict.fromkeys(parts))
    return None if not parts or None in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def one_of(strings):
    """What the text must contain when one of ``strings`` stands in it."""
    return disjunction([conjunction(grams(s)) for s in sorted(strings)])


def trigram_query(pattern: str):
    """Boolean query of a pattern: a trigram, ``("and", parts)``, ``("or", parts)``, or None for no demand."""
    strings, query = sequence(_parser.parse(pattern))
    return conjunction([query, one_of(strings)]) if strings is not None else query


def sequence(tree):
    """(strings a sequence can be, or None when not a short list; what it demands besides them)."""
    run, whole, demands = {""}, True, []
    for op, value in tree:
        strings, query = part(op, value)
        demands.append(query)
        if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
            run = {a + b for a in run for b in strings}
        else:
            demands.append(one_of(run))
            run, whole = strings if strings is not None else {""}, False
    if whole:
        return run, conjunction(demands)
    return None, conjunction([*demands, one_of(run)])


def part(op, value):
    if op is sre.LITERAL:
        return {chr(value)}, None
    if op is sre.AT:
        return {""}, None
    if op is sre.SUBPATTERN:
        return sequence(value[3])
    if op is sre.BRANCH:
        arms = [sequence(arm) for arm in value[1]]
        if all(s is not None for s, _ in arms):
            return set().union(*(s for s, _ in arms)), disjunction([q for _, q in arms])
        return None, disjunction([conjunction([q, one_of(s) if s is not None else None]) for s, q in arms])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, inner = value
        strings, query = sequence(inner)
        if low == 0:
            return (strings | {""}, None) if high == 1 and strings is not None else (None, None)
        if low == high == 1:
            return strings, query
        return None, conjunction([query, one_of(strings) if strings is not None else None])
    return None, None


def trigrams_in(query) -> set[str]:
    if query is None:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams_in, query[1]))


class Segment:
    """Posting lists of the trigrams in question over a slice of texts."""

    fold = np.zeros(256, np.int32)
    fold[:128] = [ord(lower(chr(i))) for i in range(128)]

    def __init__(self, texts: list[str], wanted: list[str]):
        table = np.zeros(1 << 21, np.int16)
        for k, g in enumerate(wanted):
            a, b, c = map(ord, g)
            table[a << 14 | b << 7 | c] = k + 1
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        c = self.fold[np.frombuffer(b"\0\0".join(raw) + b"\0\0", np.uint8)]
        found = table[(c[:-2] << 14) | (c[1:-1] << 7) | c[2:]]
        at = np.flatnonzero(found)
        ends = np.cumsum([len(r) + 2 for r in raw])
        has = np.zeros((len(wanted) + 1, len(texts)), bool)
        has[found[at], np.searchsorted(ends, at, side="right")] = True
        self.size = len(texts)
        self.postings = {g: np.flatnonzero(has[k + 1]) for k, g in enumerate(wanted)}

    def find(self, query) -> np.ndarray:
        """Texts that satisfy a query, in order; all of them for no demand."""
        if query is None:
            return np.arange(self.size)
        if isinstance(query, str):
            return self.postings[query]
        lists = sorted((self.find(q) for q in query[1]), key=len)
        out = lists[0]
        for other in lists[1:]:
            out = np.intersect1d(out, other, True) if query[0] == "and" else np.union1d(out, other)
        return out


def spans_of(texts: list[str], rules: list[Rule]) -> list[list[tuple[str, int, int]]]:
    """Spans of each text, by start and then in the order of the rules."""
    queries = [trigram_query(r.pattern) for r in rules]
    segment = Segment(texts, sorted(set().union(*map(trigrams_in, queries))))
    out: list[list] = [[] for _ in texts]
    for k, (rule, query) in enumerate(zip(rules, queries)):
        expression = rule.compiled()
        for i in segment.find(query).tolist():
            for m in expression.finditer(texts[i]):
                if len(m.group(rule.group)) >= rule.least:
                    out[i].append((m.start(), k, m.end()))
    return [[(rules[k].kind, a, b) for a, k, b in sorted(spans)] for spans in out]


def scan(docs: DataFrame, keep: list[str], text: str = "text", rules: list[Rule] = (*BASE, *MORE)) -> DataFrame:
    """``keep`` columns of every row and ``spans``, an array of (kind, start, end)."""
    rules = list(rules)

    def run(batches):
        import pyarrow as pa

        from .languages import slices

        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            rows = []
            for lo, hi in slices(texts, SEGMENT_CHARS):
                rows += spans_of(texts[lo:hi], rules)
            rows = [[dict(zip(("kind", "start", "end"), s)) for s in spans] for spans in rows]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(rows, kind)], [*keep, "spans"])

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", spans array<struct<kind string, start bigint, end bigint>>"
    return docs.select(*keep, text).mapInArrow(run, schema)


def joined(spans):
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_kind(spans, *kinds: str):
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))
