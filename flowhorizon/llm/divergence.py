"""Divergence of sources by a frequent-pattern tree of term rows.

Every (lang, source) group gives a term a share p, smoothed so that absent terms have one too, and two sources differ by
the sum of abs(p - q) over all kept terms of their lang. A term's row holds the counts of the sources in which it occurs,
in the order of the sources. Writing z for the share of an absent term, the sum for sources s and t is

    V * abs(z_s - z_t)                                        as if no term occurred in either
    + sum over s's terms of abs(p_s - z_t) - abs(z_s - z_t)   for each side alone
    + sum over common terms of what both sides together add   the pair correction

Rows go into a prefix tree whose nodes are (source, count) with the number of rows through them. A node and one of
its ancestors stand for that many common terms at once, so the pair correction is computed once per such combination;
the number of rows through the nodes of a (source, count) gives the sum for a side alone.

Scale: counts are combined in the tasks before they are shuffled, equal rows are counted, and distinct rows that
begin with the same nodes come into one task in path order, which builds its part of the tree and keeps only the
path it stands on. What leaves a task are sums per pair of sources and per (source, count). No step holds a
vocabulary or all pairs in one place. All arithmetic is in whole numbers.

Defined results: null text, lang and source are empty strings; a source without kept terms has the share of an absent term
for all of them; a lang without kept terms gives value 0 for every pair and no term rows; repeated rows are documents of
their own; ties are ordered by item; a lang with one source has no pair rows; long texts are read in pieces that end
between terms; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import stored

DOCUMENTS = 30  # documents of its lang that a kept term is in
UNIT, PRIOR = 1_000_000_000, 5
TOP = 50
PIECE, HELD = 1 << 20, 300_000  # bytes of text read at once, counts a task holds before it sends them on

COUNTS = "lang string, source string, term string, n bigint, docs bigint"


def count_terms(docs: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    """Occurrences and documents of every term in every group. A term is a run of ASCII letters and of characters beyond
    ASCII, with A-Z lower-cased, which in UTF-8 is a run of such bytes."""
    empty = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = docs.select(empty(lang).alias("lang"), empty(source).alias("source"), empty(text).alias("text"))

    def run(batches):
        import re
        from collections import Counter

        import pyarrow as pa

        term = re.compile(rb"[a-z\x80-\xff]+")
        between = re.compile(rb"[^a-z\x80-\xff]")
        groups: dict[tuple, tuple] = {}
        held = 0

        def pieces(raw: bytes):
            start = 0
            while start < len(raw):
                gap = between.search(raw, min(start + PIECE, len(raw)))
                end = gap.start() if gap else len(raw)
                yield raw[start:end]
                start = end

        def flush():
            # both counters of a group got their terms in the same order
            for (lang, source), (ns, ds) in groups.items():
                words = pa.array(list(ns), pa.binary()).cast(pa.string())
                counts = [pa.array(list(x.values()), pa.int64()) for x in (ns, ds)]
                names = [pa.repeat(pa.scalar(x, pa.string()), len(words)) for x in (lang, source)]
                yield pa.RecordBatch.from_arrays([*names, words, *counts], ["lang", "source", "term", "n", "docs"])
            groups.clear()

        for batch in batches:
            for lang, source, text in zip(*(batch.column(i) for i in range(3))):
                ns, ds = groups.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
                before, own = len(ns), {}
                for piece in pieces(text.as_py().encode("utf-8").lower()):
                    words = term.findall(piece)
                    ns.update(words)
                    own.update(dict.fromkeys(words))
                ds.update(iter(own))
                held += len(ns) - before
                if held >= HELD:
                    yield from flush()
                    held = 0
        yield from flush()

    parts = rows.mapInArrow(run, COUNTS)
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, total: str, terms: str) -> Column:
    """1 + floor(UNIT * (n + PRIOR) / (total + PRIOR * terms)), in numbers wide enough for any count; null without terms."""
    wide = lambda x: f"cast({x} as decimal(28,0))"
    return F.expr(f"1 + {wide(f'({n} + {PRIOR})')} * {UNIT} div nullif({wide(f'{total} + {PRIOR} * {terms}')}, 0)")


TREE = "lang string, s string, t string, p bigint, z bigint, amount decimal(38,0)"


def corrections(rows: DataFrame) -> DataFrame:
    """Sums over the tree of rows (lang, path, m), which come sorted by lang and path: pair corrections per (lang, s, t), and
    with a null ``t`` the rows through all nodes of a source and share."""

    def run(batches):
        from collections import defaultdict
        from decimal import Decimal

        import pyarrow as pa

        # the nodes from the root down: (source, count), share, share of an absent term, rows through them
        lang, names, shares, absent, through = None, [], [], [], []
        pairs: dict[tuple, dict] = defaultdict(lambda: defaultdict(int))
        single: dict[tuple, int] = defaultdict(int)

        def close(depth: int):
            """Leave the nodes below ``depth``; a node is complete when it is left."""
            while len(names) > depth:
                (t, _), q, y, m = names.pop(), shares.pop(), absent.pop(), through.pop()
                if through:
                    through[-1] += m
                single[lang, t, q, y] += m
                sums = pairs[lang, t]
                for (s, _), p, z in zip(names, shares, absent):
                    sums[s] += m * (abs(p - q) - abs(p - y) - abs(q - z) + abs(z - y))

        def flush():
            out = [(g, s, t, None, None, x) for (g, t), sums in pairs.items() for s, x in sums.items()]
            out += [(g, s, None, p, z, x) for (g, s, p, z), x in single.items()]
            pairs.clear()
            single.clear()
            columns = list(zip(*out)) if out else [()] * 6
            kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.decimal128(38, 0)]
            columns[5] = [Decimal(x) for x in columns[5]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["lang", "s", "t", "p", "z", "amount"])

        held = 0
        for batch in batches:
            for row in batch.to_pylist():
                if row["lang"] != lang:
                    close(0)
                    lang = row["lang"]
                items = [(x["source"], x["n"]) for x in row["path"]]
                same = 0
                while same < min(len(names), len(items)) and names[same] == items[same]:
                    same += 1
                close(same)
                for x, name in zip(row["path"][same:], items[same:]):
                    names.append(name)
                    shares.append(x["p"])
                    absent.append(x["z"])
                    through.append(0)
                through[-1] += row["m"]
                held += len(items) - same
                if held >= HELD:  # every sum held came from one of these nodes, as one of at most (sources) pairs
                    yield flush()
                    held = 0
        close(0)
        yield flush()

    return rows.select("lang", "path", "m").mapInArrow(run, TREE).groupBy("lang", "s", "t", "p", "z").agg(F.sum("amount").alias("amount"))


def audit(docs: DataFrame, lang="lang", source="source", text="text", documents: int = DOCUMENTS, top: int = TOP) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value and rank of every group."""
    empty = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    counts = stored(count_terms(docs, lang, source, text), "audit-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).filter(F.col("docs") >= documents)
    kept = stored(kept.select("lang", "term", "lang_n"), "audit-terms")
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    used = stored(counts.select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "audit-used")
    totals = used.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select(empty(lang).alias("lang"), empty(source).alias("source")).distinct()
    groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "terms", "lang_total"])
    groups = stored(groups.withColumn("z", share("0", "total", "terms")), "audit-groups")

    shares = used.join(groups, ["lang", "source"]).withColumn("p", share("n", "total", "terms"))
    shares = stored(shares.withColumn("q", share("lang_n", "lang_total", "terms")), "audit-shares")
    best = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)

    paths = shares.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("source", "n", "p", "z"))).alias("path"))
    rows = stored(paths.groupBy("lang", "path").agg(F.count("*").alias("m")), "audit-rows")
    # rows that begin with the same three nodes meet; any other dealing gives the same sums from a tree with more nodes
    begins = F.transform(F.slice("path", 1, 3), lambda x: F.struct(x["source"], x["n"]))
    sums = stored(corrections(rows.repartition("lang", begins).sortWithinPartitions("lang", "path")), "audit-sums")

    own = groups.select("lang", "source", "z", "terms")
    other = own.select("lang", F.col("source").alias("item"), F.col("z").alias("y"))
    alone = sums.filter(F.col("t").isNull()).select("lang", F.col("s").alias("source"), "p", "z", "amount").join(other, "lang").filter("source <> item")
    alone = alone.groupBy("lang", "source", "item").agg(F.sum(F.expr("amount * (abs(p - y) - abs(z - y))")).alias("part"))
    both = sums.filter(F.col("t").isNotNull()).select("lang", F.col("s").alias("source"), F.col("t").alias("item"), F.col("amount").alias("part"))
    turned = lambda df: df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "part")
    added = alone.union(turned(alone)).union(both).union(turned(both)).groupBy("lang", "source", "item").agg(F.sum("part").alias("added"))
    base = own.join(other, "lang").filter("source <> item").withColumn("base", F.expr("cast(terms as decimal(20,0)) * coalesce(abs(z - y), 0)"))
    value = (F.col("base") + F.coalesce("added", F.lit(0))).cast("bigint")
    pairs = base.join(added, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))
    return pairs.withColumn("rank", F.row_number().over(best)).union(terms)
