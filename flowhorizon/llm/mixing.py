"""Mixing sources to target weights by capped water-filling, with DataFrame functions only.

Every source gets a share of the word budget in proportion to its weight. A source whose share passes
``max_epochs`` times its own words stops there and the excess is shared again among the others, until no
source is above its limit. A target of ``e`` epochs takes every document ``floor(e)`` times and, for the
fraction, the documents that come first in a seeded random order of the source, so that the words taken
differ from the target by at most half a document.

Defined results: a null text has no words; a null source is a source of its own and comes last; sources
without words have target 0; the order of rows that repeat one id follows their texts, and equal rows are
numbered, so that a repeated id is spread like any other; an empty table gives an empty result. Columns of the input other than the named ones are carried through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .common import equal_keys, small_side, stored, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = 17


def numbered(rows: DataFrame) -> DataFrame:
    """Add ``_nth``, the number of a row among those of equal ``_same``, from 0.

    Most rows are alone and are not moved. The others are counted per partition of a stored table first, so that the
    rows of one ``_same``, however many, are numbered in the partitions in which they lie.
    """
    many = stored(rows.groupBy("_same").agg(F.count("*").alias("_n")).filter("_n > 1").select("_same"), "mix-repeats")
    if many.isEmpty():
        return rows.withColumn("_nth", F.lit(0).cast("bigint"))
    single = rows.join(many, "_same", "left_anti").withColumn("_nth", F.lit(0).cast("bigint"))
    again = stored(rows.join(many, "_same", "left_semi").withColumn("_part", F.spark_partition_id()), "mix-repeated")
    counts = again.groupBy("_same", "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy("_same").orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.select("_same", "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = again.withColumn("_row", F.row_number().over(W.partitionBy("_same", "_part").orderBy("_same")))
    nth = inside.join(counts, ["_same", "_part"]).withColumn("_nth", F.col("_before") + F.col("_row") - 1)
    return single.unionByName(nth.select(*single.columns))


def ordered(rows: DataFrame, seed: int) -> DataFrame:
    """Rows with ``_u``, a random order by ``_id``, ``_md5`` of the text and number among equal rows; it tells all rows of
    a source apart."""
    name = F.concat(F.coalesce(F.col("_id").cast("string"), F.lit("null")), F.lit(":"), F.col("_md5"))
    told = numbered(rows.withColumn("_same", F.struct(name.alias("n"), F.col("_source").alias("s"))))
    u = F.md5(F.concat(F.lit(f"{seed}:"), F.col("_same.n"), F.lit(":"), F.col("_nth").cast("string")))
    return told.withColumn("_u", u).drop("_same", "_nth", "_md5")


def with_sizes(docs: DataFrame, id_col: str, source: str, text: str, seed: int) -> DataFrame:
    """Narrow rows: id, source, words, and the random order ``_u``."""
    own = docs.select(
        F.col(f"`{id_col}`").alias("_id"), F.col(f"`{source}`").alias("_source"), word_count(F.col(f"`{text}`")).alias("_size"),
        F.md5(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("_md5"),
    )
    return ordered(stored(own, "mix-sizes"), seed)


def weigh_sources(rows: DataFrame, weights=WEIGHTS) -> DataFrame:
    """Total words per source and its weight: the weights repeat along the sources in code point order.

    Ranks come from a range partitioning stored with its partition numbers, so no task orders all sources.
    """
    order = F.col("_source").asc_nulls_last()
    totals = rows.groupBy("_source").agg(F.sum("_size").alias("source_size"))
    ranged = stored(totals.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "mix-sources")
    parts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = ranged.withColumn("_row", F.row_number().over(W.partitionBy("_part").orderBy(order))).join(
        parts.select("_part", before.alias("_before")), "_part"
    )
    rank = F.col("_before") + F.col("_row") - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    return ranked.select("_source", "source_size", weight.alias("weight"))


def water_fill(sources: DataFrame, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Add ``target``: the level is raised until clamped sources and open ones together use the budget.

    Each round is one aggregate over the stored sources. The level only rises, so a clamped source stays
    clamped and the rounds end after at most as many as there are sources (in practice a few).
    """
    cap = F.col("source_size").cast("double") * max_epochs
    budget = float(sources.agg(F.sum("source_size")).first()[0] or 0) * share
    level = 0.0
    while True:
        clamped = F.col("weight") * F.lit(level) > cap
        used, open_weight = sources.agg(
            F.coalesce(F.sum(F.when(clamped, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~clamped, F.col("weight"))), F.lit(0.0))
        ).first()
        raised = (budget - used) / open_weight if open_weight else level
        if raised <= level:
            break
        level = raised
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(level), cap))


def cut_points(rows: DataFrame, plan: DataFrame, digits: int = 4) -> DataFrame:
    """Per source the whole repetitions and the last ``u`` that gets one more.

    Words are summed by the leading hex digits of ``u`` first; only the one segment in which the fraction
    ends is read row by row, so a source with a third of all rows never meets in one task.
    """
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = plan.withColumn("whole", F.floor(epochs)).withColumn(
        "need", F.col("target") - F.col("whole") * F.col("source_size")
    )
    seg = F.substring("_u", 1, digits)
    totals = rows.groupBy("_source", seg.alias("_seg")).agg(F.sum("_size").alias("_tot"))
    before = F.coalesce(
        F.sum("_tot").over(W.partitionBy("_source").orderBy("_seg").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
    )
    totals = totals.withColumn("_before", before)
    fits = (F.col("_before") <= F.col("need")) & (F.col("need") < F.col("_before") + F.col("_tot")) & (F.col("need") > 0)
    ends = (
        totals.join(plan.withColumnRenamed("_source", "_s"), F.col("_source").eqNullSafe(F.col("_s")))
        .filter(fits)
        .select(F.col("_s"), F.col("_seg").alias("_end"), (F.col("need") - F.col("_before")).alias("_rest"))
    )
    ends = stored(ends, "mix-ends")
    near = rows.withColumn("_seg", seg).join(
        ends, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_seg") == F.col("_end"))
    )
    near = near.groupBy("_s", "_end", "_rest", "_u").agg(F.sum("_size").alias("_size"))
    run = F.sum("_size").over(W.partitionBy("_s").orderBy("_u").rowsBetween(W.unboundedPreceding, 0))
    last = (
        near.withColumn("_mid", run - F.col("_size") / 2)
        .filter(F.col("_mid") <= F.col("_rest"))
        .groupBy("_s")
        .agg(F.max("_u").alias("_last"))
    )
    # ids of earlier segments sort before the segment's own prefix, so the prefix is the cut when none of it fits
    cuts = ends.join(last.withColumnRenamed("_s", "_l"), F.col("_s").eqNullSafe(F.col("_l")), "left").select(
        F.col("_s"), F.coalesce("_last", "_end").alias("cut")
    )
    return plan.join(cuts, F.col("_source").eqNullSafe(F.col("_s")), "left").select(
        "_source", "source_size", "target", "whole", "cut"
    )


def mix_plan(docs, id_col="doc_id", source="source", text="text", weights=WEIGHTS, share=SHARE, max_epochs=MAX_EPOCHS, seed=SEED):
    """Stored rows (id, source, words, order) and the stored plan of every source."""
    rows = stored(with_sizes(docs, id_col, source, text, seed), "mix-rows")
    sources = stored(weigh_sources(rows, weights), "mix-weights")
    plan = stored(water_fill(sources, share, max_epochs), "mix-targets")
    return rows, stored(cut_points(rows, plan), "mix-cuts")


def repetitions(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with their source's plan and ``_copies``, how often the mix takes them."""
    plan = small_side(plan, plan.count(), 256).withColumnRenamed("_source", "_p")
    joined = rows.join(plan, equal_keys(rows, plan, {"_source": "_p"}), "left").drop("_p")
    extra = F.when(F.col("cut").isNotNull() & (F.col("_u") <= F.col("cut")), 1).otherwise(0)
    return joined.withColumn("_copies", F.col("whole") + extra)


def mix_report(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per document: its words, its source's words and target, and the words taken."""
    rows, plan = mix_plan(docs, id_col, **options)
    return repetitions(rows, plan).select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), "source_size", "target", (F.col("_copies") * F.col("_size")).cast("bigint").alias("taken")
    )


def mix(docs: DataFrame, id_col="doc_id", source="source", text="text", seed=SEED, **options) -> DataFrame:
    """The mixed table itself: every document as often as it is taken, with all its columns."""
    _, plan = mix_plan(docs, id_col, source, text, seed=seed, **options)
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    rows = own.select(
        "_doc", F.col(f"_doc.`{id_col}`").alias("_id"), F.col(f"_doc.`{source}`").alias("_source"),
        F.md5(F.coalesce(F.col(f"_doc.`{text}`"), F.lit(""))).alias("_md5"),
    )
    taken = repetitions(ordered(rows, seed), plan).filter(F.col("_copies") > 0)
    return taken.select(F.explode(F.array_repeat("_doc", F.col("_copies").cast("int"))).alias("_doc")).select("_doc.*")
