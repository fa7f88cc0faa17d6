"""Column expressions and table helpers the operators share."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, functions as F

from ..sinks.tables import stage

WORD = r"[^\x20\x09-\x0D]+"
BROADCAST_BYTES = 8 << 20


def word_count(text: Column) -> Column:
    """Number of runs without ASCII white space; a null text has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def plain_words(text: Column) -> Column:
    """Lower-case letters, marks and digits, everything else one blank: the form in which texts are compared."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+", " "))


def equal_keys(left: DataFrame, right: DataFrame, keys: dict[str, str]) -> Column:
    """Join condition in which null equals null."""
    on = F.lit(True)
    for a, b in keys.items():
        on = on & left[a].eqNullSafe(right[b])
    return on


def small_side(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Broadcast hint for a stored table of counted rows of at most ``row_bytes``, else left to Spark's joins."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back, so that lost executors cost nothing already done."""
    return stage(df, f"llm-{name}")


@contextmanager
def short_shuffles(spark):
    """Within this block a shuffle's files go as soon as the query that made them has ended."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def block_pairs(df: DataFrame, keys: list[str], n: str, by: str, block: int) -> DataFrame:
    """Deal lists of rows out so that every two rows of a list meet in a group of at most about two blocks.

    ``n`` is the size of a row's list (columns ``keys``). A list of more than ``block`` rows is cut into
    blocks by the hash of ``by``; a row goes to one group per other block, as ``block`` = its own block and
    (``i``, ``j``) = the two blocks that meet. Lists of one block share groups of about ``2 * block`` rows.
    """
    small = df.filter(F.col(n) <= block).count()
    slots = max(1, small // (2 * block))
    out = df.withColumn("cuts", F.ceil(F.col(n) / block).cast("int"))
    out = out.withColumn("block", F.pmod(F.xxhash64(by), "cuts").cast("int"))
    out = out.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    out = out.withColumn("i", F.least("block", "_other")).withColumn("j", F.greatest("block", "_other"))
    list_hash = F.xxhash64(*keys)
    return out.withColumn("group", F.when(F.col("cuts") == 1, F.pmod(list_hash, F.lit(slots))).otherwise(list_hash)).drop("_other")
