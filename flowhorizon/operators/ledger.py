"""Tamper-evident hash chains over tables.

A chain is sequential by nature, so one long chain would be one task. Rows of a key (a session,
an alert) are cut into blocks of a fixed number of rows. Inside a block each row's hash covers its
text and the previous hash; block 0 starts from zeros and later blocks from a value derived from key
and block number. The heads table keeps one row per block, and its ``link`` column chains
the block heads, so blocks hash and verify in parallel and removing a whole block still shows.
"""

from __future__ import annotations

import hashlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions.lookups import GENESIS
from ..functions.scalars import canonical_text, fixed6
from ..plans.scan import row_index

BLOCK_ROWS = 10_000

# fixed values: every alert field that the hash covers, in order
ALERT_FIELDS = [
    "session_id", "sequence_id", "host_id", "predicted_at", "target_window_start", "target_window_end",
    "model_probability", "model_threshold", "lr_probability", "lr_threshold", "lr_flag", "reference_rule_flag",
    "risk_score", "risk_components", "confidence", "confidence_label", "predicted_stage",
    "truth_attack", "truth_class", "truth_stage", "model_version", "created_at",
]
REAL_FIELDS = {"model_probability", "model_threshold", "lr_probability", "lr_threshold", "risk_score", "confidence"}

LINK_BROKEN = "link broken: a record before this one was deleted, reordered or rewritten"
CONTENT_CHANGED = "content does not match the stored hash"
TAIL_DELETED = "newest records deleted"
RECOMPUTED = "chain was recomputed"


def alert_text(alerts: DataFrame) -> Column:
    """Canonical line of an alert: reals with six decimals, NULL distinguishable, position included."""
    cols = [F.col("seq_no").cast("string")]
    for f in ALERT_FIELDS:
        c = F.col(f) if f in alerts.columns else F.lit(None)
        cols.append(fixed6(c) if f in REAL_FIELDS else c)
    return canonical_text(*cols)


def block_genesis(key: Column, block: Column) -> Column:
    derived = F.sha2(F.concat_ws("|", key.cast("string"), block.cast("string")), 256)
    return F.when(block == 0, F.lit(GENESIS)).otherwise(derived)


def number_rows(rows: DataFrame, key: str, order: list[str], segment: Column, heads: DataFrame | None = None):
    """Add ``seq_no``, the 0-based position in the key, continuing after stored heads."""
    numbered = row_index(rows, [key], order, segment, "seq_no")
    if heads is None:
        return numbered
    last = heads.groupBy(F.col(key).alias("_k")).agg((F.max("last_seq") + 1).alias("_next"))
    return (
        numbered.join(last, numbered[key] == last["_k"], "left")
        .withColumn("seq_no", F.col("seq_no") + F.coalesce("_next", F.lit(0)))
        .drop("_k", "_next")
    )


def chain_rows(
    rows: DataFrame, key: str, text: Column, heads: DataFrame | None = None, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Add ``block_no``, ``prev_hash`` and ``hash`` to numbered rows.

    A group handed to Python has at most ``block_rows`` rows. A block already begun in ``heads``
    goes on from its stored head.
    """
    block = F.floor(F.col("seq_no") / block_rows).cast("bigint")
    prepared = rows.withColumns({"block_no": block, "_text": text})
    prepared = prepared.withColumn("_seed", block_genesis(F.col(key), F.col("block_no")))
    if heads is not None:
        stored = heads.select(F.col(key).alias("_k"), F.col("block_no").alias("_b"), F.col("head_hash").alias("_h"))
        prepared = (
            prepared.join(stored, (F.col(key) == F.col("_k")) & (F.col("block_no") == F.col("_b")), "left")
            .withColumn("_seed", F.coalesce("_h", "_seed"))
            .drop("_k", "_b", "_h")
        )
    kept = [c for c in prepared.columns if c not in ("_text", "_seed")]
    schema = T.StructType(
        [prepared.schema[c] for c in kept]
        + [T.StructField("prev_hash", T.StringType()), T.StructField("hash", T.StringType())]
    )

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by("seq_no")
        prev, before, after = table["_seed"][0].as_py(), [], []
        for line in table["_text"].to_pylist():
            before.append(prev)
            prev = hashlib.sha256((line + prev).encode("utf-8")).hexdigest()
            after.append(prev)
        out = table.select(kept)
        return out.append_column("prev_hash", pa.array(before)).append_column("hash", pa.array(after))

    return prepared.groupBy(key, "block_no").applyInArrow(fold, schema)


def append_alerts(
    alerts: DataFrame, heads: DataFrame | None = None, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Number and chain alerts per session, in id order."""
    numbered = number_rows(alerts, "session_id", ["id"], F.floor(F.col("id") / 65536), heads)
    return chain_rows(numbered, "session_id", alert_text(numbered), heads, block_rows)


def chain_heads(chained: DataFrame, key: str, previous: DataFrame | None = None) -> DataFrame:
    """One row per (key, block): rows, last_seq, last_id, head_hash and the running ``link``.

    ``previous`` are stored heads of blocks that these rows continue or follow.
    """
    fresh = chained.groupBy(key, "block_no").agg(
        F.count(F.lit(1)).alias("rows"),
        F.max("seq_no").alias("last_seq"),
        F.max_by("id", "seq_no").alias("last_id"),
        F.max_by("hash", "seq_no").alias("head_hash"),
    )
    if previous is not None:
        merged = fresh.unionByName(previous.select(*fresh.columns))
        fresh = merged.groupBy(key, "block_no").agg(
            F.sum("rows").alias("rows"),
            F.max("last_seq").alias("last_seq"),
            F.max_by("last_id", "last_seq").alias("last_id"),
            F.max_by("head_hash", "last_seq").alias("head_hash"),
        )
    schema = T.StructType([*fresh.schema.fields, T.StructField("link", T.StringType())])

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block_no")
        links, prev = [], GENESIS
        for head in pdf["head_hash"]:
            prev = hashlib.sha256((head + prev).encode("utf-8")).hexdigest()
            links.append(prev)
        return pdf.assign(link=links)

    # one row per block_rows records: this group is smaller than the chain by that factor
    return fresh.groupBy(key).applyInPandas(link, schema)


def chain_violations(chained: DataFrame, key: str, text: Column, content: bool = True) -> DataFrame:
    """Rows whose link or content is wrong, with a reason. Windows run per block."""
    w = W.partitionBy(key, "block_no").orderBy("seq_no")
    expected = F.coalesce(F.lag("hash").over(w), block_genesis(F.col(key), F.col("block_no")))
    checked = chained.withColumns({"_expected": expected, "_text": text})
    reason = F.when(~F.col("prev_hash").eqNullSafe(F.col("_expected")), LINK_BROKEN)
    if content:
        again = F.sha2(F.concat("_text", "prev_hash"), 256)
        reason = reason.when(~F.col("hash").eqNullSafe(again), CONTENT_CHANGED)
    return checked.withColumn("reason", reason).filter(F.col("reason").isNotNull()).drop("_expected", "_text")


def head_problems(chained: DataFrame, heads: DataFrame, key: str) -> DataFrame:
    """Per (key, block) of the heads table: state against the rows that are there."""
    have = chained.select(F.col(key).alias("_k"), F.col("block_no").alias("_b"), "seq_no", "hash")
    joined = heads.join(
        have, (F.col(key) == F.col("_k")) & (F.col("block_no") == F.col("_b")) & (F.col("seq_no") == F.col("last_seq")), "left"
    )
    last = chained.groupBy(F.col(key).alias("_k2"), F.col("block_no").alias("_b2")).agg(F.max("seq_no").alias("_max"))
    joined = joined.join(last, (F.col(key) == F.col("_k2")) & (F.col("block_no") == F.col("_b2")), "left")
    state = (
        F.when(F.col("hash").isNull(), TAIL_DELETED)
        .when(F.col("hash") != F.col("head_hash"), RECOMPUTED)
        .when(F.col("_max") > F.col("last_seq"), "behind")
        .otherwise("matched")
    )
    return joined.select(key, "block_no", "last_id", state.alias("anchor"))


def broken_links(heads: DataFrame, key: str) -> DataFrame:
    """Blocks whose stored ``link`` does not follow from the block before (or a block is gone)."""
    w = W.partitionBy(key).orderBy("block_no")
    prev = F.coalesce(F.lag("link").over(w), F.lit(GENESIS))
    gap = F.col("block_no") != F.coalesce(F.lag("block_no").over(w) + 1, F.lit(0))
    marked = heads.withColumns({"_prev": prev, "_gap": gap})
    bad = F.col("_gap") | (F.sha2(F.concat("head_hash", "_prev"), 256) != F.col("link"))
    return marked.filter(bad).select(key, "block_no")


def verify_chain(chained: DataFrame, key: str, text: Column, heads: DataFrame | None = None) -> DataFrame:
    """Per key: status, first bad id, reason, records checked before it, anchor state."""
    bad = chain_violations(chained, key, text).groupBy(F.col(key).alias("_k")).agg(
        F.min("id").alias("record_id"), F.min_by("reason", "id").alias("reason")
    )
    totals = chained.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("records"))
    ahead = (
        chained.select(F.col(key).alias("_kk"), "id")
        .join(bad.select(F.col("_k").alias("_kk"), "record_id"), "_kk")
        .filter(F.col("id") < F.col("record_id"))
        .groupBy("_kk")
        .agg(F.count(F.lit(1)).alias("_before"))
    )
    out = totals.join(bad, F.col("_key") == F.col("_k"), "left").join(ahead, F.col("_key") == F.col("_kk"), "left")
    if heads is not None:
        p = head_problems(chained, heads, key)
        hard = F.col("anchor").isin(TAIL_DELETED, RECOMPUTED)
        per = p.groupBy(F.col(key).alias("_ak")).agg(
            F.min_by("anchor", F.when(hard, F.col("block_no"))).alias("_hard"),
            F.min(F.when(hard, F.col("last_id"))).alias("_hard_id"),
            F.max((F.col("anchor") == "behind").cast("int")).alias("_behind"),
        )
        links = broken_links(heads, key).groupBy(F.col(key).alias("_lk")).agg(F.min("block_no").alias("_block"))
        out = out.join(per, F.col("_key") == F.col("_ak"), "full_outer").join(
            links, F.coalesce("_key", "_ak") == F.col("_lk"), "left"
        )
    else:
        none = F.lit(None)
        out = out.withColumns({"_ak": none.cast("string"), "_hard": none.cast("string"), "_hard_id": none.cast("bigint"),
                               "_behind": none.cast("int"), "_block": none.cast("bigint")})
    links_reason = F.when(F.col("_block").isNotNull(), F.lit("block heads do not chain"))
    reason = F.coalesce("reason", "_hard", links_reason)
    anchor = (
        F.when(F.col("_ak").isNull(), "missing")
        .when(F.col("_hard").isNotNull() | F.col("_block").isNotNull(), "broken")
        .when(F.col("_behind") == 1, "behind")
        .otherwise("matched")
    )
    return out.select(
        F.coalesce("_key", "_ak").alias(key) if heads is not None else F.col("_key").alias(key),
        F.when(reason.isNull(), "VERIFIED").otherwise("CORRUPTED").alias("status"),
        F.coalesce("record_id", "_hard_id").alias("record_id"),
        F.when(F.col("record_id").isNotNull(), F.coalesce("_before", F.lit(0)))
        .otherwise(F.coalesce("records", F.lit(0)))
        .alias("records_checked"),
        reason.alias("reason"),
        anchor.alias("anchor"),
    )


def verify_alerts(chained: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    return verify_chain(chained, "session_id", alert_text(chained), heads)
