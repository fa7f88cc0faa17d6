"""Cleaning, flow features and row validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import clip
from ..schema import FLOW_KEY, NUMERIC

DROP_RULES = [
    "missing_timestamp",
    "missing_source_ip",
    "missing_destination_ip",
    "negative_duration",
    "infinite_values",
]
DUPLICATE = "exact_duplicate_flow"
FLAGS = ["syn", "ack", "rst", "fin", "psh"]


def drop_reason(flows: DataFrame) -> Column:
    """First failing rule of a row, NULL when it passes. Duplicates are not a row property."""
    inf = F.lit(float("inf"))
    infinite = F.lit(False)
    for c in NUMERIC:
        if c in flows.columns:
            infinite = infinite | F.coalesce(F.abs(F.col(c)) == inf, F.lit(False))

    def blank(c):
        return F.col(c).isNull() | (F.length(c) == 0)

    return (
        F.when(F.col("timestamp").isNull(), DROP_RULES[0])
        .when(blank("source_ip"), DROP_RULES[1])
        .when(blank("destination_ip"), DROP_RULES[2])
        .when(F.col("flow_duration") < 0, DROP_RULES[3])
        .when(infinite, DROP_RULES[4])
    )


def clean_flows(flows: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    """Keep usable rows, and of exact duplicates the first one.

    "First" is by ``order_by`` (input order columns such as file and line); without it, by the
    remaining columns, so the result does not depend on partitioning. ``min_by`` is an aggregate
    with map-side combine, so a flow repeated a billion times costs one row per map task.
    """
    kept = flows.filter(drop_reason(flows).isNull())
    rest = [c for c in flows.columns if c not in FLOW_KEY]
    rank = F.struct(*(order_by or []), *[c for c in rest if c not in (order_by or [])])
    first = kept.groupBy(*FLOW_KEY).agg(F.min_by(F.struct(*rest), rank).alias("_row"))
    return first.select(*FLOW_KEY, "_row.*").select(*flows.columns)


def cleaning_report(flows: DataFrame) -> DataFrame:
    """``reason, rows`` for every rule (zero included) plus rows_in and rows_out, from one pass."""
    reason = drop_reason(flows)
    # dropped rows lose their key here, so they collapse before the shuffle
    keyed = flows.select(reason.alias("reason"), *[F.when(reason.isNull(), F.col(k)).alias(k) for k in FLOW_KEY])
    groups = keyed.groupBy("reason", *FLOW_KEY).agg(F.count(F.lit(1)).alias("n"))
    totals = groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows_in"),
        F.count(F.when(F.col("reason").isNull(), 1)).alias("rows_out"),
        *[F.coalesce(F.sum(F.when(F.col("reason") == r, F.col("n"))), F.lit(0)).alias(r) for r in DROP_RULES],
        F.coalesce(F.sum(F.when(F.col("reason").isNull(), F.col("n") - 1)), F.lit(0)).alias(DUPLICATE),
    )
    names = ["rows_in", *DROP_RULES, DUPLICATE, "rows_out"]
    long = F.explode(F.array(*[F.struct(F.lit(n).alias("reason"), F.col(n).alias("rows")) for n in names]))
    return totals.select(long.alias("r")).select("r.reason", "r.rows")


def flow_features(flows: DataFrame) -> DataFrame:
    """Rates per second, bytes per packet and TCP flag ratios with guarded denominators."""

    def number(c):
        return F.coalesce(F.col(c).cast("double"), F.lit(0.0))

    seconds = F.greatest(number("flow_duration"), F.lit(1e-6))
    packets = F.greatest(number("packet_count"), F.lit(1.0))
    out = {
        "packets_per_second": number("packet_count") / seconds,
        "bytes_per_second": number("byte_count") / seconds,
        "bytes_per_packet": number("byte_count") / packets,
    }
    for flag in FLAGS:
        have = f"{flag}_count" in flows.columns
        ratio = clip(number(f"{flag}_count") / packets, 0.0, 1.0) if have else F.lit(None).cast("double")
        out[f"{flag}_ratio"] = ratio
    return flows.withColumns(out)


def prepare_flows(flows: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    """Unlabelled traffic: NULL label columns where absent, then clean and add features."""
    for c in ("normalized_attack_class", "attack_stage"):
        if c not in flows.columns:
            flows = flows.withColumn(c, F.lit(None).cast("string"))
    return flow_features(clean_flows(flows, order_by))


# fixed values: limits of an alert row
PROBABILITY_FIELDS = ["model_probability", "model_threshold", "lr_probability", "lr_threshold", "confidence"]
FLAG_FIELDS = ["lr_flag", "reference_rule_flag", "truth_attack"]
TEXT_LIMITS = {
    "session_id": 128, "sequence_id": 128, "host_id": 128, "confidence_label": 128, "predicted_stage": 128,
    "truth_class": 128, "truth_stage": 128, "model_version": 128,
    "predicted_at": 64, "target_window_start": 64, "target_window_end": 64,
}
REQUIRED_ALERT_FIELDS = ["sequence_id", "host_id"]


def alert_reject_reason(alerts: DataFrame) -> Column:
    """Name of the first field that breaks an alert limit, NULL for a valid row."""
    checks = []
    for c in REQUIRED_ALERT_FIELDS:
        checks.append((c, F.col(c).isNull() if c in alerts.columns else F.lit(True)))
    for c in PROBABILITY_FIELDS:
        if c in alerts.columns:
            checks.append((c, F.isnan(c) | (F.col(c) < 0) | (F.col(c) > 1)))
    for c in FLAG_FIELDS:
        if c in alerts.columns:
            checks.append((c, ~F.col(c).isin(0, 1)))
    if "risk_score" in alerts.columns:
        checks.append(("risk_score", F.isnan("risk_score") | (F.col("risk_score") < 0) | (F.col("risk_score") > 100)))
    for c, limit in TEXT_LIMITS.items():
        if c in alerts.columns:
            checks.append((c, F.length(F.col(c).cast("string")) > limit))
    return F.coalesce(*[F.when(bad, F.lit(name)) for name, bad in checks])


def split_valid_alerts(alerts: DataFrame) -> tuple[DataFrame, DataFrame]:
    marked = alerts.withColumn("reject_reason", alert_reject_reason(alerts))
    valid = marked.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    return valid, marked.filter(F.col("reject_reason").isNotNull())
