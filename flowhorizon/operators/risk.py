"""Risk scores, alert rows and host roll-ups."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.lookups import RISK_WEIGHTS, STAGE_SEVERITY, UNCERTAIN, map_column
from ..functions.scalars import risk_level
from ..plans.grid import MICROS
from ..plans.scan import row_index, with_time_halo

HISTORY_SECONDS = 600
HISTORY_FULL = 5  # alerts in the history window that max out the component
TIMELINE_POINTS = 500
HOUR_US = 3_600 * MICROS


def check_weights(weights: dict[str, float]) -> dict[str, float]:
    """A weight for every risk component, so that the weighted components stay on a scale of 0 to 100.

    All faults are reported together.
    """
    faults = [f"component {name} has no weight" for name in RISK_WEIGHTS if name not in weights]
    faults += [f"{name} is not a component" for name in weights if name not in RISK_WEIGHTS]
    faults += [f"weight of {name} is below zero" for name, w in weights.items() if not float(w) >= 0]
    if not faults and not math.isclose(math.fsum(map(float, weights.values())), 1.0, abs_tol=1e-6):
        faults = ["the weights of all components do not add up to one"]
    if faults:
        raise ValueError("; ".join(faults))
    return {name: float(weights[name]) for name in RISK_WEIGHTS}


def max_reachable_risk(weights: dict[str, float] = RISK_WEIGHTS, stages: bool = True) -> float:
    """Highest possible risk; without a stage forecast the stage component is always 0."""
    w = check_weights(weights)
    top = max(STAGE_SEVERITY.values()) / 100 if stages else 0.0
    return round(100 * (sum(v for k, v in w.items() if k != "stage_severity") + w["stage_severity"] * top), 2)


def abnormality(last_scaled: Column, limit: float | Column = 3.0) -> Column:
    """Share of the last window's scaled inputs beyond ``limit``, a column where it has to be of the inputs' own type:
    a float is widened to meet a number, so that the float nearest to 0.1 would be beyond 0.1."""
    return F.array_size(F.filter(last_scaled, lambda x: F.abs(x) > limit)) / F.array_size(last_scaled)


def recent_alerts(
    scored: DataFrame,
    host: str = "host_id",
    time: str = "target_window_start",
    tie: list[str] = ("seq_start_time",),
    alerted: str = "alerted",
    seconds: int = HISTORY_SECONDS,
) -> DataFrame:
    """Add ``recent_alerts``: earlier alerts of the host no older than ``seconds``.

    Rows are processed by (time, tie); a same-time row counts only what came before it by ``tie``. Rows equal in both
    do not count each other, so the count does not depend on the order in which they are read.
    The look-back is a fixed time, so a host's rows are spread over short spans with a halo.
    """
    back = seconds * MICROS
    rows = scored.withColumn("_t", F.unix_micros(F.col(time).cast("timestamp")))
    halo = with_time_halo(rows, "_t", back, max(HOUR_US, 4 * back))
    one = F.when(F.col(alerted), 1)
    earlier = F.count(one).over(W.partitionBy(host, "_span").orderBy("_t").rangeBetween(-back, -1))
    # the frame ends with the last row of an equal tie, whose own alerts are taken off again
    up_to = F.count(one).over(W.partitionBy(host, "_span", "_t").orderBy(*tie).rangeBetween(W.unboundedPreceding, W.currentRow))
    level = F.count(one).over(W.partitionBy(host, "_span", "_t", *tie))
    return halo.withColumn("recent_alerts", earlier + up_to - level).filter("_own").drop("_t", "_span", "_own")


def risk_components(
    p: Column, threshold: Column, stage: Column, abnormal: Column, recent: Column
) -> dict[str, Column]:
    severity = F.coalesce(F.try_element_at(map_column(STAGE_SEVERITY), stage) / 100.0, F.lit(0.0))
    return {
        "attack_probability": p,
        "stage_severity": severity,
        "prediction_confidence": F.greatest(F.lit(0.0), (p - threshold) / (1 - threshold)),
        "abnormality_score": abnormal,
        "recent_attack_history": F.least(F.lit(1.0), recent / HISTORY_FULL),
    }


def add_risk(scored: DataFrame, threshold: float, weights: dict[str, float] = RISK_WEIGHTS) -> DataFrame:
    """Add ``risk_score`` (0-100, two digits) and the rounded ``risk_components`` struct.

    Needs p, predicted_stage, abnormality and recent_alerts.
    """
    w = check_weights(weights)
    parts = risk_components(
        F.col("p"), F.lit(float(threshold)), F.col("predicted_stage"), F.col("abnormality"), F.col("recent_alerts")
    )
    total = None
    for k, c in parts.items():
        total = F.lit(w[k]) * c if total is None else total + F.lit(w[k]) * c
    return scored.withColumns(
        {
            "risk_score": F.bround(100 * total, 2),
            "risk_components": F.struct(*[F.bround(c, 4).alias(k) for k, c in parts.items()]),
        }
    )


def score_risk(scored: DataFrame, threshold: float, weights: dict[str, float] = RISK_WEIGHTS) -> DataFrame:
    """History, then risk, for every scored sequence."""
    flagged = scored.withColumn("alerted", F.col("p") >= threshold)
    return add_risk(recent_alerts(flagged), threshold, weights)


def iso(column: Column) -> Column:
    """ISO text without a zone; microseconds only when there are any."""
    whole = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss")
    micro = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.when(F.unix_micros(column.cast("timestamp")) % MICROS == 0, whole).otherwise(micro)


def alert_rows(
    risky: DataFrame,
    threshold: float,
    session_id: str,
    model_version: str,
    lr_threshold: float = 0.5,
    confidence_threshold: float = 0.5,
    created_at: Column | None = None,
) -> DataFrame:
    """Alert table of every row with ``p >= threshold``, ids not yet assigned."""
    hits = risky.filter(F.col("p") >= threshold)

    def have(name, ddl, default=None):
        return F.col(name).cast(ddl) if name in risky.columns else F.lit(default).cast(ddl)

    confidence = F.coalesce(have("confidence", "double"), F.col("p"))
    created = created_at if created_at is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return hits.select(
        F.lit(session_id).alias("session_id"),
        "sequence_id",
        "host_id",
        iso(F.col("seq_end_time")).alias("predicted_at"),
        iso(F.col("target_window_start")).alias("target_window_start"),
        iso(F.col("target_window_end")).alias("target_window_end"),
        F.col("p").alias("model_probability"),
        F.lit(float(threshold)).alias("model_threshold"),
        have("lr_p", "double").alias("lr_probability"),
        F.lit(float(lr_threshold)).alias("lr_threshold"),
        (have("lr_p", "double") >= lr_threshold).cast("int").alias("lr_flag"),
        have("rule", "int").alias("reference_rule_flag"),
        "risk_score",
        F.to_json("risk_components").alias("risk_components"),
        confidence.alias("confidence"),
        F.when(confidence < confidence_threshold, UNCERTAIN).otherwise("LIKELY_ATTACK").alias("confidence_label"),
        "predicted_stage",
        have("target_attack_present", "int").alias("truth_attack"),
        have("target_dominant_class", "string").alias("truth_class"),
        have("target_dominant_stage", "string").alias("truth_stage"),
        F.lit(model_version).alias("model_version"),
        created.alias("created_at"),
    )


def assign_ids(alerts: DataFrame, after: int = 0) -> DataFrame:
    """Consecutive ids from ``after + 1`` in processing order (target start, host, sequence)."""
    start = F.unix_micros(F.col("target_window_start").cast("timestamp"))
    rows = alerts.withColumns({"_all": F.lit(1), "_t": start})
    order = ["_t", "host_id", "predicted_at", "sequence_id"]
    numbered = row_index(rows, ["_all"], order, F.floor(F.col("_t") / (3600 * MICROS)), "id")
    return numbered.withColumn("id", F.col("id") + after + 1).drop("_all", "_t")


# --- views over scored rows and alerts -----------------------------------------------------


def _tie(risky: DataFrame) -> list[str]:
    """What orders rows of a host that are equal in both times, so that reruns agree."""
    return [c for c in ("sequence_id",) if c in risky.columns]


def host_rollup(risky: DataFrame) -> DataFrame:
    """Per host: sequences, alerts, latest and highest risk, last seen, level."""
    latest = F.struct("target_window_start", "seq_start_time", *_tie(risky))
    return (
        risky.groupBy("host_id")
        .agg(
            F.count(F.lit(1)).alias("sequences"),
            F.count(F.when(F.col("alerted"), 1)).alias("alerts"),
            F.max("risk_score").alias("max_risk"),
            F.max_by("risk_score", latest).alias("latest_risk"),
            F.max_by(F.round("p", 4), latest).alias("latest_p"),
            F.max("target_window_start").alias("last_seen"),
        )
        .withColumn("level", risk_level(F.col("latest_risk")))
    )


def host_list(risky: DataFrame) -> DataFrame:
    return host_rollup(risky).orderBy(F.desc("alerts"), F.desc("latest_risk"), "host_id")


def timelines(risky: DataFrame, points: int = TIMELINE_POINTS) -> DataFrame:
    """Last ``points`` risk points per host (500 by default), oldest first.

    ``row_number <= n`` is limited per task before the shuffle, so a busy host sends little.
    """
    order = [F.desc(c) for c in ("target_window_start", "seq_start_time", *_tie(risky))]
    newest = W.partitionBy("host_id").orderBy(*order)
    kept = risky.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= points)
    point = F.struct((-F.col("_n")).alias("o"), F.col("target_window_start").alias("t"), "risk_score", F.round("p", 4).alias("p"), "alerted")
    return kept.groupBy("host_id").agg(
        F.transform(
            F.array_sort(F.collect_list(point)),
            lambda x: F.struct(x["t"].alias("t"), x["risk_score"].alias("risk"), x["p"].alias("p"), x["alerted"].alias("alerted")),
        ).alias("timeline")
    )


def host_detail(risky: DataFrame, alerts: DataFrame, host_id: str, session_id: str | None = None, limit: int = 200):
    """One host: its roll-up row with timeline, and its newest alerts (200 by default)."""
    mine = risky.filter(F.col("host_id") == host_id)
    detail = host_rollup(mine).join(timelines(mine), "host_id")
    return detail, list_alerts(alerts, limit=limit, host_id=host_id, session_id=session_id)


def replay_totals(risky: DataFrame) -> DataFrame:
    """Processed rows, alerts, alerts that match the attack label, hosts, time range."""
    per = risky.groupBy("host_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("alerted"), 1)).alias("a"),
        F.count(F.when(F.col("alerted") & (F.col("target_attack_present") == 1), 1)).alias("m"),
        F.min("target_window_start").alias("lo"),
        F.max("target_window_start").alias("hi"),
    )
    return per.agg(
        F.sum("n").alias("processed"),
        F.sum("a").alias("alerts_emitted"),
        F.sum("m").alias("alerts_matching_attack_label"),
        F.count(F.lit(1)).alias("hosts_seen"),
        F.min("lo").alias("first_time"),
        F.max("hi").alias("last_time"),
    )


def list_alerts(
    alerts: DataFrame, limit: int = 100, offset: int = 0, host_id: str | None = None, session_id: str | None = None
) -> DataFrame:
    """Newest first, with optional equality filters. Any page size is served; the default is 100."""
    if limit < 1 or offset < 0:
        raise ValueError("a page has at least one row and starts at or after the first")
    if host_id is not None:
        alerts = alerts.filter(F.col("host_id") == host_id)
    if session_id is not None:
        alerts = alerts.filter(F.col("session_id") == session_id)
    return alerts.orderBy(F.desc("id")).offset(offset).limit(limit)


def get_alert(alerts: DataFrame, alert_id: int) -> DataFrame:
    return alerts.filter(F.col("id") == alert_id)


def sessions(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("alerts"), F.min("id").alias("first_id"), F.max("id").alias("last_id")
    ).orderBy("first_id")
