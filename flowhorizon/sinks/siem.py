"""Alert export as CEF, RFC 5424 syslog or JSON lines: one text column, built in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.lookups import UNCERTAIN
from ..functions.scalars import cef_extension, cef_header, epoch_millis, severity

VENDOR = "FlowHorizon"
PRODUCT = "FlowHorizon Forecaster"
SIGNATURE = "flow-forecast"
EVENT_NAME = "Predicted attack in next window"
FORMATS = ("cef", "syslog", "jsonl")

# fixed values: extension key -> alert column or constant label, in output order
CEF_EXTENSIONS = [
    ("rt", "predicted_at", "time"),
    ("src", "host_id", "text"),
    ("externalId", "id", "text"),
    ("cfp1", "model_probability", "text"),
    ("cfp1Label", "attackProbability", "label"),
    ("cn1", "risk_score", "text"),
    ("cn1Label", "riskScore", "label"),
    ("cs1", "predicted_stage", "stage"),
    ("cs1Label", "predictedStage", "label"),
    ("cs2", "hash", "text"),
    ("cs2Label", "ledgerHash", "label"),
    ("cs3", "sequence_id", "text"),
    ("cs3Label", "sequenceId", "label"),
    ("cs4", "model_version", "text"),
    ("cs4Label", "modelVersion", "label"),
    ("start", "target_window_start", "time"),
    ("end", "target_window_end", "time"),
]


def _field(alerts: DataFrame, name: str) -> Column:
    return F.col(name) if name in alerts.columns else F.lit(None)


def cef_line(alerts: DataFrame, version: str = "0.1.0", vendor: str = VENDOR, product: str = PRODUCT) -> Column:
    parts = []
    for key, source, kind in CEF_EXTENSIONS:
        if kind == "label":
            value = F.lit(source)
        elif kind == "time":
            value = epoch_millis(_field(alerts, source)).cast("string")
        elif kind == "stage":
            value = F.coalesce(F.nullif(_field(alerts, source).cast("string"), F.lit("")), F.lit(UNCERTAIN))
        else:
            value = _field(alerts, source).cast("string")
        # concat is NULL when the value is NULL, and concat_ws skips it
        parts.append(F.concat(F.lit(f"{key}="), cef_extension(value)))
    head = [F.lit("CEF:0"), F.lit(vendor), F.lit(product), F.lit(version), F.lit(SIGNATURE), F.lit(EVENT_NAME)]
    head.append(severity(_field(alerts, "risk_score").cast("double")).cast("string"))
    return F.concat(F.concat_ws("|", *[cef_header(h) for h in head]), F.lit("|"), F.concat_ws(" ", *parts))


def syslog_line(alerts: DataFrame, hostname: str = "flowhorizon", version: str = "0.1.0") -> Column:
    """Facility local4; crit, err, warning or notice by severity; CEF as the message."""
    sev = severity(_field(alerts, "risk_score").cast("double"))
    level = F.when(sev >= 8, 2).when(sev >= 6, 3).when(sev >= 4, 4).otherwise(5)
    created = F.coalesce(
        _field(alerts, "created_at").cast("string"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'+00:00'"),
    )
    pri = (F.lit(160) + level).cast("string")
    return F.concat(
        F.lit("<"), pri, F.lit(">1 "), created, F.lit(f" {hostname} flowhorizon - alert - "), cef_line(alerts, version)
    )


def json_line(alerts: DataFrame, module: str = "flowhorizon") -> Column:
    """Nested event document. Fields are declared in key order, so keys come out sorted."""

    def col(name, alias):
        return _field(alerts, name).alias(alias)

    def text(name, alias):
        return _field(alerts, name).cast("string").alias(alias)

    components = _field(alerts, "risk_components")
    if "risk_components" in alerts.columns and alerts.schema["risk_components"].dataType.typeName() == "string":
        components = F.from_json(components, "map<string,double>")
    document = F.struct(
        text("predicted_at", "@timestamp"),
        F.struct(
            text("target_window_end", "end"),
            col("hash", "hash"),
            col("id", "id"),
            F.lit("alert").alias("kind"),
            F.lit(module).alias("module"),
            col("risk_score", "risk_score"),
            severity(_field(alerts, "risk_score").cast("double")).alias("severity"),
            text("target_window_start", "start"),
        ).alias("event"),
        F.struct(
            col("model_probability", "attack_probability"),
            col("model_version", "model_version"),
            col("predicted_stage", "predicted_stage"),
            col("prev_hash", "prev_hash"),
            components.alias("risk_components"),
            col("sequence_id", "sequence_id"),
            col("model_threshold", "threshold"),
        ).alias(module),
        F.struct(col("host_id", "ip")).alias("source"),
    )
    return F.to_json(document, {"ignoreNullFields": "false"})


def render(alerts: DataFrame, fmt: str, **options) -> DataFrame:
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    line = {"cef": cef_line, "syslog": syslog_line, "jsonl": json_line}[fmt](alerts, **options)
    return alerts.select(*(["id"] if "id" in alerts.columns else []), line.alias("value"))


def alerts_since(alerts: DataFrame, since_id: int = 0, limit: int = 1000) -> DataFrame:
    """Page of ``limit`` alerts after an id, oldest first; any page size is served, 1000 by default."""
    if limit < 1:
        raise ValueError("a page has at least one row")
    return alerts.filter(F.col("id") > since_id).orderBy("id").limit(limit)


def export_text(alerts: DataFrame, fmt: str, path: str, **options) -> None:
    """Write all lines, one text file per task; ids stay in order inside a file."""
    render(alerts.sortWithinPartitions("id"), fmt, **options).select("value").write.mode("overwrite").text(path)
