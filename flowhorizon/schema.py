"""The canonical flow schema and its checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

REQUIRED = {
    "timestamp": "timestamp",
    "source_ip": "string",
    "destination_ip": "string",
    "source_port": "int",
    "destination_port": "int",
    "protocol": "string",
    "flow_duration": "double",
    "packet_count": "double",
    "byte_count": "double",
    "dataset_label": "string",
}
OPTIONAL = {
    name: "double"
    for name in (
        "packet_size_mean", "packet_size_std", "packet_size_min", "packet_size_max",
        "inter_arrival_mean", "inter_arrival_std",
        "syn_count", "ack_count", "rst_count", "fin_count", "psh_count", "urg_count",
        "ttl_mean", "ttl_std", "tcp_window_size", "retransmission_count",
        "fwd_packet_count", "bwd_packet_count", "fwd_byte_count", "bwd_byte_count",
    )
}
DERIVED = {
    "normalized_attack_class": "string",
    "attack_stage": "string",
    "label_confidence": "string",
    "source_dataset": "string",
}
ALL_COLUMNS = {**REQUIRED, **OPTIONAL, **DERIVED}
NUMERIC = [c for c, t in {**REQUIRED, **OPTIONAL}.items() if t == "double"]
FLOW_KEY = ["timestamp", "source_ip", "destination_ip", "source_port", "destination_port", "protocol"]

COMMENTS = {
    "timestamp": "start of the flow, naive clock of the capture site",
    "flow_duration": "seconds",
    "byte_count": "bytes in both directions",
    "dataset_label": "label exactly as the source gives it",
    "inter_arrival_mean": "microseconds between packets",
    "ttl_mean": "NULL unless the source decodes packets",
    "ttl_std": "NULL unless the source decodes packets",
    "retransmission_count": "NULL unless the source decodes packets",
    "label_confidence": "ground_truth or inferred",
}


class FlowSchemaError(ValueError):
    """A table does not follow the canonical flow schema."""


def flow_schema(extra: dict[str, str] | None = None) -> T.StructType:
    """Struct type of the canonical columns, with their comments as metadata."""
    fields = []
    for name, ddl in {**ALL_COLUMNS, **(extra or {})}.items():
        meta = {"comment": COMMENTS[name]} if name in COMMENTS else {}
        fields.append(T.StructField(name, T.DataType.fromDDL(ddl), True, meta))
    return T.StructType(fields)


def empty_flows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], flow_schema())


def validate_flows(flows: DataFrame, context: str = "", check_rows: bool = True) -> DataFrame:
    """Raise FlowSchemaError on missing columns, a wrong time type, or (if asked) an empty table."""
    where = f"{context}: " if context else ""
    missing = [c for c in REQUIRED if c not in flows.columns]
    if missing:
        raise FlowSchemaError(f"{where}missing required columns {missing}")
    if not isinstance(flows.schema["timestamp"].dataType, (T.TimestampType, T.TimestampNTZType)):
        raise FlowSchemaError(f"{where}column 'timestamp' must be a timestamp")
    if check_rows and not flows.isStreaming and flows.isEmpty():
        raise FlowSchemaError(f"{where}the table has no rows")
    return flows


def nan_to_null(column):
    """Missing numbers are NULL in this library, never NaN."""
    return F.when(~F.isnan(column), column)


def coerce_flows(flows: DataFrame) -> DataFrame:
    """Add absent optional columns as NULL and cast every known column leniently.

    Columns outside the schema pass through. Values that do not parse become NULL.
    """
    have = set(flows.columns)
    out = {}
    for name, ddl in {**REQUIRED, **OPTIONAL}.items():
        if name not in have:
            if name in OPTIONAL:
                out[name] = F.lit(None).cast(ddl)
            continue
        col = F.col(name)
        if ddl == "double":
            out[name] = nan_to_null(col.try_cast("double"))
        elif ddl == "int":
            out[name] = col.try_cast("double").try_cast("int")
        elif ddl == "timestamp":
            is_text = isinstance(flows.schema[name].dataType, T.StringType)
            out[name] = F.try_to_timestamp(col) if is_text else col.cast("timestamp")
        else:
            out[name] = col.cast(ddl)
    for name, ddl in DERIVED.items():
        if name in have:
            out[name] = F.col(name).cast(ddl)
    return flows.withColumns(out)
