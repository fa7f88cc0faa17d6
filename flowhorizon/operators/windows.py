"""Host x sliding-window aggregation.

All window measures come out of two aggregations. The first counts flows per
(host, window, dimension, value), where the dimensions are labels, destination addresses,
destination ports, source ports and seconds; additive measures ride on the label rows. The second
folds those counts per (host, window). Distinct counts, port entropy and the burst maximum are then
plain sums and maxima: no set or list of raw flows is ever held for one window, both shuffles
combine on the map side, and a host that owns a third of the traffic is spread by its values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.scalars import clip, counts_json
from ..plans.grid import assign_windows, at_micros, check_grid, origin_column

# flow column -> [(window column, aggregate)]
BASE_MEASURES = {
    "packet_count": [("packet_count_sum", "sum"), ("packet_count_mean", "mean")],
    "byte_count": [("byte_count_sum", "sum"), ("byte_count_mean", "mean")],
    "flow_duration": [("duration_mean", "mean"), ("duration_total", "sum")],
}
OPTIONAL_MEASURES = {
    "packets_per_second": [("packets_per_second_mean", "mean")],
    "bytes_per_second": [("bytes_per_second_mean", "mean")],
    "bytes_per_packet": [("bytes_per_packet_mean", "mean")],
    "packet_size_mean": [("packet_size_mean", "mean")],
    "packet_size_std": [("packet_size_std_mean", "mean")],
    "packet_size_min": [("packet_size_min", "min")],
    "packet_size_max": [("packet_size_max", "max")],
    "inter_arrival_mean": [("inter_arrival_mean", "mean")],
    "inter_arrival_std": [("inter_arrival_std_mean", "mean")],
    "syn_count": [("syn_count_sum", "sum")],
    "ack_count": [("ack_count_sum", "sum")],
    "rst_count": [("rst_count_sum", "sum")],
    "fin_count": [("fin_count_sum", "sum")],
    "psh_count": [("psh_count_sum", "sum")],
    "urg_count": [("urg_count_sum", "sum")],
    "tcp_window_size": [("tcp_window_size_mean", "mean")],
}
RATIO_FLAGS = ["syn", "ack", "rst", "fin", "psh"]
# dimensions of the first aggregation
LABEL, DST_IP, DST_PORT, SRC_PORT, SECOND = range(5)


def _measures(flows: DataFrame) -> dict[str, list[tuple[str, str]]]:
    extra = {c: m for c, m in OPTIONAL_MEASURES.items() if c in flows.columns}
    return {**{c: m for c, m in BASE_MEASURES.items() if c in flows.columns}, **extra}


def _partials(measures, source) -> list[Column]:
    """Mergeable partial aggregates for the wanted measures; ``source`` maps a name to a column."""
    out = []
    for c, wanted in measures.items():
        kinds = {k for _, k in wanted}
        if kinds & {"sum", "mean"}:
            out.append(F.sum(source("s", c)).alias(f"s_{c}"))
        if "mean" in kinds:
            out.append(source("c", c).alias(f"c_{c}"))
        if "min" in kinds:
            out.append(F.min(source("lo", c)).alias(f"lo_{c}"))
        if "max" in kinds:
            out.append(F.max(source("hi", c)).alias(f"hi_{c}"))
    return out


def _long_rows(flows: DataFrame, group_by: str, origin: Column, measures, keep: list[str] = ()) -> DataFrame:
    """One row per (flow, dimension) with a value; offsets are microseconds from the grid origin."""

    def label(c, default):
        col = F.col(c).cast("string") if c in flows.columns else F.lit(None).cast("string")
        return F.coalesce(col, F.lit(default))

    def num(c):
        return F.col(c).cast("bigint") if c in flows.columns else F.lit(None).cast("bigint")

    micros = F.unix_micros(F.col("timestamp").cast("timestamp"))
    none_s, none_n = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    values = [
        (LABEL, none_n, label("dataset_label", "BENIGN")),
        (DST_IP, none_n, F.col("destination_ip").cast("string")),
        (DST_PORT, num("destination_port"), none_s),
        (SRC_PORT, num("source_port"), none_s),
        (SECOND, F.floor(micros / F.lit(1_000_000)).cast("bigint"), none_s),
    ]
    flat = [c for code, number, text in values for c in (F.lit(code), number, text)]
    base = flows.filter(F.col("timestamp").isNotNull() & F.col(group_by).isNotNull())
    long = base.select(
        F.col(group_by).cast("string").alias("host_id"),
        *keep,
        (micros - origin).alias("_off"),
        label("normalized_attack_class", "Benign").alias("cls"),
        label("attack_stage", "Benign").alias("stg"),
        *[F.col(c).cast("double").alias(f"m_{c}") for c in measures],
        F.stack(F.lit(len(values)), *flat).alias("dim", "num", "txt"),
    ).filter(F.col("num").isNotNull() | F.col("txt").isNotNull())

    def on_label(c):
        return F.when(F.col("dim") == LABEL, F.col(c))

    return long.select(
        "host_id", *keep, "_off", "dim", "num", "txt", on_label("cls").alias("cls"), on_label("stg").alias("stg"),
        *[on_label(f"m_{c}").alias(c) for c in measures],
    )


VALUE_KEYS = ["dim", "num", "txt", "cls", "stg"]


def _count_values(rows: DataFrame, key: str, measures) -> DataFrame:
    """First aggregation: per (host, window or pane, dimension value)."""

    def raw(kind, c):
        return F.count(c) if kind == "c" else F.col(c)

    return rows.groupBy("host_id", key, *VALUE_KEYS).agg(F.count(F.lit(1)).alias("n"), *_partials(measures, raw))


def _merge_values(rows: DataFrame, key: str, measures) -> DataFrame:
    def part(kind, c):
        return F.sum(f"c_{c}") if kind == "c" else F.col(f"{kind}_{c}")

    return rows.groupBy("host_id", key, *VALUE_KEYS).agg(F.sum("n").alias("n"), *_partials(measures, part))


def value_counts_by_window(
    flows: DataFrame, window_us: int, stride_us: int, group_by: str, origin: Column, panes: bool
) -> DataFrame:
    """(host, window, dimension value) counts, directly or through panes one stride long."""
    measures = _measures(flows)
    long = _long_rows(flows, group_by, origin, measures)
    if not panes:
        return _count_values(
            assign_windows(long, F.col("_off"), window_us, stride_us), "window_idx", measures
        )
    paned = long.withColumn("_pane", F.floor(F.col("_off") / F.lit(stride_us)).cast("bigint"))
    counted = _count_values(paned, "_pane", measures)
    spread = assign_windows(counted, F.col("_pane") * F.lit(stride_us), window_us, stride_us)
    return _merge_values(spread, "window_idx", measures)


def _per_name(labels: Column, field: str) -> Column:
    """``array<struct<name, n>>``: flows per distinct name. Usually one label, so that case is direct."""

    def count_of(x):
        hits = F.filter(labels, lambda e: e[field] == x)
        return F.aggregate(hits, F.lit(0).cast("bigint"), lambda acc, e: acc + e["n"])

    names = F.array_distinct(F.transform(labels, lambda e: e[field]))
    one = F.array(F.struct(labels[0][field].alias("name"), labels[0]["n"].alias("n")))
    many = F.transform(names, lambda x: F.struct(x.alias("name"), count_of(x).alias("n")))
    return F.when(F.size(labels) == 1, one).otherwise(many)


def _most_frequent(counts: Column) -> Column:
    """Highest count, alphabetical on ties; NULL for an empty list."""
    return F.array_min(F.transform(counts, lambda e: F.struct((-e["n"]).alias("rank"), e["name"].alias("name"))))["name"]


def _attacks(counts: Column) -> Column:
    return F.filter(counts, lambda e: F.lower(e["name"]) != "benign")


def host_windows(
    flows: DataFrame,
    window_seconds: float = 60,
    stride_seconds: float = 30,
    min_flows: int = 1,
    group_by: str = "source_ip",
    origin=None,
    panes: bool | None = None,
) -> DataFrame:
    """One row per (host, window) that holds at least ``min_flows`` flows.

    ``origin`` defaults to the earliest flow. ``panes`` counts flows once per stride-long pane and
    combines panes into windows; it needs a whole number of strides per window and is then the default.
    """
    window_us, stride_us = check_grid(window_seconds, stride_seconds)
    if min_flows < 1:
        raise ValueError("min_flows must be at least 1")
    if group_by not in flows.columns:
        raise ValueError(f"host column {group_by!r} is not in the table")
    whole = window_us % stride_us == 0
    if panes is None:
        panes = whole
    elif panes and not whole:
        raise ValueError("panes need a window that is a whole number of strides")
    start = origin_column(flows, origin)
    counts = value_counts_by_window(flows, window_us, stride_us, group_by, start, panes)
    return fold_windows(counts, _measures(flows), start, window_us, stride_us, min_flows)


def measure_columns(measures, of) -> list[Column]:
    """The window columns of the measures; ``of`` gives sum (s), count (c), least (lo) and greatest (hi) of a measure."""
    out = []
    for c, wanted in measures.items():
        for name, kind in wanted:
            if kind == "sum":
                col = F.coalesce(of["s"](c), F.lit(0.0))
            elif kind == "mean":
                col = of["s"](c) / F.nullif(of["c"](c), F.lit(0))
            else:
                col = of["lo" if kind == "min" else "hi"](c)
            out.append(col.alias(name))
    return out


def fold_windows(
    counts: DataFrame,
    measures,
    origin: Column,
    window_us: int,
    stride_us: int,
    min_flows: int = 1,
) -> DataFrame:
    """Second aggregation: dimension counts to one row per (host, window)."""
    n = F.col("n")

    def on(code, value):
        return F.when(F.col("dim") == code, value)

    port_n, port_nlogn = F.sum(on(DST_PORT, n)), F.sum(on(DST_PORT, n * F.log2(n)))
    aggs = [
        F.sum(on(LABEL, n)).alias("flow_count"),
        F.count(on(DST_IP, n)).alias("unique_destination_ips"),
        F.count(on(DST_PORT, n)).alias("unique_destination_ports"),
        F.count(on(SRC_PORT, n)).alias("unique_source_ports"),
        F.coalesce(F.greatest(F.log2(port_n) - port_nlogn / port_n, F.lit(0.0)), F.lit(0.0)).alias(
            "destination_port_entropy"
        ),
        F.coalesce(F.max(on(SECOND, n)).cast("double"), F.lit(1.0)).alias("connection_burst_max"),
        # at most one entry per label of the mapping table
        F.collect_list(on(LABEL, F.struct(F.col("txt").alias("raw"), "cls", "stg", "n"))).alias("_labels"),
    ]
    aggs += measure_columns(
        measures, {"s": lambda c: F.sum(f"s_{c}"), "c": lambda c: F.sum(f"c_{c}"), "lo": lambda c: F.min(f"lo_{c}"), "hi": lambda c: F.max(f"hi_{c}")}
    )
    out = counts.groupBy("host_id", "window_idx").agg(*aggs)
    if min_flows > 1:
        out = out.filter(F.col("flow_count") >= min_flows)
    return describe_windows(out, measures, origin, window_us, stride_us)


def describe_windows(out: DataFrame, measures, origin: Column, window_us: int, stride_us: int) -> DataFrame:
    """Times, ratios and label summaries of folded windows, from their sums and ``_labels``, one entry per label."""
    names = {name for wanted in measures.values() for name, _ in wanted}
    packets = F.greatest(F.col("packet_count_sum"), F.lit(1.0))
    labels = F.col("_labels")
    out = out.withColumns({f"_{f}": _per_name(labels, f) for f in ("raw", "cls", "stg")})
    out = out.withColumns({"_acls": _attacks(F.col("_cls")), "_astg": _attacks(F.col("_stg"))})
    attack_n = F.aggregate("_acls", F.lit(0).cast("bigint"), lambda a, e: a + e["n"])
    ratios = {
        f"{f}_ratio": clip(F.col(f"{f}_count_sum") / packets, 0.0, 1.0) if f"{f}_count_sum" in names else F.lit(0.0)
        for f in RATIO_FLAGS
    }
    out = out.withColumns(
        {
            "window_start": at_micros(origin + F.col("window_idx") * stride_us),
            "window_end": at_micros(origin + F.col("window_idx") * stride_us + window_us),
            **ratios,
            "communication_fan_out": F.col("unique_destination_ips") / F.col("flow_count"),
            "_share": attack_n / F.col("flow_count"),
            "dominant_dataset_label": _most_frequent(F.col("_raw")),
            "dominant_class": F.coalesce(_most_frequent(F.col("_acls")), F.lit("Benign")),
            "dominant_stage": F.coalesce(_most_frequent(F.col("_astg")), F.lit("Benign")),
            "stage_counts": F.map_from_entries("_stg"),
            "stage_distribution": counts_json(F.col("_stg")),
        }
    )
    share = F.col("_share")
    return out.withColumns(
        {
            "attack_flow_ratio": share,
            "benign_flow_ratio": 1.0 - share,
            "attack_present": (share > 0).cast("int"),
            "label_confidence": F.when(share > 0, "inferred").otherwise("ground_truth"),
        }
    ).drop("_labels", "_raw", "_cls", "_stg", "_acls", "_astg", "_share")


def port_shares(
    flows: DataFrame, window_seconds: float = 60, stride_seconds: float = 30, group_by: str = "source_ip", origin=None
) -> DataFrame:
    """Flows per (host, window, destination port) and the port's share of the window's flows.

    The group total runs over port counts, so a group has at most one row per port number.
    """
    window_us, stride_us = check_grid(window_seconds, stride_seconds)
    start = origin_column(flows, origin)
    rows = flows.filter(F.col("destination_port").isNotNull()).select(
        F.col(group_by).cast("string").alias("host_id"),
        "destination_port",
        (F.unix_micros(F.col("timestamp").cast("timestamp")) - start).alias("_off"),
    )
    keys = ["host_id", "window_idx"]
    counts = (
        assign_windows(rows, F.col("_off"), window_us, stride_us)
        .groupBy(*keys, "destination_port")
        .agg(F.count(F.lit(1)).alias("flows"))
    )
    total = F.sum("flows").over(W.partitionBy(*keys))
    return counts.withColumn("share", F.col("flows") / total)


def label_matrix(
    flows: DataFrame,
    names: list[str],
    column: str = "attack_stage",
    window_seconds: float = 60,
    stride_seconds: float = 30,
    group_by: str = "source_ip",
    origin=None,
    default: str = "Benign",
) -> DataFrame:
    """Wide count matrix per (host, window): one column per listed name, zero where absent."""
    window_us, stride_us = check_grid(window_seconds, stride_seconds)
    start = origin_column(flows, origin)
    rows = flows.select(
        F.col(group_by).cast("string").alias("host_id"),
        F.coalesce(F.col(column), F.lit(default)).alias("_name"),
        (F.unix_micros(F.col("timestamp").cast("timestamp")) - start).alias("_off"),
    )
    assigned = assign_windows(rows, F.col("_off"), window_us, stride_us)
    return assigned.groupBy("host_id", "window_idx").pivot("_name", names).count().fillna(0, subset=names)
