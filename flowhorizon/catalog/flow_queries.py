"""Queries on flows: cleaning, labels, summaries, windows and the communication graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.lookups import STAGE_ORDER, label_table, stage_rank
from ..operators import cleaning, diff, eda, graph, labels
from ..operators.cleaning import flow_features
from ..operators.windows import host_windows, label_matrix, port_shares
from . import bindings as B
from .registry import query
from .sql import S_US, W_US, r6, with_

WINDOW_DOUBLES = [
    "packet_count_sum", "packet_count_mean", "byte_count_sum", "byte_count_mean", "duration_mean", "duration_total",
    "packets_per_second_mean", "bytes_per_second_mean", "bytes_per_packet_mean", "syn_count_sum", "syn_ratio",
    "communication_fan_out", "destination_port_entropy", "connection_burst_max", "attack_flow_ratio",
    "benign_flow_ratio",
]
WINDOW_OTHERS = [
    "host_id", "window_idx", "window_start", "window_end", "flow_count", "unique_destination_ips",
    "unique_destination_ports", "unique_source_ports", "attack_present", "dominant_class", "dominant_stage",
    "dominant_dataset_label", "stage_distribution", "label_confidence",
]


@query(
    "host_windows",
    "W1 W2 W3 W4 W5 W6 J9",
    with_("win") + f"SELECT {', '.join(WINDOW_OTHERS)}, {r6(*WINDOW_DOUBLES)} FROM win",
)
def q_host_windows(spark, sf):
    flows = flow_features(B.labelled_flows(spark, sf))
    return host_windows(flows, B.WINDOW, B.STRIDE).select(*WINDOW_OTHERS, *WINDOW_DOUBLES)


@query(
    "host_windows_panes",
    "W1 W2 (panes)",
    with_("win") + f"SELECT {', '.join(WINDOW_OTHERS)}, {r6(*WINDOW_DOUBLES)} FROM win",
)
def q_host_windows_panes(spark, sf):
    flows = flow_features(B.labelled_flows(spark, sf))
    return host_windows(flows, B.WINDOW, B.STRIDE, panes=True).select(*WINDOW_OTHERS, *WINDOW_DOUBLES)


@query(
    "min_flow_windows",
    "W2 (min flows, other host column)",
    with_("flows")
    + f"""SELECT destination_ip AS host_id, k AS window_idx, count(*) AS flow_count, count(DISTINCT source_port) AS unique_source_ports
    FROM (SELECT destination_ip, source_port, unnest(generate_series(CASE WHEN off < {W_US} THEN 0 ELSE (off - {W_US}) // {S_US} + 1 END,
      off // {S_US})) AS k FROM (SELECT *, us - (SELECT min(us) FROM flows) AS off FROM flows)) GROUP BY ALL HAVING count(*) >= 2""",
)
def q_min_flow_windows(spark, sf):
    w = host_windows(B.flows(spark, sf), B.WINDOW, B.STRIDE, min_flows=2, group_by="destination_ip")
    return w.select("host_id", "window_idx", "flow_count", "unique_source_ports")


@query(
    "port_entropy",
    "W3 N2",
    with_("entropy")
    + "SELECT host_id, k_win AS window_idx, round(port_entropy, 6) + 0.0 AS destination_port_entropy FROM entropy",
)
def q_port_entropy(spark, sf):
    w = host_windows(B.flows(spark, sf), B.WINDOW, B.STRIDE)
    return w.select("host_id", "window_idx", "destination_port_entropy")


@query(
    "port_shares",
    "N2",
    with_("port_counts")
    + """SELECT host_id, k_win AS window_idx, destination_port, c AS flows, round(c / sum(c) OVER (PARTITION BY host_id, k_win), 6) AS share
    FROM port_counts""",
)
def q_port_shares(spark, sf):
    return port_shares(B.flows(spark, sf), B.WINDOW, B.STRIDE)


@query("burst_max", "W4", with_("burst") + "SELECT host_id, k_win AS window_idx, burst AS connection_burst_max FROM burst")
def q_burst_max(spark, sf):
    return host_windows(B.flows(spark, sf), B.WINDOW, B.STRIDE).select("host_id", "window_idx", "connection_burst_max")


@query(
    "window_labels",
    "W6 N1 F15",
    with_("win")
    + """SELECT host_id, window_idx, attack_present, dominant_class, dominant_stage, dominant_dataset_label, stage_distribution,
    label_confidence, round(attack_flow_ratio, 6) AS attack_flow_ratio FROM win""",
)
def q_window_labels(spark, sf):
    return host_windows(B.labelled_flows(spark, sf), B.WINDOW, B.STRIDE).select(
        "host_id", "window_idx", "attack_present", "dominant_class", "dominant_stage", "dominant_dataset_label",
        "stage_distribution", "label_confidence", "attack_flow_ratio",
    )


@query(
    "label_matrix",
    "W7",
    with_("member")
    + """SELECT host_id, k_win AS window_idx, count(*) FILTER (WHERE stg = 'Benign') AS "Benign",
    count(*) FILTER (WHERE stg = 'Impact') AS "Impact", count(*) FILTER (WHERE stg = 'Initial Access') AS "Initial Access"
    FROM member GROUP BY ALL""",
)
def q_label_matrix(spark, sf):
    names = ["Benign", "Impact", "Initial Access"]
    return label_matrix(B.labelled_flows(spark, sf), names, "attack_stage", B.WINDOW, B.STRIDE)


FEATURES = ["packets_per_second", "bytes_per_second", "bytes_per_packet", "syn_ratio"]


@query(
    "flow_features",
    "C5 C6",
    with_("flows")
    + """SELECT ts AS "timestamp", source_ip, destination_ip, source_port, destination_port, protocol,
    round(packet_count / greatest(flow_duration, 1e-6), 4) AS packets_per_second,
    round(byte_count / greatest(flow_duration, 1e-6), 4) AS bytes_per_second,
    round(byte_count / greatest(packet_count, 1.0), 4) AS bytes_per_packet,
    round(least(greatest(syn_count / greatest(packet_count, 1.0), 0.0), 1.0), 4) AS syn_ratio FROM flows""",
    digits=4,
)
def q_flow_features(spark, sf):
    return cleaning.prepare_flows(B.flows(spark, sf)).select(*cleaning.FLOW_KEY, *FEATURES)


# --- cleaning: a damaged copy of the flows, every fault decided by the event id --------------

DIRTY_SQL = """SELECT CASE WHEN event_id % 97 = 0 THEN NULL ELSE date_trunc('hour', ts) END AS "timestamp",
  CASE WHEN event_id % 89 = 0 THEN NULL WHEN event_id % 83 = 0 THEN '' ELSE source_ip END AS source_ip,
  CASE WHEN event_id % 79 = 0 THEN '' ELSE destination_ip END AS destination_ip,
  source_port // 40 AS source_port, destination_port // 40 AS destination_port, protocol,
  CASE WHEN event_id % 73 = 0 THEN -1.0 WHEN event_id % 71 = 0 THEN NULL ELSE flow_duration END AS flow_duration,
  CASE WHEN event_id % 67 = 0 THEN CAST('infinity' AS DOUBLE) ELSE byte_count END AS byte_count, event_id
  FROM flows, generate_series(0, CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END) g(copy)"""
REASON_SQL = """CASE WHEN "timestamp" IS NULL THEN 'missing_timestamp'
  WHEN source_ip IS NULL OR source_ip = '' THEN 'missing_source_ip'
  WHEN destination_ip IS NULL OR destination_ip = '' THEN 'missing_destination_ip'
  WHEN flow_duration < 0 THEN 'negative_duration' WHEN isinf(byte_count) THEN 'infinite_values' END"""
KEY_SQL = '"timestamp", source_ip, destination_ip, source_port, destination_port, protocol'


def dirty_flows(spark, sf):
    e = B.table(spark, sf, "events").select("event_id", "ts", "user_id", "value", "props", "event_type")
    k = F.get_json_object("props", "$.k").cast("int")
    i = F.col("event_id")

    def hit(n):
        return i % n == 0

    copies = F.explode(F.sequence(F.lit(0), F.when(hit(10), 1).otherwise(0)))
    host = F.concat(F.lit("h"), F.col("user_id").cast("string"))
    peer = F.concat(F.lit("h"), ((F.col("user_id") + k) % B.HOSTS).cast("string"))
    return e.withColumn("copy", copies).select(
        F.when(~hit(97), F.date_trunc("hour", F.col("ts").cast("timestamp"))).alias("timestamp"),
        F.when(hit(89), None).when(hit(83), "").otherwise(host).alias("source_ip"),
        F.when(hit(79), "").otherwise(peer).alias("destination_ip"),
        F.floor((1024 + k) / 40).cast("int").alias("source_port"),
        F.floor(k / 40).cast("int").alias("destination_port"),
        F.when(k % 3 == 0, "UDP").otherwise("TCP").alias("protocol"),
        F.when(hit(73), -1.0).when(hit(71), None).otherwise(F.col("value") / 10).alias("flow_duration"),
        F.when(hit(67), float("inf")).otherwise(F.col("value") * 100).alias("byte_count"),
        "event_id",
    )


@query(
    "clean_flows",
    "C3 O7",
    with_("flows", dirty=DIRTY_SQL)
    + f"""SELECT {KEY_SQL}, round(coalesce(flow_duration, -9), 6) AS flow_duration, round(byte_count, 6) AS byte_count, event_id
    FROM (SELECT *, {REASON_SQL} AS reason FROM dirty) WHERE reason IS NULL
    QUALIFY row_number() OVER (PARTITION BY {KEY_SQL} ORDER BY event_id) = 1""",
)
def q_clean_flows(spark, sf):
    out = cleaning.clean_flows(dirty_flows(spark, sf), order_by=["event_id"])
    return out.withColumn("flow_duration", F.coalesce("flow_duration", F.lit(-9.0)))


@query(
    "drop_report",
    "C4",
    with_("flows", dirty=DIRTY_SQL, marked=f"SELECT *, {REASON_SQL} AS reason FROM dirty",
          kept=f"SELECT DISTINCT {KEY_SQL} FROM marked WHERE reason IS NULL")
    + """SELECT 'rows_in' AS reason, count(*) AS rows FROM marked
    UNION ALL SELECT r, (SELECT count(*) FROM marked WHERE reason = r) FROM unnest(['missing_timestamp', 'missing_source_ip',
      'missing_destination_ip', 'negative_duration', 'infinite_values']) t(r)
    UNION ALL SELECT 'exact_duplicate_flow', (SELECT count(*) FROM marked WHERE reason IS NULL) - (SELECT count(*) FROM kept)
    UNION ALL SELECT 'rows_out', (SELECT count(*) FROM kept)""",
)
def q_drop_report(spark, sf):
    return cleaning.cleaning_report(dirty_flows(spark, sf))


@query(
    "ingest_summary",
    "K2",
    with_("flows", dirty=DIRTY_SQL, marked=f"SELECT *, {REASON_SQL} AS reason FROM dirty",
          kept=f"SELECT DISTINCT {KEY_SQL} FROM marked WHERE reason IS NULL")
    + """SELECT (SELECT count(*) FROM marked) AS rows_raw, (SELECT count(*) FROM kept) AS rows_clean,
      (SELECT count(*) FROM marked WHERE reason = 'missing_source_ip') AS missing_source_ip, (SELECT count(*) FROM marked WHERE reason = 'negative_duration') AS negative_duration,
      (SELECT count(*) FROM marked WHERE reason IS NULL) - (SELECT count(*) FROM kept) AS exact_duplicate_flow, 5 AS sample_size""",
)
def q_ingest_summary(spark, sf):
    """The summary an ingest stores, read back for the table it belongs to; for a table of another size there is none."""
    from ..sinks.tables import read_ingest_summary, write_ingest_summary

    folder, report = B.scratch(spark, "summary"), cleaning.cleaning_report(dirty_flows(spark, sf))
    write_ingest_summary(report, folder, 5)
    clean = report.filter("reason = 'rows_out'").first()["rows"]
    found = read_ingest_summary(spark, folder, clean).unionByName(read_ingest_summary(spark, folder, clean + 1))
    drop = lambda name: F.element_at("dropped_by_reason", name).alias(name)
    return found.select("rows_raw", "rows_clean", drop("missing_source_ip"), drop("negative_duration"), drop("exact_duplicate_flow"), "sample_size")


@query(
    "stage_mapping",
    "J1",
    with_("labelled")
    + 'SELECT ts AS "timestamp", source_ip, dataset_label, cls AS normalized_attack_class, stg AS attack_stage, conf AS label_confidence FROM labelled',
)
def q_stage_mapping(spark, sf):
    mapped = labels.apply_stage_mapping(B.flows(spark, sf), "cic_ids2017")
    return mapped.select(
        "timestamp", "source_ip", "dataset_label", "normalized_attack_class", "attack_stage", "label_confidence"
    )


@query(
    "unmapped_labels",
    "J1 O6",
    with_("label_map", seen="SELECT DISTINCT CASE WHEN event_type = 'click' THEN 'Bot' ELSE event_type END AS dataset_label FROM events")
    + "SELECT dataset_label FROM seen WHERE dataset_label NOT IN (SELECT dataset_label FROM label_map)",
)
def q_unmapped(spark, sf):
    kind = F.when(F.col("event_type") == "click", "Bot").otherwise(F.col("event_type"))
    seen = B.table(spark, sf, "events").select(kind.alias("dataset_label"))
    return labels.unmapped_labels(seen, label_table(spark, "cic_ids2017"))


@query(
    "mitre_lookup",
    "J2 O8",
    with_("labelled")
    + """SELECT stg AS stage, CASE stg WHEN 'Benign' THEN 0 WHEN 'Initial Access' THEN 2 WHEN 'Impact' THEN 6 END AS stage_rank,
    CASE stg WHEN 'Initial Access' THEN 'TA0001' WHEN 'Impact' THEN 'TA0040' ELSE 'none' END AS tactic_id,
    CASE stg WHEN 'Initial Access' THEN 'T1110,T1190' WHEN 'Impact' THEN 'T1498' ELSE '' END AS techniques, count(*) AS flows
    FROM labelled GROUP BY ALL""",
)
def q_mitre(spark, sf):
    stages = B.labelled_flows(spark, sf).groupBy("attack_stage").agg(F.count(F.lit(1)).alias("flows"))
    padded = stages.withColumn("predicted_stage", F.concat(F.lit(" "), F.upper("attack_stage"), F.lit(" ")))
    found = labels.mitre_lookup(padded)
    return found.select(
        F.col("attack_stage").alias("stage"),
        stage_rank(F.col("attack_stage")).alias("stage_rank"),
        F.coalesce("tactic_id", F.lit("none")).alias("tactic_id"),
        F.array_join(F.transform("techniques", lambda t: t["id"]), ",").alias("techniques"),
        "flows",
    )


# --- summaries -----------------------------------------------------------------------------


@query(
    "dataset_summary",
    "E1",
    with_("flows")
    + """SELECT count(*) AS rows, count(DISTINCT source_ip) AS source_hosts, count(DISTINCT destination_ip) AS destination_hosts,
    min(ts) AS first_time, max(ts) AS last_time FROM flows""",
)
def q_dataset_summary(spark, sf):
    return eda.dataset_summary(B.flows(spark, sf))


@query(
    "value_counts",
    "E1 E6",
    with_("labelled")
    + """SELECT * FROM (SELECT 'protocol' AS "column", protocol AS value, count(*) AS rows FROM labelled GROUP BY ALL
    UNION ALL SELECT 'normalized_attack_class', cls, count(*) FROM labelled GROUP BY ALL
    UNION ALL SELECT 'attack_stage', stg, count(*) FROM labelled GROUP BY ALL
    UNION ALL SELECT 'label_confidence', conf, count(*) FROM labelled GROUP BY ALL)""",
)
def q_value_counts(spark, sf):
    return eda.value_counts(B.labelled_flows(spark, sf), eda.SUMMARY_COLUMNS)


@query(
    "missing_fraction",
    "E2",
    with_("flows", dirty=DIRTY_SQL)
    + """SELECT 'timestamp' AS "column", round_even(avg(("timestamp" IS NULL)::DOUBLE), 4) AS missing_fraction FROM dirty
    UNION ALL SELECT 'source_ip', round_even(avg((source_ip IS NULL)::DOUBLE), 4) FROM dirty
    UNION ALL SELECT 'flow_duration', round_even(avg((flow_duration IS NULL)::DOUBLE), 4) FROM dirty
    UNION ALL SELECT 'byte_count', round_even(avg((byte_count IS NULL)::DOUBLE), 4) FROM dirty""",
)
def q_missing(spark, sf):
    return eda.missing_fraction(dirty_flows(spark, sf), ["timestamp", "source_ip", "flow_duration", "byte_count"])


@query(
    "hourly_volume",
    "E3 W7",
    with_("labelled")
    + """SELECT date_trunc('hour', ts) AS hour, count(*) FILTER (WHERE stg = 'Benign') AS benign_flows,
    count(*) FILTER (WHERE stg <> 'Benign') AS attack_flows FROM labelled GROUP BY ALL""",
)
def q_hourly(spark, sf):
    return eda.hourly_volume(B.labelled_flows(spark, sf))


@query(
    "crosstab",
    "E4",
    with_("labelled")
    + "SELECT dataset_label, "
    + ", ".join(f"count(*) FILTER (WHERE stg = '{s}') AS \"{s}\"" for s in STAGE_ORDER)
    + " FROM labelled GROUP BY dataset_label",
)
def q_crosstab(spark, sf):
    return eda.crosstab(B.labelled_flows(spark, sf), "dataset_label", "attack_stage", STAGE_ORDER)


@query(
    "flows_per_host",
    "E4",
    with_("flows", per="SELECT source_ip, count(*) AS n FROM flows GROUP BY ALL")
    + """SELECT count(*) AS hosts, round(avg(n), 6) AS mean_flows, round(stddev_samp(n), 6) AS std_flows, min(n) AS min_flows,
    max(n) AS max_flows, round(quantile_cont(n, 0.25), 6) AS q25, round(quantile_cont(n, 0.5), 6) AS median,
    round(quantile_cont(n, 0.75), 6) AS q75 FROM per""",
)
def q_per_host(spark, sf):
    return eda.flows_per_host(B.flows(spark, sf))


@query(
    "quality_metrics",
    "E5",
    with_("seqs", "win", f="""SELECT count(*)::DOUBLE AS rows, round_even((max(us) - min(us)) / 3.6e9, 2) AS duration_hours,
      avg((cls = 'Benign')::DOUBLE) AS benign_share, count(DISTINCT source_ip)::DOUBLE AS hosts, count(DISTINCT cls)::DOUBLE AS classes FROM labelled""",
      w="SELECT count(*)::DOUBLE AS rows, sum(attack_present)::DOUBLE AS attack FROM win",
      s="SELECT count(*)::DOUBLE AS rows, sum(target_attack_present)::DOUBLE AS attack FROM seqs")
    + """SELECT 'flows' AS tier, 'rows' AS measure, rows AS value FROM f UNION ALL SELECT 'flows', 'duration_hours', duration_hours FROM f
    UNION ALL SELECT 'flows', 'benign_share', round(benign_share, 6) FROM f UNION ALL SELECT 'flows', 'hosts', hosts FROM f
    UNION ALL SELECT 'flows', 'classes', classes FROM f
    UNION ALL SELECT 'flows', 'warn_benign_share', (benign_share > 0.95 AND classes > 1)::INT::DOUBLE FROM f
    UNION ALL SELECT 'windows', 'rows', rows FROM w UNION ALL SELECT 'windows', 'attack', attack FROM w
    UNION ALL SELECT 'windows', 'benign', rows - attack FROM w UNION ALL SELECT 'sequences', 'rows', rows FROM s
    UNION ALL SELECT 'sequences', 'attack', attack FROM s UNION ALL SELECT 'sequences', 'benign', rows - attack FROM s
    UNION ALL SELECT 'sequences', 'misaligned', 0.0 UNION ALL SELECT 'sequences', 'warn_few_positives', (attack < 100)::INT::DOUBLE FROM s
    UNION ALL SELECT 'sequences', 'warn_target_alignment', 0.0""",
)
def q_quality(spark, sf):
    from ..operators.sequences import build_sequences

    windows = B.windows(spark, sf)
    seqs = build_sequences(windows, B.LENGTH, 1, 1, B.WINDOW, B.STRIDE)
    return eda.quality_metrics(B.labelled_flows(spark, sf), windows, seqs)


# --- graph ---------------------------------------------------------------------------------

PAIRS_SQL = """SELECT DISTINCT k_win AS window_idx, least(source_ip, destination_ip) AS a, greatest(source_ip, destination_ip) AS b
  FROM member WHERE source_ip <> destination_ip"""
NEAR_SQL = "SELECT window_idx, a AS host_id, b AS peer FROM pairs UNION ALL SELECT window_idx, b, a FROM pairs"


@query("window_neighbours", "G1", with_("member", pairs=PAIRS_SQL, near=NEAR_SQL) + "SELECT * FROM near")
def q_neighbours(spark, sf):
    return graph.window_neighbours(B.flows(spark, sf), None, B.WINDOW, B.STRIDE)


@query(
    "neighbour_mean",
    "J10 G2",
    with_("win", pairs=PAIRS_SQL, near=NEAR_SQL)
    + """SELECT n.host_id, n.window_idx, count(*) AS degree, count(w.host_id) AS peers_with_features,
    round(coalesce(avg(w.flow_count), 0), 6) AS flow_count, round(coalesce(avg(w.byte_count_sum), 0), 6) AS byte_count_sum,
    round(coalesce(avg(w.destination_port_entropy), 0), 6) + 0.0 AS destination_port_entropy
    FROM near n LEFT JOIN win w ON w.host_id = n.peer AND w.window_idx = n.window_idx GROUP BY ALL""",
)
def q_neighbour_mean(spark, sf):
    windows = B.windows(spark, sf)
    near = graph.window_neighbours(B.flows(spark, sf), windows, B.WINDOW, B.STRIDE)
    out = graph.neighbour_features(near, windows)
    return out.select(
        "host_id", "window_idx", "degree", "peers_with_features", "flow_count", "byte_count_sum", "destination_port_entropy"
    )


@query(
    "graph_summary",
    "G2 G3",
    with_("runs", pairs=PAIRS_SQL, near=NEAR_SQL,
          cells="""SELECT r.host_id, r.i, m.window_idx FROM runs r JOIN numbered m ON m.host_id = r.host_id AND m.idx BETWEEN r.i AND r.last_idx""",
          near2="""SELECT n.host_id, n.window_idx, count(*) AS degree, count(w.host_id) AS have FROM near n LEFT JOIN win w
            ON w.host_id = n.peer AND w.window_idx = n.window_idx GROUP BY ALL""")
    + """SELECT round(avg(coalesce(degree, 0)), 6) AS mean_degree, round(avg((coalesce(have, 0) > 0)::DOUBLE), 6) AS share_with_neighbour_features
    FROM cells LEFT JOIN near2 USING (host_id, window_idx)""",
)
def q_graph_summary(spark, sf):
    windows = B.windows(spark, sf)
    near = graph.window_neighbours(B.flows(spark, sf), windows, B.WINDOW, B.STRIDE)
    feats = graph.neighbour_features(near, windows)
    return graph.graph_summary(graph.neighbour_sequences(windows, feats, B.LENGTH, B.STRIDE))


# --- comparison, sorting, scalars ------------------------------------------------------------


@query(
    "table_diff",
    "O4 O5",
    """SELECT o_orderpriority, left_rows, right_rows FROM (
      SELECT o_orderpriority, o_orderstatus, count(*) FILTER (WHERE side = 0) AS left_rows, count(*) FILTER (WHERE side = 1) AS right_rows
      FROM (SELECT o_orderpriority, o_orderstatus, 0 AS side FROM orders
            UNION ALL SELECT o_orderpriority, CASE WHEN o_totalprice > 400000 THEN 'X' ELSE o_orderstatus END, 1 FROM orders)
      GROUP BY ALL) WHERE left_rows <> right_rows""",
)
def q_table_diff(spark, sf):
    o = B.table(spark, sf, "orders")
    changed = o.withColumn("o_orderstatus", F.when(F.col("o_totalprice") > 400000, "X").otherwise(F.col("o_orderstatus")))
    # the table as two files, one of which lacks a column
    parts = [o.filter("o_orderkey % 2 = 0"), o.filter("o_orderkey % 2 = 1").drop("o_totalprice")]
    left, right = (d.select("o_orderpriority", "o_orderstatus") for d in (diff.union_all(parts), changed))
    return diff.table_diff(left, right).select("o_orderpriority", "left_rows", "right_rows")


@query(
    "diff_summary",
    "O5",
    """WITH a AS (SELECT * FROM orders), b AS (SELECT * REPLACE (CASE WHEN o_totalprice > 400000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus) FROM orders)
    SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS only_left,
    (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS only_right,
    (SELECT count(*) FROM a) AS left_total, (SELECT count(*) FROM b) AS right_total""",
)
def q_diff_summary(spark, sf):
    o = B.table(spark, sf, "orders")
    changed = o.withColumn("o_orderstatus", F.when(F.col("o_totalprice") > 400000, "X").otherwise(F.col("o_orderstatus")))
    return diff.diff_summary(o, changed)


@query(
    "scalar_functions",
    "F4 F5 F6 F8 F9 F10 F11 F12 F16",
    """SELECT o_orderkey, CAST(least(greatest(round_even(o_totalprice / 50000, 0), 0), 10) AS INT) AS severity,
    CASE WHEN o_totalprice / 5000 < 33 THEN 'low' WHEN o_totalprice / 5000 < 66 THEN 'medium' ELSE 'high' END AS level,
    epoch_ms(o_orderdate) AS order_ms, o_custkey % 65536 AS hex_port, o_orderkey % 1000 AS plain_port,
    'host' || o_custkey AS host, CASE o_orderkey % 4 WHEN 0 THEN 'TCP' WHEN 1 THEN 'UDP' WHEN 2 THEN 'ICMP' ELSE '47' END AS protocol,
    CASE o_orderkey % 3 WHEN 0 THEN 'Botnet' WHEN 1 THEN 'Normal' ELSE 'Background' END AS family,
    round(ln(1 + o_totalprice), 6) AS logged, round(ln(0.25 / 0.75) * (o_orderkey % 2), 6) + 0.0 AS logit_part,
    round(1 / (1 + exp(-(o_orderkey % 10) / 10.0)), 6) AS squashed FROM orders""",
)
def q_scalars(spark, sf):
    o = B.table(spark, sf, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    code = F.element_at(F.array(*[F.lit(c) for c in ("6", "17", "1", "47")]), (key % 4 + 1).cast("int"))
    text = F.element_at(
        F.array(F.lit("flow=From-Botnet-V1"), F.lit("flow=To-Normal-V2"), F.lit("flow=Background")), (key % 3 + 1).cast("int")
    )
    hexed = F.concat(F.lit(" 0X"), F.hex(cust % 65536))
    return o.select(
        "o_orderkey",
        S.severity(F.col("o_totalprice") / 5000).alias("severity"),
        S.risk_level(F.col("o_totalprice") / 5000).alias("level"),
        S.epoch_millis(F.col("o_orderdate")).alias("order_ms"),
        S.parse_port(hexed).alias("hex_port"),
        S.parse_port((key % 1000).cast("string")).alias("plain_port"),
        S.host_key(F.concat(F.lit("HOST"), cust.cast("string"), F.lit(".Example.Net"))).alias("host"),
        S.protocol_name(code, "packets").alias("protocol"),
        S.label_family(text).alias("family"),
        S.signed_log1p(S.signed_expm1(S.signed_log1p(F.col("o_totalprice")))).alias("logged"),
        (S.logit(F.lit(0.25)) * (key % 2)).alias("logit_part"),
        S.sigmoid((key % 10) / 10.0).alias("squashed"),
    )


@query(
    "time_parsing",
    "F1 F2 F3 F7",
    """SELECT o_orderkey, o_orderdate + INTERVAL 9 HOUR AS day_first, o_orderdate + INTERVAL 15 HOUR + INTERVAL 30 MINUTE AS afternoon,
    o_orderdate + INTERVAL 11 HOUR + INTERVAL 717 MILLISECOND AS local_time,
    CASE WHEN o_orderkey % 13 + 1 < 14 THEN o_orderkey % 13 + 1 END AS scenario FROM orders""",
)
def q_times(spark, sf):
    o = B.table(spark, sf, "orders")
    d, n = F.col("o_orderdate").cast("timestamp"), (F.col("o_orderkey") % 13 + 1)
    stem = F.concat(F.lit("/data/scenario_"), n.cast("string"), F.lit("_botnet.binetflow.gz"))
    return o.select(
        "o_orderkey",
        S.repair_twelve_hour(S.parse_flow_time(F.date_format(d, "d/M/yyyy '09:00:00'"))).alias("day_first"),
        S.repair_twelve_hour(S.parse_flow_time(F.date_format(d, "d/M/yyyy '3:30'"))).alias("afternoon"),
        S.parse_local_time(F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("T11:00:00.717-04:00"))).alias("local_time"),
        S.scenario_id(stem).alias("scenario"),
    )
