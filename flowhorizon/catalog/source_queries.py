"""Raw-format adapters and streams, fed with raw rows that Spark derives from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lookups import LABEL_TABLES
from ..operators import models, scaling
from ..operators.splits import temporal_split
from ..session import ensure_checkpoint_dir
from ..sinks.tables import stage
from ..sources import argus, authlog, ecar, flowmeter, packets, push, records
from ..schema import validate_flows
from ..streaming import scoring as stream_scoring
from ..streaming import sequences as stream_seq
from ..streaming import windows as stream_win
from . import bindings as B
from .evaluation_queries import INTERCEPT, MODEL_PRESENT, STEP_SQL, logged_sql, model_rows, stored_model
from .registry import query
from .sequence_queries import PRESENT, FLOWS_AT, total
from .sql import with_

FLOW_OUT = ["timestamp", "source_ip", "destination_ip", "source_port", "destination_port", "protocol"]


def text(c):
    return c.cast("string")


@query(
    "flowmeter_flows",
    "S1 S2 F1 F2 F8",
    with_("flows")
    + """SELECT CASE WHEN hour(ts) < 8 THEN date_trunc('second', ts) + INTERVAL 12 HOUR ELSE date_trunc('second', ts) END AS "timestamp",
    source_ip, destination_ip, source_port, destination_port, CASE k % 3 WHEN 0 THEN 'UDP' WHEN 1 THEN 'TCP' ELSE '41' END AS protocol,
    round(value, 6) AS flow_duration, CAST(1 + k % 20 + k % 3 AS DOUBLE) AS packet_count, round(value * 100, 4) AS byte_count, dataset_label
    FROM flows""",
    digits=4,
)
def q_flowmeter(spark, sf):
    f = B.flows(spark, sf)
    k = F.col("destination_port")
    raw = f.select(
        F.date_format("timestamp", "d/M/yyyy H:m:s").alias("timestamp"),
        "source_ip",
        "destination_ip",
        text(F.col("source_port")).alias("source_port"),
        text(k).alias("destination_port"),
        F.element_at(F.array(F.lit("17"), F.lit(" 6 "), F.lit("41")), k % 3 + 1).alias("protocol"),
        text(F.col("flow_duration") * 1e7).alias("flow_duration"),
        text(F.col("packet_count")).alias("fwd_packet_count"),
        text(k % 3).alias("bwd_packet_count"),
        text(F.col("byte_count")).alias("fwd_byte_count"),
        F.lit(None).cast("string").alias("bwd_byte_count"),
        "dataset_label",
    )
    # every tenth row is followed by a repeated header line, as in concatenated exports
    header = F.explode(F.when(F.col("destination_port").cast("int") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    dirty = raw.withColumn("_h", header).withColumn(
        "dataset_label", F.when(F.col("_h") == 1, " Label").otherwise(F.col("dataset_label"))
    ).drop("_h")
    # exports of two collectors, whose headers are spelt and ordered differently
    one = {
        "source_ip": " Source IP", "source_port": " Source Port", "destination_ip": " Destination IP", "destination_port": " Destination Port",
        "protocol": " Protocol", "timestamp": " Timestamp", "flow_duration": " Flow Duration", "fwd_packet_count": " Total Fwd Packets",
        "bwd_packet_count": " Total Backward Packets", "fwd_byte_count": "Total Length of Fwd Packets", "bwd_byte_count": " Total Length of Bwd Packets",
        "dataset_label": " Label",
    }
    other = {n: h.strip().upper() for n, h in reversed(one.items())}
    folder = B.scratch(spark, "flowmeter")
    for name, header, rows in (("one", one, dirty.filter("length(source_ip) % 2 = 0")), ("other", other, dirty.filter("length(source_ip) % 2 = 1"))):
        rows.select(*[F.col(c).alias(h) for c, h in header.items()]).write.option("header", True).csv(f"{folder}/{name}")
    flows = flowmeter.flowmeter_to_flows(flowmeter.read_flowmeter(spark, folder))
    return flows.select(*FLOW_OUT, "flow_duration", "packet_count", "byte_count", "dataset_label")


@query(
    "argus_flows",
    "S3 S4 F4 F6",
    with_("flows")
    + """SELECT ts AS "timestamp", source_ip, destination_ip, source_port, destination_port, upper(protocol) AS protocol,
    round(value * 100, 4) AS byte_count, round(greatest(value * 100 - value * 60, 0), 4) AS bwd_byte_count,
    round(value * 100 / packet_count, 4) AS packet_size_mean,
    CASE WHEN event_type = 'error' THEN 'Botnet' WHEN event_type = 'view' THEN 'Normal' ELSE 'Background' END AS dataset_label,
    CAST(protocol = 'TCP' AND k % 2 = 0 AS INT)::DOUBLE AS syn_count, CAST(protocol = 'TCP' AS INT)::DOUBLE AS ack_count, 0.0::DOUBLE AS rst_count FROM flows""",
    digits=4,
)
def q_argus(spark, sf):
    e = B.table(spark, sf, "events").select("event_type", F.col("ts").cast("timestamp").alias("timestamp"), "user_id", "value", "props")
    k = F.get_json_object("props", "$.k").cast("int")
    peer = F.concat(F.lit("h"), ((F.col("user_id") + k) % B.HOSTS).cast("string"))
    raw = e.select(
        F.date_format("timestamp", "yyyy/MM/dd HH:mm:ss.SSSSSS").alias("StartTime"),
        text(F.col("value") / 10).alias("Dur"),
        F.when(k % 3 == 0, "udp").otherwise(" tcp").alias("Proto"),
        F.concat(F.lit("h"), text(F.col("user_id")), F.lit(" ")).alias("SrcAddr"),
        F.concat(F.lit("0x"), F.hex(k + 1024)).alias("Sport"),
        F.lit("->").alias("Dir"),
        peer.alias("DstAddr"),
        F.concat(F.lit(" "), text(k)).alias("Dport"),
        F.when(k % 2 == 0, "S_A").otherwise("PA_PA").alias("State"),
        F.lit("0").alias("sTos"),
        F.lit("0").alias("dTos"),
        text(1 + k % 20).alias("TotPkts"),
        text(F.col("value") * 100).alias("TotBytes"),
        text(F.col("value") * 60).alias("SrcBytes"),
        F.when(F.col("event_type") == "error", "flow=From-Botnet-V1").when(F.col("event_type") == "view", "flow=To-Normal-V1")
        .otherwise("flow=Background").alias("Label"),
        F.lit(11).alias("ctu_scenario"),
    )
    return argus.argus_to_flows(raw).select(
        *FLOW_OUT, "byte_count", "bwd_byte_count", "packet_size_mean", "dataset_label", "syn_count", "ack_count", "rst_count"
    )


@query(
    "ecar_flows",
    "S5 S6 F3",
    with_("flows", obj="""SELECT user_id AS u, k, min(ts) FILTER (WHERE event_type <> 'error') AS first_ts,
            sum(round(value * 100)::BIGINT) FILTER (WHERE event_type = 'error')::DOUBLE AS byte_count FROM flows GROUP BY ALL""")
    + """SELECT date_trunc('millisecond', first_ts) AS "timestamp", 'h' || u AS source_ip, 4000 + k AS destination_port, 'ws' || u AS optc_host,
    coalesce(byte_count, -1) AS byte_count, 'TCP' AS protocol FROM obj WHERE first_ts IS NOT NULL AND 4000 + k <> 4040""",
)
def q_ecar(spark, sf):
    """Events become JSON lines: errors are sized MESSAGEs, the rest are repeated STARTs of one object."""
    e = B.table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    port = F.when(k == 40, ecar.TELEMETRY_PORT).otherwise(4000 + k)
    error = F.col("event_type") == "error"
    document = F.struct(
        F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("-04:00")).alias("timestamp"),
        F.concat(F.lit("WS"), text(F.col("user_id")), F.lit(".Example.Net")).alias("hostname"),
        F.lit(7).alias("pid"),
        F.lit("FLOW").alias("object"),
        F.when(error, "MESSAGE").otherwise("START").alias("action"),
        F.concat_ws("-", text(F.col("user_id")), text(k)).alias("objectID"),
        F.struct(
            F.concat(F.lit("h"), text(F.col("user_id"))).alias("src_ip"),
            F.lit("1000").alias("src_port"),
            F.lit("peer").alias("dest_ip"),
            text(port).alias("dest_port"),
            F.lit("6").alias("l4protocol"),
            F.lit("outbound").alias("direction"),
            F.when(error, text(F.round(F.col("value") * 100).cast("bigint"))).alias("size"),
        ).alias("properties"),
    )
    lines = e.select(F.to_json(document).alias("value"))
    events = lines.select(F.lit("f").alias("file"), F.from_json("value", ecar.EVENT_DDL).alias("e")).select("file", "e.*")
    flows = ecar.ecar_to_flows(ecar.ecar_flow_objects(events))
    return flows.select(
        "timestamp", "source_ip", "destination_port", "optc_host", F.coalesce("byte_count", F.lit(-1.0)).alias("byte_count"), "protocol"
    )


@query(
    "host_log_flows",
    "S7 S8",
    """SELECT make_timestamp((l_orderkey % 86400) * 1000000) AS "timestamp", 'C' || l_suppkey AS source_ip, 'C' || (l_partkey % 200) AS destination_ip,
    l_linenumber + 400 AS destination_port, round(l_extendedprice / l_quantity, 6) AS packet_size_mean, l_quantity AS packet_count
    FROM lineitem WHERE l_orderkey % 86400 BETWEEN 500 AND 9000 AND (l_suppkey IN (3, 5) OR l_partkey % 200 IN (3, 5))""",
)
def q_host_log(spark, sf):
    li = B.table(spark, sf, "lineitem")
    raw = li.select(
        text(F.col("l_orderkey") % 86400).alias("time"),
        F.lit("9").alias("duration"),
        F.concat(F.lit("C"), text(F.col("l_suppkey"))).alias("src"),
        F.lit("N10").alias("src_port"),
        F.concat(F.lit("C"), text(F.col("l_partkey") % 200)).alias("dst"),
        text(F.col("l_linenumber") + 400).alias("dst_port"),
        F.lit("17").alias("protocol"),
        text(F.col("l_quantity")).alias("packets"),
        text(F.col("l_extendedprice")).alias("bytes"),
    )
    kept = authlog.select_host_flows(raw, ["C3", "C5"], (500, 9000))
    flows = authlog.host_flows_to_flows(kept)
    return flows.select("timestamp", "source_ip", "destination_ip", "destination_port", "packet_size_mean", "packet_count")


@query(
    "nfdump_flows",
    "S10 S11",
    with_("flows", r="""SELECT date_trunc('second', ts) AS t, source_ip AS a, destination_ip AS b, source_port AS sp, destination_port AS dp, protocol, flow_duration AS d,
            packet_count AS pk, CAST(round(value * 100) AS BIGINT) AS sz, k FROM flows""")
    + """SELECT t AS "timestamp", a AS source_ip, b AS destination_ip, sp AS source_port, dp AS destination_port, protocol, round(d, 3) AS flow_duration, pk AS packet_count,
      sz::DOUBLE AS byte_count, CASE WHEN protocol = 'TCP' THEN (k % 2 = 0)::INT::DOUBLE ELSE -1 END AS syn_count FROM r
    UNION ALL SELECT t, b, a, dp, sp, protocol, round(d, 3), CAST(k % 4 AS DOUBLE), CAST(k AS DOUBLE),
      CASE WHEN protocol = 'TCP' THEN (k % 2 = 0)::INT::DOUBLE ELSE -1 END FROM r WHERE k % 4 > 0""",
    digits=3,
)
def q_nfdump(spark, sf):
    f = B.flows(spark, sf)
    k = F.col("destination_port")
    raw = f.select(
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("ts"),
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("te"),
        text(F.col("flow_duration")).alias("td"),
        F.col("source_ip").alias("sa"),
        F.col("destination_ip").alias("da"),
        text(F.col("source_port")).alias("sp"),
        text(k).alias("dp"),
        F.col("protocol").alias("pr"),
        F.when(k % 2 == 0, "...A..S.").otherwise("...A....").alias("flg"),
        text(F.col("packet_count").cast("int")).alias("ipkt"),
        text(F.round(F.col("byte_count")).cast("bigint")).alias("ibyt"),
        text(k % 4).alias("opkt"),
        text(k).alias("obyt"),
    )
    out = records.records_to_flows(records.nfdump_to_records(raw))
    return out.select(
        *FLOW_OUT, "flow_duration", "packet_count", "byte_count", F.coalesce("syn_count", F.lit(-1.0)).alias("syn_count")
    )


PACKET_OUT = [
    *FLOW_OUT, "flow_duration", "packet_count", "byte_count", "fwd_packet_count", "bwd_packet_count", "fwd_byte_count", "bwd_byte_count",
    "packet_size_mean", "packet_size_std", "packet_size_min", "packet_size_max", "iat_mean_s", "iat_std_s",
    "syn_count", "ack_count", "rst_count", "fin_count", "psh_count", "urg_count", "ttl_mean", "ttl_std", "tcp_window_size", "retransmission_count",
]


def packet_out(flows):
    """Every measure of a packet flow; times between packets in seconds."""
    second = lambda c: F.col(c) / 1e6
    return flows.withColumns({"iat_mean_s": second("inter_arrival_mean"), "iat_std_s": second("inter_arrival_std")}).select(*PACKET_OUT)


#: flows by walking the packets of every conversation one by one; {proto}, {port}, {idle} and {active} are filled in
PACKET_WALK = """SELECT make_timestamp(CAST(round(min(ts) * 1000000) AS BIGINT)) AS "timestamp", head AS source_ip, CASE WHEN head = a THEN b ELSE a END AS destination_ip,
    {port} AS source_port, {port} AS destination_port, '{proto}' AS protocol,
    round(max(ts) - min(ts), 4) AS flow_duration, count(*)::DOUBLE AS packet_count, sum(len)::DOUBLE AS byte_count,
    (count(*) FILTER (WHERE src = head))::DOUBLE AS fwd_packet_count, (count(*) FILTER (WHERE src <> head))::DOUBLE AS bwd_packet_count,
    coalesce(sum(len) FILTER (WHERE src = head), 0)::DOUBLE AS fwd_byte_count, coalesce(sum(len) FILTER (WHERE src <> head), 0)::DOUBLE AS bwd_byte_count,
    round(avg(len), 4) AS packet_size_mean, round(coalesce(stddev_samp(len), 0), 4) AS packet_size_std, min(len)::DOUBLE AS packet_size_min, max(len)::DOUBLE AS packet_size_max,
    round(coalesce(avg((ts - lp) * 1e6), 0) / 1e6, 4) AS iat_mean_s, round(coalesce(stddev_samp((ts - lp) * 1e6), 0) / 1e6, 4) AS iat_std_s,
    {flags}, round(avg(ttl), 4) AS ttl_mean, round(coalesce(stddev_samp(ttl), 0), 4) AS ttl_std,
    (first(win ORDER BY n) FILTER (WHERE src = head AND win IS NOT NULL))::DOUBLE AS tcp_window_size,
    CASE WHEN '{proto}' = 'TCP' THEN (count(*) FILTER (WHERE len > 0) - count(DISTINCT (src, seq, len)) FILTER (WHERE len > 0))::DOUBLE END AS retransmission_count
    FROM (SELECT o.*, w.flow, w.head, lag(o.ts) OVER (PARTITION BY o.a, o.b, w.flow ORDER BY o.n) AS lp FROM ordered o JOIN (
      WITH RECURSIVE walk AS (
        SELECT a, b, n, ts, ts AS began, 1 AS flow, src AS head, fin AS head_fin, false AS peer_fin, rst AS closed FROM ordered WHERE n = 1
        UNION ALL
        SELECT a, b, n, ts, CASE WHEN fresh THEN ts ELSE began END, flow + fresh::INT, CASE WHEN fresh THEN src ELSE head END,
          CASE WHEN fresh THEN fin ELSE head_fin OR (fin AND src = head) END, CASE WHEN fresh THEN false ELSE peer_fin OR (fin AND src <> head) END,
          rst OR (NOT fresh AND (head_fin OR (fin AND src = head)) AND (peer_fin OR (fin AND src <> head)))
        FROM (SELECT p.a, p.b, p.n, p.ts, p.src, p.fin, p.rst, walk.began, walk.flow, walk.head, walk.head_fin, walk.peer_fin,
            walk.closed OR p.ts - walk.ts > {idle} OR p.ts - walk.began > {active} AS fresh
          FROM walk JOIN ordered p ON p.a = walk.a AND p.b = walk.b AND p.n = walk.n + 1))
      SELECT a, b, n, flow, head FROM walk) w USING (a, b, n)) GROUP BY a, b, flow, head"""
FLAG_SQL = ", ".join(f"sum(contains(flags, '{x}')::INT)::DOUBLE AS {n}_count" for n, x in packets.FLAG_LETTERS.items())
PACKET_COLUMNS = """*, contains(flags, 'F') AS fin, contains(flags, 'R') AS rst, least(src, dst) AS a, greatest(src, dst) AS b,
    row_number() OVER (PARTITION BY least(src, dst), greatest(src, dst) ORDER BY ts, event_id) AS n"""


def packet_sql(rows: str, **fill) -> str:
    return with_("flows", pk=rows, ordered=f"SELECT {PACKET_COLUMNS} FROM pk") + PACKET_WALK.format(flags=FLAG_SQL, **fill)


@query(
    "packet_flows",
    "S12",
    packet_sql(
        "SELECT event_id, us / 1e6 AS ts, source_ip AS src, destination_ip AS dst, k AS len, 50 + k % 5 AS ttl, '' AS flags, NULL::INT AS win, NULL::BIGINT AS seq FROM flows",
        proto="UDP", port=53, idle=172800, active=400 * 86400),
    digits=4,
)
def q_packets(spark, sf):
    """Datagrams between hosts: flows end after two idle days, and the active timeout is out of reach."""
    f = B.table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    src = F.concat(F.lit("h"), text(F.col("user_id")))
    dst = F.concat(F.lit("h"), text((F.col("user_id") + k) % B.HOSTS))
    p = f.select(
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), src.alias("src"), dst.alias("dst"),
        F.lit(53).alias("sport"), F.lit(53).alias("dport"), F.lit(17).alias("proto"), k.alias("payload_len"), (50 + k % 5).alias("ttl"),
        F.lit("").alias("flags"), F.lit(None).cast("int").alias("window"), F.lit(None).cast("bigint").alias("seq"),
        F.col("event_id").alias("order_no"),
    )
    return packet_out(packets.packets_to_flows(p, idle_timeout=2 * 86400, active_timeout=400 * 86400))


@query(
    "packet_flows_tcp",
    "S12",
    packet_sql(
        """SELECT event_id, us / 1e6 AS ts, source_ip AS src, 'h' || ((user_id + k % 3 + 1) % 150) AS dst, k % 4 * 100 AS len, 64 AS ttl,
          CASE WHEN k % 17 = 0 THEN 'FA' WHEN k % 29 = 0 THEN 'R' WHEN k % 5 = 0 THEN 'S' ELSE 'A' END AS flags, 1000 + k AS win, k % 6 AS seq FROM flows""",
        proto="TCP", port=80, idle=3 * 86400, active=86400),
    digits=4,
)
def q_packets_tcp(spark, sf):
    """The same table as TCP segments with teardown flags and an active timeout of a day."""
    e = B.table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    flags = F.when(k % 17 == 0, "FA").when(k % 29 == 0, "R").when(k % 5 == 0, "S").otherwise("A")
    p = e.select(
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"),
        F.concat(F.lit("h"), text(F.col("user_id"))).alias("src"),
        F.concat(F.lit("h"), text((F.col("user_id") + k % 3 + 1) % B.HOSTS)).alias("dst"),
        F.lit(80).alias("sport"), F.lit(80).alias("dport"), F.lit(6).alias("proto"), (k % 4 * 100).alias("payload_len"), F.lit(64).alias("ttl"),
        flags.alias("flags"), (1000 + k).alias("window"), (k % 6).cast("bigint").alias("seq"), F.col("event_id").alias("order_no"),
    )
    return packet_out(packets.packets_to_flows(p, idle_timeout=3 * 86400, active_timeout=86400))


@query(
    "pushed_flows",
    "S15 C1 C2",
    with_("flows")
    + """SELECT ts AS "timestamp", source_ip, destination_ip, CASE WHEN k % 9 = 0 THEN -1 ELSE source_port END AS source_port, destination_port, protocol,
    round(byte_count, 4) AS byte_count, CASE WHEN k % 2 = 0 THEN 'UNLABELED' ELSE dataset_label END AS dataset_label FROM flows""",
    digits=4,
)
def q_push(spark, sf):
    f = B.flows(spark, sf)
    k = F.col("destination_port")
    body = F.struct(
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), "source_ip", "destination_ip",
        F.when(k % 9 == 0, "n/a").otherwise(text(F.col("source_port"))).alias("source_port"), "destination_port", "protocol",
        "flow_duration", "packet_count", "byte_count", F.when(k % 2 == 1, F.col("dataset_label")).alias("dataset_label"),
    )
    lines = f.select(F.to_json(body).alias("value"))
    out = validate_flows(push.parse_push(lines), "push")
    return out.select(
        "timestamp", "source_ip", "destination_ip", F.coalesce("source_port", F.lit(-1)).alias("source_port"),
        "destination_port", "protocol", "byte_count", "dataset_label",
    )


# --- streams -------------------------------------------------------------------------------

LATENESS = 3600
CLOSED_SQL = f"window_end <= (SELECT date_trunc('millisecond', max(ts)) FROM flows) - INTERVAL {LATENESS} SECOND"


def stream_flows(spark, sf):
    """``events`` as a file stream in order of time, a few files a batch, bound to the canonical columns."""
    from ..streaming import replay

    events, live = spark.read.parquet(f"{sf}/events.parquet"), B.scratch(spark, "live")
    replay.write_in_order(events, live, "ts")
    return named_flows(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", replay.FILES_A_BATCH).parquet(live))


def named_flows(raw):
    """Streamed events as labelled flows."""
    from ..functions.lookups import map_column

    f = B.flow_columns(raw)
    table = LABEL_TABLES["cic_ids2017"]
    label = F.col("dataset_label")
    return f.withColumns(
        {
            "normalized_attack_class": F.try_element_at(map_column({k: v[0] for k, v in table.items()}), label),
            "attack_stage": F.try_element_at(map_column({k: v[1] for k, v in table.items()}), label),
        }
    )


def run_stream(df, name):
    """Drive a stream over what is there now into a Parquet table of the shared folder."""
    import uuid

    base = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/flowhorizon-stream/{name}-{uuid.uuid4().hex}"
    query_ = stream_win.write_closed_windows(df, f"{base}/out", f"{base}/state")
    query_.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{base}/out")


def first_micros(spark, sf):
    """Time of the earliest flow, from one column of the stored table."""
    return spark.read.parquet(f"{sf}/events.parquet").agg(F.min(F.unix_micros(F.col("ts").cast("timestamp")))).first()[0]


def closed_windows(spark, sf):
    from ..operators.cleaning import flow_features

    origin = first_micros(spark, sf)
    flows = flow_features(stream_flows(spark, sf))
    w = stream_win.stream_host_windows(flows, origin, B.WINDOW, B.STRIDE, LATENESS)
    return run_stream(w.drop("stage_counts"), "windows")


@query(
    "stream_windows",
    "T1s T2s",
    with_("win")
    + f"""SELECT host_id, window_idx, window_start, window_end, flow_count, unique_destination_ips, round(destination_port_entropy, 6) + 0.0 AS destination_port_entropy,
    connection_burst_max, round(byte_count_sum, 4) AS byte_count_sum, attack_present, dominant_class, stage_distribution FROM win WHERE {CLOSED_SQL}""",
)
def q_stream_windows(spark, sf):
    w = closed_windows(spark, sf)
    return w.select(
        "host_id", "window_idx", "window_start", "window_end", "flow_count", "unique_destination_ips", "destination_port_entropy",
        "connection_burst_max", F.round("byte_count_sum", 4).alias("byte_count_sum"), "attack_present", "dominant_class", "stage_distribution",
    )


PLAYED = {
    "parts": """SELECT *, us < (SELECT min(us) + (max(us) - min(us)) * 3 // 5 FROM flows) AS early, event_id % 7 = 0 AS held FROM member""",
    "mark": f"SELECT max(us) // 1000 * 1000 - {LATENESS * 1_000_000} AS wm FROM parts WHERE early AND NOT held",
    "taken": f"""SELECT *, (SELECT min(us) FROM flows) + k_win * {B.STRIDE * 1_000_000} + {B.WINDOW * 1_000_000} AS end_us FROM parts
      WHERE NOT (early AND held AND (SELECT min(us) FROM flows) + k_win * {B.STRIDE * 1_000_000} + {B.WINDOW * 1_000_000} <= (SELECT wm FROM mark))""",
}
CLOSED_US = f"(SELECT max(us) // 1000 * 1000 - {LATENESS * 1_000_000} FROM flows)"


def played(spark, sf):
    """The table in two parts: the early flows without every seventh, then those, too late for many windows, with the later
    flows. Closed windows and the two runs of the query."""
    import uuid

    from ..operators.cleaning import flow_features
    from ..streaming import replay

    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/flowhorizon-stream/replay-{uuid.uuid4().hex}"
    events = spark.read.parquet(f"{sf}/events.parquet")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    span = events.agg(F.min(us).alias("lo"), F.max(us).alias("hi")).first()
    early = F.unix_micros(F.col("ts").cast("timestamp")) < span["lo"] + (span["hi"] - span["lo"]) * 3 // 5
    held = F.col("event_id") % 7 == 0
    parts = [events.filter(early & ~held), events.filter(~early | held)]
    live = replay.read_live(spark, f"{base}/live", events.schema, replay.FILES_A_BATCH)
    flows = flow_features(stream_scoring.observed(named_flows(live)))
    w = stream_win.stream_host_windows(flows, span["lo"], B.WINDOW, B.STRIDE, LATENESS)
    w = w.select("host_id", "window_idx", "flow_count", "attack_present")

    def run():
        one = stream_win.write_closed_windows(w, f"{base}/out", f"{base}/state")
        one.awaitTermination()
        return one

    # one report a batch is kept for the status, however many batches there are
    batches = events.count() // (replay.ROWS_A_FILE * replay.FILES_A_BATCH)
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", str(max(100, 2 * batches + 10)))
    runs = replay.play(parts, f"{base}/live", run, "ts")
    return spark.read.schema(w.schema).parquet(f"{base}/out"), runs


@query(
    "stream_replay",
    "T3s",
    with_("member", **PLAYED)
    + f"""SELECT host_id, k_win AS window_idx, count(*) AS flow_count, CAST(max((cls <> 'Benign')::INT) AS INT) AS attack_present FROM taken
    WHERE end_us <= {CLOSED_US} GROUP BY host_id, k_win""",
)
def q_replay(spark, sf):
    """Two parts of the table one after the other; a flow that comes late counts in the windows still open, and in no other."""
    return played(spark, sf)[0]


@query(
    "stream_status",
    "T8s",
    with_("member", **PLAYED, c=f"SELECT DISTINCT host_id, k_win FROM taken WHERE end_us <= {CLOSED_US}")
    + f"""SELECT (SELECT count(*) FROM flows) AS flows_seen, (SELECT min(ts) FROM flows) AS first_event, (SELECT max(ts) FROM flows) AS last_event,
    true AS some_late, make_timestamp({CLOSED_US}) AS watermark, count(DISTINCT k_win) AS windows_closed, count(DISTINCT host_id) AS hosts_tracked FROM c""",
)
def q_status(spark, sf):
    """What the played stream reports of itself, against counts of its input."""
    closed, runs = played(spark, sf)
    status = stream_scoring.stream_status(stream_scoring.stream_progress(spark, runs), closed)
    return status.withColumn("some_late", F.col("late_rows") > 0).drop("late_rows")


@query(
    "stream_dedup",
    "T4s",
    with_("flows") + 'SELECT DISTINCT ts AS "timestamp", source_ip, destination_ip, source_port, destination_port, protocol FROM flows',
)
def q_stream_dedup(spark, sf):
    """Every flow arrives twice; the copies are dropped within the watermark."""
    twice = stream_flows(spark, sf).withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("_copy")
    return run_stream(stream_win.deduplicate(twice.select(*FLOW_OUT), "1 hour"), "dedup")


@query(
    "stream_flush",
    "T7s",
    with_("win") + "SELECT host_id, window_idx, flow_count, attack_present FROM win",
)
def q_flush(spark, sf):
    """Closed windows of the stream plus the flushed open ones are all windows of the table."""
    from ..operators.cleaning import flow_features

    closed = closed_windows(spark, sf)
    flows = flow_features(B.labelled_flows(spark, sf))
    origin = first_micros(spark, sf)
    rest = stream_win.flush_windows(flows, closed, origin, B.WINDOW, B.STRIDE)
    keep = ["host_id", "window_idx", "flow_count", "attack_present"]
    return closed.select(*keep).unionByName(rest.select(*keep))


def live_sequences(spark, sf):
    """Sequences of the closed-window table as a stream."""
    import uuid

    closed = closed_windows(spark, sf)
    # the closed-window table in one ordered file per run stands in for the sink folder
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/flowhorizon-stream/closed-{uuid.uuid4().hex}"
    closed.write.parquet(base)
    stream_seq.use_rocksdb(spark)
    return stream_seq.stream_sequences(spark.readStream.schema(closed.schema).parquet(base), B.LENGTH, PRESENT)


@query(
    "stream_sequences",
    "T5s",
    with_("runs", "win")
    + f"""SELECT host_id, seq_start_time, seq_end_time, CAST(flows_sum AS BIGINT) AS input_flows FROM runs
    WHERE seq_end_time <= (SELECT date_trunc('millisecond', max(ts)) FROM flows) - INTERVAL {LATENESS} SECOND""",
)
def q_stream_sequences(spark, sf):
    return run_stream(live_sequences(spark, sf).select(
        "host_id", "seq_start_time", "seq_end_time", total("sequence_features", FLOWS_AT).cast("bigint").alias("input_flows")
    ), "sequences")


@query(
    "stream_scores",
    "T6s",
    with_("split", "numbered", "runs", **STEP_SQL,
          own=f"""SELECT r.host_id, r.seq_start_time, r.seq_end_time, m.idx - r.i AS step, unnest(range({len(MODEL_PRESENT)})) AS f,
            unnest([{", ".join(logged_sql("m", n) for n in MODEL_PRESENT)}]) AS x FROM runs r JOIN numbered m ON m.host_id = r.host_id AND m.idx BETWEEN r.i AND r.last_idx
            WHERE r.seq_end_time <= (SELECT date_trunc('millisecond', max(ts)) FROM flows) - INTERVAL {LATENESS} SECOND""",
          s=f"""SELECT host_id, seq_start_time, seq_end_time, 1 / (1 + exp(-({INTERCEPT} + sum((((step * {len(MODEL_PRESENT)} + f) * 37 % 101) - 50) / 400.0::DOUBLE * ((x - c) / sc)::FLOAT::DOUBLE)))) AS p
            FROM own JOIN par USING (f) GROUP BY ALL""")
    + """SELECT host_id, seq_start_time, seq_end_time, round(p, 6) AS attack_probability, p >= 0.5 AS predicted_attack, 0.5::DOUBLE AS threshold FROM s""",
)
def q_stream_scores(spark, sf):
    """Streamed sequences scored with a stored model, on scaling learnt from the stored table."""
    import uuid

    train = model_rows(spark, sf).filter(F.col("split") == "train").select("model_inputs")
    params = stage(scaling.fit_scaler(train, names=MODEL_PRESENT), "scaler")
    seqs = live_sequences(spark, sf).withColumn(
        "sequence_features", F.transform("sequence_features", lambda v: F.slice(v, 1, len(MODEL_PRESENT)))
    )
    scored = stream_scoring.score_stream(seqs, params, stored_model(spark), 0.5, MODEL_PRESENT)
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/flowhorizon-stream/scores-{uuid.uuid4().hex}"
    stream_scoring.write_results(scored, f"{base}/out", f"{base}/state").awaitTermination()
    return stream_scoring.read_results(spark, f"{base}/out", scored.schema)
