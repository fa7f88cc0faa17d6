import datetime as dt
import gzip
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from flowhorizon.functions.lookups import label_table
from flowhorizon.operators import joins
from flowhorizon.plans import jumps
from flowhorizon.sinks import tables
from flowhorizon.sources import argus, authlog, ecar, flowmeter, packets, push, records

HEADER = (
    "Flow ID, Source IP, Source Port, Destination IP, Destination Port, Protocol, Timestamp, Flow Duration, Total Fwd Packets,"
    " Total Backward Packets,Total Length of Fwd Packets, Total Length of Bwd Packets, Packet Length Mean, SYN Flag Count,"
    "Init_Win_bytes_forward, Label"
)


def test_flowmeter_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    lines = [
        HEADER,
        "x,192.168.10.5,51321,8.8.8.8,443,6,3/7/2017 09:00:01,1500000,10,8,1200,900,60.0,1,8192,BENIGN",
        HEADER,
        "x,192.168.10.5,51322,8.8.8.8,53,17,7/7/2017 3:30,2000000,1,,80,,40.0,0,-1,PortScan",
        "x,10.0.0.1,1,10.0.0.2,2,99,garbage,1,1,1,1,1,1,0,0,Web Attack \x96 XSS",
    ]
    (tmp_path / "sub" / "Monday.pcap_ISCX.csv").write_bytes("\n".join(lines).encode("latin-1"))
    other = ["Src IP,Dst IP,Protocol,Timestamp,Label", "1.1.1.1,2.2.2.2,6,4/7/2017 10:00,BENIGN"]
    (tmp_path / "other.csv").write_text("\n".join(other))
    raw = flowmeter.read_flowmeter(spark, str(tmp_path))
    flows = flowmeter.flowmeter_to_flows(raw).orderBy("source_port").collect()
    assert len(flows) == 4
    by = {r["source_port"]: r for r in flows}
    a, b = by[51321], by[51322]
    assert a["timestamp"] == dt.datetime(2017, 7, 3, 9, 0, 1) and a["flow_duration"] == 1.5 and a["protocol"] == "TCP"
    assert (a["packet_count"], a["byte_count"], a["tcp_window_size"]) == (18, 2100, 8192) and a["source_file"] == "Monday.pcap_ISCX.csv"
    assert b["timestamp"] == dt.datetime(2017, 7, 7, 15, 30) and b["packet_count"] == 1 and b["byte_count"] == 80
    assert by[1]["timestamp"] is None and by[1]["protocol"] == "99" and by[1]["dataset_label"] == "Web Attack – XSS"
    assert by[None]["source_ip"] == "1.1.1.1" and by[None]["ttl_mean"] is None


def test_argus_files(spark, tmp_path):
    text = "\n".join([
        ",".join(argus.COLUMNS),
        "2011/08/18 15:39:35.087798,83.062141,tcp,147.32.84.202,1078,  <?>,65.54.89.106,80,RPA_FPA,0,0,43065,40974671,1033777,flow=Background",
        "2011/08/18 15:40:00.250000,0.000000,icmp,147.32.84.165,0x0008,   ->,147.32.96.69,0x9a13,ECO,0,,1,1066,1066,flow=From-Botnet-V52-1-ICMP",
        "2011/08/18 15:40:01.000000,0.000000,arp,147.32.84.1,,  who,147.32.84.165,,INT,,,1,60,60,flow=From-Normal-V52",
    ])
    (tmp_path / "capture20110818-2.binetflow").write_text(text)
    with gzip.open(tmp_path / "capture20110819.binetflow.gz", "wt") as fh:
        fh.write(text)
    (tmp_path / "unknown.binetflow").write_text(text)
    raw = argus.read_argus(spark, str(tmp_path))
    flows = argus.argus_to_flows(raw)
    assert {r[0]: r[1] for r in flows.groupBy("ctu_scenario").count().collect()} == {11: 3, 12: 3}
    rows = {r["protocol"]: r for r in argus.argus_to_flows(argus.read_argus(spark, str(tmp_path), [11])).collect()}
    tcp = rows["TCP"]
    assert tcp["timestamp"] == dt.datetime(2011, 8, 18, 15, 39, 35, 87798) and tcp["bwd_byte_count"] == 40974671 - 1033777
    assert [tcp[f"{x}_count"] for x in ("syn", "ack", "psh", "fin", "rst")] == [0, 1, 1, 1, 1]
    assert rows["ICMP"]["source_port"] == 8 and rows["ICMP"]["destination_port"] == 39443 and rows["ICMP"]["ack_count"] == 0
    assert rows["ARP"]["source_port"] is None and rows["ARP"]["dataset_label"] == "Normal" and rows["ICMP"]["dataset_label"] == "Botnet"


def ecar_line(ts, obj, action, oid, port, size=None, pid=1284):
    size = f',"size":"{size}"' if size is not None else ""
    return (
        f'{{"timestamp":"{ts}","hostname":"SysClient0201.systemia.com","pid":{pid},"object":"{obj}","action":"{action}","objectID":"{oid}",'
        f'"properties":{{"src_ip":"10.0.0.1","src_port":"1","dest_ip":"10.0.0.2","dest_port":"{port}","l4protocol":"6","direction":"outbound"{size}}}}}'
    )


def test_ecar_and_ground_truth(spark, tmp_path):
    t = "2019-09-23T11:{}:00.000-04:00"
    lines = [
        ecar_line(t.format("24"), "FLOW", "START", "f1", 443, pid=7), ecar_line(t.format("25"), "FLOW", "MESSAGE", "f1", 443, 1000),
        ecar_line(t.format("26"), "FLOW", "MESSAGE", "f1", 443, 500), ecar_line(t.format("24"), "FLOW", "START", "f2", 138, pid=8),
        ecar_line(t.format("23"), "FLOW", "START", "f2", 138, pid=8), ecar_line(t.format("24"), "FLOW", "START", "f3", 9092),
        ecar_line(t.format("24"), "FLOW", "START", "f4", 8000), ecar_line(t.format("30"), "FLOW", "START", "f5", 8000),
        ecar_line(t.format("24"), "PROCESS", "START", "p", 1), '{"object":"FLOW", broken',
    ]
    with gzip.open(tmp_path / "ecar-2019-09-23-sysclient0201.json.gz", "wt") as fh:
        fh.write("\n".join(lines))
    objects = ecar.ecar_flow_objects(ecar.read_ecar(spark, str(tmp_path)))
    flows = ecar.ecar_to_flows(objects)
    rows = {r["destination_port"]: r for r in flows.collect()}
    assert flows.count() == 4 and rows[443]["byte_count"] == 1500 and rows[138]["byte_count"] is None
    assert rows[138]["timestamp"] == dt.datetime(2019, 9, 23, 11, 23) and rows[443]["optc_host"] == "sysclient0201"
    assert ecar.ecar_flow_objects(ecar.read_ecar(spark, str(tmp_path)), keep_telemetry=True).count() == 5
    assert ecar.ecar_to_flows(objects, hosts=["sysclient0402"]).count() == 0
    (tmp_path / "gt1.csv").write_text(
        "SysClient0201.systemia.com,1284,2019-09-23T11:23:54.717-04:00,2019-09-23T11:27:10.000-04:00\nDC1,4,2019-09-23T11:00:00-04:00,Infinity\nx,bad,2019-09-23T11:00:00-04:00,Infinity\n"
    )
    gt = ecar.read_ground_truth(spark, {1: str(tmp_path / "gt1.csv")})
    assert {r["host"]: r["end"] for r in gt.collect()}["dc1"] is None and gt.count() == 2
    labelled = joins.process_labels(flows, gt).filter("destination_port = 8000").orderBy("timestamp").collect()
    assert [r["dataset_label"] for r in labelled] == ["Malicious", "Benign"] and labelled[0]["optc_scenario"] == 1


def test_host_logs_and_redteam(spark, tmp_path):
    (tmp_path / "flows.txt").write_text(
        "100,9,C1,N10,C2,443,6,10,5000\n150885,1,C17693,5,C1003,445,6,1,1\n151036,1,C9,5,C8,445,17,1,1\n"
        "151040,1,C17693,1,C1003,2,6,1,1\n151050,1,C17693,1,C5,2,1,1,1\n200000,1,C3,1,C4,2,99,?,1\n"
    )
    (tmp_path / "red.txt").write_text("151648,U1,C17693,C1003\n152000,U1,C17693,C728\n151770,U2,C17693,C728\n")
    raw = authlog.read_host_flows(spark, str(tmp_path / "flows.txt"))
    red = authlog.read_redteam(spark, str(tmp_path / "red.txt"))
    flows = joins.contact_labels(authlog.host_flows_to_flows(raw), red).orderBy("lanl_time_s").collect()
    # 150885 is inside the hour before the first red-team authentication
    assert [r["dataset_label"] for r in flows] == ["Benign", "RedTeam", "Benign", "RedTeam", "RedTeamSource", "Benign"]
    assert flows[0]["timestamp"] == dt.datetime(1970, 1, 1, 0, 1, 40) and flows[0]["source_port"] is None and flows[0]["packet_size_mean"] == 500
    assert flows[5]["packet_count"] is None and flows[5]["protocol"] == "99"
    assert authlog.select_host_flows(raw, ["C5"]).count() == 1 and authlog.select_host_flows(raw, None, (150000, 151040)).count() == 3
    names = spark.createDataFrame([("C5",), ("C17693",), ("C5",)], "computer string")
    assert authlog.select_host_flows(raw, names).count() == 3
    victims = {r["computer"]: (r["onset_s"], r["red_auths"]) for r in joins.victim_onsets(red).collect()}
    assert victims == {"C1003": (151648, 1), "C728": (151770, 2)}


def test_nfdump(spark, tmp_path):
    (tmp_path / "n.csv").write_text(
        "ts,te,td,sa,da,sp,dp,pr,flg,ipkt,ibyt,opkt,obyt\n"
        "2020-01-01 00:00:01,2020-01-01 00:00:03,1.500,10.0.0.1,10.0.0.2,1000,80,TCP,...AP.S.,10,1000,4,400\n"
        "2020-01-01 00:00:02,2020-01-01 00:00:02,0.000,10.0.0.3,10.0.0.4,0,8.0,ICMP,........,1,84,0,0\n"
        "\nSummary\nflows,bytes,packets,avg_bps,avg_pps,avg_bpp\n3,1,2,3,4,5\n"
    )
    flows = records.records_to_flows(records.nfdump_to_records(records.read_nfdump(spark, str(tmp_path / "n.csv"))))
    rows = {(r["source_ip"], r["destination_ip"]): r for r in flows.collect()}
    assert len(rows) == 3
    f, back, icmp = rows["10.0.0.1", "10.0.0.2"], rows["10.0.0.2", "10.0.0.1"], rows["10.0.0.3", "10.0.0.4"]
    assert f["flow_duration"] == pytest.approx(1.5) and (f["syn_count"], f["ack_count"], f["psh_count"], f["fin_count"]) == (1, 1, 1, 0)
    assert (back["source_port"], back["destination_port"], back["packet_count"], back["byte_count"]) == (80, 1000, 4, 400)
    assert icmp["source_port"] is None and icmp["syn_count"] is None and icmp["protocol"] == "ICMP"
    with pytest.raises(ValueError, match="nfdump"):
        (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
        records.read_nfdump(spark, str(tmp_path / "bad.csv"))


def test_push(spark):
    lines = spark.createDataFrame([
        ('{"timestamp":"2024-01-01T00:00:01","source_ip":"a","destination_ip":"b","source_port":"x","destination_port":80,"protocol":"TCP","flow_duration":"1.5","packet_count":3,"byte_count":9}',),
        ('{"timestamp":"later","source_ip":"a"}',),
    ], "value string")
    rows = push.parse_push(lines).collect()
    assert rows[0]["dataset_label"] == "UNLABELED" and rows[0]["source_port"] is None and rows[0]["flow_duration"] == 1.5
    assert rows[1]["timestamp"] is None
    bad = push.missing_fields(lines).collect()
    assert len(bad) == 1 and "protocol" in bad[0]["missing"] and "dataset_label" not in bad[0]["missing"]


# --- packets -------------------------------------------------------------------------------

T = 1499077800.0
A, B, C = "10.0.0.1", "10.0.0.2", "10.0.0.3"


def segments(start, seconds, spec):
    """Packets of one TCP connection between A and B from a text like ``> S 0 1`` (direction, flags, bytes, seq), one every ``seconds``."""
    out = []
    for i, part in enumerate(spec.split(",")):
        way, flags, size, seq = part.split()
        ends = (A, B, 50123, 443) if way == ">" else (B, A, 443, 50123)
        out.append((start + i * seconds, *ends, 6, int(size), 60 if way == ">" else 120, flags, 1000 if way == ">" else 2000, int(seq)))
    return out


UPLOAD = "> S 0 1,< SA 0 1,> A 0 2,> PA 700 2,> PA 700 702,> PA 700 702,< A 0 2,> FPA 10 1402,< FA 0 2"
CHAT = "< S 0 9,> SA 0 9,< PA 5 10,> PA 6 10,< R 0 15"


def test_connections_become_flows(spark):
    """The same ports used twice: an upload with one segment sent again and a close by both sides, then a chat that B
    opens and resets; between them datagrams of another pair, one hour apart, and a packet without ports."""
    other = [(T + 3600 * k, C, B, 9, 9, 17, 11, 33, None, None, None) for k in (0, 1)]
    bare = [(T, B, C, None, None, 1, 0, 7, None, None, None)]
    df = spark.createDataFrame(segments(T, 0.5, UPLOAD) + segments(T + 60, 2.0, CHAT) + other + bare, packets.PACKET_DDL)
    flows = packets.packets_to_flows(df, idle_timeout=1800)
    upload, chat = flows.filter("protocol = 'TCP'").orderBy("timestamp").collect()
    want = {
        "source_ip": A, "source_port": 50123, "packet_count": 9, "fwd_packet_count": 6, "fwd_byte_count": 2110, "bwd_byte_count": 0,
        "syn_count": 2, "psh_count": 4, "fin_count": 2, "rst_count": 0, "ack_count": 8, "retransmission_count": 1, "tcp_window_size": 1000,
        "flow_duration": 4.0, "inter_arrival_mean": 500_000.0, "inter_arrival_std": 0.0, "ttl_mean": 80.0,
    }
    assert {k: pytest.approx(upload[k], abs=1e-3) if isinstance(v, float) else upload[k] for k, v in want.items()} == want
    want = {"source_ip": B, "source_port": 443, "packet_count": 5, "bwd_byte_count": 6, "rst_count": 1, "retransmission_count": 0, "tcp_window_size": 2000}
    assert {k: chat[k] for k in want} == want
    assert flows.filter("protocol = 'UDP'").count() == 2
    assert packets.packets_to_flows(df, idle_timeout=4000).filter("protocol = 'UDP'").first()["flow_duration"] == 3600
    icmp = flows.filter("protocol = 'ICMP'").first()
    assert (icmp["destination_port"], icmp["tcp_window_size"], icmp["ttl_mean"]) == (None, None, 7)


def test_rst_and_timeouts(spark):
    rows = [(T + t, A, B, 1, 2, 6, 0, 64, f, 100, 0) for t, f in ((0, "S"), (1, "R"), (2, "S"))]
    df = spark.createDataFrame(rows, packets.PACKET_DDL)
    assert sorted(r["packet_count"] for r in packets.packets_to_flows(df).collect()) == [1, 2]
    with pytest.raises(ValueError):
        packets.packets_to_flows(df, idle_timeout=0)


WALK = """
WITH RECURSIVE p AS (SELECT *, row_number() OVER (PARTITION BY proto, a, b ORDER BY ts) AS k FROM packets),
w AS (
  SELECT proto, a, b, k, ts, ts AS began, 1 AS flow, src AS head, fin AND proto = 6 AS head_fin, false AS peer_fin, rst AND proto = 6 AS closed FROM p WHERE k = 1
  UNION ALL
  SELECT proto, a, b, k, ts, CASE WHEN fresh THEN ts ELSE began END, flow + fresh::INT, CASE WHEN fresh THEN src ELSE head END,
    CASE WHEN fresh THEN f ELSE head_fin OR (f AND src = head) END, CASE WHEN fresh THEN false ELSE peer_fin OR (f AND src <> head) END,
    (rst AND proto = 6) OR (NOT fresh AND (head_fin OR (f AND src = head)) AND (peer_fin OR (f AND src <> head)))
  FROM (SELECT p.*, w.began, w.flow, w.head, w.head_fin, w.peer_fin, p.fin AND p.proto = 6 AS f,
      w.closed OR p.ts - w.ts > {idle} OR p.ts - w.began > {active} AS fresh
    FROM w JOIN p ON p.proto = w.proto AND p.a = w.a AND p.b = w.b AND p.k = w.k + 1))
SELECT w.head, round(min(ts), 3), round(max(ts) - min(ts), 3), count(*)::INT, sum(size)::INT FROM w JOIN p USING (proto, a, b, k, ts)
GROUP BY w.proto, w.a, w.b, flow, w.head ORDER BY ALL"""


def walked(rows, idle, active):
    """Flows by a recursive query over the ordered packets of each conversation."""
    con = duckdb.connect()
    con.execute("CREATE TABLE packets (ts DOUBLE, src VARCHAR, a VARCHAR, b VARCHAR, proto INT, size INT, fin BOOLEAN, rst BOOLEAN)")
    con.executemany(
        "INSERT INTO packets VALUES (?, ?, ?, ?, ?, ?, ?, ?)",
        [[r[0], r[1], min(r[1], r[2]), max(r[1], r[2]), r[5], r[6], "F" in r[8], "R" in r[8]] for r in rows],
    )
    return con.execute(WALK.format(idle=idle, active=active)).fetchall()


@pytest.mark.parametrize("block", [16_384, 4])
def test_random_packets_match_the_recursive_query(spark, monkeypatch, block):
    """Every conversation in blocks: with four packets a block none is seen whole by a task."""
    monkeypatch.setattr(jumps, "BLOCK", block)
    rng = random.Random(11)
    rows, t = [], T
    for _ in range(900):
        t += rng.choice([0.5, 3, 20, 130]) + rng.random() / 10
        src, dst = rng.sample([A, B, C], 2)
        proto = rng.choice([6, 6, 17])
        flags = rng.choice(["A", "A", "A", "S", "PA", "FA", "R"]) if proto == 6 else ""
        rows.append((round(t, 3), src, dst, 5, 5, proto, rng.randrange(50), 64, flags, 1, rng.randrange(3)))
    df = spark.createDataFrame(rows, packets.PACKET_DDL).repartition(6)
    got = packets.packets_to_flows(df, idle_timeout=400, active_timeout=900).collect()
    mine = sorted((r["source_ip"], round(r["timestamp"].timestamp(), 3), round(r["flow_duration"], 3), int(r["packet_count"]), int(r["byte_count"])) for r in got)
    assert mine == walked(rows, 400, 900)


def orbit(jumps_of_key):
    out, i = [], 0
    while i < len(jumps_of_key):
        out.append(i)
        i = jumps_of_key[i]
    return out


@pytest.mark.parametrize("block", [1, 3, 8, 1000])
def test_jumps_composed_over_blocks(spark, monkeypatch, block):
    """One key with most rows, one row keys, jumps of one row and over many blocks."""
    monkeypatch.setattr(jumps, "GROUP", 50)
    rng = random.Random(block)
    keys = {"hot": 333, "one": 1, None: 40, "even": 64, "b": 7}
    to = {k: [min(n, i + rng.choice([1, 1, 2, 5, 40])) for i in range(n)] for k, n in keys.items()}
    rows = [(k, 1, i, j) for k, xs in to.items() for i, j in enumerate(xs)]
    df = spark.createDataFrame(rows, "k string, p int, _i bigint, _next bigint").repartition(5)
    got = jumps.reached(df, ["k", "p"], block).collect()
    assert sorted((str(r["k"]), r["_i"]) for r in got) == sorted((str(k), i) for k, xs in to.items() for i in orbit(xs))


def test_jumps_of_nothing(spark):
    assert jumps.reached(spark.createDataFrame([], "k string, _i bigint, _next bigint"), ["k"]).count() == 0


def test_interval_rules(spark):
    flows = packets.packets_to_flows(spark.createDataFrame(segments(T, 0.1, CHAT) + segments(T + 10, 0.1, CHAT), packets.PACKET_DDL))
    rules = spark.createDataFrame(
        [(2, B, dt.datetime(2017, 7, 3, 10, 30, 5), dt.datetime(2017, 7, 3, 10, 31), "Bot"),
         (1, B, dt.datetime(2017, 7, 3, 10, 30, 5), dt.datetime(2017, 7, 3, 10, 31), "PortScan")],
        "rule_no int, source_ip string, start timestamp, end timestamp, label string",
    )
    table = label_table(spark, "cic_ids2017")
    out = joins.interval_labels(flows, rules, table).orderBy("timestamp").collect()
    assert [r["dataset_label"] for r in out] == ["BENIGN", "PortScan"] and out[1]["attack_stage"] == "Reconnaissance"
    with pytest.raises(Exception, match="no mapping: Teleport"):
        joins.interval_labels(flows, rules.withColumn("label", F.lit("Teleport")), table).collect()
    assert joins.unknown_rule_labels(rules.withColumn("label", F.lit("Teleport")), table).first()[0] == "Teleport"


def test_tables(spark, tmp_path):
    df = spark.range(10).select("id", (F.col("id") % 2).alias("split"))
    back = tables.write_stage(df, str(tmp_path / "t"), partition_by=["split"], sort_by=["id"])
    assert back.filter("split = 1").count() == 5
    report = spark.createDataFrame([("rows_in", 5), ("x", 2), ("rows_out", 3)], "reason string, rows bigint")
    tables.write_ingest_summary(report, str(tmp_path / "s"), 7)
    got = tables.read_ingest_summary(spark, str(tmp_path / "s"), 3).first()
    assert got["rows_raw"] == 5 and got["dropped_by_reason"] == {"x": 2} and got["sample_size"] == 7
    assert tables.read_ingest_summary(spark, str(tmp_path / "s"), 4).count() == 0
    tables.write_scored_csv(df.withColumn("a", F.array("id")), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["id", "split"]


def test_equal_intervals_count_for_the_episode_they_open(spark, monkeypatch):
    """Whatever the order in which the stored rows come back, here the worst one."""
    monkeypatch.setattr(joins, "stage", lambda df, name="stage": df.orderBy("_new").coalesce(1).localCheckpoint())
    t = dt.datetime(2024, 1, 1)
    at = lambda h: t + dt.timedelta(hours=h)
    rows = [("a", at(0), at(1)), *[("a", at(5), at(6))] * 3, *[("a", at(9), at(9))] * 2]
    got = joins.interval_episodes(spark.createDataFrame(rows, "host string, s timestamp, e timestamp"), ["host"], "s", "e").orderBy("episode").collect()
    assert [(r["episode"], r["episode_start"], r["intervals"]) for r in got] == [(1, at(0), 1), (2, at(5), 3), (3, at(9), 2)]
