import datetime as dt
import math
from collections import Counter, defaultdict
import random

import pytest
from pyspark.sql import functions as F

from flowhorizon import schema
from flowhorizon.functions import scalars as S
from flowhorizon.operators import cleaning, diff, eda, labels, splits
from flowhorizon.operators.windows import host_windows

T0 = dt.datetime(2024, 1, 1)
FLOW_DDL = (
    "timestamp timestamp, source_ip string, destination_ip string, source_port int, destination_port int, protocol string, "
    "flow_duration double, packet_count double, byte_count double, syn_count double, dataset_label string, "
    "normalized_attack_class string, attack_stage string"
)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def five_flows(spark):
    rows = [
        (at(0), "10.0.0.1", "b", 1000, 80, "TCP", 1.0, 10.0, 1000.0, 1.0, "BENIGN", "Benign", "Benign"),
        (at(10), "10.0.0.1", "c", 1001, 443, "TCP", 2.0, 20.0, 2000.0, 2.0, "BENIGN", "Benign", "Benign"),
        (at(40), "10.0.0.1", "b", 1002, 80, "TCP", 3.0, 5.0, 500.0, 5.0, "PortScan", "Reconnaissance", "Reconnaissance"),
        (at(70), "10.0.0.1", "d", None, None, "ICMP", None, 1.0, 50.0, None, None, None, None),
        (at(5), "10.0.0.2", "b", 2000, 53, "UDP", 0.5, 2.0, 100.0, 0.0, "BENIGN", "Benign", "Benign"),
    ]
    return spark.createDataFrame(rows, FLOW_DDL)


def test_windows_on_five_flows(spark):
    w = {(r["host_id"], r["window_idx"]): r for r in host_windows(five_flows(spark), 60, 30).collect()}
    assert set(w) == {("10.0.0.1", 0), ("10.0.0.1", 1), ("10.0.0.1", 2), ("10.0.0.2", 0)}
    first, second = w["10.0.0.1", 0], w["10.0.0.1", 1]
    assert (first["flow_count"], second["flow_count"]) == (3, 2)
    assert first["window_start"] == T0 and first["window_end"] == at(60)
    assert first["packet_count_sum"] == 35 and first["packet_count_mean"] == pytest.approx(35 / 3)
    assert (first["unique_destination_ips"], first["unique_destination_ports"]) == (2, 2)
    p = [2 / 3, 1 / 3]
    assert first["destination_port_entropy"] == pytest.approx(-sum(x * math.log2(x) for x in p))
    assert first["attack_flow_ratio"] == pytest.approx(1 / 3) and first["attack_present"] == 1
    assert first["dominant_class"] == "Reconnaissance" and first["dominant_dataset_label"] == "BENIGN"
    assert first["stage_distribution"] == '{"Benign": 2, "Reconnaissance": 1}'
    assert first["label_confidence"] == "inferred" and first["syn_ratio"] == pytest.approx(8 / 35)
    # missing ports count as flows but not as ports; missing labels are benign
    third = w["10.0.0.1", 2]
    assert third["flow_count"] == 1 and third["unique_destination_ports"] == 0 and third["destination_port_entropy"] == 0
    assert third["dominant_class"] == "Benign" and third["duration_mean"] is None and third["duration_total"] == 0
    assert "rst_count_sum" not in third and third["rst_ratio"] == 0


def test_window_arguments(spark):
    f = five_flows(spark)
    for bad in ({"window_seconds": 0}, {"stride_seconds": 0}, {"min_flows": 0}, {"group_by": "nope"}):
        with pytest.raises(ValueError):
            host_windows(f, **bad)
    with pytest.raises(ValueError):
        host_windows(f, 60, 25, panes=True)
    assert {r["host_id"] for r in host_windows(f, 60, 30, group_by="destination_ip").collect()} == {"b", "c", "d"}
    assert host_windows(f, 60, 30, min_flows=3).count() == 1


@pytest.mark.parametrize("window,stride,panes", [(60, 30, False), (60, 10, True), (60, 25, False), (20, 50, False), (60, 60, True)])
def test_windows_match_brute_force(spark, window, stride, panes):
    rng = random.Random(window * stride)
    rows = []
    for _ in range(300):
        t = rng.random() * 600
        port = rng.choice([None, 53, 80, 443])
        cls, stage = rng.choice([("Benign", "Benign"), ("Botnet", "Impact"), ("APT", "Impact"), ("APT", "Lateral Movement")])
        host = "hot" if rng.random() < 0.5 else f"h{rng.randrange(3)}"
        rows.append((at(round(t, 6)), host, f"d{rng.randrange(5)}", rng.randrange(9), port, "TCP", t / 9, 1.0, 2.0, 0.0, cls, cls, stage))
    t0 = min(r[0] for r in rows)
    groups = defaultdict(list)
    for r in rows:
        off = round((r[0] - t0).total_seconds() * 1e6)
        for k in range(off // (stride * 10**6) + 1):
            if k * stride * 10**6 <= off < (k * stride + window) * 10**6:
                groups[r[1], k].append(r)
    got = {(r["host_id"], r["window_idx"]): r for r in host_windows(spark.createDataFrame(rows, FLOW_DDL), window, stride, panes=panes).collect()}
    assert set(got) == set(groups)
    for key, flows in groups.items():
        r = got[key]
        ports = Counter(f[4] for f in flows if f[4] is not None)
        n = sum(ports.values())
        entropy = -sum(c / n * math.log2(c / n) for c in ports.values()) if n else 0
        attack = Counter(f[11] for f in flows if f[11] != "Benign")
        top = min(attack, key=lambda c: (-attack[c], c)) if attack else "Benign"
        assert r["flow_count"] == len(flows) and r["unique_destination_ips"] == len({f[2] for f in flows})
        assert r["destination_port_entropy"] == pytest.approx(entropy, abs=1e-9)
        assert r["connection_burst_max"] == max(Counter(int(f[0].timestamp()) for f in flows).values())
        assert r["dominant_class"] == top and r["attack_flow_ratio"] == pytest.approx(sum(attack.values()) / len(flows))


def test_schema_checks(spark):
    f = schema.coerce_flows(five_flows(spark))
    assert set(schema.REQUIRED) | set(schema.OPTIONAL) <= set(f.columns)
    assert f.filter("ttl_mean is not null").count() == 0
    schema.validate_flows(f)
    with pytest.raises(schema.FlowSchemaError, match="missing"):
        schema.validate_flows(f.drop("protocol"))
    with pytest.raises(schema.FlowSchemaError, match="no rows"):
        schema.validate_flows(schema.empty_flows(spark))
    with pytest.raises(schema.FlowSchemaError, match="timestamp"):
        schema.validate_flows(f.withColumn("timestamp", F.lit("x")))
    text = spark.createDataFrame([("x", "9.5", float("nan"))], "source_port string, byte_count string, packet_count double")
    r = schema.coerce_flows(text).first()
    assert r["source_port"] is None and r["byte_count"] == 9.5 and r["packet_count"] is None


def test_cleaning_order_and_report(spark):
    base = dict(zip([c.split()[0] for c in FLOW_DDL.split(", ")], five_flows(spark).first()))

    def row(**change):
        return tuple({**base, **change}.values())

    rows = [
        row(), row(byte_count=1.0), row(timestamp=None, source_ip=None), row(source_ip=""), row(destination_ip=None),
        row(flow_duration=-0.5), row(byte_count=float("inf")), row(flow_duration=None, source_port=7), row(source_port=None),
        row(source_port=None, byte_count=5.0),
    ]
    df = spark.createDataFrame(rows, FLOW_DDL).withColumn("line", F.monotonically_increasing_id())
    report = {r["reason"]: r["rows"] for r in cleaning.cleaning_report(df).collect()}
    assert report == {
        "rows_in": 10, "missing_timestamp": 1, "missing_source_ip": 1, "missing_destination_ip": 1, "negative_duration": 1,
        "infinite_values": 1, "exact_duplicate_flow": 2, "rows_out": 3,
    }
    kept = cleaning.clean_flows(df, order_by=["line"]).collect()
    assert sorted(r["byte_count"] for r in kept) == [1000.0, 1000.0, 1000.0]  # the first copy stays
    assert cleaning.clean_flows(df).count() == 3


def test_flow_features(spark):
    f = {r["source_port"]: r for r in cleaning.flow_features(five_flows(spark)).collect()}
    assert f[1000]["packets_per_second"] == 10 and f[1000]["bytes_per_packet"] == 100
    assert f[1002]["syn_ratio"] == 1.0 and f[None]["syn_ratio"] == 0.0 and f[1000]["rst_ratio"] is None
    assert f[None]["bytes_per_second"] == pytest.approx(50 / 1e-6)


def test_label_mapping_is_strict(spark):
    f = five_flows(spark).drop("normalized_attack_class", "attack_stage")
    out = labels.apply_stage_mapping(f, "cic_ids2017")
    assert {(r[0], r[1]) for r in out.select("dataset_label", "attack_stage").distinct().collect()} == {
        ("BENIGN", "Benign"), ("PortScan", "Reconnaissance"), (None, None)}
    with pytest.raises(labels.LabelMappingError, match="Teleport"):
        labels.apply_stage_mapping(f.withColumn("dataset_label", F.lit("Teleport")), "cic_ids2017")
    with pytest.raises(KeyError):
        labels.apply_stage_mapping(f, "unknown")


def test_scalar_edges(spark):
    one = spark.range(1)

    def value(c):
        return one.select(c).first()[0]

    assert [value(S.severity(F.lit(x).cast("double"))) for x in (None, 0, 25, 35, 100, 140, -3)] == [0, 0, 2, 4, 10, 10, 0]
    assert value(S.parse_port(F.lit("0x0008"))) == 8 and value(S.parse_port(F.lit("0x9a13"))) == 39443
    assert value(S.parse_port(F.lit(""))) is None and value(S.parse_port(F.lit("N10"))) is None
    assert value(S.scenario_id(F.lit("capture20110818-2.binetflow"))) == 11
    assert value(S.scenario_id(F.lit("CTU-Malware-Capture-Botnet-52.binetflow.gz"))) == 11
    assert value(S.scenario_id(F.lit("scenario_99.binetflow"))) is None
    assert value(S.parse_flow_time(F.lit("3/7/2017 09:00:01"))) == dt.datetime(2017, 7, 3, 9, 0, 1)
    assert value(S.parse_flow_time(F.lit("7/30/2017 3:30"))) == dt.datetime(2017, 7, 30, 3, 30)
    assert value(S.repair_twelve_hour(S.parse_flow_time(F.lit("7/7/2017 3:30")))) == dt.datetime(2017, 7, 7, 15, 30)
    assert value(S.parse_flow_time(F.lit("soon"))) is None
    assert value(S.parse_local_time(F.lit("2019-09-23T11:23:54-04:00"))) == dt.datetime(2019, 9, 23, 11, 23, 54)
    assert value(S.counts_json(F.array(F.struct(F.lit('a"b').alias("name"), F.lit(2).alias("n"))))) == '{"a\\"b": 2}'
    assert value(S.sigmoid(S.logit(F.lit(0.3)))) == pytest.approx(0.3)
    assert value(S.cef_extension(F.lit("a=b\\c\nd"))) == "a\\=b\\\\c\\nd"
    assert value(S.canonical_text(F.lit("a|b"), F.lit(None), F.lit("~"))) == "a\\|b|~|\\~"


def test_eda_counts_nulls(spark):
    counts = {(r[0], r[1]): r[2] for r in eda.value_counts(five_flows(spark), ["protocol", "attack_stage"]).collect()}
    assert counts["attack_stage", None] == 1 and counts["protocol", "TCP"] == 3
    s = eda.dataset_summary(five_flows(spark)).first()
    assert (s["rows"], s["source_hosts"], s["destination_hosts"]) == (5, 2, 3)


def test_table_diff(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "i int, s string")
    b = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "i int, s string")
    assert sorted(tuple(r) for r in diff.table_diff(a, b).collect()) == [(1, "x", 2, 1), (2, None, 1, 2)]
    assert diff.table_diff(a, a).count() == 0 and diff.schema_differences(a, a.drop("s")) == ["s: string / None"]
    assert diff.union_all([a, b.drop("s")]).filter("s is null").count() == 4


def test_spread_sample_is_proportional_and_stable(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 900, "big").otherwise("small").alias("f"))
    a = splits.spread_sample(df, "f", ["id"], 100)
    assert {r[0]: r[1] for r in a.groupBy("f").count().collect()} == {"big": 90, "small": 10}
    b = splits.spread_sample(df.repartition(13), "f", ["id"], 100)
    assert sorted(r["id"] for r in a.collect()) == sorted(r["id"] for r in b.collect())
    assert splits.spread_sample(df, "f", ["id"], 5000).count() == 1000
