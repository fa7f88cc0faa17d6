import datetime as dt

import pytest
from pyspark.sql import functions as F

from flowhorizon.functions.lookups import GENESIS, RISK_WEIGHTS
from flowhorizon.operators import cleaning, ledger, risk, triage
from flowhorizon.sinks import siem
from flowhorizon.sinks.tables import stage


def make_alerts(spark, n=50):
    a = spark.range(1, n + 1).select(
        "id",
        F.concat(F.lit("s"), (F.col("id") % 2).cast("string")).alias("session_id"),
        F.concat(F.lit("q"), F.col("id").cast("string")).alias("sequence_id"),
        F.lit("10.0.0.1").alias("host_id"),
        F.lit(0.75).alias("model_probability"),
        (F.col("id") * 1.5).alias("risk_score"),
        F.when(F.col("id") % 3 == 0, "Impact").alias("predicted_stage"),
    )
    return a


@pytest.fixture(scope="module")
def chain(spark):
    c = stage(ledger.append_alerts(make_alerts(spark), block_rows=8))
    return c, stage(ledger.chain_heads(c, "session_id"))


def verdict(c, heads=None):
    return {r["session_id"]: r for r in ledger.verify_alerts(c, heads).collect()}


def test_clean_chain(chain):
    c, heads = chain
    v = verdict(c, heads)
    assert all(r["status"] == "VERIFIED" and r["anchor"] == "matched" and r["records_checked"] == 25 for r in v.values())
    first = c.filter("session_id = 's1' and seq_no = 0").first()
    assert first["prev_hash"] == GENESIS and first["id"] == 1
    assert verdict(c)["s0"]["anchor"] == "missing"


def test_tampering_is_located(chain):
    c, heads = chain
    edit = c.withColumn("risk_score", F.when(F.col("id") == 11, 99.0).otherwise(F.col("risk_score")))
    v = verdict(edit, heads)
    assert (v["s1"]["status"], v["s1"]["record_id"], v["s1"]["reason"]) == ("CORRUPTED", 11, ledger.CONTENT_CHANGED)
    assert v["s1"]["records_checked"] == 5 and v["s0"]["status"] == "VERIFIED"
    gone = verdict(c.filter("id <> 11"), heads)["s1"]
    assert (gone["record_id"], gone["reason"]) == (13, ledger.LINK_BROKEN)
    tail = verdict(c.filter("id <> 49"), heads)["s1"]
    assert tail["status"] == "CORRUPTED" and tail["reason"] == ledger.TAIL_DELETED and tail["record_id"] == 49
    block = verdict(c.filter("not (session_id = 's1' and block_no = 1)"), heads)["s1"]
    assert block["status"] == "CORRUPTED" and block["reason"] == ledger.TAIL_DELETED
    both = verdict(c.filter("not (session_id = 's1' and block_no = 1)"), heads.filter("not (session_id = 's1' and block_no = 1)"))["s1"]
    assert both["status"] == "CORRUPTED" and both["anchor"] == "broken"
    whole = verdict(c.filter("session_id = 's0'"), heads)["s1"]
    assert whole["status"] == "CORRUPTED" and whole["records_checked"] == 0


def test_recomputed_chain_and_swapped_hashes(spark, chain):
    c, heads = chain
    plain = make_alerts(spark).withColumn("risk_score", F.lit(1.0))
    redone = ledger.append_alerts(plain, block_rows=8)
    assert verdict(redone, heads)["s0"]["reason"] == ledger.RECOMPUTED
    swapped = c.withColumn("hash", F.when(F.col("id") == 20, F.sha2(F.lit("x"), 256)).otherwise(F.col("hash")))
    assert verdict(swapped, heads)["s0"]["record_id"] == 20


def test_append_in_batches_equals_one_append(spark, chain):
    c, heads = chain
    a = make_alerts(spark)
    first = stage(ledger.append_alerts(a.filter("id <= 21"), block_rows=8))
    h1 = stage(ledger.chain_heads(first, "session_id"))
    second = stage(ledger.append_alerts(a.filter("id > 21"), h1, block_rows=8))
    h2 = ledger.chain_heads(second, "session_id", h1)
    whole = first.unionByName(second)
    assert {r["id"]: r["hash"] for r in whole.collect()} == {r["id"]: r["hash"] for r in c.collect()}
    key = lambda df: sorted((r["session_id"], r["block_no"], r["rows"], r["head_hash"], r["link"]) for r in df.collect())
    assert key(h2) == key(heads)
    assert verdict(whole, h1)["s1"]["anchor"] == "behind"


def test_risk_weights_and_bounds():
    assert risk.max_reachable_risk() == pytest.approx(98.75) and risk.max_reachable_risk(stages=False) == 75.0
    for bad in ({"x": 1.0}, {**RISK_WEIGHTS, "stage_severity": -0.1}, {**RISK_WEIGHTS, "stage_severity": 0.5}):
        with pytest.raises(ValueError):
            risk.check_weights(bad)


def test_recent_alerts_and_alert_rows(spark):
    t = dt.datetime(2024, 1, 1, 23, 55)
    rows = [("a", t + dt.timedelta(minutes=m), i, p) for i, (m, p) in enumerate([(0, 0.9), (0, 0.1), (4, 0.8), (10, 0.95), (10.5, 0.7), (30, 0.9)])]
    df = spark.createDataFrame(rows, "host_id string, target_window_start timestamp, seq int, p double").withColumns(
        {
            "seq_start_time": F.col("target_window_start") - F.expr("interval 1 hour") + F.make_dt_interval(secs=F.col("seq")),
            "seq_end_time": F.col("target_window_start"), "target_window_end": F.col("target_window_start"), "sequence_id": F.col("seq").cast("string"),
            "abnormality": F.lit(0.5), "predicted_stage": F.lit("Impact"),
        }
    )
    r = risk.score_risk(df, 0.6)
    got = {x["seq"]: (x["recent_alerts"], x["risk_score"]) for x in r.collect()}
    assert [got[i][0] for i in range(6)] == [0, 1, 1, 2, 2, 0]
    want = 100 * (0.4 * 0.9 + 0.25 * 0.9 + 0.15 * 0.75 + 0.1 * 0.5 + 0.1 * 0)
    assert got[0][1] == pytest.approx(want, abs=0.011)
    a = risk.assign_ids(risk.alert_rows(r, 0.6, "s", "v"), after=100).orderBy("id").collect()
    assert [x["id"] for x in a] == [101, 102, 103, 104, 105] and a[0]["predicted_at"] == "2024-01-01T23:55:00"
    assert a[3]["target_window_start"] == "2024-01-02T00:05:30" and a[0]["confidence_label"] == "LIKELY_ATTACK"
    detail, newest = risk.host_detail(r, risk.assign_ids(risk.alert_rows(r, 0.6, "s", "v")), "a")
    d = detail.first()
    assert (d["sequences"], d["alerts"], len(d["timeline"])) == (6, 5, 6) and newest.count() == 5
    with pytest.raises(ValueError):
        risk.list_alerts(newest, limit=0)
    assert risk.get_alert(newest, 3).count() == 1


def test_alert_limits(spark):
    rows = [("q", "h", 0.5, 1, 50.0), ("q", "h", 1.5, 1, 50.0), ("q", "h", float("nan"), 1, 50.0), ("q", "h", 0.5, 2, 50.0),
            ("q", "h", 0.5, 1, 101.0), ("q" * 129, "h", 0.5, 1, 1.0), ("q", None, 0.5, 1, 1.0), ("q", "h", None, None, None)]
    df = spark.createDataFrame(rows, "sequence_id string, host_id string, model_probability double, lr_flag int, risk_score double")
    reasons = [r[0] for r in df.select(cleaning.alert_reject_reason(df)).collect()]
    assert reasons == [None, "model_probability", "model_probability", "lr_flag", "risk_score", "sequence_id", "host_id", None]


# --- triage --------------------------------------------------------------------------------

ACTION_DDL = "action_id bigint, alert_id bigint, action string, analyst string, note string, response string, stage string, created_at string"


def act(i, alert, action, note=None, response=None, stage_=None, analyst="ana"):
    return (i, alert, action, analyst, note, response, stage_, "2024-01-01T00:00:00")


@pytest.mark.parametrize("fold_rows", [2, 256])
def test_transitions(spark, fold_rows):
    rows = [
        act(1, 1, "reopen"), act(2, 1, "acknowledge"), act(3, 1, "acknowledge"), act(4, 1, "approve_response", response="block"),
        act(5, 1, "comment", note="x"), act(6, 1, "dismiss"), act(7, 1, "reopen"), act(8, 1, "dismiss"), act(9, 2, "override_stage", stage_="Impact"),
        act(10, 2, "acknowledge", analyst=" "), act(11, 99, "acknowledge"), act(12, 2, "comment", note=" "),
    ]
    actions = spark.createDataFrame(rows, ACTION_DDL)
    s = {r["action_id"]: (r["state_before"], r["state_after"], r["allowed"]) for r in triage.replay_states(actions, fold_rows=fold_rows).collect()}
    assert s[1] == ("open", "open", False) and s[4] == ("acknowledged", "response_approved", True)
    assert s[6] == ("response_approved", "response_approved", False) and s[8] == ("reopened", "dismissed", True)
    alerts = stage(ledger.append_alerts(make_alerts(spark, 5)))
    d = triage.record_actions(actions, alerts)
    got = {r["action_id"]: r["reason"] for r in d.collect()}
    assert got[1] == "cannot reopen an alert that is open" and got[2] is None and got[10] == "an action names its analyst"
    assert got[11] == "alert not found" and got[12] == "an empty comment" and got[9] is None
    log = stage(triage.chain_actions(d, block_rows=2))
    assert triage.verify_actions(log, alerts).first()["status"] == "VERIFIED"
    h = {r["alert_id"]: r for r in triage.alert_history(alerts, log).collect()}
    assert h[1]["status"] == "dismissed" and h[1]["approved_response"] is None and h[2]["effective_stage"] == "Impact" and h[3]["status"] == "open"
    summary = {r["status"]: r["alerts"] for r in triage.triage_summary(alerts, log).collect()}
    assert summary == {"dismissed": 1, "open": 4}
    moved = triage.verify_actions(log, alerts.withColumn("hash", F.when(F.col("id") == 2, F.lit("x")).otherwise(F.col("hash")))).first()
    assert (moved["status"], moved["action_id"], moved["reason"]) == ("CORRUPTED", 9, triage.ALERT_CHANGED)
    edited = triage.verify_actions(log.withColumn("note", F.lit("y")), alerts).first()
    assert edited["status"] == "CORRUPTED" and edited["action_id"] == 2


# --- export --------------------------------------------------------------------------------


def test_export_lines(spark):
    df = spark.createDataFrame(
        [(7, "10.0.0.1", "a=b|c", 0.9, 62.5, "2017-07-07T15:00:00", "h1", "Impact", "2017-07-07T15:00:01+00:00"), (8, "x", "s", None, None, None, None, None, "t")],
        "id bigint, host_id string, sequence_id string, model_probability double, risk_score double, predicted_at string, hash string, "
        "predicted_stage string, created_at string",
    )
    cef = {r["id"]: r["value"] for r in siem.render(df, "cef").collect()}
    assert cef[7] == (
        "CEF:0|FlowHorizon|FlowHorizon Forecaster|0.1.0|flow-forecast|Predicted attack in next window|6|rt=1499439600000 src=10.0.0.1 externalId=7 "
        "cfp1=0.9 cfp1Label=attackProbability cn1=62.5 cn1Label=riskScore cs1=Impact cs1Label=predictedStage cs2=h1 cs2Label=ledgerHash "
        "cs3=a\\=b|c cs3Label=sequenceId cs4Label=modelVersion"
    )
    assert "|0|src=x externalId=8 cfp1Label" in cef[8] and "cs1=UNCERTAIN" in cef[8]
    log = {r["id"]: r["value"] for r in siem.render(df, "syslog").collect()}
    assert log[7].startswith("<163>1 2017-07-07T15:00:01+00:00 flowhorizon flowhorizon - alert - CEF:0|") and log[8].startswith("<165>1 t ")
    piped = siem.cef_line(df, vendor="a|b\\c")
    assert df.select(piped).first()[0].startswith("CEF:0|a\\|b\\\\c|")
    with pytest.raises(ValueError):
        siem.render(df, "xml")
    assert [r["id"] for r in siem.alerts_since(df, 7, 1).collect()] == [8]
    with pytest.raises(ValueError):
        siem.alerts_since(df, 7, 0)


def test_export_text(spark, tmp_path):
    siem.export_text(make_alerts(spark, 10), "jsonl", str(tmp_path / "out"))
    lines = spark.read.json(str(tmp_path / "out"))
    assert lines.count() == 10 and lines.filter("event.severity = 2").count() > 0


def test_equal_rows_do_not_count_each_other(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("h", t, t, True, f"q{i}") for i in range(4)] + [("h", t, t + dt.timedelta(minutes=1), True, "later")]
    ddl = "host_id string, target_window_start timestamp, seq_start_time timestamp, alerted boolean, sequence_id string"
    got = risk.recent_alerts(spark.createDataFrame(rows, ddl)).collect()
    assert {r["sequence_id"]: r["recent_alerts"] for r in got} == {"q0": 0, "q1": 0, "q2": 0, "q3": 0, "later": 4}


def test_equal_times_in_roll_up_and_timeline_follow_the_sequence(spark):
    t = dt.datetime(2024, 1, 1)
    ddl = "sequence_id string, host_id string, target_window_start timestamp, seq_start_time timestamp, risk_score double, p double, alerted boolean"
    rows = [(f"q{i}", "h", t, t, float(i), i / 10, i % 2 == 0) for i in range(6)]
    for part in (rows, rows[::-1], rows[3:] + rows[:3]):
        df = spark.createDataFrame(part, ddl).coalesce(1)
        assert risk.host_rollup(df).first()["latest_risk"] == 5.0
        assert [x["risk"] for x in risk.timelines(df, 4).first()["timeline"]] == [2.0, 3.0, 4.0, 5.0]


def test_abnormality_at_the_limit_equals_the_sql(spark, tmp_path):
    """A component that is the float nearest to the limit is not beyond it; vectors without components have no share."""
    import __spark_entry__ as entry
    from compare import compare, connect

    rows = [(1, [0.1, -0.1, 0.5, 0.0]), (2, [0.10000001, 0.2, float("nan"), None]), (3, []), (4, None)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "w"))
    next((tmp_path / "w").glob("*.parquet")).rename(tmp_path / "embeddings.parquet")
    assert compare(entry.queries()["abnormality"](spark, str(tmp_path)), connect(str(tmp_path)), entry.oracle_sql()["abnormality"]) is None
