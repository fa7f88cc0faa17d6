"""Queries on risk, alerts, hash chains, analyst actions and alert export."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions.lookups import GENESIS, RISK_WEIGHTS, STAGE_ORDER, STAGE_SEVERITY
from ..functions.scalars import risk_level
from ..operators import cleaning, ledger, risk, triage
from ..sinks import siem
from ..sinks.tables import stage
from . import bindings as B
from .registry import query
from .sql import with_

THRESHOLD = 0.6
BLOCK = 256

SCORED_SQL = """SELECT o_orderkey, 'q' || o_orderkey AS sequence_id, 'h' || (o_custkey % 150) AS host_id, (o_orderkey * 37 % 1009) / CAST(1009 AS DOUBLE) AS p,
  TIMESTAMP '2024-01-01' + to_minutes(CAST(o_orderkey * 13 % 2880 AS BIGINT)) AS target_window_start,
  TIMESTAMP '2024-01-01' + to_minutes(CAST(o_orderkey * 13 % 2880 - 60 - o_orderkey % 47 AS BIGINT)) AS seq_start_time,
  (o_orderkey % 29) / CAST(28 AS DOUBLE) AS abnormality, ['""" + "', '".join(STAGE_ORDER) + """', 'UNCERTAIN'][o_orderkey % 8 + 1] AS predicted_stage,
  CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS truth FROM orders"""
SEVERITY_SQL = "CASE predicted_stage " + " ".join(f"WHEN '{s}' THEN {v}" for s, v in STAGE_SEVERITY.items()) + " ELSE 0 END"
W = RISK_WEIGHTS
RISK_SQL = {
    "scored": SCORED_SQL,
    "recent": f"""SELECT a.o_orderkey, count(b.o_orderkey) AS recent FROM scored a LEFT JOIN scored b ON b.host_id = a.host_id AND b.p >= {THRESHOLD}
      AND b.target_window_start >= a.target_window_start - INTERVAL 10 MINUTE AND (b.target_window_start < a.target_window_start
        OR (b.target_window_start = a.target_window_start AND b.seq_start_time < a.seq_start_time)) GROUP BY ALL""",
    "risky": f"""SELECT s.*, recent, p >= {THRESHOLD} AS alerted, round_even(100 * ({W['attack_probability']}::DOUBLE * p + {W['stage_severity']}::DOUBLE * ({SEVERITY_SQL} / 100.0::DOUBLE)
      + {W['prediction_confidence']}::DOUBLE * greatest(0.0::DOUBLE, (p - {THRESHOLD}::DOUBLE) / (1 - {THRESHOLD}::DOUBLE)) + {W['abnormality_score']}::DOUBLE * abnormality
      + {W['recent_attack_history']}::DOUBLE * least(1.0::DOUBLE, recent / 5.0::DOUBLE)), 2) AS risk_score FROM scored s JOIN recent USING (o_orderkey)""",
}


def scored(spark, sf):
    o = B.table(spark, sf, "orders")
    key = F.col("o_orderkey")
    base = F.unix_micros(F.lit("2024-01-01").cast("timestamp"))
    target = key * 13 % 2880
    minute = 60_000_000
    return o.select(
        "o_orderkey",
        F.concat(F.lit("q"), key.cast("string")).alias("sequence_id"),
        F.concat(F.lit("h"), (F.col("o_custkey") % 150).cast("string")).alias("host_id"),
        ((key * 37 % 1009) / 1009.0).alias("p"),
        F.timestamp_micros(base + target * minute).alias("target_window_start"),
        F.timestamp_micros(base + (target + 360) * minute).alias("target_window_end"),
        F.timestamp_micros(base + (target - 60 - key % 47) * minute).alias("seq_start_time"),
        F.timestamp_micros(base + (target - 1) * minute).alias("seq_end_time"),
        ((key % 29) / 28.0).alias("abnormality"),
        F.element_at(F.array(*[F.lit(s) for s in [*STAGE_ORDER, "UNCERTAIN"]]), (key % 8 + 1).cast("int")).alias(
            "predicted_stage"
        ),
        F.when(F.col("o_orderstatus") == "O", 1).otherwise(0).alias("target_attack_present"),
    )


def risky(spark, sf):
    return risk.score_risk(scored(spark, sf), THRESHOLD)


@query(
    "risk_scores",
    "R1 R2 N3",
    with_(**RISK_SQL)
    + """SELECT sequence_id, recent AS recent_alerts, alerted, risk_score,
    CASE WHEN risk_score < 33 THEN 'low' WHEN risk_score < 66 THEN 'medium' ELSE 'high' END AS level FROM risky""",
)
def q_risk(spark, sf):
    r = risky(spark, sf)
    return r.select("sequence_id", "recent_alerts", "alerted", "risk_score", risk_level(F.col("risk_score")).alias("level"))


@query(
    "abnormality",
    "R1",
    """SELECT vec_id, count(*) FILTER (WHERE abs(v) > 0.1) / count(*) AS share FROM (SELECT vec_id, unnest(embedding) AS v FROM embeddings) GROUP BY vec_id""",
)
def q_abnormality(spark, sf):
    e = B.table(spark, sf, "embeddings").filter(F.size("embedding") > 0)
    return e.select("vec_id", risk.abnormality(F.col("embedding"), F.lit(0.1).cast("float")).alias("share"))


@query(
    "host_rollup",
    "A3",
    with_(**RISK_SQL)
    + """SELECT host_id, count(*) AS sequences, count(*) FILTER (WHERE alerted) AS alerts, max(risk_score) AS max_risk,
    last(risk_score ORDER BY target_window_start, seq_start_time) AS latest_risk, round(last(p ORDER BY target_window_start, seq_start_time), 4) AS latest_p,
    max(target_window_start) AS last_seen, CASE WHEN last(risk_score ORDER BY target_window_start, seq_start_time) < 33 THEN 'low'
    WHEN last(risk_score ORDER BY target_window_start, seq_start_time) < 66 THEN 'medium' ELSE 'high' END AS level FROM risky GROUP BY host_id""",
)
def q_rollup(spark, sf):
    return risk.host_list(risky(spark, sf))


@query(
    "timelines",
    "N4 A6",
    with_(**RISK_SQL, n="SELECT *, row_number() OVER (PARTITION BY host_id ORDER BY target_window_start DESC, seq_start_time DESC) AS rn FROM risky")
    + """SELECT host_id, count(*) AS points, round(sum(risk_score), 2) AS risk_sum, string_agg(CAST(alerted AS VARCHAR), ',' ORDER BY rn DESC) AS flags
    FROM n WHERE rn <= 50 GROUP BY host_id""",
    digits=2,
)
def q_timelines(spark, sf):
    t = risk.timelines(risky(spark, sf), 50)
    return t.select(
        "host_id",
        F.size("timeline").alias("points"),
        F.aggregate("timeline", F.lit(0.0), lambda a, x: a + x["risk"]).alias("risk_sum"),
        F.array_join(F.transform("timeline", lambda x: x["alerted"].cast("string")), ",").alias("flags"),
    )


@query(
    "host_detail",
    "A6",
    with_(**RISK_SQL, n="SELECT *, row_number() OVER (PARTITION BY host_id ORDER BY target_window_start DESC, seq_start_time DESC) AS rn FROM risky",
          h="SELECT host_id FROM risky GROUP BY host_id ORDER BY count(*) DESC, host_id LIMIT 1")
    + """SELECT host_id, count(*) AS sequences, count(*) FILTER (WHERE alerted) AS alerts, max(risk_score) AS max_risk,
    round(sum(risk_score) FILTER (WHERE rn <= 500), 2) AS timeline_risk, max(target_window_start) AS last_seen, count(*) FILTER (WHERE alerted) AS listed
    FROM n JOIN h USING (host_id) GROUP BY host_id""",
    digits=2,
)
def q_host_detail(spark, sf):
    """The host with most sequences: its roll-up, its timeline and how many alerts are listed for it."""
    r = stage(risky(spark, sf), "risky")
    host = r.groupBy("host_id").count().orderBy(F.desc("count"), "host_id").first()["host_id"]
    detail, listed = risk.host_detail(r, alerts(spark, sf), host, limit=1 << 30)
    return detail.select(
        "host_id", "sequences", "alerts", "max_risk", F.aggregate("timeline", F.lit(0.0), lambda a, x: a + x["risk"]).alias("timeline_risk"),
        "last_seen", listed.agg(F.count(F.lit(1))).scalar().alias("listed"),
    )


@query(
    "replay_totals",
    "A4",
    with_(**RISK_SQL)
    + """SELECT count(*) AS processed, count(*) FILTER (WHERE alerted) AS alerts_emitted, count(*) FILTER (WHERE alerted AND truth = 1) AS alerts_matching_attack_label,
    count(DISTINCT host_id) AS hosts_seen, min(target_window_start) AS first_time, max(target_window_start) AS last_time FROM risky""",
)
def q_totals(spark, sf):
    return risk.replay_totals(risky(spark, sf))


# --- alert table ---------------------------------------------------------------------------

ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S')"
ALERT_SQL = {
    **RISK_SQL,
    "alert": f"""SELECT r.*, o_orderpriority AS session_id, row_number() OVER (ORDER BY target_window_start, host_id, {ISO.format("target_window_start - INTERVAL 1 MINUTE")}, sequence_id) AS id,
      {ISO.format("target_window_start - INTERVAL 1 MINUTE")} AS predicted_at, {ISO.format("target_window_start")} AS t0, {ISO.format("target_window_start + INTERVAL 6 HOUR")} AS t1
      FROM risky r JOIN orders USING (o_orderkey) WHERE alerted""",
}


def alerts(spark, sf):
    """Alerts of every order above the threshold, one session per order priority."""
    r = risky(spark, sf).join(B.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey")
    sessions = r.withColumn("confidence", F.col("p"))
    made = risk.alert_rows(
        sessions.withColumn("_s", F.col("o_orderpriority")), THRESHOLD, "", "m1", created_at=F.lit("2024-02-01T00:00:00+00:00")
    )
    keyed = made.drop("session_id").join(
        r.select("sequence_id", F.col("o_orderpriority").alias("session_id")), "sequence_id"
    )
    return risk.assign_ids(stage(keyed, "alerts"))


@query(
    "alert_table",
    "R3",
    with_(**ALERT_SQL)
    + f"""SELECT id, session_id, sequence_id, host_id, predicted_at, t0 AS target_window_start, t1 AS target_window_end, round(p, 6) AS model_probability, risk_score,
    'LIKELY_ATTACK' AS confidence_label, predicted_stage, truth AS truth_attack FROM alert""",
)
def q_alerts(spark, sf):
    return alerts(spark, sf).select(
        "id", "session_id", "sequence_id", "host_id", "predicted_at", "target_window_start", "target_window_end",
        "model_probability", "risk_score", "confidence_label", "predicted_stage", "truth_attack",
    )


@query(
    "alert_sessions",
    "A1",
    with_(**ALERT_SQL) + "SELECT session_id, count(*) AS alerts, min(id) AS first_id, max(id) AS last_id FROM alert GROUP BY session_id",
)
def q_sessions(spark, sf):
    return risk.sessions(alerts(spark, sf))


@query(
    "alert_listing",
    "C10 K7",
    with_(**ALERT_SQL) + "SELECT id, sequence_id FROM alert WHERE session_id = '1-URGENT' ORDER BY id DESC LIMIT 100 OFFSET 50",
)
def q_listing(spark, sf):
    return risk.list_alerts(alerts(spark, sf), 100, 50, session_id="1-URGENT").select("id", "sequence_id")


@query(
    "alerts_since",
    "K7",
    with_(**ALERT_SQL) + "SELECT id, sequence_id FROM alert WHERE id > 200 ORDER BY id LIMIT 1000",
)
def q_since(spark, sf):
    return siem.alerts_since(alerts(spark, sf), 200, 1000).select("id", "sequence_id")


@query(
    "alert_validation",
    "C11",
    """SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'host_id' WHEN o_totalprice > 300000 THEN 'model_probability' WHEN o_orderkey % 7 = 0 THEN 'lr_flag'
      WHEN o_totalprice > 250000 THEN 'risk_score' ELSE 'ok' END AS reason, count(*) AS n FROM orders GROUP BY ALL""",
)
def q_validation(spark, sf):
    o = B.table(spark, sf, "orders")
    key = F.col("o_orderkey")
    rows = o.select(
        key.cast("string").alias("sequence_id"),
        F.when(key % 5 != 0, F.lit("h")).alias("host_id"),
        (F.col("o_totalprice") / 300000).alias("model_probability"),
        F.when(key % 7 == 0, 2).otherwise(1).alias("lr_flag"),
        (F.col("o_totalprice") / 2500).alias("risk_score"),
    )
    good, bad = cleaning.split_valid_alerts(rows)
    both = bad.select("reject_reason").unionByName(good.select(F.lit("ok").alias("reject_reason")))
    return both.groupBy(F.col("reject_reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


# --- chains --------------------------------------------------------------------------------

TEXT_SQL = """concat_ws('|', seq_no, session_id, sequence_id, host_id, predicted_at, t0, t1, printf('%.6f', p), '0.600000', '~', '0.500000', '~', '~',
  printf('%.6f', risk_score), '~', printf('%.6f', p), 'LIKELY_ATTACK', predicted_stage, truth, '~', '~', 'm1', '2024-02-01T00:00:00+00:00')"""
CHAIN_SQL = {
    **ALERT_SQL,
    "seq": "SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY id) - 1 AS seq_no FROM alert",
    "lines": f"SELECT *, seq_no // {BLOCK} AS block_no, "
    + TEXT_SQL
    + " AS line FROM seq",
    "heads": f"""SELECT session_id, block_no, count(*) AS rows, max(seq_no) AS last_seq, max(id) AS last_id,
      list_reduce(list(line ORDER BY seq_no), lambda acc, x: sha256(x || acc),
        CASE WHEN block_no = 0 THEN '{GENESIS}' ELSE sha256(session_id || '|' || block_no) END) AS head_hash FROM lines GROUP BY session_id, block_no""",
    "linked": f"""SELECT *, list_reduce(list(head_hash) OVER (PARTITION BY session_id ORDER BY block_no), lambda acc, x: sha256(x || acc), '{GENESIS}') AS link FROM heads""",
}


def plain_alerts(spark, sf):
    """Alerts without the JSON component text, whose number formatting is Spark's own."""
    return stage(alerts(spark, sf).withColumn("risk_components", F.lit(None).cast("string")), "alert-table")


def chained(spark, sf):
    return stage(ledger.append_alerts(plain_alerts(spark, sf), block_rows=BLOCK), "chain")


@query(
    "chain_heads",
    "H1 F14",
    with_(**CHAIN_SQL) + "SELECT session_id, block_no, rows, last_seq, last_id, head_hash, link FROM linked",
)
def q_heads(spark, sf):
    return ledger.chain_heads(chained(spark, sf), "session_id")


@query(
    "chain_verify",
    "H2 H3",
    with_(**CHAIN_SQL, bad="SELECT session_id, min(id) AS record_id FROM seq WHERE o_orderkey % 401 = 17 GROUP BY session_id")
    + """SELECT s.session_id, CASE WHEN any_value(record_id) IS NULL THEN 'VERIFIED' ELSE 'CORRUPTED' END AS status, coalesce(any_value(record_id), -1) AS record_id,
    count(*) FILTER (WHERE id < coalesce(record_id, 1000000000)) AS records_checked, CASE WHEN any_value(record_id) IS NULL THEN 'none' ELSE 'content' END AS reason,
    'matched' AS anchor FROM seq s LEFT JOIN bad USING (session_id) GROUP BY s.session_id""",
)
def q_verify(spark, sf):
    """Change a field of some records of the stored chain, then look for them."""
    c = chained(spark, sf)
    heads = stage(ledger.chain_heads(c, "session_id"), "heads")
    hit = F.substring("sequence_id", 2, 20).cast("bigint") % 401 == 17
    v = ledger.verify_alerts(c.withColumn("risk_score", F.when(hit, F.col("risk_score") + 1).otherwise(F.col("risk_score"))), heads)
    return v.select(
        "session_id", "status", F.coalesce("record_id", F.lit(-1)).alias("record_id"), "records_checked",
        F.when(F.col("reason") == ledger.CONTENT_CHANGED, "content").when(F.col("reason").isNull(), "none").otherwise("other").alias("reason"),
        "anchor",
    )


@query(
    "anchor_states",
    "H3",
    with_(**CHAIN_SQL, k="SELECT *, dense_rank() OVER (ORDER BY session_id) % 5 AS way FROM seq")
    + f"""SELECT session_id, CASE WHEN way IN (1, 2) THEN 'CORRUPTED' ELSE 'VERIFIED' END AS status,
    CASE way WHEN 1 THEN 'newest records deleted' WHEN 2 THEN 'chain was recomputed' ELSE 'none' END AS reason,
    CASE way WHEN 1 THEN 'broken' WHEN 2 THEN 'broken' WHEN 3 THEN 'behind' WHEN 4 THEN 'missing' ELSE 'matched' END AS anchor,
    count(*) - (way = 1)::INT AS records_checked,
    coalesce(CASE way WHEN 1 THEN max(id) WHEN 2 THEN max(id) FILTER (WHERE seq_no < {BLOCK}) END, -1) AS record_id FROM k GROUP BY session_id, way""",
)
def q_anchors(spark, sf):
    """Stored heads against chains: one session lost its newest record, of one the first block was recomputed, the heads of one
    are older than its chain, those of one are gone, and one is untouched."""
    c = chained(spark, sf)
    names = c.select("session_id").distinct()
    way = stage(names.select("session_id", (F.dense_rank().over(Window.orderBy("session_id")) % 5).alias("way")), "ways")
    newest = c.groupBy("session_id").agg(F.max("id").alias("newest"))
    c = stage(c.join(way, "session_id").join(newest, "session_id"), "chain")
    left = c.filter((F.col("way") != 1) | (F.col("id") != F.col("newest"))).drop("way", "newest")
    old = c.filter((F.col("way") != 3) | (F.col("id") != F.col("newest"))).drop("way", "newest")
    heads = ledger.chain_heads(old, "session_id").join(way, "session_id").filter("way <> 4")
    hit = (F.col("way") == 2) & (F.col("block_no") == 0)
    heads = stage(heads.withColumn("head_hash", F.when(hit, F.sha2("head_hash", 256)).otherwise(F.col("head_hash"))).drop("way"), "heads")
    v = ledger.verify_alerts(left, heads)
    return v.select(
        "session_id", "status", F.coalesce("reason", F.lit("none")).alias("reason"), "anchor", "records_checked",
        F.coalesce("record_id", F.lit(-1)).alias("record_id"),
    )


@query(
    "chain_deletions",
    "H2 H3",
    with_(**CHAIN_SQL, gone="SELECT *, lag(o_orderkey) OVER (PARTITION BY session_id, block_no ORDER BY seq_no) AS pk, lag(seq_no) OVER (PARTITION BY session_id, block_no ORDER BY seq_no) AS ps FROM lines",
          cut="SELECT * FROM gone WHERE o_orderkey % 53 <> 5")
    + """SELECT id FROM cut WHERE (pk IS NOT NULL AND pk % 53 = 5)""",
)
def q_deletions(spark, sf):
    """Delete some records; every record right after a deleted one has a broken link."""
    c = chained(spark, sf)
    kept = c.filter(F.substring("sequence_id", 2, 20).cast("bigint") % 53 != 5)
    bad = ledger.chain_violations(kept, "session_id", ledger.alert_text(kept))
    return bad.filter(F.col("reason") == ledger.LINK_BROKEN).select("id")


# --- analyst actions -----------------------------------------------------------------------

KINDS = ["acknowledge", "approve_response", "dismiss", "reopen", "override_stage", "comment", "escalate"]
ACTION_SQL = {
    "act": f"""SELECT event_id AS action_id, user_id * 11 % 140 AS alert_id, {KINDS}[(k + event_id) % 7 + 1] AS action,
      CASE WHEN k = 3 THEN ' ' ELSE 'ana' END AS analyst, CASE WHEN k % 2 = 0 THEN 'n' END AS note, CASE WHEN k % 3 > 0 THEN 'r' || k END AS response,
      CASE WHEN k % 4 > 0 THEN {STAGE_ORDER}[k % 7 + 1] ELSE 'Nowhere' END AS stage FROM (SELECT *, CAST(props->>'k' AS INT) AS k FROM events)""",
    "checked": """SELECT *, CASE WHEN action = 'escalate' THEN 'no such action' WHEN trim(analyst) = '' THEN 'an action names its analyst'
      WHEN action = 'approve_response' AND response IS NULL THEN 'approval without a response'
      WHEN action = 'override_stage' AND stage = 'Nowhere' THEN 'override without a listed stage'
      WHEN action = 'comment' AND note IS NULL THEN 'an empty comment'
      WHEN alert_id % 10 = 9 THEN 'alert not found' END AS problem FROM act""",
    "walk": """SELECT *, list_reduce(list(action) OVER (PARTITION BY alert_id ORDER BY action_id ROWS UNBOUNDED PRECEDING),
      lambda s, a: CASE WHEN a = 'acknowledge' AND s IN ('open', 'reopened') THEN 'acknowledged'
        WHEN a = 'approve_response' AND s IN ('open', 'acknowledged', 'reopened') THEN 'response_approved'
        WHEN a = 'dismiss' AND s IN ('open', 'acknowledged', 'reopened') THEN 'dismissed'
        WHEN a = 'reopen' AND s IN ('response_approved', 'dismissed') THEN 'reopened' ELSE s END, 'open') AS state FROM checked WHERE problem IS NULL""",
    "steps": """SELECT *, coalesce(lag(state) OVER (PARTITION BY alert_id ORDER BY action_id), 'open') AS was FROM walk""",
    "decided": """SELECT *, CASE WHEN (action = 'acknowledge' AND was NOT IN ('open', 'reopened')) OR (action IN ('approve_response', 'dismiss')
        AND was NOT IN ('open', 'acknowledged', 'reopened')) OR (action = 'reopen' AND was NOT IN ('response_approved', 'dismissed'))
      THEN 'cannot ' || action || ' an alert that is ' || was END AS late FROM steps""",
    "done": "SELECT * FROM decided WHERE late IS NULL",
    "alert": "SELECT DISTINCT user_id * 11 % 140 AS id FROM events WHERE user_id * 11 % 140 % 10 <> 9",
}


def proposed(spark, sf):
    e = B.table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")

    def nth(values, i):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))

    return e.select(
        F.col("event_id").alias("action_id"),
        (F.col("user_id") * 11 % 140).alias("alert_id"),
        nth(KINDS, (k + F.col("event_id")) % 7).alias("action"),
        F.when(k == 3, " ").otherwise("ana").alias("analyst"),
        F.when(k % 2 == 0, "n").alias("note"),
        F.when(k % 3 > 0, F.concat(F.lit("r"), k.cast("string"))).alias("response"),
        F.when(k % 4 > 0, nth(STAGE_ORDER, k % 7)).otherwise("Nowhere").alias("stage"),
        F.lit("2024-02-01T00:00:00").alias("created_at"),
    )


def action_alerts(spark, sf):
    ids = B.table(spark, sf, "events").select((F.col("user_id") * 11 % 140).alias("id")).distinct()
    return ids.filter(F.col("id") % 10 != 9).select(
        "id", F.sha2(F.col("id").cast("string"), 256).alias("hash"), F.lit("UNCERTAIN").alias("predicted_stage"),
        F.lit("s").alias("session_id"),
    )


def decided(spark, sf):
    return triage.record_actions(proposed(spark, sf), action_alerts(spark, sf))


@query(
    "triage_decisions",
    "H4",
    with_(**ACTION_SQL)
    + """SELECT c.action_id, c.alert_id, c.action, coalesce(c.problem, d.late) IS NULL AS accepted, coalesce(c.problem, d.late, '') AS reason,
    CASE WHEN coalesce(c.problem, d.late) IS NULL THEN d.state ELSE '' END AS status_after FROM checked c LEFT JOIN decided d USING (action_id)""",
)
def q_decisions(spark, sf):
    d = decided(spark, sf)
    return d.select(
        "action_id", "alert_id", "action", "accepted", F.coalesce("reason", F.lit("")).alias("reason"),
        F.coalesce("status_after", F.lit("")).alias("status_after"),
    )


def action_log(spark, sf):
    return stage(triage.chain_actions(decided(spark, sf), block_rows=BLOCK), "actions")


@query(
    "triage_summary",
    "A2",
    with_(**ACTION_SQL, last="SELECT alert_id, last(state ORDER BY action_id) AS status FROM done GROUP BY alert_id")
    + "SELECT coalesce(status, 'open') AS status, count(*) AS alerts FROM alert LEFT JOIN last ON id = alert_id GROUP BY ALL",
)
def q_summary(spark, sf):
    return triage.triage_summary(action_alerts(spark, sf), action_log(spark, sf))


@query(
    "alert_history",
    "H5",
    with_(**ACTION_SQL, agg="""SELECT alert_id, last(state ORDER BY action_id) AS status, last(stage ORDER BY action_id) FILTER (WHERE action = 'override_stage') AS st,
            last(response ORDER BY action_id) FILTER (WHERE action = 'approve_response') AS resp, count(*) AS n FROM done GROUP BY alert_id""")
    + """SELECT id AS alert_id, coalesce(status, 'open') AS status, 'UNCERTAIN' AS model_stage, coalesce(st, 'UNCERTAIN') AS effective_stage,
    coalesce(CASE WHEN status = 'response_approved' THEN resp END, '') AS approved_response, coalesce(n, 0) AS actions FROM alert LEFT JOIN agg ON id = alert_id""",
)
def q_history(spark, sf):
    h = triage.alert_history(action_alerts(spark, sf), action_log(spark, sf))
    return h.withColumn("approved_response", F.coalesce("approved_response", F.lit("")))


@query(
    "action_verify",
    "H6 J13",
    with_(**ACTION_SQL)
    + """SELECT CASE WHEN min(action_id) FILTER (WHERE alert_id % 13 = 4) IS NULL THEN 'VERIFIED' ELSE 'CORRUPTED' END AS status,
    min(action_id) FILTER (WHERE alert_id % 13 = 4) AS action_id, 'bound' AS reason, count(*) AS actions FROM done""",
)
def q_action_verify(spark, sf):
    """Alter the hashes of some alerts after their actions were recorded."""
    a = action_alerts(spark, sf)
    now = a.withColumn("hash", F.when(F.col("id") % 13 == 4, F.sha2("hash", 256)).otherwise(F.col("hash")))
    v = triage.verify_actions(action_log(spark, sf), now)
    return v.withColumn("reason", F.when(F.col("reason") == triage.ALERT_CHANGED, "bound").otherwise("other"))


# --- export --------------------------------------------------------------------------------

CEF_SQL = """'CEF:0|FlowHorizon|FlowHorizon Forecaster|0.1.0|flow-forecast|Predicted attack in next window|'
  || CAST(least(greatest(round_even(risk_score / 10, 0), 0), 10) AS INT) || '|rt=' || (epoch_ms(target_window_start) - 60000) || ' src=' || host_id
  || ' externalId=' || id || ' cfp1Label=attackProbability cn1Label=riskScore cs1=' || predicted_stage
  || ' cs1Label=predictedStage cs2Label=ledgerHash cs3=' || sequence_id || '\\\\=x cs3Label=sequenceId cs4=m1 cs4Label=modelVersion start='
  || epoch_ms(target_window_start) || ' end=' || (epoch_ms(target_window_start) + 21600000)"""
SEV_SQL = "least(greatest(round_even(risk_score / 10, 0), 0), 10)"


def export_alerts(spark, sf):
    """Alerts with an id that needs escaping; probabilities are left out because their text form
    differs by engine."""
    a = alerts(spark, sf).drop("model_probability")
    return a.withColumn("sequence_id", F.concat("sequence_id", F.lit("\\=x")))


def without_risk_text(line):
    """Drop the risk number from a line; the severity derived from it stays."""
    return F.regexp_replace(line, r" cn1=[0-9.]+", "")


@query(
    "cef_lines",
    "K4 F11 F13",
    with_(**ALERT_SQL) + "SELECT id, replace(" + CEF_SQL + r", '\\=x', '\\\=x') AS value FROM alert",
)
def q_cef(spark, sf):
    r = siem.render(export_alerts(spark, sf), "cef")
    return r.select("id", without_risk_text(F.col("value")).alias("value"))


@query(
    "syslog_lines",
    "K5",
    with_(**ALERT_SQL)
    + f"""SELECT id, '<' || (160 + CASE WHEN {SEV_SQL} >= 8 THEN 2 WHEN {SEV_SQL} >= 6 THEN 3 WHEN {SEV_SQL} >= 4 THEN 4 ELSE 5 END)
    || '>1 2024-02-01T00:00:00+00:00 flowhorizon flowhorizon - alert - ' || replace({CEF_SQL}, """ + r"'\\=x', '\\\=x') AS value FROM alert",
)
def q_syslog(spark, sf):
    r = siem.render(export_alerts(spark, sf), "syslog")
    return r.select("id", without_risk_text(F.col("value")).alias("value"))


@query(
    "jsonl_lines",
    "K6",
    with_(**ALERT_SQL)
    + f"""SELECT id, '{{"@timestamp":"' || predicted_at || '","event":{{"end":"' || t1 || '","hash":null,"id":' || id || ',"kind":"alert","module":"flowhorizon","severity":'
    || CAST({SEV_SQL} AS INT) || ',"start":"' || t0 || '"}},"flowhorizon":{{"attack_probability":null,"model_version":"m1","predicted_stage":"' || predicted_stage
    || '","prev_hash":null,"risk_components":null,"sequence_id":"' || sequence_id || '","threshold":0.6}},"source":{{"ip":"' || host_id || '"}}}}' AS value FROM alert""",
)
def q_jsonl(spark, sf):
    a = alerts(spark, sf).drop("model_probability", "risk_components")
    r = siem.render(a, "jsonl")
    return r.select("id", F.regexp_replace("value", r'"risk_score":[0-9.]+,', "").alias("value"))
