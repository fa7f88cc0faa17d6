"""Queries on sequences: targets, splits, folds, samples, label joins and onset history."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lookups import WINDOW_FEATURES, label_table
from ..operators import eda, hostrel, joins, splits
from ..operators import sequences as Q
from ..sinks.tables import stage, top_scores, write_scored_csv, write_stage
from ..sources import ecar
from ..sources.push import read_table
from . import bindings as B
from .registry import query
from .sql import LENGTH, with_

# the test flows lack packet sizes and most flags, so vectors hold the features that exist
PRESENT = [
    f for f in WINDOW_FEATURES
    if not f.startswith(("packet_size", "inter_arrival", "tcp_window", "ack_count", "rst_count", "fin_count", "psh_count"))
]
FLOWS_AT = PRESENT.index("flow_count")
ENTROPY_AT = PRESENT.index("destination_port_entropy")


def total(matrix: str, at: int):
    return F.aggregate(matrix, F.lit(0.0), lambda a, v: a + v[at].cast("double"))


SEQ_COLUMNS = [
    "sequence_id", "host_id", "seq_start_time", "seq_end_time", "target_window_start", "target_window_end",
    "target_attack_present", "target_dominant_class", "target_dominant_stage", "target_stage_distribution",
    "target_label_confidence", "target_is_onset",
]


@query(
    "host_sequences",
    "Q1 Q2 Q3 F17 O1",
    with_("seqs")
    + f"""SELECT {', '.join(SEQ_COLUMNS)}, CAST(flows_sum AS BIGINT) AS input_flows, round(entropy_sum, 3) + 0.0 AS input_entropy,
    CAST(last_flow_count AS BIGINT) AS last_flows, target_flow_count AS target_flows FROM seqs""",
)
def q_sequences(spark, sf):
    return B.sequences(spark, sf).select(
        *SEQ_COLUMNS,
        total("sequence_features", FLOWS_AT).cast("bigint").alias("input_flows"),
        F.round(total("sequence_features", ENTROPY_AT), 3).alias("input_entropy"),
        F.element_at("sequence_features", -1)[FLOWS_AT].cast("bigint").alias("last_flows"),
        F.col("target_features")[FLOWS_AT].cast("bigint").alias("target_flows"),
    )


@query(
    "sequence_stride",
    "Q1 Q2 (stride 3, horizon 2)",
    with_("runs", "numbered")
    + """SELECT r.host_id || '_seq_' || r.i AS sequence_id, t.window_start AS target_window_start FROM runs r
    JOIN numbered t ON t.host_id = r.host_id AND t.window_start > r.seq_end_time WHERE r.i % 3 = 0
    QUALIFY row_number() OVER (PARTITION BY r.host_id, r.i ORDER BY t.window_idx) = 2""",
)
def q_stride(spark, sf):
    s = Q.build_sequences(B.windows(spark, sf), B.LENGTH, 2, 3, B.WINDOW, B.STRIDE, block=64)
    return s.select("sequence_id", "target_window_start")


@query(
    "inference_sequences",
    "Q5",
    with_("runs")
    + """SELECT host_id || '_seq_' || i AS sequence_id, host_id, seq_start_time, seq_end_time, CAST(flows_sum AS BIGINT) AS input_flows
    FROM runs""",
)
def q_inference(spark, sf):
    s = Q.inference_sequences(B.windows(spark, sf), B.LENGTH, PRESENT, B.STRIDE)
    return s.select(
        "sequence_id", "host_id", "seq_start_time", "seq_end_time",
        total("sequence_features", FLOWS_AT).cast("bigint").alias("input_flows"),
    )


@query(
    "chronology_guards",
    "Q4 M19",
    with_("seqs")
    + """SELECT count(*) FILTER (WHERE target_window_start <= seq_end_time) AS overlapping_targets,
    count(*) FILTER (WHERE seq_end_time <= seq_start_time) AS inverted_inputs, 0 AS foreign_targets,
    (SELECT count(*) FROM (SELECT host_id, window_start FROM win GROUP BY ALL HAVING count(*) > 1)) AS repeated_windows FROM seqs""",
)
def q_guards(spark, sf):
    w = B.windows(spark, sf)
    return Q.chronology_violations(Q.build_sequences(w, B.LENGTH, 1, 1, B.WINDOW, B.STRIDE), w)


@query(
    "temporal_split",
    "Q6",
    with_("split") + "SELECT sequence_id, split FROM split",
)
def q_split(spark, sf):
    return B.split_sequences(spark, sf).select("sequence_id", "split")


@query(
    "split_metadata",
    "Q6 K3",
    with_("split", per="SELECT split, target_dominant_class AS c, count(*) AS n FROM split GROUP BY ALL")
    + """SELECT count(*) AS total_sequences, count(*) FILTER (WHERE split = 'train') AS train_sequences,
    count(*) FILTER (WHERE split = 'val') AS val_sequences, count(*) FILTER (WHERE split = 'test') AS test_sequences,
    count(*) FILTER (WHERE split = 'boundary_excluded') AS boundary_excluded_sequences, min(seq_start_time) AS global_min_time,
    max(target_window_end) AS global_max_time, make_timestamp(CAST(floor((SELECT c1 FROM cuts)) AS BIGINT)) AS val_cutoff_time,
    make_timestamp(CAST(floor((SELECT c2 FROM cuts)) AS BIGINT)) AS test_cutoff_time,
    (SELECT string_agg(split || '/' || c || '=' || n, ',' ORDER BY split, c) FROM per) AS classes FROM split""",
)
def q_metadata(spark, sf):
    seqs = B.staged_sequences(spark, sf)
    cut = splits.split_cutoffs(seqs)
    meta = splits.split_metadata(splits.temporal_split(seqs, cutoffs=cut), cut, "events")
    inner = F.flatten(
        F.transform(
            F.map_entries("class_distribution_by_split"),
            lambda e: F.transform(
                F.map_entries(e["value"]),
                lambda x: F.concat(e["key"], F.lit("/"), x["key"], F.lit("="), x["value"].cast("string")),
            ),
        )
    )
    return meta.select(
        "total_sequences", *[f"{s}_sequences" for s in splits.SPLITS], "global_min_time", "global_max_time",
        "val_cutoff_time", "test_cutoff_time", F.array_join(F.array_sort(inner), ",").alias("classes"),
    )


@query(
    "onset_by_split",
    "E5 A5",
    with_("split")
    + """SELECT split, count(*) FILTER (WHERE target_attack_present = 1) AS positive, count(*) FILTER (WHERE target_is_onset) AS onset,
    count(*) FILTER (WHERE target_attack_present = 1) - count(*) FILTER (WHERE target_is_onset) AS continuation
    FROM split GROUP BY split""",
)
def q_onset_by_split(spark, sf):
    return eda.onset_by_split(B.split_sequences(spark, sf))


@query(
    "dataset_status",
    "A5",
    with_("split")
    + """SELECT count(*) AS sequences, count(DISTINCT host_id) AS hosts_with_sequences,
    count(DISTINCT host_id) FILTER (WHERE split = 'test') AS hosts_in_test_split,
    count(*) FILTER (WHERE target_attack_present = 1) AS positive_sequences FROM split""",
)
def q_status(spark, sf):
    return eda.dataset_status(B.split_sequences(spark, sf))


@query(
    "split_order",
    "M19",
    with_("split")
    + """SELECT count(*) FILTER (WHERE split = 'val' AND seq_start_time < (SELECT max(target_window_end) FROM split WHERE split = 'train')) AS val_before_train_end,
    count(*) FILTER (WHERE split = 'test' AND seq_start_time < (SELECT max(target_window_end) FROM split WHERE split = 'val')) AS test_before_val_end FROM split""",
)
def q_split_order(spark, sf):
    from ..operators.evaluation import split_order_violations

    return split_order_violations(B.split_sequences(spark, sf))


@query(
    "lead_time",
    "M20 E5",
    with_("seqs", g="SELECT date_diff('microsecond', seq_end_time, target_window_start) / 1e6 AS gap FROM seqs")
    + """SELECT count(*) AS count, round(min(gap), 6) AS min, round(median(gap), 6) AS median, round(max(gap), 6) AS max,
    count(*) FILTER (WHERE gap <= 0) AS nonpositive_count, count(*) FILTER (WHERE gap > 0) AS positive_count,
    count(*) FILTER (WHERE gap < 0) AS overlap_count FROM g""",
)
def q_lead(spark, sf):
    return eda.lead_time(B.sequences(spark, sf))


@query(
    "target_variants",
    "M7",
    with_("split")
    + """SELECT 'any' AS variant, split, count(*) AS total, sum(target_attack_present)::BIGINT AS positive FROM split GROUP BY split
    UNION ALL SELECT 'onset', split, count(*), count(*) FILTER (WHERE target_is_onset) FROM split
    WHERE NOT (target_attack_present = 1 AND NOT target_is_onset) GROUP BY split""",
)
def q_variants(spark, sf):
    s = B.split_sequences(spark, sf)
    parts = [
        splits.target_variant(s, v).groupBy("split").agg(F.count(F.lit(1)).alias("total"), F.sum("y").alias("positive"))
        .withColumn("variant", F.lit(v)) for v in ("any", "onset")
    ]
    return parts[0].unionByName(parts[1])


@query(
    "lodo_folds",
    "Q7",
    with_("seqs", days="SELECT DISTINCT CAST(seq_start_time AS DATE) AS d FROM seqs",
          folds="""SELECT d AS test_day, CASE WHEN row_number() OVER (ORDER BY d) > 2 THEN lag(d) OVER (ORDER BY d)
            ELSE lead(d) OVER (ORDER BY d) END AS val_day FROM days""",
          spread="""SELECT s.*, test_day, val_day, CAST(seq_start_time AS DATE) AS a, CAST(target_window_end AS DATE) AS b
            FROM seqs s, folds WHERE val_day IS NOT NULL""")
    + """SELECT CAST(test_day AS VARCHAR) AS test_day, CAST(val_day AS VARCHAR) AS val_day, CASE
    WHEN NOT (a <= test_day AND b >= test_day) AND NOT (a <= val_day AND b >= val_day) THEN 'train'
    WHEN a = val_day AND b = val_day THEN 'val' WHEN a = test_day AND b = test_day THEN 'test' ELSE 'purged' END AS fold_split,
    count(*) AS total, sum(target_attack_present)::BIGINT AS positive, count(*) FILTER (WHERE target_is_onset) AS onset
    FROM spread GROUP BY ALL""",
)
def q_folds(spark, sf):
    return splits.fold_counts(
        B.staged_sequences(spark, sf),
        positive=F.col("target_attack_present"),
        onset=F.when(F.col("target_is_onset"), 1).otherwise(0),
    )


@query(
    "multi_horizon",
    "J7",
    with_("seqs", "numbered",
          f="""SELECT s.sequence_id, t.flow_count, row_number() OVER (PARTITION BY s.sequence_id ORDER BY t.window_idx) AS h
            FROM seqs s JOIN numbered t ON t.host_id = s.host_id AND t.window_start > s.seq_end_time""")
    + """SELECT sequence_id, count(*) AS future_count, max(flow_count) FILTER (WHERE h = 1) AS h1,
    coalesce(max(flow_count) FILTER (WHERE h = 2), -1) AS h2, coalesce(max(flow_count) FILTER (WHERE h = 3), -1) AS h3
    FROM f WHERE h <= 3 GROUP BY sequence_id""",
)
def q_horizon(spark, sf):
    w = B.windows(spark, sf)
    s = stage(Q.build_sequences(w, B.LENGTH, 1, 1, B.WINDOW, B.STRIDE), "sequences")
    m = Q.multi_horizon_targets(s, w, 3, window_seconds=B.WINDOW, stride_seconds=B.STRIDE, features=PRESENT)

    def h(i):
        return F.coalesce(F.get(F.get("future_features", F.lit(i)), F.lit(FLOWS_AT)).cast("bigint"), F.lit(-1))

    return m.select("sequence_id", "future_count", h(0).alias("h1"), h(1).alias("h2"), h(2).alias("h3"))


@query(
    "horizon_check",
    "J8",
    with_("seqs") + """SELECT 'stored' AS targets, 0 AS mismatches, count(*) AS sequences FROM seqs
    UNION ALL SELECT 'altered', count(*) FILTER (WHERE length(host_id) = 2), count(*) FROM seqs""",
)
def q_horizon_check(spark, sf):
    """The first future window against the stored target; then with the targets of some hosts altered, which must be found.

    Both are counted in one pass over what the comparison needs, so that no sequence is written or shuffled with its inputs.
    """
    w = B.windows(spark, sf)
    s = Q.build_sequences(w, B.LENGTH, 1, 1, B.WINDOW, B.STRIDE, PRESENT).select("host_id", "seq_end_time", "target_features")
    m = Q.multi_horizon_targets(s, w, 3, window_seconds=B.WINDOW, stride_seconds=B.STRIDE, features=PRESENT)
    shifted = F.transform("target_features", lambda x: (x * 2 + 1).cast("float"))
    altered = F.when(F.length("host_id") == 2, shifted).otherwise(F.col("target_features"))
    off = Q.horizon_off(stored=PRESENT, names=PRESENT)
    counts = m.select(off.alias("stored"), "*").withColumn("target_features", altered).agg(
        F.count_if("stored").alias("stored"), F.count_if(off).alias("altered"), F.count(F.lit(1)).alias("sequences")
    )
    each = F.array(*[F.struct(F.lit(n).alias("targets"), F.col(n).alias("mismatches")) for n in ("stored", "altered")])
    return counts.select("sequences", F.inline(each)).select("targets", "mismatches", "sequences")


@query(
    "last_window_rule",
    "N7 M10",
    with_("seqs") + "SELECT sequence_id, CASE WHEN last_attack_ratio > 0 THEN 1 ELSE 0 END AS rule FROM seqs",
)
def q_rule(spark, sf):
    return B.sequences(spark, sf).select("sequence_id", Q.last_window_rule("sequence_features", PRESENT).alias("rule"))


@query(
    "sequence_filter",
    "C9 O2 S14 K1",
    with_("split")
    + """SELECT sequence_id, split FROM split WHERE split = 'test' AND target_dominant_class <> 'Benign'""",
)
def q_filter(spark, sf):
    """From the stage table, partitioned by split, of which only the wanted part is read."""
    folder = B.scratch(spark, "split")
    write_stage(B.split_sequences(spark, sf), folder, partition_by=["split"], sort_by=["host_id"])
    s = read_table(spark, folder, ["sequence_id", "target_dominant_class", "split"], split="test")
    ids = s.filter(F.col("target_dominant_class") != "Benign").select("sequence_id")
    return Q.filter_sequences(s, ids=ids, split="test").select("sequence_id", "split")


@query(
    "top_sequences",
    "K8 O2",
    with_("seqs", k="SELECT sequence_id, host_id, flows_sum / 100.0 AS attack_probability FROM seqs")
    + """SELECT sequence_id, round(attack_probability::DOUBLE, 6) AS attack_probability FROM k ORDER BY attack_probability DESC, sequence_id LIMIT 10""",
)
def q_top(spark, sf):
    s = B.sequences(spark, sf).withColumn("attack_probability", total("sequence_features", FLOWS_AT) / 100.0)
    folder = B.scratch(spark, "scored")
    write_scored_csv(s, folder)
    back = spark.read.option("header", True).csv(folder).withColumn("attack_probability", F.col("attack_probability").cast("double"))
    return top_scores(back).select("sequence_id", "attack_probability")


@query(
    "spread_sample",
    "S13",
    with_(t="SELECT count(*) AS total FROM orders",
          c="SELECT o_orderpriority, least(CAST(round_even(count(*) * CAST(2000 AS DOUBLE) / (SELECT total FROM t), 0) AS BIGINT), count(*)) AS take FROM orders GROUP BY ALL",
          r="""SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(o_orderkey || '|42'), o_orderkey) AS rn FROM orders""")
    + "SELECT o_orderkey, r.o_orderpriority FROM r JOIN c ON r.o_orderpriority = c.o_orderpriority WHERE rn <= CASE WHEN (SELECT total FROM t) <= 2000 THEN rn ELSE take END",
)
def q_sample(spark, sf):
    o = B.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return splits.spread_sample(o, "o_orderpriority", ["o_orderkey"], 2000)


# --- label joins ---------------------------------------------------------------------------

RULES_SQL = """SELECT o_orderkey AS rule_no, 'h' || (o_custkey % 150) AS source_ip,
  TIMESTAMP '2024-01-01' + to_minutes(CAST(o_orderkey * 7 % 43200 AS BIGINT)) AS a,
  TIMESTAMP '2024-01-01' + to_minutes(CAST(o_orderkey * 7 % 43200 + CASE WHEN o_orderkey % 7 = 0 THEN 5760 ELSE o_orderkey % 240 END AS BIGINT)) AS b,
  CASE o_orderkey % 3 WHEN 0 THEN 'PortScan' WHEN 1 THEN 'Bot' ELSE 'DDoS' END AS label FROM orders"""


def rules(spark, sf):
    o = B.table(spark, sf, "orders")
    key = F.col("o_orderkey")
    at = F.unix_micros(F.lit("2024-01-01").cast("timestamp")) + (key * 7 % 43200) * 60_000_000
    length = F.when(key % 7 == 0, 5760).otherwise(key % 240) * 60_000_000
    return o.select(
        key.alias("rule_no"),
        F.concat(F.lit("h"), (F.col("o_custkey") % 150).cast("string")).alias("source_ip"),
        F.timestamp_micros(at).alias("start"),
        F.timestamp_micros(at + length).alias("end"),
        F.element_at(F.array(F.lit("PortScan"), F.lit("Bot"), F.lit("DDoS")), (key % 3 + 1).cast("int")).alias("label"),
    )


@query(
    "interval_labels",
    "J3",
    with_("flows", "label_map", rules=RULES_SQL,
          hit="""SELECT f.event_id, f.ts, f.source_ip, f.destination_ip, r.label, r.rule_no FROM flows f JOIN rules r ON r.source_ip = f.source_ip AND f.ts BETWEEN r.a AND r.b
            QUALIFY row_number() OVER (PARTITION BY f.event_id ORDER BY r.rule_no) = 1""")
    + """SELECT f.ts AS "timestamp", f.source_ip, f.destination_ip, coalesce(h.label, 'BENIGN') AS dataset_label, m.stg AS attack_stage
    FROM flows f LEFT JOIN hit h USING (event_id) JOIN label_map m ON m.dataset_label = coalesce(h.label, 'BENIGN')""",
)
def q_interval(spark, sf):
    out = joins.interval_labels(B.flows(spark, sf), rules(spark, sf), label_table(spark, "cic_ids2017"))
    return out.select("timestamp", "source_ip", "destination_ip", "dataset_label", "attack_stage")


@query(
    "process_labels",
    "J4 S9",
    with_("flows", gt="""SELECT o_orderkey AS gt_no, 'h' || (o_custkey % 150) AS host, o_orderkey % 5 AS pid,
            TIMESTAMP '2024-01-01' + to_minutes(CAST(o_orderkey * 11 % 43200 AS BIGINT)) AS a,
            CASE WHEN o_orderkey % 11 = 0 THEN TIMESTAMP '2100-01-01' ELSE TIMESTAMP '2024-01-01' + to_minutes(CAST(o_orderkey * 11 % 43200 + o_orderkey % 180 AS BIGINT)) END AS b,
            o_orderkey % 3 + 1 AS scenario FROM orders""",
          hit="""SELECT f.event_id, g.scenario FROM flows f JOIN gt g ON g.host = f.source_ip AND g.pid = f.k % 5 AND f.ts BETWEEN g.a AND g.b
            QUALIFY row_number() OVER (PARTITION BY f.event_id ORDER BY g.scenario, g.gt_no) = 1""")
    + """SELECT ts AS "timestamp", source_ip, k % 5 AS pid, CASE WHEN scenario IS NULL THEN 'Benign' ELSE 'Malicious' END AS dataset_label,
    coalesce(scenario, -1) AS optc_scenario FROM flows LEFT JOIN hit USING (event_id)""",
)
def q_process(spark, sf):
    """The truth comes from one headerless CSV per scenario, with local times and open ends; scenarios are tried in order."""
    o = B.table(spark, sf, "orders")
    key = F.col("o_orderkey")
    at = F.unix_micros(F.lit("2024-01-01").cast("timestamp")) + (key * 11 % 43200) * 60_000_000
    local = lambda us: F.concat(F.date_format(F.timestamp_micros(us), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-04:00"))
    rows = o.select(
        (key % 3 + 1).alias("scenario"),
        F.concat(F.lit("H"), (F.col("o_custkey") % 150).cast("string"), F.lit(".example.net")).alias("host"),
        (key % 5).alias("pid"),
        local(at).alias("start"),
        F.when(key % 11 == 0, "Infinity").otherwise(local(at + (key % 180) * 60_000_000)).alias("end"),
    )
    folder = B.scratch(spark, "truth")
    paths = {n: f"{folder}/{n}" for n in (1, 2, 3)}
    for n, path in paths.items():
        rows.filter(F.col("scenario") == n).drop("scenario").write.csv(path)
    truth = ecar.read_ground_truth(spark, paths)
    flows = B.flows(spark, sf).withColumns(
        {"optc_host": F.col("source_ip"), "pid": (F.col("destination_port") % 5).cast("bigint")}
    )
    out = joins.process_labels(flows, truth)
    return out.select(
        "timestamp", "source_ip", "pid", "dataset_label", F.coalesce("optc_scenario", F.lit(-1)).alias("optc_scenario")
    )


RED_SQL = """SELECT epoch_us(o_orderdate) // 1000000 % 2592000 + 1704067200 AS time, 'h' || (o_custkey % 40) AS src, 'h' || (o_orderkey % 150) AS dst FROM orders"""


def redteam(spark, sf):
    o = B.table(spark, sf, "orders")
    seconds = F.floor(F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1_000_000)
    return o.select(
        (seconds % 2592000 + 1704067200).alias("time"),
        F.concat(F.lit("h"), (F.col("o_custkey") % 40).cast("string")).alias("src"),
        F.concat(F.lit("h"), (F.col("o_orderkey") % 150).cast("string")).alias("dst"),
    )


@query(
    "contact_labels",
    "J5",
    with_("flows", red=RED_SQL, pairs="SELECT src, dst, min(time) AS t0 FROM red GROUP BY ALL", srcs="SELECT DISTINCT src FROM red")
    + """SELECT ts AS "timestamp", source_ip, destination_ip, CASE WHEN us // 1000000 >= t0 - 3600 THEN 'RedTeam'
    WHEN s.src IS NOT NULL THEN 'RedTeamSource' ELSE 'Benign' END AS dataset_label
    FROM flows f LEFT JOIN pairs p ON p.src = f.source_ip AND p.dst = f.destination_ip LEFT JOIN srcs s ON s.src = f.source_ip""",
)
def q_contact(spark, sf):
    flows = B.flows(spark, sf).withColumn("lanl_time_s", F.floor(F.unix_micros("timestamp") / 1_000_000))
    out = joins.contact_labels(flows, redteam(spark, sf))
    return out.select("timestamp", "source_ip", "destination_ip", "dataset_label")


@query(
    "victim_onsets",
    "E7",
    with_(red=RED_SQL)
    + "SELECT dst AS computer, min(time) AS onset_s, first(src ORDER BY time, src) AS attacker, count(*) AS red_auths FROM red GROUP BY dst",
)
def q_victims(spark, sf):
    return joins.victim_onsets(redteam(spark, sf))


@query(
    "sequence_extras",
    "J6",
    with_("runs", "flows")
    + """SELECT r.host_id || '_seq_' || r.i AS sequence_id, round(avg(CAST(50 + f.k % 30 AS DOUBLE)), 6) AS ttl_mean,
    round(avg(f.k / 7.0)::DOUBLE, 6) AS ttl_std_mean, round(sum(f.k % 3)::DOUBLE, 6) AS retransmissions
    FROM runs r JOIN flows f ON f.source_ip = r.host_id AND f.ts >= r.seq_start_time AND f.ts < r.seq_end_time GROUP BY ALL""",
)
def q_extras(spark, sf):
    s = stage(Q.inference_sequences(B.windows(spark, sf), B.LENGTH, PRESENT, B.STRIDE), "runs")
    k = F.col("destination_port")
    flows = B.flows(spark, sf).withColumns(
        {"ttl_mean": (50 + k % 30).cast("double"), "ttl_std": k / 7.0, "retransmission_count": (k % 3).cast("double")}
    )
    out = joins.sequence_extras(s, flows, pane_seconds=B.STRIDE, base_seconds=B.LENGTH * B.STRIDE)
    return out.select("sequence_id", "ttl_mean", "ttl_std_mean", "retransmissions")


# --- onsets --------------------------------------------------------------------------------

TRUTH_SQL = """SELECT o_orderkey % 3 + 1 AS scenario, 'h' || (o_custkey % 150) AS host, o_orderkey AS pid,
  TIMESTAMP '2024-01-01' + to_minutes(CAST(o_orderkey * 13 % 43200 AS BIGINT)) AS a,
  TIMESTAMP '2024-01-01' + to_minutes(CAST(o_orderkey * 13 % 43200 + o_orderkey % 90 AS BIGINT)) AS b FROM orders"""
EPISODE_SQL = {
    "truth": TRUTH_SQL,
    "reach": """SELECT *, max(b) OVER (PARTITION BY scenario, host ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM truth""",
    "marked": """SELECT *, sum(CASE WHEN prev IS NULL OR a - prev > INTERVAL 30 MINUTE THEN 1 ELSE 0 END)
      OVER (PARTITION BY scenario, host ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ep FROM reach""",
    "eps": "SELECT scenario, host, ep, min(a) AS episode_start, max(b) AS episode_end, count(*) AS intervals FROM marked GROUP BY ALL",
    "onsets": """SELECT scenario, host, min(episode_start) AS onset, count(*) AS episodes, max(episode_end) AS last_activity,
      CAST(sum(intervals) AS BIGINT) AS intervals FROM eps GROUP BY ALL""",
    "chained": """SELECT *, CASE WHEN lag(onset) OVER (PARTITION BY scenario ORDER BY onset, episodes, host) IS NULL
      OR onset - lag(onset) OVER (PARTITION BY scenario ORDER BY onset, episodes, host) > INTERVAL 60 SECOND THEN 1 ELSE 0 END AS fresh FROM onsets""",
    "batched": """SELECT *, CAST(sum(fresh) OVER (PARTITION BY scenario ORDER BY onset, episodes, host ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS batch FROM chained""",
    "sized": "SELECT *, count(*) OVER (PARTITION BY scenario, batch) AS batch_size FROM batched",
}


def truth(spark, sf):
    o = B.table(spark, sf, "orders")
    key = F.col("o_orderkey")
    at = F.unix_micros(F.lit("2024-01-01").cast("timestamp")) + (key * 13 % 43200) * 60_000_000
    return o.select(
        (key % 3 + 1).cast("int").alias("scenario"),
        F.concat(F.lit("h"), (F.col("o_custkey") % 150).cast("string")).alias("host"),
        key.alias("pid"),
        F.timestamp_micros(at).alias("start"),
        F.timestamp_micros(at + (key % 90) * 60_000_000).alias("end"),
    )


def onsets(spark, sf):
    return joins.onset_table(truth(spark, sf))


def some(*names):
    return {n: EPISODE_SQL[n] for n in names}


@query(
    "interval_episodes",
    "N5",
    with_(**some("truth", "reach", "marked", "eps"))
    + "SELECT scenario, host, CAST(ep AS BIGINT) AS episode, episode_start, episode_end, intervals FROM eps",
)
def q_interval_episodes(spark, sf):
    return joins.interval_episodes(truth(spark, sf), ["scenario", "host"], "start", "end")


@query(
    "onset_table",
    "E8",
    with_(**some("truth", "reach", "marked", "eps", "onsets"))
    + "SELECT o.*, p.processes FROM onsets o JOIN (SELECT scenario, host, count(DISTINCT pid) AS processes FROM truth GROUP BY ALL) p USING (scenario, host)",
)
def q_onset_table(spark, sf):
    return onsets(spark, sf)


@query(
    "lockstep",
    "N6",
    with_(**EPISODE_SQL) + "SELECT scenario, host, onset, batch, batch_size FROM sized",
)
def q_lockstep(spark, sf):
    slim = onsets(spark, sf).select("scenario", "onset", "episodes", "host")
    return joins.lockstep_batches(slim).select("scenario", "host", "onset", "batch", "batch_size")


@query(
    "census_summary",
    "E9",
    with_(**EPISODE_SQL)
    + """SELECT scenario, count(DISTINCT host) AS hosts, count(*) AS onsets, max(batch) AS batches, max(batch_size) AS largest_batch FROM sized GROUP BY ALL""",
)
def q_census(spark, sf):
    slim = onsets(spark, sf).select("scenario", "onset", "episodes", "host")
    return joins.census_summary(joins.lockstep_batches(slim)).drop("with_history_days")


@query(
    "event_episodes",
    "N5",
    with_("flows", l="SELECT event_type, source_ip, ts, lag(ts) OVER (PARTITION BY event_type, source_ip ORDER BY ts) AS p FROM flows")
    + "SELECT event_type, count(*) AS events, count(*) FILTER (WHERE p IS NULL OR ts - p > INTERVAL 120 MINUTE) AS episodes FROM l GROUP BY ALL",
)
def q_event_episodes(spark, sf):
    e = B.table(spark, sf, "events").select(
        "event_type", F.col("user_id").alias("host"), F.col("ts").cast("timestamp").alias("ts")
    )
    return joins.episode_counts(e, "host", "ts", ["event_type"], 7200)


@query(
    "onset_history",
    "J11",
    with_("labelled", **some("truth"), o="SELECT host, min(a) AS onset FROM truth GROUP BY host",
          f="SELECT source_ip AS host, ts, CASE WHEN k % 2 = 0 THEN 'outbound' ELSE 'inbound' END AS direction, cls <> 'Benign' AS bad FROM labelled",
          j="SELECT o.host, o.onset, f.ts, f.direction, f.bad FROM o LEFT JOIN f USING (host)")
    + """SELECT host, onset, count(*) FILTER (WHERE NOT bad AND direction = 'outbound' AND ts < onset AND ts >= onset - INTERVAL 10 MINUTE) AS own_out_10m,
    count(*) FILTER (WHERE NOT bad AND direction = 'outbound' AND ts < onset AND ts >= onset - INTERVAL 60 MINUTE) AS own_out_60m,
    count(*) FILTER (WHERE NOT bad AND direction = 'inbound' AND ts < onset AND ts >= onset - INTERVAL 10 MINUTE) AS inbound_10m,
    count(*) FILTER (WHERE NOT bad AND direction = 'inbound' AND ts < onset AND ts >= onset - INTERVAL 60 MINUTE) AS inbound_60m,
    count(*) FILTER (WHERE bad) AS red_flows,
    coalesce(round((epoch_us(onset) - max(epoch_us(ts)) FILTER (WHERE NOT bad AND direction = 'outbound' AND ts < onset)) / 6e7, 2), -1) AS min_since_last_own_out,
    coalesce(round((min(epoch_us(ts)) FILTER (WHERE bad) - epoch_us(onset)) / 1e6, 1), 0) AS first_red_flow_lag_s
    FROM j GROUP BY host, onset""",
)
def q_history(spark, sf):
    o = truth(spark, sf).groupBy("host").agg(F.min("start").alias("onset"))
    side = F.when(F.col("destination_port") % 2 == 0, "outbound").otherwise("inbound")
    label = F.when(F.col("normalized_attack_class") == "Benign", "Benign").otherwise("Malicious")
    f = B.labelled_flows(spark, sf).select(
        F.col("source_ip").alias("host"), "timestamp", side.alias("direction"), label.alias("dataset_label")
    )
    out = joins.onset_history(o, f)
    return out.withColumns(
        {
            "min_since_last_own_out": F.coalesce("min_since_last_own_out", F.lit(-1.0)),
            "first_red_flow_lag_s": F.coalesce("first_red_flow_lag_s", F.lit(0.0)),
        }
    )


@query(
    "days_before",
    "J12",
    with_("flows", **some("truth"), o="SELECT host, min(a) AS onset FROM truth GROUP BY host",
          i="SELECT source_ip AS host, CAST(ts AS DATE) AS day, count(*) * 100 AS size_bytes FROM flows GROUP BY ALL")
    + """SELECT o.host, o.onset, count(*) FILTER (WHERE day < CAST(onset AS DATE)) AS days_before,
    coalesce(max(size_bytes) FILTER (WHERE day = CAST(onset AS DATE)), 0) AS onset_day_bytes, count(day) > 0 AS has_telemetry
    FROM o LEFT JOIN i USING (host) GROUP BY ALL""",
)
def q_days_before(spark, sf):
    o = truth(spark, sf).groupBy("host").agg(F.min("start").alias("onset"))
    index = B.flows(spark, sf).groupBy(F.col("source_ip").alias("host"), F.to_date("timestamp").alias("day")).agg(
        (F.count(F.lit(1)) * 100).alias("size_bytes")
    )
    return joins.days_before(o, index)


# --- host-relative inputs ------------------------------------------------------------------

LOOKBACK, MIN_HISTORY = 20, 5


@query(
    "host_relative",
    "Q8 F9",
    with_("seqs", "numbered",
          pos="SELECT *, row_number() OVER (PARTITION BY host_id ORDER BY seq_start_time) - 1 AS pos FROM seqs",
          firsts="""SELECT p.host_id, p.pos, p.seq_start_time, p.sequence_id, n.flow_count, n.destination_port_entropy
            FROM pos p JOIN numbered n ON n.host_id = p.host_id AND n.window_start = p.seq_start_time""",
          ended="""SELECT c.sequence_id, c.host_id, c.pos, count(*) AS k FROM firsts c JOIN firsts e ON e.host_id = c.host_id AND e.pos < c.pos
            AND e.seq_start_time + INTERVAL 6 HOUR <= c.seq_start_time GROUP BY ALL""",
          base=f"""SELECT d.sequence_id, d.k, median(ln(1 + f.flow_count)) AS m_flow, median(f.destination_port_entropy) AS m_ent
            FROM ended d JOIN firsts f ON f.host_id = d.host_id AND f.pos < d.k AND f.pos >= d.k - {LOOKBACK} GROUP BY ALL""")
    + f"""SELECT p.sequence_id, round(CASE WHEN k >= {MIN_HISTORY} THEN sum(ln(1 + n.flow_count) - m_flow) ELSE 0.0 END, 3) + 0.0 AS flow_shift,
    round(CASE WHEN k >= {MIN_HISTORY} THEN sum(n.destination_port_entropy - m_ent) ELSE 0.0 END, 3) + 0.0 AS entropy_shift
    FROM pos p JOIN numbered n ON n.host_id = p.host_id AND n.idx BETWEEN p.i AND p.i + {LENGTH - 1} LEFT JOIN base b USING (sequence_id)
    GROUP BY p.sequence_id, k, m_flow, m_ent""",
    digits=3,
)
def q_host_relative(spark, sf):
    s = B.staged_sequences(spark, sf)
    names = [n for n in PRESENT if n not in ("attack_flow_ratio", "benign_flow_ratio")]
    inputs = s.withColumn("model_inputs", F.transform("sequence_features", lambda v: F.slice(v, 1, len(names))))
    out = hostrel.host_relative_inputs(
        inputs, "model_inputs", names, B.WINDOW, B.STRIDE, lookback=LOOKBACK, min_history=MIN_HISTORY, block=256
    )
    return out.select(
        "sequence_id",
        total("relative_inputs", FLOWS_AT).alias("flow_shift"),
        total("relative_inputs", ENTROPY_AT).alias("entropy_shift"),
    )


