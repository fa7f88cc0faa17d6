"""Queries on scored predictions and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lookups import LOG_FEATURES, STAGE_ORDER, THRESHOLD_GRID
from ..operators import eda, joins, models, scaling
from ..operators import evaluation as E
from ..operators.splits import temporal_split
from ..plans.scan import spread_small
from . import bindings as B
from .registry import query
from .sequence_queries import PRESENT
from .sql import with_

NAMED = "s7"
MODEL_PRESENT = [n for n in PRESENT if n not in ("attack_flow_ratio", "benign_flow_ratio")]

RANK_SQL = {
    "d": "SELECT {k} p, sum(y)::BIGINT AS pos, count(*) - sum(y)::BIGINT AS neg FROM src GROUP BY {g} p",
    "c": """SELECT *, coalesce(sum(neg) OVER ({part} ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below,
      coalesce(sum(pos) OVER ({part} ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos_below,
      sum(pos) OVER ({part}) AS tp_all, sum(neg) OVER ({part}) AS fp_all FROM d""",
}


def ranks(key: str = "") -> dict[str, str]:
    k = f"{key}," if key else ""
    part = f"PARTITION BY {key}" if key else ""
    return {n: b.format(k=k, g=k, part=part) for n, b in RANK_SQL.items()}


AUC = "sum(pos * (neg_below + neg / 2.0))::DOUBLE / (max(tp_all)::DOUBLE * max(fp_all))"
AP = """sum(CASE WHEN pos > 0 THEN pos * ((tp_all - pos_below)::DOUBLE / (tp_all - pos_below + fp_all - neg_below)) ELSE 0 END) / max(tp_all)::DOUBLE"""


@query(
    "metrics_at",
    "M5",
    with_("scores", src="SELECT * FROM scores WHERE split = 'test'", **ranks(),
          m="""SELECT count(*) FILTER (WHERE p < 0.5 AND y = 0) AS tn, count(*) FILTER (WHERE p >= 0.5 AND y = 0) AS fp,
            count(*) FILTER (WHERE p < 0.5 AND y = 1) AS fn, count(*) FILTER (WHERE p >= 0.5 AND y = 1) AS tp FROM src""")
    + f"""SELECT tn, fp, fn, tp, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
    round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(fp / (fp + tn), 6) AS false_positive_rate, tp + fp AS positive_predictions,
    tp + fn AS actual_positives, tn + fp AS actual_negatives, (SELECT round({AUC}, 6) FROM c) AS roc_auc,
    (SELECT round({AP}, 6) FROM c) AS average_precision FROM m""",
)
def q_metrics(spark, sf):
    return E.metrics_at(B.scores(spark, sf).filter(F.col("split") == "test"), 0.5)


@query(
    "ranking_by_split",
    "M5",
    with_("scores", src="SELECT * FROM scores", **ranks("split"))
    + f"""SELECT split, sum(pos + neg)::BIGINT AS n, max(tp_all)::BIGINT AS positives, max(fp_all)::BIGINT AS negatives,
    round({AUC}, 6) AS roc_auc, round({AP}, 6) AS average_precision FROM c GROUP BY split""",
)
def q_ranking(spark, sf):
    return E.ranking_metrics(B.scores(spark, sf), ["split"])


@query(
    "per_host_auc",
    "M8",
    with_("scores", src="SELECT * FROM scores", **ranks("host_id"))
    + f"""SELECT host_id, sum(pos + neg)::BIGINT AS n, max(tp_all)::BIGINT AS positives, round({AUC}, 6) AS roc_auc FROM c
    GROUP BY host_id HAVING max(tp_all) > 0 AND max(fp_all) > 0""",
)
def q_host_auc(spark, sf):
    return E.per_host_auc(B.scores(spark, sf))


@query(
    "host_check",
    "M8",
    with_("scores", src=f"SELECT *, CASE WHEN host_id = '{NAMED}' THEN '{NAMED}' ELSE 'other_hosts' END AS host_group FROM scores",
          **ranks("host_group"), auc=f"SELECT host_group, {AUC} AS roc_auc FROM c GROUP BY host_group")
    + """SELECT host_group, count(*) AS n, sum(y)::BIGINT AS pos, count(*) - sum(y)::BIGINT AS neg,
    count(*) FILTER (WHERE y = 0 AND p >= 0.5) AS neg_flagged, round(count(*) FILTER (WHERE y = 0 AND p >= 0.5) / (count(*) - sum(y)), 6) AS neg_flag_rate,
    count(*) FILTER (WHERE y = 1 AND p >= 0.5) AS pos_detected, round(count(*) FILTER (WHERE y = 1 AND p >= 0.5) / sum(y), 6) AS pos_detect_rate,
    round(any_value(roc_auc), 6) AS roc_auc FROM src JOIN auc USING (host_group) GROUP BY host_group""",
)
def q_host_check(spark, sf):
    return E.host_check(B.scores(spark, sf), 0.5, NAMED)


F1_SQL = "CASE WHEN tp_all - pos_below > 0 THEN 2.0::DOUBLE * (tp_all - pos_below) / (tp_all - pos_below + fp_all - neg_below + tp_all) ELSE 0 END"


@query(
    "threshold_curve",
    "M6",
    with_("scores", src="SELECT * FROM scores WHERE split = 'val'", **ranks())
    + f"""SELECT round(p, 6) AS threshold, (tp_all - pos_below)::BIGINT AS tp, (tp_all - pos_below + fp_all - neg_below)::BIGINT AS predicted,
    round({F1_SQL}, 6) AS f1 FROM c""",
)
def q_curve(spark, sf):
    return E.threshold_curve(B.scores(spark, sf).filter(F.col("split") == "val"))


@query(
    "threshold_sweep",
    "M6",
    with_("scores", src="SELECT * FROM scores", **ranks(), curve=f"SELECT p AS t, {F1_SQL} AS f1 FROM c",
          grid=f"SELECT unnest([{', '.join(map(str, THRESHOLD_GRID))}])::DOUBLE AS t",
          cand="""SELECT t, f1 FROM curve UNION ALL SELECT g.t, coalesce((SELECT first(f1 ORDER BY c.t) FROM curve c WHERE c.t >= g.t), 0) FROM grid g""")
    + """SELECT round(first(t ORDER BY f1 DESC, t), 6) AS threshold, round(max(f1), 6) AS f1, 'validation F1 maximization' AS reason FROM cand""",
)
def q_sweep(spark, sf):
    return E.select_threshold(B.scores(spark, sf))


@query(
    "class_weights",
    "M2",
    with_("scores")
    + """SELECT sum(y)::BIGINT AS positives, count(*) - sum(y)::BIGINT AS negatives, round((count(*) - sum(y)) / sum(y), 6) AS positive_weight
    FROM scores WHERE split = 'train'""",
)
def q_weights(spark, sf):
    return E.class_weight(B.scores(spark, sf).filter(F.col("split") == "train"))


@query(
    "stage_weights",
    "M2 O8",
    with_("seqs", st=f"SELECT unnest({STAGE_ORDER}) AS stage", n="SELECT target_dominant_stage AS stage, count(*) AS n FROM seqs GROUP BY ALL")
    + """SELECT stage, coalesce(n, 0) AS n, round(CASE WHEN n > 0 THEN least((SELECT sum(n) FROM n) / (7.0 * n), 100.0) ELSE 0 END::DOUBLE, 6) AS weight
    FROM st LEFT JOIN n USING (stage)""",
)
def q_stage_weights(spark, sf):
    return E.stage_weights(B.sequences(spark, sf), "target_dominant_stage")


@query(
    "majority_baseline",
    "M3",
    with_("scores", prior="SELECT avg(y) AS p FROM scores WHERE split = 'train'")
    + """SELECT split, count(*) AS n, round((SELECT p FROM prior), 6) AS score, 0 AS flagged FROM scores GROUP BY split""",
)
def q_majority(spark, sf):
    m = E.majority_baseline(B.scores(spark, sf))
    return m.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.max("p").alias("score"), F.count(F.when(F.col("p") >= 0.5, 1)).alias("flagged")
    )


@query(
    "reference_rules",
    "M10",
    with_("scores")
    + f"""SELECT split, count(*) FILTER (WHERE host_id = '{NAMED}' AND y = 1) AS tp, count(*) FILTER (WHERE host_id = '{NAMED}' AND y = 0) AS fp,
    count(*) FILTER (WHERE host_id <> '{NAMED}' AND y = 1) AS fn, count(*) FILTER (WHERE host_id <> '{NAMED}' AND y = 0) AS tn FROM scores GROUP BY split""",
)
def q_identity(spark, sf):
    rule = B.scores(spark, sf).withColumn("p", (F.col("host_id") == NAMED).cast("double"))
    return E.confusion(rule, 0.5, ["split"]).select("split", "tp", "fp", "fn", "tn")


@query(
    "class_recall",
    "M9 N5",
    with_("scores", t="SELECT * FROM scores WHERE split = 'test' AND y = 1",
          l="SELECT cls, host_id, target_window_start AS w, lag(target_window_start) OVER (PARTITION BY cls, host_id ORDER BY target_window_start) AS pv FROM t",
          e="SELECT cls, count(*) FILTER (WHERE pv IS NULL OR w - pv > INTERVAL 30 MINUTE) AS episodes FROM l GROUP BY cls")
    + f"""SELECT cls, count(*) AS positives, count(*) FILTER (WHERE p >= 0.5) AS detected, count(*) FILTER (WHERE is_onset) AS onset_positives,
    count(*) FILTER (WHERE is_onset AND p >= 0.5) AS onset_detected, count(DISTINCT host_id) AS distinct_hosts,
    count(*) FILTER (WHERE host_id = '{NAMED}' AND p >= 0.5) AS detected_named_host, count(*) FILTER (WHERE host_id <> '{NAMED}' AND p >= 0.5) AS detected_other_hosts,
    cls IN (SELECT cls FROM scores WHERE split = 'train' AND y = 1) AS seen_in_training, any_value(episodes) AS episodes,
    round(count(*) FILTER (WHERE p >= 0.5) / count(*), 6) AS detection_rate, count(*) < 10 AS insufficient_data
    FROM t JOIN e USING (cls) GROUP BY cls""",
)
def q_class_recall(spark, sf):
    s = B.scores(spark, sf)
    test, train = s.filter(F.col("split") == "test"), s.filter(F.col("split") == "train")
    eps = joins.episode_counts(test.filter("y = 1"), "host_id", "target_window_start", ["cls"], 1800)
    return E.class_recall(test, train, 0.5, NAMED, eps)


@query(
    "class_auc",
    "M9",
    with_("scores", neg="SELECT p, count(*) AS n FROM scores WHERE split = 'test' AND y = 0 GROUP BY p",
          pos="SELECT cls, p, count(*) AS m FROM scores WHERE split = 'test' AND y = 1 GROUP BY ALL",
          tot="SELECT sum(n) AS nn FROM neg")
    + """SELECT cls, sum(m)::BIGINT AS positives, (SELECT nn FROM tot)::BIGINT AS negatives,
    round(sum(m * ((SELECT coalesce(sum(n), 0) FROM neg WHERE neg.p < pos.p) + (SELECT coalesce(sum(n), 0) FROM neg WHERE neg.p = pos.p) / 2.0))::DOUBLE
      / (sum(m) * (SELECT nn FROM tot))::DOUBLE, 6) AS roc_auc FROM pos GROUP BY cls""",
)
def q_class_auc(spark, sf):
    return E.class_auc(B.scores(spark, sf).filter(F.col("split") == "test"))


@query(
    "calibration_bins",
    "M12",
    with_("scores")
    + """SELECT CAST(least(floor(p * 10), 9) AS INT) AS bin, count(*) AS n, round(avg(p), 6) AS mean_predicted, round(avg(y), 6) AS observed_rate,
    round(sum((p - y) * (p - y)), 4) AS squared_error, CAST(least(floor(p * 10), 9) AS INT) / 10 AS bin_low, (CAST(least(floor(p * 10), 9) AS INT) + 1) / 10 AS bin_high
    FROM scores GROUP BY ALL""",
)
def q_bins(spark, sf):
    return E.calibration_bins(B.scores(spark, sf)).withColumn("squared_error", F.round("squared_error", 4))


@query(
    "calibration_metrics",
    "M12",
    with_("scores", b="SELECT split, least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS r FROM scores GROUP BY ALL",
          ece="SELECT split, sum(n * abs(mp - r)) / sum(n) AS ece FROM b GROUP BY split")
    + """SELECT split, count(*) AS n, sum(y)::BIGINT AS positives, round(avg((p - y) * (p - y)), 6) AS brier, round(any_value(ece), 6) AS ece,
    round(avg(p), 6) AS mean_predicted, round(avg(y), 6) AS observed_rate FROM scores JOIN ece USING (split) GROUP BY split""",
)
def q_calibration(spark, sf):
    return E.calibration_metrics(B.scores(spark, sf), keys=["split"])


STAGED = """SELECT CASE WHEN y = 0 THEN 'Benign' WHEN cls = 'stage-0' THEN 'Reconnaissance' WHEN cls = 'stage-1' THEN 'Initial Access' ELSE 'Impact' END AS stage,
  CASE WHEN p < 0.4 THEN 'Benign' WHEN cls IN ('stage-0', 'stage-2') THEN 'Reconnaissance' ELSE 'Impact' END AS pred, y FROM scores"""


def staged(spark, sf):
    s = B.scores(spark, sf)
    truth = (
        F.when(F.col("y") == 0, "Benign").when(F.col("cls") == "stage-0", "Reconnaissance")
        .when(F.col("cls") == "stage-1", "Initial Access").otherwise("Impact")
    )
    # three stage probabilities that put the wanted stage on top, or none above one half
    guess = (
        F.when(F.col("p") < 0.4, F.array(F.lit(0.8), F.lit(0.1), F.lit(0.1)))
        .when(F.col("cls").isin("stage-0", "stage-2"), F.array(F.lit(0.1), F.lit(0.6), F.lit(0.3)))
        .otherwise(F.array(F.lit(0.1), F.lit(0.2), F.lit(0.7)))
    )
    named = E.stage_decision(guess, ["Benign", "Reconnaissance", "Impact"])
    return s.select(truth.alias("stage"), named.alias("predicted_stage"), "y")


@query(
    "stage_confusion",
    "M13 M15",
    with_("scores", s=STAGED) + "SELECT stage AS truth, pred AS predicted, count(*) AS n FROM s GROUP BY ALL",
)
def q_confusion(spark, sf):
    return E.stage_confusion(staged(spark, sf))


@query(
    "stage_metrics",
    "M13",
    with_("scores", s=STAGED, names="SELECT stage FROM s UNION SELECT pred FROM s",
          f="""SELECT n.stage, 2.0 * count(*) FILTER (WHERE s.stage = n.stage AND s.pred = n.stage)
            / (count(*) FILTER (WHERE s.stage = n.stage) + count(*) FILTER (WHERE s.pred = n.stage)) AS f1 FROM names n, s GROUP BY n.stage""",
          major="SELECT first(stage ORDER BY c DESC) AS m FROM (SELECT stage, count(*) AS c FROM s GROUP BY stage)")
    + """SELECT count(*) AS n, round(avg((stage = pred)::INT), 6) AS accuracy, sum(y)::BIGINT AS attack_target_count,
    round(avg((stage = pred)::INT) FILTER (WHERE y = 1), 6) AS attack_stage_accuracy, round(avg((stage = (SELECT m FROM major))::INT), 6) AS majority_accuracy,
    round(avg((stage = (SELECT m FROM major))::INT) FILTER (WHERE y = 1), 6) AS majority_attack_accuracy, (SELECT round(avg(f1)::DOUBLE, 6) FROM f) AS macro_f1 FROM s""",
)
def q_stage_metrics(spark, sf):
    rows = staged(spark, sf)
    return E.stage_metrics(rows, E.majority_stage(rows))


NAMES_SQL = ", ".join(f"'{n}'" for n in MODEL_PRESENT)


def input_sql(alias: str, name: str) -> str:
    """A model input of a window in SQL; flags that the tables do not have count as none set."""
    return "0.0::DOUBLE" if name in ("ack_ratio", "rst_ratio", "fin_ratio", "psh_ratio") else f"{alias}.{name}::FLOAT::DOUBLE"


def logged_sql(alias: str, name: str) -> str:
    return f"ln(1 + {input_sql(alias, name)})" if name in LOG_FEATURES else input_sql(alias, name)


@query(
    "persistence_error",
    "M14",
    with_("seqs", "numbered",
          f="""SELECT s.sequence_id, s.host_id, s.last_idx, t.idx, row_number() OVER (PARTITION BY s.sequence_id ORDER BY t.window_idx) AS h
            FROM seqs s JOIN numbered t ON t.host_id = s.host_id AND t.window_start > s.seq_end_time""",
          e=f"""SELECT h, unnest([{NAMES_SQL}]) AS feature,
            unnest([{", ".join(f"{input_sql('b', n)} - {input_sql('t', n)}" for n in MODEL_PRESENT)}]) AS e
            FROM f JOIN numbered b ON b.host_id = f.host_id AND b.idx = f.last_idx JOIN numbered t ON t.host_id = f.host_id AND t.idx = f.idx WHERE h <= 3""")
    + """SELECT CAST(h AS INT) AS horizon, feature, count(*) AS count, round(avg(abs(e)), 6) AS persistence_mae,
    round(sqrt(avg(e * e)), 6) AS persistence_rmse FROM e GROUP BY h, feature""",
)
def q_persistence(spark, sf):
    """The error of every model input, by horizon and feature."""
    from ..operators import sequences as Q
    from ..sinks.tables import stage

    w = B.windows(spark, sf)
    s = stage(Q.build_sequences(w, B.LENGTH, 1, 1, B.WINDOW, B.STRIDE, MODEL_PRESENT), "sequences")
    m = Q.multi_horizon_targets(s, w, 3, window_seconds=B.WINDOW, stride_seconds=B.STRIDE, features=MODEL_PRESENT)
    rows = m.select(F.element_at("sequence_features", -1).alias("last"), F.col("future_features").alias("future"))
    return E.state_error(rows, names=MODEL_PRESENT)


@query(
    "score_summary",
    "M18",
    with_("scores", q="SELECT unnest([0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1])::DOUBLE AS fraction",
          l="SELECT split, y, list(p) AS ps, count(*) AS n, min(p) AS mn, max(p) AS mx, avg(p) AS mean, stddev_pop(p) AS std FROM scores GROUP BY ALL",
          g="""SELECT split, y, quantile_cont(p, [0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1]) AS qs FROM scores GROUP BY ALL""")
    + """SELECT split, y, unnest([0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1])::DOUBLE AS fraction, round(unnest(qs), 6) AS quantile, n,
    round(mn, 6) AS min, round(mx, 6) AS max, round(mean, 6) AS mean, round(std, 6) AS std FROM g JOIN l USING (split, y)""",
)
def q_summary(spark, sf):
    return eda.score_summary(B.scores(spark, sf), ["split", "y"])


@query(
    "upper_tail",
    "M18",
    with_("scores")
    + """SELECT unnest([0.1, 0.05, 0.01, 0.001, 0.0])::DOUBLE AS upper_tail,
    round(unnest(quantile_cont(p, [0.9, 0.95, 0.99, 0.999, 1.0])), 6) AS threshold FROM scores WHERE split = 'val'""",
)
def q_tail(spark, sf):
    return eda.upper_tail_thresholds(B.scores(spark, sf).filter(F.col("split") == "val"))


# --- preprocessing and models --------------------------------------------------------------


def model_rows(spark, sf):
    """Sequences of the label-free inputs that the test flows have, with label and split; nothing else is stored."""
    from ..operators import sequences as Q
    from ..sinks.tables import stage

    s = Q.build_sequences(B.windows(spark, sf), B.LENGTH, 1, 1, B.WINDOW, B.STRIDE, MODEL_PRESENT)
    inputs, y = F.col("sequence_features").alias("model_inputs"), F.col("target_attack_present").alias("y")
    return temporal_split(spread_small(stage(s.select("sequence_id", "seq_start_time", "target_window_end", inputs, y), "sequences")))


@query(
    "robust_params",
    "M1",
    with_("split", "numbered",
          v=f"""SELECT unnest([{NAMES_SQL}]) AS name,
            unnest([{", ".join(logged_sql("m", n) for n in MODEL_PRESENT)}]) AS x
            FROM split s JOIN numbered m ON m.host_id = s.host_id AND m.idx BETWEEN s.i AND s.last_idx WHERE s.split = 'train'""")
    + """SELECT name, round(median(x), 4) + 0.0 AS center,
    round(CASE WHEN quantile_cont(x, 0.75) - quantile_cont(x, 0.25) > 1e-15 THEN quantile_cont(x, 0.75) - quantile_cont(x, 0.25) ELSE 1 END, 4) AS scale
    FROM v GROUP BY name""",
    digits=4,
)
def q_robust(spark, sf):
    """The parameters of every model input."""
    train = model_rows(spark, sf).filter(F.col("split") == "train").select("model_inputs")
    return scaling.fit_scaler(train, names=MODEL_PRESENT).select("name", "center", "scale")


@query(
    "leakage_audit",
    "M19",
    with_("seqs", "cuts",
          r=f"""SELECT make_timestamp(epoch_us(seq_end_time) - {B.WINDOW * 1_000_000}) AS last_start, target_window_start, target_window_end,
            make_timestamp(CAST(c1 AS BIGINT)) AS cut_at FROM seqs, cuts""",
          n="""SELECT count(*) FILTER (WHERE last_start < cut_at) AS closed, count(*) FILTER (WHERE last_start >= cut_at) AS opened,
            count(*) FILTER (WHERE target_window_start >= cut_at) AS later, count(*) FILTER (WHERE last_start < cut_at AND target_window_start >= cut_at) AS leaks FROM r""")
    + """SELECT 'sequences' AS builder, closed, 0 AS inputs_changed, opened AS open_changed, later AS targets_changed FROM n
    UNION ALL SELECT 'planted leak', closed, leaks, opened, later FROM n""",
)
def q_leakage(spark, sf):
    """Alter all windows from the first cutoff on and build again: no input that was complete by then may change. The same
    audit of a builder that takes the target in as its last step has to count every such sequence."""
    from ..operators import sequences as Q
    from ..operators.splits import split_cutoffs
    from ..sinks.tables import stage

    w = B.windows(spark, sf)
    at = split_cutoffs(Q.build_sequences(w, B.LENGTH, 1, 1, B.WINDOW, B.STRIDE, ["flow_count"])).select(
        F.col("val_cutoff_us").cast("bigint")
    )
    at = stage(at, "cutoff").scalar()

    def build(windows):
        s = Q.build_sequences(windows, B.LENGTH, 1, 1, B.WINDOW, B.STRIDE, MODEL_PRESENT)
        last = F.timestamp_micros(F.unix_micros("seq_end_time") - B.WINDOW * 1_000_000)
        return s.select("sequence_id", last.alias("last_start"), F.col("sequence_features").alias("inputs"), F.col("target_features").alias("target"))

    def leaky(windows):
        steps = F.concat(F.slice("inputs", 1, B.LENGTH - 1), F.array(F.col("target").cast("array<float>")))
        return build(windows).withColumn("inputs", steps)

    present = [n for n in MODEL_PRESENT if n in w.columns]
    found = [E.leak_counts(f, w, at, present).select(F.lit(n).alias("builder"), "*") for n, f in (("sequences", build), ("planted leak", leaky))]
    return found[0].union(found[1])


STEP_SQL = {
    "x": f"""SELECT s.sequence_id, s.split, s.target_attack_present AS y, m.idx - s.i AS step, unnest(range({len(MODEL_PRESENT)})) AS f,
      unnest([{", ".join(logged_sql("m", n) for n in MODEL_PRESENT)}]) AS x,
      unnest([{", ".join(input_sql("m", n) for n in MODEL_PRESENT)}]) AS raw
      FROM split s JOIN numbered m ON m.host_id = s.host_id AND m.idx BETWEEN s.i AND s.last_idx""",
    "par": """SELECT f, median(x) AS c, CASE WHEN quantile_cont(x, 0.75) - quantile_cont(x, 0.25) > 1e-15 THEN quantile_cont(x, 0.75) - quantile_cont(x, 0.25) ELSE 1 END AS sc
      FROM x WHERE split = 'train' GROUP BY f""",
    "z": f"""SELECT x.* EXCLUDE (x), ((x - c) / sc)::FLOAT::DOUBLE AS z, (((step * {len(MODEL_PRESENT)} + f) * 37 % 101) - 50) / 400.0::DOUBLE AS w FROM x JOIN par USING (f)""",
}
INTERCEPT = -0.25


def stored_model(spark):
    """A model table as an earlier training would have left it, its weights from a rule."""
    n = B.LENGTH * len(MODEL_PRESENT)
    weight = F.when(F.col("position") < 0, INTERCEPT).otherwise((F.col("position") * 37 % 101 - 50) / 400)
    return models.linear_model(spark.range(-1, n).select(F.col("id").cast("int").alias("position")).withColumn("weight", weight))


def scaled_rows(spark, sf):
    """Scaled anew where they are read, which takes less than to store them and read them back."""
    from ..sinks.tables import stage

    rows = model_rows(spark, sf)
    params = stage(scaling.fit_scaler(rows.filter(F.col("split") == "train"), names=MODEL_PRESENT), "scaler")
    return scaling.apply_scaler(rows, params, names=MODEL_PRESENT)


@query(
    "score_sequences",
    "M16 C8 K9",
    with_("split", "numbered", **STEP_SQL, s=f"SELECT sequence_id, split, y, 1 / (1 + exp(-({INTERCEPT} + sum(w * z)))) AS p FROM z GROUP BY ALL")
    + """SELECT sequence_id, split, y, round(p, 6) AS attack_probability, p >= 0.5 AS predicted_attack, 0.5::DOUBLE AS threshold FROM s""",
)
def q_score(spark, sf):
    """All sequences scored with a stored model on train-only scaling."""
    scored = models.predict_sequences(models.score_logistic(scaled_rows(spark, sf), stored_model(spark)), 0.5)
    return scored.select("sequence_id", "split", "y", "attack_probability", "predicted_attack", "threshold")


@query(
    "linear_attribution",
    "M17 O3",
    with_("split", "numbered", **STEP_SQL,
          mean="SELECT step, f, avg(z) AS m FROM z WHERE split = 'train' GROUP BY step, f",
          a="SELECT sequence_id, f, step, raw, w * (z - m) AS c FROM z JOIN mean USING (step, f)",
          t="""SELECT sequence_id, f, sum(c) AS total, first(step ORDER BY abs(c) DESC, step) AS top, max(raw) FILTER (WHERE step = 9) AS raw FROM a GROUP BY sequence_id, f
            QUALIFY row_number() OVER (PARTITION BY sequence_id ORDER BY abs(sum(c)) DESC, f) <= 5""")
    + f"""SELECT sequence_id, CAST(row_number() OVER (PARTITION BY sequence_id ORDER BY abs(total) DESC, f) AS INT) AS place,
    [{NAMES_SQL}][f + 1] AS feature, round(total, 6) AS attribution, CASE WHEN total > 0 THEN 'towards attack' WHEN total < 0 THEN 'towards benign' ELSE 'none' END AS direction,
    CAST(top AS INT) AS most_influential_step, round(raw, 6) AS last_window_value FROM t""",
)
def q_attribution(spark, sf):
    scaled = scaled_rows(spark, sf)
    background = models.background_mean(scaled.filter(F.col("split") == "train"))
    out = models.linear_attribution(scaled, stored_model(spark), background, names=MODEL_PRESENT)
    return models.top_features(out, 5, MODEL_PRESENT)


@query(
    "logistic_optimum",
    "M4",
    f"SELECT CAST(range - 1 AS INT) AS position, true AS optimal FROM range({B.LENGTH * len(MODEL_PRESENT) + 1})",
)
def q_optimum(spark, sf):
    """The fitted model's gradient of the balanced, penalised loss, worked out from all training rows: 0 within a hundredth."""
    train = scaled_rows(spark, sf).filter(F.col("split") == "train")
    return models.penalised_gradient(train, models.fit_logistic(train)).select("position", (F.abs("gradient") < 0.01).alias("optimal"))


def newton_sql(steps: int = 14) -> dict[str, str]:
    """Newton's method for slope and intercept on logit(p), one common table per step."""
    out = {
        "v": """SELECT y, ln(q / (1 - q)) AS x, count(*) AS w FROM (SELECT y, greatest(least(p, 1 - 1e-7), 1e-7) AS q FROM scores WHERE split = 'val') GROUP BY ALL""",
        "n0": "SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b",
    }
    for k in range(steps):
        out[f"n{k + 1}"] = f"""SELECT a - (h22 * ga - h12 * gb) / (h11 * h22 - h12 * h12) AS a, b - (h11 * gb - h12 * ga) / (h11 * h22 - h12 * h12) AS b FROM (
          SELECT a, b, sum(w * (s - y) * x) + 1e-6 * a AS ga, sum(w * (s - y)) AS gb, sum(w * s * (1 - s) * x * x) + 1e-6 AS h11,
            sum(w * s * (1 - s) * x) AS h12, sum(w * s * (1 - s)) AS h22 FROM (SELECT *, 1 / (1 + exp(-(a * x + b))) AS s FROM v, n{k}) GROUP BY a, b)"""
    return out


@query(
    "platt",
    "M11 F10",
    with_("scores", **newton_sql(),
          u="""SELECT 'raw' AS kind, y, p FROM scores WHERE split = 'test' UNION ALL
            SELECT 'calibrated', y, 1 / (1 + exp(-(a * ln(q / (1 - q)) + b))) FROM (SELECT y, greatest(least(p, 1 - 1e-7), 1e-7) AS q FROM scores WHERE split = 'test'), n14""",
          b="SELECT kind, least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS r FROM u GROUP BY ALL",
          ece="SELECT kind, sum(n * abs(mp - r)) / sum(n) AS ece FROM b GROUP BY kind")
    + """SELECT kind, count(*) AS n, sum(y)::BIGINT AS positives, round(avg((p - y) * (p - y)), 4) AS brier, round(any_value(ece), 4) AS ece,
    round(avg(p), 4) AS mean_predicted, round(avg(y), 4) AS observed_rate, round(any_value(n14.a), 4) AS slope, round(any_value(n14.b), 4) AS intercept
    FROM u JOIN ece USING (kind), n14 GROUP BY kind""",
    digits=4,
)
def q_platt(spark, sf):
    s = B.scores(spark, sf)
    a, b = models.fit_platt(s.filter(F.col("split") == "val"))
    test = s.filter(F.col("split") == "test").withColumn("raw", F.col("p"))
    both = test.withColumn("p", models.calibrate(F.col("p"), a, b))
    raw = E.calibration_metrics(test).withColumn("kind", F.lit("raw"))
    cal = E.calibration_metrics(both).withColumn("kind", F.lit("calibrated"))
    return raw.unionByName(cal).withColumns({"slope": F.lit(a), "intercept": F.lit(b)})


@query("fold_rounds", "M21")
def q_folds(spark, sf):
    """All day folds over the whole table: fit, choose the threshold, report.

    Day folds need sequences shorter than a day, so the windows here are one hour long.
    """
    from ..operators.cleaning import flow_features
    from ..operators.sequences import build_sequences
    from ..operators.splits import fold_days
    from ..operators.windows import host_windows
    from ..sinks.tables import stage

    hour = 3600
    w = stage(host_windows(flow_features(B.labelled_flows(spark, sf)), hour, hour), "hourly")
    inputs, y = F.col("sequence_features").alias("model_inputs"), F.col("target_attack_present").alias("y")
    seqs = build_sequences(w, 2, 1, 1, hour, hour, MODEL_PRESENT).select("seq_start_time", "target_window_end", inputs, y)
    rows = spread_small(stage(seqs, "inputs"))
    days = [tuple(r) for r in fold_days(rows).filter("val_day is not null").orderBy("test_day").collect()]
    return models.run_folds(rows, days, names=MODEL_PRESENT)
