"""Binary, calibration, stage and state metrics from label and score columns.

Scores are first counted per distinct value. Ranks, cumulative counts and thresholds then come
from a segmented scan over two levels of score buckets, so neither a host nor a crowded score
range is ever ordered in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.lookups import STAGE_ORDER, THRESHOLD_GRID
from ..plans.scan import join_keys, running
from ..sinks.tables import stage

FINE, COARSE = 1 << 24, 1 << 12


def ratio(n: Column, d: Column) -> Column:
    """0 on an empty denominator."""
    return F.when(d > 0, n / d).otherwise(0.0)


def rate(n: Column, d: Column) -> Column:
    """NULL on an empty denominator."""
    return F.when(d > 0, n / d)


def score_counts(scored: DataFrame, keys: list[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    """Per (keys, distinct score): positives and negatives."""
    return scored.groupBy(*keys, F.col(p).cast("double").alias("p")).agg(
        F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col(y) == 1, 0).otherwise(1)).alias("neg"),
    )


def cumulative_counts(counts: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Add positives and negatives strictly below each score, and the key's totals.

    The count table is read by several branches of the scan, so it is written once instead of
    scanning the scored rows for each of them.
    """
    counts = stage(counts, "scores")
    keyed = counts.withColumn("_all", F.lit(1))
    ks = [*keys, "_all"]
    levels = [
        ("_fine", F.floor(F.col("p") * FINE)),
        ("_coarse", F.floor(F.col("_fine") * F.lit(COARSE / FINE))),
    ]
    below = running(keyed, ks, ["p"], levels, {"pos_below": ("sum", "pos"), "neg_below": ("sum", "neg")})
    totals = counts.groupBy(*keys).agg(F.sum("pos").alias("pos_total"), F.sum("neg").alias("neg_total"))
    if not keys:
        out = below.withColumns({c: totals.select(c).scalar() for c in ("pos_total", "neg_total")})
    else:
        out = join_keys(below, totals, list(keys))
    return out.drop("_all")


def ranking_metrics(scored: DataFrame, keys: list[str] = ()) -> DataFrame:
    """ROC-AUC with average tie ranks (NULL for one class) and average precision (NULL without
    positives), per key."""
    c = cumulative_counts(score_counts(scored, keys), keys)
    tp, fp = F.col("pos_total") - F.col("pos_below"), F.col("neg_total") - F.col("neg_below")
    agg = c.groupBy(*keys).agg(
        F.sum(F.col("pos") + F.col("neg")).alias("n"),
        F.max("pos_total").alias("positives"),
        F.max("neg_total").alias("negatives"),
        F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2)).alias("_u"),
        F.sum(F.when(F.col("pos") > 0, F.col("pos") * (tp / (tp + fp)))).alias("_ap"),
    )
    pn = F.col("positives").cast("double") * F.col("negatives")
    return agg.select(
        *keys,
        "n",
        "positives",
        "negatives",
        rate(F.col("_u"), pn).alias("roc_auc"),
        rate(F.col("_ap"), F.col("positives")).alias("average_precision"),
    )


def confusion(scored: DataFrame, threshold, keys: list[str] = ()) -> DataFrame:
    """Confusion counts and derived rates at ``p >= threshold`` (number or column)."""
    flag = F.col("p") >= (threshold if isinstance(threshold, Column) else F.lit(float(threshold)))
    pos = F.col("y") == 1
    c = scored.groupBy(*keys).agg(
        F.count(F.when(~flag & ~pos, 1)).alias("tn"),
        F.count(F.when(flag & ~pos, 1)).alias("fp"),
        F.count(F.when(~flag & pos, 1)).alias("fn"),
        F.count(F.when(flag & pos, 1)).alias("tp"),
    )
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.withColumns(
        {
            "precision": ratio(tp, tp + fp),
            "recall": ratio(tp, tp + fn),
            "f1": ratio(2 * tp, 2 * tp + fp + fn),
            "false_positive_rate": ratio(fp, fp + tn),
            "positive_predictions": tp + fp,
            "actual_positives": tp + fn,
            "actual_negatives": tn + fp,
        }
    )


def metrics_at(scored: DataFrame, threshold, keys: list[str] = ()) -> DataFrame:
    """Everything at once: confusion part and ranking part, joined on the keys (if any)."""
    at = confusion(scored, threshold, keys)
    ranks = ranking_metrics(scored, keys)
    if keys:
        return join_keys(at, ranks.select(*keys, "roc_auc", "average_precision"), list(keys), "left")
    return at.withColumns(
        {
            "roc_auc": ranks.select("roc_auc").scalar(),
            "average_precision": ranks.select("average_precision").scalar(),
        }
    )


def threshold_curve(scored: DataFrame, keys: list[str] = ()) -> DataFrame:
    """F1 at every distinct score (``p >= score``), per key."""
    c = cumulative_counts(score_counts(scored, keys), keys)
    tp, fp = F.col("pos_total") - F.col("pos_below"), F.col("neg_total") - F.col("neg_below")
    f1 = F.when(tp > 0, 2 * tp / (tp + fp + F.col("pos_total"))).otherwise(0.0)
    return c.select(*keys, F.col("p").alias("threshold"), tp.alias("tp"), (tp + fp).alias("predicted"), f1.alias("f1"))


def select_threshold(scored: DataFrame, grid: list[float] = THRESHOLD_GRID, keys: list[str] = ()) -> DataFrame:
    """Best-F1 threshold among the grid and all scores; lowest on ties, 0.5 without positives. One row per key that has
    scores, or just one without keys.

    A grid value that is no score predicts what the smallest score above it predicts.
    """
    curve = threshold_curve(scored, keys)
    best = F.min(F.struct((-F.col("f1")).alias("loss"), F.col("threshold").alias("t")))
    steps = [
        F.min(F.when(F.col("threshold") >= g, F.struct(F.col("threshold"), F.col("f1")))).alias(f"g{i}")
        for i, g in enumerate(grid)
    ]
    row = curve.groupBy(*keys).agg(best.alias("best"), F.max("tp").alias("positives"), *steps)
    candidates = [F.col("best")] + [
        F.struct((-F.coalesce(F.col(f"g{i}.f1"), F.lit(0.0))).alias("loss"), F.lit(float(g)).alias("t"))
        for i, g in enumerate(grid)
    ]
    win = row.withColumn("_w", F.array_min(F.array(*candidates)))
    found = F.coalesce(F.col("positives"), F.lit(0)) > 0
    return win.select(
        *keys,
        F.when(found, F.col("_w.t")).otherwise(0.5).alias("threshold"),
        F.when(found, -F.col("_w.loss")).alias("f1"),
        F.when(found, "validation F1 maximization")
        .otherwise("no positive validation targets; default 0.5")
        .alias("reason"),
    )


def class_weight(scored: DataFrame, y: str = "y") -> DataFrame:
    """negatives / positives, 1 without positives."""
    counts = scored.agg(
        F.count(F.when(F.col(y) == 1, 1)).alias("positives"), F.count(F.when(F.col(y) == 0, 1)).alias("negatives")
    )
    weight = F.when(F.col("positives") > 0, F.col("negatives") / F.col("positives")).otherwise(1.0)
    return counts.withColumn("positive_weight", weight)


def stage_weights(rows: DataFrame, stage: str, stages: list[str] = STAGE_ORDER, cap: float = 100.0) -> DataFrame:
    """Inverse-frequency weights, clipped, 0 for unseen stages."""
    row = rows.agg(*[F.count(F.when(F.col(stage) == s, 1)).alias(f"s{i}") for i, s in enumerate(stages)])
    total = sum((F.col(f"s{i}") for i in range(1, len(stages))), F.col("s0"))
    pairs = [
        F.struct(
            F.lit(s).alias("stage"),
            F.col(f"s{i}").alias("n"),
            F.when(F.col(f"s{i}") > 0, F.least(total / (len(stages) * F.col(f"s{i}")), F.lit(cap)))
            .otherwise(0.0)
            .alias("weight"),
        )
        for i, s in enumerate(stages)
    ]
    return row.select(F.explode(F.array(*pairs)).alias("r")).select("r.*")


def majority_baseline(scored: DataFrame) -> DataFrame:
    """The train prior as the score of every row."""
    prior = scored.filter(F.col("split") == "train").agg(F.coalesce(F.avg("y"), F.lit(0.0))).scalar()
    return scored.withColumn("p", prior)


def host_check(scored: DataFrame, threshold: float, named_host: str) -> DataFrame:
    """Named host against the rest: flagged negatives, detected positives, rates, AUC."""
    grouped = scored.withColumn(
        "host_group", F.when(F.col("host_id") == named_host, named_host).otherwise("other_hosts")
    )
    c = confusion(grouped, threshold, ["host_group"])
    r = ranking_metrics(grouped, ["host_group"]).select("host_group", "n", "roc_auc")
    return c.join(r, "host_group").select(
        "host_group",
        "n",
        F.col("actual_positives").alias("pos"),
        F.col("actual_negatives").alias("neg"),
        F.col("fp").alias("neg_flagged"),
        rate(F.col("fp"), F.col("actual_negatives")).alias("neg_flag_rate"),
        F.col("tp").alias("pos_detected"),
        rate(F.col("tp"), F.col("actual_positives")).alias("pos_detect_rate"),
        "roc_auc",
    )


def per_host_auc(scored: DataFrame) -> DataFrame:
    """ROC-AUC of every host that has both labels."""
    r = ranking_metrics(scored, ["host_id"])
    return r.filter((F.col("positives") > 0) & (F.col("negatives") > 0)).select("host_id", "n", "positives", "roc_auc")


def class_recall(
    test: DataFrame, train: DataFrame, threshold: float, named_host: str, episodes: DataFrame, min_positives: int = 10
) -> DataFrame:
    """Per attack class: detection, onset detection, hosts, episodes, seen-in-training and
    too-little-data flags, split by the named host. ``episodes`` is (cls, episodes)."""
    hit = F.col("p") >= threshold
    pos = test.filter(F.col("y") == 1)
    named = F.col("host_id") == named_host
    per_host = pos.groupBy("cls", "host_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(hit, 1)).alias("hit"),
        F.count(F.when(F.col("is_onset"), 1)).alias("onset"),
        F.count(F.when(F.col("is_onset") & hit, 1)).alias("onset_hit"),
    )
    per = per_host.groupBy("cls").agg(
        F.sum("n").alias("positives"),
        F.sum("hit").alias("detected"),
        F.sum("onset").alias("onset_positives"),
        F.sum("onset_hit").alias("onset_detected"),
        F.count(F.lit(1)).alias("distinct_hosts"),
        F.coalesce(F.sum(F.when(named, F.col("hit"))), F.lit(0)).alias("detected_named_host"),
        F.coalesce(F.sum(F.when(~named, F.col("hit"))), F.lit(0)).alias("detected_other_hosts"),
    )
    seen = train.filter(F.col("y") == 1).select("cls").distinct().withColumn("seen_in_training", F.lit(True))
    return (
        per.join(seen, "cls", "left")
        .join(episodes.select("cls", "episodes"), "cls", "left")
        .withColumns(
            {
                "seen_in_training": F.coalesce("seen_in_training", F.lit(False)),
                "detection_rate": F.col("detected") / F.col("positives"),
                "insufficient_data": F.col("positives") < min_positives,
            }
        )
    )


def class_auc(test: DataFrame, named_host: str | None = None) -> DataFrame:
    """ROC-AUC of each class's positives against all negatives, or on one host only.

    Negatives are shared, so they are counted once per score and met by each class through the
    distinct scores, never row by row.
    """
    rows = test.filter(F.col("host_id") == named_host) if named_host else test
    neg = score_counts(rows.filter(F.col("y") == 0)).select("p", F.col("neg").alias("shared"))
    pos = rows.filter(F.col("y") == 1).groupBy("cls", F.col("p").cast("double").alias("p")).agg(
        F.count(F.lit(1)).alias("pos")
    )
    scores = pos.select("p").distinct().join(neg, "p", "full_outer")
    base = scores.select("p", F.lit(0).cast("bigint").alias("pos"), F.coalesce("shared", F.lit(0)).alias("neg"))
    ranked = cumulative_counts(base).select(F.col("p").alias("_p"), "neg", "neg_below", "neg_total")
    joined = pos.join(ranked, F.col("p") == F.col("_p"))
    agg = joined.groupBy("cls").agg(
        F.sum("pos").alias("positives"),
        F.max("neg_total").alias("negatives"),
        F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2)).alias("_u"),
    )
    return agg.select(
        "cls", "positives", "negatives", rate(F.col("_u"), F.col("positives").cast("double") * F.col("negatives")).alias("roc_auc")
    )


def calibration_bins(scored: DataFrame, bins: int = 10, keys: list[str] = ()) -> DataFrame:
    """Reliability table over equal-width bins, the last one closed; empty bins are absent."""
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int").alias("bin")
    return (
        scored.groupBy(*keys, b)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("p").alias("mean_predicted"),
            F.avg(F.col("y").cast("double")).alias("observed_rate"),
            F.sum((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("squared_error"),
        )
        .withColumns({"bin_low": F.col("bin") / bins, "bin_high": (F.col("bin") + 1) / bins})
    )


def calibration_metrics(scored: DataFrame, bins: int = 10, keys: list[str] = ()) -> DataFrame:
    """Brier score and expected calibration error from the bin table alone."""
    t = calibration_bins(scored, bins, keys)
    n = F.sum("n")
    return t.groupBy(*keys).agg(
        n.alias("n"),
        F.bround(F.sum(F.col("observed_rate") * F.col("n")), 0).cast("bigint").alias("positives"),
        (F.sum("squared_error") / n).alias("brier"),
        (F.sum(F.col("n") * F.abs(F.col("mean_predicted") - F.col("observed_rate"))) / n).alias("ece"),
        (F.sum(F.col("mean_predicted") * F.col("n")) / n).alias("mean_predicted"),
        (F.sum(F.col("observed_rate") * F.col("n")) / n).alias("observed_rate"),
    )


# --- stages and future state ---------------------------------------------------------------


def stage_confusion(rows: DataFrame, truth: str = "stage", predicted: str = "predicted_stage") -> DataFrame:
    return rows.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def stage_support(matrix: DataFrame) -> DataFrame:
    """Per stage: truth support, predictions, hits, precision, recall, F1."""
    both = matrix.select(F.explode(F.array(
        F.struct(F.col("truth").alias("stage"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"),
                 F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0).alias("hits")),
        F.struct(F.col("predicted").alias("stage"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"),
                 F.lit(0).cast("bigint").alias("hits")),
    )).alias("r")).select("r.*")
    s = both.groupBy("stage").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predictions"), F.sum("hits").alias("hits")
    )
    hits, sup, pred = F.col("hits"), F.col("support"), F.col("predictions")
    return s.withColumns(
        {"precision": ratio(hits, pred), "recall": ratio(hits, sup), "f1": ratio(2 * hits, sup + pred)}
    )


def stage_metrics(rows: DataFrame, majority: Column | str = "Benign") -> DataFrame:
    """Accuracy, macro-F1, attack-only accuracy, majority baseline.

    ``rows`` is (stage, predicted_stage, y). The matrix is stages x stages, so all later steps
    run on a few dozen rows.
    """
    m = rows.groupBy(F.col("stage").alias("truth"), F.col("predicted_stage").alias("predicted"), "y").agg(
        F.count(F.lit(1)).alias("n")
    )
    macro = stage_support(m.select("truth", "predicted", "n")).agg(F.avg("f1")).scalar()
    major = majority if isinstance(majority, Column) else F.lit(majority)
    right, attack = F.col("truth") == F.col("predicted"), F.col("y") == 1
    base = F.col("truth") == major

    def n(cond):
        return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))

    return m.agg(
        F.sum("n").alias("n"),
        rate(n(right), F.sum("n")).alias("accuracy"),
        n(attack).alias("attack_target_count"),
        rate(n(attack & right), n(attack)).alias("attack_stage_accuracy"),
        rate(n(base), F.sum("n")).alias("majority_accuracy"),
        rate(n(attack & base), n(attack)).alias("majority_attack_accuracy"),
    ).withColumn("macro_f1", macro)


def majority_stage(train: DataFrame, stage: str = "stage") -> Column:
    """Most frequent stage, the earlier one in canonical order on ties."""
    from ..functions.lookups import stage_rank

    counts = train.groupBy(stage).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.min_by(stage, F.struct(-F.col("n"), stage_rank(F.col(stage))))).scalar()


def state_error(rows: DataFrame, predicted: str | None = None, names: list[str] | None = None) -> DataFrame:
    """Per horizon: count, MAE and RMSE of a prediction (optional) and of persistence; with the ``names`` of the
    vectors' features, per horizon and feature.

    ``rows`` has ``future`` and optionally ``predicted`` as array of horizon vectors and ``last``
    as the last input vector; absent horizons are simply missing from ``future``.
    """
    h = rows.select(
        "last",
        F.posexplode("future").alias("h", "target"),
        *([F.col(predicted).alias("_pred")] if predicted else []),
    )
    diff = F.posexplode(F.arrays_zip(F.zip_with("last", "target", lambda a, b: a.cast("double") - b.cast("double")).alias("e"),
                                  *([F.zip_with(F.get("_pred", F.col("h")), "target", lambda a, b: a.cast("double") - b.cast("double")).alias("m")]
                                    if predicted else [])))
    cells = h.select((F.col("h") + 1).alias("horizon"), F.array_size("target").alias("_w"), diff.alias("_f", "d"))
    aggs = [
        (F.count(F.lit(1)) / (F.lit(1) if names else F.max("_w"))).cast("bigint").alias("count"),
        F.avg(F.abs("d.e")).alias("persistence_mae"),
        F.sqrt(F.avg(F.col("d.e") * F.col("d.e"))).alias("persistence_rmse"),
    ]
    if predicted:
        aggs += [F.avg(F.abs("d.m")).alias("mae"), F.sqrt(F.avg(F.col("d.m") * F.col("d.m"))).alias("rmse")]
    if names:
        feature = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_f") + 1)
        return cells.groupBy("horizon", feature.alias("feature")).agg(*aggs)
    return cells.groupBy("horizon").agg(*aggs)


def stage_decision(probabilities: Column, stages: list[str], threshold: float = 0.5, uncertain: str = "UNCERTAIN") -> Column:
    """Most probable stage when its probability reaches the threshold, else the uncertain label."""
    top = F.array_max(probabilities)
    name = F.element_at(F.array(*[F.lit(s) for s in stages]), F.array_position(probabilities, top).cast("int"))
    return F.when(top >= threshold, name).otherwise(F.lit(uncertain))


def split_order_violations(split: DataFrame) -> DataFrame:
    """Pairs of splits that overlap in time; all counts must be 0."""
    t = split.groupBy("split").agg(F.min("seq_start_time").alias("lo"), F.max("target_window_end").alias("hi"))

    def edge(s, c):
        return t.filter(F.col("split") == s).agg(F.max(c)).scalar()

    return split.agg(
        F.count(F.when((F.col("split") == "val") & (F.col("seq_start_time") < edge("train", "hi")), 1)).alias(
            "val_before_train_end"
        ),
        F.count(F.when((F.col("split") == "test") & (F.col("seq_start_time") < edge("val", "hi")), 1)).alias(
            "test_before_val_end"
        ),
    )


def leak_counts(build: Callable[[DataFrame], DataFrame], windows: DataFrame, at: Column, features: list[str]) -> DataFrame:
    """Build sequences from the windows, and again after every window from ``at`` (microseconds) on was altered; count what changed.

    One row: ``closed`` sequences, whose inputs begin before ``at`` throughout, and how many of their ``inputs`` changed
    (each one a leak); ``open_changed``, the other sequences with changed inputs; ``targets_changed``. ``build`` returns
    sequence_id, last_start (of the last input window), inputs and target.
    """
    late = F.unix_micros("window_start") >= at
    new = {f: F.when(late, F.col(f) * 2 + 1).otherwise(F.col(f)).cast(windows.schema[f].dataType) for f in features}
    first, again = (
        build(w).select("sequence_id", "last_start", F.xxhash64("inputs").alias("i"), F.xxhash64("target").alias("t"))
        for w in (windows, windows.withColumns(new))
    )
    both = first.join(again.toDF("sequence_id", "_l", "_i", "_t"), "sequence_id", "full_outer")
    closed = F.unix_micros(F.coalesce("last_start", "_l")) < at
    moved, aimed = ~F.col("i").eqNullSafe(F.col("_i")), ~F.col("t").eqNullSafe(F.col("_t"))
    return both.agg(
        F.count_if(closed).alias("closed"),
        F.count_if(closed & moved).alias("inputs_changed"),
        F.count_if(~closed & moved).alias("open_changed"),
        F.count_if(aimed).alias("targets_changed"),
    )
