import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowhorizon.operators import evaluation as E, models, scaling

NAMES = ["flow_count", "duration_mean", "byte_count_mean"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    out = []
    for i in range(300):
        y = int(rng.random() < 0.3)
        x = rng.gamma(2, 5, (4, 3)) * (1 + 3 * y)
        out.append((f"s{i}", x.tolist(), y, "train" if i < 180 else "val" if i < 240 else "test"))
    return spark.createDataFrame(out, "sequence_id string, model_inputs array<array<float>>, y int, split string")


def test_scaler_matches_numpy_and_inverts(spark, rows):
    train = rows.filter("split = 'train'")
    params = scaling.fit_scaler(train, names=NAMES)
    x = np.concatenate([np.array(r[0]) for r in train.select("model_inputs").collect()])
    x[:, 0] = np.log1p(x[:, 0])
    q = np.quantile(x, [0.25, 0.5, 0.75], axis=0)
    for r in params.collect():
        i = r["feature"]
        assert r["center"] == pytest.approx(q[1, i], rel=1e-6) and r["scale"] == pytest.approx(q[2, i] - q[0, i], rel=1e-6)
    scaled = scaling.apply_scaler(rows, params, names=NAMES)
    back = scaling.invert_scaler(scaled.select(F.col("scaled")[0].alias("v"), F.col("model_inputs")[0].alias("o")), params, "v", NAMES)
    for r in back.limit(20).collect():
        assert np.allclose(r["raw"], r["o"], rtol=1e-3)
    assert scaling.scaler_differences(params, scaling.fit_scaler(train, names=NAMES)).count() == 0
    assert scaling.scaler_differences(params, scaling.fit_scaler(rows, names=NAMES)).count() > 0


def test_scaler_imputes_missing_values(spark):
    inf = float("inf")
    data = [[1.0], [2.0], [3.0], [10.0], [inf], [float("nan")], [None]]
    df = spark.createDataFrame([([v],) for v in data], "model_inputs array<array<float>>")
    p = scaling.fit_scaler(df, names=["duration_mean"]).first()
    filled = np.array([1, 2, 3, 10, 2.5, 2.5, 2.5])
    assert p["median"] == 2.5 and p["center"] == np.median(filled)
    assert p["scale"] == pytest.approx(np.quantile(filled, 0.75) - np.quantile(filled, 0.25))
    same = spark.createDataFrame([([[4.0]],), ([[4.0]],)], "model_inputs array<array<float>>")
    assert scaling.fit_scaler(same, names=["duration_mean"]).first()["scale"] == 1.0


def test_logistic_scores_attribution_and_round(spark, rows):
    params = scaling.fit_scaler(rows.filter("split = 'train'"), names=NAMES)
    scaled = scaling.apply_scaler(rows, params, names=NAMES)
    model = models.fit_logistic(scaled.filter("split = 'train'"))
    scored = models.score_logistic(scaled, model)
    from flowhorizon.functions.vectors import flat_vector

    direct = model.transform(scored.withColumn("features", flat_vector(F.col("scaled"))))
    for r in direct.select("p", "probability").limit(30).collect():
        assert r["p"] == pytest.approx(float(r["probability"][1]), abs=1e-9)
    background = models.background_mean(scaled.filter("split = 'train'"))
    out = models.linear_attribution(scaled, model, background, names=NAMES)
    assert out.agg(F.max("additivity_gap")).first()[0] < 1e-9
    top = models.top_features(out, 2, NAMES).filter("sequence_id = 's0'").orderBy("place").collect()
    full = out.filter("sequence_id = 's0'").first()
    order = np.argsort(-np.abs(full["feature_totals"]))
    assert [t["feature"] for t in top] == [NAMES[i] for i in order[:2]]
    column = np.abs(np.array(full["attributions"])[:, order[0]])
    assert top[0]["most_influential_step"] == int(column.argmax())
    r = models.run_round(rows, names=NAMES).first()
    assert r["roc_auc"] > 0.8 and r["tp"] + r["fn"] == rows.filter("split = 'test' and y = 1").count()
    with pytest.raises(ValueError):
        models.fit_logistic(scaled.filter("y = 0"))


def test_external_model(spark, rows):
    def predict(batch: pd.Series) -> pd.Series:
        return batch.map(lambda m: float(np.stack(m).mean()))

    out = models.score_with(rows.select("sequence_id", "model_inputs"), predict, "model_inputs").collect()
    assert out[0]["p"] == pytest.approx(np.mean(out[0]["model_inputs"]), rel=1e-5)


def brute_auc(y, p):
    pos, neg = [a for a, b in zip(p, y) if b], [a for a, b in zip(p, y) if not b]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("seed", range(3))
def test_threshold_and_ranking_match_brute_force(spark, seed):
    rng = random.Random(seed)
    data = [(int(rng.random() < 0.3), rng.choice([0.0, 1.0, round(rng.random(), 2), rng.random() * 1e-9])) for _ in range(200)]
    df = spark.createDataFrame(data, "y int, p double")
    y, p = zip(*data)
    grid = [0.01, 0.05, 0.1, 0.2, 0.3, 0.5]

    def f1(t):
        tp = sum(a for a, b in data if b >= t)
        pred = sum(b >= t for b in p)
        return 2 * tp / (pred + sum(y)) if tp else 0.0

    best = min(sorted({*grid, *p}), key=lambda t: (-f1(t), t))
    got = E.select_threshold(df).first()
    assert got["threshold"] == best and got["f1"] == pytest.approx(f1(best))
    r = E.ranking_metrics(df).first()
    assert r["roc_auc"] == pytest.approx(brute_auc(y, p))
    order = sorted(set(p), reverse=True)
    ap, last = 0.0, 0.0
    for t in order:
        tp = sum(a for a, b in data if b >= t)
        pred = sum(b >= t for b in p)
        ap, last = ap + (tp / sum(y) - last) * tp / pred, tp / sum(y)
    assert r["average_precision"] == pytest.approx(ap)


def test_degenerate_labels(spark):
    df = spark.createDataFrame([(0, 0.2), (0, 0.9)], "y int, p double")
    t = E.select_threshold(df).first()
    assert t["threshold"] == 0.5 and t["f1"] is None
    m = E.metrics_at(df, 0.5).first()
    assert m["roc_auc"] is None and m["average_precision"] is None and m["precision"] == 0 and m["false_positive_rate"] == 0.5
    assert E.class_weight(df).first()["positive_weight"] == 1.0


def test_platt_is_monotone_and_helps(spark):
    rng = np.random.default_rng(4)
    y = (rng.random(800) < 0.1).astype(int)
    p = 1 / (1 + np.exp(-(rng.normal(0, 1, 800) + 2.5 * y + 1.5)))
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y int, p double")
    a, b = models.fit_platt(df)
    assert a > 0
    cal = df.withColumn("raw", F.col("p")).withColumn("p", models.calibrate(F.col("p"), a, b))
    before, after = E.calibration_metrics(df).first(), E.calibration_metrics(cal).first()
    assert after["brier"] < before["brier"] and after["ece"] < before["ece"]
    ranks = [r["p"] for r in cal.orderBy("raw").collect()]
    assert ranks == sorted(ranks)
    with pytest.raises(ValueError, match="both classes"):
        models.fit_platt(df.filter("y = 0"))
    with pytest.raises(ValueError, match="slope"):
        models.fit_platt(df.withColumn("p", 1 - F.col("p")))


def test_calibration_edges(spark):
    df = spark.createDataFrame([(1, 1.0), (0, 0.0), (1, 0.95)], "y int, p double")
    bins = {r["bin"]: r["n"] for r in E.calibration_bins(df).collect()}
    assert bins == {0: 1, 9: 2}


def test_state_error_with_prediction(spark):
    df = spark.createDataFrame(
        [([1.0, 2.0], [[2.0, 2.0], [3.0, 2.0]], [[2.0, 2.0], [1.0, 2.0]]), ([0.0, 0.0], [[1.0, 1.0]], [[0.0, 1.0]])],
        "last array<float>, future array<array<float>>, pred array<array<float>>",
    )
    r = {x["horizon"]: x for x in E.state_error(df, "pred").collect()}
    assert (r[1]["count"], r[2]["count"]) == (2, 1)
    assert r[1]["persistence_mae"] == pytest.approx(3 / 4) and r[1]["mae"] == pytest.approx(1 / 4) and r[2]["rmse"] == pytest.approx(2**0.5)


def test_all_model_inputs_are_reported(spark, sf):
    from flowhorizon.catalog import load
    from flowhorizon.catalog.evaluation_queries import MODEL_PRESENT

    names = {r["name"] for r in load()[0]["robust_params"](spark, sf).collect()}
    errors = {(r.horizon, r.feature) for r in load()[0]["persistence_error"](spark, sf).collect()}
    assert names == set(MODEL_PRESENT) and errors == {(h, n) for h in (1, 2, 3) for n in MODEL_PRESENT}


def test_gradient_is_zero_at_the_fit_only(spark, rows):
    params = scaling.fit_scaler(rows.filter("split = 'train'"), names=NAMES)
    train = scaling.apply_scaler(rows, params, names=NAMES).filter("split = 'train'")
    model = models.fit_logistic(train)
    at = {r["position"]: r["gradient"] for r in models.penalised_gradient(train, model).collect()}
    assert set(at) == set(range(-1, 12)) and max(map(abs, at.values())) < 0.01
    table = models.linear_rows(model, spark)
    again = models.linear_model(table)
    assert list(again.coefficients) == list(model.coefficients) and again.intercept == model.intercept
    off = models.LinearModel(again.coefficients * 0.0, 1.0)
    x = np.array([np.concatenate([[1.0], np.ravel(r["scaled"])]) for r in train.select("scaled", "y").orderBy("sequence_id").collect()])
    y = np.array([r["y"] for r in train.orderBy("sequence_id").collect()])
    beta = np.array([off.intercept, *off.coefficients])
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    want = x.T @ (w * (1 / (1 + np.exp(-x @ beta)) - y)) / len(y) + np.append(0, beta[1:]) / len(y)
    got = {r["position"]: r["gradient"] for r in models.penalised_gradient(train, off).collect()}
    assert np.allclose([got[i] for i in range(-1, 12)], want) and abs(got[-1]) > 0.05
    with pytest.raises(ValueError, match="model table"):
        models.linear_model(table.filter("position <> 3"))


def test_equal_steps_are_taken_apart_once(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]],), ([[3.0, 4.0], [1.0, 2.0]],)], "model_inputs array<array<float>>")
    got = scaling.feature_values(df, "model_inputs", ["a", "b"]).collect()
    assert sorted((r["feature"], r["value"], r["times"]) for r in got) == [(0, 1.0, 2), (0, 3.0, 2), (1, 2.0, 2), (1, 4.0, 2)]


def test_fit_reaches_the_optimum_of_dependent_inputs(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(600, 1))
    x = np.hstack([base + 0.001 * rng.normal(size=(600, 6)), 1000 * rng.gamma(0.1, 1, (600, 2))])
    y = (rng.random(600) < 1 / (1 + np.exp(-3 * base[:, 0]))).astype(int)
    train = spark.createDataFrame([([a[:4].tolist(), a[4:].tolist()], int(b)) for a, b in zip(x, y)], "scaled array<array<float>>, y int")
    gradient = models.penalised_gradient(train, models.fit_logistic(train)).collect()
    assert len(gradient) == 9 and max(abs(r["gradient"]) for r in gradient) < 1e-5


def test_missing_and_short_steps_are_scaled_as_before(spark):
    params = spark.createDataFrame([(0, "a", 2.0, 1.0, 4.0), (1, "flow_count", 0.5, 0.5, 0.25)], "feature int, name string, median double, center double, scale double")
    rows = [(1, [[5.0, 0.0], [None, float("inf")]]), (2, []), (3, None), (4, [[1.0, 3.0], None])]
    df = spark.createDataFrame(rows, "id int, model_inputs array<array<float>>")
    got = {r["id"]: r["scaled"] for r in scaling.apply_scaler(df, params, names=["a", "flow_count"]).collect()}
    assert got[1] == [[1.0, -2.0], [0.25, 0.0]] and got[2] == [] and got[3] is None
    assert got[4] == [[0.0, pytest.approx((np.log1p(3) - 0.5) * 4)], [0.25, 0.0]]


def test_folds_share_their_passes_and_equal_single_rounds(spark):
    import datetime as dt

    from flowhorizon.operators.splits import assign_fold

    rng = np.random.default_rng(5)
    out = []
    for i in range(320):
        y, begin = int(rng.random() < 0.4), dt.datetime(2024, 1, 1 + i % 8, 12)
        x = rng.gamma(2, 5, (2, 3)) * (1 + 2 * y)
        x[0, 1] = np.nan if i % 9 == 0 else x[0, 1]
        out.append((x.tolist(), y, begin, begin + dt.timedelta(hours=24 if i % 10 == 0 else 2)))
    df = spark.createDataFrame(out, "model_inputs array<array<float>>, y int, seq_start_time timestamp, target_window_end timestamp")
    df = df.repartition(4).cache()
    folds = [(dt.date(2024, 1, d), dt.date(2024, 1, d - 1 or 2)) for d in range(1, 9)]

    def last_job() -> int:
        spark.sparkContext.setJobGroup("count", "")
        spark.range(1).rdd.count()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return max(spark.sparkContext.statusTracker().getJobIdsForGroup("count"))

    before = last_job()
    got = {r["test_day"]: r.asDict() for r in models.run_folds(df, folds, names=NAMES).collect()}
    assert len(got) == 8 and last_job() - before < 200
    for fold in folds[:2]:
        want = models.run_round(assign_fold(df, *fold), names=NAMES).first().asDict()
        assert {k: pytest.approx(v, rel=1e-5) for k, v in want.items()} == {k: got[fold[0]][k] for k in want}


def test_scored_sequences_are_stored_once_without_copies(spark, sf):
    from pathlib import Path

    from flowhorizon.catalog import load
    from flowhorizon.session import ensure_checkpoint_dir

    folder = Path(ensure_checkpoint_dir(spark).removeprefix("file:")) / "flowhorizon-stage"
    before = set(folder.glob("*"))
    assert load()[0]["score_sequences"](spark, sf).filter("attack_probability is null").count() == 0
    made = [p for p in set(folder.glob("*")) - before if p.name.split("-")[0] in ("sequences", "inputs", "train", "scaled")]
    assert len(made) == 1 and set(spark.read.parquet(str(made[0])).columns) == {"sequence_id", "seq_start_time", "target_window_end", "model_inputs", "y"}
