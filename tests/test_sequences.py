import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowhorizon.functions.lookups import LOG_FEATURES, MODEL_FEATURES, WINDOW_FEATURES
from flowhorizon.operators import hostrel, sequences as Q, splits

T0 = dt.datetime(2024, 1, 1)
DDL = (
    "host_id string, window_idx bigint, window_start timestamp, window_end timestamp, flow_count double, "
    "attack_flow_ratio double, attack_present int, dominant_class string, dominant_stage string, stage_distribution string, "
    "label_confidence string"
)


def window_rows(host, ks, attack_from=10**9, w=60, s=30):
    out = []
    for k in ks:
        start = T0 + dt.timedelta(seconds=k * s)
        bad = k >= attack_from
        cls = "Botnet" if bad else "Benign"
        out.append((host, k, start, start + dt.timedelta(seconds=w), float(k), float(bad), int(bad), cls, cls, "{}", "x"))
    return out


def test_counts_ids_and_targets(spark):
    w = spark.createDataFrame(window_rows("a", range(20)) + window_rows("b", range(3)), DDL)
    s = Q.build_sequences(w, 5, 2)
    rows = s.orderBy("seq_start_time").collect()
    # targets start after the end: run i ends at (i+6)*30 s, so the second eligible window is i+8
    assert len(rows) == 12 and rows[0]["sequence_id"] == "a_seq_0" and {r["host_id"] for r in rows} == {"a"}
    assert all(r["target_window_start"] > r["seq_end_time"] for r in rows)
    assert rows[0]["target_features"][0] == 8.0 and [v[0] for v in rows[0]["sequence_features"]] == [0, 1, 2, 3, 4]
    assert Q.build_sequences(w, 5, 2, 3).count() == 4
    for bad in ((0, 1, 1), (5, 0, 1), (5, 1, 0)):
        with pytest.raises(ValueError):
            Q.build_sequences(w, *bad)


def test_onsets(spark):
    w = spark.createDataFrame(window_rows("a", range(30), attack_from=10), DDL)
    s = Q.build_sequences(w, 5, 1)
    positive = {int(r["sequence_id"].rsplit("_", 1)[1]): r["target_is_onset"] for r in s.collect() if r["target_attack_present"]}
    assert sorted(i for i, onset in positive.items() if onset) == [3, 4, 5]
    assert not positive[6]


@pytest.mark.parametrize("block", [8, 2048])
def test_matches_brute_force_with_gaps(spark, block):
    rng = random.Random(block)
    rows, hosts = [], {"hot": 400, "x": 30, "y": 7}
    for host, n in hosts.items():
        rows += window_rows(host, sorted(rng.sample(range(n * 2), n)), attack_from=int(n * 1.5))
    length, horizon = 4, 2
    want = {}
    for host in hosts:
        mine = [r for r in rows if r[0] == host]
        for i in range(len(mine) - length + 1):
            end = mine[i + length - 1][3]
            later = [r for r in mine[i + length :] if r[2] > end]
            if len(later) >= horizon:
                want[f"{host}_seq_{i}"] = (mine[i][2], end, later[horizon - 1][2], later[horizon - 1][6])
    s = Q.build_sequences(spark.createDataFrame(rows, DDL).repartition(5), length, horizon, block=block)
    got = {r["sequence_id"]: (r["seq_start_time"], r["seq_end_time"], r["target_window_start"], r["target_attack_present"]) for r in s.collect()}
    assert got == want


def test_split_rules(spark):
    w = spark.createDataFrame(window_rows("a", range(200)) + window_rows("b", range(50, 180)), DDL)
    s = Q.build_sequences(w, 5, 1)
    out = splits.temporal_split(s)
    rows = out.collect()
    ends = sorted(r["target_window_end"].timestamp() for r in rows)
    c1, c2 = np.quantile(ends, 0.6), np.quantile(ends, 0.8)
    for r in rows:
        a, b = r["seq_start_time"].timestamp(), r["target_window_end"].timestamp()
        want = "test" if a >= c2 else "val" if a >= c1 and b <= c2 else "train" if b <= c1 else "boundary_excluded"
        assert r["split"] == want
    # labels and row order do not matter
    flipped = splits.temporal_split(s.withColumn("target_attack_present", 1 - F.col("target_attack_present")).repartition(9))
    assert {r["sequence_id"]: r["split"] for r in flipped.collect()} == {r["sequence_id"]: r["split"] for r in rows}
    with pytest.raises(ValueError):
        splits.temporal_split(s, 0.9, 0.2, 0.2)


def full_sequences(spark, n=40, hosts=("a", "b"), level=5.0, w=60, s=30):
    """Sequences with all thirty features."""
    rng = np.random.default_rng(0)
    rows = []
    for h in hosts:
        for i in range(n):
            start = T0 + dt.timedelta(seconds=i * s)
            m = np.full((3, len(WINDOW_FEATURES)), level) if level else rng.gamma(2, 3, (3, len(WINDOW_FEATURES)))
            rows.append((f"{h}_seq_{i}", h, start, start + dt.timedelta(seconds=w + 2 * s), m.tolist(), m[0].tolist(), i % 2, "Benign", "Benign", "train"))
    return spark.createDataFrame(
        rows,
        "sequence_id string, host_id string, seq_start_time timestamp, seq_end_time timestamp, sequence_features array<array<float>>, "
        "target_features array<float>, target_attack_present int, target_dominant_class string, target_dominant_stage string, split string",
    )


def test_host_relative_inputs_are_causal(spark):
    s = Q.select_model_inputs(full_sequences(spark, level=None), 3)
    out = {r["sequence_id"]: np.array(r["relative_inputs"]) for r in hostrel.host_relative_inputs(s, lookback=8, block=16).collect()}
    raw = {r["sequence_id"]: np.array(r["model_inputs"]) for r in s.collect()}
    logs = np.array([n in LOG_FEATURES for n in MODEL_FEATURES])
    logged = {k: np.where(logs, np.sign(v) * np.log1p(np.abs(v)), v) for k, v in raw.items()}
    for h in ("a", "b"):
        for i in range(40):
            k = max(0, i - 1)  # windows of 60 s every 30 s: the one before has not ended yet
            x = logged[f"{h}_seq_{i}"]
            want = np.zeros_like(x) if k < 5 else x - np.median([logged[f"{h}_seq_{j}"][0] for j in range(max(0, k - 8), k)], axis=0)
            assert np.allclose(out[f"{h}_seq_{i}"], want, atol=1e-4)
    flat = Q.select_model_inputs(full_sequences(spark, level=5.0), 3)
    assert all(np.abs(np.array(r[0])).max() < 1e-6 for r in hostrel.host_relative_inputs(flat).select("relative_inputs").collect())


def test_model_inputs_reject_bad_shapes(spark):
    s = full_sequences(spark, 3)
    assert len(Q.select_model_inputs(s).first()["model_inputs"][0]) == 28
    with pytest.raises(Exception, match="unexpected shape"):
        Q.select_model_inputs(s, 7).collect()
    with pytest.raises(ValueError, match="lacks columns"):
        Q.select_model_inputs(s.drop("split"))


def test_horizon_consistency(spark):
    rows = window_rows("a", range(30))
    w = spark.createDataFrame(rows, DDL)
    for f in WINDOW_FEATURES:
        if f not in w.columns:
            w = w.withColumn(f, F.col("flow_count") * 2)
    s = Q.build_sequences(w, 4, 1)
    m = Q.multi_horizon_targets(s, w, 3)
    assert Q.horizon_mismatches(m).count() == 0
    broken = m.withColumn("target_features", F.transform("target_features", lambda x: x + 1))
    assert Q.horizon_mismatches(broken).count() == m.filter("future_count > 0").count()
    assert m.agg(F.max("future_count")).first()[0] == 3
    ids = spark.createDataFrame([("a_seq_0",), ("nope",)], "sequence_id string")
    with pytest.raises(ValueError):
        Q.filter_sequences(s, ids)
    assert Q.filter_sequences(s, ids.filter("sequence_id <> 'nope'")).count() == 1 and [r[0] for r in Q.missing_ids(s, ids).collect()] == ["nope"]


def test_day_folds(spark):
    rows = []
    for d in range(4):
        rows += [(f"s{d}", T0 + dt.timedelta(days=d, hours=3), T0 + dt.timedelta(days=d, hours=4)),
                 (f"over{d}", T0 + dt.timedelta(days=d, hours=23), T0 + dt.timedelta(days=d + 1, hours=1))]
    s = spark.createDataFrame(rows, "sequence_id string, seq_start_time timestamp, target_window_end timestamp")
    days = {str(r["test_day"]): str(r["val_day"]) for r in splits.fold_days(s).collect()}
    assert days == {"2024-01-01": "2024-01-02", "2024-01-02": "2024-01-03", "2024-01-03": "2024-01-02", "2024-01-04": "2024-01-03"}
    fold = {r["sequence_id"]: r["split"] for r in splits.assign_fold(s, "2024-01-03", "2024-01-02").collect()}
    assert fold == {"s0": "train", "over0": "purged", "s1": "val", "over1": "purged", "s2": "test", "over2": "purged", "s3": "train", "over3": "train"}


def test_horizon_check_stores_the_windows_only(spark, sf):
    from pathlib import Path

    from flowhorizon.catalog import load
    from flowhorizon.session import ensure_checkpoint_dir

    folder = Path(ensure_checkpoint_dir(spark).removeprefix("file:")) / "flowhorizon-stage"
    before = set(folder.glob("*"))
    got = {r["targets"]: r for r in load()[0]["horizon_check"](spark, sf).collect()}
    assert got["stored"]["mismatches"] == 0 < got["altered"]["mismatches"] < got["altered"]["sequences"]
    assert {p.name.split("-")[0] for p in set(folder.glob("*")) - before} == {"windows"}
