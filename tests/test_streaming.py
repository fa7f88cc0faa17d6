import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from flowhorizon.operators.cleaning import flow_features
from flowhorizon.operators.sequences import inference_sequences
from flowhorizon.operators.windows import host_windows
from flowhorizon.streaming import replay, scoring, sequences, windows

T0 = dt.datetime(2024, 1, 1, 0, 0, 7)
DDL = (
    "timestamp timestamp, source_ip string, destination_ip string, source_port int, destination_port int, protocol string, "
    "flow_duration double, packet_count double, byte_count double, syn_count double, dataset_label string, "
    "normalized_attack_class string, attack_stage string"
)
W, S = 60, 30
KEEP = ["host_id", "window_idx", "window_start", "window_end", "flow_count", "unique_destination_ips", "connection_burst_max",
        "attack_present", "dominant_class", "stage_distribution"]


def make_rows(n=400, seed=1, span=1200):
    rng = random.Random(seed)
    times = sorted(rng.random() * span for _ in range(n))
    times[0] = 0.0
    out = []
    for t in times:
        bad = rng.random() < 0.1
        cls, stage = ("Botnet", "Impact") if bad else ("Benign", "Benign")
        out.append((T0 + dt.timedelta(seconds=round(t, 3)), f"h{rng.randrange(3)}", f"d{rng.randrange(4)}", rng.randrange(9), rng.randrange(5),
                    "TCP", 1.0, 2.0, float(rng.randrange(9)), 1.0, "x", cls, stage))
    return out


def run(spark, batches, folder, lateness=0):
    """Feed batches one after the other; returns closed windows and the query."""
    live = str(folder / "live")
    spark.createDataFrame([], DDL).write.parquet(live)
    flows = flow_features(replay.read_live(spark, live, spark.createDataFrame([], DDL).schema))
    stream = windows.stream_host_windows(flows, T0.isoformat(), W, S, lateness)
    query = None
    for b in batches:
        spark.createDataFrame(b, DDL).coalesce(1).write.mode("append").parquet(live)
        query = windows.write_closed_windows(stream.drop("stage_counts"), str(folder / "out"), str(folder / "ck"))
        query.awaitTermination()
    return spark.read.schema(stream.drop("stage_counts").schema).parquet(str(folder / "out")), query


def as_set(df):
    return {tuple(r) for r in df.select(*KEEP).collect()}


@pytest.mark.parametrize("chunks", [1, 4])
def test_stream_equals_closed_batch_windows(spark, tmp_path, chunks):
    rows = make_rows()
    size = -(-len(rows) // chunks)
    out, _ = run(spark, [rows[i : i + size] for i in range(0, len(rows), size)], tmp_path)
    batch = host_windows(flow_features(spark.createDataFrame(rows, DDL)), W, S)
    last = max(r[0] for r in rows)
    closed = batch.filter(F.col("window_end") <= F.lit(last))
    assert as_set(out) == as_set(closed) and out.count() > 50
    # nothing is lost at the end of the stream
    rest = windows.flush_windows(flow_features(spark.createDataFrame(rows, DDL)), out, T0.isoformat(), W, S)
    assert as_set(out) | as_set(rest) == as_set(batch) and not as_set(out) & as_set(rest)


def test_late_flows(spark, tmp_path):
    rows = make_rows(100, 2)
    late = [(T0 + dt.timedelta(seconds=5), *rows[0][1:])]
    out, query = run(spark, [rows, late], tmp_path, lateness=60)
    # the late flow's windows were closed in the first run
    assert scoring.stream_progress(spark, [query]).agg(F.sum("late_rows")).first()[0] > 0
    batch = host_windows(flow_features(spark.createDataFrame(rows, DDL)), W, S)
    first = {r for r in as_set(batch) if r[1] == 0}
    assert {r for r in as_set(out) if r[1] == 0} == first


def test_lateness_keeps_windows_open(spark, tmp_path):
    rows = make_rows(200, 3)
    held = [r for i, r in enumerate(rows) if i % 50 == 20]
    prompt = [r for r in rows if r not in held]
    # whatever is held back arrives before the allowed lateness has passed
    cut = max(r[0] for r in held)
    first = [r for r in prompt if r[0] <= cut + dt.timedelta(seconds=20)]
    second = held + [r for r in prompt if r not in first]
    span = (max(r[0] for r in first) - min(r[0] for r in held)).total_seconds()
    out, _ = run(spark, [first, second], tmp_path, lateness=span + 1)
    batch = host_windows(flow_features(spark.createDataFrame(rows, DDL)), W, S)
    limit = max(r[0] for r in rows) - dt.timedelta(seconds=span + 1)
    assert as_set(out) == as_set(batch.filter(F.col("window_end") <= F.lit(limit)))


def test_duplicates_within_watermark(spark, tmp_path):
    rows = make_rows(50, 4)
    live = str(tmp_path / "live")
    spark.createDataFrame(rows + rows[:20], DDL).write.parquet(live)
    stream = windows.deduplicate(replay.read_live(spark, live, spark.createDataFrame([], DDL).schema), "1 hour")
    q = stream.writeStream.format("memory").queryName("dedup").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("dedup").count() == len({r[:6] for r in rows})


def test_stream_sequences_equal_batch(spark, tmp_path):
    sequences.use_rocksdb(spark)
    batch = host_windows(flow_features(spark.createDataFrame(make_rows(), DDL)), W, S).drop("stage_counts")
    names = ["flow_count", "byte_count_sum"]
    live = str(tmp_path / "closed")
    got = []
    stream = None
    for lo, hi in ((0, 15), (15, 30), (30, 99)):
        batch.filter((F.col("window_idx") >= lo) & (F.col("window_idx") < hi)).coalesce(1).write.mode("append").parquet(live)
        stream = sequences.stream_sequences(spark.readStream.schema(batch.schema).parquet(live), 5, names)
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "s")).option("checkpointLocation", str(tmp_path / "c"))
        q.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(stream.schema).parquet(str(tmp_path / "s"))
    want = inference_sequences(batch, 5, names)
    key = lambda df: {(r["host_id"], r["seq_start_time"], r["seq_end_time"], str([list(v) for v in r["sequence_features"]])) for r in df.collect()}
    assert key(got) == key(want) and got.count() == want.count() > 50


def test_replay_and_status(spark, tmp_path):
    rows = make_rows(120, 6)
    live, out, state = (str(tmp_path / n) for n in ("live", "out", "ck"))
    flows = scoring.observed(replay.read_live(spark, live, spark.createDataFrame([], DDL).schema))
    stream = windows.stream_host_windows(flow_features(flows), T0.isoformat(), W, S, 0).drop("stage_counts")

    def go():
        query = windows.write_closed_windows(stream, out, state)
        query.awaitTermination()
        return query

    parts = [spark.createDataFrame(r, DDL) for r in (rows[:70], rows[70:] + [(T0, *rows[0][1:])])]
    progress = scoring.stream_progress(spark, replay.play(parts, live, go))
    closed = spark.read.schema(stream.schema).parquet(out)
    results = spark.createDataFrame([("a", T0, T0, 0.9, True, 0.5), ("b", T0, T0 + dt.timedelta(1), 0.1, False, 0.5)],
                                    "host_id string, seq_start_time timestamp, seq_end_time timestamp, attack_probability double, predicted_attack boolean, threshold double")
    s = scoring.stream_status(progress, closed, results).first()
    assert (s["flows_seen"], s["first_event"], s["last_event"]) == (121, T0, max(r[0] for r in rows))
    assert s["late_rows"] > 0 and s["watermark"] == s["last_event"] and s["hosts_tracked"] == 3
    assert s["windows_closed"] == closed.select("window_idx").distinct().count() and (s["sequences_scored"], s["alerts"]) == (2, 1)
    assert [r["host_id"] for r in scoring.latest_results(results, 5).collect()] == ["b", "a"]
    assert scoring.latest_results(results, 5, alerts_only=True).count() == 1


def test_a_batch_that_runs_again_counts_once(spark, tmp_path):
    """Stopped between write and commit, a batch is run again after the restart."""
    live, out, state = (str(tmp_path / n) for n in ("live", "out", "ck"))
    rows = make_rows(60, 8)
    stream = replay.read_live(spark, live, spark.createDataFrame([], DDL).schema).select("timestamp", "source_ip")
    go = lambda: scoring.write_results(stream, out, state).awaitTermination()
    replay.play([spark.createDataFrame(rows[:30], DDL), spark.createDataFrame(rows[30:], DDL)], live, go)
    got = scoring.read_results(spark, out, stream.schema)
    assert got.count() == 60
    last = max((tmp_path / "ck" / "commits").glob("[0-9]*"), key=lambda f: int(f.name))
    for f in (last, last.with_name(f".{last.name}.crc")):
        f.unlink(missing_ok=True)
    go()
    assert sorted(r["timestamp"] for r in scoring.read_results(spark, out, stream.schema).collect()) == sorted(r[0] for r in rows)


def test_stream_needs_overlapping_or_touching_windows(spark):
    with pytest.raises(ValueError):
        windows.stream_host_windows(spark.createDataFrame([], DDL), 0, 10, 20)
