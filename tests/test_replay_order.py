import random

from pyspark.sql import functions as F
from test_streaming import DDL, S, T0, W, as_set, make_rows

from flowhorizon.operators.cleaning import flow_features
from flowhorizon.operators.windows import host_windows
from flowhorizon.streaming import replay, scoring, windows


def test_a_table_comes_in_order_of_time(spark, tmp_path):
    """A shuffled table, a file a batch: no row is late, every closed window is whole, and only a small part is open at a time."""
    rows = make_rows(600, 9)
    shuffled = random.Random(2).sample(rows, len(rows))
    live, out, state = (str(tmp_path / n) for n in ("live", "out", "ck"))
    stored = spark.createDataFrame(shuffled, DDL).repartition(8)
    assert replay.write_in_order(stored, live, "timestamp", rows=60) > 5
    stream = spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", 1).parquet(live)
    w = windows.stream_host_windows(flow_features(stream), T0.isoformat(), W, S, 0).drop("stage_counts")
    query = windows.write_closed_windows(w, out, state)
    query.awaitTermination()
    progress = scoring.stream_progress(spark, [query])
    assert progress.agg(F.sum("late_rows")).first()[0] == 0
    batch = host_windows(flow_features(spark.createDataFrame(rows, DDL)), W, S)
    closed = batch.filter(F.col("window_end") <= F.lit(max(r[0] for r in rows)))
    assert as_set(spark.read.schema(w.schema).parquet(out)) == as_set(closed)
    # one row of state for an open window of a host, and not for every window of the table
    assert progress.agg(F.max("open_rows")).first()[0] < batch.count() / 2


def test_parts_follow_each_other_in_order(spark, tmp_path):
    """Every part is in order by itself, behind the part before."""
    live = str(tmp_path / "live")
    rows = make_rows(200, 3)
    parts = [spark.createDataFrame(random.Random(k).sample(rows[a:b], b - a), DDL).repartition(4) for k, (a, b) in enumerate([(0, 120), (120, 200)])]
    seen = []
    replay.play(parts, live, lambda: seen.append(spark.read.schema(DDL).parquet(live).count()), "timestamp")
    assert seen == [120, 200]
