import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowhorizon.plans.intervals import interval_join
from flowhorizon.plans.quantiles import exact_quantiles, grid_quantiles, ordered_key, select_ranks
from flowhorizon.plans.scan import row_index, running, spread_small, with_halo
from flowhorizon.plans.segments import FOREVER, first_at, pieces


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(3)
    rows = [(("hot" if rng.random() < 0.5 else f"k{rng.randrange(9)}"), rng.randrange(500), i, rng.randrange(-5, 6))
            for i in range(1500)]
    return rows, spark.createDataFrame(rows, "key string, t bigint, tie bigint, v bigint").repartition(7)


def brute_running(rows):
    out, groups = {}, defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    for g in groups.values():
        total, top = 0, None
        for i, r in enumerate(sorted(g, key=lambda r: (r[1], r[2]))):
            out[r[2]] = (i, total, top)
            total, top = total + r[3], r[3] if top is None else max(top, r[3])
    return out


@pytest.mark.parametrize("levels", [[], [40], [40, 200]])
def test_running_matches_one_ordered_pass(skewed, levels):
    rows, df = skewed
    df = df.withColumn("one", F.lit(1).cast("bigint"))
    names = ["_a", "_b"]
    segs = [(n, F.floor(F.col("t" if i == 0 else "_a") / (w if i == 0 else w // levels[0]))) for i, (n, w) in enumerate(zip(names, levels))]
    out = running(df, ["key"], ["t", "tie"], segs, {"n": ("sum", "one"), "s": ("sum", "v"), "m": ("max", "v")})
    assert {r["tie"]: (r["n"], r["s"], r["m"]) for r in out.collect()} == brute_running(rows)


def test_row_index_and_halo(skewed):
    rows, df = skewed
    indexed = row_index(df, ["key"], ["t", "tie"], F.floor(F.col("t") / 64))
    want = {k: v[0] for k, v in brute_running(rows).items()}
    assert {r["tie"]: r["row_idx"] for r in indexed.collect()} == want
    halo = with_halo(indexed, "row_idx", before=3, after=2, block=10).collect()
    assert sum(r["_own"] for r in halo) == len(rows)
    have = defaultdict(set)
    for r in halo:
        have[r["key"], r["_block"]].add(r["row_idx"])
    size = defaultdict(int)
    for r in rows:
        size[r[0]] += 1
    for key, n in size.items():
        for i in range(n):
            need = set(range(max(0, i - 3), min(n, i + 3)))
            assert need <= have[key, i // 10]


def test_interval_join_matches_nested_loops(spark):
    rng = random.Random(5)
    points = [(i, f"h{rng.randrange(3)}", rng.randrange(10**9)) for i in range(400)]
    spans = []
    for i in range(120):
        s = rng.randrange(10**9)
        spans.append((i, f"h{rng.randrange(3)}", s, s + rng.choice([0, 10**5, 3 * 10**7, 9 * 10**8])))
    p = spark.createDataFrame(points, "pid bigint, ph string, t bigint")
    s = spark.createDataFrame(spans, "sid bigint, sh string, a bigint, b bigint")
    got = sorted((r["pid"], r["sid"]) for r in interval_join(p, s, [("ph", "sh")], "t", "a", "b", 1).collect())
    want = sorted((i, j) for i, h, t in points for j, g, a, b in spans if h == g and a <= t <= b)
    assert got == want


def test_interval_join_of_nothing(spark):
    p = spark.createDataFrame([(1, "a", 5)], "pid bigint, ph string, t bigint")
    s = spark.createDataFrame([], "sid bigint, sh string, a bigint, b bigint")
    assert interval_join(p, s, [("ph", "sh")], "t", "a", "b").count() == 0


def test_exact_quantiles(spark):
    rng = np.random.default_rng(1)
    data = {"a": rng.gamma(2, 5, 3001), "b": rng.integers(0, 4, 500).astype(float), "c": np.array([7.0])}
    rows = [(g, float(v)) for g, vs in data.items() for v in vs] + [("a", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    fractions = [0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]
    got = exact_quantiles(df, "v", fractions, ["g"]).collect()
    assert len(got) == 3 * len(fractions)
    for r in got:
        assert r["quantile"] == pytest.approx(np.quantile(data[r["g"]], r["fraction"]), abs=1e-12)
        assert r["n"] == len(data[r["g"]])
    tiny = spark.createDataFrame([("t", float(v)) for v in (1, 2, 2.5, 2.5, 2.5, 3, 10)], "g string, v double")
    r = {x["fraction"]: x["quantile"] for x in exact_quantiles(tiny, "v", [0.25, 0.75], ["g"]).collect()}
    assert r == {0.25: 2.25, 0.75: 2.75}
    got = grid_quantiles(df.filter("g = 'b'"), "v", [0.3, 0.5]).first()["quantiles"]
    assert got == pytest.approx(list(np.quantile(data["b"], [0.3, 0.5])))


def test_ordered_key_is_in_the_order_of_doubles(spark):
    rng = np.random.default_rng(3)
    x = np.frombuffer(rng.bytes(8 * 3000), np.float64)
    powers = [s * 2.0**e * f for e in (-1074, -1073, -1023, -1022, -1, 0, 1, 52, 53, 1022, 1023) for f in (1.0, 1 + 2**-52, 1.5) for s in (1, -1)]
    values = [*x[np.isfinite(x)].tolist(), *powers, 0.0, 1.7976931348623157e308, 5e-324, float("inf"), -float("inf"), 2.0, 1.9999999999999998]
    rows = spark.createDataFrame([(v,) for v in values], "v double").withColumn("k", ordered_key(F.col("v"))).collect()
    bits = lambda v: np.float64(v).view(np.int64)
    for r in rows:
        assert r["k"] == (bits(r["v"]) if r["v"] >= 0 else -bits(-r["v"]))
    nan = spark.createDataFrame([(float("nan"),), (-0.0,), (None,)], "v double").select(ordered_key(F.col("v"))).collect()
    assert [r[0] for r in nan][:2] == [(1 << 63) - 1, 0]


def test_ranks_count_what_is_below_and_equal(spark):
    df = spark.createDataFrame([("t", v) for v in (3.0, 1.0, 3.0, float("nan"), 3.0, -2.0)] + [(None, 5.0)], "g string, v double")
    ranks = spark.createDataFrame([("t", 0), ("t", 2), ("t", 4), ("t", 5), ("t", 6), (None, 0)], "g string, rank bigint")
    got = {(r["g"], r["rank"]): (r["value"], r["below"], r["equal"]) for r in select_ranks(df, "v", ranks, ["g"]).collect()}
    assert math.isnan(got.pop(("t", 5))[0])
    assert got == {("t", 0): (-2.0, 0, 1), ("t", 2): (3.0, 2, 3), ("t", 4): (3.0, 2, 3), (None, 0): (5.0, 0, 1)}


def first_by_hand(points, rules):
    out = {}
    for key, t in points:
        held = [o for o, k, s, e in rules if k == key and s <= t and (e is None or t <= e)]
        if held:
            out[key, t] = min(held)
    return out


def test_segment_tree_first_match(spark):
    """One key with ten thousand rules, many of them open, and keys with few; every point by hand."""
    rng = np.random.default_rng(8)
    rules = [(int(o), "hot", int(s), None if o % 3 == 0 else int(s + rng.integers(0, 50))) for o, s in enumerate(rng.integers(0, 5000, 10_000))]
    rules += [(20_000 + o, k, int(s), int(s + n)) for o, (k, s, n) in enumerate(zip("ab" * 20, rng.integers(0, 300, 40), rng.integers(-3, 60, 40)))]
    rng.shuffle(rules)
    rules = [(int(o), k, int(s), None if e is None else int(e)) for o, k, s, e in rules]
    points = {(k, int(t)) for k, t in zip(["hot"] * 400 + ["a", "b", "none"] * 100, rng.integers(-20, 5100, 700))} | {(None, 5)}
    ruled = spark.createDataFrame(rules, "o int, k string, s bigint, e bigint").withColumn("e", F.coalesce("e", F.lit(FOREVER)))
    ruled = ruled.withColumn("rule", F.struct("o"))
    asked = spark.createDataFrame(sorted(points, key=str), "k string, t bigint")
    found = pieces(ruled, ["k"], "s", "e", "rule", "o")
    bounds = {(k, x) for _, k, s, e in rules if e is None or e >= s for x in (s, (FOREVER if e is None else e) + 1)}
    assert found.count() == len(bounds)  # one row per bound, not per covering rule
    got = {(r["k"], r["t"]): r["_hit"]["o"] for r in first_at(asked, found, ["k"], "t").collect()}
    assert got == first_by_hand(points, rules)


def test_segment_tree_of_nothing(spark):
    ruled = spark.createDataFrame([], "o int, k string, s bigint, e bigint").withColumn("rule", F.struct("o"))
    asked = spark.createDataFrame([("a", 1)], "k string, t bigint")
    assert first_at(asked, pieces(ruled, ["k"], "s", "e", "rule", "o"), ["k"], "t").count() == 0


def test_spread_small(spark):
    df = spark.range(100).coalesce(1)
    assert spread_small(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    wide = spark.range(100).repartition(64)
    assert spread_small(wide) is wide


def test_weighted_ranks_equal_repeated_rows(spark):
    df = spark.createDataFrame([("a", 1.0, 3), ("a", 2.0, 1), ("a", 5.0, 2)], "g string, v double, n int")
    ranks = spark.createDataFrame([("a", i) for i in range(7)], "g string, rank bigint")
    got = {r["rank"]: (r["value"], r["below"], r["equal"]) for r in select_ranks(df, "v", ranks, ["g"], "n").collect()}
    assert got == {**{i: (1.0, 0, 3) for i in range(3)}, 3: (2.0, 3, 1), 4: (5.0, 4, 2), 5: (5.0, 4, 2)}


def test_spread_rows_bounds_the_rows_of_a_task(spark):
    from flowhorizon.plans.scan import spread_rows

    dealt = spread_rows(spark.range(1000).coalesce(1), 25)
    assert dealt.rdd.getNumPartitions() == 40 and max(dealt.rdd.glom().map(len).collect()) <= 50
