"""Line dedup and source mixing: edge cases, and the queries against DuckDB."""

import duckdb
import pytest
from compare import compare, connect

from pyspark.sql import functions as F

from flowhorizon.llm import lines, mixing, queries
from flowhorizon.llm.common import word_count
from flowhorizon.llm.sql import mixing_sql

SCHEMA = "doc_id bigint, text string, source string, _host string, _size int, target string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf, name):
    assert compare(queries.QUERIES[name](spark, sf), connect(sf), queries.ORACLES[name]) is None


def test_lines_of_a_site(spark):
    rows = [(i, f"own {i}\n menu \n\nmenu", "a") for i in range(6)] + [(i, "menu\nother", "b") for i in range(10, 14)]
    rows += [(20, None, "a"), (21, "", "a"), (22, "menu", None), (5, "own 5\n menu \n\nmenu", "a"), (30, "menu", "a"), (31, "w " * 50_000, "a")]
    out = lines.drop_boilerplate(frame(spark, rows), "source", "text", 0.5)
    assert out.columns == ["doc_id", "text", "source", "_host", "_size", "target"]
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    want = {0: "own 0\n", 10: "", 20: None, 21: "", 22: "menu", 30: "", 31: "w " * 50_000}
    assert len(got) == len(rows) and got.count((5, "own 5\n")) == 2
    for key, text in want.items():
        assert (key, text) in got
    counts = lines.drop_boilerplate(frame(spark, rows), "source", "text", 0.5, counts=True)
    assert {(r.n_lines, r.n_dropped) for r in counts.filter("doc_id in (0, 20, 30)").collect()} == {(3, 2), (0, 0), (1, 1)}


def test_lines_are_dropped_on_the_small_tables(spark):
    """The comparison with SQL is not an empty one."""
    out = queries.QUERIES["op6_line_dedup"](spark, "/root/testdata/sf0.01")
    assert out.agg(F.sum("n_dropped")).first()[0] > 100


def test_lines_of_an_empty_table(spark):
    assert lines.drop_boilerplate(frame(spark, []), "source", "text").count() == 0


ROWS = [(i, "w " * (1 + i * 7 % 50), f"s{i % 4}") for i in range(400)]
ROWS += [(1000 + i, "big word " * 40, "s9") for i in range(300)]
ROWS += [(7, "w w w", "s1"), (7, "w w w", "s1"), (None, "a b", None), (2000, None, None), (2001, "", "s0"), (2002, "l " * 60_000, "s2")]


def test_mix_equals_closed_form(spark):
    docs = frame(spark, ROWS)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [list(r) for r in ROWS])
    assert compare(mixing.mix_report(docs), con, mixing_sql()) is None


def test_mix_reaches_targets(spark):
    docs = frame(spark, [r for r in ROWS if r[0] != 7])
    got = mixing.mix_report(docs).toPandas()
    assert (got["taken"] <= 2 * got["size"]).all()
    merged = got.merge(docs.select("doc_id", "source").toPandas(), on="doc_id", how="left")
    for source, part in merged.groupby("source", dropna=False):
        own = part["target"].iloc[0]
        assert own <= 2 * part["source_size"].iloc[0] + 1e-9
        assert abs(part["taken"].sum() - own) <= part["size"].max() / 2, source
    targets = merged.groupby("source", dropna=False)["target"].first().sum()
    assert abs(targets - 1.5 * got["size"].sum()) < 1e-6 * targets


def test_mix_spreads_rows_of_one_id(spark):
    """Half of a source's rows have no id, some of them with equal texts: the target is met all the same."""
    rows = [(None, "w " * (15 if i % 2 else 14 + i % 3), "a") for i in range(500)] + [(i, "w " * 10, "a") for i in range(500)]
    rows += [(5000 + i, "x " * 400, "b") for i in range(40)] + [(8, "same words", "c")] * 200
    docs = frame(spark, rows).repartition(7)
    got = mixing.mix_report(docs).toPandas()
    for size, part in got.groupby("source_size"):
        assert abs(part["taken"].sum() - part["target"].iloc[0]) <= part["size"].max() / 2
    assert (got["taken"] <= 2 * got["size"]).all() and len(got) == len(rows)
    words = mixing.mix(docs).agg(F.sum(word_count(F.col("text")))).first()[0]
    assert words == got["taken"].sum()
    again = mixing.mix_report(docs.repartition(3)).toPandas()
    by = ["doc_id", "size", "source_size", "target", "taken"]
    assert got[by].sort_values(by).reset_index(drop=True).equals(again[by].sort_values(by).reset_index(drop=True))


def test_mix_repeats_whole_rows(spark):
    docs = frame(spark, ROWS)
    out, again = mixing.mix(docs), mixing.mix(docs)
    assert out.columns == docs.columns
    count = lambda df: sorted(((r.doc_id, r["count"]) for r in df.groupBy("doc_id").count().collect()), key=str)
    assert count(out) == count(again)
    assert max(r["count"] for r in out.filter("doc_id >= 1000").groupBy("doc_id").count().collect()) <= 2
    report = mixing.mix_report(docs).selectExpr("sum(taken) t").first().t
    words = out.agg(F.sum(word_count(F.col("text")))).first()[0]
    assert report == words


def test_mix_of_an_empty_table(spark):
    assert mixing.mix_report(frame(spark, [])).count() == 0
    assert mixing.mix(frame(spark, [])).count() == 0


def test_small_hosts_lose_their_lines(spark, tmp_path):
    pages = [(k, f"http://h{k // 3}.net/{k}", f"<p>own {k}</p><p>menu</p>") for k in range(6)] + [(9, "http://one.net/", "<p>menu</p>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    out = queries.QUERIES["op6_line_dedup"](spark, str(tmp_path)).collect()
    assert {r.page_id: r.n_dropped for r in out} == {**dict.fromkeys(range(6), 1), 9: 0}
