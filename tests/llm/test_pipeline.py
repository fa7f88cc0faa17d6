"""The pipeline, stage by stage, against what each stage must do to its own input."""

import corpus_pipeline
from flowhorizon.llm import toxicity


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "source_mixing"]
    before = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, sf).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        assert after.columns == docs.columns and after.count() > 0
        ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
        assert ids(after) <= ids(before)
        if name == "toxicity":
            scores = toxicity.toxicity(before, labels)
            assert ids(after) == {r.doc_id for r in scores.filter("predicted = 0").collect()}
        if name == "line_dedup":
            assert after.count() == before.count()
        if name == "minhash_near_dedup":
            assert after.select("doc_id").distinct().count() == after.count()
        before = after


def test_run_on_odd_documents(spark, tmp_path):
    rows = [(1, None, "en", "a", 0), (2, "", "en", None, 0), (3, "a b c d e f g", None, "a", 13), (4, "a b c d e f g", "en", "b", 13), (4, "a b c d e f g", "en", "b", 13), (5, "z " * 70_000, "en", "a", 9)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, data, kind in (
        ("documents", rows, schema), ("labels", [(1, 0, 0)], "doc_id long, quality int, toxic int"), ("benchmark", [(1, "q r s t u")], "item_id long, text string"),
    ):
        spark.createDataFrame(data, kind).write.parquet(f"{tmp_path}/{name}.parquet")
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert toxicity is not None
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [c.split()[0] for c in schema.split(", ")]
    assert {r.doc_id for r in out.collect()} <= {1, 2, 3, 5}
    for name, kind in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_line_stage_drops_passages_shared_within_a_source(spark, sf):
    """Passages on six of a source's 600 documents go; on six of 6,100, or on one of each source, they stay."""
    shared = " ".join(f"word{i}" for i in range(60))
    rows = [(k, f"own line {k}\n{shared}" if k < 6 else f"own line {k}", "en", "a", 0) for k in range(600)]
    rows += [(k, f"own line {k}\n{shared}" if k < 1006 else f"own line {k}", "en", "b", 0) for k in range(1000, 7100)]
    rows += [(k, f"own line {k}\nonce a source", "en", f"s{k}", 0) for k in range(8000, 8010)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r.text for r in corpus_pipeline.without_boilerplate(spark, docs, sf).collect()}
    assert {k for k, text, *_ in rows if out[k] != text} == set(range(6))
    assert all(out[k] == f"own line {k}" for k in range(6))
