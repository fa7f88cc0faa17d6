"""Registered queries of this subpackage, one per operator, with DuckDB SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import decontamination, divergence, languages, lines, mixing, order_minhash, pitman_yor, pivots, secret_scan, tokenization, toxicity, urls, vertical_scan
from .common import fold, stored
from ..session import tune
from .sql import DIVERGENCE_SQL, LINES_SQL, MIXING_SQL, NEGATIVES_SQL

QUERIES, ORACLES = {}, {}
URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def query(name: str, oracle: str | None = None):
    def wrap(fn):
        def run(spark, sf_dir):
            return fn(tune(spark), sf_dir)

        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return fn

    return wrap


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_lines(spark, sf):
    host = F.lower(F.regexp_extract("url", "://([^/?#]*)", 1))
    return table(spark, sf, "pages").select("page_id", host.alias("host"), lines.html_lines(F.col("html")).alias("text"))


@query("op6_line_dedup", LINES_SQL)
def line_dedup(spark, sf):
    """Visible lines of every page without the boilerplate of its host."""
    return lines.drop_boilerplate(stored(page_lines(spark, sf), "page-lines"), "host", "text", counts=True)


@query("op10_mixing", MIXING_SQL)
def mix_sources(spark, sf):
    """Words every document contributes to the mix."""
    return mixing.mix_report(table(spark, sf, "documents"))

@query("op1_toxicity")
def toxic_documents(spark, sf):
    """Toxicity of every whole text; documents of the held-out fold teach nothing."""
    out = toxicity.toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")

@query("op7_secrets")
def find_secrets(spark, sf):
    """Secrets of every whole text: counts and digest of the base rules, spans of all rules."""
    found = secret_scan.scan(table(spark, sf, "documents"), ["doc_id"])
    base = secret_scan.of_kind(F.col("spans"), *(r.kind for r in secret_scan.BASE))
    count = lambda kind: F.size(secret_scan.of_kind(F.col("spans"), kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(
        "doc_id", *(count(r.kind) for r in secret_scan.BASE),
        F.sha2(secret_scan.joined(base), 256).alias("base_sha256"), secret_scan.joined(F.col("spans")).alias("spans"),
    )


@query("op9_language_id")
def language_id(spark, sf):
    """Language of every whole text; the held-out fold teaches nothing."""
    docs = table(spark, sf, "documents")
    held = fold(F.col("doc_id"), 4) == 2
    out = languages.identify(docs, languages.prototypes(docs.filter(~held)), ["doc_id"])
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")

@query("op2_url_filter")
def url_filter(spark, sf):
    """Verdict on every url, by rule where one fits."""
    out = urls.filter_urls(table(spark, sf, "pages"), URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict", "ratio")


@query("op4_near_duplicates")
def near_duplicates(spark, sf):
    """Near-duplicate class of every document."""
    out = order_minhash.near_classes(table(spark, sf, "documents"))
    return out.select(F.col("id").alias("doc_id"), "class_id", F.col("id").eqNullSafe(F.col("class_id")).alias("kept"))


@query("op5_decontamination")
def benchmark_passages(spark, sf):
    """Every test item found in a document, within its budget of word edits."""
    return decontamination.passages(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op3_embedding_near_dup")
def near_vectors(spark, sf):
    """Links and components of all vectors."""
    return pivots.near_vectors(table(spark, sf, "embeddings"))


@query("op8_lm_scoring")
def lm_scores(spark, sf):
    """Log10 probability of every whole text under the unigram base and under the Pitman-Yor model."""
    return pitman_yor.score_texts(table(spark, sf, "documents"))


@query("op11_hard_negatives", NEGATIVES_SQL)
def hard_negatives(spark, sf):
    """Hard negatives of every anchor and positive; every seventh vector carries the next label."""
    vectors = table(spark, sf, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return vertical_scan.hard_negatives(vectors.withColumn("label", label))


@query("op12_source_divergence", DIVERGENCE_SQL)
def source_divergence(spark, sf):
    """How far every source is from the others of its language, and the terms it uses more than the language does."""
    return divergence.audit(table(spark, sf, "documents"))


@query("op13_tokenization")
def tokenized(spark, sf):
    """Digests of the token ids of every whole text and of what they decode to."""
    import public_tokenizers

    vocabulary = tokenization.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    encoded = tokenization.encode(table(spark, sf, "documents"), vocabulary, ["doc_id"])
    decoded = tokenization.decode(encoded, vocabulary, ["doc_id", "n_tokens", "ids"])
    return decoded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256")
    )


def load():
    """All queries and their SQL, the pipeline included."""
    import corpus_pipeline

    sql = {} if corpus_pipeline.ORACLE_SQL is None else {"pipeline": corpus_pipeline.ORACLE_SQL}
    return {**QUERIES, "pipeline": corpus_pipeline.run}, {**ORACLES, **sql}
