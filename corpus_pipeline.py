"""Cleaning of ``documents`` in five stages, each one operator of ``flowhorizon.llm``.

Every stage takes the table its predecessor kept and returns a table that is written as Parquet before the next one
reads it. All but the last return the columns of ``documents``; the last returns the mix, in which a
document stands as often as it is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowhorizon.llm import decontamination, lines, mixing, order_minhash, toxicity
from flowhorizon.llm.common import stored
from flowhorizon.session import tune


#: A line of one site stands on over a tenth of that site's pages (``lines.MAX_RATIO``). A source joins many sites; one
#: with a hundredth of the source's documents still has its lines found at a tenth of a hundredth.
SOURCE_RATIO = lines.MAX_RATIO / 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity stays below 0.3."""
    return toxicity.drop_toxic(docs, table(tune(spark), sf_dir, "labels"))


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that repeat on over a thousandth of their source's documents."""
    tune(spark)
    return lines.drop_boilerplate(docs, "source", "text", max_ratio=SOURCE_RATIO)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    tune(spark)
    return order_minhash.drop_near_copies(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item stands within its budget of edits."""
    return decontamination.drop_contaminated(docs, table(tune(spark), sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    tune(spark)
    return mixing.mix(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_boilerplate),
    ("minhash_near_dedup", without_near_copies),
    ("benchmark_decontamination", without_benchmark),
    ("source_mixing", mixed),
]

# scores of a trained network, alignments and edit distances are beyond SQL; tests hold each stage against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
