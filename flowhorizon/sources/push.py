"""Pushed JSON flow records and Parquet stage tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schema import REQUIRED, coerce_flows, flow_schema

UNLABELED = "UNLABELED"


def text_schema() -> str:
    """Pushed records are read as text and cast leniently afterwards."""
    return ", ".join(f"`{f.name}` string" for f in flow_schema())


def parse_push(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON flow records (batch or stream) to canonical flows; absent labels become UNLABELED."""
    rows = lines.select(F.from_json(F.col(column), text_schema()).alias("f")).select("f.*")
    return coerce_flows(rows.withColumn("dataset_label", F.coalesce("dataset_label", F.lit(UNLABELED))))


def missing_fields(lines: DataFrame, column: str = "value") -> DataFrame:
    """Records that lack a required field (the label may be absent), with the missing names."""
    need = [c for c in REQUIRED if c != "dataset_label"]
    keys = F.json_object_keys(F.col(column))
    lacking = F.array_except(F.array(*[F.lit(c) for c in need]), F.coalesce(keys, F.array().cast("array<string>")))
    return lines.select(column, lacking.alias("missing")).filter(F.size("missing") > 0)


def read_table(
    spark: SparkSession, path: str, columns: list[str] | None = None, split: str | None = None
) -> DataFrame:
    """Stage table with pushed-down split filter and column pruning."""
    df = spark.read.parquet(path)
    if split is not None:
        df = df.filter(F.col("split") == split)
    return df.select(*columns) if columns else df
