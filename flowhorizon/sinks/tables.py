"""Stage tables and small result tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ..session import ensure_checkpoint_dir


def write_stage(df: DataFrame, path: str, partition_by: list[str] = (), sort_by: list[str] = (), mode="overwrite"):
    """Write a stage table as Parquet. Rows are sorted inside each task only, so no global sort."""
    if sort_by:
        df = df.sortWithinPartitions(*sort_by)
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.parquet(path)


def write_bucketed(df: DataFrame, table: str, column: str, buckets: int, sort_by: list[str] = ()):
    """Catalog table bucketed by a key, so later joins and windows on that key skip the shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, column).sortBy(*(sort_by or [column])).saveAsTable(table)
    return df.sparkSession.table(table)


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Materialise an intermediate table in the shared checkpoint folder and read it back.

    Used where a plan needs the same result more than once. A written table survives the loss of
    executors and, unlike a checkpointed RDD, later readers fetch only the columns they use.
    """
    folder = ensure_checkpoint_dir(df.sparkSession)
    path = f"{folder.rstrip('/')}/flowhorizon-stage/{name}-{uuid.uuid4().hex}"
    return write_stage(df, path)


def write_ingest_summary(report: DataFrame, path: str, sample_size: int | None = None) -> None:
    """One JSON row: rows_raw, rows_clean, drops by reason, sample size."""
    drops = F.map_from_entries(
        F.collect_list(F.when(~F.col("reason").isin("rows_in", "rows_out"), F.struct("reason", "rows")))
    )
    row = report.agg(
        F.max(F.when(F.col("reason") == "rows_in", F.col("rows"))).alias("rows_raw"),
        F.max(F.when(F.col("reason") == "rows_out", F.col("rows"))).alias("rows_clean"),
        drops.alias("dropped_by_reason"),
    ).withColumn("sample_size", F.lit(sample_size).cast("bigint"))
    row.coalesce(1).write.mode("overwrite").json(path)


SUMMARY_DDL = "rows_raw bigint, rows_clean bigint, dropped_by_reason map<string,bigint>, sample_size bigint"


def read_ingest_summary(spark, path: str, rows_clean: int) -> DataFrame:
    """The stored summary, or no row when it was written for a table of another size."""
    return spark.read.schema(SUMMARY_DDL).json(path).filter(F.col("rows_clean") == rows_clean)


def write_json_table(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def write_scored_csv(scored: DataFrame, path: str) -> None:
    """All scored sequences as CSV; nested columns are left out because CSV has no place for them."""
    flat = [f.name for f in scored.schema if f.dataType.typeName() not in ("array", "map", "struct")]
    scored.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def top_scores(scored: DataFrame, k: int = 10, column: str = "attack_probability") -> DataFrame:
    return scored.orderBy(F.desc(column), "sequence_id").limit(k)


def save_model_tables(metrics: DataFrame, params: DataFrame, path: str) -> None:
    """Long metric rows (model, split, metric, value) and feature parameters."""
    metrics.write.mode("overwrite").parquet(f"{path}/metrics")
    params.write.mode("overwrite").parquet(f"{path}/parameters")
