"""Label mapping and stage lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.lookups import label_table, mitre_table


class LabelMappingError(ValueError):
    """A label has no entry in the mapping table."""


def unmapped_labels(flows: DataFrame, table: DataFrame) -> DataFrame:
    """Distinct non-null labels that the table does not know."""
    seen = flows.select("dataset_label").filter(F.col("dataset_label").isNotNull()).distinct()
    return seen.join(table, "dataset_label", "left_anti")


def map_labels(flows: DataFrame, table: DataFrame, fixed_table: bool = False) -> DataFrame:
    """Left join class, stage and confidence. ``fixed_table`` marks a literal table of known small
    size; anything else is left to Spark's own broadcast size check."""
    keep = flows.drop("normalized_attack_class", "attack_stage", "label_confidence")
    return keep.join(F.broadcast(table) if fixed_table else table, "dataset_label", "left").select(
        *keep.columns, "normalized_attack_class", "attack_stage", "label_confidence"
    )


def apply_stage_mapping(flows: DataFrame, dataset: str, check: bool = True) -> DataFrame:
    """Map labels with the built-in table of a dataset; unknown labels are an error.

    The check is one distinct aggregation over the label column. The message names the first 20
    offenders and says how many there are.
    """
    table = label_table(flows.sparkSession, dataset)
    if check:
        unknown = unmapped_labels(flows, table)
        missing = [r[0] for r in unknown.orderBy("dataset_label").limit(20).collect()]
        if missing:
            raise LabelMappingError(f"{unknown.count()} labels without a mapping for {dataset!r}, first {missing}")
    return map_labels(flows, table, fixed_table=True)


def mitre_lookup(df: DataFrame, stage: str = "predicted_stage") -> DataFrame:
    """Attach tactic and techniques by stage name, ignoring case and outer blanks."""
    table = mitre_table(df.sparkSession).withColumn("_stage_key", F.lower("stage")).drop("stage")
    keyed = df.withColumn("_stage_key", F.lower(F.trim(F.col(stage))))
    return keyed.join(F.broadcast(table), "_stage_key", "left").drop("_stage_key")


def set_difference(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Distinct values of ``column`` present on the left only."""
    values = left.select(column).filter(F.col(column).isNotNull()).distinct()
    return values.join(right.select(column).distinct(), column, "left_anti")
