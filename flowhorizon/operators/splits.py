"""Chronological splits, day folds, target variants and proportional samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..plans.quantiles import grid_quantiles
from ..plans.scan import running

SPLITS = ["train", "val", "test", "boundary_excluded"]


def _us(name: str) -> Column:
    return F.unix_micros(F.col(name).cast("timestamp"))


def check_fractions(train: float, val: float, test: float) -> None:
    if not 0.99 <= train + val + test <= 1.01:
        raise ValueError(f"split fractions must sum to 1, got {train + val + test}")


def split_cutoffs(sequences: DataFrame, train: float = 0.6, val: float = 0.2, test: float = 0.2) -> DataFrame:
    """One row with the two cutoffs in microseconds. Target ends lie on the window grid, so equal
    ends are counted before the exact percentile and its buffer is bounded by the grid."""
    check_fractions(train, val, test)
    ends = sequences.select(_us("target_window_end").alias("_end"))
    return grid_quantiles(ends, "_end", [train, train + val]).select(
        F.col("quantiles")[0].alias("val_cutoff_us"), F.col("quantiles")[1].alias("test_cutoff_us")
    )


def temporal_split(
    sequences: DataFrame, train: float = 0.6, val: float = 0.2, test: float = 0.2, cutoffs: DataFrame | None = None
) -> DataFrame:
    """Add ``split``. The cutoffs come in as scalar subqueries; sequences are not shuffled."""
    cut = cutoffs if cutoffs is not None else split_cutoffs(sequences, train, val, test)
    c1, c2 = cut.select("val_cutoff_us").scalar(), cut.select("test_cutoff_us").scalar()
    start, end = _us("seq_start_time"), _us("target_window_end")
    # later rules override earlier ones, hence the reverse order
    label = (
        F.when(start >= c2, "test")
        .when((start >= c1) & (end <= c2), "val")
        .when(end <= c1, "train")
        .otherwise("boundary_excluded")
    )
    return sequences.withColumn("split", label)


def split_metadata(split: DataFrame, cutoffs: DataFrame, dataset: str, fractions=(0.6, 0.2, 0.2)) -> DataFrame:
    """One row: cutoffs, fractions, counts and class / stage distributions per split."""
    counts = split.groupBy("split", "target_dominant_class", "target_dominant_stage").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("seq_start_time").alias("lo"),
        F.max("target_window_end").alias("hi"),
    )

    def dist(column):
        per = counts.groupBy("split", column).agg(F.sum("n").alias("n"))
        nested = per.groupBy("split").agg(
            F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "n")))).alias("d")
        )
        return nested.agg(F.map_from_entries(F.collect_list(F.struct("split", "d")))).scalar()

    total = counts.agg(
        F.min("lo").alias("global_min_time"),
        F.max("hi").alias("global_max_time"),
        F.sum("n").alias("total_sequences"),
        *[
            F.coalesce(F.sum(F.when(F.col("split") == s, F.col("n"))), F.lit(0)).alias(f"{s}_sequences")
            for s in SPLITS
        ],
    )
    return total.withColumns(
        {
            "dataset_key": F.lit(dataset),
            "val_cutoff_time": F.timestamp_micros(cutoffs.select("val_cutoff_us").scalar().cast("bigint")),
            "test_cutoff_time": F.timestamp_micros(cutoffs.select("test_cutoff_us").scalar().cast("bigint")),
            "train_fraction": F.lit(fractions[0]),
            "val_fraction": F.lit(fractions[1]),
            "test_fraction": F.lit(fractions[2]),
            "class_distribution_by_split": dist("target_dominant_class"),
            "stage_distribution_by_split": dist("target_dominant_stage"),
        }
    )


def fold_days(sequences: DataFrame) -> DataFrame:
    """(test_day, val_day) for every day a sequence starts on; rows are bounded by the calendar.

    The validation day is the day before the test day, or the day after for the first two.
    """
    days = sequences.select(F.to_date("seq_start_time").alias("test_day")).distinct()
    by_day = W.orderBy("test_day")
    pos = F.row_number().over(by_day)
    val = F.when(pos > 2, F.lag("test_day").over(by_day)).otherwise(F.lead("test_day").over(by_day))
    return days.withColumn("val_day", val)


def day_span() -> tuple[Column, Column]:
    """First day of a sequence's inputs and last day of its target."""
    return F.to_date("seq_start_time"), F.to_date("target_window_end")


def fold_role(begin: Column, end: Column, test_day: Column, val_day: Column) -> Column:
    """Role in one fold of whatever runs from day ``begin`` to day ``end``.

    A span that misses both held-out days trains. One that meets a held-out day belongs to it only if it is
    that single day; spans over midnight are purged, since they would carry a held-out day into another role.
    """
    met = F.when(val_day.between(begin, end), "val").when(test_day.between(begin, end), "test")
    return F.when(met.isNull(), "train").when(F.datediff(end, begin) == 0, met).otherwise("purged")


def assign_fold(sequences: DataFrame, test_day, val_day) -> DataFrame:
    days = (F.lit(d).cast("date") for d in (test_day, val_day))
    return sequences.withColumn("split", fold_role(*day_span(), *days))


def fold_counts(sequences: DataFrame, **measures: Column) -> DataFrame:
    """``total`` and summed ``measures`` per fold and role, for all folds.

    Sequences are counted per (first day, last day) first; only those counts, of which there are about as many as
    days, meet the list of folds.
    """
    begin, end = day_span()
    spans = sequences.groupBy(begin.alias("_a"), end.alias("_b")).agg(
        F.count(F.lit(1)).alias("total"), *[F.sum(m).alias(name) for name, m in measures.items()]
    )
    folds = fold_days(sequences).filter(F.col("val_day").isNotNull())
    listed = folds.agg(F.sort_array(F.collect_list(F.struct("test_day", "val_day")))).scalar()
    each = spans.withColumn("_fold", F.explode(listed)).select("*", "_fold.*")
    role = fold_role(F.col("_a"), F.col("_b"), F.col("test_day"), F.col("val_day"))
    return each.groupBy("test_day", "val_day", role.alias("fold_split")).agg(
        *[F.sum(name).alias(name) for name in ("total", *measures)]
    )


def target_variant(sequences: DataFrame, variant: str) -> DataFrame:
    """``any``: label is attack in the target. ``onset``: continuations are removed everywhere."""
    attack, onset = F.col("target_attack_present") == 1, F.col("target_is_onset")
    if variant == "any":
        return sequences.withColumn("y", attack.cast("int"))
    if variant == "onset":
        return sequences.filter(~(attack & ~onset)).withColumn("y", onset.cast("int"))
    raise ValueError("variant must be 'any' or 'onset'")


def spread_sample(df: DataFrame, stratum: str, key: list[str], sample_size: int, seed: int = 42) -> DataFrame:
    """Same fraction of every stratum: ``round(f*n)`` rows each, drawn by the hash of a row key.

    The draw depends only on key and seed. Ranks come from a segmented scan over hash prefixes, so
    one huge file does not end up in one task.
    """
    counts = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    plan = counts.select(
        F.col(stratum).alias("_s"),
        F.when(total <= sample_size, F.col("_n"))
        .otherwise(F.least(F.bround(F.col("_n") * F.lit(float(sample_size)) / total, 0).cast("bigint"), F.col("_n")))
        .alias("_take"),
    )
    digest = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(str(seed))))
    hashed = df.withColumns({"_h": digest, "_one": F.lit(1).cast("bigint")})
    prefix = F.conv(F.substring("_h", 1, 4), 16, 10).cast("int")
    ranked = running(hashed, [stratum], ["_h", *key], [("_seg", prefix)], {"_rank": ("sum", "_one")})
    return ranked.join(plan, ranked[stratum].eqNullSafe(plan["_s"])).filter(F.col("_rank") < F.col("_take")).select(
        *df.columns
    )
