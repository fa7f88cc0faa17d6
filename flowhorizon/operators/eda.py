"""Dataset summaries and quality measures, as long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.quantiles import exact_quantiles, grid_quantiles
from ..sinks.tables import stage
from ..plans.scan import join_keys
from ..schema import DERIVED, OPTIONAL, REQUIRED

SUMMARY_COLUMNS = ["protocol", "normalized_attack_class", "attack_stage", "label_confidence"]


def value_counts(flows: DataFrame, columns: list[str]) -> DataFrame:
    """``column, value, rows`` for several columns in one pass; NULL is a value of its own.

    Rows are turned into (column, value) pairs that combine on the map side.
    """
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    )
    return (
        flows.select(pairs.alias("p"))
        .groupBy("p.column", "p.value")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def dataset_summary(flows: DataFrame) -> DataFrame:
    """One row: rows, distinct source and destination hosts, time range.

    Distinct hosts are counted through (side, host) pairs, so neither side expands the other.
    """
    sides = F.explode(
        F.array(
            F.struct(F.lit("src").alias("side"), F.col("source_ip").alias("host")),
            F.struct(F.lit("dst").alias("side"), F.col("destination_ip").alias("host")),
        )
    )
    hosts = (
        flows.select("timestamp", sides.alias("s"))
        .groupBy("s.side", "s.host")
        .agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))
    )
    known = F.col("host").isNotNull()
    return hosts.agg(
        F.coalesce(F.sum(F.when(F.col("side") == "src", F.col("n"))), F.lit(0)).alias("rows"),
        F.count(F.when((F.col("side") == "src") & known, 1)).alias("source_hosts"),
        F.count(F.when((F.col("side") == "dst") & known, 1)).alias("destination_hosts"),
        F.min("lo").alias("first_time"),
        F.max("hi").alias("last_time"),
    )


def missing_fraction(flows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``column, missing_fraction`` rounded to four digits, from one aggregate row."""
    names = columns or [c for c in {**REQUIRED, **OPTIONAL, **DERIVED} if c in flows.columns]
    row = flows.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in names])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("v")) for c in names]))
    return row.select(pairs.alias("p")).select("p.column", F.bround("p.v", 4).alias("missing_fraction"))


def hourly_volume(flows: DataFrame) -> DataFrame:
    """Flows per hour, benign against attack."""
    hour = F.date_trunc("hour", F.col("timestamp").cast("timestamp")).alias("hour")
    attack = F.coalesce(F.col("attack_stage") != "Benign", F.lit(True))
    return flows.groupBy(hour).agg(
        F.count(F.when(~attack, 1)).alias("benign_flows"), F.count(F.when(attack, 1)).alias("attack_flows")
    )


def crosstab(flows: DataFrame, rows: str, columns: str, names: list[str]) -> DataFrame:
    """Contingency table with a listed set of columns (no extra job to find them)."""
    return flows.groupBy(rows).pivot(columns, names).count().fillna(0, subset=names)


def flows_per_host(flows: DataFrame, host: str = "source_ip") -> DataFrame:
    """Distribution of flows per host: count, mean, std, min, quartiles, max."""
    per = flows.filter(F.col(host).isNotNull()).groupBy(host).agg(F.count(F.lit(1)).alias("n"))
    # few distinct counts compared to hosts, so the quantile buffer is small
    q = grid_quantiles(per, "n", [0.25, 0.5, 0.75])
    stats = per.agg(
        F.count("n").alias("hosts"), F.avg("n").alias("mean_flows"), F.stddev_samp("n").alias("std_flows"),
        F.min("n").alias("min_flows"), F.max("n").alias("max_flows"),
    )
    array = q.select("quantiles").scalar()
    return stats.withColumns({"q25": array[0], "median": array[1], "q75": array[2]})


def target_gap(sequences: DataFrame) -> DataFrame:
    """Seconds between input end and target start: count, min, median, max, bad rows."""
    gap = sequences.select(
        (
            F.unix_micros(F.col("target_window_start").cast("timestamp"))
            - F.unix_micros(F.col("seq_end_time").cast("timestamp"))
        ).alias("_gap")
    )
    # gaps are whole strides, so equal ones collapse first
    counted = gap.groupBy("_gap").agg(F.count(F.lit(1)).alias("_n"))
    micro = 1e6
    return counted.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("count"),
        (F.min("_gap") / micro).alias("min"),
        (F.percentile("_gap", 0.5, F.col("_n")) / micro).alias("median"),
        (F.max("_gap") / micro).alias("max"),
        F.coalesce(F.sum(F.when(F.col("_gap") <= 0, F.col("_n"))), F.lit(0)).alias("nonpositive_count"),
        F.coalesce(F.sum(F.when(F.col("_gap") > 0, F.col("_n"))), F.lit(0)).alias("positive_count"),
        F.coalesce(F.sum(F.when(F.col("_gap") < 0, F.col("_n"))), F.lit(0)).alias("overlap_count"),
    )


lead_time = target_gap


def onset_by_split(split: DataFrame) -> DataFrame:
    """Positive, onset and continuation targets per split."""
    positive = F.count(F.when(F.col("target_attack_present") == 1, 1))
    onset = F.count(F.when(F.col("target_is_onset"), 1))
    return split.groupBy("split").agg(
        positive.alias("positive"), onset.alias("onset"), (positive - onset).alias("continuation")
    )


def quality_metrics(flows: DataFrame, windows: DataFrame, sequences: DataFrame) -> DataFrame:
    """``tier, measure, value`` over flows, windows and sequences, plus 0/1 warning rows.

    Each tier is one aggregate row; the tiers are joined as scalars and unpivoted.
    """
    t = F.unix_micros(F.col("timestamp").cast("timestamp"))
    labelled = F.col("normalized_attack_class").isNotNull()
    classes = flows.groupBy("normalized_attack_class").count()
    host_count = flows.filter(F.col("source_ip").isNotNull()).select("source_ip").distinct().agg(F.count("*")).scalar()
    class_count = classes.filter("normalized_attack_class is not null").agg(F.count("*")).scalar()
    f = flows.agg(
        F.count(F.lit(1)).cast("double").alias("rows"),
        F.bround((F.max(t) - F.min(t)) / 3.6e9, 2).alias("duration_hours"),
        (F.count(F.when(F.col("normalized_attack_class") == "Benign", 1)) / F.count(F.when(labelled, 1))).alias(
            "benign_share"
        ),
    ).withColumns({"hosts": host_count.cast("double"), "classes": class_count.cast("double")})
    w = windows.agg(
        F.count(F.lit(1)).cast("double").alias("rows"),
        F.count(F.when(F.col("attack_present") == 1, 1)).cast("double").alias("attack"),
        F.count(F.when(F.col("attack_present") == 0, 1)).cast("double").alias("benign"),
    )
    s = sequences.agg(
        F.count(F.lit(1)).cast("double").alias("rows"),
        F.count(F.when(F.col("target_attack_present") == 1, 1)).cast("double").alias("attack"),
        F.count(F.when(F.col("target_attack_present") == 0, 1)).cast("double").alias("benign"),
        F.count(F.when(F.col("target_window_start") <= F.col("seq_end_time"), 1)).cast("double").alias("misaligned"),
    )
    f = f.withColumn(
        "warn_benign_share",
        ((F.col("benign_share") > 0.95) & (F.col("classes") > 1)).cast("double"),
    )
    s = s.withColumns(
        {
            "warn_few_positives": (F.col("attack") < 100).cast("double"),
            "warn_target_alignment": (F.col("misaligned") > 0).cast("double"),
        }
    )
    return _unpivot(f, "flows").unionByName(_unpivot(w, "windows")).unionByName(_unpivot(s, "sequences"))


def _unpivot(row: DataFrame, tier: str) -> DataFrame:
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in row.columns])
    )
    return row.select(pairs.alias("p")).select(F.lit(tier).alias("tier"), "p.measure", "p.value")


def dataset_status(split: DataFrame) -> DataFrame:
    """Sequences, hosts with sequences, hosts in the test split, positives."""
    per = split.groupBy("host_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("target_attack_present") == 1, 1)).alias("pos"),
        F.max((F.col("split") == "test").cast("int")).alias("tested"),
    )
    return per.agg(
        F.sum("n").alias("sequences"),
        F.count(F.lit(1)).alias("hosts_with_sequences"),
        F.sum("tested").alias("hosts_in_test_split"),
        F.sum("pos").alias("positive_sequences"),
    )


def score_summary(scored: DataFrame, groups: list[str], score: str = "p") -> DataFrame:
    """Per group: count, min, max, mean, population std and nine exact quantiles (long form)."""
    fractions = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0]
    scored = stage(scored.select(*groups, score), "scores")
    stats = scored.groupBy(*groups).agg(
        F.min(score).alias("min"), F.max(score).alias("max"), F.avg(score).alias("mean"),
        F.stddev_pop(score).alias("std"),
    )
    return join_keys(exact_quantiles(scored, score, fractions, groups), stats, groups)


def upper_tail_thresholds(scored: DataFrame, tails: list[float] = (0.1, 0.05, 0.01, 0.001, 0.0)) -> DataFrame:
    """Validation-score quantiles 1 - tail as alert-volume thresholds."""
    q = exact_quantiles(stage(scored.select("p"), "scores"), "p", [1.0 - t for t in tails], [])
    return q.select(F.round(1 - F.col("fraction"), 6).alias("upper_tail"), F.col("quantile").alias("threshold"))


def attack_share(column: Column) -> Column:
    return F.avg((column != "Benign").cast("double"))
