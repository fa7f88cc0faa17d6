"""Label joins, onset tables and history joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..plans.grid import MICROS
from ..plans.intervals import interval_join
from ..plans.scan import running, with_time_halo
from ..plans.segments import FOREVER, first_at, pieces
from ..sinks.tables import stage

DAY_US = 86_400 * MICROS
HOUR_US = 3_600 * MICROS


def _us(name) -> Column:
    return F.unix_micros(F.col(name).cast("timestamp"))


def first_interval_match(
    flows: DataFrame,
    rules: DataFrame,
    keys: list[tuple[str, str]],
    start: str,
    end: str,
    order: str,
    payload: list[str],
) -> DataFrame:
    """Left-join to every flow the payload of the first rule (by ``order``) whose interval holds it.

    A match depends on (keys, timestamp) alone, so distinct points are matched and the result is
    joined back: no row identity is needed and copies of one flow are matched once. An open end
    (NULL) never closes. Overlapping rules are settled in a segment tree before points come in.
    """
    names = [f"_p_{a}" for a, _ in keys]
    points = flows.select(*[F.col(a).alias(f"_p_{a}") for a, _ in keys], _us("timestamp").alias("_pt"))
    ruled = rules.select(
        *[F.col(b).alias(f"_p_{a}") for a, b in keys],
        _us(start).alias("_rs"),
        F.coalesce(_us(end), F.lit(FOREVER)).alias("_re"),
        F.struct(F.col(order).alias("o"), *[F.col(c) for c in payload]).alias("_rule"),
        F.col(order).alias("_order"),
    )
    found = pieces(ruled, names, "_rs", "_re", "_rule", "_order")
    first = first_at(points.filter(F.col("_pt").isNotNull()).distinct(), found, names, "_pt")
    on = [F.col(a) == F.col(f"_p_{a}") for a, _ in keys] + [_us("timestamp") == F.col("_pt")]
    joined = flows.join(first, reduce(lambda x, y: x & y, on), "left")
    return joined.select(*[flows[c] for c in flows.columns], *[F.col(f"_hit.{c}").alias(c) for c in payload])


def interval_labels(flows: DataFrame, rules: DataFrame, table: DataFrame, default: str = "BENIGN") -> DataFrame:
    """Analyst label rules ``(rule_no, source_ip, start, end, label)``; first rule wins, else BENIGN.

    A rule whose label the table does not know stops the job that reads the result.
    """
    named = table.select(F.col("dataset_label").alias("_known"))
    checked = rules.join(named, F.col("label") == F.col("_known"), "left").withColumn(
        "label",
        F.when(F.col("_known").isNotNull(), F.col("label")).otherwise(
            F.raise_error(F.concat(F.lit("rule with a label that has no mapping: "), F.coalesce("label", F.lit("NULL"))))
        ),
    )
    base = flows.drop("dataset_label", "normalized_attack_class", "attack_stage", "label_confidence")
    hit = first_interval_match(
        base, checked.drop("_known"), [("source_ip", "source_ip")], "start", "end", "rule_no", ["label"]
    )
    named = hit.withColumn("dataset_label", F.coalesce("label", F.lit(default))).drop("label")
    return named.join(table, "dataset_label", "left").select(
        *base.columns, "dataset_label", "normalized_attack_class", "attack_stage", "label_confidence"
    )


def unknown_rule_labels(rules: DataFrame, table: DataFrame) -> DataFrame:
    return rules.select(F.col("label").alias("dataset_label")).distinct().join(table, "dataset_label", "left_anti")


def process_labels(flows: DataFrame, truth: DataFrame, host: str = "optc_host") -> DataFrame:
    """Malicious when a known-bad (host, pid) was alive at flow start; adds its scenario.

    ``truth`` is ``(gt_no, host, pid, start, end, scenario)``; a NULL end is open.
    """
    base = flows.drop("dataset_label", "optc_scenario")
    hit = first_interval_match(
        base, truth, [(host, "host"), ("pid", "pid")], "start", "end", "gt_no", ["scenario"]
    )
    label = F.when(F.col("scenario").isNotNull(), "Malicious").otherwise("Benign")
    return hit.withColumns({"dataset_label": label, "optc_scenario": F.col("scenario").cast("int")}).drop("scenario")


def contact_labels(
    flows: DataFrame,
    redteam: DataFrame,
    source: str = "source_ip",
    destination: str = "destination_ip",
    seconds: str = "lanl_time_s",
    slack_seconds: int = 3600,
) -> DataFrame:
    """RedTeam for flows along a red-team pair from its first use minus the slack, RedTeamSource for
    the other flows of a red-team source, else Benign. Both sides are reduced before the join."""
    pairs = redteam.groupBy(F.col("src").alias("_ps"), F.col("dst").alias("_pd")).agg(F.min("time").alias("_first"))
    sources = redteam.select(F.col("src").alias("_src")).filter(F.col("_src").isNotNull()).distinct()
    joined = flows.join(pairs, (F.col(source) == F.col("_ps")) & (F.col(destination) == F.col("_pd")), "left").join(
        sources, F.col(source) == F.col("_src"), "left"
    )
    label = (
        F.when(F.col(seconds) >= F.col("_first") - slack_seconds, "RedTeam")
        .when(F.col("_src").isNotNull(), "RedTeamSource")
        .otherwise("Benign")
    )
    return joined.withColumn("dataset_label", label).drop("_ps", "_pd", "_first", "_src")


def victim_onsets(redteam: DataFrame) -> DataFrame:
    """First red-team time per destination, who came first, and how often."""
    return redteam.groupBy(F.col("dst").alias("computer")).agg(
        F.min("time").alias("onset_s"),
        F.min_by("src", F.struct("time", "src")).alias("attacker"),
        F.count(F.lit(1)).alias("red_auths"),
    )


# --- gaps and islands ---------------------------------------------------------------------


def episode_starts(events: DataFrame, host: str, time: str, gap_seconds: int = 1800) -> DataFrame:
    """Mark events that open a new episode: no event of the host in the ``gap`` before.

    Only a fixed time back matters, so rows are spread over short spans with a halo.
    """
    gap_us = gap_seconds * MICROS
    rows = events.withColumn("_t", _us(time))
    span = max(HOUR_US, 4 * gap_us)
    part = W.partitionBy(host, "_span").orderBy("_t")
    tied = W.partitionBy(host, "_span", "_t").orderBy(*[c for c in events.columns if c not in (host, time)])
    halo = with_time_halo(rows, "_t", gap_us, span)
    near = F.count(F.lit(1)).over(part.rangeBetween(-gap_us, -1))
    return (
        halo.withColumns({"_near": near, "_tie": F.row_number().over(tied)})
        .filter("_own")
        .withColumn("starts_episode", (F.col("_near") == 0) & (F.col("_tie") == 1))
        .drop("_t", "_span", "_own", "_near", "_tie")
    )


def episode_counts(events: DataFrame, host: str, time: str, groups: list[str], gap_seconds: int = 1800) -> DataFrame:
    """Episodes per group; every group is scanned on its own events."""
    slim = events.select(*dict.fromkeys([*groups, host, time])).withColumn(
        "_key", F.concat_ws("\u0001", *[F.col(g).cast("string") for g in dict.fromkeys([*groups, host])])
    )
    marked = episode_starts(slim, "_key", time, gap_seconds)
    return marked.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("events"), F.count(F.when(F.col("starts_episode"), 1)).alias("episodes")
    )


def interval_episodes(
    intervals: DataFrame, keys: list[str], start: str, end: str, gap_seconds: int = 1800
) -> DataFrame:
    """Merge intervals at most ``gap`` apart per key: ``episode_start, episode_end, intervals``.

    The latest end so far and the episode number are segmented scans, so no key is one task.
    """
    begin, stop = _us(start), F.greatest(_us(start), _us(end))
    rows = intervals.withColumns({"_s": begin, "_e": stop})
    segment = F.floor(F.col("_s") / DAY_US)
    seen = running(rows, keys, ["_s", "_e"], [("_seg", segment)], {"_reach": ("max", "_e")})
    flagged = seen.withColumn(
        "_new",
        (F.col("_reach").isNull() | (F.col("_s") - F.col("_reach") > gap_seconds * MICROS)).cast("bigint"),
    )
    # the second scan reads its input twice, so the first one is written down
    flagged = stage(flagged.select(*keys, "_s", "_e", "_new"), "episodes")
    # of equal intervals the one that opens the episode comes first, or the others would count for the episode before
    flagged = flagged.withColumn("_old", -F.col("_new"))
    numbered = running(flagged, keys, ["_s", "_e", "_old"], [("_seg", segment)], {"_prior": ("sum", "_new")})
    return (
        numbered.groupBy(*keys, (F.col("_prior") + F.col("_new")).alias("episode"))
        .agg(
            F.timestamp_micros(F.min("_s")).alias("episode_start"),
            F.timestamp_micros(F.max("_e")).alias("episode_end"),
            F.count(F.lit(1)).alias("intervals"),
        )
    )


def onset_table(truth: DataFrame, gap_seconds: int = 1800) -> DataFrame:
    """Per (scenario, host): first start, distinct processes, episodes, last activity."""
    keys = ["scenario", "host"]
    eps = interval_episodes(truth, keys, "start", "end", gap_seconds).groupBy(*keys).agg(
        F.min("episode_start").alias("onset"),
        F.count(F.lit(1)).alias("episodes"),
        F.max("episode_end").alias("last_activity"),
        F.sum("intervals").alias("intervals"),
    )
    pids = truth.select(*keys, "pid").distinct().groupBy(*keys).agg(F.count("pid").alias("processes"))
    return eps.join(pids, keys)


def lockstep_batches(onsets: DataFrame, scenario: str = "scenario", onset: str = "onset", chain_seconds: int = 60):
    """Chain onsets of a scenario that follow each other within ``chain_seconds``.

    Adds ``batch`` (1-based in the scenario) and ``batch_size``. The previous onset is the running
    maximum, since rows are ordered by onset.
    """
    order = ["_t", *[c for c in onsets.columns if c not in (scenario, onset)]]
    rows = onsets.withColumn("_t", _us(onset))
    segment = F.floor(F.col("_t") / DAY_US)
    prev = running(rows, [scenario], order, [("_seg", segment)], {"_prev": ("max", "_t")})
    flagged = prev.withColumn(
        "_new", (F.col("_prev").isNull() | (F.col("_t") - F.col("_prev") > chain_seconds * MICROS)).cast("bigint")
    )
    flagged = stage(flagged, "lockstep")
    numbered = running(flagged, [scenario], order, [("_seg", segment)], {"_before": ("sum", "_new")})
    batched = numbered.withColumn("batch", F.col("_before") + F.col("_new")).drop("_t", "_prev", "_new", "_before")
    batched = stage(batched, "batches")
    sizes = batched.groupBy(F.col(scenario).alias("_s"), F.col("batch").alias("_b")).agg(
        F.count(F.lit(1)).alias("batch_size")
    )
    same = F.col(scenario).eqNullSafe(F.col("_s")) & (F.col("batch") == F.col("_b"))
    return batched.join(sizes, same).drop("_s", "_b")


def census_summary(onsets: DataFrame, min_days: int = 3) -> DataFrame:
    """Per scenario: onsets, hosts, independent batches, largest batch, enough-history counts."""
    per_host = onsets.groupBy("scenario", "host").agg(F.count(F.lit(1)).alias("n"))
    hosts = per_host.groupBy("scenario").agg(F.count(F.lit(1)).alias("hosts"), F.sum("n").alias("onsets"))
    have_days = "days_before" in onsets.columns
    enough = F.count(F.when(F.col("days_before") >= min_days, 1)) if have_days else F.lit(None).cast("bigint")
    batches = onsets.groupBy("scenario").agg(
        F.max("batch").alias("batches"), F.max("batch_size").alias("largest_batch"), enough.alias("with_history_days")
    )
    return hosts.join(batches, "scenario")


# --- history before an onset ---------------------------------------------------------------


def onset_history(onsets: DataFrame, flows: DataFrame) -> DataFrame:
    """Benign traffic of a host before its onset and the lag to its first malicious flow.

    ``onsets`` is (host, onset), ``flows`` is (host, timestamp, direction, dataset_label). Counts of
    the last hour are an interval join on flows already counted per instant, the last outbound
    flow is an as-of lookup by segmented running maximum, and the malicious part does not depend
    on the onset, so it is one aggregate per host. No host is joined flow by flow.
    """
    o = onsets.select(F.col("host").alias("_h"), "onset", _us("onset").alias("_o")).distinct()
    f = flows.select(F.col("host").alias("_fh"), _us("timestamp").alias("_t"), "direction", "dataset_label")
    benign = f.filter(F.col("dataset_label") == "Benign")
    instants = (
        benign.filter(F.col("direction").isin("outbound", "inbound"))
        .groupBy("_fh", "_t")
        .agg(
            F.count(F.when(F.col("direction") == "outbound", 1)).alias("_nout"),
            F.count(F.when(F.col("direction") == "inbound", 1)).alias("_nin"),
        )
    )
    hour = 3600 * MICROS
    spans = o.withColumns({"_lo": F.col("_o") - hour, "_hi": F.col("_o") - 1})
    late = F.col("_t") >= F.col("_o") - 600 * MICROS
    recent = (
        interval_join(instants, spans, [("_fh", "_h")], "_t", "_lo", "_hi", 3600)
        .groupBy("_h", "_o")
        .agg(
            F.sum(F.when(late, F.col("_nout")).otherwise(0)).alias("own_out_10m"),
            F.sum("_nout").alias("own_out_60m"),
            F.sum(F.when(late, F.col("_nin")).otherwise(0)).alias("inbound_10m"),
            F.sum("_nin").alias("inbound_60m"),
        )
    )
    marks = instants.filter("_nout > 0").select(F.col("_fh").alias("_h"), "_t", F.lit(1).alias("_kind"), F.col("_t").alias("_seen"))
    asked = o.select("_h", F.col("_o").alias("_t"), F.lit(0).alias("_kind"), F.lit(None).cast("bigint").alias("_seen"))
    last = (
        running(marks.unionByName(asked), ["_h"], ["_t", "_kind"], [("_seg", F.floor(F.col("_t") / (600 * MICROS)))], {"_last": ("max", "_seen")})
        .filter("_kind = 0")
        .select("_h", F.col("_t").alias("_o"), "_last")
    )
    red = f.filter(F.col("dataset_label") == "Malicious").groupBy(F.col("_fh").alias("_h")).agg(
        F.count(F.lit(1)).alias("red_flows"), F.min("_t").alias("_red")
    )
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("own_out_10m", "own_out_60m", "inbound_10m", "inbound_60m", "red_flows")}
    return (
        o.join(recent, ["_h", "_o"], "left")
        .join(last, ["_h", "_o"], "left")
        .join(red, "_h", "left")
        .withColumns(zero)
        .withColumns(
            {
                "host": F.col("_h"),
                "min_since_last_own_out": F.round((F.col("_o") - F.col("_last")) / 6e7, 2),
                "first_red_flow_lag_s": F.round((F.col("_red") - F.col("_o")) / 1e6, 1),
            }
        )
        .select("host", "onset", *zero, "min_since_last_own_out", "first_red_flow_lag_s")
    )


def days_before(onsets: DataFrame, index: DataFrame) -> DataFrame:
    """Telemetry days of the host before the onset day, and the size of the onset day's file.

    ``index`` is (host, day, size_bytes), one row per host and day: bounded by the calendar.
    """
    o = onsets.select("host", "onset", F.to_date("onset").alias("_d"))
    i = index.select(F.col("host").alias("_ih"), F.to_date("day").alias("_day"), "size_bytes")
    return (
        o.join(i, F.col("host") == F.col("_ih"), "left")
        .groupBy("host", "onset")
        .agg(
            F.count(F.when(F.col("_day") < F.col("_d"), 1)).alias("days_before"),
            F.coalesce(F.max(F.when(F.col("_day") == F.col("_d"), F.col("size_bytes"))), F.lit(0)).alias(
                "onset_day_bytes"
            ),
            (F.count("_day") > 0).alias("has_telemetry"),
        )
    )


def sequence_extras(
    sequences: DataFrame, flows: DataFrame, pane_seconds: float | None = None, base_seconds: int = 600
) -> DataFrame:
    """Mean TTL, mean TTL deviation and retransmissions of a host's flows in [start, end).

    With ``pane_seconds`` (the window stride, when sequence bounds lie on that grid) flows are
    reduced to one row per (host, pane) before the interval join; otherwise one row per distinct
    (host, timestamp).
    """
    grain = "_ft"
    f = flows.select(
        F.col("source_ip").alias("_fh"), _us("timestamp").alias("_ft"), "ttl_mean", "ttl_std", "retransmission_count"
    )
    if pane_seconds:
        pane = round(pane_seconds * MICROS)
        t0 = sequences.agg(F.min(_us("seq_start_time"))).scalar()
        f = f.withColumn("_ft", F.floor((F.col("_ft") - t0) / pane) * pane + t0)
    reduced = f.groupBy("_fh", grain).agg(
        F.sum("ttl_mean").alias("_ts"), F.count("ttl_mean").alias("_tc"),
        F.sum("ttl_std").alias("_ds"), F.count("ttl_std").alias("_dc"),
        F.sum("retransmission_count").alias("_rs"),
    )
    spans = sequences.select(
        "sequence_id",
        F.col("host_id").alias("_sh"),
        _us("seq_start_time").alias("_s"),
        (_us("seq_end_time") - 1).alias("_e"),
    )
    per = (
        interval_join(reduced, spans, [("_fh", "_sh")], grain, "_s", "_e", base_seconds)
        .groupBy("sequence_id")
        .agg(
            (F.sum("_ts") / F.nullif(F.sum("_tc"), F.lit(0))).alias("ttl_mean"),
            (F.sum("_ds") / F.nullif(F.sum("_dc"), F.lit(0))).alias("ttl_std_mean"),
            F.sum("_rs").alias("retransmissions"),
        )
    )
    return sequences.join(per, "sequence_id", "left")
