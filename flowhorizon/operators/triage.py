"""Analyst actions on alerts: a per-alert state machine, its history and its own hash chain."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.lookups import STAGE_ORDER, map_column
from ..functions.scalars import canonical_text
from ..plans.scan import row_index
from ..sinks.tables import stage
from .ledger import BLOCK_ROWS, chain_rows, chain_violations

STATES = ["open", "acknowledged", "response_approved", "dismissed", "reopened"]
# fixed values: action -> (states it is allowed in, state after); None means any / unchanged
TRANSITIONS = {
    "acknowledge": (["open", "reopened"], "acknowledged"),
    "approve_response": (["open", "acknowledged", "reopened"], "response_approved"),
    "dismiss": (["open", "acknowledged", "reopened"], "dismissed"),
    "reopen": (["response_approved", "dismissed"], "reopened"),
    "override_stage": (None, None),
    "comment": (None, None),
}
ACTION_FIELDS = ["alert_id", "alert_hash", "action", "analyst", "note", "response", "stage", "status_after", "created_at"]
ALERT_CHANGED = "the alert was changed or removed after the action"
FOLD_ROWS = 256


def _moves() -> dict[str, str]:
    """``state|action`` to the next state, for every allowed pair."""
    out = {}
    for action, (allowed, after) in TRANSITIONS.items():
        for state in allowed or STATES:
            out[f"{state}|{action}"] = after or state
    return out


def static_problem(actions: DataFrame) -> Column:
    """Why an action is invalid whatever the alert's state; NULL when it is fine."""

    def blank(c):
        return F.col(c).isNull() | (F.trim(F.col(c)) == "")

    return (
        F.when(~F.coalesce(F.col("action").isin(list(TRANSITIONS)), F.lit(False)), "no such action")
        .when(blank("analyst"), "an action names its analyst")
        .when((F.col("action") == "approve_response") & blank("response"), "approval without a response")
        .when(
            (F.col("action") == "override_stage") & ~F.coalesce(F.col("stage").isin(STAGE_ORDER), F.lit(False)),
            "override without a listed stage",
        )
        .when((F.col("action") == "comment") & blank("note"), "an empty comment")
    )


def _walk(actions: Column, start: Column) -> Column:
    """States after each action of a short ordered list, starting with the state before the first."""
    moves = map_column(_moves())
    return F.aggregate(
        actions,
        F.array(start),
        lambda states, a: F.array_append(
            states,
            F.coalesce(
                F.try_element_at(moves, F.concat(F.element_at(states, -1), F.lit("|"), a["action"])),
                F.element_at(states, -1),
            ),
        ),
    )


def replay_states(actions: DataFrame, initial: DataFrame | None = None, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """``action_id, state_before, state_after, allowed`` for statically valid actions.

    A run of actions maps each start state to an end state, and such maps compose. Runs of
    ``fold_rows`` actions are therefore walked in parallel for all five start states, the runs of an
    alert are chained through these maps, and each run is walked once more from its real start.
    """
    moves = map_column(_moves())
    indexed = row_index(
        actions.select("action_id", "alert_id", "action"), ["alert_id"], ["action_id"], F.floor(F.col("action_id") / 65536)
    ).withColumn("run", F.floor(F.col("row_idx") / fold_rows).cast("bigint"))
    runs = indexed.groupBy("alert_id", "run").agg(
        F.array_sort(F.collect_list(F.struct("row_idx", "action_id", "action"))).alias("steps")  # <= fold_rows
    )
    runs = stage(runs, "runs")  # read once per branch below
    ends = F.array(*[F.element_at(_walk(F.col("steps"), F.lit(s)), -1) for s in STATES])
    maps = runs.select("alert_id", "run", ends.alias("ends"))
    if initial is not None:
        maps = maps.join(initial.select("alert_id", F.col("status").alias("first")), "alert_id", "left")
    else:
        maps = maps.withColumn("first", F.lit("open"))

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("run")
        state, starts = pdf["first"].iloc[0] or "open", []
        for e in pdf["ends"]:
            starts.append(state)
            state = e[STATES.index(state)]
        return pd.DataFrame({"alert_id": pdf["alert_id"], "run": pdf["run"], "start": starts})

    folded = (
        maps.select("alert_id", "run", "ends", F.coalesce("first", F.lit("open")).alias("first"))
        .groupBy("alert_id")
        .applyInPandas(chain, "alert_id bigint, run bigint, start string")
    )
    started = runs.join(folded, ["alert_id", "run"])
    walked = started.withColumn("_states", _walk(F.col("steps"), F.col("start")))
    each = walked.select(F.posexplode("steps").alias("i", "s"), "_states")
    before, after = F.get("_states", F.col("i")), F.get("_states", F.col("i") + 1)
    return each.select(
        F.col("s.action_id").alias("action_id"),
        before.alias("state_before"),
        after.alias("state_after"),
        F.try_element_at(moves, F.concat(before, F.lit("|"), F.col("s.action"))).isNotNull().alias("allowed"),
    )


def record_actions(actions: DataFrame, alerts: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """Decide a batch of proposed actions in ``action_id`` order.

    Adds ``alert_hash``, ``status_after``, ``accepted`` and ``reason``. Rejected actions do not
    change the state.
    """
    known = alerts.select(F.col("id").alias("_aid"), F.col("hash").alias("alert_hash"))
    joined = actions.join(known, F.col("alert_id") == F.col("_aid"), "left")
    marked = joined.withColumn(
        "_static", F.coalesce(static_problem(joined), F.when(F.col("_aid").isNull(), "alert not found"))
    ).drop("_aid")
    states = replay_states(marked.filter(F.col("_static").isNull()), initial)
    out = marked.join(states, "action_id", "left")
    late = F.when(~F.col("allowed"), F.concat(F.lit("cannot "), "action", F.lit(" an alert that is "), "state_before"))
    reason = F.coalesce(F.col("_static"), late)
    return out.withColumns(
        {
            "reason": reason,
            "accepted": reason.isNull(),
            "status_after": F.when(reason.isNull(), F.col("state_after")),
            "analyst": F.trim("analyst"),
            "stage": F.when(F.col("action") == "override_stage", F.col("stage")),
        }
    ).drop("_static", "state_before", "state_after", "allowed")


def action_text() -> Column:
    return canonical_text(F.col("seq_no"), *[F.col(f) for f in ACTION_FIELDS])


def chain_actions(accepted: DataFrame, heads: DataFrame | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Chain accepted actions per alert; ``id`` is the action id."""
    rows = accepted.filter("accepted").withColumn("id", F.col("action_id"))
    numbered = row_index(rows, ["alert_id"], ["id"], F.floor(F.col("id") / 65536), "seq_no")
    return chain_rows(numbered, "alert_id", action_text(), heads, block_rows)


def statuses(actions: DataFrame) -> DataFrame:
    """Status of every alert that has actions: that of its latest one."""
    return actions.groupBy("alert_id").agg(F.max_by("status_after", "id").alias("status"))


def triage_summary(alerts: DataFrame, actions: DataFrame, session_id: str | None = None) -> DataFrame:
    """Alerts per status; alerts without an action are open."""
    if session_id is not None:
        alerts = alerts.filter(F.col("session_id") == session_id)
    s = statuses(actions)
    joined = alerts.select("id").join(s, F.col("id") == F.col("alert_id"), "left")
    return joined.groupBy(F.coalesce("status", F.lit("open")).alias("status")).agg(F.count(F.lit(1)).alias("alerts"))


def alert_history(alerts: DataFrame, actions: DataFrame) -> DataFrame:
    """Per alert: status, model and effective stage, response in force, number of actions.

    The latest override wins; a response counts only while the status is response_approved. The
    ordered actions themselves stay rows of the action table.
    """
    def when(action, col):
        return F.max_by(F.when(F.col("action") == action, F.col(col)), F.when(F.col("action") == action, F.col("id")))

    per = actions.groupBy("alert_id").agg(
        F.max_by("status_after", "id").alias("_status"),
        when("override_stage", "stage").alias("_stage"),
        when("approve_response", "response").alias("_response"),
        F.count(F.lit(1)).alias("_n"),
    )
    status = F.coalesce("_status", F.lit("open"))
    return alerts.select(F.col("id").alias("alert_id"), "predicted_stage").join(per, "alert_id", "left").select(
        "alert_id",
        status.alias("status"),
        F.col("predicted_stage").alias("model_stage"),
        F.coalesce("_stage", "predicted_stage").alias("effective_stage"),
        F.when(status == "response_approved", F.col("_response")).alias("approved_response"),
        F.coalesce("_n", F.lit(0)).alias("actions"),
    )


def action_violations(chained: DataFrame, alerts: DataFrame) -> DataFrame:
    """Broken links, changed content, and actions whose alert no longer has the bound hash."""
    chain = chain_violations(chained, "alert_id", action_text()).select("id", "alert_id", "reason")
    now = alerts.select(F.col("id").alias("_aid"), F.col("hash").alias("_now"))
    bound = chained.join(now, F.col("alert_id") == F.col("_aid"), "left").filter(
        ~F.col("_now").eqNullSafe(F.col("alert_hash"))
    )
    both = chain.unionByName(bound.select("id", "alert_id", F.lit(ALERT_CHANGED).alias("reason")))
    # link and content problems come first when one action has several
    rank = F.when(F.col("reason") == ALERT_CHANGED, 1).otherwise(0)
    return both.groupBy("id", "alert_id").agg(F.min_by("reason", rank).alias("reason"))


def verify_actions(chained: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row: status, first bad action, reason, number of actions."""
    bad = action_violations(chained, alerts).agg(F.min("id").alias("action_id"), F.min_by("reason", "id").alias("reason"))
    total = chained.agg(F.count(F.lit(1))).scalar()
    return bad.select(
        F.when(F.col("action_id").isNull(), "VERIFIED").otherwise("CORRUPTED").alias("status"),
        "action_id",
        "reason",
        total.alias("actions"),
    )


