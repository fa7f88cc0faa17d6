"""Scalar column functions. All are built-in expressions and stay inside codegen."""

from __future__ import annotations

import functools

from pyspark.sql import Column, functions as F

from .lookups import PROTOCOL_NAMES, map_column

# --- fixed values -------------------------------------------------------------------------

# tried in this order; the first pattern that fits wins
FLOW_TIME_PATTERNS = ["d/M/y H:m:s", "d/M/y H:m", "M/d/y H:m:s", "M/d/y H:m"]
# capture sheets use a 12-hour clock without AM/PM and no capture starts before eight
FIRST_MORNING_HOUR = 8
# TCP flag bits in flow export records
FLAG_BITS = {"fin": 1, "syn": 2, "rst": 4, "psh": 8, "ack": 16, "urg": 32}
# scenario number -> (capture id, file stem) of the public botnet captures
BOTNET_SCENARIOS = {
    1: (42, "capture20110810"),
    2: (43, "capture20110811"),
    3: (44, "capture20110812"),
    4: (45, "capture20110815"),
    5: (46, "capture20110815-2"),
    6: (47, "capture20110816"),
    7: (48, "capture20110816-2"),
    8: (49, "capture20110816-3"),
    9: (50, "capture20110817"),
    10: (51, "capture20110818"),
    11: (52, "capture20110818-2"),
    12: (53, "capture20110819"),
    13: (54, "capture20110815-3"),
}
PROBABILITY_EPS = 1e-7

# --- time ---------------------------------------------------------------------------------


def parse_flow_time(text: Column) -> Column:
    """Day-first then month-first sheet formats, then ISO; NULL when nothing fits."""
    text = F.trim(text)
    tries = [F.try_to_timestamp(text, F.lit(p)) for p in FLOW_TIME_PATTERNS]
    return F.coalesce(*tries, F.try_to_timestamp(text))


def repair_twelve_hour(ts: Column) -> Column:
    return F.when(F.hour(ts) < FIRST_MORNING_HOUR, ts + F.expr("INTERVAL 12 HOURS")).otherwise(ts)


def parse_local_time(text: Column) -> Column:
    """ISO text with an offset to its local clock time; the offset is dropped on purpose."""
    return F.coalesce(
        F.try_to_timestamp(F.substring(text, 1, 23), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSS")),
        F.try_to_timestamp(F.substring(text, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")),
    )


def epoch_millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 1e6


# --- network fields -----------------------------------------------------------------------


def parse_port(text: Column) -> Column:
    """Decimal or 0x-prefixed port; blanks, words and de-identified ``N…`` tokens are NULL."""
    text = F.lower(F.trim(text.cast("string")))
    hexed = F.when(text.rlike("^0x[0-9a-f]+$"), F.conv(F.substring(text, 3, 16), 16, 10).try_cast("int"))
    return F.coalesce(hexed, text.try_cast("double").try_cast("int"))


def host_key(hostname: Column) -> Column:
    return F.lower(F.trim(F.substring_index(hostname, ".", 1)))


def label_family(label: Column) -> Column:
    return (
        F.when(label.contains("Botnet"), F.lit("Botnet"))
        .when(label.contains("Normal"), F.lit("Normal"))
        .otherwise(F.lit("Background"))
    )


def scenario_id(file_name: Column) -> Column:
    """Scenario number from the official file stem, ``scenario_NN…`` or ``…botnet-NN…``."""
    base = F.element_at(F.split(file_name, "/"), -1)
    stem = F.regexp_replace(base, r"\.binetflow(\.gz)?$", "")
    by_stem = map_column({s: n for n, (_, s) in BOTNET_SCENARIOS.items()})
    by_capture = map_column({c: n for n, (c, _) in BOTNET_SCENARIOS.items()})
    numbered = F.nullif(F.regexp_extract(base, r"^scenario_(\d+)", 1), F.lit("")).try_cast("int")
    captured = F.nullif(F.regexp_extract(base, r"(?i)botnet[-_](\d+)", 1), F.lit("")).try_cast("int")
    known = F.when(numbered.between(1, len(BOTNET_SCENARIOS)), numbered)
    return F.coalesce(F.try_element_at(by_stem, stem), known, F.try_element_at(by_capture, captured))


def protocol_name(code: Column, source: str) -> Column:
    """Protocol number as text to its name; codes outside the table stay as they are."""
    text = F.trim(code.cast("string"))
    return F.coalesce(F.try_element_at(map_column(PROTOCOL_NAMES[source]), text), text)


# --- numbers ------------------------------------------------------------------------------


def signed_log1p(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def signed_expm1(x: Column) -> Column:
    return F.signum(x) * F.expm1(F.abs(x))


def finite_or_null(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - PROBABILITY_EPS)), F.lit(PROBABILITY_EPS))
    return F.ln(p / (1 - p))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def clip(x: Column, low: float, high: float) -> Column:
    """Clamp and keep NULL as NULL (greatest/least alone would drop it)."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high)), F.lit(low)))


def half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)


def severity(risk: Column) -> Column:
    """Event severity 0-10 from a 0-100 risk; half-even, NULL gives 0."""
    return F.coalesce(clip(F.bround(risk / 10, 0), 0, 10).cast("int"), F.lit(0))


def risk_level(risk: Column, low: float = 33, medium: float = 66) -> Column:
    return F.when(risk < low, "low").when(risk < medium, "medium").otherwise("high")


# --- text ---------------------------------------------------------------------------------


def cef_header(text: Column) -> Column:
    steps = [("\\", "\\\\"), ("|", "\\|"), ("\n", " "), ("\r", " ")]
    return functools.reduce(lambda c, s: F.replace(c, F.lit(s[0]), F.lit(s[1])), steps, text)


def cef_extension(text: Column) -> Column:
    steps = [("\\", "\\\\"), ("=", "\\="), ("\n", "\\n"), ("\r", "\\r")]
    return functools.reduce(lambda c, s: F.replace(c, F.lit(s[0]), F.lit(s[1])), steps, text)


def counts_json(counts: Column) -> Column:
    """``array<struct<name,n>>`` to ``{"a": 1, "b": 2}`` text, names sorted, zero counts left out."""
    quoted = F.transform(
        F.array_sort(F.filter(counts, lambda e: e["n"] > 0)),
        lambda e: F.concat(
            F.lit('"'),
            F.replace(F.replace(e["name"], F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')),
            F.lit('": '),
            e["n"].cast("string"),
        ),
    )
    return F.concat(F.lit("{"), F.array_join(quoted, ", "), F.lit("}"))


def fixed6(x: Column) -> Column:
    """Number as text with six decimals, NULL as NULL. ``format_number`` would add commas."""
    return F.when(x.isNotNull(), F.format_string("%.6f", x.cast("double")))


def canonical_text(*columns: Column) -> Column:
    """One unambiguous line from text fields: NULL is a lone ``~``, separators inside are escaped."""

    def one(c):
        safe = F.replace(F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
        return F.coalesce(F.replace(safe, F.lit("~"), F.lit("\\~")), F.lit("~"))

    return F.concat_ws("|", *[one(c) for c in columns])
