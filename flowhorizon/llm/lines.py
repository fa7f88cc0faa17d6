"""Line dedup by site-relative frequency, with DataFrame functions only.

Pages are grouped by host. A line's ratio is the number of the host's pages that contain it divided by
the number of the host's pages; lines whose ratio exceeds ``max_ratio`` are boilerplate of that host and are
dropped from its pages. A line on a single page repeats nothing and stays. Pages themselves always stay.

Defined results: a null text stays null and counts as a page without lines; lines are compared without
leading and trailing blanks; blank lines are neither counted nor dropped; a line repeated on one page
counts once; a null host is a host of its own; repeated rows are pages of their own; a page of which
every line is boilerplate keeps an empty text; a long text is split like any other; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import small_side, stored

MAX_RATIO = 0.1
SLOT = 8  # keys that one lookup compares, on average


def keys_of(line: Column) -> Column:
    """Comparison key of a line: 128 bits of its text, null for a blank line."""
    bare = F.trim(line)
    return F.when(bare != "", F.unhex(F.md5(bare)))


def slot_of(key: Column, slots: Column) -> Column:
    """Where a host's list keeps a key, so that a lookup does not read a long list."""
    return F.pmod(F.xxhash64(key), slots)


def line_keys(text: Column) -> Column:
    """Keys of the different lines of a page."""
    return F.array_distinct(F.array_compact(F.transform(F.split(text, "\n"), keys_of)))


def boilerplate(pages: DataFrame, host: str, text: str, max_ratio: float = MAX_RATIO) -> DataFrame:
    """Per host the keys of its boilerplate lines, in slots.

    Counts combine before they are shuffled. A host's list is bounded: each listed line is on more than
    ``max_ratio`` of the pages, so there are at most (lines per page) / ``max_ratio`` of them.
    """
    lines = pages.select(F.col(host).alias("_host"), F.explode(line_keys(F.col(text))).alias("_key"))
    counts = lines.groupBy("_host", "_key").agg(F.count("*").alias("_n")).filter("_n > 1")
    totals = pages.groupBy(F.col(host).alias("_h")).agg(F.count("*").alias("_pages"))
    common = counts.join(totals, F.col("_host").eqNullSafe(F.col("_h"))).filter(
        F.col("_n") / F.col("_pages") > max_ratio
    )
    listed = common.groupBy("_host").agg(F.collect_list("_key").alias("_keys"))
    slots = F.greatest(F.lit(1), F.ceil(F.size("_keys") / SLOT)).cast("int")
    by_slot = F.transform(F.sequence(F.lit(0), slots - 1), lambda i: F.filter("_keys", lambda k: slot_of(k, slots) == i))
    return listed.select("_host", F.size("_keys").alias("_listed"), by_slot.alias("_drop"))


def drop_boilerplate(pages, host="source", text="text", max_ratio=MAX_RATIO, counts: bool = False):
    """Pages with their boilerplate lines removed; ``counts`` adds n_lines (not blank) and n_dropped."""
    drop = stored(boilerplate(pages, host, text, max_ratio), "host-lines")
    hosts, listed = drop.agg(F.count("*"), F.coalesce(F.sum("_listed"), F.lit(0))).first()
    drop = small_side(drop, hosts * 128 + listed * 24, 1)
    # the page travels as one struct, so its column names cannot meet the ones made here
    packed = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("_page"))
    out = packed.join(drop, F.col(f"_page.`{host}`").eqNullSafe(F.col("_host")), "left")
    lines = F.split(F.col(f"_page.`{text}`"), "\n")
    at = lambda key: F.get("_drop", slot_of(key, F.size("_drop")).cast("int"))
    keyed = F.transform(lines, lambda x: F.struct(x.alias("line"), keys_of(x).alias("key")))
    stays = F.filter(keyed, lambda x: ~F.coalesce(F.array_contains(at(x["key"]), x["key"]), F.lit(False)))
    kept = F.transform(stays, lambda x: x["line"])
    new = F.when(F.col("_drop").isNull(), F.col(f"_page.`{text}`")).otherwise(F.array_join(kept, "\n"))
    columns = [(new if c == text else F.col(f"_page.`{c}`")).alias(c) for c in pages.columns]
    if counts:
        solid = lambda a: F.coalesce(F.size(F.filter(a, lambda x: F.trim(x) != "")), F.lit(0)).cast("bigint")
        whole = F.coalesce(lines, F.array().cast("array<string>"))
        left = F.when(F.col("_drop").isNull(), whole).otherwise(F.coalesce(kept, whole))
        columns += [solid(whole).alias("n_lines"), (solid(whole) - solid(left)).alias("n_dropped")]
    return out.select(*columns)


def html_lines(html: Column) -> Column:
    """Visible text of a page, one line per block element."""
    text = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", "\n")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", "\n")
    text = F.regexp_replace(
        text, r"(?i)</?(html|head|body|title|meta|nav|ul|ol|li|div|article|section|header|footer|h[1-6]|p|br|tr|td|th|table)[^>]*>", "\n"
    )
    return F.regexp_replace(text, r"<[^>]*>", "")
