"""Statistics over the entries that have a visible line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from logweave.functions.levels import level_of


def visible_headers(document: DataFrame, predicate: Column | None = None) -> DataFrame:
    """One header per entry with a visible line, whether or not the header matches."""
    headers = document.where("line_in_entry = 0").select(
        "file_ord", "entry_no", "sort_key", F.col("line").alias("header")
    )
    if predicate is None:
        return headers
    # Both sides hold at most one row per entry, so no key is hot.
    hits = document.where(predicate).select("file_ord", "entry_no").distinct()
    return headers.join(hits, ["file_ord", "entry_no"], "left_semi")


def level_counts(headers: DataFrame) -> DataFrame:
    """Entries per level, most frequent first; ties in order of first appearance."""
    return (
        headers.groupBy(level_of(F.col("header")).alias("level"))
        .agg(
            F.count("*").alias("count"),
            F.min(F.struct("sort_key", "file_ord", "entry_no")).alias("first"),
        )
        .orderBy(F.col("count").desc(), "first")
        .select("level", "count")
    )


def level_share(counts: DataFrame) -> DataFrame:
    """Counts with the number of visible entries and each level's share in percent."""
    # At most one row per level reaches this window.
    total = F.sum("count").over(Window.partitionBy())
    share = F.round(100.0 * F.col("count") / total, 2)
    return counts.select("level", "count", total.alias("total_entries"), share.alias("share"))
