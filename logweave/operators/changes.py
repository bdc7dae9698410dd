"""What changed in a directory between two snapshots."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from logweave.sources.listing import Listing
from logweave.sources.snapshots import TreeSnapshot


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(path, status)`` with status added, removed, modified or same."""
    before, after = old.alias("o"), new.alias("n")
    return before.join(after, F.col("o.path") == F.col("n.path"), "full_outer").select(
        F.coalesce("o.path", "n.path").alias("path"),
        F.when(F.col("o.path").isNull(), "added")
        .when(F.col("n.path").isNull(), "removed")
        .when(
            (F.col("o.mtime_us") != F.col("n.mtime_us")) | (F.col("o.length") != F.col("n.length")),
            "modified",
        )
        .otherwise("same")
        .alias("status"),
    )


@dataclass(frozen=True)
class ChangeCheck:
    """``status`` is changed, unchanged or inconclusive."""

    status: str
    baseline: Listing


def check_changes(baseline: Listing, current: Listing) -> ChangeCheck:
    """Compare listings. One that misses something never counts as a change and
    never becomes the baseline."""
    if current.skipped:
        return ChangeCheck("inconclusive", baseline)
    if current.files == baseline.files:
        return ChangeCheck("unchanged", baseline)
    return ChangeCheck("changed", current)


def check_snapshots(baseline: TreeSnapshot, current: TreeSnapshot) -> tuple[str, TreeSnapshot]:
    """The status and the next baseline, as ``check_changes``, from trees that the executors listed."""
    if current.skipped:
        return "inconclusive", baseline
    changed = not snapshot_diff(baseline.files, current.files).where("status <> 'same'").isEmpty()
    return ("changed", current) if changed else ("unchanged", baseline)
