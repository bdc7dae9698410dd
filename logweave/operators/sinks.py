"""Write logs back as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from logweave.operators.merge import merge_chronological
from logweave.session import store


def write_merged(document: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One line of text per line. The part files, in name order, are the merged log."""
    merge_chronological(document).select("line").write.mode(mode).option("lineSep", "\n").text(path)


def export_visible(document: DataFrame, predicate: Column, path: str) -> None:
    """Write the lines a filter leaves, replacing what is there.

    They are stored unsorted first: the sort looks at its input twice, and the filter is to see each line once.
    """
    write_merged(store(document.where(predicate), "visible"), path, mode="overwrite")
