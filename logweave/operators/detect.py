"""Timestamp format of each file, by a vote over its first lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from logweave.functions.timestamps import TimestampFormat, first_match
from logweave.operators.joins import attach
from logweave.operators.staging import RUN_KEY, StagedLines, earlier_runs

# Fixed value: how many lines at the start of a file may vote.
SAMPLE_LINES = 2_000


def run_sizes(pieces: DataFrame) -> DataFrame:
    """One row per run, with the number of lines of the file before it."""
    return (
        pieces.groupBy("file_ord", "offset", *RUN_KEY)
        .agg(F.sum("n").alias("n_lines"), F.min("first_pos").alias("run_pos"))
        .withColumn("lines_before", F.coalesce(F.sum("n_lines").over(earlier_runs()), F.lit(0)))
    )


def file_formats(
    staged: StagedLines, sample_lines: int = SAMPLE_LINES, resume: DataFrame | None = None
) -> DataFrame:
    """``(file_ord, fmt_idx, votes, via)`` for files with a recognised format.

    Each sampled line votes for the first format that matches it; the most votes
    win and ties go to the earlier format. If no sampled line votes, the first
    line that matches anywhere decides. A file in ``resume`` had its vote; without a format so far, its
    first match decides.
    """
    heads = (
        run_sizes(staged.pieces_by_file())
        .where(F.col("lines_before") < sample_lines)
        .select("file_ord", *RUN_KEY, "run_pos", "lines_before")
    )
    candidates = staged.lines.where("flags IS NOT NULL").select(*RUN_KEY, "pos", "flags")
    voters = attach(candidates, heads, RUN_KEY, staged.n_pieces).where(F.col("lines_before") + F.col("pos") - F.col("run_pos") < sample_lines)
    tallies = voters.groupBy("file_ord", first_match(F.col("flags")).alias("fmt_idx")).agg(
        F.count("*").alias("votes")
    )
    best = tallies.groupBy("file_ord").agg(
        F.max(F.struct("votes", -F.col("fmt_idx"))).alias("best")
    )
    first = (
        staged.pieces_by_file().where("flags IS NOT NULL")
        .groupBy("file_ord")
        .agg(F.min_by("flags", F.struct("offset", "first_pos")).alias("flags"))
    )
    found = first.join(best, "file_ord", "left").select(
        "file_ord",
        F.coalesce(-F.col("best.col2"), first_match(F.col("flags"))).alias("fmt_idx"),
        F.coalesce("best.votes", F.lit(0)).alias("votes"),
        F.when(F.col("best").isNotNull(), "vote").otherwise("first_match").alias("via"),
        first_match(F.col("flags")).alias("first_idx"),
    )
    if resume is None:
        return found.drop("first_idx")
    settled = resume.select("file_ord", F.col("fmt_idx").alias("settled_idx"), F.lit(True).alias("settled"))
    pinned = F.col("settled_idx").isNotNull()
    return found.join(settled, "file_ord", "full_outer").select(
        "file_ord",
        F.when(F.col("settled"), F.coalesce("settled_idx", "first_idx")).otherwise(F.col("fmt_idx")).alias("fmt_idx"),
        F.when(F.col("settled"), F.lit(0)).otherwise(F.col("votes")).alias("votes"),
        F.when(pinned, "earlier").when(F.col("settled"), "first_match").otherwise(F.col("via")).alias("via"),
    ).where("fmt_idx IS NOT NULL")


def format_report(staged: StagedLines, formats_by_file: DataFrame) -> DataFrame:
    """One row per file, also for those without lines or without a format."""
    names: list[TimestampFormat] = staged.formats
    name = F.get(F.array(*[F.lit(f.name) for f in names]), F.col("fmt_idx"))
    files = staged.units.groupBy("file_ord").agg(F.first("file").alias("file"))
    return files.join(formats_by_file, "file_ord", "left").select(
        "file_ord", "file", name.alias("format"), F.coalesce("votes", F.lit(0)).alias("votes"), "via"
    )
