"""Lines with a fixed position, and the runs they come in.

A *run* is a contiguous piece of one file, at most ``2 ** RUN_BITS`` lines long,
whatever the file's size and whether or not it can be split. Everything that
has to be carried from line to line is computed inside runs, and then once more
over the table of runs, which has one narrow row per run.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, WindowSpec, functions as F

from logweave.functions.timestamps import TimestampFormat, stamp_of, with_match_flags
from logweave.session import store
from logweave.sources.logs import LogSource, decoded_path

RUN_BITS = 20
RUN_KEY = ["file_id", "block_start", "chunk"]
_MARK_BYTES = 3  # of a byte order mark, which readers drop

#: A stored line again, from its stamp and the rest.
LINE = "concat(coalesce(stamp, ''), rest)"


def earlier_runs() -> WindowSpec:
    """Over the table of runs only: the runs of one file before this one."""
    in_file = Window.partitionBy("file_ord").orderBy("offset", "chunk")
    return in_file.rowsBetween(Window.unboundedPreceding, -1)


@dataclass
class StagedLines:
    """``lines``: escaped, file_id, block_start, chunk, pos, flags, stamp, n_bytes, rest.

    ``pos`` increases along each block; ``flags`` says which formats match, and ``stamp`` is as much
    of a line that matches one as its key needs, so that headers can be looked at without reading text. ``rest`` is
    what follows the stamp; see ``LINE``. ``escaped`` is the path as the scan spells it, if that is not the plain one.
    ``pieces``: file_ord, file, path, run key, offset, flags, n, n_bytes, first_pos, last_pos,
    one row per run and set of flags; ``n_pieces`` bounds the number of runs.
    """

    lines: DataFrame
    pieces: DataFrame
    n_pieces: int
    units: DataFrame
    formats: list[TimestampFormat]

    def pieces_by_file(self) -> DataFrame:
        """The narrow table in the partitioning that all per-file steps share."""
        return self.pieces.repartition("file_ord")

    def unread(self) -> DataFrame:
        """``(path, reason)`` of files that gave less than their listing says.

        They were removed, closed to us or cut short after they had been listed. The last newline may be missing, and a
        byte order mark is not counted.
        """
        read = self.pieces.groupBy("path", "file_ord").agg(F.sum("n_bytes").alias("read"))
        listed = self.units.where("filled").join(read, ["path", "file_ord"], "left")
        cut = F.format_string("cut short: %d of %d bytes were there when it was scanned", "read", "length")
        gone = F.lit("not read: it was gone or closed when it was scanned")
        reason = F.when(F.col("read").isNull(), gone).when(F.col("read") + _MARK_BYTES < F.col("length"), cut)
        return listed.select("path", reason.alias("reason")).where("reason IS NOT NULL").distinct()


def stage(source: LogSource, formats: list[TimestampFormat], run_bits: int = RUN_BITS) -> StagedLines:
    """Scan the files once. Later steps read the columns they need from the stored table."""
    position = F.monotonically_increasing_id()
    placed = source.lines.withColumn("pos", position).select(
        # A name without escapes is found by its hash; to write a path with every line costs as much as to write its text.
        F.when(F.contains("file", F.lit("%")), F.col("file")).alias("escaped"),
        F.xxhash64("file").alias("file_id"),
        "block_start",
        F.shiftright("pos", run_bits).alias("chunk"),
        "pos",
        "n_bytes",
        "line",
    )
    # The formats are looked for in the stamp: a regex takes time for every character it is given.
    flagged = with_match_flags(placed.withColumn("stamp", stamp_of(formats, F.col("line"))), formats, "stamp")
    matched = F.col("flags").isNotNull()
    stamp = F.when(matched, F.col("stamp")).alias("stamp")
    rest = F.when(matched, F.substr("line", F.length("stamp") + 1)).otherwise(F.col("line")).alias("rest")
    lines = store(flagged.select("escaped", *RUN_KEY, "pos", "flags", stamp, "n_bytes", rest), "lines")
    per_flags = lines.groupBy("escaped", *RUN_KEY, "flags").agg(
        F.count("*").alias("n"),
        F.min("pos").alias("first_pos"),
        F.max("pos").alias("last_pos"),
        F.sum(F.col("n_bytes").cast("bigint") + 1).alias("n_bytes"),
    )
    path_id = F.when(F.col("escaped").isNull(), F.col("file_id")).otherwise(F.xxhash64(decoded_path(F.col("escaped"))))
    pieces = store(
        per_flags.withColumn("path_id", path_id)
        .join(source.units.withColumn("path_id", F.xxhash64("path")), "path_id")
        .withColumn("offset", F.col("base") + F.col("block_start"))
        .drop("escaped", "path_id", "base", "filled", "length"),
        "pieces",
    )
    return StagedLines(lines, pieces, pieces.count(), source.units, formats)

