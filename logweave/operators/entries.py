"""Group lines into entries: a header with a timestamp and its continuation lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from logweave.functions.timestamps import TimestampFormat, key_for, matches_format, span_for
from logweave.operators.joins import attach, whole_entries, without_entries
from logweave.operators.staging import LINE, RUN_KEY, StagedLines, earlier_runs
from logweave.session import local_table, store

# Text of an entry that is put into one value, and lines of a longer one that are summed up together.
PART_BYTES = 32 << 20
BLOCK_LINES = 1 << 12

DOCUMENT_COLUMNS = [
    "file", "file_ord", "entry_no", "line_in_entry", "sort_key", "timestamp_length", "line",
]


#: What is known of files whose earlier lines were parsed before: how many lines and headers they
#: had, their format, and the entry that is still open: its key and the line it begins at.
RESUME_SCHEMA = "file_ord bigint, lines bigint, headers bigint, fmt_idx int, resumed_key string, resumed_line bigint"


def _runs(staged: StagedLines, formats_by_file: DataFrame, resume: DataFrame | None) -> DataFrame:
    """Runs with what precedes them in their file: lines, headers, and the last header."""
    if resume is None:
        resume = local_table(staged.pieces.sparkSession, [], RESUME_SCHEMA)
    header = matches_format(F.col("flags"), F.col("fmt_idx"))
    header_line = F.col("lines_before") + F.col("last_header") - F.col("run_pos")
    return (
        staged.pieces_by_file().join(formats_by_file.select("file_ord", "fmt_idx"), "file_ord", "left")
        .join(F.broadcast(resume.drop("fmt_idx")), "file_ord", "left")  # as many rows as files are resumed
        .groupBy("file_ord", "file", "fmt_idx", "lines", "headers", "resumed_key", "resumed_line", "offset", *RUN_KEY)
        .agg(
            F.sum("n").alias("n_lines"),
            F.min("first_pos").alias("run_pos"),
            F.sum(F.when(header, F.col("n")).otherwise(0)).alias("n_headers"),
            F.max(F.when(header, F.col("last_pos"))).alias("last_header"),
        )
        .select(
            "*",
            _before("n_lines", "lines").alias("lines_before"),
            _before("n_headers", "headers").alias("headers_before"),
        )
        .withColumn(
            "open_line",
            F.coalesce(F.last(header_line, ignorenulls=True).over(earlier_runs()), "resumed_line", F.lit(0)),
        )
        .drop("n_lines", "n_headers", "lines", "headers", "resumed_line")
    )


def _before(own: str, resumed: str) -> Column:
    return F.coalesce(F.sum(own).over(earlier_runs()), F.lit(0)) + F.coalesce(resumed, F.lit(0))


def _formats_in_use(staged: StagedLines, runs: DataFrame) -> dict[int, TimestampFormat]:
    """At most as many as the catalog has."""
    numbers = runs.agg(F.collect_set("fmt_idx")).first()[0]
    return {number: staged.formats[number] for number in sorted(numbers)}


def _carried(
    staged: StagedLines, runs: DataFrame, formats: dict[int, TimestampFormat]
) -> DataFrame:
    """Runs with the sort key that is still open when they begin. Reads stamps, not lines.

    A position is of one line only, so it is all that is matched.
    """
    closing_lines = attach(
        staged.lines.where("flags IS NOT NULL").select("pos", "stamp"),
        runs.where("last_header IS NOT NULL").withColumn("pos", F.col("last_header")), ["pos"], staged.n_pieces,
    )
    headerless = runs.where("last_header IS NULL").withColumn("stamp", F.lit(None).cast("string"))
    closing_key = F.when(F.col("stamp").isNotNull(), key_for(formats, F.col("fmt_idx"), F.col("stamp"))).cast("string")
    return (
        closing_lines.select(*headerless.columns)
        .unionByName(headerless)
        .repartition("file_ord")
        .withColumn("closing_key", closing_key)
        .withColumn("open_key", F.coalesce(F.last("closing_key", ignorenulls=True).over(earlier_runs()), "resumed_key"))
        .drop("closing_key", "stamp", "last_header", "offset", "resumed_key")
        .withColumn("run", F.monotonically_increasing_id())
    )


def build_document(
    staged: StagedLines, formats_by_file: DataFrame, resume: DataFrame | None = None
) -> DataFrame:
    """One row per line, with the entry it belongs to. ``resume`` has what came before in some files.

    ``entry_no`` 0 is the preamble, the lines before a file's first header, whose
    key is ``''``. One shuffle, by run; only run-sized groups meet in a task.
    """
    runs = store(_runs(staged, formats_by_file, resume), "runs")
    formats = _formats_in_use(staged, runs)
    carried = store(_carried(staged, runs, formats), "carried")
    # Only what a line needs for its key goes through the shuffle; the rest of its run joins it afterwards.
    lines = attach(
        staged.lines.select(*RUN_KEY, "pos", "flags", "stamp", "rest"), carried.select(*RUN_KEY, "run", "fmt_idx"), RUN_KEY, staged.n_pieces
    )
    header = matches_format(F.col("flags"), F.col("fmt_idx"))
    keyed = lines.select(
        "run",
        "pos",
        F.when(header, F.col("pos")).alias("header_pos"),
        F.when(header, key_for(formats, F.col("fmt_idx"), F.col("stamp"))).cast("string").alias("key"),
        F.when(header, span_for(formats, F.col("fmt_idx"), F.col("stamp")))
        .otherwise(0).alias("timestamp_length"),
        F.expr(LINE).alias("line"),
    )
    so_far = Window.partitionBy("run").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    grouped = keyed.select(
        "run", "pos", "timestamp_length", "line",
        F.last("key", ignorenulls=True).over(so_far).alias("own_key"),
        F.last("header_pos", ignorenulls=True).over(so_far).alias("own_start"),
        F.count("header_pos").over(so_far).alias("headers"),
    )
    since_open = F.col("lines_before") + F.col("pos") - F.col("run_pos") - F.col("open_line")
    return attach(grouped, carried.drop(*RUN_KEY, "fmt_idx"), ["run"], staged.n_pieces).select(
        "file",
        "file_ord",
        (F.col("headers_before") + F.col("headers")).alias("entry_no"),
        F.coalesce(F.col("pos") - F.col("own_start"), since_open).alias("line_in_entry"),
        F.coalesce("own_key", "open_key", F.lit("")).alias("sort_key"),
        "timestamp_length",
        "line",
    )


def entry_table(document: DataFrame) -> DataFrame:
    """One narrow row per entry."""
    return document.groupBy("file_ord", "entry_no", "sort_key").agg(
        F.count("*").alias("n_lines"), F.max("timestamp_length").alias("timestamp_length")
    )


def content_of(lines: Column) -> Column:
    """Text of an entry from its ordered lines: every line ends with a newline."""
    return F.concat(F.array_join(lines, "\n"), F.lit("\n"))


def entry_contents(document: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """Entries with their text, as the viewer copies them, in numbered parts.

    ``n_lines`` is the entry's. An entry of at most ``part_bytes`` is one part. A longer one, of any size, is cut between
    lines where each further ``part_bytes`` begin: its parts, joined in order, are its text, and a part is longer only by
    what its last line takes. So no value and no task holds a whole huge entry.
    """
    entry = ["file_ord", "entry_no", "sort_key"]
    line_bytes = F.octet_length("line").cast("bigint") + 1
    sizes = store(document.groupBy(*entry).agg(F.count("*").alias("n_lines"), F.sum(line_bytes).alias("n_bytes")), "entry-sizes")
    is_large = F.col("n_bytes") > part_bytes
    large = sizes.where(is_large)
    n_large = large.count()
    if n_large == 0:
        return _joined_lines(document.withColumn("part", F.lit(0).cast("bigint")), entry)
    short = without_entries(document, large, sizes.where(~is_large), n_large).withColumn("part", F.lit(0).cast("bigint"))
    # Bytes before each block of lines come from a table with one narrow row per block, those in the block from a short window.
    lines = whole_entries(document, large, at_most=n_large).withColumns(
        {"block": F.expr(f"line_in_entry div {BLOCK_LINES}"), "line_bytes": line_bytes})
    blocks = lines.groupBy(*entry, "block").agg(F.sum("line_bytes").alias("block_bytes"))
    earlier = Window.partitionBy(*entry).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(*entry, "block", F.coalesce(F.sum("block_bytes").over(earlier), F.lit(0)).alias("block_start"))
    before = Window.partitionBy(*entry, "block").orderBy("line_in_entry").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("block_start") + F.coalesce(F.sum("line_bytes").over(before), F.lit(0))
    placed = lines.join(starts, [*entry, "block"]).withColumn("start", start).withColumn("part", F.expr(f"start div {part_bytes}"))
    cut = _joined_lines(placed.select(*short.columns), entry).drop("n_lines").join(
        large.select(*entry, "n_lines"), entry)
    return _joined_lines(short, entry).unionByName(cut)


def _joined_lines(document: DataFrame, entry: list[str]) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("line_in_entry", "line")))
    return document.groupBy(*entry, "part").agg(
        F.count("*").alias("n_lines"), content_of(F.transform(ordered, lambda item: item["line"])).alias("content"),
    )
