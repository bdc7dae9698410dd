"""One query per operator, on logs rendered from the given tables."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from logweave.functions.ascii import ascii_icontains, ascii_iequals, ascii_lower
from logweave.functions.filters import regexp_filter, substring_filter
from logweave.functions.levels import level_of
from logweave.functions.timestamps import TimestampFormat
from logweave.operators import search, stats
from logweave.operators.changes import check_snapshots, snapshot_diff
from logweave.operators.detect import file_formats, format_report
from logweave.operators.entries import entry_contents, entry_table
from logweave.operators.merge import concat_logs, merge_chronological
from logweave.operators.sinks import export_visible, write_merged
from logweave.operators.staging import stage
from logweave.plans.merge_plan import merge_directory, parse_logs, reread_merged
from logweave.plans.refresh import LogStore
from logweave.session import scratch_path
from logweave.sources.catalog import BUILT_IN_FORMATS, load_catalog
from logweave.sources.listing import list_tree
from logweave.sources.logs import read_files, read_lines, read_tree
from logweave.sources.snapshots import snapshot_tree
from logweave.streaming.new_files import stream_new_files, streamed_document
from workload import fixture
from workload.fixture import log_lines, log_name, read_table, write_logs
from workload.logs import logs_of, named

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# Filters and terms shared with the oracles.
FILTER_WORD = "ERROR"
FILTER_EXPRESSION = 'error !"user=8 " || java:17) || WARNING && "user=1"'
FILTER_REGEXP = r"^\d{4}-.*error.*id=\d*7\b || handler\.java:[12]\)$"
FIND_TERM = "id=77"
FIND_FROM = 900
PART_BYTES = 100


def _tree_lines(spark: SparkSession, root: str, **options) -> DataFrame:
    lines = read_tree(spark, root, include_hidden=False, **options).lines
    return lines.select(log_name(F.col("file")).alias("file"), "line")


# ---- sources ----

@query
def read_lines_query(spark, sf_dir):
    """All logs, given by path and in reverse order; the first one twice."""
    listing = list_tree(spark, logs_of(spark, sf_dir).root, include_hidden=False)
    paths = [f.path for f in reversed(listing.files)]
    source = read_files(spark, [*paths, paths[0]])
    parsed = parse_logs(source)
    return named(parsed.document).groupBy("file_ord", "file").agg(
        F.count("*").alias("n_lines"), F.sum(F.octet_length("line")).alias("n_bytes")
    )


@query
def split_lines(spark, sf_dir):
    """Documents as logs with CRLF line ends: lines come back without them."""
    documents = read_table(spark, sf_dir, "documents")
    lines = documents.select(
        F.concat(F.lit("doc-"), F.floor(F.col("doc_id") / 500)).alias("file"),
        F.col("doc_id").alias("pos"),
        F.concat(F.replace("text", F.lit("\n"), F.lit("\r\n")), F.lit("\r")).alias("line"),
    )
    return _tree_lines(spark, write_logs(spark, sf_dir, lines=lines)).groupBy("file").agg(
        F.count("*").alias("n_lines"),
        F.count_if(F.col("line") == "").alias("n_empty"),
        F.sum(F.octet_length("line")).alias("n_bytes"),
        F.count_if(F.col("line").contains("\r")).alias("n_with_cr"),
    )


@query
def read_gzip(spark, sf_dir):
    return _tree_lines(spark, write_logs(spark, sf_dir, compression="gzip"))


@query
def read_tree_query(spark, sf_dir):
    return _tree_lines(spark, logs_of(spark, sf_dir).root)


@query
def read_tree_excluding(spark, sf_dir):
    """The output of an earlier merge lies in the tree and is not read again."""
    root = write_logs(spark, sf_dir)
    merge_directory(spark, root, include_hidden=False)
    return _tree_lines(spark, root, exclude=f"{root}/merged.log")


@query
def input_warnings(spark, sf_dir):
    """Lines per usable log, and the inputs that were left out."""
    root = write_logs(spark, sf_dir)
    damaged = f"{root}/name=zz-damaged.log/part-0.gz"
    _write_bytes(spark, damaged, b"\x1f\x8b\x08\x00" + bytes(6) + b"\xff\xff not deflate data")
    vanishing = f"{root}/name=zz-vanishing.log/part-0.txt"
    _write_bytes(spark, vanishing, b"gone before the scan\n")
    listing = list_tree(spark, root, include_hidden=False)
    folder = f"{root}/name=folder.log/part-0.txt"
    _write_bytes(spark, f"{folder}/x.txt", b"")
    missing = f"{root}/name=missing.log/part-0.txt"
    source = read_files(spark, [*(f.path for f in listing.files), missing, folder])
    _delete(spark, vanishing)
    parsed = parse_logs(source)
    usable = parsed.document.groupBy(log_name(F.col("file")).alias("file")).agg(F.count("*").alias("n_lines"))
    skipped = parsed.warnings().select(
        log_name(F.col("path")).alias("file"), F.lit(None).cast("bigint").alias("n_lines"),
        F.substring_index("reason", ":", 1).alias("skipped"),
    )
    return usable.withColumn("skipped", F.lit(None).cast("string")).unionByName(skipped)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, False)


def _write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    filesystem = target.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = filesystem.create(target, True)
    stream.write(bytearray(content))
    stream.close()


CATALOG = [
    {"name": "to-the-second", "pattern": "yyyy-MM-dd HH:mm:ss"},
    {"name": "logback", "pattern": "yyyy-MM-dd HH:mm:ss.SSS"},
    {"name": "web", "pattern": "dd/MMM/yyyy:HH:mm:ss"},
]


@query
def format_catalog(spark, sf_dir):
    """Formats detected with a catalog of one's own, where earlier entries vote first."""
    path = scratch_path(spark, "formats") + "/formats.json"
    _write_bytes(spark, path, json.dumps(CATALOG, indent=1).encode())
    catalog = load_catalog(spark, path)
    source = read_tree(spark, logs_of(spark, sf_dir).root, include_hidden=False)
    staged = stage(source, catalog.formats)
    return named(format_report(staged, file_formats(staged))).select("file", "format", "votes")


@query
def reread_merged_query(spark, sf_dir):
    """All logs in one layout: their merged log is read back as one log, in the same order."""
    lines = log_lines(spark, sf_dir, layout=0)
    root = write_logs(spark, sf_dir, lines=lines)
    merged = scratch_path(spark, "merged")
    write_merged(parse_logs(read_tree(spark, root, include_hidden=False)).document, merged)
    again = reread_merged(spark, merged)
    return search.number_lines(again.document).select("doc_line_no", "sort_key", "line")


# ---- sinks ----

@query
def write_merged_query(spark, sf_dir):
    out = scratch_path(spark, "merged")
    write_merged(logs_of(spark, sf_dir).parse().document, out)
    return _written(spark, out)


@query
def export_visible_query(spark, sf_dir):
    out = scratch_path(spark, "export")
    export_visible(logs_of(spark, sf_dir).document, substring_filter(FILTER_EXPRESSION), out)
    return _written(spark, out)


def _written(spark: SparkSession, out: str) -> DataFrame:
    """The lines of a written log with their place in it, from part to part."""
    lines = read_lines(spark, list_tree(spark, out, include_hidden=False).files).lines
    parts = lines.withColumn("pos", F.monotonically_increasing_id())
    ordered = parts.select(
        F.lit("").alias("sort_key"), F.col("file").alias("file_ord"),
        F.col("block_start").alias("entry_no"), F.col("pos").alias("line_in_entry"), "line",
    )
    return search.number_lines(ordered).select("doc_line_no", "line")


# ---- timestamps ----

def _key_query(name: str, layout: int, pattern: str) -> None:
    """Keys of all events, rendered in one layout."""
    def run(spark, sf_dir):
        fmt = TimestampFormat(name, pattern)
        return fixture.event_headers(spark, sf_dir, layout).select(
            "event_id", fmt.sort_key(F.col("header")).alias("sort_key"),
            fmt.span(F.col("header")).cast("bigint").alias("span"),
        )

    QUERIES[name] = run


_key_query("sort_key", 0, "yyyy-MM-dd HH:mm:ss.SSS")
_key_query("weekday_prefix", 2, "EEE MMM dd HH:mm:ss yyyy")
_key_query("twelve_hour", 3, "MM/dd/yyyy hh:mm:ss a")


@query
def sort_key_custom_pattern(spark, sf_dir):
    """A yearless pattern with literals, on all events."""
    fmt = TimestampFormat("custom", "<dd|MM @ HH.mm.ss,SSS>")
    events = read_table(spark, sf_dir, "events")
    line = F.concat(F.date_format("ts", "'<'dd'|'MM @ HH.mm.ss,SSSSSS'>'"), F.col("props"))
    return events.select("event_id", fmt.sort_key(line).alias("sort_key"))


@query
def timestamp_span(spark, sf_dir):
    """Length of the timestamp of every header in the merged document."""
    return (
        named(logs_of(spark, sf_dir).document.where("line_in_entry = 0"))
        .groupBy("file", F.col("timestamp_length").cast("bigint").alias("span"))
        .agg(F.count("*").alias("n_entries"))
    )


# French month spellings, as system logs write them.
FRENCH_MONTHS = [
    "janv.", "févr.", "mars", "avr.", "mai", "juin",
    "juil.", "août", "sept.", "oct.", "nov.", "déc.",
]


@query
def month_names(spark, sf_dir):
    """English upper-case names for even events, French ones for odd events.

    The month is spread over the year, as the events cover a single month.
    """
    fmt = TimestampFormat("apache-common", "dd/MMM/yyyy:HH:mm:ss")
    events = read_table(spark, sf_dir, "events").withColumn(
        "at", F.add_months("ts", (F.col("event_id") % 12).cast("int"))
    )
    number = F.month("at")
    english = F.upper(F.date_format("at", "MMM"))
    french = F.element_at(F.array(*[F.lit(m) for m in FRENCH_MONTHS]), number)
    name = F.when(F.col("event_id") % 2 == 0, english).otherwise(french)
    line = F.concat(
        F.date_format("at", "dd"), F.lit("/"), name, F.date_format("at", "/yyyy"),
        F.date_format("ts", ":HH:mm:ss"), F.lit(" GET"),
    )
    return events.select(
        "event_id", fmt.sort_key(line).alias("sort_key"), fmt.span(line).cast("bigint").alias("span")
    )


@query
def fraction_precision(spark, sf_dir):
    """1 to 12 fraction digits give keys of one width."""
    fmt = TimestampFormat("bracketed", "[yyyy-MM-dd HH:mm:ss.SSS]")
    events = read_table(spark, sf_dir, "events")
    digits = F.concat(F.date_format("ts", "SSSSSS"), F.lit("123456"))
    n = (F.col("event_id") % 12 + 1).cast("int")
    line = F.concat(
        F.date_format("ts", "'['yyyy-MM-dd HH:mm:ss."), F.substring(digits, F.lit(1), n), F.lit("] x")
    )
    return events.select(
        "event_id", fmt.sort_key(line).alias("sort_key"), fmt.span(line).cast("bigint").alias("span")
    )


@query
def level_of_header(spark, sf_dir):
    headers = fixture.event_headers(spark, sf_dir)
    return headers.select("event_id", level_of(F.col("header")).alias("level"))


# ---- formats and entries ----

@query
def detect_format(spark, sf_dir):
    source = read_tree(spark, logs_of(spark, sf_dir).root, include_hidden=False)
    staged = stage(source, BUILT_IN_FORMATS)
    return named(format_report(staged, file_formats(staged))).select("file", "format", "votes", "via")


@query
def detect_format_late(spark, sf_dir):
    """2,500 lines of banner come before the first header of each log."""
    lines = log_lines(spark, sf_dir)
    banner = (
        lines.select("file").distinct()
        .select("file", F.explode(F.sequence(F.lit(1), F.lit(2500))).alias("n"))
        .select("file", (F.col("n") - 10_000).cast("bigint").alias("pos"),
                F.concat(F.lit("banner "), F.col("n")).alias("line"))
    )
    root = write_logs(spark, sf_dir, lines=lines.unionByName(banner))
    staged = stage(read_tree(spark, root, include_hidden=False), BUILT_IN_FORMATS)
    return named(format_report(staged, file_formats(staged))).select("file", "format", "votes", "via")


@query
def format_pinning(spark, sf_dir):
    """All logs in one layout, where every tenth header lacks its fraction and so starts no entry."""
    lines = log_lines(spark, sf_dir, layout=0)
    is_header = F.col("line").rlike("^2024-")
    tenth = F.regexp_extract("line", r"id=(\d+)", 1).cast("bigint") % 10 == 0
    short = F.concat(F.substring("line", 1, 19), F.col("line").substr(F.lit(27), F.length("line")))
    changed = lines.withColumn("line", F.when(is_header & tenth, short).otherwise(F.col("line")))
    root = write_logs(spark, sf_dir, lines=changed)
    document = parse_logs(read_tree(spark, root, include_hidden=False)).document
    return named(entry_table(document.where("entry_no > 0")).join(
        document.where("line_in_entry = 0").select("file", "file_ord", "entry_no"),
        ["file_ord", "entry_no"],
    )).select("file", "entry_no", "sort_key", "n_lines")


@query
def format_report_query(spark, sf_dir):
    return named(logs_of(spark, sf_dir).parse().report()).select("file_ord", "file", "format")


@query
def group_entries(spark, sf_dir):
    entries = entry_table(logs_of(spark, sf_dir).parse().document)
    return entries.select("file_ord", "entry_no", "sort_key", "n_lines")


@query
def preamble_entry(spark, sf_dir):
    document = logs_of(spark, sf_dir).parse().document
    return named(document.where("entry_no = 0")).select(
        "file", "entry_no", "line_in_entry", "sort_key", "line"
    )


@query
def entry_content(spark, sf_dir):
    return entry_contents(logs_of(spark, sf_dir).document).select(
        "file_ord", "entry_no", "n_lines", "part", "content"
    )


@query
def entry_parts(spark, sf_dir):
    """Entries cut into short parts, as very long ones are."""
    return entry_contents(logs_of(spark, sf_dir).document, part_bytes=PART_BYTES).select(
        "file_ord", "entry_no", "n_lines", "part", "content"
    )


# ---- merge ----

@query
def concat_files(spark, sf_dir):
    document = logs_of(spark, sf_dir).document
    doubled = concat_logs(document, document)
    return doubled.groupBy("file_ord").agg(
        F.count("*").alias("n_lines"), F.count_if(F.col("line_in_entry") == 0).alias("n_entries")
    )


@query
def merge_chronological_query(spark, sf_dir):
    document = logs_of(spark, sf_dir).parse().document
    return merge_chronological(document).select(
        "sort_key", "file_ord", "entry_no", "line_in_entry", "line"
    )


@query
def dedup_entries_query(spark, sf_dir):
    document = logs_of(spark, sf_dir).parse(dedup=True).document
    return document.select("sort_key", "file_ord", "entry_no", "line_in_entry", "line")


# ---- filters ----

def _filtered(spark, sf_dir, predicate) -> DataFrame:
    return logs_of(spark, sf_dir).document.where(predicate).select(
        "file_ord", "entry_no", "line_in_entry", "line"
    )


@query
def filter_substring(spark, sf_dir):
    return _filtered(spark, sf_dir, substring_filter(FILTER_WORD))


@query
def filter_expression(spark, sf_dir):
    return _filtered(spark, sf_dir, substring_filter(FILTER_EXPRESSION))


@query
def filter_regexp(spark, sf_dir):
    return _filtered(spark, sf_dir, regexp_filter(FILTER_REGEXP))


@query
def line_counts(spark, sf_dir):
    return search.line_counts(logs_of(spark, sf_dir).document, substring_filter(FILTER_EXPRESSION))


@query
def ascii_lower_query(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", ascii_lower(F.col("text")).alias("lowered"))


@query
def ascii_iequals_query(spark, sf_dir):
    """Each turn's role and text against their upper-case forms; accented letters make the difference."""
    turns = read_table(spark, sf_dir, "conversations")
    shouted = F.translate("role", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return turns.select(
        "conv_id", "turn",
        ascii_iequals(F.col("role"), shouted).alias("same_role"),
        ascii_iequals(F.col("text"), F.upper("text")).alias("same_text"),
    )


@query
def ascii_icontains_query(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select(
        "doc_id",
        ascii_icontains(F.col("text"), "THE").alias("has_word"),
        ascii_icontains(F.col("text"), "É").alias("has_accent"),
        ascii_icontains(F.col("text"), F.col("lang")).alias("has_lang"),
        ascii_icontains(F.col("text"), "").alias("has_empty"),
    )


# ---- find, slice, context ----

@query
def number_lines(spark, sf_dir):
    numbered = search.number_lines(logs_of(spark, sf_dir).parse().document)
    return numbered.select("doc_line_no", "file_ord", "entry_no", "line_in_entry", "line")


@query
def find_from(spark, sf_dir):
    return search.find_from(logs_of(spark, sf_dir).positions, FIND_TERM, FIND_FROM)


@query
def find_next(spark, sf_dir):
    """From the last line on, so that the search wraps around."""
    positions = logs_of(spark, sf_dir).positions
    return search.find_next(positions, FIND_TERM, positions.count() - 1)


@query
def find_previous(spark, sf_dir):
    return search.find_previous(logs_of(spark, sf_dir).positions, FIND_TERM, FIND_FROM)


@query
def find_spans(spark, sf_dir):
    spans = search.find_spans(logs_of(spark, sf_dir).numbered, "ER")
    return spans.select("doc_line_no", F.col("start").cast("bigint"), F.col("length").cast("bigint"))


@query
def slice_lines(spark, sf_dir):
    """Lines 700 to 1200 of the lines that the filter leaves."""
    visible = search.store_lines(logs_of(spark, sf_dir).document, substring_filter(FILTER_WORD))
    return search.slice_lines(visible, 700, 1200).select("doc_line_no", "line")


@query
def tail_lines(spark, sf_dir):
    return search.tail_lines(logs_of(spark, sf_dir).document, 50).select(
        "sort_key", "file_ord", "entry_no", "line_in_entry", "line"
    )


@query
def entry_context(spark, sf_dir):
    context = search.entry_context(logs_of(spark, sf_dir).document, substring_filter("java:17)"))
    return context.select("file_ord", "entry_no", "line_in_entry", "line")


# ---- statistics ----

@query
def visible_headers(spark, sf_dir):
    headers = stats.visible_headers(logs_of(spark, sf_dir).document, substring_filter("handler || props"))
    return headers.select("file_ord", "entry_no", "sort_key", "header")


@query
def level_counts(spark, sf_dir):
    """Levels of all entries of the merged, deduplicated logs."""
    document = logs_of(spark, sf_dir).parse(dedup=True).document
    return stats.level_counts(stats.visible_headers(document))


@query
def level_share(spark, sf_dir):
    headers = stats.visible_headers(
        logs_of(spark, sf_dir).document, substring_filter("main || user=8 || loaded")
    )
    return stats.level_share(stats.level_counts(headers))


# ---- changes ----

@query
def dir_snapshot(spark, sf_dir):
    snapshot = snapshot_tree(spark, logs_of(spark, sf_dir).root, include_hidden=False).files
    return snapshot.select(log_name(F.col("path")).alias("file"), "length")


def _changed_lines(spark: SparkSession, sf_dir: str, later: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """All logs but the last service's, and later all but the first one's with half of service 2's lines; or those of some services."""
    before = log_lines(spark, sf_dir).where("file NOT LIKE 'svc-4%'")
    after = log_lines(spark, sf_dir, services=later).where("file NOT LIKE 'svc-0%' AND NOT (file LIKE 'svc-2%' AND pos % 8 >= 4)")
    return before, after


@query
def snapshot_diff_query(spark, sf_dir):
    """Snapshots of two folders compared by log name and length."""
    before, after = (
        snapshot_tree(spark, write_logs(spark, sf_dir, lines=lines), include_hidden=False)
        .files.select(log_name(F.col("path")).alias("path"), F.lit(0).cast("bigint").alias("mtime_us"), "length")
        for lines in _changed_lines(spark, sf_dir)
    )
    return snapshot_diff(before, after).select(F.col("path").alias("file"), "status")


@query
def check_changes_query(spark, sf_dir):
    """A snapshot compared with itself, with a later one, and with one that could not list its folder."""
    before, after = (
        snapshot_tree(spark, write_logs(spark, sf_dir, lines=lines), include_hidden=False)
        for lines in _changed_lines(spark, sf_dir)
    )
    incomplete = snapshot_tree(spark, scratch_path(spark, "no-such-folder"))
    rows = []
    for case, current in {"same": before, "later": after, "incomplete": incomplete}.items():
        status, baseline = check_snapshots(before, current)
        sums = baseline.files.agg(F.count("*").alias("baseline_files"), F.sum("length").alias("baseline_bytes"))
        rows.append(sums.select(F.lit(case).alias("case_name"), F.lit(status).alias("status"), "*"))
    return reduce(DataFrame.unionByName, rows)


def _refreshed(spark: SparkSession, sf_dir: str) -> LogStore:
    """Logs are added and rewritten after the first merge; only those are parsed again."""
    before, rewritten = _changed_lines(spark, sf_dir, later=[2, 4])
    root = write_logs(spark, sf_dir, lines=before)
    log_store = LogStore(spark, root, scratch_path(spark, "store"), include_hidden=False)
    log_store.refresh()
    _rewrite(spark, rewritten, root)
    log_store.refresh()
    return log_store


@query
def refresh_incremental(spark, sf_dir):
    document = _refreshed(spark, sf_dir).document()
    return named(document).select("file", "entry_no", "line_in_entry", "sort_key", "line")


@query
def refreshed_levels(spark, sf_dir):
    """Level counts of the refreshed store, from the summaries that its generations keep."""
    return _refreshed(spark, sf_dir).level_counts()


def _rewrite(spark: SparkSession, lines: DataFrame, root: str) -> None:
    """Replace the logs that ``lines`` holds and leave the others alone."""
    (
        lines.withColumnRenamed("file", "name")
        .repartition("name").sortWithinPartitions("name", "pos").select("name", "line")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("name").text(root)
    )


@query
def stream_new_files_query(spark, sf_dir):
    """Two runs of the stream. In between logs are added, and a merged log is written into the tree and not read."""
    lines = log_lines(spark, sf_dir)
    late = "file LIKE 'svc-4%' OR file LIKE 'zz-%'"
    root = write_logs(spark, sf_dir, lines=lines.where(f"NOT ({late})"))
    out, checkpoint = scratch_path(spark, "streamed"), scratch_path(spark, "offsets")
    options = {"once": True, "include_hidden": False, "exclude": f"{root}/merged.log"}
    stream_new_files(spark, root, out, checkpoint, **options).awaitTermination()
    merge_directory(spark, root, include_hidden=False)
    _rewrite(spark, lines.where(late), root)
    stream_new_files(spark, root, out, checkpoint, **options).awaitTermination()
    return named(streamed_document(spark, out)).select(
        "file_ord", "file", "entry_no", "line_in_entry", "sort_key", "line"
    )


# Functions named like the operator they call are registered without the suffix.
QUERIES = {name.removesuffix("_query"): run for name, run in QUERIES.items()}
