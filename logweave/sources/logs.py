"""Log files as a DataFrame of lines."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logweave.session import local_table
from logweave.sources.listing import (
    WARNING_SCHEMA, Listing, LogFile, escape_glob, is_hidden, list_paths, list_tree,
)
from logweave.sources.rawfiles import can_open, gzip_states, is_gzip, read_ranges, read_raw

# Suffixes Spark's text source would decode, other than .gz.
_OTHER_CODECS = (".bz2", ".deflate", ".lz4", ".snappy", ".zst")

# Spark lists many folders with a task for each, up to this setting; a task takes longer to start than a folder to list.
_LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
_TASKS_PER_CORE = 4

UNIT_SCHEMA = "path string, file string, file_ord bigint, base bigint, filled boolean, length bigint"


@dataclass
class LogSource:
    """Lines and the table that orders their files.

    ``lines``: ``file`` (as the scan spells it), ``block_start``, ``line``, and ``n_bytes`` that the line took without its
    newline; rows of one block come in file order within their partition.
    ``units``: path -> the log it belongs to, its place in the merge, the byte
    offset of this path inside that log, whether it must give lines, and how many bytes they must
    take (NULL if that is not known before, as for compressed files).
    """

    lines: DataFrame
    units: DataFrame
    problems: list[tuple[str, str]] = field(default_factory=list)

    def warnings(self) -> DataFrame:
        """Files left out so far; ``ParsedLogs.warnings`` adds those that the scan did not find."""
        return local_table(self.lines.sparkSession, self.problems, WARNING_SCHEMA)


def strip_cr(value: Column) -> Column:
    """Drop one trailing carriage return."""
    return F.when(value.endswith("\r"), value.substr(F.lit(1), F.length(value) - 1)).otherwise(value)


def _counted(lines: DataFrame) -> DataFrame:
    line = strip_cr(F.col("value")).alias("line")
    return lines.select("file", "block_start", line, F.octet_length("value").alias("n_bytes"))


def decoded_path(file: Column) -> Column:
    """The plain path behind the percent-encoded one a scan reports."""
    return F.url_decode(F.replace(file, F.lit("+"), F.lit("%2B")))


def _hidden_from_scan(path: str) -> bool:
    name = os.path.basename(path)
    return is_hidden(name) or name.endswith("._COPYING_")


def _read_by_hand(path: str) -> bool:
    return _hidden_from_scan(path) or path.endswith(_OTHER_CODECS)


def _text(spark: SparkSession, paths: list[str], counted: bool, recursive: bool = False) -> DataFrame:
    # Only "\n" ends a line: the default would also split at a lone "\r". A file that is gone when
    # the scan runs does not end the job, nor does one that was cut short, if it is known how many bytes its lines must
    # take; staging reports both.
    reader = (
        spark.read.option("lineSep", "\n")
        .option("ignoreMissingFiles", True)
        .option("ignoreCorruptFiles", counted)
        .option("recursiveFileLookup", recursive)
    )
    most = spark.conf.get(_LISTING_TASKS)
    spark.conf.set(_LISTING_TASKS, str(min(int(most), _TASKS_PER_CORE * spark.sparkContext.defaultParallelism)))
    try:
        lines = reader.text([escape_glob(p) for p in paths])  # lists at once
    finally:
        spark.conf.set(_LISTING_TASKS, most)
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block_start"),
        "value",
    )


def _encoded_path(spark: SparkSession, path: str) -> str:
    return spark._jvm.org.apache.hadoop.fs.Path(path).toUri().toString()


def _native(
    spark: SparkSession, paths: list[str], root: str | None, unwanted: list[str], folders: list[str], counted: bool
) -> DataFrame:
    """The files that Spark reads itself.

    The files of one tree are listed by Spark, in parallel, instead of being
    checked path by path; conditions on the file path prune the listing.
    """
    if root is None:
        return _text(spark, paths, counted)
    lines = _text(spark, [root], counted, recursive=True)
    for path in folders:
        lines = lines.where(~F.col("file").startswith(_encoded_path(spark, path) + "/"))
    encoded = [_encoded_path(spark, path) for path in unwanted]
    return lines.where(~F.col("file").isin(encoded)) if encoded else lines


def _empty(spark: SparkSession) -> DataFrame:
    return local_table(spark, [], "file string, block_start bigint, value string")


def read_lines(
    spark: SparkSession, files: list[LogFile], check_gzip: bool = True, tree: Listing | None = None
) -> LogSource:
    """Lines of ``files``, merged in the given order; a repeated file counts repeatedly.

    ``tree`` is the listing they come from, if they are all of a directory tree.

    With ``check_gzip`` every gzip file is streamed once beforehand, so that a
    damaged one is left out with a warning instead of failing the scan.
    """
    distinct = list({f.path: f for f in files}.values())
    gzip = [f for f in distinct if is_gzip(f.path)]
    plain_raw = [f for f in distinct if not is_gzip(f.path) and _read_by_hand(f.path)]
    gzip_raw: list[LogFile] = []
    problems: list[tuple[str, str]] = []
    inflated: dict[str, int] = {}
    filled = {f.path: f.length > 0 for f in distinct if not is_gzip(f.path)}
    if gzip and check_gzip:
        states = {r.path: r for r in gzip_states(spark, gzip).collect()}
        problems = [(f.path, states[f.path].reason) for f in gzip if states[f.path].state == "unreadable"]
        inflated = {f.path: states[f.path].n_bytes for f in gzip}
        filled |= {path: bool(n) for path, n in inflated.items()}
        plain_raw += [f for f in gzip if states[f.path].state == "plain"]
        gzip_raw = [
            f for f in gzip
            if states[f.path].state == "partial"
            or (states[f.path].state == "ok" and _read_by_hand(f.path))
        ]
    else:
        gzip_raw = [f for f in gzip if _read_by_hand(f.path)]
    unreachable = [f for f in plain_raw + gzip_raw if not can_open(f.path)]
    reason = "not readable: a name that Spark skips, on a filesystem that only Spark reads"
    problems += [(f.path, reason) for f in unreachable]
    left_out = {path for path, _ in problems}
    plain_raw = [f for f in plain_raw if f.path not in left_out]
    gzip_raw = [f for f in gzip_raw if f.path not in left_out]
    by_hand = {f.path for f in plain_raw + gzip_raw}
    native = [f.path for f in distinct if f.path not in by_hand and f.path not in left_out]

    root = tree.root if tree else None
    seen_by_scan = [p for p in [*by_hand, *left_out] if not _hidden_from_scan(p)]
    unwanted = [*(tree.left_out if tree else []), *seen_by_scan]
    folders = tree.left_out_folders if tree else []
    counted = check_gzip or not gzip
    parts = [_native(spark, native, root, unwanted, folders, counted)] if native else []
    if by_hand:
        parts.append(read_raw(spark, plain_raw, gzip_raw))
    lines = parts[0] if parts else _empty(spark)
    for part in parts[1:]:
        lines = lines.unionByName(part)
    kept = [f.path for f in files if f.path not in left_out]
    lengths = {f.path: f.length for f in distinct if not is_gzip(f.path)} | inflated
    units = local_table(
        spark,
        [(path, path, position, 0, filled.get(path, False), lengths.get(path)) for position, path in enumerate(kept)],
        UNIT_SCHEMA,
    )
    return LogSource(_counted(lines), units, problems)


def read_stretches(spark: SparkSession, stretches: list[tuple[str, int, int]]) -> LogSource:
    """The lines that begin in the byte ranges ``(path, begin, until)``, one for each file; gzip files are read whole."""
    gzip = [LogFile(path, 0, until) for path, _, until in stretches if is_gzip(path)]
    states = {r.path: r for r in gzip_states(spark, gzip).collect()} if gzip else {}
    bad = {path: r.reason for path, r in states.items() if r.state == "unreadable"}
    ranges = [(path, begin, until, path in states and states[path].state != "plain") for path, begin, until in stretches if path not in bad]
    units = [
        (path, path, place, 0, bool(states[path].n_bytes) if path in states else until > begin, None if path in states else until - begin)
        for place, (path, begin, until) in enumerate(stretches) if path not in bad
    ]
    return LogSource(_counted(read_ranges(spark, ranges)), local_table(spark, units, UNIT_SCHEMA), list(bad.items()))


def read_files(spark: SparkSession, paths: list[str], check_gzip: bool = True) -> LogSource:
    """Several log files in the given order; unusable ones are left out with a warning."""
    listing, problems = list_paths(spark, paths)
    source = read_lines(spark, listing.files, check_gzip)
    source.problems = problems + source.problems
    return source


def read_tree(
    spark: SparkSession, root: str, exclude: str | None = None,
    include_hidden: bool = True, check_gzip: bool = True,
) -> LogSource:
    """Every file of a directory tree, in path order, but for the output in ``exclude``."""
    listing = list_tree(spark, root, exclude, include_hidden)
    source = read_lines(spark, listing.files, check_gzip, tree=listing)
    source.problems = listing.problems(root) + source.problems
    return source


def read_merged(spark: SparkSession, path: str) -> LogSource:
    """A merged log written earlier: one file, or a folder whose parts form one log.

    An entry may run from one part into the next, so the parts keep their place
    in a single log instead of being merged as separate files.
    """
    as_file, problems = list_paths(spark, [path])
    if as_file.files:
        return read_lines(spark, as_file.files)
    parts = list_tree(spark, path, include_hidden=False).files
    if not parts:
        raise FileNotFoundError(problems[0][0])
    source = read_lines(spark, parts)
    bases, base = [], 0
    for part in parts:
        zipped = is_gzip(part.path)
        bases.append((part.path, problems[0][0], 0, base, part.length > 0 and not zipped, None if zipped else part.length))
        base += part.length
    source.units = local_table(spark, bases, UNIT_SCHEMA)
    return source
