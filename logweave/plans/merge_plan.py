"""From files to one merged document, and to text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from logweave.functions.timestamps import TimestampFormat
from logweave.operators.detect import file_formats, format_report
from logweave.operators.entries import build_document
from logweave.operators.merge import dedup_entries, with_line_hashes
from logweave.operators.sinks import write_merged
from logweave.operators.staging import RUN_BITS, StagedLines, stage
from logweave.session import store
from logweave.sources.catalog import BUILT_IN_FORMATS
from logweave.sources.logs import LogSource, read_files, read_merged, read_tree


@dataclass
class ParsedLogs:
    """``document``: one row per line; ``formats_by_file``: the detected formats."""

    document: DataFrame
    staged: StagedLines
    formats_by_file: DataFrame
    source: LogSource

    def report(self) -> DataFrame:
        return format_report(self.staged, self.formats_by_file)

    def warnings(self) -> DataFrame:
        """Every input that gave no lines although it should have, with the reason."""
        return self.source.warnings().unionByName(self.staged.unread())


def parse_logs(
    source: LogSource, formats: list[TimestampFormat] | None = None,
    dedup: bool = False, run_bits: int = RUN_BITS, resume: DataFrame | None = None,
) -> ParsedLogs:
    """``resume``: rows of ``RESUME_SCHEMA`` for files of which ``source`` holds only the lines that came later."""
    staged = stage(source, formats or BUILT_IN_FORMATS, run_bits)
    formats_by_file = file_formats(staged, resume=resume)
    document = build_document(staged, formats_by_file, resume)
    if dedup:
        document = dedup_entries(store(with_line_hashes(document), "document"))
    return ParsedLogs(document, staged, formats_by_file, source)


def merge_files(spark: SparkSession, paths: list[str], output: str | None = None, **options) -> ParsedLogs:
    """Merge the given files; with ``output``, also write the merged log."""
    parsed = parse_logs(read_files(spark, paths), **options)
    if output:
        write_merged(parsed.document, output)
    return parsed


def merge_directory(
    spark: SparkSession, root: str, output: str | None = None,
    include_hidden: bool = True, write: bool = True, **options,
) -> ParsedLogs:
    """Merge a directory tree into ``output``, by default ``merged.log`` inside it.

    The output of an earlier run is not read.
    """
    output = output or root.rstrip("/") + "/merged.log"
    parsed = parse_logs(read_tree(spark, root, exclude=output, include_hidden=include_hidden), **options)
    if write:
        write_merged(parsed.document, output)
    return parsed


def reread_merged(spark: SparkSession, path: str, **options) -> ParsedLogs:
    """Parse, sort and optionally deduplicate a merged log again."""
    return parse_logs(read_merged(spark, path), **options)
