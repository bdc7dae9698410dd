"""The catalog of timestamp formats: built-in, or from a JSON file."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from logweave.functions.timestamps import TimestampFormat
from logweave.session import local_table
from logweave.sources.listing import escape_glob

# The built-in formats, in the order in which lines vote for them.
BUILT_IN_FORMATS = [
    TimestampFormat("logback", "yyyy-MM-dd HH:mm:ss.SSS"),
    TimestampFormat("logback-iso", "yyyy-MM-ddTHH:mm:ss,SSS"),
    TimestampFormat("logback-comma", "yyyy-MM-dd HH:mm:ss,SSS"),
    TimestampFormat("iso8601", "yyyy-MM-ddTHH:mm:ss.SSS"),
    TimestampFormat("iso8601-nofrac", "yyyy-MM-ddTHH:mm:ss"),
    TimestampFormat("apache", "dd/MMM/yyyy:HH:mm:ss.SSS"),
    TimestampFormat("apache-common", "dd/MMM/yyyy:HH:mm:ss"),
    TimestampFormat("nginx", "yyyy/MM/dd HH:mm:ss"),
    TimestampFormat("plain", "yyyy-MM-dd HH:mm:ss"),
    TimestampFormat("vmtoolsd", "[MMM dd HH:mm:ss.SSS]"),
    TimestampFormat("syslog", "MMM dd HH:mm:ss"),
    TimestampFormat("redis", "dd MMM yyyy HH:mm:ss.SSS"),
    TimestampFormat("oracle", "dd-MMM-yyyy HH:mm:ss"),
    TimestampFormat("ctime", "EEE MMM dd HH:mm:ss yyyy"),
    TimestampFormat("http-date", "EEE, dd MMM yyyy HH:mm:ss"),
    TimestampFormat("us-12h", "MM/dd/yyyy hh:mm:ss a"),
]


@dataclass
class FormatCatalog:
    formats: list[TimestampFormat]
    warnings: list[str] = field(default_factory=list)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, f.name, f.pattern) for i, f in enumerate(self.formats)]
        return local_table(spark, rows, "fmt_idx int, name string, pattern string")


def load_catalog(spark: SparkSession, path: str | None = None) -> FormatCatalog:
    """Formats from a JSON array of ``{"name", "pattern"}``.

    A missing, unreadable, invalid or empty file, or one with a bad entry, gives
    the built-in formats and a warning.
    """
    if path is None:
        return FormatCatalog(list(BUILT_IN_FORMATS))
    try:
        # A small settings file, read through Spark so that it may lie on any filesystem.
        text = spark.read.text(escape_glob(path), wholetext=True).first()
        entries, _ = json.JSONDecoder().raw_decode(text.value.lstrip() if text else "")
        formats = [_entry(entry) for entry in entries]
        reason = "it defines no timestamp formats"
    except (PySparkException, Py4JJavaError, ValueError, TypeError) as error:
        formats = []
        reason = str(error).splitlines()[0]
    if formats:
        return FormatCatalog(formats)
    warning = f"{path} is not used as a catalog ({reason}); the default formats apply"
    return FormatCatalog(list(BUILT_IN_FORMATS), [warning])


def _entry(entry) -> TimestampFormat:
    if not isinstance(entry, dict) or not all(isinstance(entry.get(k), str) for k in ("name", "pattern")):
        raise ValueError("an entry lacks its name or pattern")
    return TimestampFormat(entry["name"], entry["pattern"])
