"""The logs that the queries run on, prepared once per session and data folder."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from logweave.operators.numbering import NumberedStore
from logweave.operators.search import NUMBER, store_lines
from logweave.plans.merge_plan import ParsedLogs, parse_logs
from logweave.session import store
from logweave.sources.logs import read_tree
from workload.fixture import log_name, write_logs


RUN_BITS = 9


@dataclass(eq=False)
class Logs:
    spark: SparkSession
    sf_dir: str

    @cached_property
    def root(self) -> str:
        return write_logs(self.spark, self.sf_dir)

    @cached_property
    def parsed(self) -> ParsedLogs:
        """The merged document as a viewer would hold it, parsed once."""
        parsed = self.parse()
        parsed.document = store(parsed.document, "document")
        return parsed

    @cached_property
    def positions(self) -> NumberedStore:
        return store_lines(self.parsed.document)

    @property
    def numbered(self) -> DataFrame:
        return self.positions.rows(NUMBER)

    @property
    def document(self) -> DataFrame:
        return self.parsed.document

    def parse(self, **options) -> ParsedLogs:
        """Parsed in short runs, so that every log has several."""
        options = {"run_bits": RUN_BITS, **options}
        return parse_logs(read_tree(self.spark, self.root, include_hidden=False), **options)


_PREPARED: dict[tuple[str, str], Logs] = {}


def logs_of(spark: SparkSession, sf_dir: str) -> Logs:
    key = (spark.sparkContext.applicationId, sf_dir)
    return _PREPARED.setdefault(key, Logs(spark, sf_dir))


def forget() -> None:
    """Drop what was prepared, so that the next query starts from the tables."""
    _PREPARED.clear()


def named(df: DataFrame) -> DataFrame:
    """Show a log by its name instead of its full path."""
    return df.withColumn("file", log_name(F.col("file")))
