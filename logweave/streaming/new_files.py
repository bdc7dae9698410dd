"""Parse log files as they arrive and grow, with Structured Streaming.

The stream follows a directory tree through the source in ``growth``: new files, hidden names too, lines appended to
known files, and files written anew. Of an appended file only the new bytes are read; how far it had been
parsed (lines, entries, format, the entry that is still open) is kept per file, so its lines get the numbers and
keys that a parse of the whole file would give them.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from logweave.functions.timestamps import TimestampFormat
from logweave.operators.detect import SAMPLE_LINES
from logweave.operators.entries import RESUME_SCHEMA
from logweave.operators.joins import join_groups
from logweave.operators.numbering import with_number
from logweave.plans.merge_plan import parse_logs
from logweave.session import local_table, store
from logweave.sources.listing import WARNING_SCHEMA, qualify
from logweave.sources.logs import decoded_path, read_stretches
from logweave.streaming.growth import GrowthSource

_LINES = (
    "file string, since bigint, entry_no bigint, line_in_entry bigint, sort_key string, "
    "timestamp_length int, line string"
)
_STATE = (
    "path string, file string, gen bigint, since bigint, lines bigint, headers bigint, "
    "fmt_idx int, open_key string, open_line bigint"
)
_UNITS = "path string, file_ord bigint, gen bigint, since bigint, lines_before bigint"
# Names that the scan of the lines takes as hidden.
_WARNINGS, _STATES, _ALL_STATES = "_warnings", "_states", "_all_states"
_ALL_STATES_EVERY = 20


def stream_new_files(
    spark: SparkSession, root: str, out: str, checkpoint: str,
    formats: list[TimestampFormat] | None = None, max_files: int = 1_000,
    once: bool = False, exclude: str | None = None, include_hidden: bool = True,
) -> StreamingQuery:
    """Append the parsed lines that files below ``root`` gain to the folder ``out``.

    A micro-batch owns the folder ``batch=<id>`` and overwrites it when it is run
    again, so a restart neither loses nor repeats lines. A file that cannot be read
    gives a row of ``streamed_warnings`` and the stream goes on. ``exclude`` names the
    output of an earlier run, a file or a folder, whether written yet or not; what the stream itself writes is left
    out too. With ``once`` the query stops after what is there now. At most ``max_files`` files are parsed together.
    """
    spark.dataSource.register(GrowthSource)
    outputs = [qualify(spark, path) for path in (exclude, out, checkpoint) if path]
    gains = (
        spark.readStream.format(GrowthSource.name())
        .option("root", qualify(spark, root))
        .option("ledger", qualify(spark, checkpoint.rstrip("/") + "/growth"))
        .option("outputs", json.dumps(outputs))
        .option("includeHidden", str(include_hidden).lower())
        .option("settled", str(once).lower())
        .option("maxFiles", 0 if once else max_files)
        .load()
    )

    def append(batch: DataFrame, batch_id: int) -> None:
        states = _states(spark, out, batch_id)
        parts = -(-batch.count() // max_files)
        known = []
        for part in range(max(parts, 1)):
            mode = "append" if part else "overwrite"
            own = batch.where(F.pmod(F.xxhash64("path"), F.lit(max(parts, 1))) == part)
            known.append(_append(spark, own, states, out, batch_id, formats, mode))
        _write_states(spark, reduce(DataFrame.unionByName, known), out, batch_id)
        if batch_id % _ALL_STATES_EVERY == _ALL_STATES_EVERY - 1:
            _states(spark, out, batch_id + 1).write.mode("overwrite").parquet(f"{out}/{_ALL_STATES}/batch={batch_id}")

    writer = gains.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _append(
    spark: SparkSession, gains: DataFrame, states: DataFrame, out: str, batch_id: int,
    formats: list[TimestampFormat] | None, mode: str,
) -> DataFrame:
    """Parse some files' new lines and write them; returns the files with their formats."""
    # As many rows as files are parsed together. Of two stretches of one file, the batch holds both.
    stretches = gains.groupBy("path").agg(
        F.max("gen").alias("gen"), F.min_by("begin", F.struct(-F.col("gen"), "begin")).alias("begin"),
        F.max_by("until", F.struct("gen", "until")).alias("until"),
    )
    told = states.drop("file").withColumnRenamed("gen", "told_gen")
    rows = sorted(stretches.join(told, "path", "left").collect(), key=lambda r: r.path.encode(errors="surrogateescape"))
    ranges, units, resume = [], [], []
    for place, row in enumerate(rows):
        # Until the vote is over, a file is parsed from its start each time it grows.
        goes_on = row.begin > 0 and row.told_gen == row.gen and row.lines >= SAMPLE_LINES
        ranges.append((row.path, row.begin if goes_on else 0, row.until))
        units.append((row.path, place, row.gen, row.since if goes_on else batch_id, row.lines if goes_on else 0))
        if goes_on:
            resume.append((place, row.lines, row.headers, row.fmt_idx, row.open_key, row.open_line))
    parsed = parse_logs(read_stretches(spark, ranges), formats, resume=local_table(spark, resume, RESUME_SCHEMA))
    known = F.broadcast(local_table(spark, units, _UNITS))
    document = parsed.document.join(known.select("file_ord", "since"), "file_ord")
    document.select(*[name.split()[0] for name in _LINES.split(", ")]).write.mode(mode).parquet(f"{out}/batch={batch_id}")
    parsed.warnings().write.mode(mode).parquet(f"{out}/{_WARNINGS}/batch={batch_id}")

    found = known.join(parsed.formats_by_file.select("file_ord", "fmt_idx"), "file_ord", "left")
    return store(found.drop("file_ord"), "stream-files")


def _write_states(spark: SparkSession, known: DataFrame, out: str, batch_id: int) -> None:
    """The end of each file of a batch from what was written of it, without its text and without parsing it again."""
    ends = spark.read.schema(_LINES).parquet(f"{out}/batch={batch_id}").groupBy("file").agg(
        F.count("*").alias("n"), F.max("entry_no").alias("headers"),
        F.max(F.struct("entry_no", "line_in_entry", "sort_key")).alias("last"),
    ).withColumn("path", decoded_path(F.col("file")))
    lines = F.col("lines_before") + F.col("n")
    state = known.join(ends, "path", "left").select(
        "path", "file", "gen", "since",
        F.coalesce(lines, F.lit(0)).alias("lines"),  # a file that gave nothing is read from its start when it changes
        F.coalesce("headers", F.lit(0)).alias("headers"), "fmt_idx", F.col("last.sort_key").alias("open_key"),
        (lines - 1 - F.col("last.line_in_entry")).alias("open_line"),
    )
    state.write.mode("overwrite").parquet(f"{out}/{_STATES}/batch={batch_id}")


def _states(spark: SparkSession, out: str, before: int | None = None) -> DataFrame:
    """The state of each file after the batches before ``before``, or after all."""
    def read(folder: str) -> DataFrame:
        hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/{folder}")
        if not hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path):
            return local_table(spark, [], _STATE + ", batch bigint")
        rows = spark.read.schema(_STATE + ", batch bigint").parquet(f"{out}/{folder}")
        return rows if before is None else rows.where(F.col("batch") < before)

    whole, single = read(_ALL_STATES), read(_STATES)
    start = whole.agg(F.max("batch")).first()[0]
    if start is not None:
        single = whole.where(F.col("batch") == start).unionByName(single.where(F.col("batch") > start))
    state = F.struct(*[name.split()[0] for name in _STATE.split(", ")[1:]])
    return single.groupBy("path").agg(F.max_by(state, F.col("batch")).alias("s")).select("path", "s.*")


def streamed_warnings(spark: SparkSession, out: str) -> DataFrame:
    """Files that the stream could not read, and why."""
    return spark.read.schema(WARNING_SCHEMA).parquet(f"{out}/{_WARNINGS}").select("path", "reason")


def streamed_document(spark: SparkSession, out: str) -> DataFrame:
    """The lines gathered so far, with files in path order; of a file that started again, the later ones."""
    lines = spark.read.schema(_LINES).parquet(out)
    files = _states(spark, out).where("lines > 0").select("file", "since", F.col("lines").alias("n"))
    numbered = with_number(files, ["file"], "file_ord")
    return join_groups(lines, numbered, ["file", "since"], weight="n").drop("since", "batch")
