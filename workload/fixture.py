"""Application logs rendered from the ``events`` table.

Five services log in five timestamp layouts, and a mirror service repeats a part
of the first one's entries. A service starts a new file every ``ROTATE_EVENTS``
events, so that a larger table gives more files rather than larger ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logweave.session import scratch_path

SERVICES = 5
ROTATE_EVENTS = 20_000

# Date layouts by service, for Spark and for DuckDB.
SPARK_LAYOUTS = [
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "dd/MMM/yyyy:HH:mm:ss",
    "EEE MMM dd HH:mm:ss yyyy",
    "MM/dd/yyyy hh:mm:ss a",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
]
DUCKDB_LAYOUTS = [
    "%Y-%m-%d %H:%M:%S.%f",
    "%d/%b/%Y:%H:%M:%S",
    "%a %b %d %H:%M:%S %Y",
    "%m/%d/%Y %I:%M:%S %p",
    "%Y-%m-%dT%H:%M:%S.%f",
]
FORMAT_NAMES = ["logback", "apache-common", "ctime", "us-12h", "iso8601"]

# Text of a header after the timestamp; the same expression runs on both engines.
BODY_SQL = """
    CASE event_type WHEN 'error' THEN ' ERROR' WHEN 'purchase' THEN ' WARNING'
                    WHEN 'click' THEN ' debug' WHEN 'view' THEN ' info' ELSE '' END
    || ' user=' || CAST(user_id AS STRING) || ' id=' || CAST(event_id AS STRING)
    || ' props=' || props
"""


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rendered_timestamp(service: Column) -> Column:
    text = F.date_format("ts", SPARK_LAYOUTS[0])
    for number, layout in enumerate(SPARK_LAYOUTS[1:], start=1):
        text = F.when(service == number, F.date_format("ts", layout)).otherwise(text)
    return text


def event_headers(spark: SparkSession, sf_dir: str, layout: int | None = None) -> DataFrame:
    """``(event_id, service, header)`` for every event, in its service's layout or in the one given."""
    events = read_table(spark, sf_dir, "events").withColumn("service", F.col("user_id") % SERVICES)
    stamp = rendered_timestamp(F.col("service") if layout is None else F.lit(layout))
    return events.select("*", F.concat(stamp, F.expr(BODY_SQL)).alias("header"))


def log_lines(spark: SparkSession, sf_dir: str, layout: int | None = None, services: list[int] | None = None) -> DataFrame:
    """``(file, pos, line)``: the lines of all log files, or of those of some services."""
    events = event_headers(spark, sf_dir, layout).withColumn("segment", F.floor(F.col("event_id") / ROTATE_EVENTS))
    if services is not None:
        events = events.where(F.col("service").isin(services))
    segment = F.lpad(F.col("segment").cast("string"), 6, "0")
    own_name = F.concat(F.lit("svc-"), F.col("service"), F.lit("-"), segment, F.lit(".log")).alias("file")
    own = events.select("*", own_name)
    mirrored = events.where("service = 0 AND event_id % 3 = 0").withColumn(
        "file", F.concat(F.lit("zz-mirror-"), segment, F.lit(".log"))
    )
    start = (F.col("event_id") % 7 * 1_000_000_000 + F.col("event_id")) * 4
    trace = F.when(
        F.col("event_type") == "error",
        F.array(
            F.col("header"),
            F.concat(
                F.lit("\tat svc.Handler.run(Handler.java:"),
                (F.col("event_id") % 100).cast("string"), F.lit(")"),
            ),
            F.lit("\tat svc.Main.main(Main.java:7)"),
        ),
    ).otherwise(F.array("header"))
    entries = own.unionByName(mirrored).select("file", start.alias("start"), F.posexplode(trace).alias("at", "line"))
    banners = events.select("service", "segment").distinct().select(own_name).select(
        "file", F.lit(0).cast("bigint").alias("start"),
        F.posexplode(
            F.array(
                F.concat(F.lit("starting "), F.col("file")),
                F.concat(F.lit("configuration of "), F.col("file"), F.lit(" loaded")),
            )
        ).alias("at", "line"),
    ).withColumn("at", F.col("at") - 2)
    return entries.unionByName(banners).select("file", (F.col("start") + F.col("at")).alias("pos"), "line")


def write_logs(spark: SparkSession, sf_dir: str, compression: str = "none", lines: DataFrame | None = None) -> str:
    """Write the log files, each of bounded size by its own task; returns their folder.

    Spark names the parts itself, so a log is ``name=<file>/part-...``.
    """
    root = scratch_path(spark, "logs")
    lines = log_lines(spark, sf_dir) if lines is None else lines
    (
        lines.withColumnRenamed("file", "name")
        .repartition("name")
        .sortWithinPartitions("name", "pos")
        .select("name", "line")
        .write.partitionBy("name")
        .option("compression", compression)
        .text(root)
    )
    return root


def log_name(path: Column) -> Column:
    return F.regexp_extract(path, "name=([^/]+)/", 1)
