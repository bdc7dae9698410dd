"""Files that Spark's text source would skip, decode or fail on.

These are names it treats as hidden, suffixes of codecs that should be read as
they are, and ``.gz`` files that are not whole gzip streams. They are read on
the executors in bounded batches; plain ones are cut into byte ranges.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import quote

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from logweave.session import local_table
from logweave.sources import listing
from logweave.sources.listing import LogFile, local_path

# Ship these helpers with the tasks, so that executors need not have the package installed.
cloudpickle.register_pickle_by_value(listing)
cloudpickle.register_pickle_by_value(sys.modules[__name__])

GZIP_STATES = "path string, state string, reason string, n_bytes bigint"
RANGE_BYTES = 128 << 20
#: A task reads files of about so many bytes; opening one counts as some, and gzip files hold more than their length.
TASK_BYTES = 64 << 20
OPEN_BYTES = 1 << 20
GZIP_RATIO = 8
_CHUNK = 1 << 20
_BATCH_LINES = 1 << 15
_BOM = b"\xef\xbb\xbf"  # dropped at the start of a file, as Spark's text reader does


def is_gzip(path: str) -> bool:
    return path[-3:].isascii() and path[-3:].lower() == ".gz"


def dealt(spark: SparkSession, rows: list[tuple], schema: str, weights: list[int]) -> DataFrame:
    """The rows dealt to tasks in order, so that small files share a task and every core has one; a heavy row is alone in its task."""
    weights = [OPEN_BYTES + weight for weight in weights]
    most = min(TASK_BYTES, max(OPEN_BYTES, sum(weights) // max(spark.sparkContext.defaultParallelism, 1)))
    tasks, task, held = [], 0, 0
    for weight in weights:
        if held and held + weight > most:
            task, held = task + 1, 0
        tasks.append(task)
        held += weight
    placed = [(*row, task) for row, task in zip(rows, tasks)]
    return local_table(spark, placed, f"{schema}, task int").repartitionById(task + 1, "task").drop("task")


def open_file(path: str):
    local = local_path(path)
    if local is not None:
        return open(local, "rb")
    from pyarrow import fs

    filesystem, inner = fs.FileSystem.from_uri(path)
    return filesystem.open_input_file(inner)


@lru_cache(maxsize=64)
def _has_client(store: str) -> bool:
    from pyarrow import fs

    try:
        fs.FileSystem.from_uri(store + "/")
    except (pa.ArrowException, OSError):
        return False
    return True


def can_open(path: str) -> bool:
    """Whether these readers have a client for the filesystem of ``path``."""
    scheme, _, rest = path.partition("://")
    return local_path(path) is not None or _has_client(f"{scheme}://{rest.split('/')[0]}")


def _inflate(stream, state: dict) -> Iterator[bytes]:
    """Inflated chunks of a gzip stream with any number of members.

    ``state["end"]`` becomes ``ok``, ``partial`` (cut off, or followed by other
    bytes) or ``plain`` (no gzip header); damaged data raises ``zlib.error``.
    """
    data = stream.read(_CHUNK)
    if data[:2] != b"\x1f\x8b":
        state["end"] = "plain"
        while data:
            yield data
            data = stream.read(_CHUNK)
        return
    member = zlib.decompressobj(wbits=31)
    while True:
        if member.eof:
            data = member.unused_data or stream.read(_CHUNK)
            if len(data) == 1:
                data += stream.read(_CHUNK)
            if data[:2] != b"\x1f\x8b":
                state["end"] = "partial" if data else "ok"
                return
            member = zlib.decompressobj(wbits=31)
        elif not data:
            state["end"] = "partial"
            return
        yield member.decompress(data)
        if not member.eof:
            data = stream.read(_CHUNK)


def gzip_states(spark: SparkSession, files: list[LogFile]) -> DataFrame:
    """Label each gzip file by streaming it once, on the executors."""
    schema = pa.schema([
        ("path", pa.string()), ("state", pa.string()), ("reason", pa.string()), ("n_bytes", pa.int64()),
    ])

    def label(batches):
        for batch in batches:
            rows = []
            for path in batch.column("path").to_pylist():
                end: dict = {}
                try:
                    with open_file(path) as stream:
                        n_bytes = sum(len(chunk) for chunk in _inflate(stream, end))
                    rows.append((path, end["end"], None, n_bytes))
                except FileNotFoundError as error:
                    rows.append((path, "unreadable", f"not readable: {error.strerror}", None))
                except (zlib.error, OSError) as error:
                    rows.append((path, "unreadable", f"damaged content: {error}", None))
            yield pa.RecordBatch.from_pydict(
                {name: [row[i] for row in rows] for i, name in enumerate(schema.names)}, schema=schema
            )

    table = dealt(spark, [(f.path,) for f in files], "path string", [f.length * GZIP_RATIO for f in files])
    return table.mapInArrow(label, GZIP_STATES)


def _lines(chunks: Iterator[bytes]) -> Iterator[bytes]:
    tail = b""
    for chunk in chunks:
        *whole, tail = (tail + chunk).split(b"\n")
        yield from whole
    if tail:
        yield tail


def _range_lines(path: str, start: int, end: int) -> Iterator[bytes]:
    """The lines that begin inside ``[start, end)``."""
    with open_file(path) as stream:
        at = start
        if start > 0:
            stream.seek(start - 1)
            at = start - 1
        skip_first = start > 0

        def chunks():
            while data := stream.read(_CHUNK):
                yield data

        for line in _lines(chunks()):
            if not skip_first:
                if at >= end:
                    return
                yield line.removeprefix(_BOM) if at == 0 else line
            skip_first = False
            at += len(line) + 1


def _gzip_lines(path: str) -> Iterator[bytes]:
    with open_file(path) as stream:
        for number, line in enumerate(_lines(_inflate(stream, {}))):
            yield line.removeprefix(_BOM) if number == 0 else line


def _unless_gone(lines: Iterator[bytes]) -> Iterator[bytes]:
    """Nothing of a file that cannot be opened any more; staging then warns of it."""
    try:
        first = next(lines, None)
    except (FileNotFoundError, PermissionError):
        return
    if first is not None:
        yield first
        yield from lines


def read_raw(spark: SparkSession, plain: list[LogFile], gzipped: list[LogFile]) -> DataFrame:
    """``(file, block_start, value)`` in file order within each block."""
    return read_ranges(spark, [(f.path, 0, f.length, False) for f in plain] + [(f.path, 0, f.length, True) for f in gzipped])


def read_ranges(spark: SparkSession, ranges: list[tuple[str, int, int, bool]]) -> DataFrame:
    """The lines that begin in ``(path, begin, until, gzipped)``; gzip files are read whole.

    ``begin`` must be the start of a line.
    """
    jobs = [
        (path, start, min(start + RANGE_BYTES, until), False)
        for path, begin, until, gzipped in ranges if not gzipped
        for start in range(begin, until, RANGE_BYTES)
    ] + [(path, 0, until, True) for path, _, until, gzipped in ranges if gzipped]
    schema = pa.schema([("file", pa.string()), ("block_start", pa.int64()), ("value", pa.binary())])

    def read(batches):
        for batch in batches:
            for job in batch.to_pylist():
                path, start = job["path"], job["start"]
                source = _gzip_lines(path) if job["gzipped"] else _range_lines(path, start, job["end"])
                pending: list[bytes] = []

                def flush():
                    n = len(pending)
                    return pa.RecordBatch.from_arrays(
                        [pa.array([quote(path, safe="/:")] * n), pa.array([start] * n, pa.int64()),
                         pa.array(pending, pa.binary())],
                        schema=schema,
                    )

                for line in _unless_gone(source):
                    pending.append(line)
                    if len(pending) == _BATCH_LINES:
                        yield flush()
                        pending = []
                if pending:
                    yield flush()

    weights = [(end - start) * (GZIP_RATIO if gzipped else 1) for _, start, end, gzipped in jobs]
    table = dealt(spark, jobs, "path string, start bigint, end bigint, gzipped boolean", weights)
    lines = table.mapInArrow(read, "file string, block_start bigint, value binary")
    return lines.selectExpr("file", "block_start", "CAST(value AS STRING) AS value")
