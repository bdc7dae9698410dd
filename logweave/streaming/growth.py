"""A streaming source of what log files gain: new files, appended bytes, and files written anew.

Spark's file source hands over a name once and skips hidden names. This one compares listings: it knows up to which
byte each file has been handed over, and gives ``(path, mtime_us, begin, until, gen)`` for each stretch of whole lines that came since.
A file that shrank, or changed in what was already handed over, starts again at byte 0 with the next ``gen``.

What is known of the files is kept in a *ledger* folder beside the checkpoint: one Parquet file per planned
version with the files that changed, and now and then one with all of them. An offset is just a version number, so a
restart plans nothing twice and the checkpoint stays small, whatever the number of files. Tasks read the stretches of a
version from its file; they do not pass through the offset log.
"""

from __future__ import annotations

import json
import sys
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import astuple, dataclass, fields, replace

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from logweave.sources import listing, rawfiles
from logweave.sources.listing import Exclusion, Listing, LogFile, is_hidden, local_path, walk_local
from logweave.sources.rawfiles import is_gzip, open_file

cloudpickle.register_pickle_by_value(listing)
cloudpickle.register_pickle_by_value(rawfiles)
cloudpickle.register_pickle_by_value(sys.modules[__name__])

UNITS = "path string, mtime_us bigint, begin bigint, until bigint, gen bigint"
#: Bytes before the end of what was handed over that must still be there when a file has grown.
MARK_BYTES = 256
FULL_EVERY = 50
_TAIL = 1 << 16
_READERS = 32
_UNITS_PER_TASK = 1_000


@dataclass(frozen=True)
class Known:
    """A file as last listed, the stretch planned then (none if empty), and how to recognise its end.

    ``rest``: the stretch ended with a line that had no newline yet.
    """

    path: str
    mtime_us: int
    length: int
    begin: int
    until: int
    gen: int
    rest: bool
    mark: int


_SCHEMA = pa.schema([
    ("path", pa.string()), *((name, pa.int64()) for name in ("mtime_us", "length", "begin", "until", "gen")),
    ("rest", pa.bool_()), ("mark", pa.int64()),
])


def _last_line_end(path: str, begin: int, length: int) -> int:
    """The place after the last newline in ``[begin, length)``, or ``begin``."""
    with open_file(path) as stream:
        end = length
        while end > begin:
            start = max(begin, end - _TAIL)
            stream.seek(start)
            found = stream.read(end - start).rfind(b"\n")
            if found >= 0:
                return start + found + 1
            end = start
    return begin


def _mark(path: str, until: int) -> int:
    with open_file(path) as stream:
        stream.seek(max(0, until - MARK_BYTES))
        return zlib.crc32(stream.read(min(until, MARK_BYTES)))


def plan(file: LogFile, known: Known | None, settled: bool) -> Known | None:
    """What to hand over of a listed file; None if it is as it was.

    A last line without a newline waits until the file stays as it is for one listing, or is
    ``settled``. If it is continued after that, the file starts again.
    """
    same = known is not None and (known.mtime_us, known.length) == (file.mtime_us, file.length)
    if same and known.until == known.length:
        return None
    try:
        if is_gzip(file.path):
            return None if same else Known(file.path, file.mtime_us, file.length, 0, file.length, known.gen + 1 if known else 0, False, 0)
        begin, gen = 0, 0
        if known is not None:
            grown = same or file.length > known.length and not known.rest
            goes_on = grown and _mark(file.path, known.until) == known.mark
            begin, gen = (known.until, known.gen) if goes_on else (0, known.gen + 1)
        whole = settled or same
        until = file.length if whole else _last_line_end(file.path, begin, file.length)
        rest = whole and _last_line_end(file.path, max(begin, file.length - 1), file.length) != file.length
        return Known(file.path, file.mtime_us, file.length, begin, until, gen, rest, _mark(file.path, until))
    except OSError:  # closed to us or gone: its reader will warn, and it is planned again when it changes
        return Known(file.path, file.mtime_us, file.length, 0, file.length, known.gen + 1 if known else 0, True, 0)


def _list_client(root: str, exclusion: Exclusion, include_hidden: bool) -> Listing:
    """A tree listed by the filesystem's Arrow client."""
    filesystem, base = fs.FileSystem.from_uri(root)
    prefix = root.removesuffix(base)
    found = Listing()
    for info in filesystem.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)):
        path = prefix + info.path
        shown = include_hidden or not any(is_hidden(part) for part in info.path[len(base):].split("/"))
        if info.type == fs.FileType.File and shown and not exclusion.matches(path):
            found.files.append(LogFile(path, (info.mtime_ns or 0) // 1000, info.size))
    return found


class Ledger:
    """What was planned, by version, in a folder that driver and executors share."""

    def __init__(self, folder: str):
        local = local_path(folder) or (folder if folder.startswith("/") else None)
        self._fs, self._folder = (fs.LocalFileSystem(), local) if local else fs.FileSystem.from_uri(folder)
        self._fs.create_dir(self._folder, recursive=True)

    def path(self, kind: str, version: int) -> str:
        return f"{self._folder}/{kind}-{version:012d}.parquet"

    def _versions(self, kind: str) -> list[int]:
        names = (info.base_name for info in self._fs.get_file_info(fs.FileSelector(self._folder)))
        return sorted(int(name[len(kind) + 1:-8]) for name in names if name.startswith(kind + "-"))

    def write(self, kind: str, version: int, rows: list[Known]) -> None:
        columns = zip(*(astuple(row) for row in rows)) if rows else [()] * len(_SCHEMA)
        table = pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)
        draft = f"{self._folder}/.{kind}-{version:012d}"
        pq.write_table(table, draft, filesystem=self._fs)
        self._fs.move(draft, self.path(kind, version))

    def read(self, kind: str, version: int) -> pa.Table:
        return pq.read_table(self.path(kind, version), filesystem=self._fs)

    def known(self) -> tuple[dict[str, Known], int]:
        """All files as last planned, and the last version."""
        deltas, fulls = self._versions("delta"), self._versions("full")
        start = fulls[-1] if fulls else -1
        parts = [self.read("full", start)] if fulls else []
        parts += [self.read("delta", v) for v in deltas if v > start]
        rows = (Known(*row) for part in parts for row in zip(*(part.column(f.name).to_pylist() for f in fields(Known))))
        return {row.path: row for row in rows}, max([start, *deltas])

    def forget(self, version: int) -> None:
        """Remove what a complete table of an earlier or this version has replaced."""
        fulls = [v for v in self._versions("full") if v <= version]
        for kind in ("delta", "full"):
            for v in self._versions(kind):
                if fulls and (v < fulls[-1] or kind == "delta" and v == fulls[-1]):
                    self._fs.delete_file(self.path(kind, v))


@dataclass
class _Rows(InputPartition):
    version: int
    first: int
    n: int


class GrowthReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self._root = options["root"].rstrip("/")
        self._outputs = json.loads(options.get("outputs", "[]"))
        self._hidden = options.get("includehidden", "true") == "true"
        self._settled = options.get("settled", "false") == "true"
        self._at_most = int(options.get("maxfiles", "0")) or sys.maxsize
        self._folder = options["ledger"]
        self._known: dict[str, Known] | None = None
        self._version = -1

    def initialOffset(self) -> dict:
        return {"version": -1}

    def _listed(self) -> list[LogFile]:
        exclusion = Exclusion(None, *self._outputs)
        local = local_path(self._root)
        found = walk_local(local, exclusion, self._hidden) if local else _list_client(self._root, exclusion, self._hidden)
        return sorted(found.files, key=lambda f: f.path.encode(errors="surrogateescape"))

    def latestOffset(self) -> dict:
        ledger = Ledger(self._folder)
        if self._known is None:
            self._known, self._version = ledger.known()
        changes: list[Known] = []
        with ThreadPoolExecutor(_READERS) as pool:
            listed, at = self._listed(), 0
            while at < len(listed) and len(changes) < self._at_most:
                some = listed[at:at + min(self._at_most, 10_000)]
                at += len(some)
                changes += [p for p in pool.map(lambda f: plan(f, self._known.get(f.path), self._settled), some) if p]
        changes = changes[:self._at_most]
        if changes:
            self._version += 1
            ledger.write("delta", self._version, changes)
            self._known |= {change.path: change for change in changes}
            if self._version % FULL_EVERY == FULL_EVERY - 1:
                ledger.write("full", self._version, [replace(k, begin=k.until) for k in self._known.values()])
        return {"version": self._version}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        ledger, out = Ledger(self._folder), []
        for version in range(start["version"] + 1, end["version"] + 1):
            n = pq.read_metadata(ledger.path("delta", version), filesystem=ledger._fs).num_rows
            out += [_Rows(version, first, min(_UNITS_PER_TASK, n - first)) for first in range(0, n, _UNITS_PER_TASK)]
        return out

    def read(self, partition: _Rows) -> Iterator[pa.RecordBatch]:
        rows = Ledger(self._folder).read("delta", partition.version).slice(partition.first, partition.n)
        rows = rows.filter(pa.compute.greater(rows["until"], rows["begin"]))
        yield from rows.select(["path", "mtime_us", "begin", "until", "gen"]).combine_chunks().to_batches()

    def commit(self, end: dict) -> None:
        Ledger(self._folder).forget(end["version"])


class GrowthSource(DataSource):
    """Options: root, ledger, outputs (a JSON list), includeHidden, settled, maxFiles (a version; 0: no limit)."""

    @classmethod
    def name(cls) -> str:
        return "log_growth"

    def schema(self) -> str:
        return UNITS

    def streamReader(self, schema) -> GrowthReader:
        return GrowthReader(self.options)
