"""Directory trees listed by the executors, level by level, into stored tables.

No list of files passes through the driver: it only learns how many folders the next level has, and how many
entries could not be looked at. The filesystem must look the same from every executor.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from logweave.session import local_table, store
from logweave.sources import listing
from logweave.sources.listing import Exclusion, entries_of, is_hidden, local_path, qualify

cloudpickle.register_pickle_by_value(listing)
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ENTRIES = "path string, kind string, mtime_us bigint, length bigint"
_FOLDERS_PER_TASK = 64
_MAX_TASKS = 20_000


@dataclass
class TreeSnapshot:
    """``files``: path, mtime_us, length. ``skipped`` counts folders and files that could not be looked at or read."""

    files: DataFrame
    skipped: int


def _remote_entries(folder: str, exclusion: Exclusion, include_hidden: bool) -> Iterator[tuple[str, str, int, int]]:
    try:
        filesystem, base = fs.FileSystem.from_uri(folder)
        found = filesystem.get_file_info(fs.FileSelector(base))
    except (OSError, pa.ArrowException):
        yield folder, "skipped", 0, 0
        return
    prefix = folder.rstrip("/").removesuffix(base.rstrip("/"))
    for info in found:
        path = prefix + info.path
        if exclusion.is_output(path):
            yield path, "output", 0, 0
        elif include_hidden or not is_hidden(info.base_name):
            if info.type == fs.FileType.Directory:
                yield path, "folder", 0, 0
            elif info.type == fs.FileType.File:
                yield path, "file", (info.mtime_ns or 0) // 1000, info.size


def snapshot_tree(spark: SparkSession, root: str, *outputs: str | None, include_hidden: bool = True) -> TreeSnapshot:
    """All regular files under ``root`` but for ``outputs`` and what lies below them."""
    left_out = [qualify(spark, path) for path in outputs if path]
    schema = pa.schema([("path", pa.string()), ("kind", pa.string()), ("mtime_us", pa.int64()), ("length", pa.int64())])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exclusion = Exclusion(None, *left_out)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                local = local_path(folder)
                rows = list(entries_of(local, exclusion, include_hidden) if local else _remote_entries(folder, exclusion, include_hidden))
                columns = zip(*rows) if rows else [[]] * len(schema)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)

    level, n_folders, levels = local_table(spark, [(qualify(spark, root),)], "folder string"), 1, []
    while n_folders:
        tasks = min(-(-n_folders // _FOLDERS_PER_TASK), _MAX_TASKS)
        levels.append(store(level.repartition(tasks).mapInArrow(look, ENTRIES), "tree-level"))
        level = levels[-1].where("kind = 'folder'").select(F.col("path").alias("folder"))
        n_folders = level.count()
    found = levels[0]
    for deeper in levels[1:]:
        found = found.unionByName(deeper)
    skipped = found.where("kind IN ('skipped', 'closed')").count()
    return TreeSnapshot(found.where("kind = 'file'").select("path", "mtime_us", "length"), skipped)
