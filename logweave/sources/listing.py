"""Which files to read: given paths, directory trees, exclusions and snapshots."""

from __future__ import annotations

import os
import re
import stat as stat_module
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from logweave.session import local_table

SNAPSHOT_SCHEMA = "path string, mtime_us bigint, length bigint"
WARNING_SCHEMA = "path string, reason string"

_LISTERS = 32  # folders of a remote tree that are listed at a time


@dataclass(frozen=True)
class LogFile:
    path: str
    mtime_us: int
    length: int


@dataclass
class Listing:
    """Files in merge order. ``skipped`` counts what could not be listed.

    ``root`` is the folder a recursive scan may read instead of the single files,
    without the paths in ``left_out`` and those below ``left_out_folders``; it is None
    if that would find other files.
    """

    files: list[LogFile] = field(default_factory=list)
    skipped: int = 0
    root: str | None = None
    left_out: list[str] = field(default_factory=list)
    left_out_folders: list[str] = field(default_factory=list)

    def snapshot(self, spark: SparkSession) -> DataFrame:
        rows = [(f.path, f.mtime_us, f.length) for f in self.files]
        return local_table(spark, rows, SNAPSHOT_SCHEMA)

    def problems(self, root: str) -> list[tuple[str, str]]:
        reason = f"{self.skipped} directories or files could not be read and were skipped"
        return [(root, reason)] if self.skipped else []


def local_path(path: str) -> str | None:
    """The local file name behind ``path``, or None on another filesystem."""
    if path.startswith("file:"):
        return re.sub(r"\Afile:/*", "/", path)
    return None


def qualify(spark: SparkSession, path: str) -> str:
    """``path`` with its scheme, spelled the way Spark reports file paths."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    filesystem = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return filesystem.makeQualified(hadoop_path).toString()


def escape_glob(path: str) -> str:
    return re.sub(r"([{}\[\]*?\\])", r"\\\1", path)


class Exclusion:
    """Leaves out outputs of earlier runs, whether files or folders of parts.

    Local paths are compared by device and inode, so a link or another spelling still counts.
    An output is looked up when the object is made; make a new one for each listing.
    """

    def __init__(self, spark: SparkSession | None, *outputs: str | None):
        """Without a session the paths must be qualified."""
        given = [path if spark is None else qualify(spark, path) for path in outputs if path]
        self.outputs = [path.rstrip("/") for path in given]
        found = (_inode(local_path(path)) for path in self.outputs if local_path(path) is not None)
        self._inodes = {inode for inode in found if inode is not None}  # None: not written yet

    def is_output(self, path: str) -> bool:
        """Whether ``path`` itself is an output."""
        local = local_path(path)
        if local is None:
            return path in self.outputs
        return bool(self._inodes) and _inode(local) in self._inodes

    def matches(self, path: str) -> bool:
        """Whether ``path`` is an output or lies below one."""
        if self.is_output(path):
            return True
        if local_path(path) is None:
            return path.startswith(tuple(output + "/" for output in self.outputs))
        above = os.path.dirname(path)
        while len(above) > len("file:/"):
            if self.is_output(above):
                return True
            above = os.path.dirname(above)
        return False


def _inode(path: str) -> tuple[int, int] | None:
    try:
        found = os.stat(path)
    except OSError:
        return None
    return found.st_dev, found.st_ino


def list_tree(
    spark: SparkSession, root: str, exclude: str | None = None, include_hidden: bool = True
) -> Listing:
    """Every regular file under ``root``, at any depth, in path-byte order."""
    qualified = qualify(spark, root)
    exclusion = Exclusion(spark, exclude)
    local = local_path(qualified)
    if local is not None:
        listing = walk_local(local, exclusion, include_hidden)
    else:
        listing = _list_remote(spark, qualified, exclusion, include_hidden)
    if any(is_hidden(part) for f in listing.files for part in f.path[len(qualified):].split("/")[:-1]):
        listing.root = None  # a file below a hidden folder, which Spark's listing would skip
    listing.files.sort(key=lambda f: os.fsencode(f.path))
    return listing


def is_hidden(name: str) -> bool:
    return name.startswith(".") or (name.startswith("_") and "=" not in name)


def entries_of(folder: str, exclusion: Exclusion, include_hidden: bool) -> Iterator[tuple[str, str, int, int]]:
    """``(path, kind, mtime_us, length)`` of what a local folder holds.

    Kinds are file, folder, link (to a folder, not to be followed), output, closed (a file we may not read), and skipped
    (could not be looked at; the folder itself, if it could not be listed).
    """
    try:
        entries = list(os.scandir(folder))
    except OSError:
        yield "file:" + folder, "skipped", 0, 0
        return
    for entry in entries:
        path = "file:" + entry.path
        if exclusion.is_output(path):
            yield path, "output folder" if entry.is_dir() else "output", 0, 0
            continue
        if not include_hidden and is_hidden(entry.name):
            continue
        try:
            if entry.is_dir():
                yield path, "link" if entry.is_symlink() else "folder", 0, 0
                continue
            status = entry.stat()
        except FileNotFoundError:  # a dangling link is not a regular file
            continue
        except OSError:
            yield path, "skipped", 0, 0
            continue
        if stat_module.S_ISREG(status.st_mode):
            kind = "file" if os.access(entry.path, os.R_OK) else "closed"
            yield path, kind, status.st_mtime_ns // 1000, status.st_size


def walk_local(root: str, exclusion: Exclusion, include_hidden: bool) -> Listing:
    """Links to folders are not followed, links to files are read."""
    listing = Listing(root="file:" + root)
    pending = [root]
    while pending:
        folder = pending.pop()
        for path, kind, mtime_us, length in entries_of(folder, exclusion, include_hidden):
            if kind == "file":
                listing.files.append(LogFile(path, mtime_us, length))
            elif kind == "folder":
                pending.append(path.removeprefix("file:"))
            elif kind == "output folder":
                listing.left_out_folders.append(path)
            elif kind in ("output", "closed"):
                listing.left_out.append(path)
            listing.skipped += kind in ("skipped", "closed")
            if kind == "link" or kind == "skipped" and path == "file:" + folder:
                listing.root = None  # Spark's recursive listing would follow it, or fail
    return listing


def _list_remote(
    spark: SparkSession, root: str, exclusion: Exclusion, include_hidden: bool = True
) -> Listing:
    """Folders are listed level by level, many at a time, through the filesystem's own client.

    Spark's listing would leave out hidden names and could not tell what it missed. Names and
    sizes reach the driver, which holds them for any file scan anyway.
    """
    start = spark._jvm.org.apache.hadoop.fs.Path(root)
    filesystem = start.getFileSystem(spark._jsc.hadoopConfiguration())
    listing = Listing(root=root)

    def children(folder) -> list | None:
        try:
            return list(filesystem.listStatus(folder))
        except Py4JJavaError:  # no access, or removed since
            return None

    with ThreadPoolExecutor(_LISTERS) as pool:
        level = [start]
        while level:
            folders, level = level, []
            for found in pool.map(children, folders):
                if found is None:
                    listing.skipped += 1
                    listing.root = None
                    continue
                for status in found:
                    path = status.getPath()
                    name = path.toString()
                    if exclusion.is_output(name):
                        (listing.left_out_folders if status.isDirectory() else listing.left_out).append(name)
                    elif not include_hidden and is_hidden(path.getName()):
                        continue
                    elif status.isDirectory():
                        level.append(path)
                    elif status.isFile():
                        mtime_us = status.getModificationTime() * 1000
                        listing.files.append(LogFile(name, mtime_us, status.getLen()))
    return listing


def list_paths(spark: SparkSession, paths: list[str]) -> tuple[Listing, list[tuple[str, str]]]:
    """The given files, in the given order (a path may repeat), and why others are left out."""
    listing, problems = Listing(), []
    for given in paths:
        path = qualify(spark, given)
        local = local_path(path)
        if local is not None:
            found = _stat_local(local)
        else:
            found = _stat_remote(spark, path)
        if isinstance(found, str):
            problems.append((path, found))
        else:
            listing.files.append(LogFile(path, *found))
    return listing, problems


def _stat_local(path: str) -> tuple[int, int] | str:
    try:
        status = os.stat(path)
    except OSError as error:
        return f"not readable: {error.strerror}"
    if not stat_module.S_ISREG(status.st_mode):
        return "not readable: not a regular file"
    if not os.access(path, os.R_OK):
        return "not readable: Permission denied"
    return status.st_mtime_ns // 1000, status.st_size


def _stat_remote(spark: SparkSession, path: str) -> tuple[int, int] | str:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    filesystem = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not filesystem.exists(hadoop_path):
        return "not readable: no such file"
    status = filesystem.getFileStatus(hadoop_path)
    if not status.isFile():
        return "not readable: not a regular file"
    return status.getModificationTime() * 1000, status.getLen()
