"""Keep a merged document up to date while files are added, changed or removed.

The store holds parsed lines by *generation*: each refresh parses only the files
that are new or changed and writes them as one generation, with the fingerprints of their entries. A manifest says, per
file, which generation is current and which number the file has there, so nothing that was written is ever touched.
Rows name their file by that number: a path is longer than most lines.

Small and half-dead generations are merged now and then, as in a log-structured tree: the number of generations
stays logarithmic in the number of refreshes. Generations that no recent version refers to are removed.
"""

from __future__ import annotations

import time
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from logweave.functions.levels import label_of, level_code, level_word
from logweave.functions.timestamps import TimestampFormat
from logweave.operators.changes import check_changes
from logweave.operators.joins import join_groups
from logweave.operators.merge import dedup_entries, fingerprints
from logweave.operators.sinks import write_merged
from logweave.plans.merge_plan import parse_logs
from logweave.session import local_table, store
from logweave.sources.catalog import BUILT_IN_FORMATS
from logweave.sources.listing import Listing, LogFile, list_tree
from logweave.sources.logs import read_lines

POLL_SECONDS = 2.0
#: Beyond so many generations, all but those are merged that are larger than ``SPARED`` times the smaller ones together.
MAX_GENERATIONS = 8
SPARED = 4
#: A generation with less than this share of its bytes still current is merged with the next ones.
LEAST_LIVE = 0.5
#: So many versions can still be read by others while newer ones are written.
KEPT_VERSIONS = 2

_MANIFEST = "path string, mtime_us bigint, length bigint, gen bigint, place bigint, gen_bytes bigint"
_LINES = (
    "place int, entry_no bigint, line_in_entry bigint, sort_key string, "
    "timestamp_length int, line string, gen int"
)
_PRINTS = (
    "place int, entry_no bigint, sort_key string, n_lines bigint, n_bytes bigint, print_a bigint, "
    "print_b bigint, level int, gen int"
)
_LEVELS = "place int, level int, n bigint, sort_key string, entry_no bigint, gen int"
_TABLES = (
    ("lines", _LINES, ["place", "entry_no", "line_in_entry"]),
    ("prints", _PRINTS, ["place", "entry_no"]),
    ("levels", _LEVELS, ["place", "level"]),
)

# A manifest row that marks the version as complete, also when there are no files.
_MARK = ""


@dataclass
class Refresh:
    """``status`` is changed, unchanged or inconclusive; see the store for the document."""

    status: str
    parsed: list[str] = field(default_factory=list)
    problems: list[tuple[str, str]] = field(default_factory=list)


class LogStore:
    """The parsed lines of one directory tree."""

    def __init__(
        self, spark: SparkSession, root: str, store_dir: str, output: str | None = None,
        formats: list[TimestampFormat] | None = None, include_hidden: bool = True,
        dedup: bool = False,
    ):
        self.spark = spark
        self.root = root
        self.output = output
        self.formats = formats or BUILT_IN_FORMATS
        self.include_hidden = include_hidden
        self.dedup = dedup
        self._dir = store_dir.rstrip("/")
        self.version = -1
        self.baseline = Listing()
        self._gens: dict[str, int] = {}
        self._places: dict[str, int] = {}  # the number of each current file in its generation
        self._gen_bytes: dict[int, int] = {}
        self._outdated = -1
        self._resume()

    def _filesystem(self, folder: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._dir}/{folder}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _resume(self) -> None:
        """Go on from the last complete version written by an earlier session."""
        path, filesystem = self._filesystem("manifest")
        if not filesystem.exists(path):
            return
        rows = self.spark.read.schema(_MANIFEST + ", v bigint").parquet(f"{self._dir}/manifest")
        version = F.when(F.col("place").isNotNull(), F.col("v"))
        found, last = rows.where(F.col("path") == _MARK).agg(F.max(version), F.max("v")).first()
        if found is None:  # nothing yet, or a store by paths, as it was written before: everything is parsed again
            self._outdated = -1 if last is None else last
            return
        current = rows.where((F.col("v") == found) & (F.col("path") != _MARK))
        files = [(LogFile(r.path, r.mtime_us, r.length), r.gen, r.place, r.gen_bytes) for r in current.toLocalIterator()]
        files.sort(key=lambda item: item[0].path.encode(errors="surrogateescape"))
        self.version = found
        self.baseline = Listing([f for f, *_ in files])
        self._gens = {f.path: gen for f, gen, *_ in files if gen >= 0}
        self._places = {f.path: place for f, gen, place, _ in files if gen >= 0}
        self._gen_bytes = {gen: n or 0 for _, gen, _, n in files if gen >= 0}

    def refresh(self) -> Refresh:
        """Bring the store up to date. A scan that misses something changes nothing.

        Files that could not be read before are tried again, also if they look as they did.
        """
        current = list_tree(self.spark, self.root, self.output, self.include_hidden)
        check = check_changes(self.baseline, current)
        failed = [f for f in current.files if f.path not in self._gens]
        if self.version >= 0 and (check.status == "inconclusive" or check.status == "unchanged" and not failed):
            return Refresh(check.status, problems=current.problems(self.root))
        version = max(self.version, self._outdated) + 1
        known = {f.path: f for f in self.baseline.files if f.path in self._gens}
        todo = [f for f in current.files if known.get(f.path) != f]
        parsed = parse_logs(read_lines(self.spark, todo), self.formats)
        document = self._write(parsed.document, version)
        problems = [(r.path, r.reason) for r in parsed.warnings().collect()]
        unread = {path for path, _ in problems}
        fresh = {f.path: version for f in todo if f.path not in unread}
        if check.status == "unchanged" and not fresh and self.version >= 0:
            return Refresh("unchanged", problems=current.problems(self.root) + problems)
        self._summarise(document, version)
        kept = {f.path: self._gens[f.path] for f in current.files if known.get(f.path) == f}
        self._places |= {r.path: r.file_ord for r in parsed.staged.units.select("path", "file_ord").collect()}  # as long as the listing
        self._gen_bytes[version] = sum(f.length for f in todo if f.path in fresh)
        # What was merged is the new baseline, so a change during the merge is seen next time.
        self.baseline = Listing(current.files) if not current.skipped else self.baseline
        self._commit(version, current.files, {**kept, **fresh})
        if len(set(self._gens.values())) > MAX_GENERATIONS or self._wasteful():
            self.compact()
        if self.output:
            write_merged(self.document(), self.output)
        return Refresh("changed", [f.path for f in todo], current.problems(self.root) + problems)

    def _summarise(self, document: DataFrame, gen: int) -> None:
        """Fingerprints and levels of a generation's entries, and its entries per file and level with the first of them."""
        word = F.when(F.col("line_in_entry") == 0, level_word(F.col("line")))
        levelled = document.withColumn("word", word).withColumn("level", level_code(F.col("word")))
        path = f"{self._dir}/prints/gen={gen}"
        fingerprints(levelled, by="place", more=[F.max("level").alias("level")]).write.mode("overwrite").parquet(path)
        prints = self.spark.read.schema(_PRINTS.rsplit(",", 1)[0]).parquet(path)
        first = F.min(F.struct("sort_key", "entry_no")).alias("first")
        prints.groupBy("place", "level").agg(F.count("*").alias("n"), first).select(
            "place", "level", "n", "first.*").write.mode("overwrite").parquet(f"{self._dir}/levels/gen={gen}")

    def _write(self, document: DataFrame, gen: int) -> DataFrame:
        """Lines of a generation, with the number of their file in it."""
        path, schema = f"{self._dir}/lines/gen={gen}", _LINES.rsplit(",", 1)[0]
        numbered = document.withColumn("place", F.col("file_ord").cast("int"))
        numbered.select(*[name.split()[0] for name in schema.split(", ")]).write.mode("overwrite").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def _commit(self, version: int, files: list[LogFile], gens: dict[str, int]) -> None:
        self._places = {path: self._places[path] for path in gens}
        rows = [
            (f.path, f.mtime_us, f.length, g := gens.get(f.path, -1), self._places.get(f.path, -1), self._gen_bytes.get(g, 0))
            for f in files
        ]
        manifest = local_table(self.spark, [(_MARK, 0, 0, -1, -1, 0), *rows], _MANIFEST)
        manifest.write.mode("overwrite").parquet(f"{self._dir}/manifest/v={version}")
        self.version = version
        self._gens = gens

    def _live_bytes(self) -> dict[int, int]:
        sizes = {f.path: f.length for f in self.baseline.files}
        live: dict[int, int] = defaultdict(int)
        for path, gen in self._gens.items():
            live[gen] += sizes.get(path, 0)
        return live

    def _wasteful(self) -> list[int]:
        return [gen for gen, live in self._live_bytes().items() if live < LEAST_LIVE * self._gen_bytes[gen]]

    def compact(self) -> None:
        """Merge small and wasteful generations into one, sorted by file, and remove what nothing refers to."""
        live = self._live_bytes()
        merged, smaller = [], 0
        for gen in sorted(live, key=lambda g: (live[g], g)):
            if smaller and live[gen] > SPARED * smaller:
                break
            merged.append(gen)
            smaller += live[gen]
        merged = sorted({*merged, *self._wasteful()})
        version = self.version + 1
        moved = {path for path, gen in self._gens.items() if gen in merged}
        for folder, schema, order in _TABLES:
            rows = self._live(folder, schema, merged).withColumn("place", F.col("file_ord").cast("int"))
            lined_up = rows.drop("file", "file_ord", "gen").repartitionByRange(*order).sortWithinPartitions(*order)
            lined_up.write.mode("overwrite").parquet(f"{self._dir}/{folder}/gen={version}")
        self._places |= {path: place for place, path in enumerate(self._in_order()) if path in moved}
        self._gen_bytes[version] = sum(live[gen] for gen in merged)
        self._commit(version, self.baseline.files, {path: version if path in moved else gen for path, gen in self._gens.items()})
        self._remove_dead()

    def _remove_dead(self) -> None:
        """Delete manifests older than the last ones, and generations that those do not name."""
        rows = self.spark.read.schema(_MANIFEST + ", v bigint").parquet(f"{self._dir}/manifest")
        recent = rows.where(F.col("v") > self.version - KEPT_VERSIONS)
        named = {row.gen for row in recent.select("gen").distinct().collect()}  # logarithmic in the refreshes
        for folder, prefix, is_dead in (
            ("manifest", "v=", lambda v: v <= self.version - KEPT_VERSIONS),
            *((folder, "gen=", lambda g: g not in named) for folder, _, _ in _TABLES),
        ):
            path, filesystem = self._filesystem(folder)
            for status in filesystem.listStatus(path):
                name = status.getPath().getName()
                if name.startswith(prefix) and is_dead(int(name.removeprefix(prefix))):
                    filesystem.delete(status.getPath(), True)

    def _live(self, folder: str, schema: str, gens: list[int] | None = None) -> DataFrame:
        """Rows of the current generation of each file, with ``file_ord``; of some generations, if given."""
        sizes = {f.path: f.length for f in self.baseline.files}
        current = [
            (path, self._gens[path], self._places[path], number, sizes.get(path, 0))
            for number, path in enumerate(self._in_order()) if gens is None or self._gens[path] in gens
        ]
        files = local_table(self.spark, current, "file string, gen int, place int, file_ord bigint, length bigint")
        named = sorted({gen for _, gen, *_ in current})  # other generations are not scanned
        rows = self.spark.read.schema(schema).parquet(f"{self._dir}/{folder}").where(F.col("gen").isin(named))
        return join_groups(rows, files, ["gen", "place"], weight="length").drop("place")

    def _in_order(self) -> list[str]:
        """The current files; a file's place in the list is its ``file_ord``."""
        return sorted(self._gens, key=lambda path: path.encode(errors="surrogateescape"))

    def document(self) -> DataFrame:
        """The current lines of all current files, deduplicated if the store is set to.

        Duplicates are found from the stored fingerprints; only lines of entries that share one are read for it.
        """
        if self.version < 0:
            raise ValueError("refresh the store first")
        document = self._live("lines", _LINES).drop("gen")
        if not self.dedup:
            return store(document, "refreshed")
        return dedup_entries(document, prints=self._live("prints", _PRINTS).drop("gen", "file", "level"))

    def level_counts(self) -> DataFrame:
        """Entries per level, as ``stats.level_counts`` has them, from the summaries of the generations: no text is read.

        A store that deduplicates counts one entry for each fingerprint.
        """
        if self.version < 0:
            raise ValueError("refresh the store first")
        first = F.min(F.struct("sort_key", "file_ord", "entry_no")).alias("first")
        if self.dedup:
            prints = self._live("prints", _PRINTS)
            kept = prints.groupBy("n_lines", "n_bytes", "print_a", "print_b").agg(first, F.max("level").alias("level"))
            counts = kept.groupBy("level").agg(F.count("*").alias("count"), F.min("first").alias("first"))
        else:
            counts = self._live("levels", _LEVELS).groupBy("level").agg(F.sum("n").alias("count"), first)
        return counts.orderBy(F.col("count").desc(), "first").select(label_of(F.col("level")).alias("level"), "count")


def watch(store: LogStore, rounds: int | None = None, interval: float = POLL_SECONDS) -> Iterator[Refresh]:
    """Poll the directory and yield after each change that was merged."""
    done = 0
    while rounds is None or done < rounds:
        outcome = store.refresh()
        if outcome.status == "changed":
            yield outcome
        done += 1
        if rounds is None or done < rounds:
            time.sleep(interval)
