"""Grouping of spelling variants by dense prefix-suffix tiling.

Two words are near if one inserted, deleted or replaced code point makes them equal. That is so if their common prefix
and their common suffix together reach the longer length minus one, which is read off padded code-point matrices.

Which words meet: of near words the shorter has ``m`` code points and the longer at most one more, and one of prefix and
suffix has ``m div 2`` or more. So each word is dealt, for ``m`` its own length and one less, by its first and by its last
``m div 2`` code points. A pair is counted where its prefix matches if that is long enough, else where its suffix does.
A small group is compared pair by pair along the diagonals of one matrix with many groups; a larger one as a tile. A group of
more than ``CELLS`` matrix cells is dealt into blocks, and each pair of blocks is a tile of its own: a task holds two blocks at most.

Pairs are not written. A tile gives, for each word, how many near words it has there and the most frequent of them; these are
summed up by word. Forms are then followed to their ends by doubling, one stored table per round; a form is at least ``ratio`` times as
frequent as its word, so the rounds are few.

Cases: null and empty texts have no words; words of any length are taken (a long one makes small blocks); repeated rows count
again; ties go to the smaller word in code-point order; an empty table gives an empty result. Only id and text are read.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from logweave.llm import common
from logweave.session import store

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORD = "[A-Za-zÀ-ÿ]"
#: Matrix cells of a block, and of the part of a task's input that is turned into matrices at a time.
CELLS = 1 << 16
PORTION = 1 << 20
#: Groups of up to so many words are compared along diagonals, many groups at once.
SMALL = 24
#: Cells of one comparison of rows.
STEP = 1 << 21
#: Rows of (m, front, key, blocks) that may be broadcast: some 40 bytes each.
BROADCAST_GROUPS = 200_000
RATIO = 10

_GROUP = ["m", "front", "key"]
_NEAR = "word string, n_near long, best_n long, best string"


def count_words(
    docs: DataFrame, *, least_length: int = 7, least_count: int = 2, id_col: str = "doc_id", text_col: str = "text",
    change: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """(word, n): the runs of letters, A-Z lower-cased, of at least so many code points and occurrences.

    ``change`` gives another spelling, no longer than the run, from the document's id and the run.
    """
    runs = F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(WORD + f"{{{least_length},}}"), F.lit(0))
    words = docs.select(F.col(f"`{id_col}`").alias("id"), F.explode(runs).alias("run")).select("id", common.ascii_lower(F.col("run")).alias("run"))
    word = F.col("run") if change is None else change(F.col("id"), F.col("run"))
    return words.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(
        F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _dealt(words: DataFrame) -> DataFrame:
    """Rows (m, front, key, low, high, own, word, n), one for each tile that a word belongs to."""
    length = F.length("word")
    sides = F.array(*[F.struct(m.alias("m"), F.lit(front).alias("front")) for m in (length, length - 1) for front in (True, False)])
    half = F.expr("m div 2")
    part = F.when(F.col("front"), F.substring("word", F.lit(1), half)).otherwise(F.substring("word", length - half + 1, half))
    placed = words.select("word", "n", F.inline(sides)).where("m > 0").withColumn("key", F.xxhash64(part))
    cells = F.count(F.lit(1)) * (F.col("m") + 1)
    large = store(placed.groupBy(*_GROUP).agg(F.ceil(cells / CELLS).cast("int").alias("blocks")).where("blocks > 1"), "large-groups")
    n_large = large.count()
    if n_large:
        placed = placed.join(F.broadcast(large) if n_large <= BROADCAST_GROUPS else large, _GROUP, "left")
    else:
        placed = placed.withColumn("blocks", F.lit(1))
    blocks = F.coalesce("blocks", F.lit(1))
    own = placed.withColumn("own", F.pmod(F.xxhash64("word"), blocks).cast("int"))
    others = own.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return others.select(*_GROUP, F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "word", "n")


def matrix(words: list[str], width: int) -> np.ndarray:
    """One row of code points per word, padded with zeros."""
    points = np.array(words, dtype=f"U{width}").view(np.uint32).reshape(len(words), width)
    return points.astype(np.uint8) if points.max(initial=0) < 256 else points


class _Rows:
    """Words of one ``m`` and side as matrices, forwards and backwards."""

    def __init__(self, m: int, front: bool, words: list[str], n: np.ndarray):
        self.m, self.front, self.words, self.n = m, front, words, n
        self.length = np.array([len(w) for w in words])
        self.ahead, self.back = matrix(words, m + 1), matrix([w[::-1] for w in words], m + 1)
        self.count = np.zeros(len(words), np.int64)
        order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
        self.rank = np.empty(len(words), np.int64)
        self.rank[order] = np.arange(len(words))
        self.order, self.best = order, np.full(len(words), len(words), np.int64)

    def compare(self, i: np.ndarray, j: np.ndarray) -> None:
        """Note which rows ``i`` are near to the rows ``j`` beside them."""
        short, long = np.minimum(self.length[i], self.length[j]), np.maximum(self.length[i], self.length[j])
        keep = (short == self.m) & (long <= self.m + 1)
        i, j, short, long = i[keep], j[keep], short[keep], long[keep]
        for at in range(0, len(i), rows := max(1, STEP // (self.m + 1))):
            a, b, least = i[at:at + rows], j[at:at + rows], short[at:at + rows]
            prefix, suffix = (np.minimum(_first_difference(x[a], x[b]), least) for x in (self.ahead, self.back))
            near = prefix + suffix >= long[at:at + rows] - 1
            near &= prefix >= self.m // 2 if self.front else (suffix >= self.m // 2) & (prefix < self.m // 2)
            for x, y in ((a[near], b[near]), (b[near], a[near])):
                np.add.at(self.count, x, 1)
                np.minimum.at(self.best, x, self.rank[y])

    def found(self) -> pa.RecordBatch:
        some = np.flatnonzero(self.count)
        best = [self.order[r] for r in self.best[some]]
        return pa.RecordBatch.from_pydict({
            "word": pa.array([self.words[k] for k in some], pa.string()), "n_near": pa.array(self.count[some], pa.int64()),
            "best_n": pa.array(self.n[best] if best else [], pa.int64()), "best": pa.array([self.words[k] for k in best], pa.string())})


def _first_difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    differ = a != b
    at = differ.argmax(axis=1)
    return np.where(differ[np.arange(len(at)), at], at, a.shape[1])


def diagonals(group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of all rows with the same number in the sorted ``group``, one distance at a time."""
    at = np.arange(len(group))
    distance = 1
    while True:
        at = at[at < len(group) - distance]
        at = at[group[at] == group[at + distance]]
        if not len(at):
            return
        yield at, at + distance
        distance += 1


def tile(one: np.ndarray, other: np.ndarray, cells: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of a block with another, or with itself, some rows at a time."""
    same = one is other
    for at in range(0, len(one), rows := max(1, cells // max(1, len(other)))):
        i, j = np.meshgrid(one[at:at + rows], other, indexing="ij")
        i, j = i.ravel(), j.ravel()
        yield (i[i < j], j[i < j]) if same else (i, j)


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, np.ndarray, list, list, np.ndarray]]:
    """Rows of one ``m`` and side, with whole tiles, up to ``PORTION`` cells unless a single tile is larger."""
    side, tiles, owns, words, counts, last, number, cells = None, [], [], [], [], None, -1, 0

    def portion():
        return side, np.array(tiles), owns, words, np.array(counts, np.int64)

    for batch in batches:
        for m, front, key, low, high, own, word, n in zip(*(column.to_pylist() for column in batch.columns)):
            now = (m, front, key, low, high)
            if now != last:
                number += 1
                if words and (side != (m, front) or cells > PORTION):
                    yield portion()
                    tiles, owns, words, counts, cells = [], [], [], [], 0
                side, last = (m, front), now
            tiles.append(number)
            owns.append(own if low != high else -1)
            words.append(word)
            counts.append(n)
            cells += m + 1
    if words:
        yield portion()


def compare_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each word of the sorted tiles of a task: how many near words it has in a tile, and the best of them."""
    for (m, front), tiles, owns, words, counts in _portions(batches):
        starts = np.flatnonzero(np.diff(tiles, prepend=tiles[0] - 1))
        size = np.diff(starts, append=len(tiles))
        met = np.repeat(size, size) > 1
        if not met.any():
            continue
        keep = np.flatnonzero(met)
        rows = _Rows(m, front, [words[k] for k in keep], counts[keep])
        tiles, own, size = tiles[keep], np.array(owns)[keep], np.repeat(size, size)[keep]
        cross = own >= 0
        small = np.flatnonzero((size <= SMALL) & ~cross)
        for i, j in diagonals(tiles[small]):
            rows.compare(small[i], small[j])
        for number in np.unique(tiles[(size > SMALL) | cross]):
            at = np.flatnonzero(tiles == number)
            sides = [at] if own[at[0]] < 0 else [at[own[at] == k] for k in np.unique(own[at])]
            if own[at[0]] >= 0 and len(sides) < 2:
                continue
            for i, j in tile(sides[0], sides[-1], STEP):
                rows.compare(i, j)
        yield rows.found()


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) for each of the stored distinct ``words`` (word, n) that has a near one."""
    tiles = _dealt(words).repartition(*_GROUP, "low", "high").sortWithinPartitions(*_GROUP, "low", "high")
    found = tiles.mapInArrow(compare_tiles, _NEAR)
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", (-F.col("b.minus")).alias("best_n"), "b.best")


def follow(links: DataFrame) -> DataFrame:
    """(word, root) of stored links (word, root) that lead to ever more frequent words."""
    while True:
        onward = links.select(F.col("root"), F.lit(0).alias("there")).distinct().join(
            links.select(F.col("word").alias("root"), F.col("root").alias("next")), "root").select("root", "next")
        onward = store(onward, "onward-forms")
        if onward.isEmpty():
            return links
        links = store(links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "forms")


def group(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near and form_n of the distinct ``words`` (word, n)."""
    words = store(words, "words")
    joined = words.join(near_words(words), "word", "left")
    has_form = F.col("best_n") >= ratio * F.col("n")
    formed = store(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has_form, F.col("best")).alias("form"),
        F.when(has_form, F.col("best_n")).alias("form_n")), "formed-words")
    roots = follow(formed.where("form is not null").select("word", F.col("form").alias("root")))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
