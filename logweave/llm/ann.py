"""Nearest neighbours by collision counting with query-centred windows.

Inner products become distances by one more coordinate that gives all vectors the same length. Vectors are
projected on ``PROJECTIONS`` random lines, each line of a block is cut into ``LEVELS`` narrow levels, one byte a row. A query does
not hash into fixed buckets: windows centred at its own projections grow in rounds by virtual rehashing (the same levels, a wider
radius), and each row counts the lines in whose window it lies, for all rows of a block at a time. Rows that reach the collision
threshold are verified by their inner product in double precision; rounds end when ``share_of`` the rows have been verified. That share
falls as the table grows: the nearest rows of a larger table are nearer, and are told from the others by fewer verifications.

Rows are dealt to blocks of about ``BLOCK`` by hash and queries to groups of about ``GROUP``; each pair of block and
group is one task's work, with the best ``k`` per query of each pair merged by a window. Equal vectors are merged first,
keeping the ``k + 1`` smallest ids: ties go to smaller ids, so no other copy can be in any result. The random
lines depend on nothing but the dimension; no index is fitted and every row is indexed.

Counting takes every query past every row, so the work still grows with rows times queries, by some hundredths of a microsecond a pair.

Cases: null vectors, zero vectors and those with null or non-finite components take no part, nor do rows with a null id; vectors of a
length other than the most frequent one take no part; a query with no candidate has no rows; repeated ids are rows of
their own, but rows with the query's id are not its neighbours. Only id and vector are read.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from logweave.session import store

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PROJECTIONS = 64
#: Share of the lines on which a row must fall into the query's window.
THRESHOLD = 0.8
#: Rounds end when this share of a table of ``SHARE_ROWS`` rows has been verified, less of a larger one (a power of its rows), and
#: of any table so many rows.
SHARE, SHARE_ROWS, SHARE_POWER = 0.25, 10_000, 0.3
LEAST = 800
BLOCK = 8_192
GROUP = 4_096
LEVELS = 255
#: Share of a block beyond the outer levels of a line, at either end.
_TAIL = 0.001
_GROWTH = 1.04
#: Queries of a group that look for their radius from a small one; the others begin near the middle of what those found.
_PROBES = 9


def share_of(rows: int) -> float:
    """The share of a table that is verified for each query."""
    return min(1.0, max(LEAST / max(rows, 1), SHARE * (SHARE_ROWS / max(rows, 1)) ** SHARE_POWER))


def lines(dims: int, count: int = PROJECTIONS) -> np.ndarray:
    return np.random.default_rng(dims).standard_normal((dims, count))


class Index:
    """The levels of one block's projections: a row of bytes for each line."""

    def __init__(self, vectors: np.ndarray, longest: float, count: int = PROJECTIONS):
        self.vectors = vectors
        rest = np.sqrt(np.maximum(longest**2 - (vectors**2).sum(axis=1), 0))
        self.lines = lines(vectors.shape[1] + 1, count)
        projected = (np.column_stack([vectors, rest]) @ self.lines).T
        self.low, high = np.quantile(projected, [_TAIL, 1 - _TAIL], axis=1)
        self.width = np.maximum((high - self.low) / (LEVELS - 2), 1e-12 * longest + 1e-300)
        # Eight rows are added up as one word; the last ones are filled up with a level that no window has.
        self.levels = np.full((count, -(-len(vectors) // 8) * 8), LEVELS, dtype=np.uint8)
        self.levels[:, :len(vectors)] = np.clip(np.floor((projected - self.low[:, None]) / self.width[:, None]) + 1, 0, LEVELS - 1)
        self.longest = longest

    def near(self, queries: np.ndarray, share: float, threshold: float = THRESHOLD) -> list[np.ndarray]:
        """Rows to verify for each query. Queries are scaled to the length of the rows, which keeps their order."""
        n, count = len(self.vectors), len(self.levels)
        wanted = min(n, int(np.ceil(n * share)))
        need = int(np.ceil(count * threshold))
        norm = np.linalg.norm(queries, axis=1, keepdims=True)
        at = np.column_stack([queries / norm * self.longest, np.zeros(len(queries))]) @ self.lines
        # What lies far beyond all rows of a line counts as a whole range away.
        at = np.clip((at - self.low) / self.width + 1, -LEVELS, 2 * LEVELS)
        moved, inside = np.empty_like(self.levels), np.empty(self.levels.shape, dtype=bool)
        words = inside.view(np.uint64)
        found, radii, first = [], [], 1.0
        for query in at:
            radius = first if len(radii) < _PROBES else 0.95 * float(np.median(radii[:_PROBES]))
            while True:
                low = np.clip(np.floor(query - radius), 0, LEVELS - 1)
                high = np.clip(np.floor(query + radius), low, LEVELS - 1)
                np.subtract(self.levels, low.astype(np.uint8)[:, None], out=moved)  # below the window: wraps around
                np.less_equal(moved, (high - low).astype(np.uint8)[:, None], out=inside)
                hit = np.flatnonzero(words.sum(axis=0).view(np.uint8)[:n] >= need)
                if len(hit) >= wanted:
                    break
                radius = max(radius * (_GROWTH if 8 * len(hit) >= wanted else _GROWTH**4), radius + 1)
            found.append(hit)
            radii.append(radius)
        return found


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Stored rows (id, v): vectors of doubles that take part."""
    vector = F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double"))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), vector.alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    rows = store(rows, "vectors")
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (size["d"] if size else 0))


def search(vectors: DataFrame, is_query: Column, k: int = 20, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows with the largest inner product for each row where
    ``is_query``, a condition on the column ``id``, holds."""
    rows = usable(vectors, id_col, vector_col)
    # Equal vectors are one row with its smallest ids: at most k + 1 survive in each partial sum.
    ranked = rows.select("v", "id", F.xxhash64("v").alias("h"), F.pmod(F.xxhash64("id", F.lit("salt")), F.lit(64)).alias("salt"))
    first = ranked.withColumn("r", F.row_number().over(Window.partitionBy("h", "v", "salt").orderBy("id"))).where(F.col("r") <= k + 1)
    first = first.withColumn("r", F.row_number().over(Window.partitionBy("h", "v").orderBy("id"))).where(F.col("r") <= k + 1)
    merged = store(first.groupBy("h", "v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "distinct-vectors")  # k + 1 ids
    stats = merged.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("m")).first()
    blocks = max(1, -(-stats["n"] // BLOCK))
    longest, share = float(np.sqrt(stats["m"] or 0.0)), share_of(stats["n"])
    queries = rows.where(is_query)
    groups = max(1, -(-queries.count() // GROUP))
    left = merged.select("v", "ids", F.pmod("h", F.lit(blocks)).cast("int").alias("block"),
                         F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    right = queries.select("id", "v", F.pmod(F.xxhash64("id", "v"), F.lit(groups)).cast("int").alias("group"),
                           F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def pair(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(asked):
            index = Index(np.stack(rows["v"].to_numpy()), longest)
            ids = rows["ids"].to_numpy()
            asked = asked.sort_values("id")  # the first ones set the radius of the others
            wanted = np.stack(asked["v"].to_numpy())
            for own, query, near in zip(asked["id"].to_numpy(), wanted, index.near(wanted, share)):
                if len(near) > k + 1:
                    rough = index.vectors[near] @ query  # rounds otherwise than the sum below, so a little is allowed for it
                    slack = 1e-12 * longest * np.linalg.norm(query)
                    near = near[rough >= np.partition(rough, -(k + 1))[-(k + 1)] - slack]
                score = (index.vectors[near] * query).sum(axis=1)
                best = sorted((-s, i) for s, r in zip(score, near) for i in ids[r] if i != own)[:k]
                out += [(own, i, -s) for s, i in best]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = left.groupBy("block", "group").cogroup(right.groupBy("block", "group")).applyInPandas(
        pair, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
