"""Consecutive numbers in a global order, without a single-task window over the rows."""

from __future__ import annotations

import json
from bisect import bisect_right
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from logweave.session import local_table, scratch_path, store

# monotonically_increasing_id keeps the row's rank in its partition in the low bits.
_RANK_MASK = (1 << 33) - 1


def with_number(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Add the place of each row, from 0, in the total order given by ``order``.

    A range shuffle puts the partitions in order. Each row is ranked in its
    partition, and the table of partition sizes gives the rank to start from.
    """
    ranked = store(
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("piece", F.spark_partition_id())
        .withColumn("rank", F.monotonically_increasing_id().bitwiseAND(F.lit(_RANK_MASK))),
        "numbered",
    )
    # One row per partition of the range shuffle, so this table and its window stay tiny.
    sizes = ranked.groupBy("piece").agg(F.count("*").alias("n"))
    earlier = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("piece", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    return (
        ranked.join(F.broadcast(starts), "piece")
        .withColumn(name, F.col("start") + F.col("rank"))
        .drop("piece", "rank", "start")
    )


PIECE, RANK = "piece", "rank"
_ZONES = "piece int, first bigint, n bigint, schema string"
_SCHEMA_ROW = -1  # the piece of the row that holds the schema, also if there are no zones


class NumberedStore:
    """Rows in a total order, in files cut by range, with a table of zones.

    A row is stored with its rank in its piece, the zone of a piece says which number its first row has, and each piece is
    a folder of its own. So the rows of a range of numbers are a folder and a range of ranks: the scan lists
    one folder and skips the row groups outside. The store can be opened again by its path.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def write(cls, rows: DataFrame, order: list[str], path: str | None = None) -> NumberedStore:
        """Sort and write ``rows`` once. ``order`` must tell all rows apart, or equal ones may swap."""
        made = cls(rows.sparkSession, path or scratch_path(rows.sparkSession, "numbered"))
        pieces = (
            rows.repartitionByRange(*order)
            .withColumn(PIECE, F.spark_partition_id())
            .sortWithinPartitions(PIECE, *order)
            .withColumn(RANK, F.monotonically_increasing_id().bitwiseAND(F.lit(_RANK_MASK)))
        )
        pieces.write.mode("overwrite").partitionBy(PIECE).parquet(f"{made.path}/rows")
        # One row per partition of the range shuffle.
        sizes = made.spark.read.schema(pieces.schema).parquet(f"{made.path}/rows").groupBy(PIECE).agg(F.count("*").alias("n"))
        table, first = [(_SCHEMA_ROW, 0, 0, pieces.schema.json())], 0
        for piece, n in sorted(sizes.collect()):
            table.append((piece, first, n, None))
            first += n
        local_table(made.spark, table, _ZONES).coalesce(1).write.mode("overwrite").parquet(f"{made.path}/zones")
        made.__dict__["_table"] = table
        return made

    @cached_property
    def _table(self) -> list[tuple[int, int, int, str | None]]:
        return sorted(map(tuple, self.spark.read.schema(_ZONES).parquet(f"{self.path}/zones").collect()))

    @cached_property
    def zones(self) -> list[tuple[int, int, int]]:
        """``(piece, first, n)`` in order."""
        return [row[:3] for row in self._table[1:]]

    @cached_property
    def _stored(self) -> DataFrame:
        schema = StructType.fromJson(json.loads(self._table[0][3]))
        return self.spark.read.schema(schema).parquet(f"{self.path}/rows")

    def count(self) -> int:
        return self.zones[-1][1] + self.zones[-1][2] if self.zones else 0

    def piece_of(self, number: int) -> int:
        """Place in ``zones`` of the piece that holds a number; the nearest one if none does."""
        return max(0, min(bisect_right([first for _, first, _ in self.zones], number) - 1, len(self.zones) - 1))

    def pieces(self, first: int, last: int, name: str) -> DataFrame:
        """The rows of the zones ``first`` to ``last``, both included, with their numbers as ``name``."""
        zones = self.zones[first:last + 1]
        rows = self._stored
        if len(zones) < len(self.zones):
            low, high = (zones[0][0], zones[-1][0]) if zones else (0, -1)
            rows = rows.where(F.col(PIECE) == low if low == high else F.col(PIECE).between(low, high))
        if len(zones) == 1:
            return rows.withColumn(name, F.col(RANK) + zones[0][1]).drop(PIECE, RANK)
        starts = F.broadcast(local_table(self.spark, [z[:2] for z in zones], "piece int, first bigint"))
        return rows.join(starts, PIECE).withColumn(name, F.col("first") + F.col(RANK)).drop(PIECE, RANK, "first")

    def rows(self, name: str) -> DataFrame:
        """All rows with their numbers, from 0, as ``name``."""
        return self.pieces(0, len(self.zones) - 1, name)

    def between(self, first: int, last: int, name: str) -> DataFrame:
        """The rows numbered ``first`` to ``last``, both included."""
        if not self.zones or last < first or last < 0 or first >= self.count():
            return self.rows(name).where("false")
        begin, end = self.piece_of(first), self.piece_of(last)
        if begin != end:
            return self.pieces(begin, end, name).where(F.col(name).between(first, last))
        piece, start, _ = self.zones[begin]
        ranks = F.col(RANK).between(F.lit(first - start), F.lit(last - start))
        return self._stored.where((F.col(PIECE) == piece) & ranks).withColumn(name, F.col(RANK) + start).drop(PIECE, RANK)
