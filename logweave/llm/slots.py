"""Sharding by fixed virtual slots.

Every record is hashed by its id into one of ``SLOTS`` virtual slots. Bytes are aggregated
per slot, and a slot-to-shard map says where each slot lives. The map is versioned and stored:
version 0 deals the slots out in turn, and each rebalancing writes the next version, which
moves only as many slots as it takes to make the shards' bytes equal. Records never change
their slot.

A slot may be hot (one id can hold a third of all rows). Each slot therefore has ``PARTS``
parts, dealt by the row's place in the input; the parts of a slot stay together unless the slot
holds more than a quarter of a fair share of the bytes. Only then are its parts moved one by one.
So the driver sees at most ``SLOTS * PARTS`` sums, whatever the input.

Places in a shard are numbered from counts per (task of the scan, shard): no group is larger
than the rows of one task.

Cases: a null text has no bytes and crc32 0; a null id hashes like the empty text; repeated rows
are rows of their own; an empty table gives an empty result. Only id and text are read, so other
columns cannot clash. If one row is larger than a fair share, its shard is as large as that row.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from logweave.llm.common import text_or_empty, to_numpy
from logweave.session import scratch_path, store

SLOTS = 4096
PARTS = 16
#: Bytes that a row takes besides its text.
ROW_BYTES = 8


def records(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow stored row per record: doc_id, size, text_crc32, vslot, part, place."""
    text = text_or_empty(F.col(f"`{text_col}`"))
    key = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    place = F.monotonically_increasing_id()
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.pmod(F.xxhash64(key), F.lit(SLOTS)).cast("int").alias("vslot"),
        place.alias("place"),
    )
    return store(rows.withColumn("part", F.pmod(F.xxhash64("place"), F.lit(PARTS)).cast("int")), "records")


def initial_map(shards: int) -> np.ndarray:
    """Shard of each (slot, part): slots in turn, parts together."""
    return np.repeat(np.arange(SLOTS) % shards, PARTS).reshape(SLOTS, PARTS)


def rebalance(owner: np.ndarray, weight: np.ndarray, shards: int) -> np.ndarray:
    """The next version of the map: moves units from the fullest shard to the emptiest
    while that brings them closer. A unit is a slot, or a part of a hot slot."""
    owner = owner.copy()
    hot = weight.sum(axis=1) * 4 * shards > weight.sum()
    # Units by index: whole slots are represented by part 0.
    size = np.where(hot[:, None], weight, 0)
    size[~hot, 0] = weight[~hot].sum(axis=1)
    flat, where = size.ravel(), owner.ravel()
    members = [np.flatnonzero((where == s) & (flat > 0)) for s in range(shards)]
    members = [list(m[np.argsort(flat[m], kind="stable")]) for m in members]
    load = np.array([flat[m].sum() for m in members])
    full = [(-load[s], s) for s in range(shards)]
    heapq.heapify(full)
    while full:
        from_load, source = heapq.heappop(full)
        if -from_load != load[source]:
            continue
        target = int(load.argmin())
        gap = load[source] - load[target]
        sizes = flat[members[source]]
        # The unit nearest to half the gap; anything below the gap is a gain.
        at = int(np.searchsorted(sizes, gap / 2))
        best = min((i for i in (at - 1, at) if 0 <= i < len(sizes)), key=lambda i: abs(sizes[i] - gap / 2), default=None)
        if best is None or sizes[best] >= gap:
            break
        unit = members[source].pop(best)
        members[target].insert(int(np.searchsorted(flat[members[target]], flat[unit])), unit)
        where[unit] = target
        for shard, change in ((source, -flat[unit]), (target, flat[unit])):
            load[shard] += change
            heapq.heappush(full, (-load[shard], shard))
    owner = where.reshape(SLOTS, PARTS)
    owner[~hot] = owner[~hot, :1]
    return owner


def store_map(spark: SparkSession, owner: np.ndarray, version: int, path: str) -> DataFrame:
    """Append a version of the map (vslot, part, shard) to its table; returns that version."""
    rows = pd.DataFrame({
        "version": version, "vslot": np.repeat(np.arange(SLOTS), PARTS), "part": np.tile(np.arange(PARTS), SLOTS),
        "shard": owner.ravel(),
    }).astype("int32")
    spark.createDataFrame(rows).coalesce(1).write.mode("append").parquet(path)
    return spark.read.parquet(path).where(F.col("version") == version).drop("version")


def assign(spark: SparkSession, docs: DataFrame, shards: int = 24, **columns: str) -> DataFrame:
    """doc_id, size, text_crc32, vslot, shard and the place ``slot`` in the shard, from 0."""
    rows = records(docs, **columns)
    weight = np.zeros((SLOTS, PARTS), dtype=np.int64)
    sums = to_numpy(rows.groupBy("vslot", "part").agg(F.sum("size").alias("bytes")))
    weight[sums["vslot"], sums["part"]] = sums["bytes"]
    path = scratch_path(spark, "slot-map")
    owner = initial_map(shards)
    store_map(spark, owner, 0, path)
    current = store_map(spark, rebalance(owner, weight, shards), 1, path)

    placed = rows.join(F.broadcast(current), ["vslot", "part"]).withColumn(  # SLOTS * PARTS rows at most
        "task", F.shiftright("place", 33).cast("int"))
    counts = placed.groupBy("task", "shard").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("task", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    rank = F.row_number().over(Window.partitionBy("task", "shard").orderBy("place"))
    return placed.withColumn("rank", rank).join(starts, ["task", "shard"]).select(
        "doc_id", "size", "text_crc32", "vslot", "shard", (F.col("start") + F.col("rank") - 1).alias("slot"))
