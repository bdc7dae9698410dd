"""SimHash near-duplicates with pigeonring filtering.

A fingerprint's bit is set if it is set in over half of the XXH64 values (seed 42) of the text's shingles.
Two fingerprints link if they differ in at most ``LIMIT`` (4) bits.

The 64 bits are cut into a ring of five segments, so a segment's share of the limit is 4/5. By the pigeonring
principle a linked pair has a start on the ring from which every chain of 1, 2, 3, ... segments keeps within
its proportional budget: 0 differing bits in the first segment, 1 in the first two, 2 in three, 3 in four.
The first two budgets are met by bucketing: a bucket is a start, its segment, and the next segment with one bit
masked. What meets in a bucket must keep the budgets of the longer chains before all 64 bits are compared.

Equal fingerprints are merged before bucketing, so a group of exact copies of any size is one fingerprint.
A bucket is sorted and streamed through its task. Small buckets compare all their rows; larger ones are searched
breadth first and give a spanning forest rather than all pairs; one of more than ``BLOCK`` fingerprints is cut into
blocks, and pairs of blocks are compared by tasks of their own. Components follow from the links by
``components``. No fingerprints or links pass through the driver.

Cases: a null, empty or wordless text has fingerprint zero, which links like any other; fewer than four words are
one shingle; repeated rows give one row each; a component whose ids are all null has a null component id. Only id and text are read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from logweave.llm import common
from logweave.llm.components import components
from logweave.session import store

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE = 4
LIMIT = 4
SEED = 42
#: The ring: widths of the segments and their first bits.
WIDTHS = (13, 13, 13, 13, 12)
OFFSETS = (0, 13, 26, 39, 52)
RING = len(WIDTHS)
#: Up to so many rows in a bucket are compared with each other; beyond, a forest is searched.
SMALL = 16
BLOCK = 8192


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = common.lower_bytes(text).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words]).tolist()
    ends = (ends - 1).tolist()[min(shingle, len(words)) - 1:]
    hashes = np.fromiter(
        (xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts, ends)), np.uint64, len(ends))
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        octets = hashes[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint_of(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint's bits as a signed long."""

    @F.pandas_udf("long")
    def of(series: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(x, shingle) for x in series], dtype=np.uint64).view(np.int64))

    return of(text)


def chain_mask(start: int, length: int) -> int:
    """The bits of ``length`` segments from ``start`` on, around the ring."""
    mask = 0
    for k in range(start, start + length):
        mask |= ((1 << WIDTHS[k % RING]) - 1) << OFFSETS[k % RING]
    return mask


_MASKS = [[np.uint64(chain_mask(start, length)) for length in range(1, RING + 1)] for start in range(RING)]
_BUDGETS = [length * LIMIT // RING for length in range(1, RING + 1)]


def viable(differ: np.ndarray, start: int, lengths: range = range(1, RING + 1)) -> np.ndarray:
    """Whether the chains from ``start`` keep their budgets; the last one is the full comparison."""
    good = np.ones(differ.shape, dtype=bool)
    for length in lengths:
        good &= np.bitwise_count(differ & _MASKS[start][length - 1]) <= _BUDGETS[length - 1]
    return good


def _buckets(fps: DataFrame) -> DataFrame:
    """(bucket, fp): 64 buckets for each fingerprint."""
    def segment(k: int):
        return F.shiftrightunsigned("fp", OFFSETS[k]).bitwiseAND((1 << WIDTHS[k]) - 1)

    keys = []
    for start in range(RING):
        then = (start + 1) % RING
        for bit in range(WIDTHS[then]):
            place = F.lit((start * 16 + bit) << 26)
            masked = segment(then).bitwiseAND(((1 << WIDTHS[then]) - 1) & ~(1 << bit))
            keys.append(place.bitwiseOR(F.shiftleft(segment(start), 13)).bitwiseOR(masked))
    return fps.select(F.explode(F.array(*keys)).alias("bucket"), "fp")


def _first_here(differ: np.ndarray, start: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Whether no earlier bucket of the same linked pair has found it."""
    first = np.ones(len(differ), dtype=bool)
    for k in range(RING):
        earlier = (start > k) & first
        if earlier.any():
            first[earlier] &= ~viable(differ[earlier], k)
        then = (k + 1) % RING
        step = (differ >> np.uint64(OFFSETS[then])) & np.uint64((1 << WIDTHS[then]) - 1)
        lowest = np.where(step == 0, 1, step & (~step + np.uint64(1)))
        here = start == k
        first[here] &= lowest[here] == (np.uint64(1) << bit[here].astype(np.uint64))
    return first


def small_buckets(bucket: np.ndarray, fp: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links within sorted buckets of at most ``SMALL`` rows, row against the rows after it."""
    links = []
    for lag in range(1, SMALL):
        same = np.flatnonzero(bucket[lag:] == bucket[:-lag]) if lag < len(bucket) else np.empty(0, dtype=np.int64)
        if not len(same):
            break
        differ = fp[same] ^ fp[same + lag]
        place = bucket[same] >> 26
        start, bit = place >> 4, place & 15
        for k in range(RING):  # budgets of the chains of three and four segments, then all bits
            own = np.flatnonzero(start == k)
            own = own[viable(differ[own], k, range(3, RING))]
            own = own[np.bitwise_count(differ[own]) <= LIMIT]
            own = own[_first_here(differ[own], start[own], bit[own])]
            links.append((fp[same[own]], fp[same[own] + lag]))
    return links


def forest(left: np.ndarray, right: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among ``left``, or between ``left`` and ``right``."""
    nodes = left if right is None else np.concatenate([left, right])
    side = np.zeros(len(nodes), dtype=np.int8) if right is None else np.repeat(np.array([0, 1], dtype=np.int8), [len(left), len(right)])
    waiting = np.arange(len(nodes))
    a, b = [], []
    while len(waiting):
        queue, waiting = waiting[:1], waiting[1:]
        while len(queue) and len(waiting):
            at, queue = queue[0], queue[1:]
            near = np.bitwise_count(nodes[waiting] ^ nodes[at]) <= LIMIT
            if right is not None:
                near &= side[waiting] != side[at]
            found = waiting[near]
            a.append(np.repeat(nodes[at], len(found)))
            b.append(nodes[found])
            waiting, queue = waiting[~near], np.concatenate([queue, found])
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.uint64), np.empty(0, np.uint64))


_FOUND = "a long, b long, bucket long, block int, fps array<long>"
_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("bucket", pa.int64()), ("block", pa.int32()), ("fps", pa.list_(pa.int64()))])


def _rows(links: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a = np.concatenate([x for x, _ in links]).view(np.int64)
    b = np.concatenate([y for _, y in links]).view(np.int64)
    nulls = [pa.nulls(len(a), field.type) for field in list(_ARROW)[2:]]
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *nulls], schema=_ARROW)


def _block(bucket: int, number: int, fps: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([bucket]), pa.array([number], pa.int32()),
         pa.array([fps.view(np.int64)], pa.list_(pa.int64()))], schema=_ARROW)


def search_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the sorted buckets of a task; blocks of those that are too large for it."""
    bucket, fp, number = np.empty(0, np.int64), np.empty(0, np.uint64), 0
    batches = iter(batches)
    done = False
    while not done:
        batch = next(batches, None)
        done = batch is None
        if batch is not None:
            bucket = np.concatenate([bucket, batch.column(0).to_numpy()])
            fp = np.concatenate([fp, batch.column(1).to_numpy().view(np.uint64)])
        if not len(bucket):
            continue
        starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        ends = np.append(starts[1:], len(bucket))
        links, small = [], np.ones(len(bucket), dtype=bool)
        keep = len(bucket) if done else starts[-1]  # the last bucket may go on in the next batch
        for s, e in zip(starts[ends - starts > SMALL], ends[ends - starts > SMALL]):
            small[s:e] = False
            if e == len(bucket) and not done:
                while e - s >= 2 * BLOCK:
                    yield _block(int(bucket[s]), number, fp[s:s + BLOCK])
                    number, s = number + 1, s + BLOCK
                keep = s
            elif number and s == 0:
                yield _block(int(bucket[s]), number, fp[s:e])
                number = 0
            elif e - s > BLOCK:
                for part, at in enumerate(range(s, e, BLOCK)):
                    yield _block(int(bucket[s]), part, fp[at:min(at + BLOCK, e)])
            else:
                links.append(forest(fp[s:e]))
        if number and (done or starts[-1] > 0) and ends[0] <= SMALL:  # a short rest of a bucket that was cut
            yield _block(int(bucket[0]), number, fp[:ends[0]])
            small[:ends[0]] = False
            number = 0
        small[keep:] = False
        links += small_buckets(bucket[small], fp[small])
        if any(len(x) for x, _ in links):
            yield _rows([(x, y) for x, y in links if len(x)])
        bucket, fp = bucket[keep:], fp[keep:]


def compare_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            left = batch.column("fps").slice(i, 1).flatten().to_numpy().view(np.uint64)
            right = batch.column("other").slice(i, 1).flatten().to_numpy().view(np.uint64)
            a, b = forest(left) if batch.column("same")[i].as_py() else forest(left, right)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


def link(fps: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints that join all that are reachable from each other."""
    sorted_buckets = _buckets(fps).repartition("bucket").sortWithinPartitions("bucket", "fp")
    found = store(sorted_buckets.mapInArrow(search_buckets, _FOUND), "links")
    links = found.where("fps is null").select("a", "b")
    blocks = found.where("fps is not null").select("bucket", "block", "fps")
    if blocks.isEmpty():
        return links
    others = blocks.select("bucket", F.col("block").alias("other_block"), F.col("fps").alias("other"))
    pairs = blocks.join(others, "bucket").where("block <= other_block").select(
        "fps", "other", (F.col("block") == F.col("other_block")).alias("same"))
    return links.union(pairs.mapInArrow(compare_blocks, "a long, b long"))


def rooted(rows: DataFrame) -> DataFrame:
    """Stored rows (fp, least, root): the distinct fingerprints of ``rows`` (doc_id, fp), their smallest id and component."""
    fps = store(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = components(link(fps.select("fp")), "simhash-components")
    placed = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    return store(placed, "simhash-roots")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    rows = store(docs.select(F.col(f"`{id_col}`").alias("doc_id"), fingerprint_of(F.col(f"`{text_col}`"), shingle).alias("fp")), "fingerprints")
    placed = rooted(rows)
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = placed.join(smallest, "root").select("fp", "component_id")
    return rows.join(of_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id, null ids last."""
    marked = common.store(docs.withColumn("__row", F.monotonically_increasing_id()).withColumn(
        "__fp", fingerprint_of(F.col(f"`{text_col}`"), shingle)), "fingerprinted")
    rows = marked.select("__row", F.col(f"`{id_col}`").alias("doc_id"), F.col("__fp").alias("fp"))
    first = F.min(F.struct(F.isnull("doc_id").alias("last"), "doc_id", "__row"))
    kept = rows.join(rooted(rows.select("doc_id", "fp")).select("fp", "root"), "fp").groupBy("root").agg(first.alias("first"))
    return marked.join(kept.select(F.col("first.__row").alias("__row")), "__row", "left_semi").drop("__row", "__fp")
