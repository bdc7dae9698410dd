"""Packing along a space-filling curve.

Each document's token ids are hashed by a fixed random projection to ``DIMS`` dimensions; the direction of the
mean is a point in a cube whose place along the Hilbert curve is the document's key. Documents are range-sorted by that key and
laid end to end, and the line of ids is cut every ``LENGTH`` ids. Neighbours on the curve so share sequences,
and only the last sequence of all is padded.

Texts are tokenised once and their ids stored. Bounds of the ranges and the first place of each range come from the
stored narrow columns; then the ids are shuffled once, to the task of their range, which cuts them as it streams.
Keys are completed by a hash of the row, so many equal documents (one point on the curve) spread over several ranges.

Cases: a null or empty text is the single id 0; a text that names a special token gets the id that the
tokenizer gives it; very long texts are cut over many sequences; repeated rows are packed one by one; an empty
table gives an empty result. Only id and text are read.
"""

from __future__ import annotations

import base64
import functools
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from logweave.llm import common

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LENGTH = 1024
END_ID = 0
DIMS = 4
BITS = 8
#: Ids that a range aims at, and the most ranges: beyond, ranges grow and their sort spills.
RANGE_IDS = 1 << 22
MAX_RANGES = 4096
#: Rows that a task turns into Python values at a time.
PORTION = 500


def default_files() -> tuple[str, str]:
    """The tokenizer's file, and its ranks for the faster encoder of the same ids."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.cache
def _fast(ranks_file: str):
    import public_tokenizers
    import tiktoken

    ranks = {}
    with open(ranks_file, "rb") as lines:
        for line in lines:
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def _exact(json_file: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(json_file)


@functools.cache
def special_tokens(json_file: str) -> tuple[str, ...]:
    return tuple(token.content for token in _exact(json_file).get_added_tokens_decoder().values())


def encode(text: str, files: tuple[str, str], special: tuple[str, ...]) -> np.ndarray:
    """The text's ids and the end id. Both encoders hold the same vocabulary; only one knows the ``special`` tokens.

    A worker loads that one when a text names such a token.
    """
    if any(token in text for token in special):
        ids = _exact(files[0]).encode(text, add_special_tokens=False).ids
    else:
        ids = _fast(files[1]).encode_ordinary(text)
    ids.append(END_ID)
    return np.array(ids, dtype=np.uint16)


@functools.cache
def projection(vocabulary: int = 1 << 16) -> np.ndarray:
    return np.random.default_rng(7).standard_normal((vocabulary, DIMS)).astype(np.float32)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of integer points (rows) with ``bits`` bits a coordinate.

    Coordinates are turned into the transposed index by undoing excess rotations from the highest bit
    down, then Gray-coded; its bits are interleaved into one number.
    """
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        q = 1 << level
        for k in range(dims):
            inverted = (x[k] & q) != 0
            swap = np.where(inverted, 0, (x[0] ^ x[k]) & (q - 1))
            x[0] ^= np.where(inverted, q - 1, swap)
            if k:
                x[k] ^= swap
    for k in range(1, dims):
        x[k] ^= x[k - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= flip
    place = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for k in range(dims):
            place = (place << 1) | ((x[k] >> level) & 1)
    return place


def curve_place(vectors: np.ndarray) -> np.ndarray:
    """Place on the curve of each vector's direction."""
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = vectors / np.where(norm == 0, 1, norm)
    return hilbert(np.clip(((unit + 1) * (1 << (BITS - 1))).astype(np.int64), 0, (1 << BITS) - 1))


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A few rows at a time, so that a task holds the Python values and the results of those only."""
    for batch in batches:
        for at in range(0, batch.num_rows, PORTION):
            yield batch.slice(at, PORTION)


def tokenise(docs: DataFrame, files: tuple[str, str], id_col: str, text_col: str) -> DataFrame:
    """Stored rows (row, doc_id, n, key, ids): ids as 16-bit numbers, ``key`` their place on the curve."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("doc_id"),
                       common.text_or_empty(F.col(f"`{text_col}`")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    special = special_tokens(files[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _portions(batches):
            ids = [encode(text, files, special) for text in part.column("text").to_pylist()]
            vectors = np.array([projection()[x].mean(axis=0) for x in ids])
            yield pa.RecordBatch.from_pydict({
                "row": part.column("row"), "doc_id": part.column("doc_id"),
                "n": pa.array([len(x) for x in ids], pa.int64()), "place": pa.array(curve_place(vectors), pa.int64()),
                "ids": pa.array([x.tobytes() for x in ids], pa.binary())})

    found = rows.mapInArrow(run, f"row long, doc_id {kind}, n long, place long, ids binary")
    tie = F.xxhash64("row").bitwiseAND((1 << 31) - 1)
    return common.store(found.select("row", "doc_id", "n", F.shiftleft("place", 31).bitwiseOR(tie).alias("key"), "ids"), "token-ids")


def pack(
    docs: DataFrame, *, length: int = LENGTH, files: tuple[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ``ids`` themselves."""
    stored = tokenise(docs, files or default_files(), id_col, text_col)
    total = stored.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ranges = max(1, min(MAX_RANGES, total // RANGE_IDS))
    cuts = stored.agg(F.percentile_approx("key", [i / ranges for i in range(1, ranges)], 100 * ranges)).first()[0] if ranges > 1 else []
    bounds = np.array(cuts or [], dtype=np.int64)

    @F.pandas_udf("int")
    def range_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, keys.to_numpy(), side="right").astype(np.int32))

    ranged = stored.withColumn("range", range_of("key"))
    sums = common.to_numpy(ranged.groupBy("range").agg(F.sum("n").alias("n")))  # MAX_RANGES rows at most
    size = np.zeros(ranges, dtype=np.int64)
    size[sums["range"]] = sums["n"]
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    kind = stored.schema["doc_id"].dataType.simpleString()

    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = first.copy()
        for part in _portions(batches):
            source, numbers, pieces = [], [], []
            columns = (part.column(name).to_pylist() for name in ("n", "ids", "range"))
            for row, (n, ids, own) in enumerate(zip(*columns)):
                begin, end = int(at[own]), int(at[own]) + n
                at[own] = end
                ids = np.frombuffer(ids, dtype="<u2")
                for place in [begin, *range((begin // length + 1) * length, end, length)]:
                    stop = min((place // length + 1) * length, end)
                    piece = ids[place - begin:stop - begin].astype("<u4").tobytes()
                    source.append(row)
                    numbers.append((place - begin, stop - place, zlib.crc32(piece), n, place // length, place % length))
                    pieces.append(piece)
            yield pa.RecordBatch.from_pydict(
                {"doc_id": part.column("doc_id").take(pa.array(source, pa.int64()))}
                | {name: pa.array(column, pa.int64()) for name, column in zip(names, zip(*numbers))}
                | {"ids": pa.array(pieces, pa.binary())})

    lined_up = ranged.repartitionById(ranges, F.col("range")).sortWithinPartitions("range", "key", "row")
    return lined_up.mapInArrow(cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, "
                                    "sequence_id long, offset long, ids binary")
