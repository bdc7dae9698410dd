"""Alignment of two tokenizers by products of sparse incidence matrices.

The tokens of a text by tokenizer A and by tokenizer B both spell out the same bytes. The incidence matrices of
tokens and bytes are held as compressed sparse rows built by hand, and Gustavson's row-wise product A * B^T gives the
overlap links: pairs of tokens that share bytes, and how many. Where both tokens of a link differ from those of the link before, both
tokenizers have just ended a token: these places cut the tokens into groups. The incidence of groups and token ids gives, by
the same product, the shared-group links: per document and pair of ids, how many token pairs lie in one group.

A task takes its texts in chunks of about ``CHUNK`` bytes (a longer text is a chunk of its own) and treats a chunk as one pair of
matrices, since a text's ends are ends of both tokenizers. Products are made ``STEP`` entries at a time. Texts are tokenised once. A chunk is stored as
one row per document, which names id pairs by their place among the chunk's pairs, and the chunk's pairs with the number of its documents
that hold them. Only such pre-aggregated pairs are shuffled: to count documents over the corpus, and then back to their chunk, where each document's links
look up their counts. No table of pairs is broadcast, and a task holds one chunk at a time.

Cases: null and empty texts, and texts that either tokenizer does not spell out byte by byte, have no tokens; names of special
tokens in a text are plain text; repeated rows are documents of their own; an empty table gives an empty result. Only id and text are read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, functions as F

from logweave.llm import common

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK = 1 << 19
STEP = 1 << 21
#: B's ids fit in so many bits; an id pair is A's id and B's id in one number.
PAIR_BITS = 20


def default_files() -> tuple[str, str]:
    """A's ranks (the vocabulary of byte_bpe_50k.json) and B's model."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")


@dataclass
class Tokenizer:
    """``encode`` gives a text's ids, ``spelling`` the bytes of an id."""

    encode: object
    spelling: list[bytes]

    def __post_init__(self):
        self.width = np.array([len(b) for b in self.spelling], np.int64)


@functools.cache
def byte_bpe(ranks_file: str) -> Tokenizer:
    import public_tokenizers
    import tiktoken

    with open(ranks_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    bpe = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    spelling = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        spelling[rank] = token
    return Tokenizer(lambda text: bpe.encode_ordinary(" " + text), spelling)


@functools.cache
def piece_bpe(model_file: str) -> Tokenizer:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    spelling = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    return Tokenizer(lambda text: model.encode(text, num_threads=1), spelling)


@dataclass
class Csr:
    """A sparse matrix: row i has ``columns`` and ``values`` from ``start[i]`` to ``start[i + 1]``."""

    start: np.ndarray
    columns: np.ndarray
    values: np.ndarray

    @classmethod
    def tokens_by_bytes(cls, widths: np.ndarray) -> Csr:
        start = np.concatenate([[0], np.cumsum(widths)])
        return cls(start, np.arange(start[-1]), np.ones(start[-1], np.int64))

    @classmethod
    def from_entries(cls, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, n_rows: int, n_columns: int) -> Csr:
        """Entries at the same place are added up."""
        place = rows * n_columns + columns
        order = np.argsort(place, kind="stable")
        place, values = place[order], values[order]
        first = np.flatnonzero(np.diff(place, prepend=-1))
        values = np.add.reduceat(values, first) if len(first) else values
        place = place[first]
        return cls(np.searchsorted(place, np.arange(n_rows + 1) * n_columns), place % n_columns, values)

    @property
    def n_rows(self) -> int:
        return len(self.start) - 1

    def transposed(self, n_columns: int) -> Csr:
        rows = np.repeat(np.arange(self.n_rows), np.diff(self.start))
        if (self.columns[1:] > self.columns[:-1]).all():
            return Csr(np.searchsorted(self.columns, np.arange(n_columns + 1)), rows, self.values)
        order = np.argsort(self.columns, kind="stable")
        return Csr(np.searchsorted(self.columns[order], np.arange(n_columns + 1)), rows[order], self.values[order])


def gustavson(a: Csr, b: Csr, n_columns: int, step: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Entries (row, column, value) of a * b in order, some rows of ``a`` at a time.

    A row of the product is the sum of the rows of ``b`` that the row's columns name, each times the row's value. Rows that need
    more than ``step`` entries are added up part by part.
    """
    step = step or STEP
    fan = np.diff(b.start)[a.columns]
    upto = np.concatenate([[0], np.cumsum(fan)])
    row_of = np.repeat(np.arange(a.n_rows), np.diff(a.start))
    at = 0
    held = [np.empty(0, np.int64)] * 3
    while at < len(fan):
        end = max(at + 1, int(np.searchsorted(upto, upto[at] + step, side="right")) - 1)
        count = fan[at:end]
        within = np.arange(upto[end] - upto[at]) - np.repeat(upto[at:end] - upto[at], count)
        source = np.repeat(b.start[a.columns[at:end]], count) + within
        rows = np.concatenate([held[0], np.repeat(row_of[at:end], count)])
        columns = np.concatenate([held[1], b.columns[source]])
        values = np.concatenate([held[2], np.repeat(a.values[at:end], count) * b.values[source]])
        rows, columns, values = _added_up(rows, columns, values, n_columns)
        at = end
        open_row = row_of[at] if at < len(fan) else -1
        done = int(np.searchsorted(rows, open_row)) if open_row >= 0 else len(rows)
        yield rows[:done], columns[:done], values[:done]
        held = [rows[done:], columns[done:], values[done:]]


def _added_up(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, n_columns: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    place = rows * n_columns + columns
    if len(place) > 1 and not (place[1:] > place[:-1]).all():
        order = np.argsort(place, kind="stable")
        place, values = place[order], values[order]
    first = np.flatnonzero(np.diff(place, prepend=-1))
    if len(first):
        values = np.add.reduceat(values, first)
    place = place[first]
    return place // n_columns, place % n_columns, values


def _all(entries: Iterator[tuple[np.ndarray, ...]]) -> list[np.ndarray]:
    parts = [*entries] or [(np.empty(0, np.int64),) * 3]
    return [np.concatenate(column) for column in zip(*parts)]


def overlaps(widths_a: np.ndarray, widths_b: np.ndarray) -> list[np.ndarray]:
    """Links (token of A, token of B, shared bytes) of tokens that spell out the same bytes."""
    a, b = Csr.tokens_by_bytes(widths_a), Csr.tokens_by_bytes(widths_b)
    return _all(gustavson(a, b.transposed(int(b.start[-1])), b.n_rows))


def groups_of(i: np.ndarray, j: np.ndarray, n_a: int, n_b: int) -> tuple[np.ndarray, np.ndarray]:
    """The group of each token: a new one begins where a link shares no token with the link before."""
    number = np.cumsum((np.diff(i, prepend=-1) > 0) & (np.diff(j, prepend=-1) > 0)) - 1
    of_a, of_b = np.empty(n_a, np.int64), np.empty(n_b, np.int64)
    of_a[i], of_b[j] = number, number
    return of_a, of_b


class Chunk:
    """Tokens, groups and links of a chunk's texts that both tokenizers spell out."""

    def __init__(self, ids_a: list[list[int]], ids_b: list[list[int]], a: Tokenizer, b: Tokenizer):
        self.n_a, self.n_b = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
        docs = np.arange(len(ids_a))
        self.ids_a, self.ids_b = (np.fromiter(chain.from_iterable(ids), np.int64, n.sum()) for ids, n in ((ids_a, self.n_a), (ids_b, self.n_b)))
        i, j, self.shared = overlaps(a.width[self.ids_a], b.width[self.ids_b])
        self.group_a, self.group_b = groups_of(i, j, len(self.ids_a), len(self.ids_b))
        self.n_links_overlap = np.bincount(np.repeat(docs, self.n_a)[i], minlength=len(docs))
        groups = int(self.group_a[-1]) + 1 if len(self.group_a) else 0
        doc_of_group = np.zeros(groups, np.int64)
        doc_of_group[self.group_a] = np.repeat(docs, self.n_a)
        self.n_groups = np.bincount(doc_of_group, minlength=len(docs))
        self._link(np.repeat(docs, self.n_a), groups, len(a.spelling), len(b.spelling))

    def _link(self, doc_of_a: np.ndarray, groups: int, size_a: int, size_b: int) -> None:
        """Per document and pair of ids, the number of links: (document, id of A) x group times group x id of B."""
        keys, row = np.unique(doc_of_a * size_a + self.ids_a, return_inverse=True)
        ones = np.ones(len(row), np.int64)
        left = Csr.from_entries(row, self.group_a, ones, len(keys), max(groups, 1))
        right = Csr.from_entries(self.group_b, self.ids_b, np.ones(len(self.ids_b), np.int64), groups, size_b)
        rows, columns, self.times = _all(gustavson(left, right, size_b))
        self.doc = keys[rows] // size_a if len(keys) else rows
        self.pair = (keys[rows] % size_a << PAIR_BITS | columns) if len(keys) else rows

    def spelt_groups(self, names: list[str], size_a: int) -> list[str]:
        """Each document's groups as ``a1,a2|b1;a3|b2,b3``."""
        # Tokens in order of (group, A before B): a token comes after those of the other side in earlier groups.
        total = len(self.ids_a) + len(self.ids_b)
        code = np.empty(total, np.int64)
        in_a, in_b = (np.arange(len(g)) for g in (self.group_a, self.group_b))
        last_a, last_b = (np.diff(g, append=-1) != 0 for g in (self.group_a, self.group_b))
        code[in_a + np.searchsorted(self.group_b, self.group_a)] = 2 * self.ids_a + last_a
        code[in_b + np.searchsorted(self.group_a, self.group_b, side="right")] = 2 * (self.ids_b + size_a) + last_b
        ends = np.cumsum(self.n_a + self.n_b)
        return ["".join(map(names.__getitem__, code[end - n:end].tolist()))[:-1] for end, n in zip(ends.tolist(), (self.n_a + self.n_b).tolist())]


@functools.cache
def _names(size_a: int, size_b: int) -> list[str]:
    """Each id with what follows it: within a group, and at the end of its side of the group."""
    return [f"{i}{mark}" for size, marks in ((size_a, ",|"), (size_b, ",;")) for i in range(size) for mark in marks]


_STORED = ("doc_id {kind}, chunk long, n_a long, n_b long, n_groups long, n_links long, n_overlaps long, groups_sha256 string, "
           "places array<int>, times array<long>, pairs array<struct<pair:long,docs:long>>")


def _spelt(text: str, a: Tokenizer, b: Tokenizer) -> tuple[list[int], list[int]]:
    """The text's ids, none if either side does not spell out a space and the text."""
    if not text:
        return [], []
    wanted = b" " + text.encode()
    ids_a = a.encode(text)
    if b"".join(map(a.spelling.__getitem__, ids_a)) != wanted:
        return [], []
    ids_b = b.encode(text)
    return (ids_a, ids_b) if b"".join(map(b.spelling.__getitem__, ids_b)) == wanted else ([], [])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """The ids and texts of ``CHUNK`` bytes at a time."""
    for batch in batches:
        ids, text = batch.column(0), batch.column(1)
        size = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + CHUNK, side="right")))
            yield ids.slice(at, end - at), text.slice(at, end - at).to_pylist()
            at = end


def align(docs: DataFrame, files: tuple[str, str], id_col: str, text_col: str) -> DataFrame:
    """Stored rows, one per document: counts, the links as places among the pairs of its chunk, and, in the chunk's first row, those pairs."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = _STORED.format(kind=rows.schema["doc_id"].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_bpe(files[0]), piece_bpe(files[1])
        names = _names(len(a.spelling), len(b.spelling))
        number = TaskContext.get().partitionId() << 32
        for ids, texts in _chunks(batches):
            both = [_spelt(text, a, b) for text in texts]
            chunk = Chunk([x for x, _ in both], [x for _, x in both], a, b)
            pairs, place, holders = np.unique(chunk.pair, return_inverse=True, return_counts=True)
            start = np.searchsorted(chunk.doc, np.arange(len(texts) + 1)).astype(np.int32)
            spelt = chunk.spelt_groups(names, len(a.spelling))
            links = np.add.reduceat(np.append(chunk.times, 0), start[:-1]) * (np.diff(start) > 0)
            listed = pa.StructArray.from_arrays([pa.array(pairs), pa.array(holders)], names=["pair", "docs"])
            of_first = pa.ListArray.from_arrays(pa.array([0] + [len(pairs)] * len(texts), pa.int32()), listed)
            yield pa.RecordBatch.from_pydict({
                "doc_id": ids, "chunk": pa.array(np.full(len(texts), number)), "n_a": pa.array(chunk.n_a), "n_b": pa.array(chunk.n_b),
                "n_groups": pa.array(chunk.n_groups), "n_links": pa.array(links), "n_overlaps": pa.array(chunk.n_links_overlap),
                "groups_sha256": pa.array([hashlib.sha256(s.encode()).hexdigest() if n else "" for s, n in zip(spelt, chunk.n_a)]),
                "places": pa.ListArray.from_arrays(pa.array(start), pa.array(place.astype(np.int32))),
                "times": pa.ListArray.from_arrays(pa.array(start), pa.array(chunk.times)),
                "pairs": of_first})
            number += 1

    return common.store(rows.mapInArrow(run, schema), "aligned")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): in how many documents an id pair is linked, and whether no pair of the same id of A is in more."""
    counts = common.store(_listed(aligned).groupBy("pair").agg(F.sum("docs").alias("n")), "pair-counts")
    id_a = F.shiftright("pair", PAIR_BITS)
    most = counts.groupBy(id_a.alias("id_a")).agg(F.max("n").alias("most"))  # as many rows as A has ids
    return counts.withColumn("id_a", id_a).join(F.broadcast(most), "id_a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _listed(aligned: DataFrame) -> DataFrame:
    return aligned.where(F.size("pairs") > 0).select("chunk", F.posexplode("pairs").alias("place", "p")).select(
        "chunk", "place", F.col("p.pair").alias("pair"), F.col("p.docs").alias("docs"))


def _look_up(docs: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """Add up the counts of each document's links from those of its chunk's pairs."""
    n, best = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)
    n[known["place"]], best[known["place"]] = known["n"], known["best"]
    sums = [(int((n[places] * times).sum()), int((best[places] * times).sum())) for places, times in zip(docs["places"], docs["times"])]
    out = docs.drop(columns=["places", "times", "chunk"])
    out["count_sum"], out["n_best"] = [x for x, _ in sums], [x for _, x in sums]
    return out


def alignments(
    docs: DataFrame, *, files: tuple[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_overlaps, groups_sha256, count_sum and n_best of each document."""
    aligned = align(docs, files or default_files(), id_col, text_col)
    known = _listed(aligned).join(pair_counts(aligned), "pair").select(F.col("chunk").alias("of_chunk"), "place", "n", "best")
    rows = aligned.drop("pairs")
    kept = [f for f in rows.schema if f.name not in ("places", "times", "chunk")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", count_sum long, n_best long"
    return rows.groupBy("chunk").cogroup(known.groupBy("of_chunk")).applyInPandas(_look_up, schema)
