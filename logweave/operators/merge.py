"""Chronological merge and removal of repeated entries."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import count

from pyspark.sql import Column, DataFrame, functions as F

from logweave.operators.joins import join_groups, whole_entries, without_entries
from logweave.session import store

ORDER = ["sort_key", "file_ord", "entry_no", "line_in_entry"]


def concat_logs(*documents: DataFrame) -> DataFrame:
    """All lines of several documents, duplicates included."""
    first, *rest = documents
    for other in rest:
        first = first.unionByName(other)
    return first


def merge_chronological(document: DataFrame) -> DataFrame:
    """Total order by key, then file, then place in the file. Keys compare bytewise."""
    return document.orderBy(*ORDER)


def line_hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "line_in_entry", "line")


_PRINT = ["n_lines", "n_bytes", "print_a", "print_b"]
_HASHES = ["hash_a", "hash_b"]
_N_BYTES = "line_bytes"
# The seeds of the first attempt, which stored hashes and fingerprints are made with.
FIRST_SEEDS = (0, 1)


def with_line_hashes(document: DataFrame) -> DataFrame:
    """Add what fingerprints are made of, so that they can be had from a stored document without its text."""
    hashes = {name: line_hash(seed) for name, seed in zip(_HASHES, FIRST_SEEDS)}
    return document.withColumns({**hashes, _N_BYTES: F.octet_length("line")})


def fingerprints(
    document: DataFrame, hash_a: Column | None = None, hash_b: Column | None = None, by: str = "file_ord",
    more: Iterable[Column] = (),
) -> DataFrame:
    """One row per entry. Partial sums meet, so even a huge entry is cheap to reduce.

    Stored line hashes are used if the document has them and no others are given. ``more`` are further
    aggregates of an entry.
    """
    stored = hash_a is None and set(_HASHES) <= set(document.columns)
    if stored:
        hash_a, hash_b = map(F.col, _HASHES)
    elif hash_a is None:
        hash_a, hash_b = map(line_hash, FIRST_SEEDS)
    return document.groupBy(by, "entry_no", "sort_key").agg(
        F.count("*").alias("n_lines"),
        F.sum(F.col(_N_BYTES) if stored else F.octet_length("line")).cast("bigint").alias("n_bytes"),
        F.bit_xor(hash_a).alias("print_a"),
        F.bit_xor(hash_b).alias("print_b"),
        *more,
    )


def _differ(document: DataFrame, suspects: DataFrame, n_suspects: int) -> bool:
    """Whether entries with one fingerprint differ in any line.

    Per fingerprint and line number the smallest and the largest line must be
    equal; partial aggregation reduces the copies before the shuffle.
    """
    prints = ["n_bytes", "print_a", "print_b"]
    spread = (
        whole_entries(document, suspects, extra=prints, at_most=n_suspects)
        .groupBy(*prints, "line_in_entry")
        .agg(F.min("line").alias("low"), F.max("line").alias("high"))
        .where("low <> high")
    )
    return not spread.isEmpty()


def dedup_entries(
    document: DataFrame,
    hashes: Callable[[int], Column] = line_hash,
    seeds: Iterable[int] | None = None,
    prints: DataFrame | None = None,
) -> DataFrame:
    """Keep the first entry, in merged order, of those with the same content.

    Entries are grouped by fingerprint, and those that share one are compared line
    by line. If two of them differ, everything is done again with another seed, so
    the result is exact. ``prints`` are the stored fingerprints of all entries, if there are any; else they come from
    the line hashes of ``with_line_hashes``, or from the text. Store the document beforehand if it is costly to compute.
    """
    has_hashes = set(_HASHES) <= set(document.columns)
    for attempt, seed in enumerate(seeds or count()):
        if attempt == 0 and prints is not None:
            entries = store(prints, "fingerprints")
        elif attempt == 0 and has_hashes and hashes is line_hash:
            entries = store(fingerprints(document), "fingerprints")
        else:
            entries = store(fingerprints(document, hashes(2 * seed), hashes(2 * seed + 1)), "fingerprints")
        groups = store(
            entries.groupBy(*_PRINT).agg(
                F.min(F.struct("sort_key", "file_ord", "entry_no")).alias("first"),
                F.count("*").alias("copies"),
            ),
            "copies",
        )
        repeated = groups.where("copies > 1")
        suspects = store(join_groups(entries, repeated, _PRINT, "copies"), "suspects")
        n_suspects = suspects.count()
        if n_suspects == 0:
            return document.drop(*_HASHES, _N_BYTES)
        if not _differ(document, suspects, n_suspects):
            break
    else:
        raise RuntimeError("different entries shared a fingerprint under every seed")
    is_first = (F.col("file_ord") == F.col("first.file_ord")) & (F.col("entry_no") == F.col("first.entry_no"))
    kept = groups.select("first.file_ord", "first.entry_no", "n_lines")
    return without_entries(document.drop(*_HASHES, _N_BYTES), suspects.where(~is_first), kept, n_suspects)
