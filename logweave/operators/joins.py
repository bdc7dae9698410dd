"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# A table with at most this many narrow rows may be broadcast (about 200 MB).
BROADCAST_ROWS = 2_000_000

# A key with more than 1/HOT_SHARE of all rows is hot; there are at most HOT_SHARE of them.
HOT_SHARE = 1_000

# Lines of one entry per join key: longer entries are spread over several keys.
PART_LINES = 1 << 17

_HASH = "key_hash"


def attach(rows: DataFrame, table: DataFrame, keys: list[str], at_most: int) -> DataFrame:
    """Join with a narrow table whose keys each match a bounded group of ``rows``.

    The table is broadcast when ``at_most``, a bound of its row count, allows it,
    and shuffled otherwise. Several keys, which must be bigints without NULLs, are looked up in the broadcast table by one hash of
    them and then compared: Spark finds a single bigint several times faster than a row of them.
    """
    if at_most > BROADCAST_ROWS:
        return rows.join(table, keys)
    if len(keys) == 1:
        return rows.join(F.broadcast(table), keys)
    hashed = F.xxhash64(*keys).alias(_HASH)
    own = {key: f"{_HASH}_{key}" for key in keys}
    others = table.select(hashed, *[F.col(key).alias(own[key]) for key in keys], *[c for c in table.columns if c not in keys])
    # As one number that is 0 if all keys agree: single comparisons would become keys of the join again.
    differs = reduce(Column.bitwiseOR, [F.col(key).bitwiseXOR(F.col(own[key])) for key in keys])
    joined = rows.select("*", hashed).join(F.broadcast(others), _HASH).where(differs == 0)
    return joined.select(*keys, *[c for c in rows.columns if c not in keys], *[c for c in table.columns if c not in keys])


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Rows joined with a stored table of their groups, one row per key.

    ``weight`` tells how large a group is, and one group may hold most of the
    rows. A small table is broadcast. Of a large one the hot groups are, whose
    number is bounded by their share, so no task receives all rows of one of them.
    """
    if groups.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(groups), keys).drop(weight)
    total = groups.agg(F.sum(weight)).first()[0]
    is_hot = F.col(weight) > total / HOT_SHARE
    hot, cold = groups.where(is_hot).drop(weight), groups.where(~is_hot).drop(weight)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(rest.join(cold, keys))


def entry_part(line_in_entry="line_in_entry"):
    return F.expr(f"{line_in_entry} div {PART_LINES}")


def whole_entries(
    document: DataFrame, entries: DataFrame, extra: list[str] | None = None, at_most: int | None = None
) -> DataFrame:
    """All lines of ``entries(file_ord, entry_no, n_lines)``.

    An entry may hold any number of lines. Unless the table of entries is known to
    be small, it is therefore matched in parts of bounded size.
    """
    columns = ["file_ord", "entry_no", *(extra or [])]
    how = "inner" if extra else "left_semi"
    if at_most is not None and at_most <= BROADCAST_ROWS:
        return document.join(F.broadcast(entries.select(*columns)), ["file_ord", "entry_no"], how)
    last_part = F.expr(f"(n_lines - 1) div {PART_LINES}")
    parts = entries.select(
        *columns, F.explode(F.sequence(F.lit(0).cast("bigint"), last_part)).alias("part")
    )
    return (
        document.withColumn("part", entry_part())
        .join(parts, ["file_ord", "entry_no", "part"], how)
        .drop("part")
    )


def without_entries(document: DataFrame, entries: DataFrame, kept: DataFrame, n_dropped: int) -> DataFrame:
    """Lines that are not of ``entries`` but of ``kept``, its complement.

    A short list of dropped entries is broadcast; otherwise the kept ones are matched.
    """
    if n_dropped <= BROADCAST_ROWS:
        dropped = F.broadcast(entries.select("file_ord", "entry_no"))
        return document.join(dropped, ["file_ord", "entry_no"], "left_anti")
    return whole_entries(document, kept)
