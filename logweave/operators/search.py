"""Number, find, slice and expand lines of the merged document.

Positions count visible lines, that is, the lines left by the current filter,
from 0 in merged order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from logweave.functions.ascii import ascii_icontains, ascii_lower, ascii_lower_str, java_literal
from logweave.operators import joins
from logweave.operators.merge import ORDER
from logweave.operators.numbering import NumberedStore
from logweave.session import local_table, store

NUMBER = "doc_line_no"


def store_lines(document: DataFrame, predicate: Column | None = None, path: str | None = None) -> NumberedStore:
    """Write the visible lines in merged order, so that pages and searches read only the files they need."""
    visible = document if predicate is None else document.where(predicate)
    return NumberedStore.write(visible, ORDER, path)


def number_lines(document: DataFrame, predicate: Column | None = None) -> DataFrame:
    """Visible lines with their position ``doc_line_no``."""
    return store_lines(document, predicate).rows(NUMBER)


def line_counts(document: DataFrame, predicate: Column) -> DataFrame:
    return document.agg(
        F.count_if(predicate).alias("visible_lines"), F.count("*").alias("total_lines")
    )


Numbered = DataFrame | NumberedStore


def _hits(lines: DataFrame, term: str) -> DataFrame:
    """No line is a hit when there is no term."""
    return lines.where(ascii_icontains(F.col("line"), term) & F.lit(term != ""))


def _hit_position(numbered: Numbered, term: str, position: int, forward: bool) -> DataFrame:
    """The nearest hit from ``position`` on or, wrapping around, the nearest one at all; NULL when nothing matches."""
    if isinstance(numbered, NumberedStore):
        return local_table(numbered.spark, [(nearest_hit(numbered, term, position, forward),)], "position bigint")
    number, pick = F.col(NUMBER), F.min if forward else F.max
    ahead = number >= position if forward else number <= position
    return _hits(numbered, term).agg(F.coalesce(pick(F.when(ahead, number)), pick(number)).alias("position"))


def nearest_hit(stored: NumberedStore, term: str, position: int, forward: bool = True) -> int | None:
    """The nearest hit from ``position`` on, wrapping around.

    Pieces are searched from there outwards, twice as many at a time, so a hit close by takes one small job and a term
    that is nowhere a number of jobs that is logarithmic in the pieces.
    """
    zones = len(stored.zones)
    if term == "" or not zones:
        return None
    own = stored.piece_of(position)
    number, pick = F.col(NUMBER), F.min if forward else F.max
    ahead = number >= position if forward else number <= position
    # Piece numbers from the own one to the end, then around and back to the own one, whose other lines come last.
    places = [*range(own, zones), *range(own + 1)] if forward else [*range(own, -1, -1), *range(zones - 1, own - 1, -1)]
    turn = zones - own if forward else own + 1
    at, width = 0, 1
    while at < len(places):
        end = min(at + width, turn if at < turn else len(places))
        low, high = sorted((places[at], places[end - 1]))
        lines = stored.pieces(low, high, NUMBER)
        found = _hits(lines.where(ahead) if at == 0 else lines, term).agg(pick(number)).first()[0]
        if found is not None:
            return found
        at, width = end, 2 * width
    return None


def find_from(numbered: Numbered, term: str, position: int) -> DataFrame:
    """First hit at or after ``position``, wrapping around."""
    return _hit_position(numbered, term, position, forward=True)


def find_next(numbered: Numbered, term: str, position: int) -> DataFrame:
    return _hit_position(numbered, term, position + 1, forward=True)


def find_previous(numbered: Numbered, term: str, position: int) -> DataFrame:
    return _hit_position(numbered, term, position - 1, forward=False)


def find_spans(numbered: DataFrame, term: str) -> DataFrame:
    """Occurrences ``(doc_line_no, start, length)`` of a term, in bytes from 0.

    They do not overlap and never span a space, so a term with a space has none.
    """
    needle = ascii_lower_str(term)
    if needle == "" or " " in needle:
        return numbered.select(
            "doc_line_no", F.lit(0).alias("start"), F.lit(0).alias("length")
        ).where("false")
    # Splitting at the needle leaves the text between the occurrences, left to right.
    hits = numbered.where(ascii_icontains(F.col("line"), term))
    pieces = F.split(ascii_lower(F.col("line")), java_literal(needle), -1)
    width = len(needle.encode())
    lengths = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda gap: F.octet_length(gap))
    gaps = hits.select("doc_line_no", F.posexplode(lengths).alias("i", "gap"))
    # start of occurrence i = all gaps up to i, plus i earlier occurrences
    so_far = Window.partitionBy("doc_line_no").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    start = F.sum("gap").over(so_far) + F.col("i") * width
    return gaps.select("doc_line_no", start.cast("int").alias("start"), F.lit(width).alias("length"))


def slice_lines(numbered: Numbered, first: int, last: int) -> DataFrame:
    """Visible lines ``first`` to ``last``, both included."""
    if isinstance(numbered, NumberedStore):
        return numbered.between(first, last, NUMBER)
    return numbered.where(F.col("doc_line_no").between(first, last))


def head_lines(document: DataFrame, n: int) -> DataFrame:
    return document.orderBy(*ORDER).limit(n)


def tail_lines(document: DataFrame, n: int) -> DataFrame:
    """The last ``n`` lines, without numbering or sorting the document."""
    return document.orderBy(*[F.col(c).desc() for c in ORDER]).limit(n)


def entry_context(document: DataFrame, predicate: Column) -> DataFrame:
    """All lines of the entries that have a line matching ``predicate``."""
    entry = ["file_ord", "entry_no"]
    hits = store(document.where(predicate).select(*entry).distinct(), "hits")
    n_hits = hits.count()
    if n_hits > joins.BROADCAST_ROWS:  # matched in parts, which takes the lengths of these entries
        sizes = document.groupBy(*entry).agg(F.count("*").alias("n_lines"))
        hits = sizes.join(hits, entry, "left_semi")
    return joins.whole_entries(document, hits, at_most=n_hits)


def entry_at(document: DataFrame, numbered: Numbered, position: int) -> DataFrame:
    """All lines, visible or not, of the entry that owns the visible line at ``position``."""
    owner = slice_lines(numbered, position, position).select("file_ord", "entry_no")
    return document.join(F.broadcast(owner), ["file_ord", "entry_no"], "left_semi")
