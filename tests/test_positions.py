"""The positional store: pages and searches that read only the files they need."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from logweave.operators import search
from logweave.operators.numbering import NumberedStore

LINES = 3_000


@pytest.fixture(scope="module")
def document(spark):
    rng = np.random.default_rng(2)
    rows = [(f"{int(rng.integers(60)):02d}", i % 3, i, 0, f"word{i % 50} needle{i}" if i % 400 == 7 else f"word{i % 50}") for i in range(LINES)]
    return spark.createDataFrame(rows, "sort_key string, file_ord bigint, entry_no bigint, line_in_entry bigint, line string").repartition(7).cache()


@pytest.fixture(scope="module")
def stored(spark, document):
    """Several pieces, though the lines are few."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        return search.store_lines(document)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def plan_of(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_numbers_follow_the_order(document, stored):
    want = [r.line for r in document.orderBy(*search.ORDER).collect()]
    got = {r.doc_line_no: r.line for r in stored.rows("doc_line_no").collect()}
    assert got == dict(enumerate(want)) and stored.count() == LINES and len(stored.zones) > 2
    again = NumberedStore(stored.spark, stored.path)
    assert again.zones == stored.zones
    for first, last in [(0, 0), (5, 17), (-4, 3), (LINES - 2, LINES + 9), (0, LINES), (9, 8), (-9, -1), (LINES, LINES + 1), (700, 2400)]:
        page = search.slice_lines(again, first, last).orderBy("doc_line_no").collect()
        assert [(r.doc_line_no, r.line) for r in page] == [(k, want[k]) for k in range(max(first, 0), min(last, LINES - 1) + 1)]


def test_a_page_reads_one_file(stored):
    piece, first, n = stored.zones[1]
    page = search.slice_lines(stored, first + 3, first + 8)
    plan = plan_of(page)
    assert "(piece#" in plan and f"= {piece})" in plan and "PushedFilters: [IsNotNull(rank), GreaterThanOrEqual(rank,3), LessThanOrEqual(rank,8)]" in plan
    assert page.select(F.input_file_name()).distinct().count() == 1 and page.count() == 6
    assert search.entry_at(stored.rows("doc_line_no"), stored, first).count() >= 1


@pytest.mark.parametrize("term", ["needle", "NEEDLE407", "absent", ""])
def test_searches_of_the_store_find_what_scans_find(spark, stored, term):
    lines = stored.rows("doc_line_no").cache()
    edges = [first + k for _, first, _ in stored.zones for k in (-1, 0)]
    for position in {0, 1500, LINES - 1, *edges[2:4]}:
        for find in (search.find_from, search.find_next, search.find_previous):
            assert find(stored, term, position).collect() == find(lines, term, position).collect(), (find, position)


def test_a_search_close_by_reads_one_piece(stored, monkeypatch):
    read = []
    pieces = NumberedStore.pieces
    monkeypatch.setattr(NumberedStore, "pieces", lambda self, low, high, name: read.append((low, high)) or pieces(self, low, high, name))
    assert search.nearest_hit(stored, "word", stored.zones[1][1]) == stored.zones[1][1]
    assert read == [(1, 1)]
    read.clear()
    assert search.nearest_hit(stored, "absent", 0) is None
    assert read[0] == (0, 0) and sum(high - low + 1 for low, high in read) == len(stored.zones) + 1


def test_an_empty_store(spark, document):
    empty = search.store_lines(document, F.lit(False))
    for stored in (empty, NumberedStore(spark, empty.path)):
        assert stored.count() == 0 and stored.rows("doc_line_no").count() == 0
        assert search.slice_lines(stored, 0, 9).columns == search.slice_lines(search.store_lines(document), 0, 9).columns
        assert search.find_from(stored, "x", 0).collect()[0].position is None
