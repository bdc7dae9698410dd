import random

import pytest
from pyspark.sql import functions as F

from logweave.functions.filters import substring_filter
from logweave.functions.timestamps import TimestampFormat
from logweave.operators import entries as entries_module, joins, search, stats
from logweave.operators.detect import file_formats
from logweave.operators.merge import dedup_entries, line_hash, merge_chronological
from logweave.operators.entries import build_document, entry_contents
from logweave.operators.sinks import write_merged
from logweave.operators.staging import stage
from logweave.plans.merge_plan import parse_logs, reread_merged
from logweave.sources.catalog import BUILT_IN_FORMATS
from logweave.sources.logs import read_files
from tests import model

TWO_FORMATS = [
    TimestampFormat("logback", "yyyy-MM-dd HH:mm:ss.SSS"),
    TimestampFormat("plain", "yyyy-MM-dd HH:mm:ss"),
]


def write(folder, name, content):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def merged_entries(document):
    """``[(sort_key, [lines])]`` in merged order."""
    entries, last = [], None
    for r in merge_chronological(document).collect():
        if (r.file_ord, r.entry_no) != last:
            assert r.line_in_entry == 0
            entries.append((r.sort_key, []))
            last = (r.file_ord, r.entry_no)
        assert r.line_in_entry == len(entries[-1][1])
        entries[-1][1].append(r.line)
    return entries


def parse(spark, paths, formats=BUILT_IN_FORMATS, **options):
    return parse_logs(read_files(spark, paths), formats, **options)


def test_continuation_lines(spark, tmp_path):
    path = write(tmp_path, "app.log", (
        "2031-02-11 07:05:09.250 INFO pump opened\n\tvalve 7, set by plant.control (Gauge.kt:88)\n"
        "    pressure 3.1 bar\n2031-02-11 07:05:41.004 INFO tank drained\n"
    ))
    parsed = parse(spark, [path], TWO_FORMATS)
    entries = merged_entries(parsed.document)
    assert [(k, len(lines)) for k, lines in entries] == [
        ("2031-02-11 07:05:09.250000000", 3), ("2031-02-11 07:05:41.004000000", 1)
    ]
    assert parsed.report().first().format == "logback"
    contents = [r.content for r in entry_contents(parsed.document).orderBy("entry_no").collect()]
    assert contents[1] == "2031-02-11 07:05:41.004 INFO tank drained\n"
    assert contents[0].count("\n") == 3


def test_line_ends_and_preamble(spark, tmp_path):
    path = write(tmp_path, "crlf.log", (
        b"control room log\r\n2031-02-11 07:05:09.250 INFO shift starts\r\n2031-02-11 15:05:00.750 INFO shift ends"
    ))
    assert merged_entries(parse(spark, [path]).document) == [
        ("", ["control room log"]),
        ("2031-02-11 07:05:09.250000000", ["2031-02-11 07:05:09.250 INFO shift starts"]),
        ("2031-02-11 15:05:00.750000000", ["2031-02-11 15:05:00.750 INFO shift ends"]),
    ]


def test_odd_line_ends(spark, tmp_path):
    path = write(tmp_path, "odd.log", b"a\rb\n\r\n\nx\r\r\n\xff\xfe\n")
    lines = [r.line for r in read_files(spark, [path]).lines.selectExpr("hex(line) line").collect()]
    assert lines == ["610D62", "", "", "780D", "FFFE"]


def test_empty_file_has_no_entries_and_no_format(spark, tmp_path):
    paths = [write(tmp_path, "empty.log", ""), write(tmp_path, "text.log", "no\ntimestamps\n")]
    parsed = parse(spark, paths)
    assert [(r.format, r.votes, r.via) for r in parsed.report().orderBy("file_ord").collect()] == [
        (None, 0, None), (None, 0, None)
    ]
    assert merged_entries(parsed.document) == [("", ["no", "timestamps"])]


def test_majority_decides_and_pins_the_format(spark, tmp_path):
    path = write(tmp_path, "a.log", (
        "2031-02-03 04:05:06 cold start\n2031-02-03 04:05:07.1 pump on\n"
        "2031-02-03 04:05:08.25 pump off\n2031-02-03 04:05:09 halted\n"
    ))
    parsed = parse(spark, [path], TWO_FORMATS)
    report = parsed.report().first()
    assert (report.format, report.votes) == ("logback", 2)
    assert [lines for _, lines in merged_entries(parsed.document)] == [
        ["2031-02-03 04:05:06 cold start"],
        ["2031-02-03 04:05:07.1 pump on"],
        ["2031-02-03 04:05:08.25 pump off", "2031-02-03 04:05:09 halted"],
    ]


def test_a_tie_goes_to_the_earlier_format(spark, tmp_path):
    path = write(tmp_path, "a.log", "2031-02-03 04:05:00 x\n2031-02-03 04:05:01.100 a\n")
    assert parse(spark, [path], TWO_FORMATS).report().first().format == "logback"
    assert parse(spark, [path], TWO_FORMATS[::-1]).report().first().votes == 2


def test_only_the_sample_votes(spark, tmp_path):
    tail = "2031-02-03 04:05:00.5 x\n" * 9
    path = write(tmp_path, "a.log", "2031-02-03 04:05:00 x\n" + "junk\n" * 4 + tail)
    for sample, expected in [(5, "plain"), (6, "logback"), (7, "logback")]:
        staged = stage(read_files(spark, [path]), TWO_FORMATS, run_bits=1)
        best = file_formats(staged, sample_lines=sample).first()
        assert TWO_FORMATS[best.fmt_idx].name == expected, sample


def test_late_format(spark, tmp_path):
    path = write(tmp_path, "a.log", "junk\n" * 2500 + "2031-02-03 04:05:00 x\n" + "2031-02-03 04:05:00.5 x\n" * 9)
    report = parse(spark, [path], TWO_FORMATS).report().first()
    assert (report.format, report.via, report.votes) == ("plain", "first_match", 0)


def random_log(rng, n, stamps):
    out = []
    for _ in range(n):
        roll = rng.random()
        if roll < 0.35:
            out.append(f"{rng.choice(stamps)}{rng.randrange(3)} {rng.choice(['INFO', 'error', ''])} m{rng.randrange(4)}")
        elif roll < 0.9:
            out.append(rng.choice(["\tat a", "\tat b", "", "x" * rng.randrange(300)]))
        else:
            out.append("2026-01-01 00:00:00 other")
    end = rng.choice(["\n", "\r\n"])
    return end.join(out) + rng.choice(["", end])


STAMPS = ["2026-01-02 03:04:05.", "2026-01-02 03:04:0", "02/Jan/2026:03:04:0", "Jan 02 03:04:0"]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("run_bits", [2, 20])
def test_merge_and_dedup_equal_the_sequential_model(spark, tmp_path, seed, run_bits):
    """Many small splits and runs; entries and preambles span several of them."""
    rng = random.Random(seed)
    contents, paths = [], []
    for i in range(4):
        content = random_log(rng, rng.choice([0, 3, 200, 400]), rng.sample(STAMPS, 2)).encode()
        contents.append(content)
        paths.append(write(tmp_path, f"{i}.log", content))
    order = [0, 1, 2, 3, 1]
    contents = [contents[i] for i in order]
    source = read_files(spark, [paths[i] for i in order])
    staged = stage(source, BUILT_IN_FORMATS, run_bits)
    document = build_document(staged, file_formats(staged, sample_lines=30))
    assert merged_entries(document) == model.merge(contents, BUILT_IN_FORMATS, sample=30)
    assert merged_entries(dedup_entries(document)) == model.merge(
        contents, BUILT_IN_FORMATS, dedup=True, sample=30
    )


def document_of(spark, entries):
    rows = [
        ("f", 0, number, at, key, 0, line)
        for number, (key, lines) in enumerate(entries) for at, line in enumerate(lines)
    ]
    return spark.createDataFrame(
        rows,
        "file string, file_ord bigint, entry_no bigint, line_in_entry bigint, sort_key string, "
        "timestamp_length int, line string",
    )


def test_merge_is_stable(spark):
    entries = [("7b", ["left"]), ("7b", ["right"]), ("7a", ["older"]), ("", ["bare"]), ("7b", ["far right"])]
    merged = merged_entries(document_of(spark, entries))
    assert [lines[0] for _, lines in merged] == ["bare", "older", "left", "right", "far right"]


# An entry, a copy of it, and entries that share only its head, its tail or its lines in another order.
DUPLICATES = [("1", ["disk 4 slow", "  queue=19"]), ("2", ["fan ok"]), ("3", ["disk 4 slow"]),
              ("4", ["disk 4 slow", "  queue=19"]), ("5", ["  queue=19"]), ("6", ["  queue=19", "disk 4 slow"])]


def test_dedup_keeps_the_first(spark):
    kept = merged_entries(dedup_entries(document_of(spark, DUPLICATES)))
    assert [key for key, _ in kept] == ["1", "2", "3", "5", "6"]


def test_dedup_survives_colliding_fingerprints(spark):
    """The first seed gives every line the same hash, the next one is sound."""
    entries = [("1", ["aa"]), ("2", ["bb"]), ("3", ["aa"]), ("4", ["x", "y"]), ("5", ["y", "x"])]
    used = []

    def weak_then_sound(seed):
        used.append(seed)
        return F.lit(7).cast("bigint") if seed < 2 else line_hash(seed)

    kept = merged_entries(dedup_entries(document_of(spark, entries), hashes=weak_then_sound))
    assert [key for key, _ in kept] == ["1", "2", "4", "5"]
    assert used == [0, 1, 2, 3]
    with pytest.raises(RuntimeError):
        dedup_entries(document_of(spark, entries), hashes=weak_then_sound, seeds=[0])


def test_entries_longer_than_a_join_part(spark, monkeypatch):
    monkeypatch.setattr("logweave.operators.joins.PART_LINES", 3)
    entries = [("1", [f"l{i}" for i in range(10)]), ("2", ["z"] * 3), ("3", [f"l{i}" for i in range(10)])]
    kept = merged_entries(dedup_entries(document_of(spark, entries)))
    assert kept == entries[:2]


def test_joins_beyond_the_broadcast_limit(spark, monkeypatch, tmp_path):
    """The same results when no table counts as small: hot keys are split off."""
    monkeypatch.setattr("logweave.operators.joins.BROADCAST_ROWS", 0)
    monkeypatch.setattr("logweave.operators.joins.HOT_SHARE", 3)
    entries = [(f"{i:03}", ["same"] if i % 2 else [f"other {i}", "x"]) for i in range(40)]
    kept = merged_entries(dedup_entries(document_of(spark, entries)))
    assert kept == [entries[0], entries[1], *entries[2::2]]
    rng = random.Random(7)
    contents = [random_log(rng, 200, STAMPS[:2]).encode() for _ in range(2)]
    paths = [write(tmp_path, f"{i}.log", c) for i, c in enumerate(contents)]
    document = parse(spark, paths, run_bits=3).document
    assert merged_entries(document) == model.merge(contents, BUILT_IN_FORMATS)


SAMPLE = [
    ("1", ["2031-02-11 07:05:09.250 INFO pump opened", "  valve=7 (Gauge.kt:88)"]),
    ("2", ["2031-02-11 07:05:41.004 ERROR pump stalled"]),
    ("3", ["2031-02-11 07:06:00.125 INFO tank drained"]),
]


@pytest.fixture
def sample(spark):
    return document_of(spark, SAMPLE)


def position(df):
    return df.first().position


def test_runs_are_looked_up_by_one_number(spark, monkeypatch):
    rows = spark.range(60).select((F.col("id") % 7).alias("a"), (F.col("id") % 3 - 1).alias("b"), "id")
    table = spark.createDataFrame([(0, -1, "x"), (1, 0, "y"), (6, 1, "z"), (9, 9, "none")], "a bigint, b bigint, v string")
    expected = rows.join(table, ["a", "b"])
    for hashes in (F.xxhash64, lambda *keys: F.lit(7).cast("bigint")):  # also if all keys share a hash
        with monkeypatch.context() as patch:
            patch.setattr(F, "xxhash64", hashes)
            joined = joins.attach(rows, table, ["a", "b"], 4)
        assert joined.columns == expected.columns
        assert sorted(joined.collect()) == sorted(expected.collect())
    plan = joins.attach(rows, table, ["a", "b"], 4)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [key_hash" in plan


def test_numbering_and_slices(spark, sample):
    numbered = search.number_lines(sample)
    assert [(r.doc_line_no, r.line) for r in numbered.orderBy("doc_line_no").collect()] == list(
        enumerate(line for _, lines in SAMPLE for line in lines)
    )
    visible = search.number_lines(sample, substring_filter("info"))
    assert [r.line.split()[-1] for r in visible.orderBy("doc_line_no").collect()] == ["opened", "drained"]
    assert search.slice_lines(numbered, 1, 2).count() == 2
    assert search.head_lines(sample, 1).first().line.endswith("opened")
    assert [r.line.split()[-1] for r in search.tail_lines(sample, 1).collect()] == ["drained"]
    counts = search.line_counts(sample, substring_filter("info && !drained")).first()
    assert (counts.visible_lines, counts.total_lines) == (1, 4)
    whole = search.entry_at(sample, visible, 0)
    assert sorted(r.line for r in whole.collect()) == sorted(SAMPLE[0][1])


def test_numbering_over_many_partitions(spark):
    entries = [(f"{i % 97:02}", [f"{i}", "more"]) for i in range(2000)]
    document = document_of(spark, entries)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        numbered = search.number_lines(document)
        got = [(r.doc_line_no, r.line) for r in numbered.orderBy("doc_line_no").collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    expected = [line for _, lines in sorted(entries, key=lambda e: e[0]) for line in lines]
    assert got == list(enumerate(expected))


def test_find_wraps_in_both_directions(spark, sample):
    numbered = search.number_lines(sample)
    assert position(search.find_from(numbered, "drained", 0)) == 3
    assert position(search.find_next(numbered, "drained", 3)) == 3
    assert position(search.find_from(numbered, "INFO", 0)) == 0
    assert position(search.find_next(numbered, "INFO", 0)) == 3
    assert position(search.find_next(numbered, "INFO", 3)) == 0
    assert position(search.find_previous(numbered, "INFO", 0)) == 3
    assert position(search.find_previous(numbered, "pump stalled", 0)) == 2
    assert position(search.find_from(numbered, "nothing here", 3)) is None
    assert position(search.find_from(numbered, "", 3)) is None


def test_find_spans(spark):
    document = document_of(spark, [("1", ["aAa baab", "é éa AA", "none"])])
    spans = search.find_spans(search.number_lines(document), "aa").orderBy("doc_line_no", "start")
    assert [tuple(r) for r in spans.collect()] == [(0, 0, 2), (0, 5, 2), (1, 7, 2)]
    assert search.find_spans(search.number_lines(document), "a b").count() == 0


def test_headers_and_levels(spark, sample):
    assert stats.visible_headers(sample).count() == 3
    hidden = stats.visible_headers(sample, substring_filter("Gauge.kt"))
    assert [r.header for r in hidden.collect()] == [SAMPLE[0][1][0]]
    counts = stats.level_share(stats.level_counts(stats.visible_headers(sample)))
    assert [tuple(r) for r in counts.collect()] == [("INFO", 2, 3, 66.67), ("ERROR", 1, 3, 33.33)]
    assert stats.level_share(stats.level_counts(hidden.limit(0))).count() == 0


def test_tied_levels_come_in_order_of_appearance(spark):
    entries = [("2", ["warning"]), ("1", ["x fatal"]), ("3", ["debug"]), ("4", ["plain"]), ("5", ["WARN"])]
    counts = stats.level_counts(stats.visible_headers(document_of(spark, entries)))
    assert [tuple(r) for r in counts.collect()] == [("WARN", 2), ("FATAL", 1), ("DEBUG", 1), ("(none)", 1)]


def test_entry_context(spark, sample):
    context = search.entry_context(sample, substring_filter("GAUGE.KT"))
    assert sorted(r.line for r in context.collect()) == sorted(SAMPLE[0][1])


def test_a_merged_log_in_many_parts_is_one_log(spark, tmp_path):
    """Entries cross part files; only the first part may begin with a preamble."""
    content = "".join(
        f"2026-01-01 00:{i // 60:02}:{i % 60:02}.0 m\n" + "\tat x\n" * 7 for i in range(300)
    ).encode()
    document = parse(spark, [write(tmp_path, "a.log", content)]).document
    out = str(tmp_path / "merged.log")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_merged(document, out)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    again = reread_merged(spark, out)
    assert merged_entries(again.document) == model.merge([content], BUILT_IN_FORMATS)
    assert again.report().count() == 1
    assert len(merged_entries(reread_merged(spark, out, dedup=True).document)) == 300


@pytest.mark.parametrize("part_bytes, block_lines", [(1, 2), (40, 3), (700, 5), (1 << 20, 2)])
def test_long_entries_come_in_parts(spark, monkeypatch, part_bytes, block_lines):
    monkeypatch.setattr(entries_module, "BLOCK_LINES", block_lines)
    rows = [("k", 0, n, k, f"line {k} " + "é" * (k * n % 17)) for n, size in enumerate([1, 3, 60, 200]) for k in range(size)]
    document = spark.createDataFrame(rows, "sort_key string, file_ord bigint, entry_no bigint, line_in_entry bigint, line string").repartition(5)
    got = sorted(entry_contents(document, part_bytes).collect(), key=lambda r: (r.entry_no, r.part))
    for n, size in enumerate([1, 3, 60, 200]):
        own = [r for r in got if r.entry_no == n]
        lines = [line for *_, entry, _, line in rows if entry == n]
        assert "".join(r.content for r in own) == "".join(line + "\n" for line in lines)
        assert {r.n_lines for r in own} == {size}
        longest = max(len(line.encode()) + 1 for line in lines)
        assert all(len(r.content.encode()) <= part_bytes + longest for r in own)
        start = 0
        for r in own:
            assert r.part == start // part_bytes
            start += len(r.content.encode())


def test_paths_are_not_written_with_every_line(spark, tmp_path):
    names = ["plain.log", "odd 50% é+.log", "more+.log"]
    broken = b"2031-02-03 04:05:06." + b"1" * 40 + b" \xff\xc3 long\n"
    paths = [write(tmp_path, name, b"first\n2031-02-03 04:05:06.5 " + b"x" * 60 + b"\xff\xe9\n\tmore\n\n" + broken) for name in names]
    staged = stage(read_files(spark, paths), BUILT_IN_FORMATS, run_bits=1)
    assert "file" not in staged.lines.columns
    assert {r.escaped is None for r in staged.lines.where("escaped IS NULL OR escaped LIKE '%odd%'").collect()} == {True, False}
    document = build_document(staged, file_formats(staged)).selectExpr("file", "entry_no", "line_in_entry", "hex(line) AS line")
    for name, path in zip(names, paths):
        lines = document.where(F.col("file").endswith("/" + name)).orderBy("entry_no", "line_in_entry").collect()
        assert b"".join(bytes.fromhex(r.line) + b"\n" for r in lines) == open(path, "rb").read(), path
