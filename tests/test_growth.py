"""The stream of what log files gain: planning, the ledger, and whole streams against a parse of the final files."""

import gzip
import os
import time

import pytest
from pyspark.sql import functions as F

from logweave.functions.timestamps import TimestampFormat, stamp_of
from logweave.plans.merge_plan import merge_directory, parse_logs
from logweave.sources.catalog import BUILT_IN_FORMATS
from logweave.sources.listing import Exclusion, LogFile
from logweave.sources.logs import read_tree
from logweave.streaming import growth, new_files
from logweave.streaming.growth import Known, Ledger, plan
from logweave.streaming.new_files import stream_new_files, streamed_document, streamed_warnings
from tests.test_documents import write

HEADER = "2031-02-03 04:05:{:02d}.250 WARN {}\n"


def listed(path):
    status = os.stat(path)
    return LogFile(f"file:{path}", status.st_mtime_ns // 1000, status.st_size)


def planned(path, known=None, settled=False):
    got = plan(listed(path), known, settled)
    return got and (got.begin, got.until, got.gen)


def test_stretches_end_with_whole_lines(tmp_path, monkeypatch):
    monkeypatch.setattr(growth, "_TAIL", 3)
    path = write(tmp_path, "a.log", "one\ntwo\nthr")
    assert planned(path) == (0, 8, 0)
    assert planned(path, settled=True) == (0, 11, 0)
    known = plan(listed(path), None, False)
    assert planned(path, known) == (8, 11, 0)  # as it was: the rest is taken for a line
    write(tmp_path, "a.log", "one\ntwo\nthree\nfour\n")
    assert planned(path, known) == (8, 19, 0)
    rest = plan(listed(path), known, False)
    assert plan(listed(path), rest, False) is None
    open_end = plan(listed(write(tmp_path, "b.log", "one\ntw")), None, True)
    assert (open_end.until, open_end.rest) == (6, True)
    assert planned(write(tmp_path, "b.log", "one\ntwo\n"), open_end) == (0, 8, 1)  # a line that was taken goes on
    assert planned(write(tmp_path, "c.log", "no newline at all")) == (0, 0, 0)
    assert planned(write(tmp_path, "d.log", "")) == (0, 0, 0)


def test_files_written_anew_start_again(tmp_path):
    path = write(tmp_path, "a.log", "one\ntwo\n")
    known = plan(listed(path), None, False)
    write(tmp_path, "a.log", "one\n")
    assert planned(path, known) == (0, 4, 1)
    write(tmp_path, "a.log", "ONE\nTWO\nthree\n")
    assert planned(path, known) == (0, 14, 1)
    write(tmp_path, "a.log", "one\ntwo\n")
    os.utime(path, (1, 1))
    assert planned(path, known) == (0, 8, 1)
    zipped = write(tmp_path, "a.log.gz", gzip.compress(b"x\n"))
    known = plan(listed(zipped), None, False)
    assert plan(listed(zipped), known, False) is None
    write(tmp_path, "a.log.gz", gzip.compress(b"x\n") + gzip.compress(b"y\n"))
    assert planned(zipped, known) == (0, os.path.getsize(zipped), 1)
    os.remove(zipped)
    gone = plan(LogFile(f"file:{zipped}x", 1, 5), None, False)
    assert (gone.begin, gone.until) == (0, 5)  # its reader warns


def test_ledger_keeps_what_was_planned(tmp_path):
    ledger = Ledger(f"file:{tmp_path}/ledger")
    assert ledger.known() == ({}, -1)
    rows = [Known(f"file:/{k}", k, k, 0, k, 0, False, k) for k in range(5)]
    ledger.write("delta", 0, rows[:3])
    ledger.write("delta", 1, [])
    ledger.write("full", 1, rows[:3])
    ledger.write("delta", 2, rows[2:])
    want = {row.path: row for row in rows}, 2
    assert ledger.known() == want
    ledger.forget(0)
    assert len(os.listdir(tmp_path / "ledger")) == 4
    ledger.forget(2)
    assert sorted(os.listdir(tmp_path / "ledger")) == ["delta-000000000002.parquet", "full-000000000001.parquet"]
    assert Ledger(str(tmp_path / "ledger")).known() == want


def test_reader_goes_on_after_a_restart(tmp_path):
    root = tmp_path / "logs"
    for name in ("a", "b", "c", ".hidden/x", "out/part-0"):
        write(root, name, f"{name}\n")
    options = {"root": f"file:{root}", "ledger": f"file:{tmp_path}/ledger", "outputs": f'["file:{root}/out"]', "maxfiles": "3"}

    def units(reader, start, end):
        return sorted(os.path.basename(u["path"]) for p in reader.partitions(start, end) for b in reader.read(p) for u in b.to_pylist())

    reader = growth.GrowthReader(options)
    start = reader.initialOffset()
    first = reader.latestOffset()
    again = growth.GrowthReader(options)  # as after a restart; nothing is planned twice
    second = again.latestOffset()
    assert len(units(again, start, first)) == 3 and len(units(again, first, second)) == 1
    assert units(again, start, second) == ["a", "b", "c", "x"]
    assert again.latestOffset() == second and again.partitions(second, second) == []
    write(root, "a", "a\nmore\n")
    third = again.latestOffset()
    rows = [u for p in again.partitions(second, third) for b in again.read(p) for u in b.to_pylist()]
    assert [(u["begin"], u["until"]) for u in rows] == [(2, 7)]
    again.commit(third)


def test_trees_listed_by_the_arrow_client(tmp_path):
    for name in ("b.log", ".hidden", "_x/c.log", "out/part-0"):
        write(tmp_path, name, "x\n")
    root = f"file://{tmp_path}"
    found = growth._list_client(root, Exclusion(None, f"{root}/out"), True)
    assert sorted(f.path.removeprefix(root) for f in found.files) == ["/.hidden", "/_x/c.log", "/b.log"]
    assert [f.length for f in found.files] == [2, 2, 2]
    assert len(growth._list_client(root, Exclusion(None), False).files) == 2


def rows_of(document):
    return sorted(
        (os.path.basename(r.file), r.entry_no, r.line_in_entry, r.sort_key, r.timestamp_length, r.line) for r in document.collect()
    )


def followed(spark, root, tmp_path, **options):
    stream_new_files(spark, str(root), str(tmp_path / "out"), str(tmp_path / "offsets"), once=True, **options).awaitTermination(120)
    return streamed_document(spark, str(tmp_path / "out"))


@pytest.mark.parametrize("settled_lines", [2_000, 3])
def test_a_stream_of_growing_files_gives_what_a_parse_of_all_gives(spark, tmp_path, monkeypatch, settled_lines):
    """Small files are parsed anew while their format may still change; later on only new bytes are read."""
    monkeypatch.setattr(new_files, "SAMPLE_LINES", settled_lines)
    read = []
    stretches = new_files.read_stretches
    monkeypatch.setattr(new_files, "read_stretches", lambda s, r: read.append({os.path.basename(p): b for p, b, _ in r}) or stretches(s, r))
    root = tmp_path / "logs"
    entry = HEADER.format(1, "x") + "\tat a\n\tat b\n"
    write(root, "a.log", "banner\n" + entry * 3)
    write(root, "banner.log", "only\na\nbanner\nso far\n")
    write(root, ".hidden.log", HEADER.format(2, "h") + "\tpart")
    write(root, "sub/_x/z.gz", gzip.compress(HEADER.format(3, "z").encode()))
    write(root, "same.log", entry)
    write(root, "shrunk.log", entry * 5)
    assert rows_of(followed(spark, root, tmp_path, max_files=2)) == rows_of(parse_logs(read_tree(spark, str(root))).document)
    with open(root / "a.log", "a") as log:
        log.write("\tat c\n" + entry + "\tcut o")
    with open(root / ".hidden.log", "a") as log:
        log.write("ial line\n\tnext\n")
    with open(root / "banner.log", "a") as log:
        log.write("more\n" + entry)
    write(root, "sub/_x/z.gz", gzip.compress(HEADER.format(3, "z").encode() * 2))
    write(root, "shrunk.log", HEADER.format(9, "new"))
    write(root, "late.log", entry)
    read.clear()
    assert rows_of(followed(spark, root, tmp_path)) == rows_of(parse_logs(read_tree(spark, str(root))).document)
    begun = {name: begin for part in read for name, begin in part.items()}
    assert "same.log" not in begun and begun[".hidden.log"] == 0
    assert (begun["a.log"] > 0, begun["banner.log"] > 0) == (settled_lines == 3,) * 2
    with open(root / "a.log", "a") as log:
        log.write("ff\n" + HEADER.format(5, "end"))
    with open(root / "banner.log", "a") as log:
        log.write("\tat y\n")
    assert rows_of(followed(spark, root, tmp_path)) == rows_of(parse_logs(read_tree(spark, str(root))).document)
    read.clear()
    followed(spark, root, tmp_path)
    assert not any(read)


def test_a_running_stream_waits_for_the_end_of_a_line(spark, tmp_path):
    root, out = tmp_path / "logs", str(tmp_path / "out")
    write(root, "a.log", HEADER.format(1, "a"))
    query = stream_new_files(spark, str(root), out, str(tmp_path / "offsets"), max_files=1)
    try:
        query.processAllAvailable()
        assert [r.line.split()[-1] for r in streamed_document(spark, out).collect()] == ["a"]
        for n in range(2, 4):
            with open(root / "a.log", "a") as log:
                log.write(HEADER.format(n, f"line{n}"))
            write(root, f"new{n}.log", HEADER.format(n, f"new{n}"))
            deadline = time.time() + 60
            while time.time() < deadline and streamed_document(spark, out).count() < 2 * n - 1:
                query.processAllAvailable()
        assert sorted(r.line.split()[-1] for r in streamed_document(spark, out).collect()) == ["a", "line2", "line3", "new2", "new3"]
    finally:
        query.stop()


def test_the_stream_does_not_read_outputs(spark, tmp_path):
    """An output folder in the tree, one that is written between batches, and the stream's own folders."""
    root = tmp_path / "logs"
    write(root, "a.log", HEADER.format(1, "a"))
    write(root, "merged.log.old", HEADER.format(2, "kept"))
    merged = str(root / "merged.log")
    options = dict(exclude=merged, once=True)

    def lines():
        stream_new_files(spark, str(root), str(root / "streamed"), str(root / "offsets"), **options).awaitTermination(120)
        return sorted(r.line.split()[-1] for r in streamed_document(spark, str(root / "streamed")).collect())

    assert lines() == ["a", "kept"]
    merge_directory(spark, str(root), output=merged, include_hidden=False)
    assert (root / "merged.log").is_dir()
    write(root, "b.log", HEADER.format(3, "b"))
    assert lines() == ["a", "b", "kept"]
    os.symlink(root, tmp_path / "alias")
    assert Exclusion(spark, str(tmp_path / "alias" / "merged.log")).matches(f"file:{root}/merged.log/part-0")
    assert not Exclusion(spark, merged).matches(f"file:{root}/merged.log.old")


def test_a_mended_file_is_read_when_it_changes(spark, tmp_path):
    root = tmp_path / "logs"
    sound = gzip.compress("".join(HEADER.format(1, f"a{n * n}") for n in range(99)).encode())
    write(root, "a.gz", sound[:60] + b"\xff" * 60 + sound[120:])
    write(root, "b.log", HEADER.format(1, "b"))
    assert followed(spark, root, tmp_path).count() == 1
    assert [os.path.basename(r.path) for r in streamed_warnings(spark, str(tmp_path / "out")).collect()] == ["a.gz"]
    write(root, "a.gz", sound)
    assert followed(spark, root, tmp_path).count() == 100


def test_states_come_from_what_was_written(spark, tmp_path, monkeypatch):
    root, out = tmp_path / "in", str(tmp_path / "out")
    root.mkdir()
    for n in range(6):
        (root / f"a b+{n}.log").write_text("".join(f"2031-02-03 04:05:0{k} INFO {n}\n\tmore\n" for k in range(n)))
    parsed = []

    def watched(*args, **options):
        parsed.append(new_files_parse(*args, **options))
        return parsed[-1]

    new_files_parse = new_files.parse_logs
    monkeypatch.setattr(new_files, "parse_logs", watched)
    write = new_files._write_states

    def unparsed(*args):
        for one in parsed:
            one.document = one.staged = None
        write(*args)

    monkeypatch.setattr(new_files, "_write_states", unparsed)
    stream_new_files(spark, str(root), out, str(tmp_path / "offsets"), once=True, max_files=2).awaitTermination()
    states = {r.path[-5]: (r.lines, r.headers, r.open_line) for r in new_files._states(spark, out).collect()}
    assert states == {str(n): (2 * n, n, 2 * n - 2) for n in range(1, 6)}
    assert len(parsed) == 3


def test_states_are_gathered_now_and_then(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(new_files, "_ALL_STATES_EVERY", 2)
    root = tmp_path / "logs"
    for n in range(3):
        write(root, f"{n}.log", HEADER.format(n, n))
        with open(root / "0.log", "a") as log:
            log.write(HEADER.format(n, "again"))
        document = followed(spark, root, tmp_path)
    assert rows_of(document) == rows_of(parse_logs(read_tree(spark, str(root))).document)
    assert (tmp_path / "out" / "_all_states").is_dir()


def test_stamps_give_the_keys_of_whole_lines(spark):
    formats = [*BUILT_IN_FORMATS, TimestampFormat("odd", "SSS|yyyy-MM-dd|HH:mm:ss.SSS EEE MMM a>")]
    stamp = {"yyyy": "2031", "MMM": "sept.", "MM": "02", "dd": "03", "HH": "04", "hh": "05", "mm": "06", "ss": "07", "EEE": "mer.", "a": "pm"}
    rows = []
    for number, fmt in enumerate(formats):
        for digits in ("1", "123456789", "1" * 16, "2" * 17, "3" * 18, "4" * 400):
            line = "".join({**stamp, "SSS": digits}.get(token, token) for token in fmt.tokens)
            rows += [(number, line + rest) for rest in ("", " text", "5" * 30 + " long", "é" * 99)]
    lines = spark.createDataFrame(rows, "fmt int, line string").withColumn("stamp", stamp_of(formats, F.col("line")))
    for number, fmt in enumerate(formats):
        own = lines.where(F.col("fmt") == number)
        for of in (fmt.matches, fmt.sort_key, fmt.span):
            assert own.where(~of(F.col("line")).eqNullSafe(of(F.col("stamp")))).count() == 0, fmt.name
        assert own.where(fmt.matches(F.col("line"))).count() > 0, fmt.name
    assert lines.where("length(stamp) < length(line)").count() > 0
