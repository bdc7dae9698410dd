import gzip
import json
import os
import subprocess
import sys
import tempfile

import pytest
from pyspark.sql import functions as F

from logweave.plans.merge_plan import merge_directory, merge_files, parse_logs
from logweave.plans import refresh
from logweave.plans.refresh import LogStore, watch
from logweave.operators.changes import check_changes, check_snapshots, snapshot_diff
from logweave.operators.sinks import export_visible
from logweave.operators.stats import level_counts, visible_headers
from logweave.functions.filters import substring_filter
from logweave.session import store
from logweave.sources import rawfiles
from logweave.sources.catalog import BUILT_IN_FORMATS, load_catalog
from logweave.sources.listing import Exclusion, Listing, LogFile, _list_remote, list_tree
from logweave.sources.logs import decoded_path, read_files, read_lines, read_tree
from logweave.sources.snapshots import _remote_entries, snapshot_tree
from logweave.streaming.new_files import stream_new_files, streamed_document, streamed_warnings
from tests.test_documents import merged_entries, write

HEADER = "2031-02-03 04:05:0{} INFO {}\n"


def lines_of(source):
    return sorted(r.line for r in source.lines.collect())


def names(listing):
    return [os.path.basename(f.path) for f in listing.files]


def test_gzip_in_any_case_and_with_several_members(spark, tmp_path):
    text = b"2031-02-03 04:05:07.100 NOTE packed\n\tmore of it\n"
    one = write(tmp_path, "app.log.gz", gzip.compress(text))
    two = write(tmp_path, "APP.GZ", gzip.compress(b"a\n") + gzip.compress(b"b\n"))
    entries = merged_entries(parse_logs(read_files(spark, [one])).document)
    assert entries == [("2031-02-03 04:05:07.100000000", text.decode().splitlines())]
    assert lines_of(read_files(spark, [two])) == ["a", "b"]
    assert lines_of(read_files(spark, [one], check_gzip=False)) == sorted(text.decode().splitlines())


def test_odd_gzip_files(spark, tmp_path):
    whole = gzip.compress("".join(f"line {i}\n" for i in range(50_000)).encode())
    paths = {
        name: write(tmp_path, name, content)
        for name, content in {
            "plain.gz": b"not compressed\nat all\n",
            "cut.gz": whole[: len(whole) // 2],
            "trailing.gz": gzip.compress(b"good\n") + b"garbage",
            "damaged.gz": whole[:2000] + b"\0" * 2000 + whole[4000:],
            "empty.gz": b"",
            "ok.gz": gzip.compress(b"fine\n"),
        }.items()
    }
    source = read_files(spark, list(paths.values()) + [str(tmp_path / "missing.log"), str(tmp_path)])
    warned = {os.path.basename(r.path): r.reason for r in source.warnings().collect()}
    assert set(warned) == {"damaged.gz", "missing.log", tmp_path.name}
    by_file = {
        os.path.basename(r.file): r.n
        for r in source.lines.groupBy("file").agg(F.count("*").alias("n")).collect()
    }
    assert by_file.pop("cut.gz") > 10_000
    assert by_file == {"plain.gz": 2, "trailing.gz": 1, "ok.gz": 1}
    first = source.lines.where(F.col("file").endswith("cut.gz")).first().line
    assert first == "line 0"


def test_executors_need_not_have_the_package(tmp_path):
    """A session started elsewhere, whose Python workers cannot import it."""
    write(tmp_path, "a.gz", gzip.compress(b"fine\n"))
    write(tmp_path, ".b.log", "hidden\n")
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = (
        f"import sys; sys.path.insert(0, {repo!r})\n"
        "from logweave.session import local_session\n"
        "from logweave.sources.logs import read_tree\n"
        f"lines = read_tree(local_session(2), {str(tmp_path)!r}).lines\n"
        "print(sorted(r.line for r in lines.collect()))\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH" and not k.startswith("PYSPARK_GATEWAY")}
    done = subprocess.run(
        [sys.executable, "-c", script], cwd=tempfile.mkdtemp(), env=env,
        capture_output=True, text=True, timeout=120,
    )
    assert "['fine', 'hidden']" in done.stdout, done.stderr[-2000:]


def test_small_files_share_a_task(spark, tmp_path):
    files = [LogFile(write(tmp_path, f"f{n:02}.gz", gzip.compress(b"line %d\n" % n)), 0, 30) for n in range(40)]
    labelled = rawfiles.gzip_states(spark, files)
    assert labelled.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
    assert sorted((r.path, r.state, r.n_bytes) for r in labelled.collect()) == [(f.path, "ok", 7 + (n > 9)) for n, f in enumerate(files)]
    lines = rawfiles.read_ranges(spark, [(f.path, 0, f.length, True) for f in files])
    assert lines.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
    assert sorted(int(r.value.split()[1]) for r in lines.collect()) == list(range(40))
    heavy = rawfiles.dealt(spark, [(n,) for n in range(9)], "n int", [0] * 4 + [1 << 30] + [0] * 4)
    assert [[r.n for r in task] for task in heavy.rdd.glom().collect() if task] == [[0, 1, 2, 3], [4], [5, 6, 7, 8]]
    assert rawfiles.dealt(spark, [], "n int", []).count() == 0


def test_tree_order_links_and_hidden_names(spark, tmp_path):
    root = tmp_path / "logs"
    for name in ["b.log", "a.log", "nested/c.log", "nested/deeper/no-suffix", ".hidden", "_x/y.log", "B.log"]:
        write(root, name, f"{name}\n")
    os.symlink(root / "nested", root / "link")
    os.symlink(root / "a.log", root / "z-link.log")
    os.symlink(root / "nowhere", root / "dangling")
    listing = list_tree(spark, str(root))
    assert [f.path.split("logs/")[1] for f in listing.files] == [
        ".hidden", "B.log", "_x/y.log", "a.log", "b.log", "nested/c.log",
        "nested/deeper/no-suffix", "z-link.log",
    ]
    assert listing.skipped == 0
    assert "_x/y.log" in lines_of(read_tree(spark, str(root)))
    assert len(lines_of(read_tree(spark, str(root)))) == 8
    assert len(lines_of(read_tree(spark, str(root), include_hidden=False))) == 6


def test_names_that_need_escaping(spark, tmp_path):
    odd = ["a b.log", "q+1.log", "x[1].log", "st*r.log", "per%20cent.log", "é.log", "br{a,b}.log", "c,d.log"]
    paths = [write(tmp_path, name, HEADER.format(1, i)) for i, name in enumerate(odd)]
    document = parse_logs(read_files(spark, paths)).document
    assert [os.path.basename(r.file) for r in document.orderBy("file_ord").collect()] == odd
    hidden = [write(tmp_path, name, f"{name}\n") for name in [".h i+%2B.log", "._COPYING_", "raw.bz2"]]
    source = read_files(spark, hidden)
    shown = source.lines.select(decoded_path(F.col("file")).alias("file"), "line").collect()
    assert sorted(os.path.basename(r.file) for r in shown) == sorted(r.line for r in shown)


def test_hidden_files_are_cut_into_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rawfiles, "RANGE_BYTES", 64)
    monkeypatch.setattr(rawfiles, "_CHUNK", 16)
    content = "".join(HEADER.format(i % 10, "x" * (i % 90)) for i in range(60)).encode()
    hidden, plain = write(tmp_path, ".a.log", content), write(tmp_path, "a.log", content)
    for text in (content, b"\n\n\nx\r\n" * 40 + b"end", b"y" * 300):
        write(tmp_path, ".a.log", text)
        write(tmp_path, "a.log", text)
        assert lines_of(read_files(spark, [hidden])) == lines_of(read_files(spark, [plain]))
        left = merged_entries(parse_logs(read_files(spark, [hidden]), run_bits=2).document)
        assert left == merged_entries(parse_logs(read_files(spark, [plain])).document)


def test_a_path_given_twice_counts_twice(spark, tmp_path):
    a, b = write(tmp_path, "a.log", HEADER.format(1, "a")), write(tmp_path, "b.log", HEADER.format(1, "b"))
    entries = merged_entries(merge_files(spark, [b, a, b]).document)
    assert [lines[0][-1] for _, lines in entries] == ["b", "a", "b"]


def test_unreadable_directories_are_counted(spark, tmp_path, monkeypatch):
    write(tmp_path, "readable.log", "x\n")
    write(tmp_path, "locked/hidden.log", "x\n")
    scandir = os.scandir

    def refuse(path):
        if str(path).endswith("locked"):
            raise PermissionError(path)
        return scandir(path)

    monkeypatch.setattr(os, "scandir", refuse)
    listing = list_tree(spark, str(tmp_path))
    assert (names(listing), listing.skipped) == (["readable.log"], 1)
    assert read_tree(spark, str(tmp_path)).warnings().count() == 1
    assert check_changes(Listing([LogFile("file:/gone", 1, 1)]), listing).status == "inconclusive"


def test_the_output_is_left_out(spark, tmp_path):
    root = tmp_path / "logs"
    write(root, "a.log", HEADER.format(1, "a"))
    for _ in range(2):
        parsed = merge_directory(spark, str(root))
        assert parsed.document.count() == 1
    assert (root / "merged.log").is_dir()
    single = write(root, "out.txt", "earlier output\n")
    os.symlink(root, tmp_path / "alias")
    listing = list_tree(spark, str(root), exclude=str(tmp_path / "alias" / "out.txt"), include_hidden=False)
    assert single not in [f.path.removeprefix("file:") for f in listing.files]
    assert "a.log" in names(listing)
    other = list_tree(spark, str(root), exclude=str(tmp_path / "elsewhere" / "a.log"))
    assert "a.log" in names(other)


def test_export_replaces_its_target(spark, tmp_path):
    path = write(tmp_path, "a.log", HEADER.format(1, "a") + "\tat x\n" + HEADER.format(2, "b"))
    document = merge_files(spark, [path]).document
    out = str(tmp_path / "out")
    for text, expected in [("info", 2), ("at", 1)]:
        export_visible(document, substring_filter(text), out)
        assert spark.read.text(out).count() == expected


def test_export_filters_each_line_once(spark, tmp_path):
    path = write(tmp_path, "a.log", "".join(HEADER.format(i, i) for i in range(1, 9)))
    document = store(merge_files(spark, [path]).document, "document")
    seen = spark.sparkContext.accumulator(0)

    def visible(line):
        seen.add(1)
        return True

    export_visible(document, F.udf(visible, "boolean")("line"), str(tmp_path / "out"))
    assert seen.value == document.count() == spark.read.text(str(tmp_path / "out")).count()


def test_many_folders_are_listed_by_few_tasks(spark, tmp_path):
    root = tmp_path / "tree"
    for i in range(70):
        (root / f"d{i}").mkdir(parents=True)
        (root / f"d{i}" / "a.log").write_text("x\n")
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    spark.sparkContext.setJobGroup("listing", "listing")
    source = read_tree(spark, str(root))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = [s for job in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(job).stageIds]
    assert stages and max(tracker.getStageInfo(s).numTasks for s in stages) <= 4 * spark.sparkContext.defaultParallelism
    assert spark.conf.get(key) == before
    assert source.lines.count() == 70


@pytest.mark.parametrize("content, reason", [
    (None, "PATH_NOT_FOUND"), ("{", ""), ("[]", "defines no"), ('[{"name": "x"}]', "lacks"),
    ('[{"name": "x", "pattern": "yyyy"}]', "must give"), ('{"name": "x"}', "lacks"), ("7", ""),
    ('[{"name": "x", "pattern": 5}]', "lacks"), ("", ""), ("null", ""),
])
def test_unusable_catalogs_give_the_built_in_formats(spark, tmp_path, content, reason):
    path = str(tmp_path / "formats.json")
    if content is not None:
        write(tmp_path, "formats.json", content)
    catalog = load_catalog(spark, path)
    assert catalog.formats == BUILT_IN_FORMATS
    assert len(catalog.warnings) == 1 and reason in catalog.warnings[0]


def test_a_catalog_keeps_its_order(spark, tmp_path):
    entries = [{"name": f"f{i}", "pattern": "x" * i + "MM-dd HH:mm:ss"} for i in range(30)]
    write(tmp_path, "formats.json", json.dumps(entries, indent=2))
    catalog = load_catalog(spark, str(tmp_path / "formats.json"))
    assert [f.name for f in catalog.formats] == [e["name"] for e in entries]
    assert catalog.table(spark).count() == 30
    assert load_catalog(spark).formats == BUILT_IN_FORMATS


def test_snapshot_diff(spark):
    schema = "path string, mtime_us bigint, length bigint"
    old = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", 1, 1), ("d", 1, 1)], schema)
    new = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("c", 1, 9), ("e", 1, 1)], schema)
    assert {tuple(r) for r in snapshot_diff(old, new).collect()} == {
        ("a", "same"), ("b", "modified"), ("c", "modified"), ("d", "removed"), ("e", "added")
    }


def test_refresh_follows_the_directory(spark, tmp_path):
    root, out = tmp_path / "logs", str(tmp_path / "merged")
    for name in "abc":
        write(root, f"{name}.log", HEADER.format(5, name))
    store = LogStore(spark, str(root), str(tmp_path / "store"), output=out)

    def messages():
        return [r.line.split()[-1] for r in store.document().orderBy("sort_key", "file_ord").collect()]

    assert store.refresh().status == "changed"
    assert messages() == ["a", "b", "c"]
    assert store.refresh().status == "unchanged"

    os.remove(root / "b.log")
    write(root, "c.log", HEADER.format(4, "changed"))
    write(root, "aa.log", HEADER.format(5, "added"))
    outcome = store.refresh()
    assert sorted(os.path.basename(p) for p in outcome.parsed) == ["aa.log", "c.log"]
    assert messages() == ["changed", "a", "added"]
    assert [r.value.split()[-1] for r in spark.read.text(out).collect()] == messages()

    resumed = LogStore(spark, str(root), str(tmp_path / "store"), output=out)
    assert resumed.refresh().status == "unchanged"
    assert resumed.document().count() == 3
    write(root, "d.log", HEADER.format(9, "late"))
    assert [o.status for o in watch(resumed, rounds=2, interval=0.01)] == ["changed"]
    store = resumed
    assert messages() == ["changed", "a", "added", "late"]


def test_an_incomplete_scan_changes_nothing(spark, tmp_path, monkeypatch):
    root = tmp_path / "logs"
    write(root, "a.log", HEADER.format(1, "a"))
    write(root, "sub/b.log", HEADER.format(2, "b"))
    store = LogStore(spark, str(root), str(tmp_path / "store"))
    store.refresh()
    scandir = os.scandir

    def refuse(path):
        if str(path).endswith("sub"):
            raise PermissionError(path)
        return scandir(path)

    monkeypatch.setattr(os, "scandir", refuse)
    assert store.refresh().status == "inconclusive"
    assert store.document().count() == 2
    monkeypatch.setattr(os, "scandir", scandir)
    assert store.refresh().status == "unchanged"


def test_stream_takes_new_files_once(spark, tmp_path):
    root, out, checkpoint = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "offsets")
    write(root, "b.log", "banner\n" + HEADER.format(1, "b") + "\tat x\n")
    stream_new_files(spark, str(root), out, checkpoint, once=True).awaitTermination(120)
    write(root, "a.log", HEADER.format(1, "a"))
    write(root, "c.log", HEADER.format(0, "c"))
    stream_new_files(spark, str(root), out, checkpoint, max_files=1, once=True).awaitTermination(120)
    stream_new_files(spark, str(root), out, checkpoint, once=True).awaitTermination(120)
    entries = merged_entries(streamed_document(spark, out))
    assert [lines[0].split()[-1] for _, lines in entries] == ["banner", "c", "a", "b"]
    assert entries[-1][1][1] == "\tat x"


def test_a_damaged_file_does_not_stop_the_stream(spark, tmp_path):
    root, out, checkpoint = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "offsets")
    write(root, "a.log", HEADER.format(1, "a"))
    write(root, "bad.gz", gzip.compress(b"x\n" * 9999)[:20] + b"\xff" * 30)
    write(root, "merged.log", "earlier output\n")
    for _ in range(2):
        stream_new_files(
            spark, str(root), out, checkpoint, max_files=1, once=True, exclude=str(root / "merged.log")
        ).awaitTermination(120)
        write(root, "late.log", HEADER.format(2, "late"))
    lines = [r.line.split()[-1] for r in streamed_document(spark, out).orderBy("file_ord").collect()]
    assert lines == ["a", "late"]
    assert [os.path.basename(r.path) for r in streamed_warnings(spark, out).collect()] == ["bad.gz"]


def test_files_that_vanish_after_the_listing_give_a_warning(spark, tmp_path):
    names = ["a.log", "gone.log", ".gone.log", "gone.gz"]
    for name in names:
        text = HEADER.format(1, name).encode()
        write(tmp_path, name, gzip.compress(text) if name.endswith(".gz") else text)
    write(tmp_path, "empty.log", "")
    write(tmp_path, "empty.gz", gzip.compress(b""))
    source = read_tree(spark, str(tmp_path))
    for name in names[1:]:
        os.remove(tmp_path / name)
    parsed = parse_logs(source)
    assert [r.line.split()[-1] for r in parsed.document.collect()] == ["a.log"]
    warned = sorted(os.path.basename(r.path) for r in parsed.warnings().collect())
    assert warned == sorted(names[1:])


def test_the_same_bytes_give_the_same_lines_under_any_name(spark, tmp_path):
    content = b"\xef\xbb\xbf" + HEADER.format(1, "x").encode() + b"\xef\xbb\xbfsecond\n"
    for name in ["a.log", ".b.log", "c.bz2", "plain.gz", "_d.gz"]:
        whole = gzip.compress(content) if name == "_d.gz" else content
        write(tmp_path, name, whole)
    write(tmp_path, "e.gz", gzip.compress(content))
    rows = read_tree(spark, str(tmp_path)).lines.groupBy("line").count().collect()
    assert sorted(r["count"] for r in rows) == [6, 6]
    assert HEADER.format(1, "x").rstrip("\n") in {r.line for r in rows}


def test_a_tree_listed_by_the_filesystem_client(spark, tmp_path):
    """The way remote trees are listed finds what the walk of the local disk finds."""
    for name in ["b.log", ".hidden", "_x/c.log", "out/part-0", "d/e/f.log"]:
        write(tmp_path, name, "x\n")
    root = "file:" + str(tmp_path)
    output = Exclusion(spark, str(tmp_path / "out"))
    found = _list_remote(spark, root, output)
    near = list_tree(spark, str(tmp_path), str(tmp_path / "out"))
    assert sorted(f.path for f in found.files) == [f.path for f in near.files]
    assert {f.path: f.length for f in found.files} == {f.path: f.length for f in near.files}
    assert found.left_out_folders == near.left_out_folders and found.skipped == 0
    assert {os.path.basename(f.path) for f in _list_remote(spark, root, output, False).files} == {"b.log", "f.log"}
    assert _list_remote(spark, root + "/none", output).skipped == 1


def test_lines_cross_splits(spark, tmp_path):
    """One file of many splits keeps its order and its entries."""
    content = "".join(HEADER.format(i % 10, i) + "\tat x\n" * (i % 5) for i in range(2000))
    path = write(tmp_path, "a.log", content)
    source = read_lines(spark, list_tree(spark, str(tmp_path)).files)
    assert source.lines.select("block_start").distinct().count() > 10
    document = parse_logs(source, run_bits=4).document
    in_file = document.orderBy("entry_no", "line_in_entry").collect()
    assert "".join(r.line + "\n" for r in in_file) == content
    assert max(r.entry_no for r in in_file) == 2000
    assert path.endswith(os.path.basename(in_file[0].file))


def test_a_large_tree_is_read_as_a_tree(spark, tmp_path):
    """More files than are given one by one, with every kind of file to leave out."""
    root = tmp_path / "logs x"
    for i in range(40):
        write(root, f"d {i % 3}/{i}.log", f"line {i}\n")
    write(root, "merged.log/part-0.txt", "earlier output\n")
    write(root, "merged.log.old", "kept\n")
    write(root, "raw.zst", "raw\n")
    write(root, "plain.gz", "plain\n")
    write(root, "bad.gz", gzip.compress(b"x\n" * 9999)[:20] + b"\xff" * 30)
    write(root, ".hidden", "hidden\n")
    expected = sorted([f"line {i}" for i in range(40)] + ["kept", "raw", "plain", "hidden"])
    output = str(root / "merged.log")
    listing = list_tree(spark, str(root), output)
    assert listing.root is not None and len(listing.left_out_folders) == 1
    source = read_tree(spark, str(root), exclude=output)
    assert lines_of(source) == expected
    assert [os.path.basename(p) for p, _ in source.problems] == ["bad.gz"]
    parsed = parse_logs(source)
    assert sorted(r.line for r in parsed.document.collect()) == expected
    ranked = parsed.report().orderBy("file_ord").collect()
    assert [r.file for r in ranked] == [f.path for f in listing.files if not f.path.endswith("bad.gz")]
    os.symlink(root / "d 0", root / "again")
    assert list_tree(spark, str(root), output).root is None
    assert lines_of(read_tree(spark, str(root), exclude=output)) == expected
    os.remove(root / "again")
    write(root, "_below/a.log", "below\n")
    assert lines_of(read_tree(spark, str(root), exclude=output)) == sorted([*expected, "below"])


def test_a_mended_file_is_tried_again_though_it_looks_the_same(spark, tmp_path):
    root = tmp_path / "logs"
    write(root, "a.log", HEADER.format(1, "a"))
    sound = gzip.compress(HEADER.format(2, "mended").encode() * 50)
    path = write(root, "b.gz", sound[:30] + b"\0" * 30 + sound[60:])
    times = (os.stat(path).st_atime, os.stat(path).st_mtime)
    store = LogStore(spark, str(root), str(tmp_path / "store"))
    assert len(store.refresh().problems) == 1
    still = store.refresh()
    assert (still.status, len(still.problems), store.version) == ("unchanged", 1, 0)
    write(root, "b.gz", sound)
    os.utime(path, times)
    assert store.refresh().status == "changed"
    assert store.document().count() == 51
    assert store.refresh().status == "unchanged"


def test_generations_are_merged_and_the_dead_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(refresh, "MAX_GENERATIONS", 3)
    root, where = tmp_path / "logs", tmp_path / "store"
    write(root, "large.log", "".join(HEADER.format(n % 10, f"x{n}") for n in range(3000)))
    store = LogStore(spark, str(root), str(where), dedup=True)
    for n in range(6):
        write(root, f"{n}.log", HEADER.format(n, "same") + HEADER.format(n, n))
        write(root, "again.log", HEADER.format(n, "same") * (n + 1))
        if n == 4:
            os.remove(root / "0.log")
            store = LogStore(spark, str(root), str(where), dedup=True)
        store.refresh()
    want = parse_logs(read_tree(spark, str(root)), dedup=True).document
    assert merged_entries(store.document()) == merged_entries(want)
    levels = [tuple(r) for r in level_counts(visible_headers(want)).collect()]
    assert [tuple(r) for r in store.level_counts().collect()] == levels
    store.dedup = False
    assert store.level_counts().collect() == level_counts(visible_headers(store.document())).collect()
    for folder in ("lines", "prints"):
        assert len([f for f in os.listdir(where / folder) if f.startswith("gen=")]) <= 6
    assert len([f for f in os.listdir(where / "manifest") if f.startswith("v=")]) <= 5
    assert 0 in set(store._gens.values())  # the large generation was never written again


def test_executors_list_what_the_driver_lists(spark, tmp_path):
    root = tmp_path / "logs"
    for name in ["b.log", "a b.log", "nested/c.log", "nested/deeper/d", ".hidden", "_x/y.log", "out/part-0", "empty/"]:
        if name.endswith("/"):
            os.makedirs(root / name)
        else:
            write(root, name, f"{name}\n")
    os.symlink(root / "nested", root / "link")
    os.symlink(root / "b.log", root / "z-link.log")
    os.symlink(root / "nowhere", root / "dangling")
    for hidden in (True, False):
        near = list_tree(spark, str(root), str(root / "out"), hidden)
        found = snapshot_tree(spark, str(root), str(root / "out"), include_hidden=hidden)
        assert sorted(map(tuple, found.files.collect())) == sorted((f.path, f.mtime_us, f.length) for f in near.files)
        assert found.skipped == 0
    by_client = [r for r in _remote_entries(f"file://{root}", Exclusion(None, f"file://{root}/out"), False)]
    assert sorted((os.path.basename(p), kind) for p, kind, *_ in by_client if "link" not in p) == [
        ("a b.log", "file"), ("b.log", "file"), ("empty", "folder"), ("nested", "folder"), ("out", "output")]
    before = snapshot_tree(spark, str(root))
    assert check_snapshots(before, before)[0] == "unchanged"
    os.remove(root / "nested/c.log")
    assert check_snapshots(before, snapshot_tree(spark, str(root)))[0] == "changed"
    status, kept = check_snapshots(before, snapshot_tree(spark, str(root / "none")))
    assert status == "inconclusive" and kept is before


def test_files_cut_short_after_the_listing_give_a_warning(spark, tmp_path):
    content = HEADER.format(1, "x") * 200
    for name in ("a.log", "b.log", ".c.log", "d.log", "e.log"):
        write(tmp_path, name, content)
    write(tmp_path, "f.log", b"\xef\xbb\xbf" + content.rstrip("\n").encode())
    write(tmp_path, "g.log", HEADER.format(1, "x").replace("\n", "\r\n") * 9)
    source = read_tree(spark, str(tmp_path))
    for name in ("b.log", ".c.log"):
        os.truncate(tmp_path / name, len(content) // 2)
    os.remove(tmp_path / "e.log")
    warned = {os.path.basename(r.path): r.reason.split(":")[0] for r in parse_logs(source).warnings().collect()}
    assert warned == {"b.log": "cut short", ".c.log": "cut short", "e.log": "not read"}


def test_a_store_names_files_by_number_and_takes_over_one_by_paths(spark, tmp_path):
    root, where = tmp_path / "logs", tmp_path / "store"
    write(root, "a.log", HEADER.format(2, "a") + "  more\n" + HEADER.format(3, "b"))
    write(root, "odd 50% é+.log", HEADER.format(1, "c"))
    for gen in (0, 7):  # as it was written before, with a path in every row
        older = "path string, mtime_us bigint, length bigint, gen bigint, gen_bytes bigint"
        files = [("", 0, 0, -1, 0), (str(root / "a.log"), 1, 1, gen, 1)]
        spark.createDataFrame(files, older).write.parquet(str(where / f"manifest/v={gen}"))
        for folder in ("lines", "prints", "levels"):
            spark.createDataFrame([("old", 1)], "file string, entry_no bigint").write.parquet(str(where / folder / f"gen={gen}"))
    for status in ("changed", "unchanged"):
        store = LogStore(spark, str(root), str(where))
        assert (store.refresh().status, store.version) == (status, 8)
        rows = store.document().select("file", "entry_no", "line_in_entry", "line").orderBy("sort_key", "line_in_entry").collect()
        assert [(os.path.basename(r.file), r.entry_no, r.line_in_entry) for r in rows] == [
            ("odd 50% é+.log", 1, 0), ("a.log", 1, 0), ("a.log", 1, 1), ("a.log", 2, 0)]
    for folder in ("lines", "prints", "levels"):
        stored = spark.read.parquet(str(where / folder / "gen=8"))
        assert "file" not in stored.columns and stored.where("place IS NULL").count() == 0
    store.compact()
    again = LogStore(spark, str(root), str(where))
    assert [os.path.basename(r.file) for r in again.document().orderBy("sort_key", "line_in_entry").collect()] == [
        os.path.basename(r.file) for r in rows]
    assert [tuple(r) for r in again.level_counts().collect()] == [tuple(r) for r in store.level_counts().collect()]
