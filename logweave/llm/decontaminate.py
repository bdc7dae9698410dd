"""Benchmark decontamination with DataFrame functions only.

A benchmark item's windows are its runs of ``width`` consecutive words; an item of fewer words, but
not none, is one window. The distinct windows form the hash set: a 64-bit key of a window's first,
middle and last word. It is broadcast if its words take at most ``BROADCAST_BYTES``, which is measured
first. Documents are scanned
once: each word position makes one key per window length, the set is probed, and a probe that finds a
key is verified word by word in the same join. Only verified hits leave the scan, besides one row per document.

A larger set is joined by shuffle, with the same rows as result: only row, position, length and key of each window are
shuffled, over ``SALTS`` parts of each key; then the texts that met a key are cut at the places found, and the words
of each cut are joined with the windows themselves.

Benchmark items that share a window, and documents that contain it, are never paired up: windows
with the same items form a group, and the items of documents are looked up once per distinct set of groups.

Cases: a null or wordless text has no words, no hits and the digest of the empty string; a wordless or null
item never occurs; repeated items and repeated documents each count as rows of their own, repeated item ids as one item;
null item ids are left out of the digest; an empty benchmark leaves every document clean. Columns other than id and
text are not read by ``scan`` and are kept by ``remove_documents`` and ``remove_spans``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from logweave.llm.common import ascii_lower, text_or_empty
from logweave.session import store

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same class in a text whose case was kept, and its complement.
_KEPT_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WIDTH = 10
ROW_BYTES = 16  # of a row number in a broadcast table
BROADCAST_BYTES = 32 << 20
SALTS = 16  # parts of a key in the joins by shuffle, as one key may hold a third of all rows


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text_or_empty(text)), F.lit(WORD), F.lit(0))


def _key(words: Column, at: Column, length: Column) -> Column:
    """Of the window of ``length`` words that starts at ``at``."""
    return F.xxhash64(
        length, F.get(words, at), F.get(words, at + F.floor(length / 2).cast("int")), F.get(words, at + length - 1))


def benchmark_windows(benchmark: DataFrame, width: int = WIDTH, *, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Stored rows (window, length, key, item_id): each distinct window of each item."""
    items = benchmark.select(
        F.col(f"`{id_col}`").cast("string").alias("item_id"), words_of(F.col(f"`{text_col}`")).alias("words"))
    items = items.where(F.size("words") > 0).withColumn("length", F.least(F.size("words"), F.lit(width)))
    runs = items.select("item_id", "words", "length", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("length"))).alias("at"))
    window = F.slice("words", F.col("at") + 1, F.col("length"))
    rows = runs.select(window.alias("window"), "length", _key(F.col("words"), F.col("at"), F.col("length")).alias("key"), "item_id")
    return store(rows.distinct(), "windows")


def _groups(windows: DataFrame) -> DataFrame:
    """Stored rows (window, length, key, group): windows with the same items share a group number."""
    same = F.struct(F.count("item_id").alias("n"), F.bit_xor(F.xxhash64("item_id")).alias("x"),
                    F.bit_xor(F.xxhash64("item_id", F.lit("second"))).alias("y"))
    return store(windows.groupBy("window", "length", "key").agg(same.alias("s")).select(
        "window", "length", "key", F.xxhash64("s.n", "s.x", "s.y").alias("group")), "window-groups")


def _join_salted(rows: DataFrame, known: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join (row, at, length, ...) with one or more rows per key; the rows of one key go to ``SALTS`` tasks."""
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("row", "at"), F.lit(SALTS)).cast("int"))
    copies = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(copies, [*keys, "salt"], how).drop("salt")


def _hits_by_shuffle(docs: DataFrame, groups: DataFrame, lengths: list[int]) -> DataFrame:
    """What ``find_hits`` returns, of (row, doc_id, text), without a broadcast."""
    numbered = store(docs, "numbered-texts")  # rows keep their numbers in both scans
    of_doc = numbered.withColumn("words", words_of(F.col("text"))).drop("text").withColumn("n_words", F.size("words"))
    places = of_doc.where("n_words > 0").select("row", "words", "n_words", F.explode(F.sequence(F.lit(0), F.col("n_words") - 1)).alias("at"))
    places = places.select("*", F.explode(F.array(*map(F.lit, lengths))).alias("length")).where("at + length <= n_words")
    keyed = places.select("row", "at", "length", _key(F.col("words"), F.col("at"), F.col("length")).alias("key"))
    met = _join_salted(keyed, groups.select("length", "key").distinct(), ["length", "key"], "left_semi")
    met = met.groupBy("row").agg(F.collect_set(F.struct("at", "length")).alias("met"))  # bounded by the document's own words
    cut = of_doc.join(met, "row").select("row", "doc_id", "n_words", "words", F.explode("met").alias("m")).select(
        "row", "doc_id", "n_words", "m.at", "m.length", F.slice("words", F.col("m.at") + 1, F.col("m.length")).alias("window"))
    hits = _join_salted(cut, groups.select("length", "window", "group"), ["length", "window"], "inner")
    documents = of_doc.select("row", "doc_id", "n_words", F.lit(None).cast("int").alias("at"),
                              F.lit(None).cast("int").alias("length"), F.lit(None).cast("long").alias("group"))
    return documents.union(hits.select(documents.columns))


def find_hits(docs: DataFrame, groups: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored rows (row, doc_id, n_words, at, length, group): one per document with null ``at``,
    one per verified window."""
    lengths = [r[0] for r in groups.select("length").distinct().orderBy("length").collect()]  # at most ``width``
    heavy = groups.agg(F.coalesce(F.sum(F.octet_length(F.array_join("window", " ")) + 64), F.lit(0))).first()[0]
    texts = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    if lengths and heavy > BROADCAST_BYTES:
        return store(_hits_by_shuffle(texts, groups, lengths), "hits")
    of_doc = texts.select("row", "doc_id", words_of(F.col("text")).alias("words"))
    size = F.size("words")
    if not lengths:
        return store(of_doc.select("row", "doc_id", size.alias("n_words"), F.lit(None).cast("int").alias("at"),
                                   F.lit(None).cast("int").alias("length"), F.lit(None).cast("long").alias("group")), "hits")
    # Probe -1 stands for the document itself; probe p is word p // k with the (p % k)-th length.
    probes = of_doc.select("row", "doc_id", "words", F.explode(F.sequence(F.lit(-1), size * len(lengths) - 1)).alias("probe"))
    at = F.floor(F.col("probe") / len(lengths)).cast("int") if len(lengths) > 1 else F.col("probe")
    length = F.element_at(F.array(*map(F.lit, lengths)), F.pmod("probe", F.lit(len(lengths))) + 1) if len(lengths) > 1 else F.lit(lengths[0])
    keyed = probes.select("row", "doc_id", "words", at.alias("at"), length.alias("l"), "probe").select(
        "row", "doc_id", "words", "at",
        F.when((F.col("probe") >= 0) & (F.col("at") + F.col("l") <= F.size("words")), _key(F.col("words"), F.col("at"), F.col("l"))).alias("k"),
        "l", "probe")
    verified = (F.col("k") == F.col("key")) & (F.col("l") == F.col("length")) & (
        F.slice("words", F.greatest("at", F.lit(0)) + 1, "l") == F.col("window"))
    found = keyed.join(F.broadcast(groups), verified, "left").where(F.col("group").isNotNull() | (F.col("probe") == -1))
    return store(found.select("row", "doc_id", F.size("words").alias("n_words"),
                              F.when(F.col("group").isNotNull(), F.col("at")).alias("at"), "length", "group"), "hits")


def scan(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    windows = benchmark_windows(benchmark, width)
    groups = _groups(windows)
    hits = find_hits(docs, groups, id_col=id_col, text_col=text_col)

    # Words covered by the union of the windows: each adds what lies past the ends before it.
    earlier = Window.partitionBy("row").orderBy("at", "length").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("at") + F.col("length")
    past = F.greatest(F.coalesce(F.max(end).over(earlier), F.lit(0)), F.col("at"))
    per_doc = hits.withColumn("new", F.when(F.col("at").isNull(), 0).otherwise(F.greatest(end - past, F.lit(0)))).groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").cast("long").alias("n_words"), F.sum("new").cast("long").alias("n_hit"),
        F.sort_array(F.collect_set("group")).alias("groups"))  # bounded by the document's own words
    per_doc = store(per_doc, "per-document")

    sets = per_doc.select("groups").where(F.size("groups") > 0).distinct()
    one_window = groups.groupBy("group").agg(F.min(F.struct("length", "window")).alias("w")).select("group", "w.length", "w.window")
    items = windows.join(one_window, ["length", "window"]).select("group", "item_id")
    listed = sets.select("groups", F.explode("groups").alias("group")).join(items, "group").groupBy("groups").agg(
        F.sort_array(F.collect_set("item_id")).alias("items"))
    listed = listed.select("groups", F.size("items").cast("long").alias("n"), F.sha2(F.array_join("items", ","), 256).alias("sha"))
    # Documents without a hit share one key, the empty set, and need no join.
    clean = per_doc.where(F.size("groups") == 0).select(
        "doc_id", "n_words", "n_hit", F.lit(0).cast("long").alias("n_items"), F.sha2(F.lit(""), 256).alias("items_sha256"),
        F.lit(False).alias("contaminated"), "row")
    hit = per_doc.where(F.size("groups") > 0).join(listed, "groups", "left").select(
        "doc_id", "n_words", "n_hit", F.coalesce("n", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.lit(True).alias("contaminated"), "row")
    return clean.union(hit)


def _hit_spans(docs: DataFrame, benchmark: DataFrame, width: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``docs`` stored with a row number, and per hit document the (at, length) of its windows."""
    numbered = store(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    hits = find_hits(numbered.select(F.col("__row").alias("doc_id"), F.col(f"`{text_col}`").alias("text")),
                     _groups(benchmark_windows(benchmark, width)))
    spans = hits.where(F.col("at").isNotNull()).groupBy(F.col("doc_id").alias("__row")).agg(
        F.collect_set(F.struct("at", "length")).alias("__spans"))  # bounded by the document's own words
    return numbered, spans


def remove_documents(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without those that contain a benchmark window.

    The numbers of the hit rows are broadcast while they take less than ``BROADCAST_BYTES``; then no text is shuffled.
    """
    numbered, spans = _hit_spans(docs, benchmark, width, id_col, text_col)
    rows = store(spans.select("__row"), "hit-rows")
    few = rows.count() * ROW_BYTES <= BROADCAST_BYTES
    return numbered.join(F.broadcast(rows) if few else rows, "__row", "left_anti").drop("__row")


def remove_spans(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the hit words cut out of their texts; what stands between words is kept."""
    numbered, spans = _hit_spans(docs, benchmark, width, id_col, text_col)
    text = F.col(f"`{text_col}`")
    pieces = F.regexp_extract_all(text, F.lit(_KEPT_CASE), F.lit(0))
    # Pieces take turns, word and gap; the parity of the first says which are words.
    marked = numbered.join(spans, "__row", "left").withColumn("__pieces", F.when(F.col("__spans").isNotNull(), pieces)).withColumn(
        "__first", F.when(F.get("__pieces", F.lit(0)).rlike(WORD.replace("\\x60", "\\x40\\x5B-\\x60")), 0).otherwise(1))
    hit_words = F.array_distinct(F.flatten(F.transform("__spans", lambda s: F.sequence(s["at"], s["at"] + s["length"] - 1))))
    marked = marked.withColumn("__hit", hit_words)
    kept = F.filter("__pieces", lambda p, i: (F.pmod(i - F.col("__first"), F.lit(2)) == 1)
                    | ~F.array_contains("__hit", F.floor((i - F.col("__first")) / 2).cast("int")))
    cut = marked.withColumn(text_col, F.when(F.col("__spans").isNull(), text).otherwise(F.array_join(kept, "")))
    return cut.drop("__row", "__spans", "__pieces", "__first", "__hit")
