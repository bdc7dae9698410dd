"""Language-model scores by prediction by partial matching.

Symbols are the bytes of the lower-cased text and an end. The longest context (up to ``ORDER`` bytes) that the model
knows predicts the next symbol or escapes to the next shorter one; there, symbols that the longer context predicts are excluded.
Each symbol that the context predicts gives half an occurrence to the escape; after order 0 the
remaining symbols are equally likely. The probabilities of all symbols after any context sum to one.

The model is pretrained and whole: byte strings of ``ORDER + 1`` and words are counted over all training documents, combined in each
task before the shuffle; nothing is pruned. Shorter strings are sums of longer ones. The probability of a position depends on the string
that ends there alone, so it is worked out once for each distinct string of the corpus, level by level from the shortest: a context has at
most 257 followers and a string at most 257 longer ones, which bounds every group. Strings with at least ``1 / STRING_SHARE`` of
all positions (at most ``STRING_SHARE``) are broadcast with their logarithms, all others are joined by shuffle. ``Trie`` is the same
model in one process, which the tests hold the job against.

The base score needs the count of every word. Words with at least ``1 / WORD_SHARE`` of all tokens (at most ``WORD_SHARE`` words)
are broadcast, all others are joined by shuffle; no rare word is frequent enough to make a hot key.

Cases: a null or empty text is one end token; a null id counts as the empty text in the split; repeated rows teach and are scored each;
without training documents every symbol is equally likely and no token is known. Only id and text are read. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import sys
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from logweave.llm import common

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ORDER = 5
STRING_SHARE = 1 << 22
WORD_SHARE = 1 << 18
END = 256
_BITS = 9
_SYMBOLS = 257
#: Positions that are worked on at once, and words and strings that a task holds before it hands them on.
_CHUNK = 1 << 18
_ROWS = 1000
_HELD = 1 << 18
_WORD, _STRING, _TEXTS = 0, 1, 2
_COUNTS = ["kind", "key", "n", "m"]


def word_hash(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words)).view(np.int64)


def positions(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The string of ``order + 1`` symbols that ends at each position of the texts, and each text's number of positions."""
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    symbols = np.full(sizes.sum() + order * len(texts), END, dtype=np.int64)
    real = np.ones(len(symbols), dtype=bool)
    at = 0
    for text, size in zip(texts, sizes.tolist()):
        real[at:at + order] = False
        at += order
        symbols[at:at + size - 1] = np.frombuffer(text, np.uint8)
        at += size
    key = symbols.copy()
    for back in range(1, order + 1):
        key[back:] |= symbols[:-back] << (_BITS * back)
    return key[real], sizes


def in_chunks(texts: list[bytes]) -> Iterator[list[bytes]]:
    chunk, size = [], 0
    for text in texts:
        chunk.append(text)
        size += len(text)
        if size >= _CHUNK:
            yield chunk
            chunk, size = [], 0
    if chunk:
        yield chunk


def in_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            yield batch.slice(at, _ROWS)


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, key, n, m): partial counts of words, strings and texts in a task's training documents (n) and in all (m).

    A string that only held-out documents have is there with n = 0; their words are not.
    """
    def rows(kind: int, keys: np.ndarray, n: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys), pa.array(n.astype(np.int64)), pa.array(m.astype(np.int64))], names=_COUNTS)

    def words_out() -> pa.RecordBatch:
        listed = list(words)
        n = np.fromiter((words[w] for w in listed), np.int64, len(listed))
        return rows(_WORD, word_hash(listed), n, n)

    def merged(parts: list[list[tuple[np.ndarray, np.ndarray]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        taught, other = ([np.concatenate(x) for x in zip(*part)] or [np.empty(0, np.int64)] * 2 for part in parts)
        keys, where = np.unique(np.concatenate([taught[0], other[0]]), return_inverse=True)
        n = np.bincount(where[:len(taught[0])], taught[1], len(keys))
        return keys, n, n + np.bincount(where[len(taught[0]):], other[1], len(keys))

    words: Counter = Counter()
    strings: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]  # of training documents, and of the others
    held, seen = 0, 0
    for batch in in_slices(batches):
        texts, taught = [common.lower_bytes(t) for t in batch.column(0).to_pylist()], batch.column(1).to_pylist()
        seen += sum(taught)
        for part, own in ((0, True), (1, False)):
            for chunk in in_chunks([text for text, t in zip(texts, taught) if t is own]):
                for text in chunk if own else ():
                    words.update(text.split())
                if len(words) > _HELD:
                    yield words_out()
                    words.clear()
                strings[part].append(np.unique(positions(chunk)[0], return_counts=True))
                held += len(strings[part][-1][0])
                if held > 8 * _HELD:
                    keys, n, m = merged(strings)
                    strings, held = [[(keys, n)], [(keys, m - n)]], 2 * len(keys)
                    if held > 4 * _HELD:
                        yield rows(_STRING, keys, n, m)
                        strings, held = [[], []], 0
    if words:
        yield words_out()
    if any(strings):
        yield rows(_STRING, *merged(strings))
    yield rows(_TEXTS, np.zeros(1, np.int64), np.array([seen]), np.array([seen]))


class Table:
    """Numbers of known keys by open addressing, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(2 * len(keys) + 1))))
        self.slots = np.full(1 << self.bits, -1, dtype=np.int64)
        self.number = np.full(1 << self.bits, -1, dtype=np.int32)
        left, at = np.arange(len(keys)), self._place(keys)
        while len(left):
            free = self.slots[at] == -1
            self.slots[at[free]] = keys[left[free]]
            mine = self.slots[at] == keys[left]
            self.number[at[mine]] = left[mine]
            left, at = left[~mine], (at[~mine] + 1) & ((1 << self.bits) - 1)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self._place(keys)
        there = self.slots[at]
        out = self.number[at].astype(np.int64)
        left = np.flatnonzero((there != keys) & (there != -1))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            there = self.slots[at[left]]
            out[left] = self.number[at[left]]
            left = left[(there != keys[left]) & (there != -1)]
        return out


@dataclass
class Trie:
    """Flattened context trie in one process. Level ``k`` holds the strings of ``k`` symbols; all numbers are log10."""

    order: int
    table: list = field(default_factory=list)
    count: list = field(default_factory=list)  # of the string's last symbol after its context
    known: list = field(default_factory=list)  # whether the string is a context with followers
    total: list = field(default_factory=list)  # entered from the start: weight of all and escape
    escape: list = field(default_factory=list)
    total_down: list = field(default_factory=list)  # entered by escape from the context: of its suffix
    escape_down: list = field(default_factory=list)
    rest: float = 0.0  # of each symbol that no context predicts

    def score(self, key: np.ndarray) -> np.ndarray:
        """log10 probability of the last symbol of each position's string after the symbols before it."""
        symbol, context = [None], [np.zeros(len(key), np.int64)]
        # A context is the string that ends one position earlier, except where a text begins.
        first = np.flatnonzero(np.concatenate([[True], key[1:] >> _BITS != key[:-1] & ((1 << (_BITS * self.order)) - 1)]))
        for level in range(1, self.order + 2):
            mask = (1 << (_BITS * level)) - 1
            symbol.append(self.table[level].find(key & mask))
            if level <= self.order:
                number = np.empty(len(key), np.int64)
                number[1:] = symbol[level][:-1]
                number[first] = self.table[level].find((key[first] >> _BITS) & mask)
                known = self.known[level]
                context.append(np.where((number >= 0) & known[number], number, -1) if len(known) else np.full(len(key), -1))
        out = np.zeros(len(key))
        entered = np.zeros(len(key), dtype=bool)
        todo = np.arange(len(key))
        for level in range(self.order, -1, -1):
            here = context[level][todo] >= 0 if level else np.full(len(todo), bool(self.known[0][0]))
            at = todo[here]
            if not len(at):
                continue
            own, down = context[level][at], entered[at]
            total, escape = self.total[level][own], self.escape[level][own]
            if down.any():
                longer = context[level + 1][at[down]]
                total[down], escape[down] = self.total_down[level + 1][longer], self.escape_down[level + 1][longer]
            number = symbol[level + 1][at]
            hit = (number >= 0) & (self.count[level + 1][number] > -1) if len(self.count[level + 1]) else number >= 0
            out[at] += np.where(hit, self.count[level + 1][number] - total if len(self.count[level + 1]) else 0.0, escape)
            entered[at] = True
            todo = np.concatenate([todo[~here], at[~hit]])
        out[todo] += self.rest
        return out


def build(levels: dict[int, tuple[np.ndarray, np.ndarray]], total: int, texts: int, order: int = ORDER) -> Trie:
    """The trie of the kept strings: ``levels`` has (keys, counts) by length, ``total`` is the number of positions."""
    keys, counts = [np.zeros(1, np.int64)], [np.array([total], dtype=np.float64)]
    for level in range(1, order + 2):
        k, n = levels.get(level, (np.empty(0, np.int64), np.empty(0, np.int64)))
        ends = sum(END << (_BITS * i) for i in range(level))  # what stands before a text
        if texts and level <= order and ends not in k:
            k, n = np.append(k, ends), np.append(n, 0)
        sort = np.argsort(k)
        keys.append(k[sort].astype(np.int64))
        counts.append(n[sort].astype(np.float64))
    trie = Trie(order)
    followers, kept, every, parents = [], [], [], [None]
    for level in range(order + 1):
        child = keys[level + 1]
        real = counts[level + 1] > 0
        parent = np.searchsorted(keys[level], child >> _BITS) if level else np.zeros(len(child), np.int64)
        parents.append(parent)
        followers.append(np.bincount(parent[real], minlength=len(keys[level])).astype(float))
        kept.append(np.bincount(parent[real], counts[level + 1][real], len(keys[level])))
        all_of = counts[level].copy()
        if level and texts:
            ends = sum(END << (_BITS * i) for i in range(level))
            all_of[np.searchsorted(keys[level], ends)] = texts
        every.append(all_of)
    with np.errstate(divide="ignore", invalid="ignore"):
        for level in range(order + 2):
            trie.table.append(Table(keys[level]) if level else None)
            seen = counts[level] > 0
            # A string that only stands before texts is a context, not a symbol: its count is negative.
            trie.count.append(np.where(seen, np.log10(np.maximum(counts[level], 1) - 0.5), -1.0))
            if level > order:
                break
            weight = every[level]
            trie.known.append(followers[level] > 0)
            trie.total.append(np.log10(weight))
            trie.escape.append(np.log10(followers[level] / 2 + every[level] - kept[level]) - np.log10(weight))
            if not level:
                trie.total_down.append(None)
                trie.escape_down.append(None)
                continue
            # What the followers of this context weigh after its suffix is excluded there.
            child, real = keys[level + 1], counts[level + 1] > 0
            suffix = np.searchsorted(keys[level], child & ((1 << (_BITS * level)) - 1))
            excluded = np.bincount(parents[level + 1][real], counts[level][suffix[real]], len(keys[level]))
            short = np.searchsorted(keys[level - 1], keys[level] & ((1 << (_BITS * (level - 1))) - 1)) if level > 1 else np.zeros(len(keys[level]), np.int64)
            new = followers[level - 1][short] - followers[level]
            weight = every[level - 1][short] - excluded
            rare = every[level - 1][short] - kept[level - 1][short]
            trie.total_down.append(np.log10(weight))
            trie.escape_down.append(np.where(weight > 0, np.log10(rare + new / 2) - np.log10(weight), 0.0))
    trie.rest = -float(np.log10(max(1.0, _SYMBOLS - followers[0][0])))
    return trie


def count_corpus(docs: DataFrame, trained: Column, text_col: str = "text") -> DataFrame:
    """Stored rows (kind, key, n, m) of the whole corpus."""
    texts = docs.select(common.text_or_empty(F.col(f"`{text_col}`")).alias("text"), trained.alias("t"))
    found = texts.mapInArrow(count_batches, "kind int, key long, n long, m long")
    return common.store(found.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("m").alias("m")), "corpus-counts")


def probabilities(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(s, m, value): the log10 probability of the last symbol of each string of the corpus after those before it.

    At each length a row has the total and the number of followers of its context. A string that training has not
    escapes to its suffix, a row of the length below, where what follows the longer context is excluded.
    """
    half = F.lit(0.5)
    longest = counts.where(F.col("kind") == _STRING).select(F.col("key").alias("s"), "n", "m")
    shorter = longest.select("n", F.explode(F.array(*(
        F.struct(F.lit(k).alias("level"), F.col("s").bitwiseAND((1 << (_BITS * k)) - 1).alias("s")) for k in range(1, order + 1)))).alias("x"))
    shorter = common.store(shorter.groupBy("x.level", "x.s").agg(F.sum("n").alias("n")), "corpus-strings")
    below = None
    for level in range(1, order + 2):
        rows = longest if level == order + 1 else shorter.where(F.col("level") == level).select("s", "n", F.lit(0).cast("long").alias("m"))
        siblings = Window.partitionBy("c")
        rows = common.store(rows.withColumn("c", F.shiftright("s", _BITS)).select(
            "s", "n", "m", "c", F.sum("n").over(siblings).alias("total"), F.count_if(F.col("n") > 0).over(siblings).alias("followers"),
            F.max(F.col("n") == 0).over(siblings).alias("novel")), f"strings-{level}")
        own = F.log10(F.col("n") - half) - F.log10("total")
        escape = F.log10(F.col("followers") / 2) - F.log10("total")
        if below is None:
            rest = -F.log10(F.greatest(F.lit(1), _SYMBOLS - F.col("followers")))
            value = F.when(F.col("n") > 0, own).when(F.col("total") > 0, escape + rest).otherwise(rest)
            done = rows.withColumns({"down": rest, "value": value})
        else:
            suffix = F.col("s").bitwiseAND((1 << (_BITS * (level - 1))) - 1)
            mixed = rows.where("novel").withColumn("suffix", suffix).join(below.select(
                F.col("s").alias("suffix"), F.col("n").alias("low_n"), F.col("total").alias("low_total"),
                F.col("followers").alias("low_followers"), F.col("down").alias("low_down"), F.col("value").alias("low_value")), "suffix")
            mixed = mixed.withColumn("left", F.col("low_total") - F.sum(F.when(F.col("n") > 0, F.col("low_n")).otherwise(0)).over(siblings))
            further = F.when(F.col("left") > 0, F.log10((F.col("low_followers") - F.col("followers")) / 2) - F.log10("left")).otherwise(0.0)
            # Of a string that training has, what follows its context's escape is never asked for.
            down = F.when(F.col("n") == 0, F.when(F.col("low_n") > 0, F.log10(F.col("low_n") - half) - F.log10("left")).otherwise(further + F.col("low_down")))
            value = F.when(F.col("total") == 0, F.col("low_value")).when(F.col("n") > 0, own).otherwise(escape + F.col("down"))
            mixed = mixed.withColumn("down", down).withColumn("value", value)
            plain = rows.where("NOT novel").withColumns({"down": F.lit(None).cast("double"), "value": own})
            done = plain.unionByName(mixed.select(*plain.columns))
        below = common.store(done.select("s", "n", "m", "total", "followers", "down", "value"), f"strings-{level}")
    return below.select("s", "m", "value")


_DOC = "row long, n_tokens long, known long, base double, score double"


def score(docs: DataFrame, trained: Column, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs``,
    with a model of the rows for which ``trained`` holds."""
    spark = docs.sparkSession
    counts = count_corpus(docs, trained, text_col)
    sums = {r["kind"]: r for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).collect()}
    texts, places = sums[_TEXTS]["n"] if sums else 0, sums[_STRING]["m"] if _STRING in sums else 0
    values = probabilities(counts)
    common_string = F.col("m") * STRING_SHARE >= places
    strings = common.to_numpy(values.where(common_string).select("s", "value"))  # STRING_SHARE rows at most
    words = counts.where((F.col("kind") == _WORD)).select("key", "n")
    stats = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    tokens, vocabulary = stats["n"] + texts, stats["v"] + (texts > 0)
    often = common.to_numpy(words.where(F.col("n") * WORD_SHARE >= stats["n"]))  # WORD_SHARE rows at most
    often = dict(zip(often["key"].view(np.uint64).tolist(), np.log10(often["n"] + 1).tolist()))
    unseen = float(np.log10(tokens + vocabulary + 1))  # tokens + 1 * (vocabulary + 1)
    shared = spark.sparkContext.broadcast((strings["s"], strings["value"], often))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
        strings, value_of, often = shared.value
        table, value_of = Table(strings), np.append(value_of, 0.0)  # what the table has not counts 0 here
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            rare = [array("q"), array("Q"), array("q")]
            rare_strings = []
            place = 0
            rows = batch.column(0).to_pylist()
            for chunk in in_chunks([common.lower_bytes(t) for t in batch.column(1).to_pylist()]):
                key, sizes = positions(chunk)
                number = np.concatenate([table.find(key[a:a + _CHUNK]) for a in range(0, len(key), _CHUNK)])
                sums = np.add.reduceat(value_of[number], np.cumsum(sizes) - sizes)
                missing = np.flatnonzero(number < 0)
                owner = np.repeat(np.array(rows[place:place + len(chunk)], np.int64), sizes)[missing]
                rare_strings.append(_counted(owner, key[missing]))
                for text, total in zip(chunk, sums.tolist()):
                    split = text.split()
                    known, base, row = int(texts > 0), float(np.log10(texts + 1)), rows[place]
                    place += 1
                    for word, n in Counter(split).items():
                        code = digest(word)
                        value = often.get(code)
                        if value is None:
                            rare[0].append(row)
                            rare[1].append(code)
                            rare[2].append(n)
                        else:
                            known += n
                            base += n * value
                    for column, value in zip(out, (row, len(split) + 1, known, base, total)):
                        column.append(value)
            doc = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(out, _TYPES)], names=_NAMES)
            n = len(doc)
            found = [pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *(pa.nulls(n, pa.int64()) for _ in range(2)), pa.nulls(n, pa.int32()), doc], names=_COLUMNS)]
            strings_out = [np.concatenate(c) for c in zip(*rare_strings)] or [np.empty(0, np.int64)] * 3
            for kind, columns in ((_WORD, [np.frombuffer(c, np.int64) for c in rare]), (_STRING, strings_out)):
                n = len(columns[0])
                found.append(pa.RecordBatch.from_arrays(
                    [*map(pa.array, columns), pa.array(np.full(n, kind, np.int32)), pa.nulls(n, doc.type)], names=_COLUMNS))
            yield found

    kept = common.store(docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("doc_id"), trained.alias("t"),
                                    common.text_or_empty(F.col(f"`{text_col}`")).alias("text")).select(
        "row", "text", "doc_id", "t").mapInArrow(_with_ids(measure), _schema(docs.schema[id_col].dataType.simpleString())), "scores")
    doc = kept.where("doc is not null").select("row", "doc_id", "t", "doc.n_tokens", "doc.known", "doc.base", "doc.score")
    rare = kept.where("doc is null").select("row", "code", "n", "kind")
    nothing, no_gain = F.lit(0).cast("long"), F.lit(0.0)
    by_word = rare.where(F.col("kind") == _WORD).join(words.withColumnRenamed("n", "c").hint("shuffle_hash"), F.col("code") == F.col("key")).select(
        "row", F.col("n").alias("more"), (F.col("n") * F.log10(F.col("c") + 1)).alias("gain"), no_gain.alias("likely"))
    by_string = rare.where(F.col("kind") == _STRING).join(values.where(~common_string).hint("shuffle_hash"), F.col("code") == F.col("s")).select(
        "row", nothing.alias("more"), no_gain.alias("gain"), (F.col("n") * F.col("value")).alias("likely"))
    found = by_word.unionByName(by_string).groupBy("row").agg(*(F.sum(c).alias(c) for c in ("more", "gain", "likely")))
    more, gain = F.coalesce("more", F.lit(0)), F.coalesce("gain", F.lit(0.0))
    return doc.join(found, "row", "left").select(
        "doc_id", (~F.col("t")).alias("held_out"), "n_tokens", (F.col("known") + more).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"), (F.col("base") + gain - F.col("n_tokens") * unseen).alias("base_score"),
        (F.col("score") + F.coalesce("likely", F.lit(0.0))).alias("score"))


_NAMES = ["row", "n_tokens", "known", "base", "score"]
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
_COLUMNS = ["row", "code", "n", "kind", "doc"]


def _schema(id_type: str) -> str:
    return f"row long, code long, n long, kind int, doc struct<{', '.join(x.replace(' ', ': ') for x in _DOC.split(', '))}>, doc_id {id_type}, t boolean"


def _counted(owner: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each pair of owner and key once, with its number."""
    order = np.lexsort((key, owner))
    owner, key = owner[order], key[order]
    first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])])[:len(key)])
    return owner[first], key[first], np.diff(np.append(first, len(key)))


def _with_ids(measure):
    """Adds the id and the split to the document rows that ``measure`` yields for a batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: list[pa.RecordBatch] = []

        def remembered() -> Iterator[pa.RecordBatch]:
            for batch in in_slices(batches):
                slices[:] = [batch]
                yield batch

        for scored, *rare in measure(remembered()):
            batch, names = slices[0], [*_COLUMNS, "doc_id", "t"]
            yield pa.RecordBatch.from_arrays([*scored.columns, batch.column(2), batch.column(3)], names=names)
            for part in rare:
                n = part.num_rows
                yield pa.RecordBatch.from_arrays([*part.columns, pa.nulls(n, batch.column(2).type), pa.nulls(n, pa.bool_())], names=names)
    return run
