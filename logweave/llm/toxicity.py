"""Toxicity: Levenshtein automata over a lexicon trie, with context windows.

The lexicon is learned by covering: of the words and stems that mark toxic labelled texts, the one that covers most texts
not yet covered is taken, until too few are left; words that are plainly toxic join it as well. Evidence is counted
by the words that a term follows, so copies of a text are no evidence. Its terms form a trie. A token is matched by its Levenshtein
automaton (one bit set of positions per number of edits) run along the trie's edges, so all terms within the
edit budget are found in one walk. A term allows one edit from five letters on and two from nine on; shorter ones only
an edit that puts a sign or digit in a letter's place. Pieces of the terms that survive so many edits filter tokens first.
A stem (``term*``) fits any ending, but no edits. Near spellings that the labelled sample shows to be harmless words are left alone.

Each match has a window of context: enclosed in quotation marks it counts as quotation, else as abuse. How likely a text
is toxic by its strongest kind of match (exact, one or two edits, quoted, none) is measured on the labelled sample
with a prior, so kinds that never occur there get the prior.

At most about ``SAMPLE`` labelled texts are learned from; word counts over them are aggregated by Spark, and at most
``CANDIDATES`` words reach the driver. Texts are scored whole, in one pass without a shuffle.

Cases: null, empty and wordless texts score as texts without a match; a null label teaches nothing; repeated rows are scored
one by one; without labels the lexicon is empty and all scores are the prior of 0.01. Other columns are kept.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from logweave.llm import common, quality

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLE = 10_000
#: Words considered for the lexicon, at most; those with the most toxic texts.
CANDIDATES = 2_000
LEAST_TEXTS = 3
#: A term adds at least this share of the toxic texts, and this share of its texts is toxic.
LEAST_SHARE = 0.01
PURITY = 0.9
STEMS = range(4, 8)
#: A word found after so many different words in toxic texts joins the lexicon even if other terms cover those texts.
SURE_TEXTS = 6
WINDOW = 80
#: Tokens whose look-up a task remembers, and places of words that it counts, before it starts anew.
REMEMBERED = 300_000
_TOKEN = re.compile(r"[^\W_][^\s\"'.,;:?()\[\]{}<>|/«»“”„]*")
_RUN = re.compile(r"(.)\1\1+")
_EDGE = "!*$@#%&+-=~^`_\\…"
_OPEN, _CLOSE = "\"“«„‘", "\"”»“’"
_END = ""
#: (pseudo rows, pseudo toxic rows) of each kind of match, strongest first.
PRIORS = {"exact": (2, 1.8), "one": (2, 1.4), "two": (2, 1.2), "quoted": (4, 0.8), "none": (20, 0.2)}


def budget(term: str) -> int:
    return 2 if len(term) >= 9 else 1


class Lexicon:
    """The terms' trie and the filter of tokens that can be within a term's edit budget."""

    def __init__(self, terms: list[str], harmless: list[str] = ()):
        self.terms = sorted(t for t in terms if not t.endswith("*"))
        self.stems = {t[:-1] for t in terms if t.endswith("*")}
        self.stem_sizes = sorted({len(t) for t in self.stems})
        self.harmless = frozenset(harmless)
        self.clean: set[str] = set()
        self.known: dict[str, tuple[str, int]] = {}
        self.trie: dict = {}
        # Of a term's budget + 1 pieces one survives whole: at the front, at the back, or inside.
        front, back, inside = set(), set(), set()
        for term in self.terms:
            node = self.trie
            for ch in term:
                node = node.setdefault(ch, {})
            node[_END] = term
            pieces = budget(term) + 1
            cuts = [len(term) * i // pieces for i in range(pieces + 1)]
            front.add(term[:cuts[1]])
            back.add(term[cuts[-2]:])
            inside.update(term[a:b] for a, b in zip(cuts[1:-2], cuts[2:-1]))
        sizes = [len(t) for t in self.terms]
        self.shortest = min(sizes, default=1) - 2
        self.longest = max(sizes, default=0) + 2
        self.fronts = [(n, frozenset(p for p in front if len(p) == n)) for n in sorted({len(p) for p in front})]
        self.backs = [(-n, frozenset(p for p in back if len(p) == n)) for n in sorted({len(p) for p in back})]
        self.inside = sorted(inside)

    def possible(self, token: str) -> bool:
        for n, known in self.fronts:
            if token[:n] in known:
                return True
        for n, known in self.backs:
            if token[n:] in known:
                return True
        for piece in self.inside:
            if piece in token:
                return True
        return False

    def find(self, token: str) -> tuple[str, int] | None:
        """The nearest term within its budget and the number of edits."""
        if not self.terms:
            return None
        last = 1 << len(token)
        masks: dict[str, int] = {}
        for i, ch in enumerate(token):
            masks[ch] = masks.get(ch, 0) | 2 << i
        odd = not token.isalpha()
        best = None
        # Bit i of level e: i characters of the token are read with e edits.
        walk = [(self.trie, (1, 3, 7))]
        while walk:
            node, (r0, r1, r2) = walk.pop()
            for ch, child in node.items():
                if ch == _END:
                    edits = 0 if r0 & last else 1 if r1 & last else 2 if r2 & last else 3
                    allowed = budget(child) if len(child) >= 5 or odd else 0
                    if edits <= allowed and (best is None or edits < best[1]):
                        best = (child, edits)
                    continue
                mask = masks.get(ch, 0)
                n0 = (r0 << 1) & mask
                n1 = ((r1 << 1) & mask) | r0 | (r0 << 1) | (n0 << 1)
                n2 = ((r2 << 1) & mask) | r1 | (r1 << 1) | (n1 << 1)
                if n2:
                    walk.append((child, (n0, n1, n2)))
        return best

    def look_up(self, token: str) -> tuple[str, int] | None:
        """The term that the token stands for and the number of edits."""
        hit = None
        for n in self.stem_sizes:
            if token[:n] in self.stems:
                hit = (token[:n] + "*", 0)
        shortest, longest = self.shortest, self.longest
        if len(token) < shortest or (len(token) > longest and token.isalpha() and not _RUN.search(token)):
            return hit
        plain = token.strip(_EDGE)
        if len(plain) > longest:
            plain = _RUN.sub(r"\1", plain)
        if shortest <= len(plain) <= longest and plain not in self.harmless and self.possible(plain):
            found = self.find(plain)
            if found is None and _RUN.search(plain):
                found = self.find(_RUN.sub(r"\1", plain))
            hit = found or hit
        return hit

    def hits(self, tokens: set[str]) -> dict[str, tuple[str, int]]:
        """The tokens that stand for a term; what was looked up before is remembered, within a bound."""
        if len(self.clean) + len(self.known) > REMEMBERED:
            self.clean, self.known = set(), {}
        out = {}
        for token in tokens - self.clean:
            hit = self.known.get(token) or self.look_up(token)
            if hit:
                out[token] = self.known[token] = hit
            else:
                self.clean.add(token)
        return out

    def matches(self, text: str) -> list[tuple[str, str, int, bool]]:
        """(term, token, edits, quoted) of every match in the text."""
        low = text.lower()
        tokens = _TOKEN.findall(low)
        hits = self.hits(set(tokens))
        if not hits:
            return []
        return [(*hits[m.group()][:1], m.group(), hits[m.group()][1], quoted(low, *m.span()))
                for m in _TOKEN.finditer(low) if m.group() in hits]


def quoted(text: str, start: int, end: int) -> bool:
    """Whether the window around text[start:end] has a mark that opens before it and one that closes after it."""
    left, right = text[max(0, start - WINDOW):start], text[end:end + WINDOW]
    opens = False
    for i, ch in enumerate(left):
        if ch == '"':
            opens = i == 0 and start > WINDOW or i == 0 or left[i - 1].isspace() or left[i - 1] in "(["
        elif ch in _OPEN:
            opens = True
        elif ch in _CLOSE:
            opens = False
    return opens and any(ch in _CLOSE for ch in right)


_KINDS = list(PRIORS)


def kind_of(matches: list[tuple[str, str, int, bool]]) -> str:
    """The strongest kind of a text's matches."""
    return min((("quoted" if q else ("exact", "one", "two")[edits]) for _, _, edits, q in matches), key=_KINDS.index, default="none")


@dataclass
class Model:
    terms: list[str]
    harmless: list[str]
    chance: dict[str, float]


def words_in(text: str | None) -> set[tuple[str, int]]:
    """A text's words of four letters or more, each with the class (of 256) of the word before it."""
    found, before = set(), ""
    for token in _TOKEN.findall((text or "").lower()):
        word = token.strip(_EDGE)
        if len(word) >= 4:
            found.add((word, before))
        before = word
    return {(word, zlib.crc32(before.encode()) & 255) for word, before in found}


def count_places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts and toxic texts by word and place, added up within the task."""
    def frame() -> pd.DataFrame:
        return pd.DataFrame([(w, p, y, n) for (w, p), (y, n) in seen.items()], columns=["word", "place", "toxic", "n"])

    seen: dict[tuple[str, int], tuple[float, int]] = {}
    for batch in batches:
        for text, y in zip(batch["text"], batch["y"]):
            for unit in words_in(text):
                toxic, n = seen.get(unit, (0.0, 0))
                seen[unit] = toxic + y, n + 1
            if len(seen) > REMEMBERED:
                yield frame()
                seen = {}
    yield frame()


def near_words(series: pd.Series, lexicon: Lexicon) -> pd.Series:
    return pd.Series([sorted({w.strip(_EDGE) for _, w, edits, _ in lexicon.matches(x) if edits}) for x in common.texts(series)])


def cover(covered_by: dict[str, set], least: int = LEAST_TEXTS) -> list[str]:
    """Terms that cover the texts, each adding ``least`` at least, most first; then words before stems, long ones first."""
    terms, left = [], {w: set(s) for w, s in covered_by.items()}
    while left:
        word = min(left, key=lambda w: (-len(left[w]), w.endswith("*"), -len(w), w))
        texts = left.pop(word)
        if len(texts) < least:
            break
        terms.append(word)
        left = {w: s - texts for w, s in left.items() if len(s - texts) >= least}
    return terms


def learn_terms(rows: DataFrame) -> list[str]:
    """Words and stems (``term*``) of the lexicon, from labelled rows (doc_id, text, y)."""
    words = rows.select("text", "y").mapInPandas(count_places, "word string, place int, toxic double, n long")
    words = words.groupBy("word", "place").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
    cut = f"transform(filter(sequence({STEMS[0]}, {STEMS[-1]}), i -> i < length(word)), i -> concat(substring(word, 1, i), '*'))"
    # Evidence is the words that a term follows, not the texts it is in: copies of a text add nothing.
    places = words.withColumn("word", F.explode(F.concat(F.array("word"), F.expr(cut)))).groupBy("word", "place").agg(
        (F.sum("toxic") / F.sum("n")).alias("y"))
    counts = places.groupBy("word").agg(F.sum("y").alias("toxic"), F.count(F.lit(1)).alias("n"))
    toxic = rows.where("y = 1").count()
    least = max(LEAST_TEXTS, int(toxic * LEAST_SHARE))
    marks = counts.where((F.col("toxic") >= least) & (F.col("toxic") >= PURITY * F.col("n"))).orderBy(
        F.desc("toxic"), "word").limit(CANDIDATES).collect()
    names = frozenset(r["word"] for r in marks)

    @F.pandas_udf("array<string>")
    def marks_in(series: pd.Series) -> pd.Series:
        out = []
        for text in common.texts(series):
            plain = {token.strip(_EDGE) for token in set(_TOKEN.findall(text.lower()))}
            found = plain & names
            for n in STEMS:
                found |= {w[:n] + "*" for w in plain if len(w) > n} & names
            out.append(sorted(w for w in found if len(w) >= 4))
        return pd.Series(out)

    where = rows.select("doc_id", "y", F.explode(marks_in("text")).alias("word")).distinct().toPandas()
    pure = where.groupby("word")["y"].mean()
    pure = set(pure.index[pure >= PURITY])
    terms = cover({w: set(g) for w, g in where[(where["y"] == 1) & where["word"].isin(pure)].groupby("word")["doc_id"]}, least)
    sure = {r["word"]: r["toxic"] for r in marks
            if r["toxic"] >= SURE_TEXTS and r["toxic"] >= PURITY * (r["n"] + 0.5) and r["word"] in pure}
    terms += [w for w in sure if not w.endswith("*")]
    # A stem joins if no single term under it explains nearly all of it; then it stands for the words under it.
    for word in sorted((w for w in sure if w.endswith("*")), key=lambda w: (len(w), w)):
        under = [t for t in terms if t.startswith(word[:-1])]
        if max((sure.get(t, sure[word]) for t in under), default=0) < PURITY * sure[word]:
            terms.append(word)
    stems = [t for t in terms if t.endswith("*")]
    terms = [t for t in terms if not any(t != x and t.startswith(x[:-1]) for x in stems)]
    terms = sorted(set(terms))
    return terms


def train(docs: DataFrame, labels: DataFrame, trained: Column, *, label: str = "toxic", bound: int = SAMPLE,
          id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learn from the labelled rows for which ``trained`` (a condition on the labels' id) holds."""
    rows = common.store(quality.labelled_texts(
        docs, quality.sample_labels(labels, label, trained, bound), bound, id_col, text_col), "toxicity-sample")
    terms = learn_terms(rows)

    @F.pandas_udf("array<string>")
    def near(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexicon = Lexicon(terms)
        for series in batches:
            yield near_words(series, lexicon)

    spelled = rows.select("y", F.explode(near("text")).alias("word")).groupBy("word").agg(F.avg("y").alias("y"))
    harmless = [r["word"] for r in spelled.where("y < 0.5").select("word").orderBy("word").collect()]  # of the bounded sample

    @F.pandas_udf("string")
    def kinds(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexicon = Lexicon(terms, harmless)
        for series in batches:
            yield pd.Series([kind_of(lexicon.matches(x)) for x in common.texts(series)])

    seen = {r["kind"]: (r["n"], r["toxic"]) for r in rows.groupBy(kinds("text").alias("kind")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("toxic")).collect()}  # five kinds
    chance = {k: (seen.get(k, (0, 0))[1] + y) / (seen.get(k, (0, 0))[0] + n) for k, (n, y) in PRIORS.items()}
    return Model(terms, harmless, chance)


def score(text: Column, model: Model) -> Column:
    """Chance that the text is toxic; more matches move it up within its kind's gap to 1."""

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexicon = Lexicon(model.terms, model.harmless)
        for series in batches:
            out = np.empty(len(series))
            for i, x in enumerate(common.texts(series)):
                found = lexicon.matches(x)
                chance = model.chance[kind_of(found)]
                out[i] = min(1.0, chance + (1 - chance) * 0.01 * min(10, len(found)))
            yield pd.Series(out)

    return of(text)
