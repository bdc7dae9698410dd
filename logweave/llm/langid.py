"""Language identification by nearest centroid.

A text's vector counts its hashed letter 1- to 3-grams (of lower-cased UTF-8 bytes, all else as spaces), damped by the
root, weighted by inverse document frequency and scaled to length one. Each language has up to ``CENTROIDS`` centroids,
clustered from a bounded sample of its texts by spherical k-means; outliers get none of their own. The nearest centroid by cosine names the
language; a text whose similarity is below its centroid's rejection limit is rejected. The limit lies halfway between the
similarity that 99 % of the centroid's own sampled texts reach and the one that half of the other languages' texts reach;
with one language it is ``ALONE`` times the former.

Document frequencies cover all training documents: each task sums a vector of ``DIMS`` counts. What reaches the
driver are those sums and, one language at a time and as Arrow arrays, about ``SAMPLE`` sparse vectors per language at most, drawn by a hash of id and text, so that
neither an id with many rows nor a row with many copies adds to them. Scoring is one pass, no shuffle.

Cases: a null text or one without a letter is ``und``, score 0, rejected; a null language teaches nothing; repeated rows
are judged one by one; with nothing to learn from every text is ``und``. Other columns are kept.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from logweave.llm import common

cloudpickle.register_pickle_by_value(sys.modules[__name__])

DIMS = 1 << 12
CENTROIDS = 4
SAMPLE = 1500
#: A cluster with a smaller share of its language's sample is outliers.
LEAST_SHARE = 0.05
ALONE = 0.6
#: Texts of each language that the limits of the others are measured against.
PROBES = 200
UNKNOWN = "und"
_ROUNDS = 12
_DRAWS = 1 << 60
_LETTER = regex.compile(r"\p{L}")
# Letters a-z and the bytes of other scripts stay; everything else is a gap.
_PLAIN = bytes(c if 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def _counts(text: str) -> np.ndarray:
    """Damped counts of the hashed n-grams of one text."""
    raw = np.frombuffer((" " + text + " ").encode("utf-8", "surrogatepass").translate(_PLAIN), np.uint8).astype(np.int32)
    letter = raw != 32
    pairs = raw[:-1] * 256 + raw[1:]
    triples = pairs[:-1] * 256 + raw[2:]
    grams = np.concatenate([
        raw[letter], pairs[letter[1:] | letter[:-1]] + (1 << 16), triples[letter[1:-1]] + (1 << 25)])
    slots = ((grams.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)
    return np.sqrt(np.bincount(slots, minlength=DIMS)).astype(np.float32)


def vectors(series: list[str], idf: np.ndarray) -> np.ndarray:
    x = np.array([_counts(t) for t in series], dtype=np.float32).reshape(-1, DIMS) * idf
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm == 0, 1, norm)


def has_letter(text: str | None) -> bool:
    return text is not None and _LETTER.search(text) is not None


@dataclass
class Centroids:
    idf: np.ndarray
    centre: np.ndarray  # (centroids, DIMS)
    lang: list[str]  # of each centroid
    limit: np.ndarray  # of each centroid

    def judge(self, series: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine and acceptance of each text."""
        lettered = np.array([has_letter(t) for t in series], dtype=bool)
        if not len(self.lang):
            return [UNKNOWN] * len(series), np.zeros(len(series)), np.zeros(len(series), dtype=bool)
        similar = vectors([t if ok else "" for t, ok in zip(series, lettered)], self.idf) @ self.centre.T
        best = similar.argmax(axis=1)
        score = np.clip(similar[np.arange(len(series)), best].astype(float), 0, 1) * lettered
        return [self.lang[k] if ok else UNKNOWN for k, ok in zip(best, lettered)], score, lettered & (score >= self.limit[best])


def cluster(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from k-means++ draws; clusters below ``LEAST_SHARE`` of the texts are given up."""
    rng = np.random.default_rng(1)
    chosen = [int(rng.integers(len(x)))]
    near = x @ x[chosen[0]]
    while len(chosen) < min(k, len(x)):
        far = np.maximum(0, 1 - near.astype(float))
        if far.sum() <= 1e-6:
            break
        chosen.append(int(rng.choice(len(x), p=far / far.sum())))
        near = np.maximum(near, x @ x[chosen[-1]])
    centre = x[chosen]
    for _ in range(_ROUNDS):
        own = (x @ centre.T).argmax(axis=1)
        size = np.bincount(own, minlength=len(centre))
        sums = np.array([x[own == j].sum(axis=0) for j in range(len(centre)) if size[j] and size[j] >= LEAST_SHARE * len(x)])
        centre = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centre.astype(np.float32)


def rejection_limit(own: np.ndarray, others: np.ndarray) -> float:
    """From the similarities of the centroid's own texts and of other languages' texts."""
    low = float(np.quantile(own, 0.01))
    return (low + min(low, float(np.median(others)))) / 2 if len(others) else ALONE * low


def _dense(sample: pa.Table) -> np.ndarray:
    """One row for each sparse vector, from the flat arrays of the table."""
    slots, counts = (sample.column(name).combine_chunks() for name in ("slots", "counts"))
    x = np.zeros((sample.num_rows, DIMS), dtype=np.float32)
    owner = np.repeat(np.arange(sample.num_rows), np.asarray(slots.value_lengths()))
    x[owner, np.asarray(slots.flatten())] = np.asarray(counts.flatten())
    return x


def train(docs: DataFrame, trained: Column, *, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id",
          bound: int = SAMPLE, centroids: int = CENTROIDS) -> Centroids:
    """Learn from the documents for which ``trained`` holds and the language is not null."""
    rows = docs.where(trained & F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull()).select(
        F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text"),
        F.pmod(F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), F.lit("sample")), F.lit(_DRAWS)).alias("draw"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one per language
    below = {lang: _DRAWS * bound / n for lang, n in sizes.items()}

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(DIMS, dtype=np.int64)
        drawn: set[tuple[str, int]] = set()
        for batch in batches:
            out = []
            for lang, text, draw in zip(batch["lang"], batch["text"], batch["draw"]):
                if not has_letter(text):
                    continue
                counts = _counts(text)
                seen += counts > 0
                if draw < below[lang] and (lang, draw) not in drawn:
                    drawn.add((lang, draw))
                    slots = np.flatnonzero(counts)
                    out.append((lang, draw, slots.astype(np.int16), counts[slots], None))
            if out:
                yield pd.DataFrame(out, columns=["lang", "draw", "slots", "counts", "seen"])
        yield pd.DataFrame({"lang": [None], "draw": [0], "slots": [None], "counts": [None], "seen": [seen]})

    found = common.store(rows.mapInPandas(gather, "lang string, draw long, slots array<short>, counts array<float>, seen array<long>"),
                         "language-counts")
    seen = np.zeros(DIMS)
    sums = found.where("lang is null").select(F.posexplode("seen").alias("slot", "n")).groupBy("slot").agg(F.sum("n").alias("n"))
    for r in sums.collect():  # DIMS rows
        seen[r["slot"]] = r["n"]
    idf = np.log((1 + sum(sizes.values())) / (1 + seen)).astype(np.float32) + 1
    centre, names, reached, probes = [], [], [], {}
    drawn = found.where("lang is not null").dropDuplicates(["lang", "draw"]).select("lang", "draw", "slots", "counts")
    for lang in sorted(sizes):
        x = _dense(drawn.where(F.col("lang") == lang).orderBy("draw").select("slots", "counts").toArrow())
        x *= idf
        if not len(x):
            continue
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        own = cluster(x, centroids)
        similar = x @ own.T
        best = similar.argmax(axis=1)
        probes[lang] = x[:PROBES].copy()
        for j in np.unique(best):
            centre.append(own[j])
            names.append(lang)
            reached.append(similar[best == j, j])
    limit = [rejection_limit(mine, np.concatenate([np.empty(0)] + [x @ c for other, x in probes.items() if other != lang]))
             for c, lang, mine in zip(centre, names, reached)]
    return Centroids(idf, np.array(centre, dtype=np.float32).reshape(-1, DIMS), names, np.array(limit))


def identify(text: Column, model: Centroids) -> Column:
    """A struct of lang, score and accepted."""

    @F.pandas_udf("lang string, score double, accepted boolean")
    def of(series: pd.Series) -> pd.DataFrame:
        out = [model.judge(list(series.iloc[at:at + 500])) for at in range(0, len(series), 500)]
        return pd.DataFrame({"lang": [x for p in out for x in p[0]], "score": [x for p in out for x in p[1]],
                             "accepted": [bool(x) for p in out for x in p[2]]})

    return of(text)
