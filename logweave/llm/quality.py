"""Quality classifier: boosted trees over document statistics.

Statistics are counts and ratios of the whole text; language, source and id play no part. Labels
are learned from about ``SAMPLE`` labelled rows, picked by a hash of the id, and at most ``SLACK`` times as many: the documented
bound of what reaches the driver, which fits the trees. Where ids repeat so much that more rows belong to the picked ids,
equal rows count once and the others are picked by a hash of id and text. The fitted forest (a few kB of arrays) is
broadcast with the scoring function, and every text is scored in one pass without a shuffle.

Cases: null and empty texts have statistics zero and a score like any other; a null label teaches nothing; an id with
several labels counts as 1 if one of them is 1; repeated rows are scored one by one; without labels every score is 0.5. Other
columns are kept, the score is one added column.
"""

from __future__ import annotations

import sys
from collections import Counter

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from logweave.llm import common
from logweave.llm.boosting import Forest, fit

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Labelled rows that the classifier is fitted on, at most (in expectation of the hash).
SAMPLE = 20_000
#: Rows that may belong to the picked ids, as a multiple of the bound.
SLACK = 2
_CLASSES = [
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n", b".", b",", b"!", b"?", b"'\"",
    b"#$%&*", b"|", b"<>{}[]()", b"@/:_-=+\\~^;`", bytes(range(128, 256)),
]
_MEMBER = np.zeros((256, len(_CLASSES)))
for _k, _chars in enumerate(_CLASSES):
    _MEMBER[list(_chars), _k] = 1
WIDTH = len(_CLASSES) + 11


def statistics(series: list[str]) -> np.ndarray:
    """One row of ``WIDTH`` statistics per text."""
    out = np.zeros((len(series), WIDTH))
    for i, text in enumerate(series):
        raw = text.encode("utf-8", "surrogatepass")
        if not raw:
            continue
        counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        share = counts / len(raw)
        words = raw.split()
        distinct = Counter(words)
        lines = [x for x in raw.split(b"\n") if x]
        sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
        present = share[share > 0]
        odd = sum(1 for w in words if not (w[-1:].isalpha() or w[-1] > 127 or w[-1:] in b".,"))
        at = len(_CLASSES)
        out[i, :at] = share @ _MEMBER
        out[i, at:] = (
            np.log1p(len(raw)), np.log1p(len(words)), sizes.mean(), sizes.max(), sizes.std(),
            len(distinct) / max(1, len(words)), max(distinct.values(), default=0) / max(1, len(words)),
            len(set(lines)) / max(1, len(lines)), np.log1p(len(raw) / max(1, len(lines))), -(present * np.log(present)).sum(),
            odd / max(1, len(words)),
        )
    return out


def sample_labels(labels: DataFrame, label: str, trained: Column, bound: int, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, y) of about ``bound`` rows at most, one per id."""
    known = labels.where(F.col(f"`{label}`").isNotNull() & F.col(f"`{id_col}`").isNotNull() & trained)
    rows = known.count()
    picked = common.sampled(known, F.col(f"`{id_col}`"), rows, bound)
    return picked.groupBy(F.col(f"`{id_col}`").alias("doc_id")).agg(F.max(F.col(f"`{label}`").cast("double")).alias("y"))


def labelled_texts(docs: DataFrame, sample: DataFrame, bound: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, y) of the sampled ids, about ``SLACK`` times ``bound`` rows at most; the sample is bounded, hence broadcast."""
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    found = texts.join(F.broadcast(sample), "doc_id")
    if texts.select("doc_id").join(F.broadcast(sample), "doc_id").count() <= SLACK * bound:
        return found
    pairs = found.select("doc_id", F.xxhash64("text")).distinct().count()
    key = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    return common.sampled(found, key, pairs, bound).distinct()


def train(docs: DataFrame, labels: DataFrame, trained: Column, *, label: str = "quality", bound: int = SAMPLE,
          id_col: str = "doc_id", text_col: str = "text") -> Forest:
    """Fit on the labelled rows for which ``trained`` (a condition on the labels' id) holds."""
    rows = labelled_texts(docs, sample_labels(labels, label, trained, bound), bound, id_col, text_col)

    @F.pandas_udf("array<double>")
    def measure(series: pd.Series) -> pd.Series:
        return pd.Series(list(statistics(common.texts(series))))

    found = rows.select("doc_id", "y", measure("text").alias("x")).orderBy("doc_id", "y").toPandas()
    x = np.array(found["x"].tolist()).reshape(-1, WIDTH)
    return fit(x, found["y"].to_numpy(dtype=float))


def score(text: Column, forest: Forest) -> Column:
    """Probability that the text is of label 1."""

    @F.pandas_udf("double")
    def of(series: pd.Series) -> pd.Series:
        found = common.texts(series)
        parts = [forest.probability(statistics(found[at:at + 1000])) for at in range(0, len(found), 1000)]
        return pd.Series(np.concatenate(parts) if parts else np.empty(0))

    return of(text)
