"""Each stage of the corpus pipeline, and all of them, on a small corpus with planted documents."""

from __future__ import annotations

import math

import numpy as np
import pytest

import corpus_pipeline
from logweave.llm.common import store
from tests.llm.test_llm import kept_ids

ENGLISH = "the cat sat on a mat while nine dogs ran over green hills and said hello to every bird in town today".split()
GERMAN = "der hund und die katze sind nicht im garten aber auf dem haus weil wir heute schon wieder gearbeitet haben".split()
FINNISH = "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan oikeuksiltaan heille annettu järki omatunto".split()


def words(vocabulary, seed, n=60):
    return np.random.default_rng(seed).choice(vocabulary, n).tolist()


def changed(own, places):
    return [f"other{k}" if k in places else w for k, w in enumerate(own)]


#: Words of the clean documents, by id.
CLEAN = {i: words(ENGLISH if i < 120 else GERMAN, i) for i in range(240)}
PASSAGE = words(ENGLISH, 9999, 14)
# One changed word of 60; whether the fingerprints then link is for the plain version to say.
COPIES = {500 + k: changed(CLEAN[7 * k], {place}) for k, place in enumerate([30, 2, 59, 25, 57, 40])}
#: Three changed words that share no shingle.
RELATED = {550 + k: changed(CLEAN[100 + k], {12, 30, 48}) for k in range(5)}
LEAKS = {600 + k: words(ENGLISH, 5000 + k, 40) + PASSAGE for k in range(5)}
JUNK = {300 + k: [w.upper() + "!!" for w in words(ENGLISH, 3000 + k)] for k in range(100)}
FOREIGN = {400 + k: words(FINNISH, 4000 + k) for k in range(20)}


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("corpus"))
    rows = [(i, " ".join(w), None if i in FOREIGN else "de" if 120 <= i < 240 else "en", "clash", 0)
            for part in (CLEAN, COPIES, RELATED, LEAKS, JUNK, FOREIGN) for i, w in part.items()]
    rows += [(0, " ".join(CLEAN[0]), "en", "clash", 0), (700, None, "en", "clash", 0), (701, "", "en", "clash", 0), (None, " ".join(words(ENGLISH, 7777)), "en", None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, words string, row int").write.parquet(f"{root}/documents.parquet")
    labels = [(r[0], int(r[0] not in JUNK), 0) for r in rows if r[0] is not None and r[0] < 700]
    spark.createDataFrame(sorted(set(labels)), "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([("b", " ".join(PASSAGE)), ("n", None)], "item_id string, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def ids(frame):
    """Ids as text; whether a document without text passes for quality is open, the language stage drops it."""
    return sorted(i for i in (str(r["doc_id"]) for r in frame.select("doc_id").collect()) if i not in ("700", "701"))


def test_stages_and_run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    gone = {"quality": set(JUNK), "language": set(FOREIGN), "decontamination": set(LEAKS)}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name == "near_duplicates":
            plain = kept_ids([(r["doc_id"], r["text"]) for r in docs.collect()])
            want = sorted("None" if i == math.inf else str(i) for i in plain)
            assert len(want) < docs.count()
        else:
            want = [i for i in ids(docs) if i not in set(map(str, gone[name]))]
        kept = store(stage(spark, docs, sf_dir), f"test-{name}")
        assert kept.columns == docs.columns
        assert ids(kept) == want, name
        docs = kept
    left = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert left <= set(CLEAN) | set(RELATED) | set(COPIES) | {None}
    packed = corpus_pipeline.run(spark, sf_dir).select("doc_id").distinct().collect()
    assert {r["doc_id"] for r in packed} == left


def test_stages_of_an_empty_table(spark, sf_dir):
    empty = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0, name
