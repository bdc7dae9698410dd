"""Each operator against a brute-force version on small tables with nulls, empty and long texts, ties and repeats."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from logweave.llm import ann, boosting, components, decontaminate, langid, packing, ppm, quality, simhash, slots, toxicity, url_trie
from logweave.llm.common import fold
from logweave.operators import joins

WORDS = "the cat sat on a mat while nine dogs ran over green hills and said hello to every bird in town today".split()


def sentence(n: int, seed: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, n))


TEXTS = [
    None, "", "  \n\t", "One", "one ", "é ß 12 !!", sentence(30, 1), sentence(30, 1), sentence(30, 1).upper() + ".", sentence(29, 2),
    sentence(4000, 3), "x" * 20000, "<|endoftext|> kept", sentence(12, 4) + "  double\n\nspace ",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", "clash") for i, t in enumerate(TEXTS)] + [(6, TEXTS[6], "x", "clash"), (None, "no id", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, row string, words string").repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)


def low(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def test_url_rules(spark):
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"),
             ("block", "org", "/a"), ("allow", "org", "/a"), ("block", "org", "/a/b/c")]
    cases = {
        "http://Example.COM/en/1": ("block", "example.com/en/"), "http://example.com": ("allow", None), "http://example.com/x?y": ("allow", "com/"),
        "https://www.example.com/en/": ("allow", "www.example.com/en/"), "http://a.www.example.com/en/x": ("allow", "www.example.com/en/"),
        "http://notexample.com/en/": ("allow", "com/"), "http://net/es/": ("block", "net/es/"), "http://x.net/es": ("allow", None),
        "http://x.org/abc": ("block", "org/a"), "http://x.org/a/b/cd": ("block", "org/a/b/c"), "nothing": ("allow", None), None: ("allow", None),
    }
    pages = spark.createDataFrame([(u, "kept") for u in cases], "url string, host string")
    got = url_trie.judge(spark, pages, rules).collect()
    assert {r["url"]: (r["filter"]["verdict"], r["filter"]["rule"]) for r in got} == cases
    assert url_trie.judge(spark, pages.limit(0), rules).count() == 0


def test_slots(spark, docs, empty):
    many = docs.crossJoin(spark.range(60).select(F.col("id").alias("copy"))).select((F.col("doc_id") + 100 * F.col("copy")).alias("doc_id"), "text")
    hot = many.union(spark.range(800).select(F.lit(7).alias("doc_id"), F.lit(sentence(40, 9)).alias("text")))
    got = slots.assign(spark, hot, 24).toPandas()
    assert len(got) == hot.count()
    for _, own in got.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    bytes_of = got.groupby("shard")["size"].sum()
    assert len(bytes_of) == 24 and bytes_of.max() <= 1.3 * bytes_of.mean()
    first = got.iloc[0]
    assert slots.assign(spark, empty, 24).count() == 0
    assert first["size"] >= 8


def test_decontamination(spark, docs, empty):
    items = [("a", sentence(30, 1)), ("b", sentence(30, 1) + " more"), ("c", "One"), ("d", None), ("e", " ..."), ("c", "one")]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    word = re.compile(decontaminate.WORD)
    windows = [(i, w[k:k + min(10, len(w))]) for i, t in items for w in [word.findall(low(t))] if w for k in range(len(w) - min(10, len(w)) + 1)]
    expected = Counter()
    for r in docs.collect():
        words = word.findall(low(r["text"]))
        hit, found = set(), set()
        for item, window in windows:
            for at in range(len(words) - len(window) + 1):
                if words[at:at + len(window)] == window:
                    hit.update(range(at, at + len(window)))
                    found.add(item)
        expected[(r["doc_id"], len(words), len(hit), len(found), bool(hit))] += 1
    got = decontaminate.scan(docs, benchmark).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in got) == expected
    assert decontaminate.scan(empty, benchmark).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.scan(docs, benchmark.limit(0)).collect())
    kept = decontaminate.remove_documents(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == sum(n for k, n in expected.items() if not k[4])
    cut = {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(docs, benchmark).collect()}
    assert cut[9] == TEXTS[9] and cut[3] == "" and cut[8].split() == ["."] and cut[0] is None and cut[5] == TEXTS[5]


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    hashes = [xxhash.xxh64(" ".join(words[i:i + 4]).encode(), seed=42).intdigest() for i in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots_of(fps):
    parent = {f: f for f in fps}

    def find(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for a in fps:
        for b in fps:
            if bin(a ^ b).count("1") <= 4:
                parent[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_simhash(spark, docs, empty):
    got = simhash.near_duplicates(docs).collect()
    prints = {r["doc_id"]: plain_fingerprint(r["text"]) for r in docs.collect()}
    roots = roots_of(set(prints.values()))
    least = {}
    for i, f in prints.items():
        if i is not None:
            least[roots[f]] = min(i, least.get(roots[f], i))
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == Counter(
        (r["doc_id"], f"{prints[r['doc_id']]:016x}", least.get(roots[prints[r["doc_id"]]])) for r in docs.collect())
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(roots.values()))


@pytest.mark.parametrize("small, block", [(16, 8192), (3, 8), (2, 40)])
def test_links_of_dense_groups(spark, monkeypatch, small, block):
    """Clusters of many fingerprints, searched whole, breadth first, and in blocks."""
    monkeypatch.setattr(simhash, "SMALL", small)
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(5)
    fps = set()
    for centre in rng.integers(0, 1 << 63, 4, dtype=np.uint64).tolist() + [0, (1 << 64) - 1]:
        fps.update(centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False)) for _ in range(120))
    fps = sorted(fps)
    frame = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    got = simhash.components(simhash.link(frame)).toPandas()
    root = dict(zip(got["node"].to_numpy().view(np.uint64).tolist(), got["root"]))
    want = roots_of(fps)
    groups, seen = {}, {}
    for f in fps:
        groups.setdefault(want[f], set()).add(f)
        seen.setdefault(root.get(f, f"single {f}"), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, seen.values()))


def kept_ids(rows):
    """Ids of the rows (id, text) that a plain search keeps: the smallest of each component, null ids last."""
    prints = [(math.inf if i is None else i, plain_fingerprint(t)) for i, t in rows]
    root, least = roots_of({f for _, f in prints}), {}
    for i, f in prints:
        least[root[f]] = min(i, least.get(root[f], math.inf))
    return sorted(least.values())


def test_near_duplicate_stage_of_the_pipeline(spark, docs, empty):
    """Copies with more and more changed words, against all pairs."""
    import corpus_pipeline

    rng = np.random.default_rng(8)
    vocabulary = [f"w{k}" for k in range(3000)]
    texts = []
    for group in range(12):
        words = rng.choice(vocabulary, 200)
        for changes in (0, 0, 1, 1, 2, 3, 8):
            own = words.copy()
            own[rng.choice(200, changes, replace=False)] = rng.choice(vocabulary, changes)
            texts.append(" ".join(own))
    frame = docs.unionByName(spark.createDataFrame([(100 + i, t, "x", "y") for i, t in enumerate(texts)], docs.schema))
    kept = corpus_pipeline.drop_near_duplicates(spark, frame, "")
    assert kept.columns == docs.columns
    want = kept_ids([(r["doc_id"], r["text"]) for r in frame.collect()])
    assert sorted(math.inf if r["doc_id"] is None else r["doc_id"] for r in kept.collect()) == want
    assert len(want) < len(texts)
    assert corpus_pipeline.drop_near_duplicates(spark, empty, "").count() == 0


@pytest.mark.parametrize("broadcast_rows", [2_000_000, 5])
def test_components_with_a_hub_of_half_the_edges(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", broadcast_rows)
    monkeypatch.setattr(joins, "HOT_SHARE", 20)
    rng = np.random.default_rng(1)
    edges = [(500, k) for k in range(1000, 2000)] + [(int(a), int(a) + 1 + int(b)) for a, b in zip(rng.integers(3000, 5000, 1000), rng.integers(0, 3, 1000))]
    parent = {n: n for e in edges for n in e}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in got} == {n: find(n) for n in parent}


def test_hilbert_is_a_curve():
    grid = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    place = packing.hilbert(grid, 3)
    assert sorted(place) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(place)], axis=0)).sum(axis=1) == 1).all()


def test_packing(spark, docs, empty, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "RANGE_IDS", 2000)
    tokenizer = Tokenizer.from_file(packing.default_files()[0])
    got = packing.pack(docs.where("doc_id is not null").dropDuplicates(["doc_id"])).toPandas()
    for doc_id, pieces in got.groupby("doc_id"):
        ids = np.array(tokenizer.encode(TEXTS[int(doc_id)] or "", add_special_tokens=False).ids + [0], dtype="<u4")
        pieces = pieces.sort_values("start")
        assert (pieces["doc_tokens"] == len(ids)).all()
        assert b"".join(pieces["ids"]) == ids.tobytes()
        assert [zlib.crc32(x) for x in pieces["ids"]] == list(pieces["ids_crc32"])
    got = got.sort_values(["sequence_id", "offset"])
    place = got["sequence_id"] * 1024 + got["offset"]
    assert (place.to_numpy() == (got["length"].cumsum() - got["length"]).to_numpy()).all()
    assert packing.pack(empty).count() == 0


def test_language_samples_reach_the_driver_as_arrays(spark, monkeypatch):
    docs = spark.createDataFrame([(i, sentence(12, i), "ab"[i % 2]) for i in range(60)], "doc_id long, text string, lang string")
    monkeypatch.setattr(type(docs), "toPandas", lambda self: pytest.fail("rows of Python numbers on the driver"))
    taken = []
    monkeypatch.setattr(langid, "cluster", lambda x, k, run=langid.cluster: taken.append(x) or run(x, k))
    model = langid.train(docs, F.lit(True))
    idf = model.idf
    want = [langid.vectors([r["text"] for r in docs.collect() if r["lang"] == lang], idf) for lang in "ab"]
    for got, own in zip(taken, want):
        assert got.shape == own.shape and np.allclose(np.sort(got.sum(axis=1)), np.sort(own.sum(axis=1)), rtol=1e-5)
    assert set(model.lang) == {"a", "b"}


def test_ppm_probabilities_sum_to_one():
    texts = [low(sentence(60, s)).encode() for s in range(8)] + [b"", b"zz"]
    keys, sizes = ppm.positions(texts)
    string, n = np.unique(keys, return_counts=True)
    for share in (1 << 20, 200):
        levels = {}
        for k in range(1, ppm.ORDER + 2):
            own, where = np.unique(string & ((1 << (9 * k)) - 1), return_inverse=True)
            count = np.bincount(where, n).astype(np.int64)
            levels[k] = (own[count * share >= n.sum()], count[count * share >= n.sum()])
        trie = ppm.build(levels, int(n.sum()), len(texts))
        for context in [keys[0], keys[70], keys[-1], 0]:
            following = ((int(context) >> 9) << 9) + np.arange(257)
            assert math.isclose((10 ** trie.score(following)).sum(), 1, rel_tol=1e-9)
    assert sizes.sum() == len(keys)


def test_ppm_base_scores(spark, docs, empty):
    trained = fold(F.col("doc_id"), 7) != 2
    got = ppm.score(docs, trained).collect()
    tokens = [(r["doc_id"], re.findall(r"[^\x20\x09-\x0D]+", low(r["text"])) + [None]) for r in docs.collect()]
    count = Counter(w for i, ws in tokens if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2 for w in ws)
    total, kinds = sum(count.values()), len(count)
    want = sorted((str(i), len(ws), sum(count[w] > 0 for w in ws), round(sum(math.log10((count[w] + 1) / (total + kinds + 1)) for w in ws), 5)) for i, ws in tokens)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 5)) for r in got) == want
    assert all(r["score"] < 0 and r["train_tokens"] == total for r in got)
    assert ppm.score(empty, trained).count() == 0
    assert all(r["n_known"] == 0 for r in ppm.score(docs, F.lit(False)).collect())


def test_ppm_keeps_every_context(spark, monkeypatch):
    texts = [low(sentence(20 + 3 * s, s)) for s in range(40)] + ["", "zz", "zz", "q\u00e9 xyzzy", None, "xyzzy plugh " * 3]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for share in (1 << 22, 8):
        monkeypatch.setattr(ppm, "STRING_SHARE", share)
        for modulus in (3, 1000, 1):  # some held out, one, all
            taught = [t for i, t in enumerate(texts) if i % modulus]
            string, n = np.unique(ppm.positions([(t or "").encode() for t in taught])[0], return_counts=True) if taught else (np.empty(0, np.int64),) * 2
            levels = {}
            for k in range(1, ppm.ORDER + 2):
                own, where = np.unique(string & ((1 << (9 * k)) - 1), return_inverse=True)
                levels[k] = own, np.bincount(where, n, len(own)).astype(np.int64)
            trie = ppm.build(levels, int(n.sum()), len(taught))
            got = {r["doc_id"]: r["score"] for r in ppm.score(docs, F.col("doc_id") % modulus != 0).collect()}
            want = [trie.score(ppm.positions([(t or "").encode()])[0]).sum() for t in texts]
            assert [round(got[i], 6) for i in range(len(texts))] == [round(float(w), 6) for w in want]


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, rng.normal(size=16).tolist(), "x") for i in range(400)]
    vectors += [(i, [1.0] * 16, "x") for i in range(400, 460)]
    vectors += [(460, None, "x"), (480, [0.0] * 16, "x"), (500, [float("nan")] * 16, "x"), (520, [None] * 16, "x"), (540, [1.0], "x")]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, h string")
    got = ann.search(frame, F.col("id") % 20 == 0).toPandas()
    real = {i: np.array(v) for i, v, _ in vectors[:460]}
    hits = total = 0
    for q in (i for i in real if i % 20 == 0):
        best = sorted((-float(v @ real[q]), i) for i, v in real.items() if i != q)[:20]
        own = got[got["query_id"] == q].sort_values("rank")
        assert list(own["rank"]) == list(range(1, 21))
        assert np.allclose(own["score"], [real[i] @ real[q] for i in own["vec_id"]], rtol=1e-12)
        hits += len({i for _, i in best} & set(own["vec_id"]))
        total += 20
    assert hits / total >= 0.9
    assert ann.search(frame.limit(0), F.col("id") % 20 == 0).count() == 0


def test_neighbours_verify_a_falling_share():
    """Two tables of which most rows are not verified: recall holds, and a query's verified rows grow slower than the table."""
    verified = {}
    for n in (6_000, 24_000):
        rows = np.random.default_rng(n).normal(size=(n, 64))
        rows /= np.linalg.norm(rows, axis=1, keepdims=True)
        asked = rows[:40]
        best = np.argsort(-(asked @ rows.T), axis=1)[:, :20]
        found = [set() for _ in asked]
        for block in np.array_split(np.arange(n), -(-n // ann.BLOCK)):
            near = ann.Index(rows[block], 1.0).near(asked, ann.share_of(n))
            for own, hit in zip(found, near):
                own |= set(block[hit].tolist())
        verified[n] = np.mean([len(own) for own in found])
        assert np.mean([len(set(b.tolist()) & own) / 20 for b, own in zip(best, found)]) >= 0.9
        assert verified[n] < 0.45 * n
    assert verified[24_000] < 0.8 * 4 * verified[6_000]


def test_boosting_learns_an_interaction():
    x = np.random.default_rng(0).normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.5)).astype(float)
    forest = boosting.fit(x[:2000], y[:2000])
    assert ((forest.probability(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    assert (boosting.fit(x[:0], y[:0]).probability(x[:3]) == 0.5).all()


def test_quality(spark, docs, empty):
    rows = [(i, sentence(40, i) if i % 3 else " ".join(w.upper() + "!!" for w in sentence(40, i).split()), int(i % 3 > 0)) for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    forest = quality.train(frame.drop("quality"), frame.drop("text"), F.col("doc_id") < 200)
    got = frame.where("doc_id >= 200").select("quality", quality.score(F.col("text"), forest).alias("s")).collect()
    assert all((r["s"] >= 0.5) == (r["quality"] == 1) for r in got)
    assert all(0 <= r["s"] <= 1 for r in docs.select(quality.score(F.col("text"), forest).alias("s")).collect())
    assert empty.select(quality.score(F.col("text"), forest)).count() == 0


def test_language(spark, docs, empty):
    other = "der hund und die katze sind nicht im garten aber auf dem haus".split()
    rows = [(i, " ".join(np.random.default_rng(i).choice(WORDS if i % 2 else other, 20)), "en" if i % 2 else "de") for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(frame, F.col("doc_id") < 150)
    got = frame.where("doc_id >= 150").select("lang", langid.identify(F.col("text"), model).alias("l")).collect()
    assert all(r["l"]["lang"] == r["lang"] and r["l"]["accepted"] for r in got)
    odd = {r["text"]: r["l"] for r in docs.select("text", langid.identify(F.col("text"), model).alias("l")).collect()}
    assert odd[None]["lang"] == odd[""]["lang"] == "und" and not odd[None]["accepted"]
    assert empty.select(langid.identify(F.col("text"), model)).count() == 0


def test_unseen_language_and_gibberish_are_rejected(spark):
    spoken = {
        "de": "der hund und die katze sind nicht im garten aber auf dem haus weil wir heute schon wieder gearbeitet haben".split(),
        "en": WORDS,
        "fr": "le chien est dans la maison avec une petite fille qui mange du pain pendant que nous parlons encore".split(),
        "fi": "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan oikeuksiltaan heille annettu järki omatunto hello town dogs".split(),  # with loan words
    }
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(rng.choice(spoken[lang], 40)), lang) for i in range(150) for lang in spoken]
    rows += [(i, " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(40)), "??") for i in range(150)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").cache()
    for known in (["de", "en", "fr"], ["en"]):
        model = langid.train(frame, (F.col("doc_id") < 100) & F.col("lang").isin(known))
        got = frame.where("doc_id >= 100").select("lang", langid.identify(F.col("text"), model).alias("l")).collect()
        right = Counter((r["lang"], r["l"]["accepted"], r["l"]["lang"] == r["lang"]) for r in got if r["lang"] in known)
        assert right == {(lang, True, True): 50 for lang in known}
        assert not any(r["l"]["accepted"] for r in got if r["lang"] not in known)


def test_centroids_of_two_varieties_with_outliers():
    rng = np.random.default_rng(4)
    north, south = "abcdefghij", "klmnopqrst"
    texts = [" ".join("".join(rng.choice(list(v), 4)) for _ in range(60)) for v in [north] * 150 + [south] * 100]
    texts += ["zz zz zz", "yyyy", "xvx xvx", "uu wu", "%"]
    x = langid.vectors(texts, np.ones(langid.DIMS, np.float32))
    centre = langid.cluster(x, langid.CENTROIDS)
    own = (x @ centre.T).argmax(axis=1)
    assert np.bincount(own, minlength=len(centre)).min() >= langid.LEAST_SHARE * len(x)
    assert not set(own[:150]) & set(own[150:250])


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_levenshtein_automaton():
    terms = ["idiot", "worthless", "scum", "pathetic", "loser"]
    lexicon = toxicity.Lexicon(terms)
    rng = np.random.default_rng(1)
    for _ in range(3000):
        token = list(rng.choice(terms))
        for _ in range(rng.integers(0, 4)):
            at, ch = rng.integers(0, len(token) + 1), rng.choice(list("aeoxz"))
            token = rng.choice(3) == 0 and token[:at] + [ch] + token[at:] or token[:at] + token[at + 1:] if rng.integers(2) else token[:at] + [ch] + token[at + 1:]
        token = "".join(token)
        near = min(((edits(t, token), t) for t in terms if edits(t, token) <= (toxicity.budget(t) if len(t) >= 5 else 0)), default=None)
        found = lexicon.find(token)
        assert (found and found[1]) == (near and near[0])
        assert found is None or lexicon.possible(token)
    assert lexicon.matches('they wrote "you idiot" there')[0][3] and not lexicon.matches("you idi0t")[0][3]


def test_toxicity(spark, docs, empty):
    rows = [(i, sentence(20, i) + (" vile " if i % 4 == 0 else " ") + sentence(20, i + 1000), int(i % 4 == 0)) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(frame.drop("toxic"), frame.drop("text"), F.col("doc_id") < 300)
    assert "vile" in model.terms or "vile*" in model.terms
    got = frame.where("doc_id >= 300").select("toxic", toxicity.score(F.col("text"), model).alias("s")).collect()
    assert all((r["s"] >= 0.3) == (r["toxic"] == 1) for r in got)
    assert all(r["s"] < 0.3 for r in docs.select(toxicity.score(F.col("text"), model).alias("s")).collect())
    assert empty.select(toxicity.score(F.col("text"), model)).count() == 0
