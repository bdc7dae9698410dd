"""Mixing, tokenizer alignment and spelling variants against plain versions."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from logweave.llm import alignment, mixing, queries, variants

WORDS = "the cat sat on a mat while nine dogs ran over green hills and said hello to every bird in town today".split()


def sentence(n, seed, vocabulary=WORDS):
    return " ".join(np.random.default_rng(seed).choice(vocabulary, n))


def lower(text):
    return text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


# ---- mixing ----

ROWS = (
    [(i, sentence(5 + i % 40, i), f"src{i % 4}") for i in range(200)]
    + [(1000 + i, sentence(20, 7), "src9") for i in range(300)]  # most rows are in one source
    + [(7, sentence(30, 3), "src1")] * 5 + [(None, sentence(9, 4), "src2"), (8, None, "src2"), (9, "", None), (10, sentence(3000, 5), None)]
    + [(11, None, "void")]
)


def plain_mix(rows, weights=(5, 2, 1), total=1.5, most=2):
    """Sizes and taken words by document, and targets by source."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    of = defaultdict(int)
    for (_, _, s), n in zip(rows, size):
        of[s] += n
    order = sorted(of, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, free, left = {}, list(order), total * sum(size)
    while free:
        level = left / sum(weight[s] for s in free)
        full = [s for s in free if most * of[s] <= level * weight[s]]
        if not full:
            target |= {s: level * weight[s] for s in free}
            break
        for s in full:
            target[s] = most * of[s]
            left -= target[s]
            free.remove(s)
    out = []
    for s in order:
        keyed = []
        for (i, t, source), n in zip(rows, size):
            if source == s:
                text = t or ""
                u = (int(hashlib.md5(f"{'' if i is None else i}:{text}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
                keyed.append((-math.log(u) / ((1 + len(re.findall("[A-Za-z]", text))) / (1 + len(text))), n, i))
        want = math.floor(target[s] + 0.5)
        whole = want // of[s] if of[s] else 0
        rest = want - whole * of[s]
        for _, n, i in sorted(keyed, key=lambda x: x[:2]):
            part = min(n, max(rest, 0))
            rest -= part
            out.append((i, s, n, of[s], target[s], whole * n + part))
    return out


@pytest.fixture(scope="module")
def mixed_docs(spark):
    return spark.createDataFrame([(*r, 1, 2) for r in ROWS], "doc_id long, text string, source string, size int, target int")


@pytest.mark.parametrize("weights, total", [((5, 2, 1), 1.5), ((1,), 1.99), ((1, 0.01), 0.3)])
def test_mixing(spark, mixed_docs, weights, total):
    got = mixing.mix(mixed_docs.repartition(5), weights=weights, total=total).collect()
    want = plain_mix(ROWS, weights, total)
    assert Counter((r["doc_id"], r["source"], r["size"], r["source_size"], r["taken"]) for r in got) == Counter((*w[:4], w[5]) for w in want)
    targets = {r["source"]: r["target"] for r in got}
    assert all(targets[w[1]] == pytest.approx(w[4]) for w in want)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert sum(targets.values()) == pytest.approx(total * sum(w[2] for w in want))


def test_mixing_prefers_documents_of_high_weight_and_agrees_on_reruns(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("one two three four").alias("text"), (F.col("id") % 2).cast("string").alias("source"))
    weight = F.when(F.col("doc_id") % 10 < 5, 9.0).when(F.col("doc_id") % 10 == 5, float("nan")).otherwise(1.0)
    runs = [mixing.mix(d, weight=weight, weights=(1, 9), total=1.2).toPandas().sort_values("doc_id", ignore_index=True) for d in (docs, docs.repartition(7))]
    assert runs[0].equals(runs[1])
    drawn = runs[0][runs[0]["source"] == "0"]
    assert drawn[drawn.doc_id % 10 < 5].taken.mean() > 2 * drawn[drawn.doc_id % 10 > 5].taken.mean()


def test_mixing_of_nothing(spark, mixed_docs):
    assert mixing.mix(mixed_docs.limit(0)).count() == 0
    got = mixing.mix(mixed_docs.where("text is null")).collect()
    assert len(got) == 2 and all(r["taken"] == 0 and r["target"] == 0 for r in got)


# ---- alignment ----

TEXTS = [
    None, "", " ", "One", sentence(40, 1), sentence(40, 1), "<|endoftext|> kept <s>x</s>", "a▁b", "naïve façade ½ 日本語 🙂 \n\n\t x", "x" * 5000,
    "thethe the" * 80, sentence(4000, 3), "  two  spaces ", "\x00\x01",
]


def plain_alignment(texts):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a_side = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printed]
    byte_of = {chr(b): b for b in printed} | {chr(256 + k): b for k, b in enumerate(others)}
    entry = {i: t for t, i in a_side.get_vocab(with_added_tokens=False).items()}

    def spell_b(i):
        piece = b_side.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b_side.is_byte(i) else piece.replace("▁", " ").encode()

    groups_of = []
    for text in texts:
        groups = []
        if text:
            a, b = a_side.encode(" " + text, add_special_tokens=False).ids, b_side.encode(text)
            ends = [np.cumsum([len(x) for x in spelt]).tolist() for spelt in ([entry[i] for i in a], map(spell_b, b))]
            spelt = [bytes(byte_of[c] for i in a for c in entry[i]), b"".join(map(spell_b, b))]
            if spelt == [b" " + text.encode()] * 2:
                begin_a = begin_b = 0
                for cut in sorted({*ends[0]} & {*ends[1]}):
                    to_a, to_b = ends[0].index(cut) + 1, ends[1].index(cut) + 1
                    groups.append((a[begin_a:to_a], b[begin_b:to_b]))
                    begin_a, begin_b = to_a, to_b
        groups_of.append(groups)
    holds = Counter(p for groups in groups_of for p in {(x, y) for a, b in groups for x in a for y in b})
    most = defaultdict(int)
    for (x, _), n in holds.items():
        most[x] = max(most[x], n)
    out = []
    for groups in groups_of:
        links = [(x, y) for a, b in groups for x in a for y in b]
        spelt = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), sum(holds[p] == most[p[0]] for p in links),
                    sum(holds[p] for p in links), hashlib.sha256(spelt.encode()).hexdigest() if groups else ""))
    return out


@pytest.mark.parametrize("chunk, step", [(1 << 20, 1 << 20), (300, 7)])
def test_alignment(spark, monkeypatch, chunk, step):
    monkeypatch.setattr(alignment, "CHUNK", chunk)
    monkeypatch.setattr(alignment, "STEP", step)
    docs = spark.createDataFrame([(i if i else None, t, 3, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, chunk int, pairs string")
    got = alignment.alignments(docs.repartition(3)).collect()
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = [(i if i else None, *w) for i, w in enumerate(plain_alignment(TEXTS))]
    assert Counter((r["doc_id"], *(r[c] for c in columns)) for r in got) == Counter(want)
    assert sum(w[1] == 0 for w in want) == 3  # null, empty and the piece mark
    assert alignment.alignments(docs.limit(0)).count() == 0


@pytest.mark.parametrize("step", [1, 5, 1000])
def test_products_of_sparse_rows(step):
    rng = np.random.default_rng(step)
    for shape in ((6, 9, 5), (1, 4, 1), (12, 3, 12)):
        left, right = (rng.integers(0, 4, s) * (rng.random(s) < 0.4) for s in (shape[:2], shape[1:]))
        csr = [alignment.Csr.from_entries(*np.nonzero(m), m[np.nonzero(m)], *m.shape) for m in (left, right)]
        dense = np.zeros((shape[0], shape[2]), int)
        for i, j, v in alignment.gustavson(*csr, shape[2], step):
            assert (np.diff(i * shape[2] + j) > 0).all()
            dense[i, j] += v
        assert (dense == left @ right).all()
        again = csr[0].transposed(shape[1]).transposed(shape[0])
        assert [*again.start] == [*csr[0].start] and [*again.columns] == [*csr[0].columns] and [*again.values] == [*csr[0].values]


def test_overlaps_share_bytes():
    i, j, shared = alignment.overlaps(np.array([1, 2, 3]), np.array([2, 1, 1, 2]))
    assert [*zip(i.tolist(), j.tolist(), shared.tolist())] == [(0, 0, 1), (1, 0, 1), (1, 1, 1), (2, 2, 1), (2, 3, 2)]
    assert [x.tolist() for x in alignment.groups_of(i, j, 3, 4)] == [[0, 0, 1], [0, 0, 1, 1]]


# ---- spelling variants ----

def misspelt(doc_id, run):
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    return run if h % 31 else run[:h % len(run)] + run[h % len(run) + 1:]


def plain_variants(rows):
    n = Counter(misspelt(i, lower(run)) for i, text in rows for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""))
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}

    def is_near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))

    near = {w: [x for x in n if is_near(w, x)] for w in n}
    best = {w: min(x, key=lambda v: (-n[v], v)) for w, x in near.items() if x}
    form = {w: v for w, v in best.items() if n[v] >= 10 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


def spelt(k, seed):
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice([*"abé"], rng.integers(6, 11))) for _ in range(k)]


VARIANT_ROWS = (
    [(i, sentence(300, i, spelt(150, 1))) for i in range(30)] + [(100 + i, sentence(900, i, ["abcdefgh", "Abcdéfgh×", "bcdefghi"])) for i in range(3)]
    + [(200, "abcdefg abcdefg " + "abcdef " * 9), (None, "éabcdefgh ABCDEFGH"), (201, None), (202, ""), (203, ("x" * 3000 + " ") * 20 + ("x" * 2999 + " ") * 2)]
    + [(300 + i, "chainabcd " * 40) for i in range(12)] + [(320 + i, "chainabc " * 6) for i in range(6)] + [(341, "chainab chainab")]
    + [(100, sentence(900, 0, ["abcdefgh", "Abcdéfgh×", "bcdefghi"]))]
)


@pytest.mark.parametrize("cells, small, portion", [(1 << 16, 24, 1 << 20), (100, 24, 1 << 20), (1 << 16, 1, 50), (64, 1, 50)])
def test_variants(spark, monkeypatch, cells, small, portion):
    for name, value in (("CELLS", cells), ("SMALL", small), ("PORTION", portion)):
        monkeypatch.setattr(variants, name, value)
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in VARIANT_ROWS], "doc_id long, text string, word string, n int")
    got = variants.group(variants.count_words(docs.repartition(3), change=queries._misspelt)).select("word", "form", "root", "n", "n_near", "form_n")
    want = plain_variants(VARIANT_ROWS)
    assert {tuple(r) for r in got.collect()} == want
    assert any(w[1] and w[1] != w[2] for w in want) and len(want) > 100


def test_variants_of_nothing_and_of_short_words(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert variants.group(variants.count_words(empty)).count() == 0
    words = spark.createDataFrame([("a", 100), ("b", 5), ("ab", 200), ("cd", 1)], "word string, n long")
    got = {r["word"]: (r["form"], r["root"], r["n_near"]) for r in variants.group(words).collect()}
    assert got == {"a": (None, "a", 2), "b": ("ab", "ab", 2), "ab": (None, "ab", 2), "cd": (None, "cd", 0)}
