"""Collocations, whitening and packing against plain versions."""

import collections
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from labelforge.llm import collocations, packing, queries, whitening
from labelforge.llm.common import word_runs

SF = "/root/testdata/sf0.001"
ODD = [(1, "the big house the big house.", "en"), (2, None, "en"), (3, "", None), (4, " \t \n ;;", "en"),
       (5, "A b\x0bA b\rA b c d e", None), (6, "x " * 3000, "de"), (7, "der große Baum, der große Baum! DER GROßE", "de"),
       (1, "the big house the big house.", "en"), (None, "Ä ä É É É \x00 \x1f a b", "fr"), (9, "tie one tie two", ""),
       (10, "a b c d a b c d a b c d", "en"), (11, "中文 字 中文 字 中文 字", "zh")]


@pytest.fixture(scope="module")
def odd(spark):
    # prefix, n and score clash with the operators' own names.
    return spark.createDataFrame([(*r, 1.0, "x", 2) for r in ODD],
                                 "doc_id long, text string, lang string, prefix double, n string, score int")


def plain_collocations(rows, least, top=2000):
    counts, totals = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, 5):
                counts[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        f = {p: c for p, c in f.items() if c >= least}
        around = collections.Counter()
        for p, c in f.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    around[p[i:i + m]] = max(around[p[i:i + m]], c)
        rows = []
        for p, a in f.items():
            if len(p) > 1 and not (p in around and 100 * around[p] >= 80 * a):
                cut = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-cut[0], -a, " ".join(p).encode(), f[p[:cut[1]]], f[p[cut[1]:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -s))
    return sorted(out)


def mined(df, **kw):
    return sorted(tuple(r) for r in collocations.collocations(df, **kw).collect())


@pytest.mark.parametrize("least,top", [(1, 2000), (2, 3), (3, 2000)])
def test_collocations_odd(odd, least, top):
    assert mined(odd, least=least, top=top) == plain_collocations([(r[1], r[2]) for r in ODD], least, top)


def test_collocations_table_in_shards_and_small_chunks(spark, monkeypatch):
    """Many shards, chunks and false hits of a full bitmap change nothing."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = plain_collocations([(r.text, r.lang) for r in docs.select("text", "lang").collect()], 6, 50)
    assert mined(docs.repartition(3), least=6, top=50) == want
    monkeypatch.setattr(collocations, "SHARD_LEAST", 64)
    monkeypatch.setattr(collocations, "SALTS", 3)
    monkeypatch.setattr(collocations, "MAX_BITS", 64)
    assert mined(docs, least=6, top=50) == want


def test_collocations_hot_prefix_is_cut(spark, monkeypatch):
    monkeypatch.setattr(collocations, "SHARD_LEAST", 4)
    """More shards for a frequent prefix; the others keep one."""
    frequent = spark.createDataFrame([("en", "the", 41), ("en", "rare", 4)], "lang string, phrase string, n long")
    assert collocations._hot(frequent, 45) == {("en", "the"): 11}


def test_collocations_empty(odd):
    assert mined(odd.limit(0)) == [] and mined(odd.where("doc_id = 4")) == []


def test_collocations_exact_beyond_64_bits(spark):
    big = 10 ** 15
    extended = spark.createDataFrame([("en", "a b", big)], "lang string, phrase string, a long")
    totals = spark.createDataFrame([("en", "a", big + 7), ("en", "b", big + 1)], "lang string, prefix string, f long")
    assert collocations.weakest_cuts(extended, totals).collect()[0].score == 2_000_000 * big // (2 * big + 8)


@given(st.text(max_size=60), st.sampled_from([b" \n", b" \n\t\r"]))
@settings(max_examples=200, deadline=None)
def test_word_runs(text, delimiters):
    words, starts, ends = word_runs(text.encode(), delimiters)
    want = [w for w in re.split(b"[" + re.escape(delimiters) + b"]", text.encode()) if w]
    assert [w.encode() for w in words.to_pylist()] == want
    assert [text.encode()[a:b] for a, b in zip(starts, ends)] == want


def plain_whitening(rows):
    x = np.array([[int(np.floor(1024 * float(c))) + 100_000 for c in v] for v in rows], object)
    n, s = len(x), x.sum(axis=0)
    d = n * x - s
    cov = (d.T @ d / n ** 3).astype(float)
    values, vecs = np.linalg.eigh(cov)
    order = np.argsort(-values)[:8]
    deviation = [int(v) for v in (d * d).sum(axis=1)]
    return n, deviation, (d / n).astype(float) @ vecs[:, order] / np.sqrt(values[order]), values[order] / np.trace(cov)


def test_whitening_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").repartition(5)
    rows = {r.vec_id: r.embedding for r in table.collect()}
    ids = sorted(rows)
    n, deviation, white, explained = plain_whitening([rows[i] for i in ids])
    got = whitening.whiten(table).collect()
    assert len(got) == 8 * n and {r.n for r in got} == {n}
    found = np.zeros_like(white)
    for r in got:
        i = ids.index(r.vec_id)
        assert r.deviation == deviation[i] == int(r.deviation_exact)
        assert abs(r.explained - explained[r.component - 1]) < 1e-9 and r.identity_error <= 1e-9
        found[i, r.component - 1] = r.whitened
    sign = np.sign((found * white).sum(axis=0))
    assert np.abs(found * sign - white).max() < 1e-7


def test_whitening_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.1, 0.2, -0.3]), (2, [0.5, -0.25, 0.0]), (2, [0.5, -0.25, 0.0]), (None, [1e-9, -1e-9, 3.0]), (3, None),
            (4, [0.0, None, 1.0]), (5, [nan, 1.0, 1.0]), (6, [1.0, -inf, 1.0]), (7, [1.0]), (8, [2.0, 5.0, -1.0])]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "vec_id long, embedding array<double>, n string, component int")
    got = whitening.whiten(df).collect()
    kept = [r[1] for r in rows if r[0] in (1, 2, 8, None)]
    n, deviation, _, _ = plain_whitening(kept)
    assert len(got) == 3 * n == 15 and sorted(r.deviation for r in got if r.component == 1) == sorted(deviation)
    assert all(r.identity_error < 1e-9 for r in got)
    same = whitening.whiten(df.where("vec_id = 2")).collect()
    assert {(r.deviation, r.whitened, r.explained, r.identity_error) for r in same} == {(0, None, None, 0.0)}
    assert whitening.whiten(df.where("vec_id = 3")).collect() == []
    assert whitening.whiten(df.limit(0)).columns[:2] == ["vec_id", "component"]
    huge = spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [0.0, 0.0])], "vec_id long, embedding array<double>")
    found = whitening.whiten(huge).collect()
    assert len(found) == 6 and any(r.deviation is None and r.deviation_exact > 1 << 63 for r in found)


@given(st.lists(st.lists(st.integers(-2 ** 40, 2 ** 40), min_size=3, max_size=3), min_size=1, max_size=70))
@settings(max_examples=100, deadline=None)
def test_cross_products_are_exact(rows):
    x = np.array(rows, np.int64)
    sums, products = whitening.cross_products(x)
    want = x.astype(object)
    assert list(sums) == list(want.sum(axis=0)) and (products == want.T @ want).all()


def test_hilbert_curve_visits_neighbours():
    side = 8
    grid = np.stack(np.meshgrid(*[np.arange(side)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = packing.hilbert_key(grid, 3)
    assert sorted(keys) == list(range(side ** 3))
    walk = grid[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


LETTERS = st.sampled_from("abzAZéÉßÿŁжΣς中ﬁ\u0301\u0338=<>'\"#.,;1230²½_×÷ \n\t\r\x00\x1c\u00a0\u2028…”😀İſ")


@given(st.lists(st.text(LETTERS, max_size=25) | st.sampled_from(["it's we've o'clock l'arbre '", "a<|endoftext|>b##"]), max_size=6))
@settings(max_examples=400, deadline=None)
def test_parts_give_the_tokenizers_ids(texts):
    encoder = packing._encoder(packing.vocabulary(), 2)
    if texts:
        ids, counts, _ = packing.tokenize(texts, encoder)
        want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in texts]
        assert [list(x) for x in np.split(ids, np.cumsum(counts)[:-1])] == want


def check_packed(docs, rows, length=4096):
    """Every id of every document lies in one piece and every sequence is full."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary())
    want = collections.Counter()
    for key, text in rows:
        want[key, tuple(tokenizer.encode(text or "", add_special_tokens=False).ids + [2])] += 1
    cut = packing.pack(docs, length=length).cache()
    at = sorted(cut.collect(), key=lambda r: (r.sequence_id, r.offset))
    place, got, open_docs = 0, collections.Counter(), []
    for r in at:
        assert r.sequence_id * length + r.offset == place and 0 < r.length == len(r.ids) <= length - r.offset
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        place += r.length
        if r.start == 0:
            open_docs = []
        assert r.start == len(open_docs)
        open_docs += r.ids
        if len(open_docs) == r.doc_tokens:
            got[r.doc_id, tuple(open_docs)] += 1
    assert got == want
    full = {r.sequence_id: r for r in packing.sequences(cut, length).collect()}
    assert all(len(r.ids) == length for r in full.values()) and sum(r.used for r in full.values()) == place
    assert sum(r.used < length for r in full.values()) <= 1
    cut.unpersist()
    return at


def test_packing_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    at = check_packed(docs.repartition(4), rows)
    bare = packing.pack(docs, with_ids=False)
    assert "ids" not in bare.columns
    first = sorted((r.doc_id, r.start) for r in bare.collect() if r.start == 0)
    assert first == sorted((r.doc_id, 0) for r in at if r.start == 0)


def test_packing_odd(spark, odd):
    extra = [(20, "it's <|endoftext|> I’ll we've naïve café 1234 Σίσυφος ΟΔΟΣ\u0085x \x1c y   z", "en"),
             (21, "w" * 5000 + " " + "é" * 300, "en"), (22, "́ ́a", None)]
    docs = odd.select("doc_id", "text", F.col("score").alias("key"), F.col("n").alias("ids")).unionByName(
        spark.createDataFrame([(a, b, 1, "x") for a, b, _ in extra], "doc_id long, text string, key int, ids string"))
    check_packed(docs, [(a, b) for a, b, _ in ODD + extra], 64)
    assert packing.pack(docs.limit(0)).collect() == []


def test_packing_neighbours_share_words(spark):
    """Documents of one vocabulary lie together on the line."""
    rng = np.random.default_rng(3)
    topics = [[f"{t}{i}" for i in range(40)] for t in "abcd"]
    rows = [(i, " ".join(rng.choice(topics[i % 4], 60))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    line = sorted(packing.line_up(packing.curve_documents(docs, packing.vocabulary())).collect(), key=lambda r: r.at)
    changes = sum(a.doc_id % 4 != b.doc_id % 4 for a, b in zip(line, line[1:]))
    assert changes < 60  # 149 expected in random order


def test_new_queries_are_registered():
    assert {"op11_collocations", "op12_whitening", "op13_packing"} <= set(queries.LLM_QUERIES)
