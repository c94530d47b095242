"""MinHash near-duplicates against brute force, the posterior bound, odd input."""

from __future__ import annotations

from math import comb

import brute
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from desense.llm import jaccard_join, minhash, queries

SF = "/root/testdata/sf0.01"


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def wanted(docs, over=80):
    return {d: (n, c, d == c) for d, (n, c) in brute.components(docs, 4, over, 100).items()}


def test_whole_query_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got(queries.op11_minhash_dedup(spark, SF)) == wanted(docs)


def edited_copies(groups=6, copies=300):
    rnd = np.random.default_rng(3)
    base = [[f"w{k}" for k in rnd.integers(0, 60, 80)] for _ in range(groups)]
    docs = []
    for i in range(copies):
        w = list(base[i % groups])
        for _ in range(int(rnd.integers(0, 7))):
            w[int(rnd.integers(0, 80))] = f"x{rnd.integers(0, 1000)}"
        docs.append((i, "  ".join(w)))
    return docs


def test_chains_of_edited_copies(spark, monkeypatch):
    """Near the threshold, so that buckets span components, in blocks made small."""
    monkeypatch.setattr(jaccard_join, "BUCKET_SETS", 16)
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 16)
    docs = edited_copies()
    want = wanted(docs)
    assert len({c for _, c, _ in want.values()}) > 50
    assert got(minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))) == want


def test_least_matches_are_where_the_posterior_falls_under_the_miss():
    for k, m in enumerate(minhash.least_matches(80, 100)):
        n = (k + 1) * minhash.BATCH
        # P(S >= t) of a Beta(m + 1, n - m + 1), by summing its density over a fine grid
        grid = np.linspace(0, 1, 200_001)
        for matches, under in ((m - 1, True), (m, False)):
            if matches < 0:
                continue
            density = grid**matches * (1 - grid) ** (n - matches)
            tail = density[grid >= 0.8].sum() / density.sum()
            assert (tail < minhash.MISS * 1.01) == under
    assert abs(sum(comb(5, i) for i in range(6)) - 32) < 1


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 10**6), st.floats(0.1, 0.95))
def test_equal_hashes_estimate_similarity(seed, share):
    rnd = np.random.default_rng(seed)
    pool = jaccard_join._mix(np.arange(2000, dtype=np.uint64) + np.uint64(seed * 10_000 + 1))
    cut = int(1000 * share)
    a, b = pool[:1000], np.concatenate([pool[:cut], pool[1000 : 2000 - cut]])
    true = cut / (2000 - cut)
    equal = (minhash.signature(np.sort(a)) == minhash.signature(rnd.permutation(b))).mean()
    assert abs(equal - true) < 6 * (true * (1 - true) / minhash.HASHES) ** 0.5 + 0.02


def test_links_survive_and_strangers_do_not():
    rnd = np.random.default_rng(5)
    left, right, linked = [], [], []
    for i in range(300):
        pool = jaccard_join._mix(rnd.integers(0, 2**63, 600, dtype=np.uint64))
        n = int(rnd.integers(1, 300))
        cut = n - int(n * rnd.random() * 0.6)
        a, b = pool[:n], np.concatenate([pool[:cut], pool[300 : 300 + n - cut]])
        left.append(a), right.append(b), linked.append(100 * cut >= 80 * (2 * n - cut))
    sketches = minhash.Signatures(pa.array([minhash.signature(s).tobytes() for s in left + right]))
    ok = sketches.may_link(np.arange(300), np.arange(300, 600), np.array([len(s) for s in left + right]), 80, 100)
    assert ok[np.array(linked)].all() and ok.mean() < 0.9


def test_odd_input(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (4, "ONE two"), (None, "one two"), (5, "a b c d e"), (6, "word " * 30_000), (7, "A b c d e"), (None, "only here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("set_id", F.lit("x")).withColumn("kept", F.lit(1))
    found = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()), key=str)
    assert found == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (4, 1, 4, True), (None, 1, 4, False), (5, 2, 5, True), (6, 1, 6, True), (7, 2, 5, False), (None, 1, None, True)], key=str)
    assert minhash.near_duplicates(docs.limit(0)).collect() == []


@pytest.mark.parametrize("words, over", [(5, 80), (3, 50)])
def test_other_parameters(spark, words, over):
    docs = edited_copies(3, 90)
    found = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), words, over, 100)
    want = brute.components(docs, words, over, 100)
    if over == 80:  # 32 bands of 4 are for 0.8 and more
        assert {r.doc_id: r.component_id for r in found.collect()} == {d: c for d, (_, c) in want.items()}
    else:
        assert sum(r.component_id != want[r.doc_id][1] for r in found.collect()) < 5
