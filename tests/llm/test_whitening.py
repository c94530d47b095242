"""Whitening against a dense eigendecomposition; spectrum slicing on hard spectra."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from desense.llm import queries, whitening

SF = "/root/testdata/sf0.01"


def reference(rows):
    """x vectors of the rows, n, sums, eigenvalues and vectors by falling size."""
    x = np.array([np.floor(64 * np.asarray(v, float)) for v in rows]).astype(np.int64) + 1_000_000
    distinct = np.unique(x, axis=0)
    n, sums = len(distinct), distinct.sum(0)
    off = distinct - sums / n
    values, vectors = np.linalg.eigh(off.T @ off / n)
    return x, n, sums, values[::-1], vectors[:, ::-1]


def test_whole_query_brute_force(spark):
    got = queries.op12_embedding_whitening(spark, SF).toPandas()
    table = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    table = table[table.embedding.map(lambda v: v is not None and np.isfinite(v).all())]
    x, n, sums, values, vectors = reference(table.embedding)
    assert len(got) == 16 * len(table) and set(got.n) == {n}
    found = got.pivot(index="vec_id", columns="component", values="whitened").loc[table.vec_id].to_numpy()
    want = (x - sums / n) @ vectors[:, :16] / np.sqrt(values[:16])
    signs = np.sign((found * want).sum(0))
    assert np.abs(found * signs - want).max() < 1e-8
    first = got[got.component == 1].set_index("vec_id").loc[table.vec_id]
    assert first.deviation.tolist() == [int(d) for d in ((n * x.astype(object) - sums) ** 2).sum(1)]
    assert np.abs(got[got.vec_id == table.vec_id.iloc[0]].sort_values("component").explained - values[:16] / values.sum()).max() < 1e-12
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-10


SPECTRA = {
    "apart": lambda r, m: r.standard_normal(m) ** 2 * 10.0 ** r.integers(-3, 4),
    "equal": lambda r, m: r.integers(0, 4, m).astype(float),
    "close": lambda r, m: 1 + 1e-9 * r.standard_normal(m),
    "one": lambda r, m: np.concatenate([[5.0], np.zeros(m - 1)]),
    "none": lambda r, m: np.zeros(m),
    "huge": lambda r, m: 10.0 ** r.uniform(-12, 12, m),
}


@pytest.mark.parametrize("kind", SPECTRA)
@pytest.mark.parametrize("seed", range(6))
def test_leading_eigenpairs(kind, seed):
    rnd = np.random.default_rng(seed)
    m = int(rnd.integers(1, 40))
    turn, _ = np.linalg.qr(rnd.standard_normal((m, m)))
    spectrum = SPECTRA[kind](rnd, m)
    matrix = turn @ np.diag(spectrum) @ turn.T
    matrix = (matrix + matrix.T) / 2
    values, vectors = whitening.leading_eigenpairs(matrix, 16)
    want, size = np.sort(spectrum)[::-1][:16], max(spectrum.max(), 1e-300)
    k = len(values)
    assert (want[k:] <= 1e-12 * m * size).all()
    assert np.abs(values - want[:k]).max(initial=0) < 1e-12 * m * size
    assert np.abs(matrix @ vectors.T - vectors.T * values).max(initial=0) < 1e-12 * m * size
    assert np.abs(vectors @ vectors.T - np.eye(k)).max(initial=0) < 1e-5


@pytest.mark.parametrize("seed", range(20))
def test_pivots_count_eigenvalues(seed):
    rnd = np.random.default_rng(seed)
    m = int(rnd.integers(1, 30))
    matrix = rnd.integers(-3, 4, (m, m)).astype(float)
    matrix = matrix + matrix.T
    values = np.linalg.eigvalsh(matrix)
    for shift in (*rnd.uniform(-20, 20, 6), 0.5):
        assert whitening.positive_pivots(matrix - shift * np.eye(m)) == (values > shift).sum()


def test_odd_vectors(spark):
    nan = float("nan")
    rows = [(1, [1.0, 2.0, 3.0]), (1, [1.0, 2.0, 3.0]), (None, [4.0, 5.0, -6.0]), (3, None), (4, [nan, 1.0, 2.0]), (5, [None, 1.0, 1.0]), (6, []), (7, [1e30, 1.0, 1.0]), (8, [1.0, 2.0]), (9, [-1.0, 0.0, 1.0]), (10, [float("inf")] * 3)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n", F.lit("x")).withColumn("x", F.lit(1))
    got = whitening.whiten(table).toPandas()
    assert sorted(got.vec_id.dropna().unique()) == [1, 9] and len(got) == 4 * 2 and set(got.n) == {3}
    x, n, sums, values, vectors = reference([[1, 2, 3], [4, 5, -6], [-1, 0, 1]])
    want = ((x - sums / n) @ vectors[:, :2] / np.sqrt(values[:2]))[0]
    assert np.allclose(np.abs(got[got.vec_id == 1].sort_values("component").whitened.to_numpy()[:1]), abs(want[0]))
    assert whitening.whiten(table.limit(0)).collect() == [] and whitening.whiten(table.limit(2)).collect() == []
    assert whitening.whiten(table).columns == [c.split()[0] for c in whitening.RESULT.split(", ")]


def test_large_entries_and_deviations(spark):
    table = spark.createDataFrame([(1, [1e12, 0.0]), (2, [0.0, 1.0]), (3, [-5e6, 2.0])], "vec_id long, embedding array<double>")
    got = whitening.whiten(table).where("component = 1").toPandas().set_index("vec_id")
    assert got.deviation.isna().loc[1] and np.isfinite(got.whitened).all() and got.identity_error[1] < 1e-4


def test_means_far_from_zero_do_not_cancel(spark):
    rnd = np.random.default_rng(1)
    vectors = [[1e5 + float(a), -1e5 + float(b)] for a, b in rnd.integers(-2, 3, (40, 2)) / 64]
    got = whitening.whiten(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")).toPandas()
    x, n, sums, values, axes = reference(vectors)
    assert set(got.n) == {n} and got.identity_error[0] < 1e-12 and len(got) == 80
