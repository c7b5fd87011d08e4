import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from windrow.llm import whitening as W

TABLES = "/root/testdata/sf0.01"


def slow(vectors, k=4):
    """(kept row numbers, n, deviations, whitened rows up to sign, shares) by numpy's eigensolver."""
    kept = [i for i, v in enumerate(vectors) if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(256 * float(np.float32(c))) for c in vectors[i]] for i in kept]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    z = np.array(fit, float) - np.array(sums) / n
    v = z.T @ z / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    deviations = [sum((n * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    return kept, n, deviations, (np.array(x, float) - np.array(sums) / n) @ u / np.sqrt(e), e / np.trace(v)


def against_slow(got, vectors):
    kept, n, deviations, white, shares = slow(vectors)
    rows = {}
    for r in got:
        rows.setdefault(r["component"], {})[r["vec_id"]] = r
    assert sorted(rows) == list(range(1, white.shape[1] + 1))
    for c, by_id in rows.items():
        assert sorted(by_id) == kept
        mine = np.array([by_id[i]["whitened"] for i in kept])
        sign = np.sign(mine @ white[:, c - 1])
        assert np.abs(mine * sign - white[:, c - 1]).max() < 1e-8
        for i, dev in zip(kept, deviations, strict=True):
            assert int(by_id[i]["deviation"]) == dev and by_id[i]["n"] == n
            assert abs(by_id[i]["explained"] - shares[c - 1]) < 1e-10
            assert by_id[i]["identity_error"] < 1e-9


def test_against_plain_eigenvectors(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(300, 7)) * [3, 2, 1.5, 1, 0.5, 0.3, 0.1] + 2
    vectors = [list(map(float, v)) for v in data]
    vectors += [vectors[0]] * 200 + [None, [1.0, None, *[0.0] * 5], [float("nan"), *[0.0] * 6], [float("inf"), *[0.0] * 6]]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id int, embedding array<float>").repartition(7)
    more = df.withColumns({"x": F.lit("own"), "own": F.lit("o"), "i": F.lit(1), "vector": F.lit(None), "n": F.lit("replaced")})
    got = W.whiten(more)
    assert got.columns == ["vec_id", "x", "own", "i", "vector", *W.RESULT]
    rows = got.collect()
    assert {(r["x"], r["own"], r["i"], r["vector"]) for r in rows} == {("own", "o", 1, None)}
    against_slow(rows, vectors)


def test_query_on_the_given_table(spark):
    rows = spark.read.parquet(f"{TABLES}/embeddings.parquet").select("vec_id", "embedding").collect()
    vectors = {r["vec_id"]: r["embedding"] for r in rows}
    against_slow(W.query(spark, TABLES).collect(), [vectors[i] for i in range(len(vectors))])


def test_few_dimensions_ranks_and_empty_tables(spark):
    make = lambda vs: W.whiten(spark.createDataFrame(list(enumerate(vs)), "vec_id int, embedding array<float>"))
    for vs in ([], [None], [[1.0, 2.0]] * 5, [[]], [[None]]):
        assert make(vs).count() == 0
    line = [[float(i), 2.0 * i, 0.0] for i in range(9)]
    assert {r["component"] for r in make(line).collect()} == {1}
    got = make([[1.0], [3.0], [3.0], [1.0, 2.0]]).collect()  # one vector of another number of dimensions
    assert sorted((r["vec_id"], r["component"], r["n"]) for r in got) == [(0, 1, 2), (1, 1, 2), (2, 1, 2)]
    assert sorted(abs(round(r["whitened"], 9)) for r in got) == [1, 1, 1]


def test_large_entries_are_exact(spark):
    rng = random.Random(5)
    xs = [[rng.randrange(-(2**50), 2**50) / 1.0 for _ in range(3)] for _ in range(50)]
    got = W.whiten(spark.createDataFrame(list(enumerate(xs)), "vec_id int, embedding array<double>"))
    whole = [[math.floor(256 * c) for c in v] for v in xs]
    sums = [sum(c) for c in zip(*whole, strict=True)]
    for r in got.collect():
        want = sum((50 * c - s) ** 2 for c, s in zip(whole[r["vec_id"]], sums, strict=True))
        assert int(r["deviation"]) == want
        assert r["identity_error"] < 1e-9


@pytest.mark.parametrize("d", [1, 2, 5, 40])
def test_pivots_and_eigenvalues(d):
    rng = np.random.default_rng(d)
    for kind in range(8):
        a = rng.normal(size=(d, d))
        a = a + a.T
        if kind % 2:
            np.fill_diagonal(a, 0)  # blocks of two are needed
        e = np.linalg.eigvalsh(a)
        for s in rng.normal(size=6) * 3:
            assert W.positive_pivots(a - s * np.eye(d)) == (e > s).sum()
        v = a @ a
        values, vectors = W.leading(v, 4)
        want = np.linalg.eigvalsh(v)[::-1][: len(values)]
        assert len(values) == min(4, np.linalg.matrix_rank(v))
        assert np.allclose(values, want, rtol=1e-9)
        assert np.allclose(v @ vectors.T, vectors.T * values, atol=1e-9 * np.trace(v))
        assert np.allclose(vectors @ vectors.T, np.eye(len(values)), atol=1e-7)


def test_equal_and_close_eigenvalues():
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.normal(size=(12, 12)))
    for e in ([5.0] * 3 + [1.0] * 9, [5.0, 5.0 - 1e-9, 5.0 - 2e-9, 4.0, *[1.0] * 8], [1.0] * 12, [9.0, 1e-6, 1e-6, *[0.0] * 9]):
        v = q @ np.diag(e) @ q.T
        v = (v + v.T) / 2
        values, vectors = W.leading(v, 4)
        want = [x for x in e if x > 0][:4]
        assert np.allclose(values, want, rtol=1e-8)
        assert np.allclose(vectors @ vectors.T, np.eye(len(want)), atol=1e-5)
