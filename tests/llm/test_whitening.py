"""TSQR whitening against a plain decomposition in exact whole numbers."""

from fractions import Fraction

import numpy as np
import pytest

from lectern.llm import queries, whitening

SF = "/root/testdata/sf0.01"


def plain(vectors, k):
    """(rows x, n, sums, eigenvalues, components) in whole numbers and double precision, over distinct rows."""
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[float(Fraction(n * v - s, n)) for v, s in zip(row, sums, strict=True)] for row in fit])
    values, vectors_ = np.linalg.eigh(centred.T @ centred / n)
    return x, n, sums, values[::-1][:k], vectors_[:, ::-1][:, :k], values.sum()


def test_query_against_plain(spark):
    rows = queries.op12_whitening(spark, SF).collect()
    table = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    x, n, sums, values, axes, total = plain([r.embedding for r in table], 16)
    by = {}
    for r in rows:
        by.setdefault(r.vec_id, {})[r.component] = r
    assert len(rows) == 16 * len(table) and len(by) == len(table)
    w = np.array([[by[r.vec_id][c].whitened for c in range(1, 17)] for r in table])
    want = np.array([[float(Fraction(n * v - s, n)) for v, s in zip(row, sums, strict=True)] for row in x]) @ axes / np.sqrt(values)
    sign = np.sign((w * want).sum(axis=0))
    assert np.abs(w * sign - want).max() < 1e-8
    for r, row in zip(table, x, strict=True):
        one = by[r.vec_id][1]
        assert one.n == n and one.deviation == sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True))
    assert [by[0][c].explained for c in range(1, 17)] == pytest.approx(list(values / total), rel=1e-9)
    assert {r.identity_error for r in rows} == {rows[0].identity_error} and rows[0].identity_error < 1e-9


def table_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, component int")


def test_small_variances_survive_a_large_scale(spark):
    """Variances of 12 orders of magnitude on a large shift; the covariance in doubles would lose the small ones."""
    rng = np.random.default_rng(3)
    scale = np.array([2.0**14, 2.0**8, 1.0, 2.0**-5])
    data = rng.standard_normal((600, 4)) * scale
    rows = [(i, [float(np.float32(v)) for v in row], 0) for i, row in enumerate(data)]
    own, _ = whitening.fit(whitening.whole_vectors(table_of(spark, rows)))
    _, n, _, values, axes, _ = plain([r[1] for r in rows], 4)
    assert own.n == n and own.variance == pytest.approx(values, rel=1e-6) and np.abs(np.abs((own.axes * axes).sum(axis=0)) - 1).max() < 1e-6
    assert max(r.identity_error for r in whitening.whiten(table_of(spark, rows)).collect()) < 1e-9


def test_tree_of_triangles_gives_the_same_variances(spark):
    """More partitions than one level of the tree holds."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in row], 0) for i, row in enumerate(rng.standard_normal((400, 5)))]
    fitted = whitening.whole_vectors(table_of(spark, rows)).select("x").distinct().repartition(20)
    n, sums = whitening.exact_sums(fitted)
    parts = whitening.factors(fitted, n, sums).cache()
    assert parts.count() == 20
    once = whitening.merged(parts, 5)
    assert once.count() == 3 and whitening.merged(once, 5).count() == 1
    r = np.frombuffer(whitening.merged(once, 5).first().r).reshape(-1, 5)
    _, _, _, values, _, _ = plain([r[1] for r in rows], 5)
    assert np.linalg.svd(r)[1] ** 2 / n == pytest.approx(values, rel=1e-10)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (None, [2.0, 5.0], 0), (4, None, 0), (5, [None, 1.0], 0), (6, [nan, 1.0], 0), (7, [inf, 1.0], 0), (8, [1.0], 0), (9, [], 0), (10, [3.0, -1.0], 0)]
    got = whitening.whiten(table_of(spark, rows)).collect()
    assert sorted({r.vec_id or 0 for r in got}) == [0, 1, 10] and len(got) == 8 and {r.n for r in got} == {3}
    assert max(r.identity_error for r in got) < 1e-12
    assert whitening.whiten(table_of(spark, rows[:2])).count() == 0  # one distinct vector has no variance
    assert whitening.whiten(table_of(spark, []).limit(0)).count() == 0
    line = whitening.whiten(table_of(spark, [(i, [float(i), 2.0 * i], 0) for i in range(5)])).collect()
    assert {r.component for r in line} == {1} and all(r.explained == pytest.approx(1) for r in line)  # the other has no variance
    huge = whitening.whiten(table_of(spark, [(i, [3e38 * (i - 1), float(i)], 0) for i in range(3)])).collect()
    assert all(r.deviation is None for r in huge if r.vec_id != 1)


def test_exact_deviation_beyond_doubles():
    x = np.array([[2**40, 7], [0, 5]], np.int64)
    sums = [2**40, 12]
    assert whitening.deviations(x, 2, sums) == [None, None]
    x = np.array([[2**29, 7], [0, 5]], np.int64)
    assert whitening.deviations(x, 2, [2**29, 12]) == [(2 * 2**29 - 2**29) ** 2 + 4] * 2
