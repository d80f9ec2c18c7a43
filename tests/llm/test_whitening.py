import numpy as np
import pytest

from refloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, v string, component string, n int"


def table(spark, vectors, schema=SCHEMA, parts=7):
    return spark.createDataFrame([(k, v, "x", "y", 1) for k, v in vectors], schema).repartition(parts)


def plain(vectors):
    """Whole numbers, exact deviations, eigenvalues and eigenvectors of the covariance, by numpy without Spark."""
    x = np.array([[int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in v] for v in vectors], object)
    n, sums = len(x), x.sum(axis=0)
    deviation = ((n * x - sums) ** 2).sum(axis=1)
    off = (n * x - sums).astype(float) / n
    values, axes = np.linalg.eigh(off.T @ off / n)
    return deviation.tolist(), off, values[::-1], axes[:, ::-1]


def matrix(found, k):
    rows = found.collect()
    at = {i: j for j, i in enumerate(sorted({r.vec_id for r in rows}))}
    w = np.zeros((len(at), k))
    for r in rows:
        w[at[r.vec_id], r.component - 1] = r.whitened
    return rows, w


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_equals_numpy(spark, parts):
    """Correlated dimensions of very different scale; null, empty, short, non-finite and null entries are left out; one partition to many, so the tree has several levels."""
    rng = np.random.default_rng(5)
    good = (rng.normal(size=(400, 12)) @ rng.normal(size=(12, 12)) * np.logspace(0, -2, 12) + 3).astype(np.float32).tolist()
    bad = [None, [], [1.0] * 5, [float("nan")] * 12, [float("inf")] + [0.0] * 11, [None] + [0.0] * 11, [float("-inf")] * 12]
    found = whitening.whiten(table(spark, [*enumerate(good), *((1000 + k, v) for k, v in enumerate(bad))], parts=parts))
    deviation, off, values, axes = plain(good)
    rows, w = matrix(found, 8)
    assert len(rows) == 8 * 400 and {r.vec_id for r in rows} == set(range(400))
    assert {r.n for r in rows} == {400} and all(r.deviation == deviation[r.vec_id] for r in rows)
    expected = off @ axes[:, :8] / np.sqrt(values[:8])
    signs = np.sign((expected * w).sum(axis=0))
    assert np.abs(w * signs - expected).max() < 1e-6
    explained = {r.component: r.explained for r in rows}
    assert all(abs(explained[k + 1] / (values[k] / values.sum()) - 1) < 1e-9 for k in range(8))
    assert {r.identity_error for r in rows} == {rows[0].identity_error} and rows[0].identity_error < 1e-9
    assert np.abs(w.T @ w / 400 - np.eye(8)).max() < 1e-9


def test_near_singular_directions_keep_their_precision(spark):
    """The smallest direction is 10 ** -6 of the largest: a covariance matrix would lose it."""
    rng = np.random.default_rng(6)
    big = (rng.normal(size=300) * 2.0e8).round()
    vectors = [[float(b), float(b) + float(e)] for b, e in zip(big, rng.normal(size=300) * 100, strict=True)]
    found = whitening.whiten(table(spark, list(enumerate(vectors)), "vec_id long, embedding array<double>, v string, component string, n int"))
    rows, w = matrix(found, 2)
    assert len(rows) == 600 and rows[0].identity_error < 1e-4 and np.abs(w.T @ w / 300 - np.eye(2)).max() < 1e-4


def test_repeated_and_null_ids_and_one_hot_vector(spark):
    rng = np.random.default_rng(8)
    good = rng.normal(size=(60, 3)).astype(np.float32).tolist()
    rows = [(1, good[0])] * 50 + [(None, v) for v in good[:5]] + [(k, v) for k, v in enumerate(good)]
    found = whitening.whiten(table(spark, rows)).collect()
    deviation, _, values, _ = plain([v for _, v in rows])
    assert len(found) == 3 * len(rows)  # three dimensions have three components
    assert sorted(r.deviation for r in found) == sorted(3 * deviation)
    assert abs(sum({r.component: r.explained for r in found}.values()) - 1) < 1e-12


def test_fewer_directions_than_components(spark):
    line = [(k, [float(k), 2.0 * k, 0.0]) for k in range(20)]
    found = whitening.whiten(table(spark, line)).collect()
    assert {r.component for r in found} == {1} and len(found) == 20 and abs(found[0].explained - 1) < 1e-12
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(k, [0.5, 0.5]) for k in range(9)]):
        empty = whitening.whiten(table(spark, rows))
        assert empty.count() == 0 and empty.columns == [c.name for c in whitening.whiten(table(spark, line)).schema]


def test_large_numbers_are_exact(spark):
    """Sums beyond a double's precision; a deviation beyond a long is null."""
    rows = [(k, [float(1 << 39) - k, float(k)]) for k in range(30)]
    found = whitening.whiten(table(spark, rows, "vec_id long, embedding array<double>, v string, component string, n int")).collect()
    x = [[1024 * ((1 << 39) - k) + 100_000, 1024 * k + 100_000] for k in range(30)]
    sums = [sum(c) for c in zip(*x, strict=True)]
    expected = {k: sum((30 * c - s) ** 2 for c, s in zip(r, sums, strict=True)) for k, r in enumerate(x)}
    assert all(r.deviation == expected[r.vec_id] for r in found)
    apart = [(0, [-1e12 / 2, 0.0]), (1, [1e12 / 2, 1.0]), (2, [1.0, 3.0])]
    wide = whitening.whiten(table(spark, apart, "vec_id long, embedding array<double>, v string, component string, n int")).collect()
    assert {r.deviation for r in wide if r.vec_id < 2} == {None}
