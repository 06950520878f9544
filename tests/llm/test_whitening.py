import math

import numpy as np
import pytest

from runlens.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n long, component string, v string"


def vectors(spark, rows):
    def floats(v):
        return None if v is None else [None if x is None else float(x) for x in v]

    full = [(i, floats(v), 1, 2, "x", "y") for i, v in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(5)


def whole(rows):
    """(ids, x) of the rows that count, exactly."""
    lengths = [len(v) for _, v in rows if fits(v)]
    top = max(set(lengths), key=lambda k: (lengths.count(k), k))
    kept = [(i, v) for i, v in rows if fits(v) and len(v) == top]
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in kept]
    return [i for i, _ in kept], x


def fits(v):
    return bool(v) and all(c is not None and math.isfinite(c) and abs(64 * c) < 2.0**62 for c in v)


def check(spark, rows, k=32):
    table = vectors(spark, rows)
    tool = whitening.train(table)
    found = whitening.components(table, tool).collect()
    ids, x = whole(rows)
    n, d = len(x), len(x[0])
    k = min(k, d)
    assert len(found) == n * k and {r["n"] for r in found} == {n}
    sums = [sum(col) for col in zip(*x)]
    deviations = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x]
    got = [(r["vec_id"], r["deviation"]) for r in found if r["component"] == 1]
    want = [(i, e if e < 2**63 else None) for i, e in zip(ids, deviations)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    centred = np.array([[(n * a - s) / n for a, s in zip(row, sums)] for row in x])
    covariance = centred.T @ centred / n
    values, basis = np.linalg.eigh(covariance)
    values, basis = values[::-1], basis[:, ::-1]
    return found, ids, centred, covariance, values, basis


def normal(seed, n, d, low=0):
    rng = np.random.default_rng(seed)
    scales = 3.0 ** -np.arange(d) + low
    return [(i, row) for i, row in enumerate((rng.standard_normal((n, d)) * scales * 5).round(4).tolist())]


@pytest.mark.parametrize("n, d", [(300, 8), (400, 40)])
def test_against_dense_eigenvectors(spark, n, d):
    rows = normal(n, n, d, 0.3)
    found, ids, centred, covariance, values, basis = check(spark, rows)
    k = min(32, d)
    by = {(r["vec_id"], r["component"]): r for r in found}
    got = np.array([[by[i, c + 1]["whitened"] for c in range(k)] for i in ids])
    want = centred @ basis[:, :k] / np.sqrt(values[:k])
    signs = np.sign((got * want).sum(axis=0))
    assert np.abs(got - want * signs).max() < 1e-8
    shares = np.array([by[ids[0], c + 1]["explained"] for c in range(k)])
    assert np.allclose(shares, values[:k] / values.sum(), rtol=1e-10)
    error = np.abs(got.T @ got / n - np.outer(got.mean(0), got.mean(0)) - np.eye(k)).max()
    assert error < 1e-9 and {r["identity_error"] for r in found} == {found[0]["identity_error"]}
    assert abs(found[0]["identity_error"] - error) < 1e-12


def test_rows_that_do_not_count(spark):
    nan, inf = float("nan"), float("inf")
    rows = normal(1, 60, 4, 0.5)
    rows += [(100, None), (101, []), (102, [1, 2, None, 4]), (103, [nan, 1, 2, 3])]
    rows += [(104, [1, inf, 2, 3]), (105, [1, 2, 3]), (106, [1e30, 0, 0, 0]), (None, [1, 2, 3, 4]), (5, rows[5][1])]
    found, ids, *_ = check(spark, rows)
    assert len(ids) == 62 and {r["vec_id"] for r in found} == {None, *range(60)}


def test_long_deviations_are_null_and_short_ones_exact(spark):
    rows = [(i, [2.0**24 + 2 * i, (-1) ** i * 2.0**24]) for i in range(40)]
    rows += [(50, [2.0**40, -(2.0**41)]), (51, [2.0**55, 1.0])]
    found, *_ = check(spark, rows)
    assert any(r["deviation"] is None for r in found)


@pytest.mark.parametrize("rows", [[(1, [1, 2, 3])], [(i, [4, 4]) for i in range(9)]])
def test_no_variance(spark, rows):
    found, *_ = check(spark, rows)
    assert {(r["whitened"], r["explained"], r["identity_error"]) for r in found} == {(None, None, 0.0)}


def test_flat_direction(spark):
    rows = [(i, [*v, 7.0, sum(v)]) for i, v in normal(3, 80, 3, 0.5)]
    rows = [(i, [round(float(x) * 64) / 64 for x in v]) for i, v in rows]
    rows = [(i, [a, b, c, d, a + b + c]) for i, (a, b, c, d, _) in rows]
    found, *_ = check(spark, rows)
    flat = {r["component"] for r in found if r["whitened"] is None}
    assert flat == {4, 5} and found[0]["identity_error"] < 1e-9


def test_empty(spark):
    table = vectors(spark, [])
    assert whitening.components(table, whitening.train(table)).collect() == []
    table = vectors(spark, [(1, None), (2, [])])
    assert whitening.whitened_vectors(table, whitening.train(table)).collect() == []


def residuals(x, k=32):
    d = x.shape[1]
    square = np.zeros((d, d))
    r = np.linalg.qr(x, mode="r")
    square[: len(r)] = r
    squares, directions = whitening.principal(square, k)
    gram, top = x.T @ x, max(squares[0], 1e-300)
    k = min(k, d)
    off = np.abs(directions.T @ directions - np.eye(k)).max()
    return np.abs(gram @ directions - directions * squares[:k]).max() / top, off


def test_directions_of_hard_spectra():
    rng = np.random.default_rng(0)
    cases = [np.zeros((4, 6)), np.eye(40) * 3, rng.standard_normal((3, 20))]
    cases.append(rng.standard_normal((90, 30)) * 10.0 ** -np.arange(0, 15, 0.5))
    glued = np.diag(np.abs(np.arange(-10, 11)) + 1.0) + np.diag(np.ones(20), 1)
    cases.append(glued)
    for seed in range(40):
        rng = np.random.default_rng(seed)
        d = int(rng.integers(2, 40))
        turn, _ = np.linalg.qr(rng.standard_normal((d, d)))
        spread = rng.choice([0, 1e-14, 1e-10, 1e-6]) * rng.random(d)
        values = rng.choice(rng.random(3) + 0.1, d) + spread
        cases.append(np.linalg.qr(rng.standard_normal((d + 50, d)))[0] * values @ turn)
    for x in cases:
        assert max(residuals(x)) < 1e-11


def test_small_singular_values_are_relatively_exact():
    d = np.array([1.0, 1e-3, 1e-6, 1e-9, 1e-12])
    above = np.array([1.0, 1e-3, 1e-6, 1e-9]) * 0.5
    squares = whitening.dqds(d, above)
    # The product of the squares is the determinant's square, which needs each to its last digits.
    assert math.isclose(np.prod(squares), np.prod(d**2), rel_tol=1e-12)
    assert len(squares) == 5 and squares[-1] > 0


def test_fold_is_independent_of_blocks(spark):
    rows = normal(9, 200, 6, 0.5)
    one, many = vectors(spark, rows).coalesce(1), vectors(spark, rows).repartition(100)
    a, b = whitening.train(one), whitening.train(many)
    assert np.abs(a.directions - b.directions).max() < 1e-12
