import numpy as np
import pytest

from plumbline.llm import whitening

COLUMNS = "vec_id long, embedding array<float>, v string, x long, n long, component int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "v", 1, 2, 3) for i, v in rows], COLUMNS)


def brute(rows):
    """vec_id, deviation and whitened rows by a full eigendecomposition, with the shares of variance."""
    kept = [(i, np.floor(64 * np.array(v, np.float32).astype(float)).astype(np.int64) + 1_000_000) for i, v in rows if v]
    kept = [(i, x) for i, x in kept]
    fit = np.unique(np.array([x for _, x in kept]), axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    y = fit - sums / n
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1][:16], u[:, ::-1][:, :16]
    out = [(i, sum((n * int(a) - int(s)) ** 2 for a, s in zip(x, sums, strict=True)), (x - sums / n) @ u / np.sqrt(e)) for i, x in kept]
    return n, out, e / np.trace(y.T @ y / n)


def collected(result):
    by_id = {}
    for r in result.collect():
        by_id.setdefault(r["vec_id"], []).append(r)
    return by_id


def test_same_as_a_full_decomposition(spark):
    rng = np.random.default_rng(1)
    spread = np.linspace(0.2, 3, 24)
    rows = [(i, [float(a) for a in rng.normal(size=24) * spread]) for i in range(3_000)]
    rows += [(10_000 + i, rows[7][1]) for i in range(500)]  # copies count once
    n, expected, explained = brute(rows)
    vectors = frame(spark, rows).repartition(40)  # more factors than one merge takes
    got = collected(whitening.whiten(vectors, whitening.fit(vectors)))
    signs = None
    for vec_id, deviation, white in expected:
        own = sorted(got[vec_id], key=lambda r: r["component"])
        assert [r["component"] for r in own] == list(range(1, 17))
        assert {(r["n"], r["deviation"]) for r in own} == {(n, deviation)}
        w = np.array([r["whitened"] for r in own])
        signs = np.sign(w * white) if signs is None else signs
        assert np.allclose(w * signs, white, atol=1e-8)
        assert np.allclose([r["explained"] for r in own], explained, rtol=1e-9)
        assert own[0]["identity_error"] < 1e-9


@pytest.mark.parametrize("values", [
    np.ones(12), np.repeat([5.0, 2.0, 1.0], 4), np.r_[3.0, 2, 1, np.zeros(9)], 1 + 1e-9 * np.arange(12), 8.0 ** -np.arange(12), np.zeros(12), np.r_[1.0, np.zeros(11)],
])
def test_solver_with_equal_close_graded_and_zero_values(values):
    rng = np.random.default_rng(2)
    left, right = (np.linalg.qr(rng.normal(size=(12, 12)))[0] for _ in range(2))
    a = left @ np.diag(values) @ right
    got, vectors = whitening.leading(a, 12)
    there = got > 0
    assert there.sum() == (np.linalg.svd(a)[1] > whitening.RANK * max(values)).sum()
    own = vectors[:, there]
    assert np.allclose(own.T @ own, np.eye(there.sum()), atol=1e-12)
    assert np.abs(a @ own - (a @ own) / got[there] * got[there]).max(initial=0) < 1e-12
    assert np.allclose(np.linalg.norm(a @ own, axis=0), got[there], rtol=1e-4)


def test_dqds_is_accurate_for_tiny_values():
    """A graded bidiagonal matrix has all its values to high relative accuracy; its smallest is known from the inverse."""
    d, e = 10.0 ** -np.arange(0, 60, 4), 10.0 ** -np.arange(0.0, 56, 4)
    squares = whitening.squared_values(d, e)
    inverse = np.linalg.inv(np.diag(d) + np.diag(e, 1))
    assert np.isclose(squares[-1], 1 / np.linalg.norm(inverse, 2) ** 2, rtol=1e-12)
    assert np.isclose(squares[0], np.linalg.norm(np.diag(d) + np.diag(e, 1), 2) ** 2, rtol=1e-14)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    good = [[1.0, 2.0, 5.0], [2.0, 1.0, 5.0], [0.0, 0.5, 5.0], [3.0, 9.0, 5.0]]
    rows = [(1, good[0]), (2, good[1]), (2, good[1]), (None, good[2]), (4, None), (5, [1.0, None, 2.0]), (6, [nan, 1.0, 1.0]), (7, [inf, 0.0, 0.0]), (8, []), (9, [1.0, 2.0]), (10, good[3])]
    vectors = frame(spark, rows)
    got = whitening.whiten(vectors, whitening.fit(vectors)).collect()
    assert sorted((str(r["vec_id"]), r["component"]) for r in got) == sorted((str(i), c) for i in (1, 2, 2, None, 10) for c in (1, 2, 3))
    assert all((r["whitened"] is None) == (r["component"] == 3) for r in got)  # the third dimension never varies
    assert {r["n"] for r in got} == {4}

    same = frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])
    got = whitening.whiten(same, whitening.fit(same)).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got] == [(1, 0, None, None, None)] * 4

    wide = frame(spark, [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 0.0])])
    got = whitening.whiten(wide, whitening.fit(wide)).collect()
    assert len(got) == 6 and {r["deviation"] for r in got if r["vec_id"] == 1} == {None}

    for empty in (frame(spark, []), frame(spark, [(1, None), (2, [])])):
        result = whitening.whiten(empty, whitening.fit(empty))
        assert result.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
        assert result.count() == 0
