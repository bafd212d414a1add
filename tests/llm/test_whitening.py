"""Whitening against a plain eigendecomposition, and rows that don't count."""

import numpy as np
import pytest

from quarry.llm import whitening


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else list(v), "x") for i, v in rows], "vec_id long, embedding array<double>, component string")


def by_hand(vectors, top):
    x = np.floor(64 * np.array(vectors)).astype(int) + 1_000_000
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(0)
    c = (n * u - s) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1][:top], v[:, ::-1][:, :top]
    return n, ((n * x - s) ** 2).sum(1), (n * x - s) / n @ v / np.sqrt(e), e / np.trace(c.T @ c / n)


@pytest.mark.parametrize(("d", "top", "parts"), [(5, 3, 1), (20, 16, 40), (3, 16, 7)])
def test_as_by_hand(spark, monkeypatch, d, top, parts):
    rng = np.random.default_rng(d)
    vectors = rng.normal(size=(300, d)) * np.arange(1, d + 1)
    vectors[200:] = vectors[rng.integers(0, 50, 100)]  # repeats count once in the fit
    monkeypatch.setattr(whitening, "FAN", 3)
    got = whitening.whiten(table(spark, enumerate(vectors.tolist())).repartition(parts), top=top).toPandas().sort_values(["vec_id", "component"])
    k = min(d, top)
    n, deviation, white, explained = by_hand(vectors, k)
    assert len(got) == 300 * k and (got["component"].to_numpy().reshape(-1, k) == np.arange(1, k + 1)).all() and set(got["n"]) == {n}
    assert (got["deviation"].to_numpy().reshape(-1, k) == deviation[:, None]).all()
    mine = got["whitened"].to_numpy().reshape(-1, k)
    assert np.allclose(mine * np.sign((mine * white).sum(0)), white, atol=1e-8)
    assert np.allclose(got["explained"].to_numpy().reshape(-1, k), explained, rtol=1e-9) and got["identity_error"].max() < 1e-9


def test_rows_that_do_not_count(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 2.0]), (2, [3.0, 1.0]), (2, [3.0, 1.0]), (None, [-1.0, 0.5])]
    bad = [(5, None), (6, []), (7, [1.0, None]), (8, [nan, 1.0]), (9, [1.0, inf]), (10, [1.0, 2.0, 3.0]), (11, [1e300, 1.0])]
    got = whitening.whiten(table(spark, good + bad)).collect()
    assert sorted((str(r["vec_id"]), r["component"]) for r in got) == sorted((str(i), c) for i, _ in good for c in (1, 2)) and {r["n"] for r in got} == {3}
    assert whitening.whiten(table(spark, bad[:5])).collect() == [] and whitening.whiten(table(spark, [])).collect() == []


def test_directions_without_variance_are_not_listed(spark):
    line = [(i, [float(i), 2.0 * i, 7.0]) for i in range(9)]
    got = whitening.whiten(table(spark, line)).collect()
    assert {r["component"] for r in got} == {1} and all(abs(r["explained"] - 1) < 1e-12 for r in got)
    assert whitening.whiten(table(spark, [(1, [1.0, 1.0]), (2, [1.0, 1.0])])).collect() == []


def test_numbers_beyond_64_bits():
    x = np.array([[2**40, -(2**40)]])
    assert whitening._centred(x, 2**30, (5, -5)).tolist() == [[2**70 - 5, 5 - 2**70]]
    assert whitening._deviation(np.array([[3, 4], [2**31, 2**31]])) == [25, None] and whitening._deviation(np.array([[2**30, 0]])) == [2**60]


def test_names_of_columns(spark):
    docs = spark.createDataFrame([(float(i), [float(i), float(i * i)], i) for i in range(5)], "x double, r array<float>, n int")
    assert whitening.whiten(docs, vec_id="n", vector="r").count() == 10
