import unittest.mock
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest

from ledgerline.llm import whitening as W

ROWS = "vec_id long, embedding array<double>, x int, dim int, n int, cell int"


def as_rows(data):
    return [(i, v, 1, 2, 3, 4) for i, v in data]


def brute(vectors):
    """n, sums, exact covariance (rounded once) of vectors of one length."""
    x = [[int(np.floor(1024 * c)) + 100_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(row[k] for row in x) for k in range(d)]
    v = np.array([[float(Fraction(sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in x), n**3)) for j in range(d)] for i in range(d)])
    return np.array(x, object), n, s, v


def check(rows, vectors, ids, error_at_most=1e-9):
    x, n, s, v = brute(vectors)
    d = len(v)
    values, basis = np.linalg.eigh(v)
    values, basis = values[::-1], basis[:, ::-1]
    found = {}
    for r in rows:
        found.setdefault(r["vec_id"], {})[r["component"]] = r
    assert set(found) == set(ids)
    signs = {}
    for at, i in enumerate(ids):
        assert sorted(found[i]) == list(range(1, min(8, d) + 1))
        deviation = sum((n * int(x[at][k]) - s[k]) ** 2 for k in range(d))
        for k, r in found[i].items():
            assert (r["n"], r["deviation"]) == (n, deviation)
            assert np.isclose(r["explained"], values[k - 1] / np.trace(v), rtol=1e-9)
            assert r["identity_error"] <= error_at_most
            centred = np.array([float(Fraction(n * int(x[at][j]) - s[j], n)) for j in range(d)])
            wanted = centred @ basis[:, k - 1] / np.sqrt(values[k - 1])
            sign = signs.setdefault(k, np.sign(wanted * r["whitened"]) if abs(wanted) > 1e-3 else None)
            if sign is None:
                signs.pop(k)
            assert abs(r["whitened"] - (sign or np.sign(wanted * r["whitened"])) * wanted) < 1e-7


def test_small_table(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(60, 6)) @ rng.normal(size=(6, 6))).tolist()
    data = list(enumerate(vectors)) + [(100, vectors[0]), (101, vectors[0]), (102, vectors[1])]
    odd = [(200, None), (201, [None] + [1.0] * 5), (202, [float("nan")] * 6), (203, [float("inf")] * 6)]
    df = spark.createDataFrame(as_rows(data + odd), ROWS).repartition(4)
    whitened, fits, error = W.whiten(df)
    assert list(fits) == [6] and error < 1e-9 and whitened.count() == len(data)
    check(query(spark, df).collect(), [v for _, v in data], [i for i, _ in data])


def query(spark, df):
    """The registered query over ``df``."""
    with unittest.mock.patch.object(W, "table", lambda *_: df):
        return W.op12_whitening(spark, "")


def test_degenerate_tables(spark):
    one = query(spark, spark.createDataFrame(as_rows([(1, [1.0, 2.0, 3.0]), (None, [1.0, 2.0, 3.0])]), ROWS)).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(2, 0, None, 0.0, 0.0)] * 6
    # Two lengths, an empty vector, fewer vectors than dimensions, entries that no long product holds.
    data = [(1, [1.0, 2.0]), (2, [3.0, 1.0]), (3, [5.0]), (4, [7.0]), (5, []), (6, [1e300, 0.0, 0.0]), (7, [-1e300, 1.0, 5.0])]
    rows = query(spark, spark.createDataFrame(as_rows(data), ROWS)).collect()
    got = {(r["vec_id"], r["component"]): r for r in rows}
    assert sorted(got) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (4, 1)] + [(i, k) for i in (6, 7) for k in (1, 2, 3)]
    assert got[1, 2]["whitened"] is None and abs(abs(got[1, 1]["whitened"]) - 1) < 1e-12 and abs(abs(got[4, 1]["whitened"]) - 1) < 1e-12
    assert got[3, 1]["deviation"] == 2048**2 and got[6, 1]["deviation"] is None and got[1, 1]["identity_error"] < 1e-9
    empty = query(spark, spark.createDataFrame([], ROWS))
    assert empty.count() == 0 and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_given_vectors(spark):
    data = "/root/testdata/sf0.001"
    t = pq.read_table(f"{data}/embeddings.parquet").to_pydict()
    check(W.op12_whitening(spark, data).collect(), t["embedding"], t["vec_id"])


def symmetric(values, seed):
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.normal(size=(len(values), len(values))))[0].astype(W.WIDE)
    for _ in range(3):  # orthogonal to extended precision
        q = q @ (1.5 * np.eye(len(values), dtype=W.WIDE) - 0.5 * q.T @ q)
    return (q * np.array(values, W.WIDE)) @ q.T, q


@pytest.mark.parametrize(
    "values",
    [
        np.linspace(100, 1, 40), np.geomspace(1e6, 1e-3, 30), [5.0] * 10, [0.0] * 4, [1.0],
        [9, 9 - 1e-7, 9 - 2e-7, 4, 4 - 1e-9, 1, 0.5], [7 + 1e-11, 7, 3, 3, 3, 1], np.concatenate(([1e4], 1 + 1e-8 * np.arange(20))),
    ],
)
def test_refined_eigenvectors(values):
    values = np.sort(np.array(values, W.WIDE))[::-1]
    a, q = symmetric(values, len(values))
    a = (a + a.T) / 2
    e, x = W.eigenvectors(a)
    top = max(1, float(abs(values).max()))
    assert float(abs(e - values).max()) <= 1e-15 * top
    assert float(abs(x.T @ x - np.eye(len(values))).max()) < 1e-15
    assert float(abs(a @ x - x * e).max()) <= 2e-15 * top
    for k in range(len(values)):  # directions, as far as their gaps fix them
        gap = min([abs(values[k] - values[j]) for j in range(len(values)) if j != k], default=top)
        if gap > 1e-9 * top:
            assert 1 - abs(float(x[:, k] @ q[:, k])) < 1e-14
            assert float(abs(x[:, k] - q[:, k] * np.sign(x[:, k] @ q[:, k])).max()) < 1e-17 * top / gap * 50 + 1e-16


def test_products_are_exact():
    rng = np.random.default_rng(5)
    for most in (1000, 2**40):
        x = rng.integers(-most, most, size=(50, 4))
        assert (np.array(W.exact_product(x, x), object) == x.astype(object).T @ x.astype(object)).all()
