"""Whitening against plain integers and floats."""

import math
import random

import numpy as np
import pytest

from weft.llm import whitening
from weft.llm.queries import op13_embedding_whitening

SF = "/root/testdata/sf0.01"


def brute(vectors):
    """n, S, the covariance over the distinct integer vectors, by Python integers."""
    xs = sorted({tuple(max(-(2**63), min(2**63 - 1, math.floor(c * 256))) for c in v) for v in vectors})
    n, d = len(xs), len(xs[0])
    s = [sum(x[i] for x in xs) for i in range(d)]
    v = [[sum((n * x[i] - s[i]) * (n * x[j] - s[j]) for x in xs) / (n * n * n) for j in range(d)] for i in range(d)]
    return n, s, np.array(v), xs


def check(rows, vectors, k=4):
    """rows by vec_id, vectors by vec_id, all of one length."""
    n, s, v, xs = brute(vectors.values())
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    signs = {}
    for (vec_id, c), r in rows.items():
        x = [math.floor(a * 256) for a in vectors[vec_id]]
        y = [n * a - b for a, b in zip(x, s, strict=True)]
        assert r["n"] == n and r["deviation"] == sum(a * a for a in y)
        want = float(np.dot(np.array(y, float) / n, u[:, c - 1])) / math.sqrt(e[c - 1])
        sign = signs.setdefault(c, 1 if want * r["whitened"] >= 0 else -1)
        assert r["whitened"] == pytest.approx(sign * want, rel=1e-8, abs=1e-8)
        assert r["explained"] == pytest.approx(e[c - 1] / np.trace(v), rel=1e-9)
        assert 0 <= r["identity_error"] < 1e-9
    assert set(rows) == {(i, c) for i in vectors for c in range(1, min(k, len(s)) + 1)}


def test_query_against_integers(spark):
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    rows = op13_embedding_whitening(spark, SF).collect()
    assert len(rows) == 4 * len(vectors) and len({r["identity_error"] for r in rows}) == 1
    check({(r["vec_id"], r["component"]): r for r in rows}, vectors)


def test_copies_count_once_and_odd_rows_go(spark):
    rng = random.Random(3)
    vectors = {i: [rng.gauss(0, 1 + k) for k in range(6)] for i in range(40)}
    vectors |= {100 + i: vectors[7] for i in range(300)}
    odd = [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [float("nan")] * 6), (903, [0.0, float("inf"), 0.0, 0.0, 0.0, 0.0]), (904, [])]
    df = spark.createDataFrame([*vectors.items(), *odd], "vec_id long, embedding array<double>").selectExpr("*", "'x' AS n", "1 AS whitened").repartition(5)
    check({(r["vec_id"], r["component"]): r for r in whitening.whiten(df).collect()}, vectors)


def test_lengths_equal_vectors_and_null_ids(spark):
    rows = [(1, [1.0, 2.0]), (2, [3.0, 1.0]), (3, [0.0, 0.5]), (3, [0.0, 0.5]), (None, [2.0, 2.0]), (4, [5.0, 5.0, 5.0]), (5, [5.0, 5.0, 5.0]), (6, [1.0]), (7, [-1.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted((r["vec_id"] or -1, r["component"]) for r in got) == sorted([(i, c) for i in (1, 2, 3, 3, -1) for c in (1, 2)] + [(i, c) for i in (4, 5) for c in (1, 2, 3)] + [(6, 1), (7, 1)])
    assert all(r["whitened"] is None and r["explained"] is None and r["deviation"] == 0 and r["identity_error"] is None for r in got if r["vec_id"] in (4, 5))
    assert {r["n"] for r in got if r["vec_id"] in (1, 2, 3, None)} == {4} and all(r["identity_error"] < 1e-12 for r in got if r["vec_id"] in (1, 6))
    assert sorted(r["whitened"] for r in got if r["vec_id"] in (6, 7)) == [-1.0, 1.0]


def test_a_component_without_variance(spark):
    rows = [(i, [float(i), 2.0 * i, 1.0]) for i in range(10)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert all((r["whitened"] is not None) == (r["component"] == 1) for r in got) and len(got) == 30
    assert all(r["identity_error"] < 1e-12 for r in got)


def test_numbers_beyond_a_double_stay_exact(spark):
    big = [(i, [2.0**40 * (i % 5) + i, -(2.0**44) + 2.0**36 * (i * i % 7)]) for i in range(30)]
    check({(r["vec_id"], r["component"]): r for r in whitening.whiten(spark.createDataFrame(big, "vec_id long, embedding array<double>")).collect()}, dict(big))
    far = spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 2.0])], "vec_id long, embedding array<double>")
    assert {tuple(r["x"]) for r in whitening.integers(far).collect()} == {(2**63 - 1, 256), (-(2**63), 512)}
    assert len(whitening.whiten(far).collect()) == 4


@pytest.mark.parametrize("most", [3, 2**20, 2**40, 2**62])
def test_cross_products_and_shifts_are_exact(most):
    rng = random.Random(most)
    x = np.array([[rng.randrange(-most, most) for _ in range(3)] for _ in range(9000)], np.int64)
    want = [[sum(int(a) * int(b) for a, b in zip(x[:, i], x[:, j], strict=True)) for j in range(3)] for i in range(3)]
    assert whitening.cross(x).tolist() == want and whitening.sums(x).tolist() == [sum(map(int, x[:, i])) for i in range(3)]
    part = whitening.Scatter.of(x, x[5])
    assert part.p.tolist() == want and (whitening.Scatter.of(x[:10], x[3]) + whitening.Scatter.of(x[10:], x[17])).scatter().tolist() == part.scatter().tolist()


def test_empty_table(spark):
    assert whitening.whiten(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
