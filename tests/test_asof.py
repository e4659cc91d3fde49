"""As-of join against a search by bisection."""

import bisect
import random

import pytest

from weft.operators.asof import asof_join


def model(left, right, tolerance):
    of = {}
    for key, at, n in right:
        if key is not None and at is not None:
            of.setdefault(key, []).append((at, n))
    out = []
    for key, at, n in left:
        rows = sorted(of.get(key, []))
        k = 0 if at is None else bisect.bisect_right(rows, (at, float("inf")))
        hit = rows[k - 1] if k and (tolerance is None or at - rows[k - 1][0] <= tolerance) else None
        out.append((key, at, n, hit and hit[1]))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("seed", "tolerance", "hot"), [(1, None, 0.0), (2, 30, 0.9), (3, 0, 0.5)])
def test_against_bisection(spark, seed, tolerance, hot):
    rng = random.Random(seed)
    row = lambda n: (rng.choice([1, 2, None, 3]) if rng.random() > hot else 7, rng.choice([None, *range(500)]), n)
    left, right = [row(n) for n in range(700)], [row(n) for n in range(300)]
    left.append(left[0])
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = asof_join(spark.createDataFrame(left, "key int, ts_ns long, n int").repartition(3), spark.createDataFrame(right, "key int, ts_ns long, n int").repartition(2), ["key"], order=["n"], tolerance=tolerance).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert sorted(((r["key"], r["ts_ns"], r["n"], r["last"] and r["last"]["n"]) for r in got), key=repr) == model(left, right, tolerance)


def test_empty_sides_and_names(spark):
    rows = spark.createDataFrame([(1, 5, "x")], "key int, ts_ns long, v string")
    none = rows.limit(0)
    assert [tuple(r) for r in asof_join(rows, none, ["key"]).collect()] == [(1, 5, "x", None)] and asof_join(none, rows, ["key"]).collect() == []
    with pytest.raises(ValueError, match="last"):
        asof_join(rows.withColumnRenamed("v", "last"), rows, ["key"])
