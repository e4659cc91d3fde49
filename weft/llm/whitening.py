"""Whitening of embeddings by an exact integer scatter matrix.

Entries become integers, x = floor(scale * c). Each task subtracts a shift (its first vector, so the
numbers stay small), and adds up sums and cross products as integers of any size; parts of tasks are
brought to shift 0 and added, all exactly, so neither the shift nor the order of rows matters. The
scatter n * X'X - S S' is formed as integers, and only then becomes floating, divided by n * n, and is
decomposed by eigh. The covariance is that of the distinct vectors, each counted once.

Vectors that are null, or hold a null or non-finite entry, take no part and give no row. Entries whose
scaled value is beyond a long take the nearest long. Vectors of each length are whitened among
themselves; vectors without entries have no components and give no row. Components whose eigenvalue is
zero, to double precision, have a null `whitened`; if all vectors are equal, `explained` is null too.
Repeated rows, null and repeated ids give rows as all others. An empty table gives an empty result.
Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from weft.llm.common import cut

#: The production parameters: what entries are multiplied with, how many components are returned.
SCALE = 256.0
COMPONENTS = 4
_LIMB = 20
_ROWS = 8192


def integers(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: float = SCALE) -> DataFrame:
    """vec_id and x (array<long>) of the vectors that take part."""
    finite = F.forall("_c", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    entries = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("_c"))
    return entries.where(F.col("_c").isNotNull() & finite & (F.size("_c") > 0)).select("vec_id", F.transform("_c", lambda c: F.floor(c * scale)).alias("x"))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """The integers of lists of d entries each."""
    return np.asarray(column.flatten(), dtype=np.int64).reshape(-1, d)


def by_length(batch: pa.RecordBatch, x: str = "x") -> Iterator[tuple[int, np.ndarray]]:
    """(d, which rows) for each length of vectors in a batch."""
    sizes = np.asarray(batch[x].value_lengths())
    for d in np.unique(sizes).tolist():
        yield d, np.flatnonzero(sizes == d)


def cross(x: np.ndarray) -> np.ndarray:
    """X'X as Python integers, exact for all longs.

    Entries are cut in limbs of 20 bits; products of limbs, added over at most 8192 rows, stay under
    2^53, where double precision is exact.
    """
    total = np.zeros((x.shape[1], x.shape[1]), object)
    for at in range(0, len(x), _ROWS):
        rest, limbs = x[at : at + _ROWS], []
        while np.abs(rest.astype(float)).max() >= 1 << _LIMB:
            limbs.append((rest & ((1 << _LIMB) - 1)).astype(float))
            rest = rest >> _LIMB
        limbs.append(rest.astype(float))
        for i, a in enumerate(limbs):
            for j, b in enumerate(limbs):
                total += (a.T @ b).astype(np.int64).astype(object) * (1 << (_LIMB * (i + j)))
    return total


def sums(x: np.ndarray) -> np.ndarray:
    """The sums of columns as Python integers, exact for all longs."""
    high, low = x >> 32, x & 0xFFFFFFFF
    return high.sum(axis=0).astype(object) * (1 << 32) + low.sum(axis=0).astype(object)


@dataclass
class Scatter:
    """n, the sums and the cross products of integer vectors, without a shift."""

    n: int
    s: np.ndarray
    p: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray, shift: np.ndarray) -> Scatter:
        """Of vectors, added up about a shift; differences that no long holds are taken without it."""
        low, high = x.min(axis=0).astype(object) - shift.astype(object), x.max(axis=0).astype(object) - shift.astype(object)
        if max(-low.min(), high.max()) >= 1 << 62:
            return cls(len(x), sums(x), cross(x))
        y, c = x - shift, shift.astype(object)
        s, p = sums(y), cross(y)
        return cls(len(x), s + len(x) * c, p + np.outer(s, c) + np.outer(c, s) + len(x) * np.outer(c, c))

    def __add__(self, other: Scatter) -> Scatter:
        return Scatter(self.n + other.n, self.s + other.s, self.p + other.p)

    def scatter(self) -> np.ndarray:
        """n * X'X - S S', exactly."""
        return self.n * self.p - np.outer(self.s, self.s)

    def rows(self, d: int) -> pa.RecordBatch:
        """A row for each dimension: its sum and its products with all, as decimal text."""
        out = {"d": pa.array([d] * d, pa.int32()), "i": pa.array(range(d), pa.int32()), "n": pa.array([self.n] * d, pa.int64())}
        return pa.RecordBatch.from_pydict(out | {"s": [str(v) for v in self.s], "p": [" ".join(map(str, r)) for r in self.p]})


ROW = "d int, i int, n long, s string, p string"


def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The scatter of a task's vectors, for each length."""
    found: dict[int, Scatter] = {}
    shift: dict[int, np.ndarray] = {}
    for b in batches:
        for d, rows in by_length(b):
            x = matrix(b["x"].take(pa.array(rows)), d)
            part = Scatter.of(x, shift.setdefault(d, x[0]))
            found[d] = found[d] + part if d in found else part
    for d, own in found.items():
        yield own.rows(d)


def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one (d, i) added; a task holds one row for each of its keys."""
    found: dict[tuple[int, int], list] = {}
    for b in batches:
        for r in b.to_pylist():
            p = np.array([int(v) for v in r["p"].split()], object)
            if own := found.get((r["d"], r["i"])):
                own[0], own[1], own[2] = own[0] + r["n"], own[1] + int(r["s"]), own[2] + p
            else:
                found[r["d"], r["i"]] = [r["n"], int(r["s"]), p]
    for (d, i), (n, s, p) in found.items():
        yield pa.RecordBatch.from_pydict({"d": pa.array([d], pa.int32()), "i": pa.array([i], pa.int32()), "n": pa.array([n], pa.int64()), "s": [str(s)], "p": [" ".join(map(str, p))]})


@dataclass
class Whitening:
    """What whitens integer vectors of one length: components are rows, by falling eigenvalue."""

    n: int
    s: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    error: float | None = None

    @classmethod
    def of(cls, n: int, s: np.ndarray, scatter: np.ndarray) -> Whitening:
        """From exact integers. Eigenvectors take the sign that makes their largest entry positive."""
        v = np.array([[x / (n * n) for x in r] for r in scatter], float)  # Python divides integers correctly rounded
        e, u = np.linalg.eigh(v)
        e, u = e[::-1], u.T[::-1]
        u = u * np.where(np.take_along_axis(u, np.abs(u).argmax(axis=1)[:, None], 1) < 0, -1.0, 1.0)
        e = np.where(e > len(e) * np.finfo(float).eps * max(e[0], 0), e, 0.0)
        return cls(n, s, u, e, int(scatter.trace()) / (n * n))

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """x - S / n, and the sum of the squares of n * x - S, exact."""
        most = max(abs(int(x.max())), abs(int(x.min()))) * self.n + max(abs(v) for v in self.s)
        if most * most * len(self.s) < 1 << 63:
            y = self.n * x - self.s.astype(np.int64)
            return y / self.n, (y * y).sum(axis=1).tolist()
        y = self.n * x.astype(object) - self.s
        return (y / self.n).astype(float), (y * y).sum(axis=1).tolist()

    def whitened(self, y: np.ndarray, k: int) -> np.ndarray:
        """The first k components of centred vectors; NaN where the eigenvalue is zero."""
        e = self.eigenvalues[:k]
        return y @ self.components[:k].T / np.sqrt(np.where(e > 0, e, np.nan))


def fitted(fit: DataFrame) -> dict[int, Whitening]:
    """The whitening of each length, from distinct vectors x. d rows of d integers reach the driver for each length d."""
    parts = fit.select("x").mapInArrow(partial, ROW).repartition("d", "i").mapInArrow(added, ROW)
    found: dict[int, dict[int, tuple]] = {}
    for r in parts.collect():
        found.setdefault(r["d"], {})[r["i"]] = (r["n"], int(r["s"]), [int(v) for v in r["p"].split()])
    out = {}
    for d, rows in found.items():
        whole = Scatter(rows[0][0], np.array([rows[i][1] for i in range(d)], object), np.array([rows[i][2] for i in range(d)], object))
        out[d] = Whitening.of(whole.n, whole.s, whole.scatter())
    return out


def projected(df: DataFrame, model: dict[int, Whitening], components: int = COMPONENTS) -> DataFrame:
    """For each x: vec_id, d, n, deviation (null beyond 38 digits), identity_error, and arrays whitened and explained by component."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # d * d doubles for each length

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                b = batch.slice(at, _ROWS)
                for d, rows in by_length(b):
                    own = b.take(pa.array(rows))
                    m, k, many = shared.value[d], min(components, d), len(rows)
                    y, deviation = m.centred(matrix(own["x"], d))
                    whitened = pa.array(m.whitened(y, k).ravel(), pa.float64(), from_pandas=True)
                    explained = pa.array([float(e) / m.trace if m.trace else None for e in m.eigenvalues[:k]] * many, pa.float64())
                    ends = pa.array(np.arange(many + 1) * k, pa.int32())
                    columns = [own["vec_id"], pa.array([d] * many, pa.int32()), pa.array([m.n] * many, pa.int64())]
                    columns += [pa.array([v if v < 10**38 else None for v in deviation], pa.decimal128(38, 0)), pa.array([m.error] * many, pa.float64())]
                    yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(ends, whitened), pa.ListArray.from_arrays(ends, explained)], names=names)

    names = ["vec_id", "d", "n", "deviation", "identity_error", "whitened", "explained"]
    kind = dict(df.dtypes)["vec_id"]
    return df.select("vec_id", "x").mapInArrow(project, f"vec_id {kind}, d int, n long, deviation decimal(38,0), identity_error double, whitened array<double>, explained array<double>")


def identity_errors(fit: DataFrame, model: dict[int, Whitening], components: int = COMPONENTS) -> dict[int, float | None]:
    """For each length the largest entry of |covariance of whitened - identity| over the fit list.

    Spark's covar_pop updates and merges moments about the mean, so it centres before it multiplies.
    Components without variance are left out; without any there is no error.
    """
    w = projected(fit.withColumn("vec_id", F.lit(0)), model, components)
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    covariances = (F.covar_pop(F.get("whitened", F.lit(i)), F.get("whitened", F.lit(j))).alias(f"c{i}_{j}") for i, j in pairs)
    errors = {}
    for r in w.groupBy("d").agg(*covariances).collect():
        entries = [abs(r[f"c{i}_{j}"] - (i == j)) for i, j in pairs if r[f"c{i}_{j}"] is not None]
        errors[r["d"]] = max(entries) if entries else None
    return errors


def whiten(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: float = SCALE, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error, a row for each vector and component."""
    x = integers(vectors, vec_id, embedding, scale)
    fit = cut(x.select("x").distinct())
    model = fitted(fit)
    for d, error in identity_errors(fit, model, components).items():
        model[d].error = error
    each = projected(x, model, components).withColumn("_at", F.arrays_zip("whitened", "explained"))
    rows = each.select("vec_id", "n", "deviation", "identity_error", F.posexplode("_at").alias("_k", "_at"))
    return rows.select("vec_id", (F.col("_k") + 1).alias("component"), "n", "deviation", "_at.whitened", "_at.explained", "identity_error")
