"""What the operators of this folder share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

from weft.operators.storage import shared_dir
from weft.operators.storage import stored as cut

__all__ = ["LOWER", "U64", "WordHashes", "as_bytes", "bounded_batches", "cut", "key_runs", "mix", "redealt", "shared_dir", "slices", "table", "window_hashes"]

#: Maps A-Z to a-z and leaves every other byte.
LOWER = bytes(range(256)).lower()
U64 = np.uint64


def redealt(df: DataFrame) -> DataFrame:
    """df without its partitioning, for a join on a key that may hold many rows of the other side.

    A side that comes straight from an aggregation on the key keeps the join from being split; dealt
    anew, both sides are exchanges that adaptive execution can split.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def bounded_batches(spark: SparkSession, size: str = "8m") -> None:
    """Bounds the Arrow batches between executors and their Python workers: texts may be long, and each task holds some batches."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 of a string column."""
    return column.cast(pa.binary() if not pa.types.is_large_string(column.type) else pa.large_binary()).to_pylist()


def slices(batches: Iterable[pa.RecordBatch], text: str, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that a slice holds at most limit bytes of the column text, or one row."""
    for b in batches:
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(b[text]), 0), dtype=np.int64))
        at = 0
        while at < b.num_rows:
            base = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, base + limit, side="right")))
            yield b.slice(at, to - at)
            at = to


def key_runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each run of equal keys; batches must come sorted by keys. A run may span batches."""
    kept: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b[k] for k in keys]
        change = np.zeros(b.num_rows - 1, dtype=bool)
        for c in columns:
            change |= np.asarray(pc.fill_null(pc.not_equal(c.slice(1), c.slice(0, b.num_rows - 1)), True))
        starts = [0, *(np.flatnonzero(change) + 1).tolist(), b.num_rows]
        for x, y in zip(starts, starts[1:], strict=False):
            key = tuple(c[x].as_py() for c in columns)
            if kept and key != last:
                yield pa.Table.from_batches(kept)
                kept = []
            kept.append(b.slice(x, y - x))
            last = key
    if kept:
        yield pa.Table.from_batches(kept)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 constants), in place where it can."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class WordHashes(dict):
    """64-bit hashes of words, with a bounded memory of those seen."""

    limit = 150_000

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), U64, len(words))


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """One 64-bit hash for each k consecutive words, given the words' hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    h = np.zeros(n, U64)
    for i in range(k):
        h *= U64(0x9E3779B97F4A7C15)
        h += words[i : i + n]
    return mix(h)
