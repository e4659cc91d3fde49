"""Near-duplicate documents: banded MinHash, sequential Bayesian verification, exact confirmation.

A document's set is its distinct shingles of five lower-case (A-Z) words; with fewer words, the whole
sequence. Equal sets are one class, and one member stands for it. Classes that share a band of their
signatures are candidates; a star for each band's bucket (every member to the smallest) gives groups
that no candidate pair leaves. A group's texts meet in one task, or, beyond `block` members, in a
task for each pair of the group's blocks, so no task grows with a group. There, signatures are
compared in batches, and a pair goes when the posterior probability (uniform prior) that its
similarity reaches the threshold falls under `miss`. Survivors are confirmed on full sets, and a
spanning star of each connected part goes on. Connected components are found by alternating large
and small stars, whose edges never reach the driver.

A pair at the threshold of 0.8 shares no band with probability under 4e-6 (bands=32, rows=5), and is
pruned in a batch with probability about `miss`.

Null and empty texts have empty sets and are linked with nothing. Rows of one doc_id are one
document. A row without a doc_id has no component of its own: it takes that of the rows with ids whose
set equals its own, else null; it is not searched for near copies of other sets (the pipeline numbers rows,
so there it is). Ties don't occur: every minimum is of ids. Texts of any length are taken whole. An empty
table gives an empty result. Extra columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import xxhash
from pyspark.sql import Column, DataFrame

from weft.llm.common import LOWER, U64, WordHashes, as_bytes, cut, key_runs, redealt, slices, window_hashes

#: The production parameters: words of a shingle, percent of similarity, bands, rows of a band, hashes of a batch, miss probability, documents and bytes of a block.
WORDS = 5
PERCENT = 80
BANDS, ROWS = 32, 5
BATCH = 32
MISS = 1e-6
BLOCK = 256
BLOCK_BYTES = 4_000_000
#: Bytes that a shingle counts for.
BYTES = 8


class Shingler:
    def __init__(self, words: int = WORDS):
        self.words, self.hashes = words, WordHashes()

    def __call__(self, text: bytes | None) -> np.ndarray:
        """Sorted 64-bit hashes of the distinct shingles."""
        found = (text or b"").translate(LOWER).split()
        if not found:
            return np.zeros(0, U64)
        return np.unique(window_hashes(self.hashes(found), min(self.words, len(found))))


@cache
def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_501)
    return rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def signature(shingles: np.ndarray, n: int = BANDS * ROWS) -> np.ndarray:
    """The minimum of each of n hash functions over a set that is not empty."""
    a, b = _functions(n)
    x = (shingles >> U64(32)).astype(np.uint32)
    out = np.full(n, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 1024):
        h = x[at : at + 1024, None] * a
        h += b
        # the product's low bits are weak: the order is by the bits turned round
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        np.minimum(out, h.min(axis=0), out=out)
    return out


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    return window_hashes_of_rows(sig.reshape(bands, rows).astype(U64), np.arange(bands, dtype=U64))


def window_hashes_of_rows(rows: np.ndarray, salt: np.ndarray) -> np.ndarray:
    h = salt.copy()
    for i in range(rows.shape[1]):
        h *= U64(0x9E3779B97F4A7C15)
        h += rows[:, i]
        h ^= h >> U64(29)
    return window_hashes(h, 1)


@cache
def least_matches(n: int, percent: int, miss: float) -> int:
    """The fewest of n matches at which the similarity may reach the threshold with probability `miss` or more."""
    t, total = percent / 100, 0.0
    for m in range(n + 1):  # P(Beta(m + 1, n - m + 1) > t) = P(Bin(n + 1, t) <= m)
        total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


def survivors(sigs: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int, miss: float = MISS, batch: int = BATCH) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j of left x right that no batch of hashes prunes."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, len(left), 64):
        rows = left[at : at + 64]
        i, j = np.nonzero((sigs[rows, None, :batch] == sigs[None, right, :batch]).sum(axis=2) >= least_matches(batch, percent, miss))
        i, j = rows[i], right[j]
        keep = i < j if left is right else i != j
        i, j = i[keep], j[keep]
        for n in range(2 * batch, sigs.shape[1] + 1, batch):
            if not len(i):
                break
            ok = np.concatenate([(sigs[i[k : k + 8192], :n] == sigs[j[k : k + 8192], :n]).sum(axis=1) for k in range(0, len(i), 8192)]) >= least_matches(n, percent, miss)
            i, j = i[ok], j[ok]
        found.append((i, j))
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def confirmed(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs reach the threshold, by their full sets."""
    size = np.array([len(s) for s in sets], np.int64)
    if len(i) <= 2000:
        shared = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
    else:  # one product of 0/1 matrices, over the shingles that two or more of the sets hold, a stretch at a time
        used = np.unique(np.concatenate([i, j]))
        at = np.full(len(sets), -1)
        at[used] = np.arange(len(used))
        _, inverse, count = np.unique(np.concatenate([sets[k] for k in used]), return_inverse=True, return_counts=True)
        common = np.cumsum(count > 1) - 1
        row, keep = np.repeat(np.arange(len(used)), size[used]), count[inverse] > 1
        row, column = row[keep], common[inverse[keep]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        both = np.zeros((len(used), len(used)), np.float64)
        step = max(1, 4_000_000 // len(used))
        for first in range(0, int(common[-1]) + 1, step):
            x, y = np.searchsorted(column, [first, first + step])
            m = np.zeros((len(used), step), np.float32)
            m[row[x:y], column[x:y] - first] = 1
            both += m @ m.T
        shared = both[at[i], at[j]].astype(np.int64)
    return 100 * shared >= percent * (size[i] + size[j] - shared)


def parts(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest member of each node's connected part."""
    label = np.arange(n)
    while len(i):
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (before == label).all():
            break
    return label


def features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, set_key (a digest of the set; null if empty) and band keys of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for b in slices(batches, text):
            n, keys, bands = [], [], []
            for t in as_bytes(b[text]):
                s = shingler(t)
                n.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                bands.append(band_keys(signature(s)).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b[doc_id], pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "set_key", "bands"])

    return docs.select(F.col(doc_id).cast("long").alias(doc_id), text).mapInArrow(run, "doc_id long, n_shingles long, set_key binary, bands array<long>")


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of the nodes of edges (a, b)."""
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        state = now
        # each side is dealt by its node once: the minimum and the join both use that
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).repartition("a")
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).repartition("a").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())


def candidate_groups(classes: DataFrame) -> DataFrame:
    """node, component of all classes (doc_id, bands) that share a band with another."""
    keys = classes.select(F.col("doc_id"), F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.min("doc_id").alias("b"), F.max("doc_id").alias("most")).where("b <> most")
    return components(keys.join(redealt(buckets), "key").select(F.col("doc_id").alias("a"), "b"))


def meetings(groups: DataFrame, classes: DataFrame, lengths: DataFrame, block: int = BLOCK, block_bytes: int = BLOCK_BYTES, bucket_cost: float = 1.0) -> DataFrame:
    """node, at, _own, _x, _y: the tasks (at, _x, _y) in which a node meets all candidates, and its block in them.

    groups: node, component. classes: doc_id, bands. lengths: node, n_bytes. A group of one block meets
    in one task. A larger one meets either in all pairs of its blocks, or bucket by bucket of the bands
    (each in pairs of its own blocks), whichever moves fewer rows: a chain of loosely related documents
    falls into small buckets, true copies share them all.
    """

    def blocks(n: str, size: str) -> Column:
        return F.greatest(F.ceil(F.col(n) / block), F.ceil(F.col(size) / block_bytes), F.lit(1)).cast("int")

    def dealt(rows: DataFrame) -> DataFrame:
        own = F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int")
        both = rows.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        return both.select("node", "at", "_own", F.least("_own", "_other").alias("_x"), F.greatest("_own", "_other").alias("_y"))

    nodes = groups.join(lengths, "node")
    size = nodes.groupBy("component").agg(F.count("*").alias("_rows"), F.sum("n_bytes").alias("_bytes")).withColumn("_blocks", blocks("_rows", "_bytes"))
    large = nodes.join(size.where("_blocks > 1").select("component"), "component")
    keys = classes.join(large, F.col("doc_id") == F.col("node")).select("node", "component", "n_bytes", F.explode("bands").alias("key"))
    buckets = keys.groupBy("component", "key").agg(F.count("*").alias("_rows"), F.sum("n_bytes").alias("_bytes")).where("_rows > 1").withColumn("_blocks", blocks("_rows", "_bytes"))
    moved = buckets.groupBy("component").agg(F.sum(F.col("_rows") * F.col("_blocks")).alias("_moved"))
    chosen = size.join(moved, "component", "left").select("component", "_blocks", F.coalesce(F.col("_moved") * bucket_cost < F.col("_rows") * F.col("_blocks"), F.lit(False)).alias("_by_bucket"))
    whole = groups.join(chosen.where("NOT _by_bucket"), "component").select("node", F.concat(F.lit("g"), F.col("component").cast("string")).alias("at"), "_blocks")
    parted = keys.join(chosen.where("_by_bucket").select("component"), "component").join(buckets.select("component", "key", "_blocks"), ["component", "key"])
    return dealt(whole).unionByName(dealt(parted.select("node", F.concat(F.lit("b"), F.col("key").cast("string")).alias("at"), "_blocks")))


def links(docs: DataFrame, met: DataFrame, doc_id: str, text: str, percent: int, miss: float = MISS) -> DataFrame:
    """Edges (a, b) that span the connected parts of each task's links."""
    dealt = met.join(docs.select(F.col(doc_id).cast("long").alias("node"), F.col(text).alias("_text")), "node").select("at", "_x", "_y", "node", "_own", "_text")
    keys = ["at", "_x", "_y"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for group in key_runs(batches, keys):
            nodes, mine = group["node"].to_numpy(), group["_own"].to_numpy() == group["_x"][0].as_py()
            sets = [shingler(t) for t in as_bytes(group["_text"])]
            filled = np.array([len(s) > 0 for s in sets])
            sigs = np.stack([signature(s) if len(s) else np.zeros(BANDS * ROWS, np.uint32) for s in sets])
            left, right = np.flatnonzero(mine & filled), np.flatnonzero(~mine & filled)
            one = group["_x"][0].as_py() == group["_y"][0].as_py()
            if not len(left) or not (one or len(right)):
                continue
            i, j = survivors(sigs, left, left if one else right, percent, miss)
            ok = confirmed(sets, i, j, percent) if len(i) else np.zeros(0, bool)
            low = parts(len(nodes), i[ok], j[ok])
            apart = np.flatnonzero(low != np.arange(len(low)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[apart]), pa.array(nodes[low[apart]])], names=["a", "b"])

    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row; links are pairs with 100 * shared >= percent * united."""
    rows = cut(features(docs, doc_id, text))
    classes = rows.where("set_key IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"))
    groups = candidate_groups(classes.where("doc_id IS NOT NULL").select("doc_id", "bands"))
    # rows of one doc_id are one document, so their classes are one component
    same = rows.where("set_key IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "set_key").join(redealt(classes.select("set_key", F.col("doc_id").alias("b"))), "set_key")
    repeated = same.groupBy("doc_id").agg(F.min("b").alias("b"), F.max("b").alias("most")).where("b <> most").select(F.explode(F.array("doc_id", "most")).alias("a"), "b")
    lengths = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg((F.max("n_shingles") * BYTES).alias("n_bytes")).withColumnRenamed("doc_id", "node")
    met = meetings(groups, classes.select("doc_id", "bands"), lengths)
    found = components(links(docs, met, doc_id, text, percent).unionByName(repeated))
    of_class = classes.select("set_key", "doc_id").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("set_key", F.coalesce("component", "doc_id").alias("component_id"))
    full = rows.where("set_key IS NOT NULL").select("doc_id", "n_shingles", "set_key").join(redealt(of_class), "set_key").select("doc_id", "n_shingles", "component_id")
    empty = rows.where("set_key IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return full.unionByName(empty).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
