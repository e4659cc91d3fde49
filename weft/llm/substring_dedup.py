"""Duplicate word windows of all documents, by a compressed FM-index for each shard.

A window is `window` consecutive words of one document. Its anchor is its smallest (by digest) run of
`anchor` words, so equal windows have equal anchors. Consecutive windows of one anchor form a segment; segments whose anchor occurs once hold no repeated window and go at once.
The others are dealt to shards by their anchor, so each window meets all its copies in one shard.
A shard's segments are indexed, some thousands at a time, never parting an anchor's: a
Burrows-Wheeler transform in a wavelet matrix of bit vectors with rank blocks. Documents' segments
are streamed backwards: each step extends the match by a word, and a match of more than `window`
words gives up its last by the index's boundaries of equal prefixes, so the state is always the
interval of the longest match up to `window`. An interval of two or more at full length is reported.

An anchor of more than `hot` occurrences would fill a shard. Its segments are instead counted by their
contents with partial sums, and the windows of the distinct ones by 128-bit digests, each with its
segment's count: the exact way for any number of copies.

Equal texts are one class and read once; a class of two or more rows repeats all its windows. Null
and empty texts have no words. Nothing depends on doc_id: null and repeated ids are rows as others,
repeated rows are documents of their own. Texts of any length are taken whole: a long one is many segments.
An empty table gives an empty result. Extra columns pass through; those named as results are
replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import xxhash
from pyspark.sql import DataFrame

from weft.llm.common import U64, WordHashes, as_bytes, key_runs, redealt, slices, window_hashes

#: The production parameters: words of a window and of an anchor, occurrences of a hot anchor, words of an index.
WINDOW = 35
ANCHOR = 8
HOT = 4096
INDEX_WORDS = 300_000
#: Most windows of a segment.
SEGMENT = 63


class BitVector:
    """Bits with constant-time rank: 64-bit words and the ones before each."""

    def __init__(self, bits: np.ndarray):
        n = len(bits) // 64 + 1
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(n * 8, np.uint8)
        self.words[: len(packed)] = packed
        self.words = self.words.view("<u8")
        ones = np.bitwise_count(self.words)
        self.before = np.concatenate([[0], np.cumsum(ones[:-1], dtype=np.int64)]).astype(np.int32)
        self.zeros = len(bits) - int(ones.sum())

    def rank1(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        block = at >> 6
        mask = (U64(1) << (at & 63).astype(U64)) - U64(1)
        return self.before[block] + np.bitwise_count(self.words[block] & mask)


class FMIndex:
    """Counts of patterns of up to `window` + 1 symbols in a text of small positive integers; a 0 parts stretches and ends the text."""

    def __init__(self, text: np.ndarray, window: int = WINDOW):
        n, depth = len(text), 1
        rank = text.astype(np.int64)
        kept: dict[int, np.ndarray] = {1: rank}
        while True:  # prefix doubling, until suffixes are sorted by more symbols than any pattern has
            ahead = np.zeros(n, np.int64)
            ahead[: n - depth] = rank[depth:] + 1 if depth < n else 0
            key = rank * (int(max(rank.max(), ahead.max())) + 2) + ahead
            sa = np.argsort(key, kind="stable")
            step = np.empty(n, np.int64)
            step[0] = 0
            np.cumsum(key[sa[1:]] != key[sa[:-1]], out=step[1:])
            rank = np.empty(n, np.int64)
            rank[sa] = step
            depth *= 2
            kept[depth] = rank
            if depth > window:
                break
        half = max(d for d in kept if d <= window)
        then = np.zeros(n, np.int64)
        then[: max(0, n - (window - half))] = kept[half][window - half :] + 1
        first, second = kept[half][sa], then[sa]
        edge = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
        starts = np.flatnonzero(edge)
        group = np.cumsum(edge) - 1
        #: The interval of all suffixes with the same first `window` symbols as each suffix.
        self.first = starts[group].astype(np.int32)
        self.end = np.append(starts[1:], n)[group].astype(np.int32)
        self.n, self.window = n, window
        symbols = int(text.max()) + 1
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])[:symbols].astype(np.int64)
        rows = text[sa - 1].astype(np.int64)
        self.levels = max(1, int(symbols - 1).bit_length())
        self.bits: list[BitVector] = []
        for level in range(self.levels - 1, -1, -1):  # a wavelet matrix: at each level zeros go before ones
            bit = (rows >> level & 1).astype(bool)
            self.bits.append(BitVector(bit))
            rows = np.concatenate([rows[~bit], rows[bit]])
        self.base = self._down(np.arange(symbols), np.zeros(symbols, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, bits in zip(range(self.levels - 1, -1, -1), self.bits, strict=True):
            ones = bits.rank1(at)
            at = np.where(symbol >> level & 1, bits.zeros + ones, at - ones)
        return at

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the matches with one symbol before them."""
        shift = self.less[symbol] - self.base[symbol]
        both = self._down(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        return both[: len(symbol)] + shift, both[len(symbol) :] + shift

    def repeated(self, stretches: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the window at each place of each row of stretches (padded to the right) occurs twice or more in the text."""
        rows, wide = stretches.shape
        low, high, size = np.zeros(rows, np.int64), np.full(rows, self.n, np.int64), np.zeros(rows, np.int64)
        out = np.zeros((rows, wide), bool)
        for j in range(wide - 1, -1, -1):
            on = np.flatnonzero(length > j)
            if not len(on):
                continue
            a, b = self.extend(stretches[on, j], low[on], high[on])
            s = size[on] + 1
            long = s > self.window
            a, b = np.where(long, self.first[np.minimum(a, self.n - 1)], a), np.where(long, self.end[np.minimum(a, self.n - 1)], b)
            low[on], high[on], size[on] = a, b, np.minimum(s, self.window)
            out[on, j] = (b - a >= 2) & (size[on] == self.window)
        return out


def sliding(op: np.ufunc, x: np.ndarray, span: int) -> np.ndarray:
    """op (minimum or maximum) over each `span` consecutive values, by doubling."""
    width = 1
    while 2 * width <= span:
        x, width = op(x[:-width], x[width:]), 2 * width
    return op(x[: len(x) - (span - width)], x[span - width :]) if width < span else x


def anchors(words: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each run of windows with one anchor, given the words' hashes: digest, first window, number of windows (at most SEGMENT), whether the anchor stands in it twice."""
    if len(words) < window:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    h, span = window_hashes(words, anchor), window - anchor + 1
    low = sliding(np.minimum, h, span)
    first = np.concatenate([[0], np.flatnonzero(low[1:] != low[:-1]) + 1])
    n = np.diff(np.append(first, len(low)))
    # a place is its windows' smallest if the largest of their minima is its value; places of a run follow each other
    none = np.zeros(span - 1, U64)
    place = h[sliding(np.maximum, np.concatenate([none, low, none]), span) == h]
    twice = np.diff(np.append(np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1]), len(place))) > 1
    if n.max() > SEGMENT:  # a long run becomes several segments
        pieces = -(-n // SEGMENT)
        at = np.repeat(first, pieces) + SEGMENT * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        n = np.minimum(SEGMENT, np.repeat(first + n, pieces) - at)
        first, twice = at, np.repeat(twice, pieces)
    return low[first], first, n, twice


def _covered(n: int, starts: np.ndarray, masks: np.ndarray, window: int) -> np.ndarray:
    """Which of n words the windows at starts[k] + i cover, for each bit i of masks[k]."""
    k, i = np.nonzero(masks[:, None] >> np.arange(SEGMENT) & 1)
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, starts[k] + i, 1)
    np.add.at(mark, starts[k] + i + window, -1)
    return np.cumsum(mark[:-1]) > 0


def _index_block(runs: list[pa.Table], window: int) -> Iterator[pa.RecordBatch]:
    """key, first word and mask of repeated windows of each of the block's segments that has any."""
    table = pa.concat_tables(runs)
    split = [w.split(b" ") for w in table["data"].to_pylist()]
    length = np.array([len(w) for w in split])
    number: dict[bytes, int] = {}
    flat = [number.setdefault(w, len(number) + 1) for s in split for w in s]
    rows = np.zeros((len(split), int(length.max())), np.int64)
    rows[np.arange(rows.shape[1]) < length[:, None]] = flat
    text = np.zeros(len(flat) + len(split), np.int64)
    at = np.repeat(np.cumsum(length + 1) - length - 1, length) + np.concatenate([np.arange(n) for n in length.tolist()])
    text[at] = flat
    found = FMIndex(text, window).repeated(rows, length)
    mask = (found[:, :SEGMENT].astype(np.int64) << np.arange(min(SEGMENT, found.shape[1]))).sum(axis=1)
    some = pa.array(np.flatnonzero(mask))
    yield pa.RecordBatch.from_arrays([table[c].combine_chunks().take(some) for c in ("key", "start")] + [pa.array(mask[mask != 0])], names=["key", "start", "mask"])


def repeated_windows(base: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, hot: int = HOT, index_words: int = INDEX_WORDS) -> DataFrame:
    """key, start, mask: bit i tells that the window at word start + i starts elsewhere too. base: key, text."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in slices(batches, "text"):
            keys, digests, places = [], [], []
            for k, t in enumerate(as_bytes(b["text"])):
                h, first, n, twice = anchors(hashes((t or b"").split()), window, anchor)
                keys.append(np.full(len(h), k))
                digests.append(h)
                places.append(first * 128 + n * 2 + twice)
            h = np.concatenate(digests).view(np.int64)
            yield pa.RecordBatch.from_arrays([b["key"].take(pa.array(np.concatenate(keys))), pa.array(h), pa.array(np.concatenate(places).astype(np.int64))], names=["key", "h", "at"])

    found = base.mapInArrow(find, "key binary, h long, at long")
    often = found.groupBy("h").agg(F.sum(F.lit(1) + F.col("at") % 2).alias("n")).where("n >= 2").select("h", (F.col("n") > hot).alias("hot"))
    own = found.join(redealt(often), "h").groupBy("key").agg(F.collect_list(F.struct("h", "at", "hot")).alias("places"))
    rows = base.join(own, "key").select("key", "text", "places")

    def cut_out(batches: Iterator[pa.RecordBatch], of_hot: bool) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1_000_000):
            out: tuple[list, list, list, list] = ([], [], [], [])
            for key, text, places in zip(b["key"].to_pylist(), as_bytes(b["text"]), b["places"].to_pylist(), strict=True):
                words = None
                for p in places:
                    if p["hot"] != of_hot:
                        continue
                    words = words if words is not None else text.split()
                    start, n = p["at"] >> 7, p["at"] >> 1 & 63
                    for column, value in zip(out, (p["h"], key, start, b" ".join(words[start : start + window + n - 1])), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.binary())], names=["h", "key", "start", "data"])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for run in key_runs(batches, ["h"]):
            n = sum(map(len, run["data"].to_pylist())) // 4
            if held and size + n > index_words:
                yield from _index_block(held, window)
                held, size = [], 0
            held.append(run)
            size += n
        if held:
            yield from _index_block(held, window)

    def each_window(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for segment, n, data in zip(b["segment"].to_pylist(), b["n"].to_pylist(), b["data"].to_pylist(), strict=True):
                words = data.split(b" ")
                out += [(segment, n, i, xxhash.xxh3_128_digest(b" ".join(words[i : i + window]))) for i in range(len(words) - window + 1)]
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["segment", "n", "at", "digest"])

    kinds = "h long, key binary, start int, data binary"
    segments = rows.mapInArrow(lambda b: cut_out(b, False), kinds)
    indexed = segments.repartition("h").sortWithinPartitions("h").mapInArrow(index, "key binary, start int, mask long")
    single = rows.where(F.exists("places", lambda p: p["hot"])).mapInArrow(lambda b: cut_out(b, True), kinds)
    single = single.withColumn("segment", F.unhex(F.md5("data")))
    distinct = single.groupBy("segment").agg(F.count("*").alias("n"), F.first("data").alias("data"))
    windows = distinct.mapInArrow(each_window, "segment binary, n long, at int, digest binary")
    twice = windows.groupBy("digest").agg(F.sum("n").alias("n")).where("n >= 2").select("digest")
    masks = windows.join(redealt(twice), "digest").groupBy("segment").agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("mask"))
    return indexed.unionByName(single.select("segment", "key", "start").join(redealt(masks), "segment").select("key", "start", "mask"))


def remove_repeats(docs: DataFrame, text: str = "text", window: int = WINDOW, anchor: int = ANCHOR, hot: int = HOT, index_words: int = INDEX_WORDS, kept_text: bool = False) -> DataFrame:
    """docs with n_words, n_removed, kept_sha256 of each text.

    With kept_text=True the column text gives way to kept_text: the text as it was if nothing is removed
    (null if it was null), else the words kept, joined by spaces.
    """
    result = ["n_words", "n_removed", "kept_sha256"] + (["kept_text"] if kept_text else [])
    key = F.unhex(F.md5(F.encode(F.coalesce(text, F.lit("")), "UTF-8")))
    base = docs.select(key.alias("key"), F.coalesce(text, F.lit("")).alias("text")).groupBy("key").agg(F.count("*").alias("rows"), F.max("text").alias("text")).where("rows > 0 AND key IS NOT NULL")  # always so; said here, all uses below have one exchange of the texts
    covered = repeated_windows(base.select("key", "text"), window, anchor, hot, index_words).groupBy("key").agg(F.collect_list("start").alias("starts"), F.collect_list("mask").alias("masks"))
    joined = base.join(covered, "key", "left").select("key", "rows", "text", "starts", "masks")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1_000_000):
            out: list[tuple] = []
            for rows, t, starts, masks in zip(b["rows"].to_pylist(), as_bytes(b["text"]), b["starts"], b["masks"], strict=True):
                words = t.split()
                n = len(words)
                if rows > 1 and n >= window:
                    words = []
                elif starts.is_valid:
                    gone = _covered(n, starts.values.to_numpy().astype(np.int64), masks.values.to_numpy(), window)
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                kept = b" ".join(words)
                out.append((n, n - len(words), hashlib.sha256(kept).hexdigest(), (kept if len(words) < n else t).decode()))
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([b["key"], pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2]), *([pa.array(columns[3])] if kept_text else [])], names=["key", *result])

    found = joined.mapInArrow(remove, "key binary, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if kept_text else ""))
    rows = docs.drop(*result).withColumn("_key", key)
    if not kept_text:
        return rows.join(found.withColumnRenamed("key", "_key"), "_key").drop("_key")
    rows = rows.withColumn("_null", F.col(text).isNull()).drop(text)  # texts come from the classes, and aren't moved again
    return rows.join(found.withColumnRenamed("key", "_key"), "_key").withColumn("kept_text", F.when(~F.col("_null"), F.col("kept_text"))).drop("_key", "_null")
