"""Best-fit packing of token pieces into sequences, by linear grouping.

Only the histogram of piece lengths (at most `size` rows) reaches the driver. There, large lengths
are sorted and cut into groups of equal cardinality, each length is rounded up to its group's
largest, and the few rounded sizes are packed by column generation over configurations, whose whole
parts are kept. Actual lengths take the places of the rounded ones; what is left, and what rounding
left a useless gap beside, is placed by best fit, largest first, and small pieces fill by best fit.
Sequences with the same contents are one run with a count, so the plan stays small: for each (length, range of ranks) where it goes. The plan,
whose size depends on `size` and `groups` alone, is broadcast, and each piece looks its place up by
its rank among the pieces of its length. Ranks come from counts per task, so no task sees all
pieces of a length.

Nulls encode as empty texts, which give one piece with the end id. Repeated rows and ids are
packed as rows of their own. An empty table gives an empty result. Other columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.window import Window

from weft.llm.bpe import VOCABULARY, Codec
from weft.llm.common import cut, slices

#: The production parameters: tokens of a sequence, id at a document's end, groups of large lengths, least length that is large.
SIZE = 1024
END = 2
GROUPS = 160
LARGE = 256
#: Gaps (from, to before) of configured sequences that are taken apart again.
GAPS = ((0, 0), (1, 8), (1, 16), (1, 32), (1, 1 << 30), (2, 1 << 30), (4, 1 << 30), (8, 1 << 30))
_STEP = 1 << 48


def configurations(sizes: np.ndarray, demand: np.ndarray, size: int) -> list[tuple[np.ndarray, int]]:
    """Configurations (how many of each size stand in a sequence) and how often each is used: the whole parts of a linear optimum.

    Column generation: the dearest configuration under the current prices enters the basis until none is
    worth more than a sequence. Sizes are large, so few stand in a sequence: the best values of up to half
    of them are tables over capacities, and two of those make a configuration.
    """
    n = len(sizes)
    most = size // int(sizes.min())
    basis = np.diag((size // sizes).astype(float))
    inverse, used = np.diag(1 / np.diag(basis)), demand / np.diag(basis)
    dot = lambda a, b: np.einsum("ij,j...->i...", a, b)  # noqa: E731  (small, and without the threads of a linear algebra library in the driver)
    room = np.arange(size + 1)[:, None] - sizes[None, :]
    fits, before = room >= 0, np.maximum(room, 0)
    everywhere = np.arange(size + 1)
    for step in range(1, 30 * n):
        price = inverse.sum(axis=0)
        values, choices = [np.zeros(size + 1)], []
        for _ in range(-(-most // 2)):
            value = np.where(fits, values[-1][before] + price, -np.inf)
            choice = value.argmax(axis=1)
            better = value[everywhere, choice] > values[-1] + 1e-12
            choices.append(np.where(better, choice, -1))
            values.append(np.where(better, value[everywhere, choice], values[-1]))
        halves = values[most // 2] + values[-1][::-1]
        at = int(halves.argmax())
        if halves[at] <= 1 + 1e-6:
            break
        column = np.zeros(n)
        for level, c in ((most // 2, at), (len(choices), size - at)):
            for choice in reversed(choices[:level]):
                if choice[c] >= 0:
                    column[choice[c]] += 1
                    c -= sizes[choice[c]]
        entering = dot(inverse, column)
        ratio = np.where(entering > 1e-9, np.maximum(used, 0) / np.where(entering > 1e-9, entering, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out] = column
        row = inverse[out] / entering[out]
        inverse -= np.outer(entering, row)
        inverse[out] = row
        used -= ratio[out] * entering
        used[out] = ratio[out]
        if step % 100 == 0:  # a Newton step, so that rounding errors don't add up
            inverse += dot(inverse, np.eye(n) - dot(basis, inverse))
            used = dot(inverse, demand)
    whole = np.floor(used + 1e-6).astype(np.int64)
    return [(basis[:, i].astype(np.int64), int(whole[i])) for i in range(n) if whole[i] > 0]


class _Runs:
    """Equal sequences as runs, found by free space."""

    def __init__(self, size: int):
        self.size = size
        self.by_free: list[list[tuple[int, list[int]]]] = [[] for _ in range(size + 1)]

    def add(self, count: int, items: list[int]) -> None:
        if count:
            self.by_free[self.size - sum(items)].append((count, items))

    def best_fit(self, length: int, count: int) -> None:
        free = length
        while count and free <= self.size:
            if not self.by_free[free]:
                free += 1
                continue
            n, items = self.by_free[free].pop()
            take = min(n, count)
            count -= take
            self.add(n - take, items)
            self.add(take, [*items, length])
            free = length
        if count:
            each = self.size // length
            self.add(count // each, [length] * each)
            self.add(1 if count % each else 0, [length] * (count % each))


def grouped(lengths: dict[int, int], groups: int) -> dict[int, list[list[int]]]:
    """The lengths, largest first, in groups of equal cardinality: for each group's largest length, its [length, count]."""
    each = max(1, -(-sum(lengths.values()) // groups))
    out: dict[int, list[list[int]]] = {}
    largest, room = 0, 0
    for k in sorted(lengths, reverse=True):
        n = lengths[k]
        while n:
            if not room:
                largest, room = k, each
            take = min(n, room)
            out.setdefault(largest, []).append([k, take])
            n, room = n - take, room - take
    return out


def substituted(stock: dict[int, list[list[int]]], size: int) -> Iterator[tuple[int, list[int]]]:
    """Runs of the configurations of rounded sizes, with actual lengths in their places; what they take leaves the stock."""
    sizes = sorted(stock, reverse=True)
    demand = np.array([sum(n for _, n in stock[s]) for s in sizes], float)
    for column, used in configurations(np.array(sizes), demand, size):
        need = {s: n for s, n in zip(sizes, column.tolist(), strict=True) if n}
        while used and need and all(sum(n for _, n in stock[s]) >= k for s, k in need.items()):
            picks, step = [], used
            for s, k in need.items():  # the k places take from the k largest stretches of this size
                stretch = [x for x in stock[s] if x[1]]
                if len(stretch) >= k:
                    picks += [(x, 1) for x in stretch[:k]]
                else:
                    share = k
                    for i, x in enumerate(stretch):
                        part = -(-share // (len(stretch) - i))
                        picks.append((x, part))
                        share -= part
            step = min([step, *(x[1] // part for x, part in picks)])
            if not step:  # a last sequence of what is there
                picks, step = [], 1
                for s, k in need.items():
                    for x in stock[s]:
                        part = min(x[1], k)
                        k -= part
                        if part:
                            picks.append((x, part))
            for x, part in picks:
                x[1] -= part * step
            yield step, [x[0] for x, part in picks for _ in range(part)]
            used -= step


def finished(runs: list[tuple[int, list[int]]], left: dict[int, int], size: int, low: int, high: int) -> list[tuple[int, list[int]]]:
    """The runs but those with a gap of low to high - 1, and all other pieces by best fit, largest first."""
    out, left = _Runs(size), dict(left)
    for n, items in runs:
        if low <= size - sum(items) < high:
            for k in items:
                left[k] = left.get(k, 0) + n
        else:
            out.add(n, items)
    for k in sorted(left, reverse=True):
        out.best_fit(k, left[k])
    return [r for free in out.by_free for r in free]


def plan(counts: dict[int, int], size: int = SIZE, groups: int = GROUPS, large: int = LARGE) -> list[tuple[int, list[int]]]:
    """Runs (count, lengths in a sequence) that hold counts[length] pieces of each length from 1 to size.

    Rounding leaves gaps in the configured sequences. Those whose gap small pieces rarely fill are taken
    apart before the small ones come; which gaps these are depends on the lengths, so each of `GAPS` is
    finished, and the one of the fewest sequences stays.
    """
    runs, left = [], {k: n for k, n in counts.items() if n}
    if big := {k: left.pop(k) for k in list(left) if large <= k < size}:
        stock = grouped(big, groups)
        runs = list(substituted(stock, size))
        for own in stock.values():
            for k, n in own:
                left[k] = left.get(k, 0) + n
    return min((finished(runs, left, size, low, high) for low, high in GAPS), key=lambda found: sum(n for n, _ in found))


def places(runs: list[tuple[int, list[int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys (length * 2^48 + first rank), and for each the first rank, first sequence and offset."""
    rows, ranks, base = [], {}, 0
    for count, items in runs:
        offset = 0
        for k in items:
            first = ranks.get(k, 0)
            rows.append((k * _STEP + first, first, base, offset))
            ranks[k] = first + count
            offset += k
        base += count
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return table[:, 0].copy(), table[:, 1].copy(), table[:, 2].copy(), table[:, 3].copy()


def token_pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, end: int = END, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each text's pieces, with the task and the rank in it among pieces of the length."""

    def cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, seen = Codec.of(vocabulary), {}
        task = TaskContext.get().partitionId()
        for b in slices(batches, text):
            rows = []
            for d, t in zip(b[doc_id].to_pylist(), b[text].to_pylist(), strict=True):
                ids = np.array([*(codec.encode(t) if t else ()), end], "<u4")
                to, at = (len(ids) - 1) % size + 1, 0
                for piece in range(-(-len(ids) // size)):
                    rank = seen.get(to - at, 0)
                    seen[to - at] = rank + 1
                    rows.append((d, piece, at, to - at, zlib.crc32(ids[at:to].tobytes()), task, rank))
                    at, to = to, to + size
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "_task", "_rank"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    return docs.select(doc_id, text).mapInArrow(cut_texts, "doc_id long, piece int, start long, length long, ids_crc32 long, _task int, _rank long")


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, end: int = END, vocabulary: str = VOCABULARY, groups: int = GROUPS, large: int = LARGE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every text."""
    pieces = cut(token_pieces(docs, doc_id, text, size, end, vocabulary))
    counts = pieces.groupBy("_task", "length").agg(F.count("*").alias("_n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most `size` rows
    table = pieces.sparkSession.sparkContext.broadcast(places(plan(histogram, size, groups, large)))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    firsts = counts.select("_task", "length", F.coalesce(before, F.lit(0)).alias("_before"))
    ranked = pieces.join(firsts, ["_task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_before") + F.col("_rank")).alias("_rank"))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, first, base, offset = table.value
        for b in batches:
            rank = b["_rank"].to_numpy()
            at = np.searchsorted(keys, b["length"].to_numpy() * _STEP + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(base[at] + rank - first[at]), pa.array(offset[at])], names=[*b.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(look_up, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
