"""Vector bin packing of examples under limits on tokens, segments and loss-bearing tokens, by dot products.

A sequence has what its limits leave of three resources. Among the examples at hand that fit, the one
goes in whose demand has the largest dot product with what is left, each resource as a share of its
limit and weighted by how much of it the examples at hand ask for on average. So scarce resources are
spent on examples that use the others too. What no example fits in is filled with the front of the
longest one, whose rest stays at hand.

Sequences are padded to the token limit, unless their length is a power of two. Where another limit
ends a sequence, or the examples end, the largest power of two is kept and the rest stays at hand:
nothing is padded. With `whole`, only examples that no sequence can hold are cut, and gaps are padded.

Each task packs its own rows and holds at most `POOL` examples with `AHEAD` tokens, and one more
example: there is no shuffle, nothing reaches the driver, and a lost task is packed again as a whole.
Sequences are numbered within their task.

Documents: null texts are empty texts, which are one end id; texts of any length are taken whole;
repeated rows and ids are packed as rows of their own. Examples without ids give no piece; null `bears`
bear loss everywhere, and null `part` is one segment. An empty table gives an empty result. Columns
that are not named are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from weft.llm.bpe import VOCABULARY, Codec
from weft.llm.common import slices

#: The production parameters: id at a text's end; limits of a sequence (tokens, segments, loss-bearing tokens) for documents
#: and for instruction data; examples and tokens that a task holds.
END = 0
LIMITS = (1024, 64, 1024)
INSTRUCTION_LIMITS = (1024, 32, 768)
POOL, AHEAD = 1024, 1_000_000


@dataclass(slots=True)
class Example:
    """ids; loss: how many of the ids before each place bear loss; part: the segment of each id; at: ids that were placed."""

    key: Any
    ids: np.ndarray
    loss: np.ndarray
    part: np.ndarray
    at: int = 0

    @classmethod
    def of(cls, key: Any, ids: np.ndarray, bears: np.ndarray | None = None, part: np.ndarray | None = None) -> Example:
        n = len(ids)
        loss = np.arange(n + 1, dtype=np.int32) if bears is None else np.concatenate([[0], np.cumsum(bears, dtype=np.int32)])
        return cls(key, ids, loss, np.zeros(n, np.int8) if part is None else part)

    def demand(self, start: int, end: int) -> tuple[int, int, int]:
        return end - start, int(self.part[end - 1]) - int(self.part[start]) + 1, int(self.loss[end] - self.loss[start])

    def fitting(self, room: np.ndarray) -> int:
        """How many ids from `at` on fit in the room."""
        end = min(self.at + int(room[0]), len(self.ids))
        by_loss = int(np.searchsorted(self.loss[self.at : end + 1], self.loss[self.at] + room[2], side="right")) - 1
        by_part = int(np.searchsorted(self.part[self.at : end], int(self.part[self.at]) + room[1]))
        return min(by_loss, by_part)


#: A piece: an example, and where its ids start and end.
Piece = tuple[Example, int, int]


class Pool:
    """The examples at hand."""

    def __init__(self, limits: tuple[int, int, int], whole: bool):
        self.limits, self.whole, self.examples, self.tokens = np.array(limits, np.int64), whole, [], 0
        self.demand = np.zeros((64, 3), np.int64)

    def add(self, example: Example) -> None:
        n = len(self.examples)
        if n == len(self.demand):
            self.demand = np.concatenate([self.demand, np.zeros_like(self.demand)])
        self.examples.append(example)
        self.demand[n] = example.demand(example.at, len(example.ids))
        self.tokens += int(self.demand[n, 0])

    def take(self, k: int, many: int) -> Piece:
        """The next ids of an example, which leaves if none are left."""
        x = self.examples[k]
        start, x.at = x.at, x.at + many
        self.tokens -= many
        if x.at < len(x.ids):
            self.demand[k] = x.demand(x.at, len(x.ids))
        else:
            self.examples[k], self.demand[k] = self.examples[-1], self.demand[len(self.examples) - 1]
            self.examples.pop()
        return x, start, x.at

    def give_back(self, piece: Piece) -> None:
        """A piece that was taken last of its example."""
        x, start, end = piece
        if end < len(x.ids):
            k = next(i for i, y in enumerate(self.examples) if y is x)
            x.at = start
            self.demand[k] = x.demand(start, len(x.ids))
            self.tokens += end - start
        else:
            x.at = start
            self.add(x)

    def sequence(self) -> list[Piece]:
        """The pieces of the next sequence."""
        room, pieces, n = self.limits.copy(), [], len(self.examples)
        weight = self.demand[:n].mean(axis=0) / self.limits**3
        while room[0] and self.examples:
            asked = self.demand[: len(self.examples)]
            fits = (asked <= room).all(axis=1)
            if fits.any():
                k = int(np.where(fits, asked @ (weight * room), -1.0).argmax())
                many = int(asked[k, 0])
            else:
                large = (asked > self.limits).any(axis=1) if self.whole else np.ones(len(asked), bool)
                k = int(np.where(large, asked[:, 0], -1).argmax())
                many = self.examples[k].fitting(room) if large[k] else 0
                if not many:
                    break
            pieces.append(self.take(k, many))
            room -= pieces[-1][0].demand(*pieces[-1][1:])
        return pieces if self.whole else self._even(pieces)

    def _even(self, pieces: list[Piece]) -> list[Piece]:
        """The pieces up to a length that is not padded; the rest is given back."""
        total = sum(end - start for _, start, end in pieces)
        keep = total if total == self.limits[0] else 1 << (total.bit_length() - 1)
        while total > keep:
            x, start, end = pieces.pop()
            cut = min(end - start, total - keep)
            self.give_back((x, end - cut, end))
            total -= cut
            if end - cut > start:
                pieces.append((x, start, end - cut))
        return pieces


def sequences(examples: Iterable[Example], limits: tuple[int, int, int] = LIMITS, whole: bool = False, pool: int = POOL, ahead: int = AHEAD) -> Iterator[list[Piece]]:
    if min(limits) < 1:
        raise ValueError("each limit must be at least 1")
    held = Pool(limits, whole)
    for x in examples:
        if len(x.ids):
            held.add(x)
        while len(held.examples) >= pool or held.tokens >= ahead:
            yield held.sequence()
    while held.examples:
        yield held.sequence()


def rows(found: Iterable[list[Piece]], schema: pa.Schema, keys: list[str]) -> Iterator[pa.RecordBatch]:
    """A row for each piece: the key columns, then what `PIECE` names."""
    number, out = TaskContext.get().partitionId() << 40, []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    for pieces in found:
        offset = 0
        for x, start, end in pieces:
            many, segments, loss = x.demand(start, end)
            out.append((*x.key, start, many, zlib.crc32(x.ids[start:end].tobytes()), len(x.ids), number, offset, segments, loss))
            offset += many
        number += 1
        if len(out) >= 8192:
            yield batch()
            out = []
    if out:
        yield batch()


PIECE = "start long, length long, ids_crc32 long, {} long, sequence_id long, offset long, segments long, loss_tokens long"


def _schema(spark_schema: str) -> pa.Schema:
    return to_arrow_schema(T._parse_datatype_string(spark_schema))


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limits: tuple[int, int, int] = LIMITS, end: int = END, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, segments and loss_tokens of each piece.

    A text is one segment; its ids bear loss, its end id doesn't.
    """
    spark_schema = f"doc_id {docs.select(doc_id).dtypes[0][1]}, " + PIECE.format("doc_tokens")
    schema = _schema(spark_schema)

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[Example]:
        codec = Codec.of(vocabulary)
        for b in slices(batches, text):
            for d, t in zip(b[doc_id].to_pylist(), b[text].to_pylist(), strict=True):
                ids = np.array([*(codec.encode(t) if t else ()), end], "<u4")
                x = Example.of((d,), ids)
                x.loss[-1] -= 1
                yield x

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return rows(sequences(examples(batches), limits), schema, ["doc_id"])

    return docs.select(doc_id, text).mapInArrow(pack, spark_schema)


def pack_examples(examples: DataFrame, keys: list[str], limits: tuple[int, int, int] = INSTRUCTION_LIMITS, whole: bool = True) -> DataFrame:
    """The keys, start, length, ids_crc32, example_tokens, sequence_id, offset, segments and loss_tokens of each piece of examples with columns

    ids (array<int>), bears (array<boolean>: which ids bear loss) and part (array<int>: the segment of each id, not falling).
    """
    kinds = dict(examples.dtypes)
    spark_schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", " + PIECE.format("example_tokens")
    schema = _schema(spark_schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[Example]:
        for b in batches:
            columns = [b[k].to_pylist() for k in keys]
            for i in range(b.num_rows):
                ids, bears, part = (b[c][i].values for c in ("ids", "bears", "part"))
                if ids is not None and len(ids):
                    yield Example.of(tuple(c[i] for c in columns), np.asarray(ids).astype("<u4"), None if bears is None else np.asarray(bears).astype(bool), None if part is None else np.asarray(part).astype(np.int64))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return rows(sequences(read(batches), limits, whole), schema, keys)

    return examples.select(*keys, "ids", "bears", "part").mapInArrow(pack, spark_schema)


def conversation_examples(turns: DataFrame, limits: tuple[int, int, int] = INSTRUCTION_LIMITS, end: int = END, vocabulary: str = VOCABULARY, bearing: str = "assistant") -> DataFrame:
    """conv_id, turn (the first one), ids, bears and part of examples: consecutive turns of a conversation as long as they keep the limits.

    Each turn is a segment, and ends with the end id; turns of the role `bearing` bear loss. Turns are
    dealt by ranges of (conv_id, turn), so a conversation may span tasks, and a range's end ends an example.
    """

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, run, out, size = Codec.of(vocabulary), [], [], 0

        def closed() -> None:
            ids = np.concatenate([r[2] for r in run])
            out.append((run[0][0], run[0][1], ids, np.repeat([r[3] for r in run], [len(r[2]) for r in run]), np.repeat(np.arange(len(run)), [len(r[2]) for r in run])))

        def batch() -> pa.RecordBatch:
            d, t, ids, bears, part = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(d, schema.field(0).type), pa.array(t, schema.field(1).type), pa.array(ids, schema.field(2).type), pa.array(bears, schema.field(3).type), pa.array(part, schema.field(4).type)], schema=schema)

        for b in slices(batches, "text"):
            for d, t, role, text in zip(*(b[c].to_pylist() for c in ("conv_id", "turn", "role", "text")), strict=True):
                ids = np.array([*(codec.encode(text) if text else ()), end], np.int32)
                demand = np.array([len(ids), 1, len(ids) * (role == bearing)])
                if run and (d is None or d != run[-1][0] or (asked + demand > limits).any()):
                    closed()
                    size += sum(len(r[2]) for r in run)
                    run = []
                asked = demand if not run else asked + demand
                run.append((d, t, ids, role == bearing))
                if size > 1 << 18:
                    yield batch()
                    out, size = [], 0
        if run:
            closed()
        if out:
            yield batch()

    kinds = dict(turns.dtypes)
    spark_schema = f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, ids array<int>, bears array<boolean>, part array<int>"
    schema = _schema(spark_schema)
    dealt = turns.select("conv_id", "turn", "role", "text").repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", F.xxhash64("text"))
    return dealt.mapInArrow(examples, spark_schema)
