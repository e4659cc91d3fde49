"""Byte-level BPE: encoding and decoding of whole texts, and tree concatenation of long ones.

A text of more than `leaf` bytes is cut in halves, wherever they fall, until each is at most `leaf`
bytes. Leaves are rows of their own, so many tasks encode one text. Neighbours are then joined pairwise:
the tokens around a join are encoded again, in a window that grows until both of its ends agree with
the sides. An end agrees if it is

- a place that parts pre-tokens in any text, by the characters beside it: there the sides are cut; or
- a place inside a run of one kind of characters where the window's outermost token is the side's own:
  a byte pair encoding is the right one if and only if each two adjacent tokens are each other's right
  encoding, so what the side and the window agree on is exact; or
- the end of the side.

Special strings stand alone and part texts before they are cut.

Ties don't occur: a vocabulary's ranks are distinct, and of equal pairs the first is merged. Nulls and empty texts encode to no ids. Repeated rows give repeated results, equal long texts are
encoded once. An empty table gives an empty result. Other columns pass through, and a column named as
a result is replaced by the result.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from weft.llm.common import key_runs, redealt, slices

#: The production parameters: a vocabulary's name in the tokenizers folder, and the bytes of a leaf.
VOCABULARY = "byte_bpe_50k"
LEAF = 16_384
END_OF_TEXT = "<|endoftext|>"
RESULT = "n_tokens long, ids_sha256 string, decoded_sha256 string"


class Codec:
    """Encodes as the tokenizers library does with special strings recognised.

    Texts of the letters up to U+024F without special strings go through the faster tiktoken with
    the same vocabulary, whose pattern has the same classes there; all other texts go through
    tokenizers itself. decode() is the inverse of either.
    """

    _loaded: dict[str, Codec] = {}

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
        self.slow.no_truncation()
        self.slow.no_padding()
        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        # what parts pre-tokens: a change of kind after letters, numbers or signs (an apostrophe may go with letters behind it)
        self.parting = regex.compile(r"(?<=\p{L})(?!\p{L})|(?<=\p{N})(?!\p{N})|(?<=[^\s\p{L}\p{N}'])(?=[\s\p{L}\p{N}])|(?<=')(?=[\s\p{N}])").finditer
        self.run = regex.compile(r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}']+").fullmatch
        self.special = self.slow.token_to_id(END_OF_TEXT)
        self.other = re.compile("[^\x00-ɏ]").search
        self.bytes_of = {v: k for k, v in ranks.items()} | {self.special: END_OF_TEXT.encode()}
        self.digits = [str(i) for i in range(max(self.bytes_of) + 1)]

    @classmethod
    def of(cls, vocabulary: str = VOCABULARY) -> Codec:
        """One codec for each process."""
        if vocabulary not in cls._loaded:
            cls._loaded[vocabulary] = cls(vocabulary)
        return cls._loaded[vocabulary]

    def encode(self, text: str) -> list[int]:
        if self.other(text) or END_OF_TEXT in text:
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def decode(self, ids: list[int]) -> bytes:
        """The UTF-8 of decode(ids, skip_special_tokens=False)."""
        out = b"".join(map(self.bytes_of.__getitem__, ids))
        try:
            out.decode()
        except UnicodeDecodeError:
            return self.slow.decode(ids, skip_special_tokens=False).encode()
        return out

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The ids of two texts' concatenation, given the ids of each."""
        if not left or not right:
            return left or right
        k = 8
        while True:
            i, j = max(0, len(left) - k), min(len(right), k)
            while 0 < i < len(left) and self.bytes_of[left[i]][0] & 0xC0 == 0x80:  # inside a character
                i -= 1
            while 0 < j < len(right) and self.bytes_of[right[j]][0] & 0xC0 == 0x80:
                j += 1
            a, b = (b"".join(map(self.bytes_of.__getitem__, x)).decode() for x in (left[i:], right[:j]))
            start = self._parting(a, last=True)
            end = self._parting(b, last=False)
            first_stays = start is None and i > 0
            last_stays = end is None and j < len(right)
            window = self.encode(a[start or 0 :] + b[:end])
            agreed = (not first_stays or (window[0] == left[i] and self._in_run(left, i))) and (not last_stays or (window[-1] == right[j - 1] and self._in_run(right, j)))
            if agreed:
                return left[: i + self._tokens(left, i, a[: start or 0])] + window + right[j if end is None else self._tokens(right, 0, b[:end]) :]
            k *= 2

    def _parting(self, text: str, last: bool) -> int | None:
        """The last or first place inside a text that parts pre-tokens whatever stands around it; the tokenizer has the last word on kinds."""
        places = [m.start() for m in self.parting(text) if 0 < m.start() < len(text)]
        splits = self.slow.pre_tokenizer.pre_tokenize_str
        return next((p for p in (reversed(places) if last else places) if len(splits(text[p - 1 : p + 1])) == 2), None)

    def _in_run(self, ids: list[int], at: int) -> bool:
        """Whether the place before token `at` is in a run of one kind: three characters before it and one after it."""
        before = b"".join(map(self.bytes_of.__getitem__, ids[max(0, at - 12) : at])).decode(errors="ignore")[-3:]
        after = b"".join(map(self.bytes_of.__getitem__, ids[at : at + 4])).decode(errors="ignore")[:1]
        return len(before) == 3 and bool(after) and bool(self.run(before + after))

    def _tokens(self, ids: list[int], at: int, text: str) -> int:
        """How many ids from `at` on make the text."""
        size, n = len(text.encode()), 0
        while size > 0:
            size -= len(self.bytes_of[ids[at + n]])
            n += 1
        return n

    def tree(self, leaves: list[list[int]]) -> list[int]:
        while len(leaves) > 1:
            leaves = [self.join(*leaves[i : i + 2]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
        return leaves[0] if leaves else []

    def parts(self, text: str, leaf: int) -> Iterator[tuple[int, str]]:
        """(tree, leaf): the leaves of each stretch between special strings, which have trees of their own."""
        for number, stretch in enumerate(re.split(f"({re.escape(END_OF_TEXT)})", text)):
            if stretch:
                pieces = 1 if number % 2 else 1 << (-(-len(stretch.encode()) // leaf) - 1).bit_length()
                at = [len(stretch) * k // pieces for k in range(pieces + 1)]
                yield from ((number, stretch[x:y]) for x, y in zip(at, at[1:], strict=False) if x < y)

    def encode_tree(self, text: str, leaf: int = LEAF) -> list[int]:
        """encode(), in one process, by way of parts() and tree()."""
        return self.assemble([(k, self.encode(part)) for k, part in self.parts(text, leaf)])

    def assemble(self, parts: list[tuple[int, list[int]]]) -> list[int]:
        return [x for _, own in groupby(parts, key=itemgetter(0)) for x in self.tree([ids for _, ids in own])]

    def digests(self, ids: list[int]) -> tuple[int, str, str]:
        joined = ",".join(map(self.digits.__getitem__, ids)).encode()
        return len(ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256(self.decode(ids)).hexdigest()


def _fields(df: DataFrame, columns: list[str], result: str) -> T.StructType:
    return T.StructType([df.schema[c] for c in columns] + T._parse_datatype_string(result).fields)


def encode_texts(df: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, leaf: int = LEAF, ids: bool = False) -> DataFrame:
    """df with n_tokens, ids_sha256 and decoded_sha256 of each text, and with ids=True the ids themselves.

    Texts of more than `leaf` bytes take the distributed tree: their leaves are keyed by the text's digest.
    """
    result = RESULT + (", ids array<int>" if ids else "")
    names = [f.name for f in T._parse_datatype_string(result).fields]
    source = df.select(*[c for c in df.columns if c not in names])
    long = F.coalesce(F.octet_length(text) > leaf, F.lit(False))
    kept = source.columns

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(vocabulary)
        for b in slices(batches, text):
            rows = [codec.encode(t) if t else [] for t in b[text].to_pylist()]
            found = list(zip(*map(codec.digests, rows), strict=True))
            out = [pa.array(found[0], pa.int64()), pa.array(found[1]), pa.array(found[2])] + ([pa.array(rows, pa.list_(pa.int32()))] if ids else [])
            yield pa.RecordBatch.from_arrays([b[c] for c in kept] + out, names=[*kept, *names])

    short = source.where(~long).mapInArrow(plain, _fields(source, kept, result))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(vocabulary)
        for b in slices(batches, "_text"):
            for key, t in zip(b["_key"].to_pylist(), b["_text"].to_pylist(), strict=True):
                rows = list(codec.parts(t, leaf))
                yield pa.RecordBatch.from_pydict({"_key": [key] * len(rows), "_at": pa.array(range(len(rows)), pa.int32()), "_tree": pa.array([r[0] for r in rows], pa.int32()), "_leaf": [r[1] for r in rows]})

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(vocabulary)
        for b in slices(batches, "_leaf"):
            out = [np.asarray(codec.encode(x), np.int32).tobytes() for x in b["_leaf"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["_key"], b["_at"], b["_tree"], pa.array(out, pa.binary())], names=["_key", "_at", "_tree", "_ids"])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(vocabulary)
        for run in key_runs(batches, ["_key"]):
            parts = [(k, np.frombuffer(x, np.int32).tolist()) for k, x in zip(run["_tree"].to_pylist(), run["_ids"].to_pylist(), strict=True)]
            found = codec.assemble(parts)
            n, a, d = codec.digests(found)
            row = {"_key": [run["_key"][0].as_py()], "n_tokens": pa.array([n], pa.int64()), "ids_sha256": [a], "decoded_sha256": [d]}
            yield pa.RecordBatch.from_pydict(row | ({"ids": pa.array([found], pa.list_(pa.int32()))} if ids else {}))

    keyed = source.where(long).withColumn("_key", F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)))
    leaves = keyed.select("_key", F.col(text).alias("_text")).mapInArrow(split, "_key binary, _at int, _tree int, _leaf string")
    leaves = leaves.groupBy("_key", "_at").agg(F.first("_tree").alias("_tree"), F.first("_leaf").alias("_leaf")).mapInArrow(encode, "_key binary, _at int, _tree int, _ids binary")
    whole = leaves.repartition("_key").sortWithinPartitions("_key", "_at").mapInArrow(assemble, "_key binary, " + result)
    return short.unionByName(keyed.join(redealt(whole), "_key").select(*kept, *names))
