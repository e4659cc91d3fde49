"""Links between the tokens of two tokenizers, by a dictionary of groups.

Both tokenizers cut a text's bytes. Where tokens of both end at one byte a group ends, so each token is
in one group, and each A token of a group is linked with each of its B tokens. Text repeats its groups
far more often than it shows new ones, so groups are interned:

- a task takes its texts in blocks of about `block` bytes. The groups of a block are told apart by
  hashes and held against the tokens themselves; its dictionary has each distinct group once, with its
  documents and occurrences, and a text is a list of numbers in that dictionary. Blocks and
  dictionaries are stored in the shared folder;
- dictionaries are added up to one table of distinct groups, whose links are expanded there, once for
  each distinct group, and multiplied by its documents or its occurrences. A document that holds a pair
  in several distinct groups was counted for each of them: blocks tell how often that happened, and
  it is subtracted;
- what a group's links amount to is joined back to the dictionaries by the group's key, and each
  block gets its own dictionary back for its documents.

A key has one row for each block that holds it, so no group is a hot key. A dictionary is at most as
large as its block; a block is at least one text. A pair of ids is expanded once for each distinct
group that holds it, whatever the number of copies in it.

Texts that are null or empty, or that one of the tokenizers doesn't give back byte for byte, have no
tokens: zeros and an empty groups_sha256. Strings of special tokens are text. Each row is a document
of its own: repeated rows and ids count as often as they stand there, null ids stay. Texts of any
length are taken whole. An empty table gives an empty result. Other columns are left out.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyspark.sql.functions as F
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from weft.llm.bpe import VOCABULARY, Codec
from weft.llm.common import U64, mix, redealt, shared_dir, slices

#: The production parameters: the second vocabulary's name in the tokenizers folder, bytes of a block's texts.
PIECES = "piece_bpe_32k"
BLOCK = 4_000_000
_B = 1 << 31
_LONGEST_KEY = 60


class Pair:
    """Both tokenizers, and the bytes of each id."""

    _loaded: dict[tuple[str, str], Pair] = {}

    def __init__(self, a: str, b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.codec = Codec.of(a)
        self.plain = Tokenizer.from_file(public_tokenizers.path(f"{a}.json"))
        self.plain.no_truncation()
        self.plain.no_padding()
        self.plain.encode_special_tokens = True
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(f"{b}.model"))
        self.bytes_a = [self.codec.bytes_of.get(i, b"") for i in range(max(self.codec.bytes_of) + 1)]
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.size_a, self.size_b = (np.array([len(x) for x in of], np.int64) for of in (self.bytes_a, self.bytes_b))

    @classmethod
    def of(cls, a: str = VOCABULARY, b: str = PIECES) -> Pair:
        """One pair for each process."""
        if (a, b) not in cls._loaded:
            cls._loaded[a, b] = cls(a, b)
        return cls._loaded[a, b]

    def encode(self, text: str | None) -> tuple[list[int], list[int]]:
        """The ids of both, or none if one of them doesn't give the text back."""
        if not text:
            return [], []
        spaced = f" {text}"
        a = self.plain.encode(spaced, add_special_tokens=False).ids if self.codec.other(spaced) else self.codec.fast.encode_ordinary(spaced)
        b = self.pieces.encode(text, num_threads=1)
        want = spaced.encode()
        same = b"".join(map(self.bytes_a.__getitem__, a)) == want and b"".join(map(self.bytes_b.__getitem__, b)) == want
        return (a, b) if same else ([], [])


def runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size says."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def packed(*arrays: np.ndarray) -> bytes:
    """Integers under 2^31 as one compressed value, its bytes of one significance together."""
    return zstandard.ZstdCompressor().compress(np.concatenate(arrays).astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<i4").ravel().astype(np.int64)


class Block:
    """The groups of some texts, interned."""

    def __init__(self, pair: Pair, texts: list[str | None]):
        ids = [pair.encode(t) for t in texts]
        self.n_a, self.n_b = (np.array([len(x[k]) for x in ids], np.int64) for k in (0, 1))
        self.a, self.b = (np.fromiter((i for x in ids for i in x[k]), np.int64, int(n.sum())) for k, n in ((0, self.n_a), (1, self.n_b)))
        del ids
        end_a, end_b = np.cumsum(pair.size_a[self.a]), np.cumsum(pair.size_b[self.b])
        common = np.intersect1d(end_a, end_b, assume_unique=True)
        self.of_a, self.of_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
        self.many_a, self.many_b = (np.bincount(x, minlength=len(common)) for x in (self.of_a, self.of_b))
        self.from_a, self.from_b = np.cumsum(self.many_a) - self.many_a, np.cumsum(self.many_b) - self.many_b
        last = np.concatenate([[0], end_a])[np.cumsum(self.n_a)]  # of each text, its last byte among all
        ends = np.searchsorted(common, last, side="right")
        self.n_groups = np.diff(ends, prepend=0)
        self.n_links = np.diff(np.concatenate([[0], np.cumsum(self.many_a * self.many_b)])[ends], prepend=0)
        self._intern()
        text = np.repeat(np.arange(len(texts)), self.n_groups)
        held, self.freq = np.unique(text * max(1, len(self.first)) + self.local, return_counts=True)
        self.text, self.held = np.divmod(held, max(1, len(self.first)))

    def _intern(self) -> None:
        """local: each group's number; first: where each number first stands. Numbers fall with occurrences."""
        in_a, in_b = np.arange(len(self.a)) - self.from_a[self.of_a], np.arange(len(self.b)) - self.from_b[self.of_b]
        hashed = lambda x, at, salt: mix(x.astype(U64) * U64(0x9E3779B97F4A7C15) + (at.astype(U64) << U64(34)) + U64(salt))
        keys = np.zeros(0, U64)
        if len(self.from_a):
            keys = np.add.reduceat(hashed(self.a, in_a, 1), self.from_a) * U64(0xD1B54A32D192ED03) + np.add.reduceat(hashed(self.b, in_b, 2), self.from_b)
        _, first, local, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
        same = self._same(first[local], in_a, in_b)
        if not same:  # two groups of one hash: told apart by their tokens
            seen: dict[tuple, int] = {}
            local = np.array([seen.setdefault((tuple(self.ids(g)[0]), tuple(self.ids(g)[1])), len(seen)) for g in range(len(self.from_a))], np.int64)
            _, first, local, counts = np.unique(local, return_index=True, return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.first, self.local = first[order], rank[local.ravel()]

    def _same(self, like: np.ndarray, in_a: np.ndarray, in_b: np.ndarray) -> bool:
        """Whether each group has the tokens of the group `like` it."""
        if not (np.array_equal(self.many_a, self.many_a[like]) and np.array_equal(self.many_b, self.many_b[like])):
            return False
        return np.array_equal(self.a, self.a[self.from_a[like][self.of_a] + in_a]) and np.array_equal(self.b, self.b[self.from_b[like][self.of_b] + in_b])

    def ids(self, group: int) -> tuple[list[int], list[int]]:
        x, y = self.from_a[group], self.from_b[group]
        return self.a[x : x + self.many_a[group]].tolist(), self.b[y : y + self.many_b[group]].tolist()

    def dictionary(self) -> list[tuple[list[int], list[int]]]:
        """The ids of each distinct group."""
        return [self.ids(g) for g in self.first.tolist()]

    def digests(self, dictionary: list[tuple[list[int], list[int]]]) -> list[str]:
        """groups_sha256 of each text; a distinct group is written out once."""
        written = [f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in dictionary]
        ends = np.cumsum(self.n_groups).tolist()
        local, out = self.local.tolist(), []
        for x, y in zip([0, *ends], ends, strict=False):
            out.append(hashlib.sha256(";".join(map(written.__getitem__, local[x:y])).encode()).hexdigest() if y > x else "")
        return out

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each distinct group, its documents and its occurrences."""
        n = len(self.first)
        return np.bincount(self.held, minlength=n), np.bincount(self.local, minlength=n)

    def surplus(self, dictionary: list[tuple[list[int], list[int]]]) -> Counter[int]:
        """For pairs (a << 32 | b): in how many groups beyond the first the documents that hold them do so."""
        each = [[x << 32 | y for x in set(a) for y in set(b)] for a, b in dictionary]
        sizes = np.array([len(x) for x in each], np.int64)
        codes, pair, times = np.unique(np.fromiter((c for x in each for c in x), np.int64, int(sizes.sum())), return_inverse=True, return_counts=True)
        shared = times[pair] > 1  # other pairs are in one distinct group
        group = np.repeat(np.arange(len(each)), sizes)[shared]
        sizes = np.bincount(group, minlength=len(each))
        starts = np.cumsum(sizes) - sizes
        at = runs(starts[self.held], sizes[self.held])
        key = np.repeat(self.text, sizes[self.held]) * max(1, len(codes)) + pair[shared][at]
        found, n = np.unique(key, return_counts=True)
        out: Counter[int] = Counter()
        for code, more in zip(codes[found[n > 1] % max(1, len(codes))].tolist(), (n[n > 1] - 1).tolist(), strict=True):
            out[code] += more
        return out


def key_of(a: list[int], b: list[int]) -> tuple[bytes, bytes | None]:
    """A group's key, and its ids if the key is a digest of them: ids of B have the highest bit set."""
    ids = np.array([*a, *(x | _B for x in b)], "<u4").tobytes()
    return (ids, None) if len(ids) <= _LONGEST_KEY else (b"#" + xxhash.xxh3_128_digest(ids), ids)


_DOCS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
_STORED = "kind string, block long, local int, key binary, ids binary, n_docs long, n long, a int, b int, doc_id array<{}>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, held binary"


class Alignment:
    """docs, tokenized and interned, as tables in the shared folder."""

    def __init__(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", a: str = VOCABULARY, b: str = PIECES, block: int = BLOCK):
        self.kind = docs.select(doc_id).dtypes[0][1]
        self.spark, self.folder = docs.sparkSession, f"{shared_dir(docs.sparkSession)}/alignment-{uuid.uuid4().hex}"
        schema = _STORED.format(self.kind)

        def intern(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pair, number = Pair.of(a, b), TaskContext.get().partitionId() << 32
            for s in slices(batches, "text", block):
                x = Block(pair, s["text"].to_pylist())
                groups = x.dictionary()
                keys, (n_docs, n), more = [key_of(*g) for g in groups], x.counts(), x.surplus(groups)
                sizes = np.bincount(x.text, minlength=s.num_rows)
                held = packed(sizes, np.where(np.diff(x.text, prepend=-1) == 0, np.diff(x.held, prepend=0), x.held), x.freq)
                yield filled(kind=["group"] * len(keys), block=[number] * len(keys), local=range(len(keys)), key=[k for k, _ in keys], ids=[i for _, i in keys], n_docs=n_docs, n=n)
                yield filled(kind=["surplus"] * len(more), a=[c >> 32 for c in more], b=[c & 0xFFFFFFFF for c in more], n_docs=[-k for k in more.values()])
                whole = {"doc_id": s["doc_id"].to_pylist(), "n_a": x.n_a.tolist(), "n_b": x.n_b.tolist(), "n_groups": x.n_groups.tolist(), "n_links": x.n_links.tolist(), "groups_sha256": x.digests(groups)}
                yield filled(kind=["block"], block=[number], held=[held], **{k: [v] for k, v in whole.items()})
                number += 1

        types = to_arrow_schema(T._parse_datatype_string(schema))

        def filled(**columns) -> pa.RecordBatch:
            n = len(columns["kind"])
            return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in types], schema=types)

        docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(intern, schema).write.option("compression", "zstd").parquet(f"{self.folder}/interned")
        self.schema = schema
        self.links = self._links()

    def of(self, kind: str) -> DataFrame:
        """Stored rows of a kind: block, group (of a block's dictionary) or surplus."""
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/interned").where(F.col("kind") == kind)

    def groups(self) -> DataFrame:
        """Distinct groups: key, ids (of A, then of B with the highest bit set), their documents and occurrences."""
        each = self.of("group").groupBy("key", "ids").agg(F.sum("n_docs").alias("n_docs"), F.sum("n").alias("n"))
        return each.select("key", F.coalesce("ids", "key").alias("ids"), "n_docs", "n")

    def _links(self) -> DataFrame:
        """key, a, b, times (pairs of occurrences in a group), n_docs and n of the group: the links of each distinct group."""

        def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    b, out = batch.slice(at, 4096), []
                    for k, ids in enumerate(b["ids"].to_pylist()):
                        ids = memoryview(ids).cast("I").tolist()
                        left, right = Counter(x for x in ids if x < _B), Counter(x - _B for x in ids if x >= _B)
                        out += [(k, x, y, n * m) for x, n in left.items() for y, m in right.items()]
                        if len(out) > 1 << 16:
                            yield rows(b, out)
                            out = []
                    if out:
                        yield rows(b, out)

        def rows(b: pa.RecordBatch, out: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
            k, x, y, times = zip(*out, strict=True)
            own = b.take(pa.array(k))
            return pa.RecordBatch.from_pydict({"key": own["key"], "a": pa.array(x, pa.int32()), "b": pa.array(y, pa.int32()), "times": pa.array(times, pa.int64()), "n_docs": own["n_docs"], "n": own["n"]})

        self.groups().mapInArrow(expand, "key binary, a int, b int, times long, n_docs long, n long").write.option("compression", "zstd").parquet(f"{self.folder}/links")
        return self.spark.read.parquet(f"{self.folder}/links")

    def pairs(self) -> DataFrame:
        """a, b, n_docs (documents that hold the pair linked), n_links (linked occurrences), best (whether no pair of its A id has more documents)."""
        each = self.links.select("a", "b", "n_docs", (F.col("times") * F.col("n")).alias("n_links"))
        less = self.of("surplus").select("a", "b", "n_docs", F.lit(0).cast("long").alias("n_links"))
        counted = each.unionByName(less).groupBy("a", "b").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_links").alias("n_links"))
        top = counted.groupBy("a").agg(F.max("n_docs").alias("_top"))  # a row for each id of A's vocabulary at most
        return counted.join(F.broadcast(top), "a").select("a", "b", "n_docs", "n_links", (F.col("n_docs") == F.col("_top")).alias("best"))

    def documents(self) -> DataFrame:
        """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
        pairs = redealt(self.pairs().select("a", "b", F.col("n_docs").alias("count"), "best"))
        linked = self.links.select("key", "a", "b", "times").join(pairs, ["a", "b"])
        worth = linked.groupBy("key").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("best"), F.sum(F.col("times") * F.col("count")).alias("sum"))
        words = self.of("group").select("block", "local", "key").join(worth, "key").select("block", "local", "best", "sum")
        blocks = self.of("block").select("block", *_DOCS, "held")

        def settle(left: pa.Table, right: pa.Table) -> pa.Table:
            best, total = np.zeros(left.num_rows, np.int64), np.zeros(left.num_rows, np.int64)
            local = left["local"].to_numpy()
            best[local], total[local] = left["best"].to_numpy(), left["sum"].to_numpy()
            own = {c: right[c].combine_chunks().flatten() for c in _DOCS}
            ints = unpacked(right["held"][0].as_py())
            sizes, (held, freq) = ints[: len(own["doc_id"])], ints[len(own["doc_id"]) :].reshape(2, -1)
            ends = np.cumsum(sizes)
            held = np.cumsum(held) - np.repeat(np.concatenate([[0], np.cumsum(held)])[ends - sizes], sizes)
            added = lambda x: np.diff(np.concatenate([[0], np.cumsum(freq * x[held])])[ends], prepend=0)
            return pa.table(own | {"n_best": pa.array(added(best)), "count_sum": pa.array(added(total))}).select(names)

        names = [*_DOCS[:-1], "n_best", "count_sum", _DOCS[-1]]
        schema = f"doc_id {self.kind}, " + ", ".join(f"{c} long" for c in names[1:-1]) + f", {names[-1]} string"
        return words.groupBy("block").cogroup(blocks.groupBy("block")).applyInArrow(settle, schema)


def align(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", a: str = VOCABULARY, b: str = PIECES, block: int = BLOCK) -> DataFrame:
    """What each document's links amount to: Alignment.documents()."""
    return Alignment(docs, doc_id, text, a, b, block).documents()
