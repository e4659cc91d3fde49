"""Lines of all listed sources: raw_lines(file_idx, line_no, line, eol), by the data source `weft_lines`.

Sources are cut in ranges: plain files, members of plain tars and bzip2 files by bytes, xz files by their
blocks. Gzip files and members of zips are a range each, a compressed tar is one for all its members. A
range owns the lines that stand behind a line end in it, so it passes over the line that it begins in
and reads on to the end of its last one, and all ranges together give the lines of the whole, however they are cut. Ranges are
dealt to partitions by their bytes.

Lines of sources with many ranges are counted first, range by range, so that each range knows its first
number (or, with dense=False, numbers grow with the ranges, and nothing is read twice). \\n, \\r\\n and a
lone \\r all end a line; with byte fidelity eol keeps what did, else it is \\n. Bytes that are no
UTF-8 become U+FFFD. A damaged source ends where the damage is met: what was decoded before is there,
the last line as far as it came, then a row without a line that tells the error. What else goes wrong (a file that a task can't see,
a failing disk) fails the task.
"""

from __future__ import annotations

import base64
import io
import json
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass, field
from typing import IO, Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from weft.sources.codecs import DAMAGE, PIECE, Block, Chunks, bz_range, damaged, decoded, inflated, raw, xz_blocks, xz_range
from weft.sources.listing import Listing, list_sources, packing_of, spread
from weft.sources.match import Matcher
from weft.sources.stores import everywhere, store_of

LINES = "file_idx int, line_no bigint, line string, eol string"
ERROR = ", error string"
NAMES = ", source_path string, alias string"
#: Bytes of a range of a plain file, and of a compressed one; bytes of a partition, if there are enough.
SPLIT_BYTES = 64_000_000
PACKED_BYTES = 16_000_000
TASK_BYTES = 64_000_000
#: Numbers of a range, if they aren't dense.
RANGE_STEP = 1 << 40
_ENDS = ["\n", "\r", "\r\n", ""]


@dataclass
class Range:
    """What is read as one: bytes start to end of a source that stands in bytes low to high of a file."""

    files: list[int]
    path: str
    how: str
    start: int = 0
    end: int = 0
    low: int = 0
    high: int = 0
    #: Of a compressed tar, the places of its members; of a zip's member how it is packed, and its checksum and size.
    places: list[int] = field(default_factory=list)
    method: int = 0
    crc: int = 0
    size: int = 0
    #: The number of its first line.
    base: int = 0
    ordinal: int = 0

    def cost(self) -> int:
        return self.end - self.start + 4096


def _xz_cuts(path: str, store: str, packed: int) -> list[tuple[int, int]]:
    """The blocks of an xz file in stretches of about `packed` bytes; none if it has no index."""
    system, inner = store_of(path, store)
    try:
        with system.open_input_file(inner) as file:
            blocks = xz_blocks(file)
    except DAMAGE:
        return []
    cuts, held = [0], 0
    for i, b in enumerate(blocks):
        if held and held + b.packed > packed:
            cuts.append(i)
            held = 0
        held += b.packed
    return list(zip(cuts, [*cuts[1:], len(blocks)], strict=True))


def ranges(listing: Listing, split: int = SPLIT_BYTES, packed: int = PACKED_BYTES, spark: SparkSession | None = None) -> list[Range]:
    """The ranges of a listing, in the order of its sources."""
    out: list[Range] = []
    tars: dict[str, Range] = {}
    sources = [(i, s, everywhere(s.container_path, listing.store)) for i, s in enumerate(listing.sources)]
    large = [p for _, s, p in sources if s.kind == "xz" and s.size > packed]
    store = listing.store  # alone: what the function names goes to every task
    cuts = dict(zip(large, spread(spark, lambda p: _xz_cuts(p, store, packed), large, 1), strict=True))

    def bytewise(i: int, path: str, how: str, low: int, high: int, step: int) -> None:
        for n, at in enumerate(range(low, high, step) if high > low else [low]):
            out.append(Range([i], path, how, at, min(at + step, high), low, high, ordinal=n))

    for i, s, path in sources:
        if s.kind == "plain":
            bytewise(i, path, "bytes", 0, s.size, split)
        elif s.kind == "bz2":
            bytewise(i, path, "bz2", 0, s.size, packed)
        elif s.kind == "tar" and s.at >= 0:
            bytewise(i, path, "bytes", s.at, s.at + s.size, split)
        elif s.kind == "xz" and cuts.get(path):
            for n, (a, b) in enumerate(cuts[path]):
                out.append(Range([i], path, "xz", a, b, 0, s.size, ordinal=n))
        elif s.kind == "zip":
            out.append(Range([i], path, "zip", 0, s.packed, s.at, 0, places=[s.ordinal], method=s.method, crc=s.crc, size=s.size))
        elif s.kind == "tar":
            if path not in tars:
                tars[path] = Range([], path, "tar")
                out.append(tars[path])
            tars[path].files.append(i)
            tars[path].places.append(s.ordinal)
            tars[path].end += s.size
        else:
            out.append(Range([i], path, "whole " + s.kind, 0, s.size, 0, s.size))
    return out


def dealt(found: list[Any], tasks: int, task: int = TASK_BYTES) -> list[list[Any]]:
    """Ranges in partitions of about equal bytes, in their order."""
    most = max(1, min(task, -(-sum(r.cost() for r in found) // max(1, tasks))))
    out: list[list[Range]] = []
    held = most
    for r in found:
        if held >= most:
            out.append([])
            held = 0
        out[-1].append(r)
        held += r.cost()
    return out


class Lines:
    """Complete lines as bytes one after another, and what ends each (its place in _ENDS)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, ends: np.ndarray):
        self.data, self.offsets, self.ends = data, offsets, ends

    def __len__(self) -> int:
        return len(self.ends)

    @classmethod
    def one(cls, pieces: list[bytes], end: int) -> Lines:
        data = np.frombuffer(b"".join(pieces), np.uint8)
        return cls(data, np.array([0, len(data)]), np.array([end]))

    def text(self) -> pa.Array:
        offsets = self.offsets.astype(np.int32) if len(self.data) < 1 << 31 else None
        if offsets is not None:
            found = pa.StringArray.from_buffers(len(self), pa.py_buffer(offsets.tobytes()), pa.py_buffer(self.data.tobytes()))
            try:
                found.validate(full=True)
            except pa.ArrowInvalid:
                pass
            else:
                return found
        whole = self.data.tobytes()
        return pa.array([whole[a:b].decode("utf-8", "replace") for a, b in zip(self.offsets.tolist(), self.offsets[1:].tolist(), strict=False)], pa.string())


def _cut(chunk: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the line ends in a chunk: where their contents stop, where they stop, and their kinds. A \\r at the end is one."""
    a = np.frombuffer(chunk, np.uint8)
    at = np.flatnonzero((a == 10) | (a == 13))
    if not len(at):
        return at, at, at
    is_r = a[at] == 13
    if not is_r.any():
        return at, at + 1, np.zeros(len(at), np.int64)
    pair = np.concatenate([is_r[:-1] & ~is_r[1:] & (at[1:] == at[:-1] + 1), [False]])  # a \r before its \n
    after = np.concatenate([[False], pair[:-1]])
    at, is_r, after = at[~pair], is_r[~pair], after[~pair]
    return at - after, at + 1, np.where(after, 2, is_r.astype(np.int64))


def owned(own: Iterator[bytes], after: Iterator[bytes], first: bool) -> Iterator[Lines]:
    """The lines of a range with the chunks `own` that `after` follow. `first` ranges own the line they begin with.

    A long line's chunks are kept as they are until it ends.
    """
    begun, pieces, held = first, [], b""
    rest: BaseException | None = None
    try:
        for chunk in own:
            chunk, held = held + chunk, b""
            if chunk.endswith(b"\r"):  # may be half of an end
                chunk, held = chunk[:-1], b"\r"
            content, ends, kinds = _cut(chunk)
            if not len(ends):
                if begun and chunk:
                    pieces.append(chunk)
                continue
            start = 0
            if not begun or pieces:
                if begun:
                    yield Lines.one([*pieces, chunk[: content[0]]], int(kinds[0]))
                begun, pieces, start = True, [], int(ends[0])
                content, ends, kinds = content[1:], ends[1:], kinds[1:]
            if len(ends):
                a = np.frombuffer(chunk, np.uint8)[start : int(ends[-1])]
                keep = np.ones(len(a), bool)
                keep[ends - 1 - start] = False
                keep[ends[kinds == 2] - 2 - start] = False
                sizes = content - np.concatenate([[start], ends[:-1]])
                yield Lines(a[keep], np.concatenate([[0], np.cumsum(sizes)]), kinds)
                start = int(ends[-1])
            if start < len(chunk):
                pieces.append(chunk[start:])
    except (*DAMAGE, OSError) as error:
        if not damaged(error):
            raise
        rest = error
    if rest is not None:
        if begun and (pieces or held):
            yield Lines.one(pieces, 1 if held else 3)
        raise rest
    if held:
        peeked = next(after, b"")
        pair = peeked.startswith(b"\n")
        if begun:
            yield Lines.one(pieces, 2 if pair else 1)
        if pair:
            return  # that end is the next range's
        begun, pieces = True, []
        after = _before(peeked, after)
    if begun:
        yield from _to_its_end(pieces, after)


def _before(chunk: bytes, chunks: Iterator[bytes]) -> Iterator[bytes]:
    if chunk:
        yield chunk
    yield from chunks


def _to_its_end(pieces: list[bytes], after: Iterator[bytes]) -> Iterator[Lines]:
    """The line of these pieces, which may end in `after`. What is damaged there is the next range's to tell."""
    held, end = b"", 3
    try:
        for chunk in after:
            chunk, held = held + chunk, b""
            if chunk.endswith(b"\r"):
                chunk, held = chunk[:-1], b"\r"
            content, _, kinds = _cut(chunk)
            if len(kinds):
                pieces, end, held = [*pieces, chunk[: content[0]]], int(kinds[0]), b""
                break
            if chunk:
                pieces.append(chunk)
    except (*DAMAGE, OSError) as error:
        if not damaged(error):
            raise
    end = 1 if held else end
    if pieces or end != 3:
        yield Lines.one(pieces, end)


def _checked(chunks: Iterator[bytes], r: Range) -> Iterator[bytes]:
    """A zip's member, whose checksum and size must hold."""
    crc = size = 0
    for chunk in chunks:
        crc, size = zlib.crc32(chunk, crc), size + len(chunk)
        yield chunk
    if crc != r.crc or size != r.size:
        raise zipfile.BadZipFile("checksum or size don't hold")


def _zipped(file: IO[bytes], r: Range) -> Iterator[bytes]:
    if r.low < 0:
        raise zipfile.BadZipFile("the member is encrypted")
    if r.method not in (0, 8):  # packed in a rarer way
        with zipfile.ZipFile(file) as z, z.open([m for m in z.infolist() if not m.is_dir()][r.places[0]]) as f:
            while data := f.read(PIECE):
                yield data
            return
    file.seek(r.low)
    head = file.read(30)
    if len(head) < 30 or head[:4] != b"PK\3\4":
        raise zipfile.BadZipFile("no member stands where the directory says")
    name, extra = struct.unpack("<HH", head[26:30])
    at = r.low + 30 + name + extra
    packed = raw(file, at, at + r.end)
    yield from _checked(packed if r.method == 0 else inflated(packed, -15), r)


def _chunks(file: IO[bytes], r: Range) -> tuple[Iterator[bytes], Iterator[bytes]]:
    """What a range holds, and what follows in its source."""
    none: Iterator[bytes] = iter(())
    if r.how == "bytes":
        return raw(file, r.start, r.end), raw(file, r.end, r.high)
    if r.how == "bz2":
        return bz_range(file, r.start, r.end, r.high), bz_range(file, r.end, r.high, r.high) if r.end < r.high else none
    if r.how == "xz":
        blocks: list[Block] = xz_blocks(file)
        return xz_range(file, blocks[r.start : r.end]), xz_range(file, blocks[r.end :])
    return (_zipped(file, r) if r.how == "zip" else decoded(r.how.split()[1], file)), none


def _members(file: IO[bytes], r: Range) -> Iterator[tuple[int, Iterator[bytes]]]:
    """(source, chunks) of the wanted members of a compressed tar, in one pass."""
    wanted = dict(zip(r.places, r.files, strict=True))
    stream = Chunks(decoded(packing_of(r.path), file))

    def chunks(t: tarfile.TarFile, m: tarfile.TarInfo) -> Iterator[bytes]:
        f, at = t.extractfile(m), m.offset_data
        while data := f.read(PIECE):
            good = data if not stream.error else data[: max(0, stream.good - at)]
            at += len(data)
            if good:
                yield good
            if len(good) < len(data):
                raise stream.error

    with tarfile.open(fileobj=io.BufferedReader(stream), mode="r|") as t:
        for ordinal, m in enumerate(x for x in t if x.isreg()):
            if ordinal in wanted:
                yield wanted.pop(ordinal), chunks(t, m)
            if not wanted:
                return


def read_range(r: Range, store: str = "") -> Iterator[tuple[int, Lines | BaseException]]:
    """(source, its next lines), and the damage met last."""
    system, inner = store_of(r.path, store)
    with system.open_input_file(inner) as file:
        sources = _members(file, r) if r.how == "tar" else iter([(r.files[0], None)])
        at, left = r.files[0], list(r.files)
        try:
            for at, chunks in sources:
                own, after = (chunks, iter(())) if r.how == "tar" else _chunks(file, r)
                for lines in owned(own, after, r.ordinal == 0):
                    yield at, lines
                left.remove(at)
        except (*DAMAGE, OSError) as error:
            if not damaged(error):
                raise
            yield at if at in left else left[0], error


def _said(error: BaseException) -> str:
    return f"{type(error).__name__}: {error}"


@dataclass
class Ranges(InputPartition):
    ranges: list[dict[str, Any]] = field(default_factory=list)
    value: None = None


class LineReader(DataSourceReader):
    """Options: plan (what plan_of() wrote) or path; what: lines, counts (one row a range: file_idx, its ordinal, n) or errors."""

    def __init__(self, options: dict[str, str]):
        self.what, self.fidelity, self.store = options.get("what", "lines"), options.get("byte_fidelity") == "true", options.get("store", "")
        self.options, self.tasks, self.filters = dict(options), int(options.get("tasks", "8")), []
        self.named = "path" in options

    def __getstate__(self) -> dict[str, Any]:
        return {k: v for k, v in self.__dict__.items() if k != "options"}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            known = isinstance(f, (EqualTo, In, StringStartsWith)) and f.attribute in ((("source_path",), ("alias",), ("file_idx",)) if self.named else (("file_idx",),))
            if known and not (isinstance(f, StringStartsWith) and f.attribute == ("file_idx",)):
                self.filters.append(f)
            else:
                yield f

    def _passes(self, i: int, names: tuple[str, str] | None) -> bool:
        row = {"file_idx": i} | ({"source_path": names[0], "alias": names[1]} if names else {})
        for f in self.filters:
            x = row[f.attribute[0]]
            if not (x.startswith(f.value) if isinstance(f, StringStartsWith) else x in f.value if isinstance(f, In) else x == f.value):
                return False
        return True

    def partitions(self) -> list[InputPartition]:
        if self.named:
            listing = list_sources([self.options["path"]], Matcher(json.loads(self.options.get("exclude", "[]"))), json.loads(self.options.get("aliases", "{}")), store=self.store)
            found = ranges(listing, int(self.options.get("split_bytes", SPLIT_BYTES)), int(self.options.get("packed_bytes", PACKED_BYTES)))
            for r in found:
                r.base = r.ordinal * RANGE_STEP
            names = {i: (s.source_path, s.alias) for i, s in enumerate(listing.sources)}
        else:
            found = [Range(**x) for x in json.loads(zlib.decompress(base64.b64decode(self.options["plan"])))]
            names = {}
        kept = []
        for r in found:
            own = [k for k, i in enumerate(r.files) if self._passes(i, names.get(i))]
            if own:
                r.files, r.places = [r.files[k] for k in own], [r.places[k] for k in own] if len(r.places) == len(r.files) else r.places
                kept.append(r)
        return [Ranges([asdict(r) | ({"names": [names[i] for i in r.files]} if names else {}) for r in part]) for part in dealt(kept, self.tasks)] or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for x in partition.ranges:
            names = x.pop("names", None)
            r = Range(**x)
            of = dict(zip(r.files, names, strict=True)) if names else {}
            n: dict[int, int] = {}
            for i, found in read_range(r, self.store):
                at = n.get(i, 0)
                if isinstance(found, Lines):
                    n[i] = at + len(found)
                    if self.what == "lines" and len(found):
                        kinds = found.ends if self.fidelity else np.zeros(len(found), np.int64)
                        eol = pa.array(_ENDS).take(pa.array(kinds))
                        yield self._batch(len(found), i, pa.array(r.base + at + np.arange(len(found))), found.text(), eol, pa.nulls(len(found), pa.string()), of.get(i))
                elif self.what != "counts":
                    yield self._batch(1, i, pa.array([r.base + at]), pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.array([_said(found)]), of.get(i))
            if self.what == "counts":
                yield self._batch(1, r.files[0], pa.array([n.get(r.files[0], 0)]), pa.array([str(r.ordinal)]), pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), of.get(r.files[0]))

    def _batch(self, n: int, i: int, number: pa.Array, line: pa.Array, eol: pa.Array, error: pa.Array, names: tuple[str, str] | None) -> pa.RecordBatch:
        columns = {"file_idx": pa.array(np.full(n, i, np.int32)), "line_no": number, "line": line, "eol": eol, "error": error}
        if self.named:
            columns |= {"source_path": pa.array([names[0]] * n), "alias": pa.array([names[1]] * n)}
        return pa.RecordBatch.from_pydict(columns)


class LineSource(DataSource):
    """spark.read.format("weft_lines").load(folder): lines with source_path and alias; predicates on those choose sources before any is opened."""

    _planned = False

    def __getstate__(self) -> dict[str, Any]:
        """Spark sends a source that has its reader to every task, which has its own ranges and needs no plan of all."""
        kept = {k: v for k, v in self.options.items() if k != "plan"}
        return self.__dict__ | ({"options": kept} if self._planned else {})

    @classmethod
    def name(cls) -> str:
        return "weft_lines"

    def schema(self) -> str:
        return LINES + ERROR + (NAMES if "path" in self.options else "")

    def reader(self, schema: Any) -> LineReader:
        self._planned = True
        return LineReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known; predicates reach Python sources only under this setting."""
    spark.dataSource.register(LineSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def plan_of(found: list[Range]) -> str:
    """Ranges as an option: a few hundred bits each."""
    return base64.b64encode(zlib.compress(json.dumps([asdict(r) for r in found]).encode())).decode()


def _scan(spark: SparkSession, found: list[Range], what: str, store: str, fidelity: bool = False) -> DataFrame:
    register(spark)
    options = {"plan": plan_of(found), "what": what, "store": store, "byte_fidelity": str(fidelity).lower(), "tasks": str(spark.sparkContext.defaultParallelism)}
    return spark.read.format("weft_lines").options(**options).load()


def numbered(spark: SparkSession, found: list[Range], store: str = "", dense: bool = True) -> list[Range]:
    """The ranges with the numbers of their first lines."""
    many = {r.files[0] for r in found if r.ordinal}
    if not dense:
        for r in found:
            r.base = r.ordinal * RANGE_STEP
    elif many:
        counts = {(r["file_idx"], int(r["line"])): r["line_no"] for r in _scan(spark, [r for r in found if r.files[0] in many], "counts", store).collect()}  # a row for each range
        before: dict[int, int] = {}
        for r in found:
            if r.files[0] in many:
                r.base = before.get(r.files[0], 0)
                before[r.files[0]] = r.base + counts[r.files[0], r.ordinal]
    return found


def read_rows(spark: SparkSession, listing: Listing, byte_fidelity: bool = False, dense: bool = True, split: int = SPLIT_BYTES, packed: int = PACKED_BYTES) -> DataFrame:
    """raw_lines of a listing with error: a damaged source's last row has one, and no line. Partitions hold stretches of sources in their order."""
    found = numbered(spark, ranges(listing, split, packed, spark), listing.store, dense)
    return _scan(spark, found, "lines", listing.store, byte_fidelity)


def read_lines(spark: SparkSession, listing: Listing, byte_fidelity: bool = False, dense: bool = True, split: int = SPLIT_BYTES, packed: int = PACKED_BYTES) -> DataFrame:
    """raw_lines of a listing."""
    return read_rows(spark, listing, byte_fidelity, dense, split, packed).where("error IS NULL").drop("error")


def errors_of(rows: DataFrame, listing: Listing) -> DataFrame:
    """path, line_no (the lines read before it) and error of damaged sources: those found on listing, and those met in rows."""
    spark = rows.sparkSession
    listed = spark.createDataFrame([(p, None, e) for p, e in listing.errors], "path string, line_no bigint, error string")
    files = listing.to_df(spark).select("file_idx", F.col("source_path").alias("path"))
    return listed.unionByName(rows.where("error IS NOT NULL").join(files, "file_idx").select("path", "line_no", "error"))


def read_errors(spark: SparkSession, listing: Listing, split: int = SPLIT_BYTES, packed: int = PACKED_BYTES) -> DataFrame:
    """errors_of() all sources, by a reading of their own."""
    return errors_of(_scan(spark, numbered(spark, ranges(listing, split, packed, spark), listing.store), "errors", listing.store), listing)
