"""WARC archives as a Spark data source, written and read.

Reading: files are planned into partitions of about `partition_bytes`; equality, IN, and comparison
predicates on headers are pushed down; a record's header is parsed first, and the block of a record
that a predicate leaves out, or all blocks with the option payload=none, is passed over: by a seek in
plain files and in members that carry their length (the public `sl` extra field of gzip, which the
writer sets), else by inflating without keeping. Options: path (a file or folder), payload (bytes or
none), partition_bytes, damage (fail or row).

A record that isn't whole (cut anywhere, a header without an end or a length, no closing line, a member
that doesn't inflate or whose checksum doesn't hold, a block with another SHA-256 than its header's)
never reads as one. It fails the query with the file and the byte where it begins, or with damage=row is a
row whose column error tells that and whose others are null. The records before it are there, those
behind it are not, as nothing tells where they begin; behind a block whose digest alone is wrong they
are. Of blocks that are passed over only the lengths are checked. Zeros behind the last member are no damage.

Writing: each task writes files of about `file_bytes`, which are a partition's size, one gzip member
for each record, under a name of its own; a commit moves them in and deletes what lost or failed
attempts of the job left, so a repeated task leaves nothing twice. Options: path, file_bytes, compress
(true or false).

Paths are opened by pyarrow.fs: file, hdfs, s3, gs and plain paths.

Null cells are left out of headers; a null payload is an empty one. Ties (equal payloads) are told apart
by page ids, see records_of_pages(). A payload is held as a whole by the task that writes or reads it, in
batches of about 4 MB or one record. Repeated rows are records of their own. An empty table writes no
file, and an empty folder reads as no rows. Columns that are none of the format's are not written, so
names that clash don't matter.
"""

from __future__ import annotations

import hashlib
import operator
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
import pyspark.sql.functions as F
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

from weft.llm.common import redealt, shared_dir

#: Column, header.
HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "profile": "WARC-Profile", "content_type": "Content-Type"}
SCHEMA = ", ".join(f"{c} string" for c in HEADERS) + ", payload_length long, payload binary"
#: A header of our own: the bytes of the full payload, also where a revisit does not hold them.
LENGTH = "X-Payload-Length"
BLOCK = "WARC-Block-Digest"
#: A header is shorter than this.
MOST_HEADER = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PARTITION_BYTES = 64_000_000
FILE_BYTES = PARTITION_BYTES
#: The production parameter: payloads of fewer bytes are never revisits.
LEAST = 100
EPOCH = "1970-01-01T00:00:00Z"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"\w+:", path) else (fs.LocalFileSystem(), path)


def record(headers: dict[str, str], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers.items() if v is not None)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def http_block(payload: bytes, length: int | None = None) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload) if length is None else length}\r\n\r\n".encode() + payload


def member(data: bytes, level: int = 5) -> bytes:
    """A gzip member that carries its lengths."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    size = 10 + 2 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def parse_headers(head: bytes) -> dict[str, str]:
    """Lower-case names. Lines that begin with white space go on from the last."""
    lines = re.sub(rb"\r?\n[ \t]+", b" ", head).splitlines()
    if not lines or not lines[0].startswith(b"WARC/"):
        raise ValueError(f"no WARC record: {head[:40]!r}")
    return {k.strip().lower().decode(): v.strip().decode("utf-8", "replace") for k, _, v in (x.partition(b":") for x in lines[1:] if x)}


class Damage(ValueError):
    """What is wrong with an archive, and at which byte its record (or that record's gzip member) begins."""

    def __init__(self, at: int, what: str):
        super().__init__(f"the record at byte {at} is damaged: {what}")


class Records:
    """The records of a file: header(), then block() or passed(), again and again. Damage is raised where a record isn't whole: cut anywhere, its
    header without an end or a length, without its closing line, a gzip member that doesn't inflate or
    whose checksum doesn't hold. Of what is passed over only the lengths are checked.
    """

    def __init__(self, file: pa.NativeFile, piece: int = 16_384):
        self.file, self.size, self.piece = file, file.size(), piece
        self.held, self.at = bytearray(), 0
        self.start()

    def start(self) -> None:
        self.file.seek(0)

    def more(self) -> bytes:
        """The next decoded bytes; none at the end."""
        return self.file.read(self.piece)

    def place(self) -> int:
        """The byte of the file where what is held begins."""
        return self.file.tell() - len(self.held)

    def jump(self, n: int) -> bool:
        """Passes over n bytes behind what is held, without reading them, if that can be done."""
        if self.file.tell() + n > self.size:
            raise Damage(self.at, "it is cut")
        self.file.seek(self.file.tell() + n)
        return True

    def fill(self, n: int) -> bool:
        while len(self.held) < n:
            data = self.more()
            if not data:
                return False
            self.held += data
        return True

    def take(self, n: int) -> bytes:
        if not self.fill(n):
            raise Damage(self.at, "it is cut")
        data = bytes(memoryview(self.held)[:n])
        del self.held[:n]
        return data

    def skip(self, n: int) -> None:
        if n > len(self.held) and self.jump(n - len(self.held)):
            self.held.clear()
            return
        while n > len(self.held):
            n -= len(self.held)
            self.held.clear()
            if not self.fill(1):
                raise Damage(self.at, "it is cut")
        del self.held[:n]

    def head(self) -> bytes | None:
        """The next header, without its end; None behind the last record."""
        while self.fill(1) and self.held[0] in b"\r\n":
            del self.held[:1]
        if not self.held:
            return None
        self.at, seen = self.place(), 0
        while (end := self.held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(self.held)
            if seen > MOST_HEADER or not self.fill(seen + 1):
                raise Damage(self.at, "its header has no end")
        return self.take(end + 4)[:-4]

    def header(self) -> tuple[dict[str, str], int] | None:
        """The next record's headers and the length of its block; None behind the last record."""
        head = self.head()
        if head is None:
            return None
        try:
            headers = parse_headers(head)
            length = int(headers["content-length"])
        except (KeyError, ValueError):
            length = -1
        if length < 0:
            raise Damage(self.at, "its header is none")
        return headers, length

    def block(self, length: int) -> bytes:
        """The record's block; what closes the record is read and checked too."""
        data = self.take(length)
        if self.take(4) != b"\r\n\r\n":
            raise Damage(self.at, "its closing line is missing")
        self.finish()
        return data

    def passed(self, length: int) -> None:
        """Goes on to the next record."""
        self.skip(length + 4)
        if not self.held and not self.jump(0):
            self.finish()

    def finish(self) -> None:
        """Reads on to where what holds the record ends."""


class _Gzip(Records):
    """The same of gzip members, one for each record or for many; a member that carries its lengths is passed over by a seek."""

    def start(self) -> None:
        self.next, self.member, self.inflate, self.raw = 0, 0, None, b""

    def place(self) -> int:
        return self.member

    def more(self) -> bytes:
        while True:
            if self.inflate is None:
                self.file.seek(self.next)
                self.raw = self.file.read(self.piece)
                while self.raw and not self.raw.strip(b"\0"):  # padding
                    self.next += len(self.raw)
                    self.raw = self.file.read(self.piece)
                if not self.raw:
                    return b""
                self.member, self.inflate, self.lengths, self.given = self.next, zlib.decompressobj(31), None, 0
                if len(self.raw) > 24 and self.raw[:3] == b"\x1f\x8b\x08" and self.raw[3] & 4 and self.raw[12:16] == b"sl\x08\0":
                    self.lengths = struct.unpack("<II", self.raw[16:24])
            if out := self.step():
                return out

    def step(self) -> bytes:
        """The next bytes of the member, which may be none; it is left at its end."""
        if not self.raw:
            self.raw = self.file.read(self.piece)
            if not self.raw:
                raise Damage(self.member, "it is cut")
        try:
            out = self.inflate.decompress(self.raw, 1 << 20)
        except zlib.error as error:
            raise Damage(self.member, str(error)) from error
        self.raw = self.inflate.unconsumed_tail
        self.given += len(out)
        if self.inflate.eof:
            self.next, self.inflate = self.file.tell() - len(self.inflate.unused_data), None
        return out

    def finish(self) -> None:
        while self.inflate is not None and not self.held:
            self.held += self.step()

    def jump(self, n: int) -> bool:
        if self.inflate is None:
            return n == 0
        if not self.lengths or self.given + n != self.lengths[1]:
            return False
        if self.member + self.lengths[0] > self.size:
            raise Damage(self.member, "it is cut")
        self.next, self.inflate = self.member + self.lengths[0], None
        return True


def digest_holds(headers: dict[str, str], block: bytes) -> bool:
    """Whether a block has the SHA-256 that its header tells, if it tells one."""
    named, _, want = headers.get("warc-block-digest", "").partition(":")
    return named.lower() != "sha256" or hashlib.sha256(block).hexdigest() == want.lower()


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    """What follows the HTTP header, or the whole block of other types."""
    if headers.get("content-type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


_TESTS: dict[type, Callable[[Any, Any], bool]] = {
    EqualTo: operator.eq, EqualNullSafe: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le,
    In: lambda x, values: x in values, StringContains: lambda x, v: v in x, StringStartsWith: str.startswith, StringEndsWith: str.endswith,
}


def passes(f: Filter, row: dict[str, Any]) -> bool | None:
    """A pushed predicate of a header's columns; None is SQL's null."""
    if isinstance(f, Not):
        got = passes(f.child, row)
        return None if got is None else not got
    value = row.get(f.attribute[0])
    if isinstance(f, IsNull | IsNotNull):
        return (value is None) == isinstance(f, IsNull)
    if isinstance(f, EqualNullSafe):
        return value == f.value
    return None if value is None else bool(_TESTS[type(f)](value, f.value))


def known(f: Filter) -> bool:
    inner = f.child if isinstance(f, Not) else f
    return isinstance(inner, (*_TESTS, IsNull, IsNotNull)) and len(inner.attribute) == 1 and inner.attribute[0] in {*HEADERS, "payload_length"}


@dataclass
class Files(InputPartition):
    paths: list[str] = field(default_factory=list)
    value: None = None


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.payload = options.get("payload", "bytes") != "none"
        self.keep = options.get("damage", "fail") == "row"
        self.size = int(options.get("partition_bytes", PARTITION_BYTES))
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if known(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """Files in order of their names, joined up to the size of a partition."""
        store, path = _open(self.path)
        info = store.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, recursive=True))
        out, room = [], 0
        for x in sorted((x for x in found if x.type == fs.FileType.File and re.search(r"\.warc(\.gz)?$", x.path)), key=lambda x: x.path):
            if not out or room < x.size:
                out.append(Files([]))
                room = self.size
            out[-1].paths.append(x.path)
            room -= x.size
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = _open(self.path)
        rows: list[tuple] = []
        held = 0
        for path in partition.paths:
            with store.open_input_file(path) as file:
                for row, data, error in self._rows((_Gzip if path.endswith(".gz") else Records)(file)):
                    if error and not self.keep:
                        raise ValueError(f"{path}: {error}") from error
                    rows.append((*row.values(), data, error and f"{path}: {error}"))
                    held += len(data or b"") + 500
                    if held > 4_000_000:
                        yield self._batch(rows)
                        rows, held = [], 0
        yield self._batch(rows)

    def _rows(self, records: Records) -> Iterator[tuple[dict[str, Any], bytes | None, Damage | None]]:
        """(columns of the header, payload, damage) of the records that pass, each when it has been checked."""
        nothing = dict.fromkeys([*HEADERS, "payload_length"])
        try:
            while (found := records.header()) is not None:
                headers, length = found
                own = headers.get(LENGTH.lower())
                row = {c: headers.get(h.lower()) for c, h in HEADERS.items()} | {"payload_length": int(own) if own and own.isdigit() else None}
                wanted = all(passes(f, row) for f in self.filters)
                if not wanted or not self.payload:
                    records.passed(length)
                    if wanted:
                        yield row, None, None
                    continue
                block = records.block(length)
                if digest_holds(headers, block):
                    yield row, payload_of(headers, block), None
                else:
                    yield nothing, None, Damage(records.at, "its block has another digest")
        except Damage as error:
            yield nothing, None, error

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = [*[pa.string()] * len(HEADERS), pa.int64(), pa.binary(), pa.string()]
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        names = [*HEADERS, "payload_length", "payload", "error"]
        k = len(kinds) if self.keep else len(kinds) - 1
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns[:k], kinds[:k], strict=True)], names=names[:k])


@dataclass
class Written(WriterCommitMessage):
    names: list[tuple[str, str]]


class WarcWriter(DataSourceArrowWriter):
    """Rows of the reader's columns; what is null is left out of the header."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.gzip = options.get("compress", "true") != "false"
        self.size = int(options.get("file_bytes", FILE_BYTES))
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, folder = _open(self.path)
        store.create_dir(folder, recursive=True)
        names, file, room = [], None, 0
        for b in iterator:
            for row in b.to_pylist():
                data = self.encode(row)
                if file is None or room < len(data):
                    if file:
                        file.close()
                    name = f"part-{self.job}-{uuid.uuid4().hex}.warc" + (".gz" if self.gzip else "")
                    names.append((f"{folder}/{name}.open", f"{folder}/{name}"))
                    file, room = store.open_output_stream(names[-1][0]), self.size
                    info = record({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": EPOCH, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n")
                    file.write(member(info) if self.gzip else info)
                file.write(data)
                room -= len(data)
        if file:
            file.close()
        return Written(names)

    def encode(self, row: dict[str, Any]) -> bytes:
        payload = row.get("payload") or b""
        headers = {h: row.get(c) for c, h in HEADERS.items()} | {LENGTH: row.get("payload_length")}
        revisit = row.get("record_type") == "revisit"
        block = http_block(b"" if revisit else payload, row.get("payload_length")) if (row.get("content_type") or "").startswith("application/http") else payload
        if not self.gzip:  # members have checksums
            headers[BLOCK] = f"sha256:{hashlib.sha256(block).hexdigest()}"
        data = record(headers, block)
        return member(data) if self.gzip else data

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = _open(self.path)
        store.create_dir(folder, recursive=True)
        for m in messages:
            for now, then in m.names if m else ():
                store.move(now, then)
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        """Deletes the job's files that no commit moved in."""
        store, folder = _open(self.path)
        for x in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if x.base_name.startswith(f"part-{self.job}-") and x.base_name.endswith(".open"):
                store.delete_file(x.path)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA + (", error string" if self.options.get("damage") == "row" else "")

    def reader(self, schema: Any) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema: Any, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known; predicates reach Python sources only under this setting."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def records_of_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST) -> DataFrame:
    """The WARC record of each page. Of equal payloads of at least `least` bytes the one of the smallest page id is the response.

    A null html is an empty payload; null and repeated page ids are records of their own, and a null
    id is larger than any other. Of rows with the same smallest id one payload, all are responses.
    """
    payload = F.encode(F.coalesce(html, F.lit("")), "UTF-8")
    rows = pages.select(F.col(page_id).cast("long").alias("_id"), F.col(url).alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumn("_digest", F.sha2("payload", 256)).withColumn("payload_length", F.octet_length("payload").cast("long"))
    first = rows.select("_id", "_digest", "payload_length").where(F.col("payload_length") >= least).groupBy("_digest").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    joined = rows.join(redealt(first), "_digest", "left")
    revisit = F.coalesce(F.col("_first").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_first")), F.lit(False))

    def name(c: Column) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))

    return joined.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), name(F.col("_id")).alias("record_id"), F.regexp_replace("target_uri", r"[\r\n]", "").alias("target_uri"), F.lit(EPOCH).alias("date"),
        F.concat(F.lit("sha256:"), F.col("_digest")).alias("payload_digest"), F.when(revisit, name(F.col("_first"))).alias("refers_to"), F.when(revisit, PROFILE).alias("profile"),
        F.lit("application/http; msgtype=response").alias("content_type"), "payload_length", F.when(~revisit, F.col("payload")).alias("payload"),
    )


def write_pages(pages: DataFrame, path: str | None = None, **columns: str) -> str:
    """Writes a record for each page; the folder."""
    spark = pages.sparkSession
    register(spark)
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    records_of_pages(pages, **columns).write.format("warc").mode("append").save(path)
    return path


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each record of write_pages()."""
    register(spark)
    source = spark.read.format("warc")
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    responses = source.load(path).where("record_type = 'response'").select("record_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", "refers_to")
    revisits = source.option("payload", "none").load(path).where("record_type = 'revisit'").select("record_id", F.col("payload_length").alias("payload_bytes"), F.regexp_replace("payload_digest", "^sha256:", "").alias("payload_digest"), "record_type", "refers_to")
    return responses.unionByName(revisits).select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))
