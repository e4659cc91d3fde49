"""The catalogue of sources: files of folders, members of archives, in a defined order.

Folders are listed level by level, and archives are indexed, in Spark tasks: of a zip its central
directory is read, of a plain tar its headers, passing over what is between, and compressed tars are
inflated where the task runs. The driver holds one entry for each source, as Spark's own file index does.
"""

from __future__ import annotations

import io
import pickle
import posixpath
import tarfile
import zipfile
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from weft.sources.codecs import DAMAGE, Chunks, decoded
from weft.sources.match import Matcher, alias_of
from weft.sources.stores import Entry, entries, entry, everywhere, store_of, unreadable

FILES = "file_idx int, source_path string, container_path string, alias string, size bigint, kind string"
# Archive kinds by extension; the double ones come first.
KINDS = {".tar.gz": "tar", ".tgz": "tar", ".tar.bz2": "tar", ".tbz2": "tar", ".tar.xz": "tar", ".txz": "tar", ".tar": "tar", ".zip": "zip", ".gz": "gz", ".bz2": "bz2", ".xz": "xz"}
MEMBER = "!/"
#: So many folders of a level, or files to be tried, are looked at in tasks; fewer on the driver.
SPREAD = 32


@dataclass
class Source:
    source_path: str
    container_path: str
    alias: str
    size: int
    kind: str
    #: The place among the regular members of its archive: names may repeat.
    ordinal: int = 0
    #: Of members that are read by their place: where they stand, their packed size, how a zip packs them, and their checksum.
    at: int = -1
    packed: int = 0
    method: int = 0
    crc: int = 0
    modified: int = 0


@dataclass
class Listing:
    sources: list[Source] = field(default_factory=list)
    errors: list[tuple[str, str]] = field(default_factory=list)
    dirs_scanned: int = 0
    files_scanned: int = 0
    store: str = ""

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, s.source_path, s.container_path, s.alias, s.size, s.kind) for i, s in enumerate(self.sources)], FILES)

    def modified(self, spark: SparkSession) -> DataFrame:
        """file_idx and modified: nanoseconds since 1970 of the file that holds a source."""
        return spark.createDataFrame([(i, s.modified) for i, s in enumerate(self.sources)], "file_idx int, modified bigint")


def kind_of(path: str) -> str:
    return next((k for x, k in KINDS.items() if path.lower().endswith(x)), "plain")


def packing_of(path: str) -> str:
    """How a tar is compressed: gz, bz2, xz or plain."""
    return next((p for p, ends in {"gz": ("gz",), "bz2": ("bz2",), "xz": ("xz",)}.items() if path.lower().endswith(ends)), "plain")


def spread(spark: SparkSession | None, f: Callable[[Any], Any], items: list, least: int = SPREAD) -> list:
    """f of each item, in tasks if there are enough of them."""
    if spark is None or len(items) < max(1, least):
        return [f(x) for x in items]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, x in zip(b["i"].to_pylist(), b["x"].to_pylist(), strict=True):
                yield pa.RecordBatch.from_pydict({"i": pa.array([i], pa.int64()), "x": pa.array([pickle.dumps(f(pickle.loads(x)))], pa.binary())})

    rows = spark.createDataFrame([(i, pickle.dumps(x)) for i, x in enumerate(items)], "i long, x binary")
    found = rows.repartition(min(len(items), 4 * spark.sparkContext.defaultParallelism)).mapInArrow(run, "i long, x binary").collect()
    return [pickle.loads(r["x"]) for r in sorted(found)]


def _walk(root: str, follow: bool, store: str, spark: SparkSession | None, found: Listing) -> list[Entry]:
    """Files under a folder, by the names on their ways. Linked folders count only with follow, and each real folder once."""
    level, files, seen = [entry(root, store)], [], set()
    while level:
        new = [f for f in level if f.real not in seen and not seen.add(f.real)]
        found.dirs_scanned += len(new)
        level = []
        for e in (e for own in spread(spark, lambda p: entries(p, store), [f.path for f in new]) for e in own):
            if e.kind == "broken":
                found.errors.append((e.path, "broken link"))
            elif e.kind == "dir":
                level += [e] if follow or not e.link else []
            else:
                files.append(e)
        level.sort(key=lambda e: e.path.split("/"))
    return sorted(files, key=lambda e: e.path.split("/"))


def members(path: str, kind: str, store: str = "") -> tuple[list[tuple], str | None]:
    """(name, size, place, packed size, method, checksum) of an archive's regular members, and what kept the list from its end."""
    system, inner = store_of(path, store)
    out: list[tuple] = []
    try:
        with system.open_input_file(inner) as file:
            if kind == "zip":
                with zipfile.ZipFile(file) as z:
                    out = [(m.filename, m.file_size, -1 if m.flag_bits & 1 else m.header_offset, m.compress_size, m.compress_type, m.CRC) for m in z.infolist() if not m.is_dir()]
            elif packing_of(path) == "plain":
                with tarfile.open(fileobj=file, mode="r:") as t:
                    for m in t:
                        if m.isreg():
                            out.append((m.name, m.size, -1 if m.sparse is not None else m.offset_data, m.size, 0, 0))
            else:
                stream = Chunks(decoded(packing_of(path), file))
                with tarfile.open(fileobj=io.BufferedReader(stream), mode="r|") as t:
                    for m in t:
                        if m.isreg() and not (stream.error and m.offset >= stream.good):
                            out.append((m.name, m.size, -1, 0, 0, 0))
                if stream.error:
                    return out, str(stream.error)
    except DAMAGE as error:
        return out, str(error)
    return out, None


def list_sources(inputs: Iterable[str], matcher: Matcher | None = None, aliases: Mapping[str, str] | None = None, follow_symlinks: bool = False, store: str = "", spark: SparkSession | None = None) -> Listing:
    """All included sources under the inputs. A missing input, or none included, is an error; a file that can't be opened is noted and left out.

    Of a damaged archive the members before the damage are sources.
    """
    matcher, aliases, found = matcher or Matcher(), aliases or {}, Listing(store=store)
    spark = spark or SparkSession.getActiveSession()
    inputs = list(inputs)
    files: list[tuple[str, Entry, str]] = []
    for root in inputs:
        top = entry(root, store)
        if top.kind in ("missing", "broken"):
            raise FileNotFoundError(root)
        own = _walk(root, follow_symlinks, store, spark, found) if top.kind == "dir" else [top]
        base = root if top.kind == "dir" else posixpath.dirname(root)
        found.files_scanned += len(own)
        files += [(root, e, relative) for e in own if matcher.includes(e.path, relative := posixpath.relpath(e.path, base or "."))]
    where = {e.path: everywhere(e.path, store) for _, e, _ in files}
    closed = dict(zip(where, spread(spark, lambda p: unreadable(p, store), list(where.values())), strict=True))
    archives = [p for p in where if kind_of(p) in ("zip", "tar") and closed[p] is None]
    index = dict(zip(archives, spread(spark, lambda p: members(p, kind_of(p), store), [where[p] for p in archives], 1), strict=True))
    for root, e, relative in files:
        kind = kind_of(e.path)
        if closed[e.path] is not None:
            found.errors.append((e.path, closed[e.path]))
        elif kind in ("zip", "tar"):
            own, damage = index[e.path]
            for ordinal, (name, size, *place) in enumerate(own):
                member = f"{e.path}{MEMBER}{name}"
                if matcher.includes(member, f"{relative}{MEMBER}{name}"):
                    found.sources.append(Source(member, e.path, alias_of(member, root, aliases), size, kind, ordinal, *place, modified=e.modified))
            if damage is not None:
                found.errors.append((e.path, damage))
        else:
            found.sources.append(Source(e.path, e.path, alias_of(e.path, root, aliases), e.size, kind, modified=e.modified))
    if not found.sources:
        raise FileNotFoundError(f"no files to merge in {', '.join(inputs)}")
    return found
