"""Growing files as a stream: the data source `weft_tail`.

An offset tells for each file how many bytes of it were read, which is behind a complete line: a line
that is still being written waits. A file is known by its place in the store (its inode where there is
one, so a renamed file goes on where it was, else its path) and by its first line, so a file that was
truncated and written anew is another. What is new in a file is cut in byte ranges, which are dealt to tasks by their bytes,
so many small files are few tasks; nothing is read
on the driver but first lines and the ends of files that grew. Offsets have an entry for each file that is there.

Options: path (a folder or file), store, split_bytes, tasks (to deal what is new to at least, if it is enough). A batch takes all that is new, as Spark asks Python sources for no less.
Rows: source (what the file is known by), path, line_no (grows along the file, not dense), line, eol.
A file that goes before it was read is left out; compressed files and archives don't grow and are not read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from weft.sources.codecs import raw
from weft.sources.listing import Listing, _walk, kind_of
from weft.sources.scan import _ENDS, SPLIT_BYTES, dealt, owned
from weft.sources.stores import entry, everywhere, store_of

SCHEMA = "source string, path string, line_no bigint, line string, eol string"
TAIL = 1 << 16


def _first_line(file: pa.NativeFile) -> bytes | None:
    """The first line, or its first 4096 bytes; None while it has no end."""
    file.seek(0)
    data = file.read(4096)
    end = data.find(b"\n")
    return data[: end + 1] if end >= 0 else data if len(data) == 4096 else None


def complete(file: pa.NativeFile, size: int, least: int = 0) -> int:
    """Where the last complete line in the first `size` bytes ends; `least` if none ends behind that."""
    end = size
    while end > least:
        start = max(least, end - TAIL)
        file.seek(start)
        at = file.read(end - start).rfind(b"\n")
        if at >= 0:
            return start + at + 1
        end = start
    return least


@dataclass
class Stretch:
    source: str
    path: str
    start: int
    end: int
    low: int
    high: int

    def cost(self) -> int:
        return self.end - self.start + 4096


@dataclass
class Stretches(InputPartition):
    stretches: list[Stretch] = field(default_factory=list)
    value: None = None


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.store = options["path"], options.get("store", "")
        self.split, self.tasks = int(options.get("split_bytes", SPLIT_BYTES)), int(options.get("tasks", "8"))
        #: Offsets that were handed out last, so that of files that didn't grow no end is looked for.
        self.known: dict[str, dict[str, Any]] = {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        found: dict[str, dict[str, Any]] = {}
        top = entry(self.path, self.store)
        for e in _walk(self.path, False, self.store, None, Listing()) if top.kind == "dir" else [top]:
            if e.kind != "file" or kind_of(e.path) != "plain":
                continue
            system, inner = store_of(e.path, self.store)
            try:
                with system.open_input_file(inner) as file:
                    size, first = file.size(), _first_line(file)
                    if first is None:
                        continue
                    place = str(os.stat(inner).st_ino) if isinstance(system, fs.LocalFileSystem) else e.path
                    source = f"{place}-{zlib.crc32(first):08x}"
                    own = self.known.get(source, {}).get("at", 0)
                    at = complete(file, size, own if own <= size else 0)
            except FileNotFoundError:
                continue
            found[source] = {"path": everywhere(e.path, self.store), "at": at}
        self.known = found
        return found

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out: list[Stretch] = []
        for source, now in end.items():
            low = start.get(source, {}).get("at", 0)
            low, high = (low if low <= now["at"] else 0), now["at"]
            out += [Stretch(source, now["path"], a, min(a + self.split, high), low, high) for a in range(low, high, self.split)]
        return [Stretches(part) for part in dealt(out, self.tasks)]

    def read(self, partition: Stretches) -> Iterator[pa.RecordBatch]:
        for r in partition.stretches:
            yield from self._lines(r)

    def _lines(self, r: Stretch) -> Iterator[pa.RecordBatch]:
        system, inner = store_of(r.path, self.store)
        try:
            file = system.open_input_file(inner)
        except FileNotFoundError:
            return
        with file:
            n = 0
            for lines in owned(raw(file, r.start, r.end), raw(file, r.end, r.high), r.start == r.low):
                many = len(lines)
                # a line takes a byte at least, so numbers from the range's first byte on are its own
                yield pa.RecordBatch.from_pydict({"source": pa.array([r.source] * many), "path": pa.array([r.path] * many), "line_no": pa.array(r.start + n + np.arange(many)), "line": lines.text(), "eol": pa.array(_ENDS).take(pa.array(lines.ends))})
                n += many

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "weft_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: Any) -> TailReader:  # noqa: N802
        return TailReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TailSource)
