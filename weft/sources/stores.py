"""Files in any store: local paths, URIs that pyarrow opens (file, hdfs, s3, gs, abfs), or a store of one's own.

A store of one's own is named "module:function"; the function takes a path and returns a
pyarrow.fs.FileSystem and the path in it. Tasks import it, so it must be on their path.
"""

from __future__ import annotations

import importlib
import os
import re
from dataclasses import dataclass

from pyarrow import fs


def store_of(path: str, store: str = "") -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    if store:
        module, _, name = store.partition(":")
        return getattr(importlib.import_module(module), name)(path)
    if local := re.match(r"file:/*(?=/)", path):
        return fs.LocalFileSystem(), path[local.end() :]
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", path):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def everywhere(path: str, store: str = "") -> str:
    """A path that means the same in every task."""
    return path if store or re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", path) else os.path.abspath(path)


@dataclass(frozen=True)
class Entry:
    """What a path is: file, dir, broken (a link to nothing) or missing. Only local stores have links; real tells folders apart."""

    path: str
    kind: str
    size: int = 0
    link: bool = False
    real: str = ""
    #: Nanoseconds since 1970 of the last modification.
    modified: int = 0


def _entry(path: str, info: fs.FileInfo, local: bool) -> Entry:
    link = local and os.path.islink(info.path)
    kind = {fs.FileType.File: "file", fs.FileType.Unknown: "file", fs.FileType.Directory: "dir"}.get(info.type, "broken" if link else "missing")
    return Entry(path, kind, info.size or 0, link, os.path.realpath(info.path) if local else info.path, info.mtime_ns or 0)


def entry(path: str, store: str = "") -> Entry:
    system, inner = store_of(path, store)
    return _entry(path, system.get_file_info(inner), isinstance(system, fs.LocalFileSystem))


def entries(folder: str, store: str = "") -> list[Entry]:
    """What is in a folder, by name."""
    system, inner = store_of(folder, store)
    local = isinstance(system, fs.LocalFileSystem)
    # a selector leaves out links to nothing, which only local stores have
    found = system.get_file_info([f"{inner.rstrip('/')}/{x}" for x in os.listdir(inner)] if local else fs.FileSelector(inner))
    return [_entry(f"{folder.rstrip('/')}/{x.base_name}", x, local) for x in sorted(found, key=lambda x: x.base_name)]


def unreadable(path: str, store: str = "") -> str | None:
    """Why a file can't be opened."""
    system, inner = store_of(path, store)
    try:
        system.open_input_file(inner).close()
    except OSError as error:
        return str(error)
    return None
