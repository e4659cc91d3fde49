"""File rules in the manner of gitignore, and aliases. Both run on the driver, over the file listing."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import cache

from weft.sources.stores import store_of

# What --ignore-archives excludes.
ARCHIVES = ("*.zip", "*.tar", "*.gz", "*.rar", "*.7z", "*.tgz", "*.bz2", "*.tbz2", "*.xz", "*.txz")


@cache
def glob_pattern(glob: str) -> re.Pattern | None:
    """A glob (* ? [..] and backslash, none crossing a slash) as a regular expression; None if it is malformed."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "\\":
            i += 1
            if i == len(glob):
                return None
            out += re.escape(glob[i])
        elif c == "[":
            m = re.match(r"\[(\^?)((?:\\.|[^\\\]])+)\]", glob[i:])
            if not m:
                return None
            members = re.findall(r"(\\.|[^\\])(?:-(\\.|[^\\]))?", m[2])
            parts = [re.escape(a[-1]) + (f"-{re.escape(b[-1])}" if b else "") for a, b in members]
            if any(b and a[-1] > b[-1] for a, b in members):
                return None
            out += ("(?!/)" if m[1] else "") + f"[{m[1]}{''.join(parts)}]"
            i += m.end() - 1
        else:
            out += re.escape(c)
        i += 1
    return re.compile(out, re.S)


def glob_match(glob: str, text: str) -> bool:
    pattern = glob_pattern(glob)
    return bool(pattern and pattern.fullmatch(text))


def _segments_match(rule: tuple[str, ...], path: tuple[str, ...]) -> bool:
    """`**` stands for any number of segments; at the end of a rule, for one at least."""
    if not rule:
        return not path
    if rule[0] != "**":
        return bool(path) and glob_match(rule[0], path[0]) and _segments_match(rule[1:], path[1:])
    rest = rule[1:]
    if all(x == "**" for x in rest):
        return bool(path)
    return any(_segments_match(rest, path[k:]) for k in range(len(path) + 1))


@dataclass(frozen=True)
class Rule:
    pattern: str
    include: bool
    at_root: bool

    @classmethod
    def parse(cls, text: str) -> Rule | None:
        text = re.sub(r"[ \t]+$", "", text)
        if text.endswith("\\"):
            text += " "
        if not text or text[0] == "#":
            return None
        include = text[0] == "!"
        text = text[1:] if include or text[:2] in ("\\#", "\\!") else text
        at_root = text[:1] == "/"
        text = text[at_root:]
        return cls(text, include, at_root) if text else None

    def matches(self, path: str) -> bool:
        if "**" in self.pattern and ("/" in self.pattern or self.at_root):
            return _segments_match(tuple(filter(None, self.pattern.split("/"))), tuple(filter(None, path.split("/"))))
        if self.at_root:
            return glob_match(self.pattern, path)
        if "/" not in self.pattern:
            return glob_match(self.pattern, path.rpartition("/")[2])
        return any(glob_match(self.pattern, path[k:]) for k in [0, *(m.end() for m in re.finditer("/", path))])


class Matcher:
    """Ordered rules: the last one that matches decides, and what none matches is included.

    Root-only rules look at the path relative to its input; with strict_reference at the path as walked.
    """

    def __init__(self, patterns: Iterable[str] = (), strict_reference: bool = False):
        self.rules = [r for r in map(Rule.parse, patterns) if r]
        self.strict_reference = strict_reference

    def includes(self, path: str, relative: str | None = None) -> bool:
        path = path.replace("\\", "/")
        for r in reversed(self.rules):
            if r.matches(relative if r.at_root and relative is not None and not self.strict_reference else path):
                return r.include
        return True


def alias_of(path: str, root: str, aliases: Mapping[str, str]) -> str:
    """The name shown for a path: by the first alias pattern that matches the path or its last part, else the path relative to its input (or an alias of that)."""
    for glob, name in aliases.items():
        if glob_match(glob, path) or glob_match(glob, path.rpartition("/")[2]):
            return name
    relative = posixpath.relpath(path, root or ".")
    if relative == ".":
        relative = posixpath.basename(path)
    return aliases.get(relative, relative)


def read_ignore_file(path: str, store: str = "") -> list[str]:
    """The rules of a file in any store, without blank lines and comments."""
    system, inner = store_of(path, store)
    with system.open_input_file(inner) as f:
        lines = f.read().decode("utf-8").split("\n")
    return [x for x in map(str.strip, lines) if x and not x.startswith("#")]
