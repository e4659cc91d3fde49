"""Licence detection by ordered signature rules.

A whole text is normalised in bytes: A-Z in lower case, words apart by one space. A rule is a regular
expression with a label and a priority; it is tried only if the text holds its keyword, the longest
plain stretch of its pattern, and one automaton finds all keywords. All matches are intervals of words. In order of priority,
then length, then rule order, a detection is kept unless an interval kept already contains it or it
overlaps one of higher priority; detections of one priority that overlap in part all stay. Base phrases are counted apart, and their labels always stay.

Null and empty texts have no words and no labels, and score 0. Texts of any length are scanned whole, in
time that grows with the text and its matches. Repeated rows give repeated results, an empty table an empty one.
Extra columns pass through; columns named as results are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from weft.llm.common import as_bytes, slices
from weft.llm.license_rules import LINES

#: The base phrases and labels.
BASE = {b"mit license": "mit", b"apache license": "apache", b"general public license": "gpl"}
#: A-Z to a-z; what is neither 0-9, a-z nor beyond ASCII to a space.
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
DETECTIONS = "detections array<struct<label:string,first_word:long,end_word:long,priority:int>>"


@dataclass(frozen=True)
class Rule:
    order: int
    label: str
    priority: int
    keyword: str
    pattern: re.Pattern


def rules(lines: str = LINES) -> list[Rule]:
    """One rule for each pattern."""
    out: list[Rule] = []
    for line in filter(None, map(str.strip, lines.splitlines())):
        label, priority, patterns = (x.strip() for x in line.split(" | ", 2))
        for p in patterns.split(" ; "):
            out.append(Rule(len(out), label, int(priority), literal(p.strip()), re.compile(rf"(?<![^ ])(?:{p.strip()})(?![^ ])".encode())))
    return out


def literal(pattern: str) -> str:
    """The longest stretch of plain characters that every match holds."""
    while (plain := re.sub(r"\([^()]*\)\??|\[[^\]]*\]|\.\{[^}]*\}\??|[^\0]\?", "\0", pattern)) != pattern:
        pattern = plain
    return max(pattern.split("\0"), key=len).strip()


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_NORMAL).split()


class Scanner:
    def __init__(self, found: list[Rule] | None = None, base: dict[bytes, str] | None = None):
        self.base = BASE if base is None else base
        by: dict[str, list[Rule]] = {}
        for r in rules() if found is None else found:
            by.setdefault(r.keyword, []).append(r)
        self.keywords = ahocorasick.Automaton()
        for keyword, own in by.items():
            self.keywords.add_word(keyword, own)
        self.keywords.make_automaton()

    def detections(self, text: bytes) -> list[tuple[int, int, Rule]]:
        """(first byte, end, rule) of what stays, by place. text: normal words apart by one space."""
        tried = {r.order: r for _, own in self.keywords.iter(text.decode("latin-1")) for r in own}
        found = [(m.start(), m.end(), r) for r in tried.values() for m in r.pattern.finditer(text)]
        found.sort(key=lambda x: (-x[2].priority, x[0] - x[1], x[2].order, x[0]))
        kept: list[tuple[int, int, Rule]] = []
        taken = _Intervals()
        for x in found:
            if taken.add(x[0], x[1], x[2].priority):
                kept.append(x)
        return sorted(kept, key=lambda x: x[:2])

    def scan(self, text: bytes | None) -> tuple[tuple, list[dict]]:
        found = words(text)
        norm = b" ".join(found)
        framed = b" " + norm + b" "
        places: list[int] = []
        base = set()
        for phrase, label in self.base.items():
            at = framed.find(b" " + phrase + b" ")
            while at >= 0:
                places.append(at)
                base.add(label)
                at = framed.find(b" " + phrase + b" ", at + 1)
        kept = self.detections(norm)
        starts = _word_numbers(norm, sorted({*places, *(x[0] for x in kept), *(x[1] for x in kept)}))
        labels = base | {x[2].label for x in kept}
        score = max([0.0, *(x[2].priority / 100 for x in kept), *([0.5] if base else [])])
        spans = [{"label": r.label, "first_word": starts[a], "end_word": starts[b] + 1, "priority": r.priority} for a, b, r in kept]
        first, last = (starts[min(places)], starts[max(places)]) if places else (None, None)
        return (len(found), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score), spans


class _Intervals:
    """Kept intervals, none in another, so sorted by their starts and by their ends."""

    def __init__(self) -> None:
        self.at: list[int] = []
        self.to: list[int] = []
        self.priority: list[int] = []

    def add(self, start: int, end: int, priority: int) -> bool:
        """Whether no kept interval contains this one or overlaps it with higher priority, and so it was kept. They come by priority, then length."""
        from bisect import bisect_left, bisect_right

        for k in range(bisect_right(self.to, start), bisect_left(self.at, end)):
            if self.priority[k] > priority or (self.at[k] <= start and end <= self.to[k]):
                return False
        k = bisect_left(self.at, start)
        self.at.insert(k, start)
        self.to.insert(k, end)
        self.priority.insert(k, priority)
        return True


def _word_numbers(norm: bytes, at: list[int]) -> dict[int, int]:
    """The number of the word at each byte."""
    out, last, n = {}, 0, 0
    for x in at:
        n += norm.count(b" ", last, x)
        out[x], last = n, x
    return out


def scan_licenses(df: DataFrame, text: str = "text", detections: bool = True) -> DataFrame:
    """df with n_words, n_base, first_word, last_word, base_labels, labels and score of each text, and the kept detections."""
    fields = T._parse_datatype_string(RESULT + (f", {DETECTIONS}" if detections else "")).fields
    kept = [c for c in df.columns if c not in {f.name for f in fields}]
    needed = [*kept, *([text] if text not in kept else [])]
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
    spans = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("priority", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for b in slices(batches, text):
            rows, found = zip(*map(scanner.scan, as_bytes(b[text])), strict=True)
            out = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in kept), *out, *([pa.array(found, spans)] if detections else [])], names=[*kept, *(f.name for f in fields)])

    return df.select(*needed).mapInArrow(run, T.StructType([*(df.schema[c] for c in kept), *fields]))
