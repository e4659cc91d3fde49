"""File rules and aliases as expressions over a path column, for catalogues that are tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

import pyspark.sql.functions as F
from pyspark.sql import Column

from weft.sources.match import Rule, glob_pattern

_NEVER = "(?!)"


def _java(glob: str) -> str:
    pattern = glob_pattern(glob)
    return pattern.pattern if pattern else _NEVER


def rule_regex(rule: Rule) -> str:
    """A regular expression for the paths that a rule matches."""
    if "**" in rule.pattern and ("/" in rule.pattern or rule.at_root):
        parts = [x for x in rule.pattern.split("/") if x]
        while len(parts) > 1 and parts[-1] == parts[-2] == "**":
            parts.pop()
        body = "".join("(?:[^/]+/)*" if x == "**" else _java(x) + ("/" if k < len(parts) - 1 else "") for k, x in enumerate(parts[:-1]))
        return f"^/?{body}{'[^/]+(?:/[^/]+)*' if parts[-1] == '**' else _java(parts[-1])}$"
    if rule.at_root:
        return f"^{_java(rule.pattern)}$"
    return f"(?:^|/){_java(rule.pattern)}$"


def includes(path: Column, patterns: Iterable[str]) -> Column:
    """Whether the ordered rules include a path: the last that matches decides, and what none matches is included."""
    out: Column | None = None
    for rule in reversed([r for r in map(Rule.parse, patterns) if r]):
        hit = path.rlike(rule_regex(rule))
        out = F.when(hit, rule.include) if out is None else out.when(hit, rule.include)
    return F.lit(True) if out is None else out.otherwise(True)


def alias(path: Column, aliases: Mapping[str, str]) -> Column:
    """The first alias whose glob matches the path or its last part; else the path."""
    out: Column | None = None
    for glob, name in aliases.items():
        hit = path.rlike(f"^(?:.*/)?{_java(glob)}$" if "/" not in glob else f"^{_java(glob)}$")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return path if out is None else out.otherwise(path)
