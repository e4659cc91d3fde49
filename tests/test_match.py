"""File rules and aliases, on the driver and as expressions, against a small matcher of one character at a time."""

import random

import pytest
from pyspark.sql import functions as F

from weft.functions import paths
from weft.sources.match import Matcher, alias_of


def glob(pattern, text):
    """*, ? and one-character classes, none crossing a slash."""
    if not pattern:
        return not text
    if pattern[0] == "*":
        return glob(pattern[1:], text) or (bool(text) and text[0] != "/" and glob(pattern, text[1:]))
    if not text:
        return False
    if pattern[0] == "?":
        return text[0] != "/" and glob(pattern[1:], text[1:])
    if pattern[0] == "[":
        end = pattern.index("]")
        inside, wanted = pattern[1:end].lstrip("^"), pattern[1] != "^"
        chars = {chr(c) for c in range(ord(inside[0]), ord(inside[2]) + 1)} if len(inside) == 3 and inside[1] == "-" else set(inside)
        return text[0] != "/" and (text[0] in chars) == wanted and glob(pattern[end + 1 :], text[1:])
    return pattern[0] == text[0] and glob(pattern[1:], text[1:])


def folders(rule, path):
    """Rules of several parts, ** among them, over lists of parts."""
    if not rule:
        return not path
    if rule[0] == "**":
        if len(rule) == 1 or set(rule) == {"**"}:
            return len(path) > 0
        return folders(rule[1:], path) or (bool(path) and folders(rule, path[1:]))
    return bool(path) and glob(rule[0], path[0]) and folders(rule[1:], path[1:])


def included(patterns, path):
    verdict = True
    for p in patterns:
        p = p.rstrip(" \t")
        if not p or p.startswith("#"):
            continue
        include = p.startswith("!")
        p = p[1:] if include else p
        root = p.startswith("/")
        p = p[1:] if root else p
        parts = path.split("/")
        if "**" in p and ("/" in p or root):
            hit = folders([x for x in p.split("/") if x], parts)
        elif root:
            hit = glob(p, path)
        elif "/" in p:
            hit = any(glob(p, "/".join(parts[k:])) for k in range(len(parts)))
        else:
            hit = glob(p, parts[-1])
        verdict = include if hit else verdict
    return verdict


def cases():
    rng = random.Random(11)
    words = ["a", "b", "ab", "ba", "x1", "*", "?", "a*", "*b", "[ab]", "[^a]", "[a-b]1", "**", "*1", "???"]
    names = ["a", "b", "ab", "ba", "x1", "b1", "aab", "c"]
    out = []
    for _ in range(700):
        rules = []
        for _ in range(rng.randrange(0, 4)):
            body = "/".join(rng.choice(words) for _ in range(rng.choice([1, 1, 2, 3])))
            rules.append(rng.choice(["", "", "!"]) + rng.choice(["", "", "/"]) + body + rng.choice(["", "", "  "]))
        rules.insert(0, rng.choice(["", "# a remark", "   ", "*"]))
        out.append((rules, "/".join(rng.choice(names) for _ in range(rng.choice([1, 2, 3, 4])))))
    return out


def test_matcher():
    found = [(r, p, Matcher(r).includes(p)) for r, p in cases()]
    assert [x for x in found if x[2] is not included(x[0], x[1])] == []
    assert 0.2 < sum(x[2] for x in found) / len(found) < 0.95


def test_expressions_agree(spark):
    some = cases()[:120]
    df = spark.createDataFrame([("x",)], "x string")
    columns = [paths.includes(F.lit(path), patterns).alias(f"c{i}") for i, (patterns, path) in enumerate(some)]
    assert list(df.select(*columns).first()) == [included(*c) for c in some]


@pytest.mark.parametrize(("rule", "name", "kept"), [("\\#note", "#note", False), ("\\#note", "note", True), ("\\!bang", "!bang", False), ("\\!bang", "bang", True), ("end\\ ", "end ", False), ("end\\ ", "end", True), ("[", "[", True), ("\\", "\\x", True), ("[q-c]", "d", True), ("st\\*r", "st*r", False), ("st\\*r", "star", True)])
def test_escapes_and_malformed_rules(rule, name, kept):
    assert Matcher([rule]).includes(name) is kept


def test_aliases(spark):
    names = {"*1.log": "first", "sub/*.log": "sub"}
    assert alias_of("in/app1.log", "in", names) == "first" and alias_of("in/other.log", "in", names) == "other.log" and alias_of("in/a.log", "in/a.log", {}) == "a.log"
    assert alias_of("in/sub/x.log", "in", {"sub/x.log": "exact"}) == "exact"
    df = spark.createDataFrame([("in/app1.log",), ("sub/x.log",), ("other",)], "p string")
    assert [r[0] for r in df.select(paths.alias(F.col("p"), names)).collect()] == ["first", "sub", "other"]


def test_root_rules_are_relative_to_the_input():
    assert not Matcher(["/x.log"]).includes("/data/in/x.log", "x.log")
    assert Matcher(["/x.log"], strict_reference=True).includes("/data/in/x.log", "x.log")
