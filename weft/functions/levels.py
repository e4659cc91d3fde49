"""Severity levels in free-form lines."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

# Levels by number, their 6-character labels, level words, glog letters, the searched characters.
NAMES = ("UNKNOWN", "TRACE", "DEBUG", "INFO", "NOTICE", "WARN", "ERROR", "FATAL")
LABELS = ("      ", "TRACE ", "DEBUG ", "INFO  ", "NOTE  ", "WARN  ", "ERROR ", "FATAL ")
WORDS = {"info": 3, "warn": 5, "warning": 5, "error": 6, "debug": 2, "trace": 1, "fatal": 7, "notice": 4, "severe": 6, "critical": 7}
LETTERS = {"I": 3, "W": 5, "E": 6, "F": 7, "D": 2}
SEARCH = 40
_AROUND = " \t|:[]()"
_WORD = r"^([ \t|:\[\]()]*)([A-Za-z]{2,9})(?![A-Za-z0-9_])[\]) |:]?"


def _pick(numbers: dict[str, int], c: Column) -> Column:
    pairs = [F.lit(x) for kv in numbers.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), c), F.lit(0)).cast("int")


def with_levels(df: DataFrame, line: str = "line") -> DataFrame:
    """df (with ts_start and ts_end) with level, level_start and level_end; positions are NULL if there is no level.

    A glog letter just before the timestamp, at the line's start or after a space, comes first; else the
    first word after the timestamp (or of a line without one) counts, if it is a level word.
    """
    own = [c for c in df.columns if c not in ("level", "level_start", "level_end")]
    end = F.coalesce("ts_end", F.lit(0))
    before = F.substring(F.col(line), F.greatest(F.col("ts_start") - 1, F.lit(1)), F.least(F.col("ts_start"), F.lit(2)))
    letter = F.coalesce(F.regexp_extract(before, r"^[ \n]?([IWEFD])$", 1), F.lit(""))
    found = F.regexp_extract(F.substring(F.col(line), end + 1, F.lit(SEARCH)), _WORD, 0)  # none of its characters ends a line
    df = df.select(*own, letter.alias("_letter"), found.alias("_found"))
    df = df.select(*own, "_letter", "_found", _pick(WORDS, F.lower(F.btrim("_found", F.lit(_AROUND)))).alias("_word"))
    by_letter, some = F.col("_letter") != "", F.col("_word") > 0
    level = F.when(by_letter, _pick(LETTERS, F.col("_letter"))).otherwise(F.col("_word"))
    start = F.when(by_letter, F.col("ts_start") - 1).when(some, end + F.length("_found") - F.length(F.ltrim("_found", F.lit(_AROUND))))
    stop = F.when(by_letter, F.col("ts_start")).when(some, end + F.length("_found"))
    return df.select(*own, level.alias("level"), start.cast("int").alias("level_start"), stop.cast("int").alias("level_end"))


def label(level: Column) -> Column:
    """The 6-character label of a level."""
    return F.element_at(F.array(*map(F.lit, LABELS)), level + 1)


def name(level: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, NAMES)), level + 1)
