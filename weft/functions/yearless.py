"""Further timestamps, for lines in which no other form was found: named months in other orders, epoch numbers, and times without a year.

A time without a year (`Mar  4 05:06:07`, as syslog writes it) gets its year from its file. Along the file, a step back by
more than half a year begins a new year, and a step forward by more than half a year (a line that came late) goes back to the old one. The
file's last such line is in the latest year in which it is not later than the file's modification,
by more than a day. Steps are counted in chunks of lines, and carried from chunk to chunk, one row each.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame
from pyspark.sql.window import Window

from weft.functions.timestamps import DAY, MONTHS, NANOS, _fields, _floor_div, epoch_seconds
from weft.operators.storage import stored

# Day, month and year with a time behind them; the month first; seconds, milli-, micro- or nanoseconds since 1970; no year.
_CLOCK = r"([01]\d|2[0-3]):([0-5]\d):([0-5]\d)(?:[.,](\d{1,9}))?"
_NAMES = "|".join(MONTHS)
NAMED = rf"(?<!\d)(\d\d?)[ /-]({_NAMES})[a-z]*[ /-](\d{{4}})[ :T]{_CLOCK}(?: ?(Z|[+-]\d\d:?\d\d))?"
MONTH_FIRST = rf"(?<![A-Za-z])({_NAMES})[a-z]* (\d\d?), (\d{{4}}),? {_CLOCK}(?: ?(Z|[+-]\d\d:?\d\d))?"
EPOCH = r"^([\[(<\s]*)([1-9](?:\d{18}|\d{15}|\d{12}|\d{9}))(?:\.(\d{1,9}))?(?![\d.])"
YEARLESS = rf"^((?:<\d{{1,3}}>)?[\[\s]*)({_NAMES}) ([ 0]?\d|[12]\d|3[01]) {_CLOCK}"
HALF = 183 * DAY * NANOS
YEARS = (1969, 2050)
CHUNK = 100_000


def _month(name: Column) -> Column:
    return F.floor((F.instr(F.lit("".join(MONTHS)), name) + 2) / 3).cast("bigint")


def _number(text: Column) -> Column:
    """The number of a group of up to four digits; 0 if it is empty."""
    return F.lpad(F.trim(text), 4, "0").cast("bigint")


def _groups(token: Column, pattern: str, n: int) -> Column:
    """What the pattern found, and its groups, taken from there at once; all empty if it found nothing."""
    return F.when(token != "", _fields(token, pattern, n)).otherwise(F.array(*[F.lit("")] * (n + 1)))


def _fraction(digits: Column) -> Column:
    return F.rpad(digits, 9, "0").cast("bigint")


def _offset(zone: Column) -> Column:
    """Seconds of Z, +hh:mm or +hhmm; 0 without."""
    digits = F.lpad(F.regexp_replace(zone, "[^0-9]", ""), 4, "0")
    return (F.substring(digits, 1, 2).cast("bigint") * 3600 + F.substring(digits, 3, 2).cast("bigint") * 60) * F.when(zone.startswith("-"), -1).otherwise(1)


def with_further_timestamps(df: DataFrame, line: str = "line", search: int = 250) -> DataFrame:
    """df (with ts_ns, ts_start, ts_end, zoned) with those of named months and epoch numbers filled in, and _of_year: what a time without a year is in a leap year, in nanoseconds."""
    part = F.when(F.col("ts_ns").isNull(), F.substring(F.col(line), 1, search)).otherwise("")
    forms = {"_n": (NAMED, 8), "_m": (MONTH_FIRST, 8), "_e": (EPOCH, 3), "_y": (YEARLESS, 7)}
    own = [c for c in df.columns if c not in ("ts_ns", "ts_start", "ts_end", "zoned")]
    df = df.select(*own, *[F.col(c).alias(f"_{c}") for c in ("ts_ns", "ts_start", "ts_end", "zoned")], part.alias("_part"))
    # each pattern runs over a line once; columns of their own, so that no later use runs it anew
    df = df.select("*", *[F.regexp_extract("_part", p, 0).alias(c) for c, (p, _) in forms.items()])
    df = df.select(*[c for c in df.columns if c not in forms], *[_groups(F.col(c), p, n).alias(c) for c, (p, n) in forms.items()])
    n, m, e, y = (F.col(c) for c in ("_n", "_m", "_e", "_y"))
    clock = lambda g, at: (_number(g[at]), _number(g[at + 1]), _number(g[at + 2]))
    at_named = (epoch_seconds(_number(n[3]), _month(n[2]), _number(n[1]), *clock(n, 4)) - _offset(n[8])) * NANOS + _fraction(n[7])
    at_first = (epoch_seconds(_number(m[3]), _month(m[1]), _number(m[2]), *clock(m, 4)) - _offset(m[8])) * NANOS + _fraction(m[7])
    scale = F.element_at(F.create_map(*[F.lit(x) for k, v in ((10, NANOS), (13, 10**6), (16, 1000), (19, 1)) for x in (k, v)]), F.length(e[2])).cast("bigint")
    at_epoch = F.try_multiply(e[2].try_cast("bigint"), scale) + F.when(F.length(e[2]) == 10, _fraction(e[3])).otherwise(0)
    low, high = (epoch_seconds(F.lit(k), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)) * NANOS for k in (YEARS[0], YEARS[1] + 1))
    is_epoch = (e[2] != "") & (at_epoch >= low) & (at_epoch < high)
    year = lambda text: (text != "") & _number(text).between(*YEARS)
    is_named, is_first, is_none = year(n[3]), year(m[3]), y[0] != ""
    of_year = epoch_seconds(F.lit(1972), _month(y[2]), _number(y[3]), *clock(y, 4)) * NANOS + _fraction(y[7]) - 730 * DAY * NANOS
    token = F.when(is_named, n[0]).when(is_first, m[0]).when(is_epoch, F.substring(e[0], F.length(e[1]) + 1, F.length(e[0]))).when(is_none, F.substring(y[0], F.length(y[1]) + 1, F.length(y[0])))
    start = F.when(is_named | is_first, F.instr(F.col("_part"), token) - 1).when(is_epoch, F.length(e[1])).when(is_none, F.length(y[1]))
    at = F.when(is_named, at_named).when(is_first, at_first).when(is_epoch, at_epoch)
    return df.select(
        *own,
        F.coalesce("_ts_ns", at).cast("bigint").alias("ts_ns"),
        F.coalesce("_ts_start", start).cast("int").alias("ts_start"),
        F.coalesce("_ts_end", start + F.length(token)).cast("int").alias("ts_end"),
        F.coalesce("_zoned", F.when(token.isNotNull(), F.when(is_named, n[8] != "").when(is_first, m[8] != "").otherwise(is_epoch))).alias("zoned"),
        F.when(F.col("_ts_ns").isNull() & at.isNull() & is_none, of_year).cast("bigint").alias("_of_year"),
    )


def _of_year(ns: Column) -> tuple[Column, Column]:
    """The year of a time, and what the time is in a leap year."""
    at = F.date_from_unix_date(_floor_div(ns, DAY * NANOS).cast("int"))
    seconds = epoch_seconds(F.lit(1972), F.month(at), F.dayofmonth(at), F.lit(0), F.lit(0), F.lit(0)) - 730 * DAY
    return F.year(at), seconds * NANOS + F.pmod(ns, F.lit(DAY * NANOS))


def with_years(df: DataFrame, files: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """df (file_idx, line_no, ts_ns, _of_year) with ts_ns of times without a year, given files (file_idx, modified: nanoseconds)."""
    inside = Window.partitionBy("file_idx", "_chunk").orderBy("line_no")
    before = F.last("_of_year", True).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    step = lambda now, last: F.when(now - last < -HALF, 1).when(now - last > HALF, -1).otherwise(0)
    rows = df.withColumn("_chunk", F.floor(F.col("line_no") / chunk))
    rows = rows.withColumn("_step", F.when(F.col("_of_year").isNotNull(), step(F.col("_of_year"), before)).otherwise(0))
    rows = stored(rows.withColumn("_steps", F.sum("_step").over(inside.rowsBetween(Window.unboundedPreceding, 0))))
    timed = rows.where("_of_year IS NOT NULL").groupBy("file_idx", "_chunk").agg(F.min_by("_of_year", "line_no").alias("_first"), F.max_by("_of_year", "line_no").alias("_last"), F.sum("_step").alias("_n"))
    along = Window.partitionBy("file_idx").orderBy("_chunk")
    linked = timed.withColumn("_join", step(F.col("_first"), F.lag("_last").over(along)))
    into = linked.withColumn("_into", F.sum(F.col("_join")).over(along.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ends = into.groupBy("file_idx").agg(F.max_by("_last", "_chunk").alias("_end"), F.max_by(F.col("_into") + F.col("_n"), "_chunk").alias("_all"))
    year, mark = _of_year(F.col("modified") + F.lit(DAY * NANOS))
    anchor = ends.join(files.select("file_idx", "modified"), "file_idx").select("file_idx", (year - F.when(F.col("_end") > mark, 1).otherwise(0) - F.col("_all")).alias("_year"))
    placed = rows.join(into.select("file_idx", "_chunk", "_into"), ["file_idx", "_chunk"], "left").join(anchor, "file_idx", "left")
    day = F.date_from_unix_date((_floor_div(F.col("_of_year"), DAY * NANOS) + 730).cast("int"))
    seconds = epoch_seconds(F.col("_year") + F.col("_into") + F.col("_steps"), F.month(day), F.dayofmonth(day), F.lit(0), F.lit(0), F.lit(0))
    at = seconds * NANOS + F.pmod(F.col("_of_year"), F.lit(DAY * NANOS))
    return placed.withColumn("ts_ns", F.coalesce("ts_ns", at).cast("bigint")).select(*[c for c in df.columns if c != "_of_year"])
