"""Timestamps in free-form lines: parsing to nanoseconds since 1970 (UTC), and formatting.

A line without a timestamp has the value NULL. Positions are 0-based character offsets in the line.
Parsing runs one regular expression over the searched part of a line; its groups are then taken
from the short token that it found, so no pattern runs over the line twice.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

# The numeric form (date, time, fraction or spaced milliseconds, zone) and the ctime form.
YEAR = r"(?:19(?:69|[7-9]\d)|20(?:[0-4]\d|50)|\d{2}(?!\d))"
NUMERIC = (
    r"(?<!\d)(" + YEAR + r")[-/]?(0[1-9]|1[0-2]|[1-9](?!\d))[-/]?(0[1-9]|[12]\d|3[01]|[1-9](?!\d))(?!\d)"
    r"[ T_]([01]\d|2[0-3]|\d(?!\d))[:.\-]([0-5]\d|\d(?!\d))[:.\-]([0-5]\d|\d(?!\d))"
    r"(?:[.,](\d{0,9})| (\d{1,3})(?!\d))?(?:(Z)|([+-])([01]\d|2[0-3]|\d(?!\d)):?(\d{0,2}))?"
)
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
CTIME = (
    r"(?:(?<=^|[ \t])[A-Za-z]{3} |(?<=^|[ \t]))(" + "|".join(MONTHS) + r")  ?(3[01]|[12]\d|0?[1-9]) (2[0-3]|[01]?\d):([0-5]?\d):([0-5]?\d)"
    r"(?: [A-Z]{2,5})? (19(?:69|[7-9]\d)|20(?:[0-4]\d|50))"
)
SEARCH_LIMIT = 250
SHORTEST = 15
NANOS = 1_000_000_000
DAY = 86_400


@dataclass(frozen=True)
class TimestampOptions:
    """How far into a line to look, the fewest characters left at a timestamp, whether zones don't count, and whether further forms are looked for."""

    search_limit: int = SEARCH_LIMIT
    shortest: int = SHORTEST
    ignore_timezone: bool = False
    further: bool = False
    #: The zone of times without one, which may show an hour twice; None is UTC.
    zone: str | None = None


def _two(c: Column) -> Column:
    """The number of a group of up to two digits; 0 if it is empty (a failing cast would cost an exception for each row)."""
    return F.lpad(c, 2, "0").cast("bigint")


def _fields(head: Column, pattern: str, n: int) -> Column:
    """token, group 1 .. group n of the pattern at the end of head."""
    groups = "|".join(f"${i}" for i in range(1, n + 2))
    return F.split(F.regexp_replace(head, rf"(?s)^.*?({pattern})$", groups), r"\|", -1)


def epoch_seconds(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    """Seconds since 1970; a day past its month's end goes on into the next month."""
    first = F.unix_date(F.make_date(year.cast("int"), month.cast("int"), F.lit(1))).cast("bigint")
    return (first + day - 1) * DAY + hour * 3600 + minute * 60 + second


def with_timestamps(df: DataFrame, line: str = "line", options: TimestampOptions | None = None) -> DataFrame:
    """df with ts_ns, ts_start, ts_end (NULL without a timestamp) and zoned (whether a zone or a ctime form ended it)."""
    o = options or TimestampOptions()
    part = F.substring(F.col(line), 1, o.search_limit)
    # cheap tests of the next characters come first: most places of a line fail them
    long_enough = rf"(?=.{{{o.shortest}}})"
    own = [c for c in df.columns if c not in ("ts_ns", "ts_start", "ts_end", "zoned")]
    df = df.select(*own, F.regexp_extract(part, rf"(?s)^.*?(?<!\d)(?=\d){long_enough}{NUMERIC}", 0).alias("_head"))
    df = df.select(*own, "_head", F.when(F.col("_head") == "", F.regexp_extract(part, rf"(?s)^.*?(?=[A-Z][a-z][a-z] ){long_enough}{CTIME}", 0)).otherwise("").alias("_ctime"))
    df = df.select(*own, "_head", "_ctime", F.when(F.col("_head") != "", _fields(F.col("_head"), NUMERIC, 12)).when(F.col("_ctime") != "", _fields(F.col("_ctime"), CTIME, 6)).alias("_f"))
    f = F.col("_f")
    df = df.select(*own, "_head", "_ctime", "_f", F.when(F.col("_head") != "", f[1].cast("bigint")).alias("_year"))
    numeric = F.col("_head") != ""
    year = F.col("_year") + F.when(F.length(f[1]) == 4, 0).when(F.col("_year") < 69, 2000).otherwise(1900)
    fraction = F.rpad(F.concat(f[7], f[8]), 9, "0").cast("bigint")
    offset = (_two(f[11]) * 3600 + _two(f[12]) * 60) * F.when(f[10] == "-", -1).otherwise(1)
    local = epoch_seconds(year, _two(f[2]), _two(f[3]), _two(f[4]), _two(f[5]), _two(f[6]))
    utc = local if o.ignore_timezone else local - offset
    month = F.floor((F.instr(F.lit("".join(MONTHS)), f[1]) + 2) / 3)
    named = epoch_seconds(f[6].cast("bigint"), month, _two(f[2]), _two(f[3]), _two(f[4]), _two(f[5]))
    at = F.when(numeric, utc * NANOS + fraction).when(f.isNotNull(), named * NANOS).cast("bigint")
    end = F.when(f.isNotNull(), F.length(F.concat("_head", "_ctime")))
    zoned = F.when(numeric, (f[9] != "") | (f[10] != "")).when(f.isNotNull(), True)
    return df.select(*own, at.alias("ts_ns"), (end - F.length(f[0])).cast("int").alias("ts_start"), end.cast("int").alias("ts_end"), zoned.alias("zoned"))


def format_timestamp(ns: Column) -> Column:
    """`YYYY-MM-DD HH:MM:SS.nnnnnnnnn ` of nanoseconds since 1970, in any session time zone."""
    second = _floor_div(ns, NANOS)
    rest = ns - second * NANOS
    day = _floor_div(second, DAY)
    of_day = second - day * DAY
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat(
        F.date_format(F.date_from_unix_date(day.cast("int")).cast("timestamp_ntz"), "yyyy-MM-dd"), F.lit(" "), two(_floor_div(of_day, 3600)), F.lit(":"), two(_floor_div(of_day % 3600, 60)), F.lit(":"), two(of_day % 60),
        F.lit("."), F.lpad(rest.cast("string"), 9, "0"), F.lit(" "),
    )


# Formats by name; %N with a digit is a fraction of so many digits, as in GNU date.
FORMATS = {"iso8601": "%Y-%m-%dT%H:%M:%S.%9NZ", "epoch": "%s.%9N", "epoch_ms": "%s%3N", "clf": "%d/%b/%Y:%H:%M:%S +0000"}


def format_as(ns: Column, pattern: str) -> Column:
    """Nanoseconds since 1970 as text: a name of FORMATS, or a pattern of %Y %m %d %j %b %a %H %M %S %s %1N to %9N and %%."""
    second = _floor_div(ns, NANOS)
    day, rest = _floor_div(second, DAY), F.lpad((ns - second * NANOS).cast("string"), 9, "0")
    of_day, date = second - day * DAY, F.date_from_unix_date(day.cast("int")).cast("timestamp_ntz")
    clock = {"H": _floor_div(of_day, 3600), "M": _floor_div(of_day % 3600, 60), "S": of_day % 60}
    dates = {"Y": "yyyy", "m": "MM", "d": "dd", "j": "DDD", "b": "MMM", "a": "EEE"}
    parts: list[Column] = []
    for plain, code, end in re.findall(r"([^%]+)|%(\dN|[A-Za-z%])|(%.?)", FORMATS.get(pattern, pattern), re.S):
        if plain or code == "%":
            parts.append(F.lit(plain or "%"))
        elif code in dates:
            parts.append(F.date_format(date, dates[code]))
        elif code in clock:
            parts.append(F.lpad(clock[code].cast("string"), 2, "0"))
        elif code == "s":
            parts.append(second.cast("string"))
        elif code[1:] == "N" and code[0] != "0":
            parts.append(F.substring(rest, 1, int(code[0])))
        else:
            raise ValueError(f"not a part of a time's format: {end or '%' + code}")
    return F.concat(*parts) if parts else F.lit("")


def _floor_div(a: Column, b: int) -> Column:
    """Whole division towards minus infinity, in 64-bit integers (a double would lose nanoseconds)."""
    divisor = F.lit(b).cast("bigint")
    return F.call_function("div", a - F.pmod(a, divisor), divisor)


def nanos(text: str) -> int:
    """Nanoseconds since 1970 of an RFC 3339 time, as bounds are given."""
    from datetime import UTC, datetime

    m = re.fullmatch(r"(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d)(?:\.(\d{1,9}))?(Z|[+-]\d\d:\d\d)", text)
    if not m:
        raise ValueError(f"not an RFC 3339 time: {text}")
    at = datetime.fromisoformat(m[1] + m[3].replace("Z", "+00:00")).astimezone(UTC)
    since = at - datetime(1970, 1, 1, tzinfo=UTC)
    return (since.days * DAY + since.seconds) * NANOS + int((m[2] or "").ljust(9, "0"))


def rfc3339(ns: int) -> str:
    """The RFC 3339 time of nanoseconds since 1970, with as few fraction digits as hold it."""
    from datetime import UTC, datetime, timedelta

    seconds, rest = divmod(ns, NANOS)
    text = (datetime(1970, 1, 1, tzinfo=UTC) + timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%S")
    return text + (f".{rest:09d}".rstrip("0") if rest else "") + "Z"
