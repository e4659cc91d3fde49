"""Timestamps: values, positions and formats, against a model built on datetime."""

import itertools
import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from weft.functions.timestamps import TimestampOptions, format_timestamp, nanos, rfc3339, with_timestamps

EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()


def parsed(spark, lines, options=None):
    df = spark.createDataFrame(list(enumerate(lines)), "i int, line string")
    return [(r["ts_ns"], r["ts_start"], r["ts_end"]) for r in with_timestamps(df, options=options).orderBy("i").collect()]


def seconds(at):
    return (at - EPOCH) // timedelta(seconds=1)


def numeric_cases():
    """(line, nanoseconds, start, end) of every separator, fraction and zone, in turn, behind different prefixes."""
    rng = random.Random(1)
    fractions = [("", 0), (".5", 500_000_000), (",042", 42_000_000), (".123456", 123_456_000), (".987654321", 987_654_321), (" 7", 700_000_000), (" 250", 250_000_000)]
    zones = [("", 0), ("Z", 0), ("+02:00", 7200), ("-0930", -34_200), ("+11", 39_600)]
    for n, (day, mid, clock, (fraction, ns), (zone, offset)) in enumerate(itertools.product("-/", " T_", ":.-", fractions, zones)):
        if clock != ":" and n % 3:
            continue
        if fraction.startswith(" ") and zone:
            continue
        at = EPOCH + timedelta(seconds=rng.randrange(0, 2_500_000_000))
        text = at.strftime(f"%Y{day}%m{day}%d{mid}%H{clock}%M{clock}%S") + fraction + zone
        prefix, suffix = rng.choice(["", "[", "host7: ", "<13>", "  ", "((", "svc a=b "]), rng.choice(["", " ready", "] ready", "|x", "\tready"])
        if suffix == "" and zone == "" and fraction == "":
            suffix = " end"
        yield prefix + text + suffix, (seconds(at) - offset) * 10**9 + ns, len(prefix), len(prefix) + len(text)


def test_numeric_forms(spark):
    cases = list(numeric_cases())
    assert parsed(spark, [c[0] for c in cases]) == [c[1:] for c in cases] and len(cases) > 200


def test_named_months(spark):
    rng, cases = random.Random(2), []
    for k in range(120):
        at = EPOCH + timedelta(seconds=rng.randrange(0, 2_500_000_000))
        month = f"{MONTHS[at.month - 1]} {at.day:2d}" if k % 2 else f"{MONTHS[at.month - 1]} {at.day:02d}"
        text = (at.strftime("%a ") if k % 3 else "") + month + at.strftime(" %H:%M:%S") + rng.choice(["", " UTC", " CEST"]) + f" {at.year}"
        prefix = rng.choice(["", "<daemon> ", "worker\t"])
        cases.append((prefix + text + rng.choice(["", " done"]), seconds(at) * 10**9, len(prefix), len(prefix) + len(text)))
    assert parsed(spark, [c[0] for c in cases]) == [c[1:] for c in cases]


def test_two_digit_years_and_short_fields(spark):
    for y in (0, 38, 68, 69, 70, 99):
        year = 2000 + y if y < 69 else 1900 + y
        at = datetime(year, 3, 4, 5, 6, 7, tzinfo=UTC)
        assert parsed(spark, [f"{y:02d}-3-4 05:06:07 up"])[0] == (seconds(at) * 10**9, 0, 15)
    assert parsed(spark, [f"{datetime(2031, 7, 9):%Y%m%d} 10:11:12 up"])[0][0] == seconds(datetime(2031, 7, 9, 10, 11, 12, tzinfo=UTC)) * 10**9


def test_days_past_a_month_go_on(spark):
    lines = [f"2023-{m:02d}-{d} 01:02:03 x" for m in (2, 4, 6, 9, 11) for d in (29, 30, 31)]
    want = [seconds(datetime(2023, m, 1, 1, 2, 3, tzinfo=UTC) + timedelta(days=d - 1)) * 10**9 for m in (2, 4, 6, 9, 11) for d in (29, 30, 31)]
    assert [r[0] for r in parsed(spark, lines)] == want


def test_no_timestamps(spark):
    parts = {"month": ["00", "13", "99"], "day": ["00", "32"], "hour": ["24", "77"], "minute": ["60"], "second": ["60", "99"], "year": ["1967", "2051", "3000"]}
    lines = []
    for field, values in parts.items():
        for v in values:
            f = {"year": "2022", "month": "05", "day": "06", "hour": "07", "minute": "08", "second": "09"} | {field: v}
            lines.append("{year}-{month}-{day} {hour}:{minute}:{second} wrong".format(**f))
    lines += ["2022-05-06 alone", "07:08:09 alone", "", None, "words only", "1234567890123456789", "x2022-05-06", "20:22:05 2022"]
    assert parsed(spark, lines) == [(None, None, None)] * len(lines)


def test_options(spark):
    at = datetime(2027, 8, 9, 10, 11, 12, tzinfo=UTC)
    line = f"{at:%Y-%m-%d %H:%M:%S}-07:00 moved"
    assert parsed(spark, [line], TimestampOptions(ignore_timezone=True))[0][0] == seconds(at) * 10**9
    assert parsed(spark, [line])[0][0] == (seconds(at) + 7 * 3600) * 10**9
    for room in (12, 19, 30):
        found = parsed(spark, ["." * 11 + line], TimestampOptions(search_limit=11 + room))[0][0]
        assert (found is None) == (room < 19)
    short = "31-2-3 4:5:6"
    assert parsed(spark, [short], TimestampOptions(shortest=len(short) + 1))[0][0] is None
    assert parsed(spark, [short], TimestampOptions(shortest=len(short)))[0][0] == seconds(datetime(2031, 2, 3, 4, 5, 6, tzinfo=UTC)) * 10**9


def test_bounds():
    assert nanos("1970-01-01T00:00:01.000000005Z") == 1_000_000_005
    assert nanos("2031-01-01T01:00:00+01:00") == nanos("2031-01-01T00:00:00Z")
    for text in ("2031-01-01T00:00:00Z", "2031-01-01T00:00:00.123456789Z", "1969-12-31T23:59:59.5Z"):
        assert rfc3339(nanos(text)) == text
    with pytest.raises(ValueError):
        nanos("yesterday")


@pytest.mark.parametrize("ns", [0, 1, -1, 999_999_999, 951_782_400_000_000_000, 4_102_444_799_999_999_999, -1_000_000_000])
def test_format(spark, ns):
    want = rfc3339(ns // 10**9 * 10**9).replace("T", " ").rstrip("Z") + f".{ns % 10**9:09d} "
    assert spark.range(1).select(format_timestamp(F.lit(ns).cast("bigint"))).first()[0] == want
