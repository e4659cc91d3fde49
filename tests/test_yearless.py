"""Times without a year, named months, epoch numbers, against datetime and a loop along the file."""

import os
import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from weft.functions.timestamps import TimestampOptions, format_as, with_timestamps
from weft.functions.yearless import with_further_timestamps, with_years
from weft.operators.render import RenderOptions
from weft.plans.merge import Merge, MergeOptions

EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


def ns(at):
    return (at - EPOCH) // timedelta(microseconds=1) * 1000


def walk(rng, start, n, steps):
    out = []
    for _ in range(n):
        start += timedelta(hours=rng.choice(steps))
        out.append(start)
    return out


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_years_along_files(spark, chunk):
    rng, rows, files, want = random.Random(chunk), [], [], {}
    for f in range(6):
        times = walk(rng, datetime(rng.choice([1999, 2019, 2023]), 11, 5, tzinfo=UTC), 120, [-200, 1, 30, 300, 900])
        files.append((f, ns(times[-1]) + rng.choice([0, 1, 40 * 86_400]) * 10**9))
        for n, t in enumerate(times):
            plain = rng.random() < 0.2
            rows.append((f, n, "no time here" if plain else t.strftime("%b ") + f"{t.day:2d}" + t.strftime(" %H:%M:%S host x")))
            want[f, n] = None if plain else ns(t)
    df = spark.createDataFrame(rows, "file_idx int, line_no bigint, line string").repartition(4)
    got = with_years(with_further_timestamps(with_timestamps(df)), spark.createDataFrame(files, "file_idx int, modified bigint"), chunk)
    assert {(r["file_idx"], r["line_no"]): r["ts_ns"] for r in got.collect()} == want


def test_forms_places_and_what_is_none(spark):
    at = datetime(2027, 3, 4, 5, 6, 7, tzinfo=UTC)
    second = ns(at)
    cases = {
        "4 Mar 2027 05:06:07 x": (second, 0, 19, False), "[04/Mar/2027:05:06:07 -0200] GET": (second + 7200 * 10**9, 1, 27, True), "at March 4, 2027 05:06:07.25 x": (second + 250_000_000, 3, 28, False), "4-Mar-2027 05:06:07Z": (second, 0, 20, True),
        f"{second // 10**9} x": (second, 0, 10, True), f"{second // 10**9}.5 x": (second + 500_000_000, 0, 12, True), f"  {second // 10**6}": (second, 2, 15, True), f"({second // 1000}) x": (second, 1, 17, True), f"{second}": (second, 0, 19, True),
        "9999999999999999999 x": None, "12345678901 x": None, "0123456789 x": None, "x 1800000000": None, "34 Abc 2027 05:06:07": None, "4 Mar 1820 05:06:07": None, "4 Mar 2027": None, "": None, "Mar 4": None, "version 1.2.3": None,
        "2027-03-04 05:06:07 and 9 Jan 2001 01:01:01": (second, 0, 19, False),
    }
    df = with_further_timestamps(with_timestamps(spark.createDataFrame(list(enumerate(cases)), "i int, line string")))
    got = [(r["ts_ns"], r["ts_start"], r["ts_end"], r["zoned"]) for r in df.orderBy("i").collect()]
    assert got == [x or (None, None, None, None) for x in cases.values()]
    none = with_further_timestamps(with_timestamps(spark.createDataFrame([("<34>Feb 29 23:59:59.5 h",), (None,)], "line string"))).collect()
    assert [(r["ts_start"], r["ts_end"], r["_of_year"]) for r in none] == [(4, 21, (59 * 86_400 + 86_399) * 10**9 + 500_000_000), (None, None, None)]


def test_merge_of_files_without_years(spark, tmp_path):
    rng, lines = random.Random(3), []
    for f in ("a.log", "b.log"):
        times = walk(rng, datetime(2024, 12, 28, tzinfo=UTC), 40, [1, 5, 9])
        (tmp_path / f).write_text("".join(t.strftime("%b %d %H:%M:%S ") + f"{f} {n}\n" for n, t in enumerate(times)))
        os.utime(tmp_path / f, (times[-1].timestamp() + 5,) * 2)
        lines += [(t, f, n) for n, t in enumerate(times)]
    with Merge(spark, [str(tmp_path)], MergeOptions(timestamps=TimestampOptions(further=True))) as m:
        assert [x[16:] for x in m.lines()] == [f"{f} {n}" for _, f, n in sorted(lines)]
        assert [r["ts_ns"] for r in m.timeline().orderBy("out_pos").collect()] == [ns(t) for t, _, _ in sorted(lines)]


def test_files_without_timestamps_stand_at_their_modification(spark, tmp_path):
    (tmp_path / "a.log").write_text("2031-01-01 00:00:01 a\n2031-01-01 00:00:09 a\n")
    (tmp_path / "z.log").write_text("none here\nnor here\n")
    os.utime(tmp_path / "z.log", (datetime(2031, 1, 1, 0, 0, 5, tzinfo=UTC).timestamp(),) * 2)
    for anchored, want in ((False, ["none here", "nor here", "a", "a"]), (True, ["a", "none here", "nor here", "a"])):
        with Merge(spark, [str(tmp_path)], MergeOptions(anchor_by_modification=anchored)) as m:
            assert [x.removeprefix("2031-01-01 00:00:01 ").removeprefix("2031-01-01 00:00:09 ") for x in m.lines()] == want


def test_formats(spark):
    rng = random.Random(4)
    times = [EPOCH + timedelta(microseconds=rng.randrange(-(10**15), 25 * 10**14)) for _ in range(50)]
    df = spark.createDataFrame([(i, ns(t) + 7) for i, t in enumerate(times)], "i int, ns bigint")
    pattern = "%Y|%m|%d|%j|%b|%a|%H:%M:%S.%9N %3N %1N %s %%"
    got = [r[0] for r in df.orderBy("i").select(format_as(F.col("ns"), pattern)).collect()]
    assert got == [t.strftime(f"%Y|%m|%d|%j|%b|%a|%H:%M:%S.{t.microsecond:06d}007 {t.microsecond // 1000:03d} {t.microsecond // 100_000} {(t - EPOCH) // timedelta(seconds=1)} %%") for t in times]
    for bad in ("%Q", "%", "%0N", "%10N"):
        with pytest.raises(ValueError, match="not a part"):
            format_as(F.col("ns"), bad)


def test_a_format_of_ones_own_in_the_output(spark, tmp_path):
    (tmp_path / "a.log").write_text("2031-01-01 00:00:01 a\n")
    (tmp_path / "b.log").write_text("none\n")
    with Merge(spark, [str(tmp_path)], MergeOptions(render=RenderOptions(write_timestamp=True, timestamp_format="%H:%M:%S"))) as m:
        assert list(m.lines()) == ["         none", "00:00:01 2031-01-01 00:00:01 a"]
        assert m.counters().first()["bytes_timestamps"] == 18


def test_each_pattern_runs_over_a_line_once(spark):
    df = spark.createDataFrame([("x",)], "line string").selectExpr("line", "CAST(NULL AS BIGINT) AS ts_ns", "0 AS ts_start", "0 AS ts_end", "false AS zoned")
    plan = with_further_timestamps(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") <= 4
