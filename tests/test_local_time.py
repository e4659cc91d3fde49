"""Times of a zone's clock, against zoneinfo."""

from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest

from weft.functions.local_time import with_local_zone
from weft.functions.timestamps import TimestampOptions, with_timestamps
from weft.plans.merge import Merge, MergeOptions

EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


def ns(at):
    return (at - EPOCH) // timedelta(microseconds=1) * 1000


@pytest.mark.parametrize(("zone", "start"), [("Europe/Berlin", datetime(2024, 10, 26, 22, tzinfo=UTC)), ("Europe/Berlin", datetime(2024, 3, 30, 22, tzinfo=UTC)), ("America/New_York", datetime(2023, 11, 5, 2, tzinfo=UTC)), ("Australia/Lord_Howe", datetime(2024, 4, 6, 10, tzinfo=UTC)), ("Asia/Kolkata", datetime(2024, 1, 1, tzinfo=UTC))])
@pytest.mark.parametrize("session", ["UTC", "America/Los_Angeles"])
def test_changes_of_clocks(spark, zone, start, session):
    rows, want = [], {}
    for f, minutes in enumerate((7, 1)):
        for n in range(8 * 60 // minutes):
            t = start + timedelta(minutes=n * minutes, seconds=n % 3, microseconds=123_000)
            rows.append((f, n, t.astimezone(ZoneInfo(zone)).strftime("%Y-%m-%d %H:%M:%S.123000007 x")))
            want[f, n] = ns(t) + 7
    rows += [(5, 0, "2024-10-27T02:30:00+05:00 z"), (5, 1, "none"), (6, 0, None)]
    want |= {(5, 0): ns(datetime(2024, 10, 26, 21, 30, tzinfo=UTC)), (5, 1): None, (6, 0): None}
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", session)
    try:
        df = with_timestamps(spark.createDataFrame(rows, "file_idx int, line_no bigint, line string").repartition(3))
        got = with_local_zone(df, zone).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert {(r["file_idx"], r["line_no"]): r["ts_ns"] for r in got} == want and len(got) == len(rows)


def test_merge_in_a_zone(spark, tmp_path):
    (tmp_path / "a.log").write_text("2024-07-01 12:00:00 local\n")
    (tmp_path / "b.log").write_text("2024-07-01 11:00:00Z utc\n")
    for zone, want in ((None, ["utc", "local"]), ("Europe/Berlin", ["local", "utc"])):
        with Merge(spark, [str(tmp_path)], MergeOptions(timestamps=TimestampOptions(zone=zone))) as m:
            assert [x.rpartition(" ")[2] for x in m.lines()] == want
