"""Times without a zone, read as the clock of a zone.

A clock shows some hours twice in autumn. Of the lines of a file in such an hour, those behind the first step
back by more than half of what the clock was set back are in its second showing; the others, and all if there
is no such step, in its first. A time that the clock left out in spring is taken on by what was left out.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame
from pyspark.sql.window import Window

from weft.functions.timestamps import NANOS, _floor_div
from weft.operators.storage import stored

#: Seconds by which clocks are set back.
BACK = (3600, 1800, 7200)


def _micros(ns: Column) -> Column:
    return _floor_div(ns, 1000)


def _shown(micros: Column, zone: str) -> Column:
    """What the zone's clock shows, as microseconds of that wall time since 1970; with the session in any zone."""
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(micros), zone))


def with_local_zone(df: DataFrame, zone: str) -> DataFrame:
    """df (file_idx, line_no, ts_ns, zoned) with ts_ns of times without a zone as those of the zone's clock."""
    wall = _micros(F.col("ts_ns"))
    first = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(wall), zone))
    back = F.coalesce(*[F.when(_shown(F.col("_first") + F.lit(s * 1_000_000), zone) == wall, F.lit(s).cast("bigint")) for s in BACK])
    free = F.col("ts_ns").isNotNull() & ~F.coalesce("zoned", F.lit(False))
    rows = stored(df.withColumn("_first", F.when(free, first)).withColumn("_back", F.when(F.col("_first").isNotNull(), back)))
    rest = F.col("ts_ns") - wall * 1000
    plain = rows.where("_back IS NULL").withColumn("ts_ns", F.coalesce(F.col("_first") * 1000 + rest, F.col("ts_ns")))
    # an hour's lines of a file: few, also in a large one
    along = Window.partitionBy("file_idx", _floor_div(F.col("_first"), 86_400 * 1_000_000)).orderBy("line_no")
    step = (F.col("ts_ns") - F.lag("ts_ns").over(along)) < -F.col("_back") * NANOS / 2
    twice = rows.where("_back IS NOT NULL").withColumn("_step", F.coalesce(step, F.lit(False)).cast("int"))
    twice = twice.withColumn("_second", F.max("_step").over(along.rowsBetween(Window.unboundedPreceding, 0)) > 0)
    settled = F.col("_first") * 1000 + rest + F.when(F.col("_second"), F.col("_back") * NANOS).otherwise(0)
    return plain.select(df.columns).unionByName(twice.withColumn("ts_ns", settled.cast("bigint")).select(df.columns))
