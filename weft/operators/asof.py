"""As-of join: each row of one timeline with the last row of another at or before its time.

Both sides are put together in ranges of (key, time), so a key that holds most rows is many ranges. In a
range, what came last is a window over the key's rows there; what comes into a range is carried from the
key's ranges before it, one row for each range of a key. No window spans a key or all rows.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame
from pyspark.sql.window import Window

from weft.operators.storage import stored


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], time: str = "ts_ns", order: list[str] | None = None, tolerance: int | None = None, name: str = "last") -> DataFrame:
    """left with a struct `name` of right's columns: its last row of equal keys whose time is not after left's, and not before it by more than the tolerance.

    Of right rows of one key and time the last by the columns `order` counts (without them any). Null
    keys and times match nothing. All rows of left stay, repeated ones too; without a match the struct is null.
    """
    if name in left.columns:
        raise ValueError(f"left has a column {name}")
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    named = [f"_k{i}" for i in range(len(keys))]
    own = left.select(*key, F.col(time).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(right.select(F.struct(*right.columns).alias("r")).schema["r"].dataType).alias("_right"))
    other = right.where(F.col(time).isNotNull()).dropna(subset=keys).select(*key, F.col(time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(own.schema["_left"].dataType).alias("_left"), F.struct(*right.columns).alias("_right"))
    tie = [F.col(f"_right.{c}") for c in order or []]
    ranged = stored(own.unionByName(other).repartitionByRange(n, *named, "_t", "_side").withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy(*named, "_part").orderBy("_t", "_side", *tie).rowsBetween(Window.unboundedPreceding, 0)
    latest = F.max_by("_right", F.when(F.col("_right").isNotNull(), F.struct("_t", *[c.alias(f"_o{i}") for i, c in enumerate(tie)])))
    ends = ranged.groupBy(*named, "_part").agg(latest.alias("_end"))
    before = Window.partitionBy(*named).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    into = ends.select(*[F.col(c).alias(f"{c}_") for c in named], F.col("_part").alias("_part_"), F.last("_end", True).over(before).alias("_into"))
    seen = ranged.withColumn("_own", F.last("_right", True).over(inside)).where("_side = 1")
    same = F.col("_part") == F.col("_part_")
    for c in named:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_"))
    found = seen.join(into, same, "left").withColumn("_found", F.coalesce("_own", "_into"))
    fits = F.col("_t").isNotNull()
    for c in named:
        fits = fits & F.col(c).isNotNull()
    if tolerance is not None:
        fits = fits & (F.col("_t") - F.col(f"_found.{time}") <= tolerance)
    return found.select("_left.*", F.when(fits, F.col("_found")).alias(name))
