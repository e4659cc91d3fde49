"""Order up to a threshold: lines of one source stay together where that moves none by the threshold or more.

Time is cut in slots of the threshold. Slots come in their order; in a slot lines are ordered by source
and line, but the source that the slot before ended with comes first, so that it goes on. Keys of two
lines out of order are in one slot, so less than the threshold apart.

Which source ends a slot depends on the slot before only by whether that ended with this slot's largest source: then
the second largest ends it, else the largest. Such maps (an input that is told apart, what it gives,
what all others give) compose to one of their kind, so slots are cut in ranges: each range is folded to one map where it lies,
the maps of the ranges are carried in their order, one row each, and each range is run once more with what comes into it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark import TaskContext
from pyspark.sql import DataFrame

from weft.operators.storage import stored
from weft.operators.timeline import with_position


def ends_with(largest: int, second: int | None, before: int | None) -> int:
    """The source that ends a slot of these largest sources, behind a slot that `before` ended."""
    return second if second is not None and before == largest else largest


def _slots(df: DataFrame, threshold: int) -> DataFrame:
    """_slot, _largest and _second (NULL in slots of one source), in ranges of slots."""
    present = df.select("_slot", "file_idx").distinct()
    largest = present.groupBy("_slot").agg(F.max("file_idx").alias("_largest"))
    second = present.join(largest, "_slot").where(F.col("file_idx") < F.col("_largest")).groupBy("_slot").agg(F.max("file_idx").alias("_second"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(largest.join(second, "_slot", "left").repartitionByRange(n, "_slot").sortWithinPartitions("_slot"))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int | None]]:
    for b in batches:
        yield from zip(b["_slot"].to_pylist(), b["_largest"].to_pylist(), b["_second"].to_pylist(), strict=True)


def with_first_source(df: DataFrame, threshold: int) -> DataFrame:
    """_slot and _first: the source that comes first in it, NULL for the smallest."""
    slots = _slots(df, threshold)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = equal = other = None
        begun = False
        for _, largest, second in _rows(batches):
            if not begun:
                begun, told, equal, other = True, largest, ends_with(largest, second, largest), largest
            else:
                equal, other = ends_with(largest, second, equal), ends_with(largest, second, other)
        if begun:
            yield pa.RecordBatch.from_pydict({k: pa.array([v], pa.int32()) for k, v in (("part", TaskContext.get().partitionId()), ("told", told), ("equal", equal), ("other", other))})

    before, into = None, {}
    for r in sorted(slots.mapInArrow(fold, "part int, told int, equal int, other int").collect()):  # a row for each range
        into[r["part"]] = before
        before = r["equal"] if before is not None and before == r["told"] else r["other"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, out = into.get(TaskContext.get().partitionId()), []
        for slot, largest, second in _rows(batches):
            out.append((slot, last))
            last = ends_with(largest, second, last)
            if len(out) == 8192:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["_slot", "_first"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["_slot", "_first"])

    return slots.mapInArrow(run, "_slot long, _first long")


def with_slop_position(df: DataFrame, threshold: int) -> DataFrame:
    """A timeline with out_pos in the order up to the threshold (nanoseconds)."""
    if threshold < 1:
        raise ValueError("the threshold must be at least a nanosecond")
    slotted = stored(df.withColumn("_slot", F.call_function("div", F.col("merge_key"), F.lit(threshold).cast("bigint"))))
    placed = slotted.join(with_first_source(slotted, threshold), "_slot").withColumn("_later", ~F.col("file_idx").eqNullSafe(F.col("_first")))
    return with_position(placed, ["_slot", "_later", "file_idx", "line_no"]).drop("_slot", "_first", "_later")
