"""The timeline: the order of all lines of all files, continuation lines, and time bounds.

The order is by merge_key, the running maximum of a file's timestamps (0 before the first), then by
file and line. Lines without a timestamp keep their parent's key, and so stay behind it. One file may
hold most lines, so running values don't go through a window over the file: lines are cut into
chunks of `chunk` lines, each chunk's own values come from a window over the chunk, and the values
carried into it come from a window over the chunks' totals, one row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from weft.operators.storage import stored

#: Lines of a chunk.
CHUNK = 100_000
_NONE = -(1 << 63)  # no timestamp: years end in 2050


def with_running(df: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """df (file_idx, line_no, ts_ns) with block_ts (the last timestamp, NULL if none yet) and merge_key.

    Lines are parsed once: the chunks' own values are stored, and what follows reads them.
    """
    return carried(stored(in_chunks(df, chunk))).select(*df.columns, "block_ts", "merge_key")


def in_chunks(df: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """df with _chunk, and the running maximum and last timestamp in it: _own_max and _own_last."""
    in_chunk = Window.partitionBy("file_idx", "_chunk").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    own = df.withColumn("_chunk", F.floor(F.col("line_no") / chunk))
    return own.withColumns({"_own_max": F.max("ts_ns").over(in_chunk), "_own_last": F.last("ts_ns", True).over(in_chunk)})


def carried(run: DataFrame) -> DataFrame:
    """block_ts and merge_key from the chunks' own values (_chunk, _own_max, _own_last) and those of the chunks before them."""
    before = Window.partitionBy("file_idx").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = run.groupBy("file_idx", "_chunk").agg(F.max("_own_max").alias("_max"), F.max_by("_own_last", "line_no").alias("_last"))
    into = totals.select("file_idx", "_chunk", F.max("_max").over(before).alias("_max"), F.last("_last", True).over(before).alias("_last"))
    key = F.coalesce(F.greatest("_own_max", "_max"), F.lit(0)).cast("bigint")
    return run.join(into, ["file_idx", "_chunk"]).withColumns({"block_ts": F.coalesce("_own_last", "_last"), "merge_key": key}).drop("_chunk", "_own_max", "_own_last", "_max", "_last")


def in_read_order(df: DataFrame) -> DataFrame:
    """df with _chunk, _own_max and _own_last, where each partition holds stretches of files in their order, as the line source reads them.

    A partition is a chunk of each of its files, so nothing is shuffled or sorted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, last_file, top, last = TaskContext.get().partitionId(), None, _NONE, _NONE
        for b in batches:
            if not b.num_rows:
                continue
            files = b["file_idx"].to_numpy()
            ts = pc.fill_null(b["ts_ns"], _NONE).to_numpy()
            tops, lasts = np.empty(len(ts), np.int64), np.empty(len(ts), np.int64)
            starts = [0, *(np.flatnonzero(np.diff(files)) + 1).tolist(), len(ts)]
            for x, y in zip(starts, starts[1:], strict=False):
                if files[x] != last_file:
                    last_file, top, last = files[x], _NONE, _NONE
                tops[x:y] = np.maximum(np.maximum.accumulate(ts[x:y]), top)
                at = np.maximum.accumulate(np.where(ts[x:y] == _NONE, -1, np.arange(y - x)))
                lasts[x:y] = np.where(at < 0, last, ts[x:y][at])
                top, last = tops[y - 1], lasts[y - 1]
            own = [pa.array(np.full(len(ts), chunk, np.int64)), *(pa.array(v, mask=v == _NONE) for v in (tops, lasts))]
            yield pa.RecordBatch.from_arrays([*b.columns, *own], names=[*b.schema.names, "_chunk", "_own_max", "_own_last"])

    fields = [T.StructField(c, T.LongType()) for c in ("_chunk", "_own_max", "_own_last")]
    return df.mapInArrow(run, T.StructType([*df.schema.fields, *fields]))


def anchored(df: DataFrame, files: DataFrame) -> DataFrame:
    """A timeline in which files without any timestamp have the key of their modification, given files (file_idx, modified), instead of 0."""
    timed = df.groupBy("file_idx").agg(F.max("ts_ns").alias("_any")).where("_any IS NULL")
    anchors = timed.join(files.select("file_idx", "modified"), "file_idx").select("file_idx", F.col("modified").alias("_anchor"))
    return df.join(anchors, "file_idx", "left").withColumn("merge_key", F.coalesce("_anchor", "merge_key")).drop("_anchor")


def bounded(df: DataFrame, since: int | None = None, until: int | None = None, drop_orphans: bool = False) -> DataFrame:
    """The lines of a timeline within the bounds, both inclusive.

    A file ends at its first line after `until`. Before `since`, timestamped lines go; continuation lines
    stay unless drop_orphans, when those of dropped lines go too.
    """
    if until is not None:
        df = df.where(F.col("merge_key") <= until)
    if since is not None:
        df = df.where(F.coalesce(F.col("block_ts") >= since, F.lit(False)) if drop_orphans else F.col("ts_ns").isNull() | (F.col("ts_ns") >= since))
    return df


def order_columns(tie: str = "file_idx") -> list[Column]:
    return [F.col("merge_key"), F.col(tie), F.col("line_no")]


def with_position(df: DataFrame, order: list[str], name: str = "out_pos", partitions: int | None = None) -> DataFrame:
    """df with 0-based positions in the order of the columns, without one task for all rows.

    Rows are sorted by ranges of all order columns, so that many rows of one key are many ranges too, and
    stored with their places in their ranges; the rows before a range are counted by range.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    counts = ranged.groupBy(part.alias("_part")).count()
    before = counts.select("_part", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    placed = ranged.withColumn("_part", part).join(before, "_part")
    return placed.select(*df.columns, (F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1)).cast("bigint").alias(name))


def with_blocks(df: DataFrame, column: str = "alias", position: str = "out_pos", chunk: int = CHUNK) -> DataFrame:
    """df with block_id (0-based), the run of consecutive rows with the same value in order of position, and block_start.

    Rows are compared within chunks of positions; a chunk's first row is compared with the last value of
    the chunk before, and the runs before a chunk are counted by chunk.
    """
    rows = df.withColumn("_chunk", F.floor(F.col(position) / chunk))
    inner = Window.partitionBy("_chunk").orderBy(position)
    last = rows.groupBy("_chunk").agg(F.max_by(column, position).alias("_last")).withColumn("_chunk", F.col("_chunk") + 1)
    previous = F.when(F.col(position) % chunk == 0, F.col("_last")).otherwise(F.col("_lag"))
    starts = (F.col(position) == 0) | ~F.col(column).eqNullSafe(previous)
    marked = rows.withColumn("_lag", F.lag(column).over(inner)).join(last, "_chunk", "left").withColumn("block_start", starts)
    totals = marked.groupBy("_chunk").agg(F.count_if("block_start").alias("_n"))
    carried = totals.select("_chunk", F.coalesce(F.sum("_n").over(Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.sum(F.col("block_start").cast("bigint")).over(inner.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("_own", own).join(carried, "_chunk").withColumn("block_id", (F.col("_before") + F.col("_own") - 1).cast("bigint")).select(*df.columns, "block_id", "block_start")
