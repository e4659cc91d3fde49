"""The ordered merge of a stream: lines of growing sources go out in the order of the batch merge.

The frontier is the least of the sources' running maxima: no source can bring a line before it. A
micro-batch's lines get their merge keys, join those held back, and what is before the frontier goes out,
sorted; the rest is held for later batches. So the batches one after another are the stable merge of all
lines. State is two tables for each batch in the stream's folder: the sources (running maximum, last
timestamp, batch of their last line) and the held lines; a batch reads those of the batch before and
writes its own, so a batch that is run again gives the same. Lines are keyed in chunks and
sorted in ranges, so a source that brings most lines is many tasks.

A source that was silent for `idle` batches holds nobody back. What it, or a source that comes later, brings
before the frontier goes out at once and is marked late: no line is lost. flush() ends the merge: all held lines go out.
"""

from __future__ import annotations

from collections.abc import Callable

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from weft.functions.timestamps import TimestampOptions
from weft.operators.storage import deleted, stored
from weft.operators.timeline import with_running
from weft.plans.merge import parse_lines

ROW = "file_idx string, path string, line_no bigint, line string, eol string, ts_ns bigint, level int, block_ts bigint, merge_key bigint"
SOURCES = "file_idx string, high bigint, last bigint, seen bigint, frontier bigint"
#: Chunks of line numbers, which are about bytes here.
CHUNK = 8_000_000
IDLE = 10


class StreamMerge:
    """folder: where the stream keeps its state. out: a folder with a Parquet table for each batch, batch=0 and so on."""

    def __init__(self, spark: SparkSession, folder: str, out: str, idle: int = IDLE, timestamps: TimestampOptions | None = None):
        self.spark, self.folder, self.out, self.idle, self.timestamps = spark, folder.rstrip("/"), out.rstrip("/"), idle, timestamps

    def writer(self, lines: DataFrame) -> DataStreamWriter:
        """Of a stream with source, path, line_no, line and eol: start it with a trigger of one's choice."""
        return lines.writeStream.foreachBatch(self.step()).option("checkpointLocation", f"{self.folder}/stream")

    def _of(self, batch: int, what: str, schema: str) -> DataFrame:
        if batch < 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/state/{batch}/{what}")

    def step(self) -> Callable[[DataFrame, int], None]:
        def run(batch: DataFrame, number: int) -> None:
            known, held = self._of(number - 1, "sources", SOURCES), self._of(number - 1, "held", ROW)
            parsed = parse_lines(batch.withColumnRenamed("source", "file_idx"), self.timestamps)
            own = with_running(parsed.select("file_idx", "path", "line_no", "line", "eol", "ts_ns", "level"), CHUNK)
            keyed = own.join(known.select("file_idx", "high", "last"), "file_idx", "left")
            keyed = keyed.withColumns({"merge_key": F.greatest("merge_key", F.coalesce("high", F.lit(0))), "block_ts": F.coalesce("block_ts", "last")}).drop("high", "last")
            rows = stored(held.unionByName(keyed.withColumn("_new", F.lit(True)), allowMissingColumns=True))
            news = rows.where("_new").groupBy("file_idx").agg(F.max("merge_key").alias("_high"), F.max_by("block_ts", "line_no").alias("_last"))
            every = known.drop("frontier").join(news, "file_idx", "full").select("file_idx", F.greatest("high", "_high").alias("high"), F.coalesce("_last", "last").alias("last"), F.when(F.col("_high").isNotNull(), F.lit(number)).otherwise(F.col("seen")).cast("bigint").alias("seen"))
            before = known.agg(F.max("frontier")).first()[0] or 0
            least = every.where(F.col("seen") > number - self.idle).agg(F.min("high")).first()[0]
            frontier = max(before, before if least is None else least)
            every.withColumn("frontier", F.lit(frontier).cast("bigint")).write.mode("overwrite").parquet(f"{self.folder}/state/{number}/sources")
            self._put(rows.where(F.col("merge_key") < frontier), number, before)
            rows.where(F.col("merge_key") >= frontier).drop("_new").write.mode("overwrite").parquet(f"{self.folder}/state/{number}/held")
            deleted(self.spark, f"{self.folder}/state/{number - 2}")

        return run

    def _put(self, rows: DataFrame, number: int, before: int) -> None:
        marked = rows.drop("_new").withColumn("late", F.col("merge_key") < before)
        marked.orderBy("merge_key", "path", "file_idx", "line_no").write.mode("overwrite").parquet(f"{self.out}/batch={number}")

    def flush(self, batch: int) -> None:
        """Puts out what the given batch, the stream's last, held back."""
        before = self._of(batch, "sources", SOURCES).agg(F.max("frontier")).first()[0] or 0
        self._put(self._of(batch, "held", ROW), batch + 1, before)

    def rows(self) -> DataFrame:
        """All lines that went out; their order is batch, merge_key, path, file_idx, line_no."""
        return self.spark.read.schema(f"{ROW}, late boolean, batch long").parquet(self.out)
