"""Counters and histograms of a merge."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.operators.render import RenderOptions, header, prefix

if TYPE_CHECKING:
    from weft.plans.merge import MergeOptions

# The histograms' upper bounds.
LINE_LENGTHS = (*range(31), *range(40, 101, 10), *range(150, 501, 50), *range(600, 1001, 100), *range(2000, 10_001, 1000), *range(20_000, 100_001, 10_000))
LINE_COUNTS = (*range(21), *range(25, 51, 5), *range(60, 101, 10))


def bucket(value: Column, levels: tuple[int, ...]) -> Column:
    """The first level that is no less than the value; NULL above all."""
    return F.try_element_at(F.filter(F.array(*map(F.lit, levels)), lambda x: x >= value), F.lit(1))


def histogram(df: DataFrame, value: str, levels: tuple[int, ...], name: str, times: str | None = None) -> DataFrame:
    """name, le (NULL: above all levels) and n of the levels that occur; the column times tells how often a row counts (else once)."""
    n = F.sum(F.col(times).cast("bigint")) if times else F.count("*")
    return df.groupBy(bucket(F.col(value), levels).alias("le")).agg(n.alias("n")).select(F.lit(name).alias("name"), "le", "n")


def cumulative(df: DataFrame) -> DataFrame:
    """A histogram with the counts up to each level; a histogram has as many rows as levels at most."""
    order = Window.partitionBy("name").orderBy(F.col("le").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("cumulative", F.sum("n").over(order))


def summary(df: DataFrame, value: str) -> DataFrame:
    v = F.col(value)
    return df.agg(F.min(v).alias("min"), F.max(v).alias("max"), F.sum(v).alias("sum"), F.count(v).alias("n"))


def event_sizes(timeline: DataFrame) -> DataFrame:
    """n, the lines of each event: a timestamped line and the lines without one behind it. Lines before a file's first timestamp are one event."""
    first = F.sum(F.col("ts_ns").isNotNull().cast("bigint"))
    chunk = Window.partitionBy("file_idx", "_chunk").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("file_idx").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    rows = timeline.select("file_idx", "line_no", "ts_ns", F.floor(F.col("line_no") / 100_000).alias("_chunk"))
    carried = rows.groupBy("file_idx", "_chunk").agg(first.alias("_n")).select("file_idx", "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    events = rows.withColumn("_own", first.over(chunk)).join(carried, ["file_idx", "_chunk"]).withColumn("event", F.col("_before") + F.col("_own"))
    return events.groupBy("file_idx", "event").agg(F.count("*").alias("n"))


def block_sizes(positioned: DataFrame) -> DataFrame:
    """n, the lines of each block of rows from one file (block_id)."""
    return positioned.groupBy("block_id").agg(F.count("*").alias("n"))


def counter_columns(options: RenderOptions, width: int = 0) -> list[Column]:
    """The line and byte counters of timeline rows with body (and block_start for block headers), as aggregates."""
    of = lambda **on: F.sum(F.octet_length(prefix(RenderOptions(timestamp_format=options.timestamp_format, **on), width))).cast("bigint") if on else F.lit(0)
    blocks = F.sum(F.when(F.col("block_start"), F.octet_length(header(F.col("alias")))).otherwise(0)) if options.write_block_alias else F.lit(0)
    parts = {
        "lines_read": F.count("*"),
        "lines_with_timestamp": F.count("ts_ns"),
        "lines_without_timestamp": F.count_if(F.col("ts_ns").isNull()),
        "bytes_read": F.sum(F.octet_length("line") + F.octet_length("eol")),
        "bytes_raw": F.sum(F.octet_length("body") + F.octet_length("eol")),
        "bytes_timestamps": of(write_timestamp=True) if options.write_timestamp else of(),
        "bytes_levels": of(write_level=True) if options.write_level else of(),
        "bytes_line_alias": of(write_line_alias=True) if options.write_line_alias else of(),
        "bytes_block_alias": blocks,
        "bytes_missing_newlines": F.count_if(~F.col("eol").endswith("\n")),
    }
    return [F.coalesce(v, F.lit(0)).cast("bigint").alias(k) for k, v in parts.items()]


def with_totals(counted: DataFrame) -> DataFrame:
    total = F.col("bytes_raw") + F.col("bytes_timestamps") + F.col("bytes_levels") + F.col("bytes_line_alias") + F.col("bytes_block_alias") + F.col("bytes_missing_newlines")
    return counted.withColumn("bytes_output", total).withColumn("bytes_overhead", F.col("bytes_output") - F.col("bytes_raw"))


def counters(rendered: DataFrame, options: RenderOptions, width: int = 0) -> DataFrame:
    """One row of counter_columns() with their totals."""
    return with_totals(rendered.agg(*counter_columns(options, width)))


def input_counters(unbounded: DataFrame, options: MergeOptions) -> DataFrame:
    """One row of what was read of all lines of a timeline without bounds: lines and bytes read, read and skipped, not read.

    A file is not read on from its first line beyond `until`; what `since` leaves out was read and skipped.
    """
    size = F.octet_length("line") + F.octet_length("eol")
    beyond, skipped = _left_out(options)
    parts = {}
    for name, on in (("read", ~beyond), ("skipped", ~beyond & skipped), ("not_read", beyond)):
        parts[f"lines_{name}"], parts[f"bytes_{name}"] = F.count_if(on), F.sum(F.when(on, size))
    parts["lines_processed"] = F.count_if(~beyond & ~skipped)
    parts["bytes_input"] = F.sum(size)
    return unbounded.agg(*[F.coalesce(v, F.lit(0)).cast("bigint").alias(k) for k, v in parts.items()])


def _left_out(options: MergeOptions) -> tuple[Column, Column]:
    beyond = F.lit(False) if options.until is None else F.col("merge_key") > options.until
    if options.since is None:
        return beyond, F.lit(False)
    if options.drop_orphans:
        return beyond, F.coalesce(F.col("block_ts") < options.since, F.lit(True))
    return beyond, F.coalesce(F.col("ts_ns") < options.since, F.lit(False))


def skipped_sizes(unbounded: DataFrame, blocks: DataFrame, options: MergeOptions) -> DataFrame:
    """n, the lines skipped before a block of output, and times, the blocks that it holds for: a file skips all before its first, none before its others."""
    beyond, skipped = _left_out(options)
    of_file = unbounded.groupBy("file_idx").agg(F.count_if(~beyond & skipped).alias("n"), F.count_if(~beyond & ~skipped).alias("_kept"))
    first = of_file.where("n > 0 OR _kept > 0").select("n", F.lit(1).cast("bigint").alias("times"))
    each = blocks.groupBy("file_idx").agg(F.countDistinct("block_id").alias("_blocks"))
    rest = each.where("_blocks > 1").select(F.lit(0).cast("bigint").alias("n"), (F.col("_blocks") - 1).alias("times"))
    return first.unionByName(rest)


def as_rows(one: DataFrame) -> DataFrame:
    """A row of counters as name, value rows."""
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in one.columns])
    return one.select(F.explode(pairs).alias("p")).select("p.name", "p.value")


def human(value: float, step: int = 1000, units: tuple[str, ...] = ("", "K", "M", "G", "T", "P")) -> str:
    """A number with two digits and a unit; bytes take step=1024."""
    k = 0
    while abs(value) >= step and k < len(units) - 1:
        value, k = value / step, k + 1
    return f"{value:.2f} {units[k]}".strip() if k else f"{value:g}"


def human_time(ns: int) -> str:
    """A duration with three digits in the largest unit that it fills, up to seconds."""
    for size, unit in ((1_000_000_000, "s"), (1_000_000, "ms"), (1000, "µs")):
        if abs(ns) >= size:
            return f"{ns / size:.3f} {unit}"
    return f"{ns} ns"


def per_second(n: float, ns: int, step: int = 1000) -> str:
    """A speed with its unit; 0 of no time."""
    return f"{human(n / ns * 1e9 if ns else 0.0, step)}/s"


def share(part: float, whole: float) -> float:
    """Percent, or 0 of nothing."""
    return 100 * part / whole if whole else 0.0
