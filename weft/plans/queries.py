"""The registered queries over the driver's tables, each with DuckDB SQL for the same rows.

`events` stands for five sources, one for each event type; `conversations` has multi-line texts, whose
further lines are continuation lines; the paths of `pages` stand for a file catalogue.
"""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import tarfile
import uuid
import zipfile
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import levels, paths
from weft.functions.local_time import with_local_zone
from weft.functions.timestamps import TimestampOptions, format_as, format_timestamp, with_timestamps
from weft.functions.yearless import with_further_timestamps, with_years
from weft.operators import metrics, timeline
from weft.operators.asof import asof_join
from weft.operators.storage import shared_dir
from weft.operators.render import RenderOptions, render, with_body
from weft.plans.merge import Merge, MergeOptions, build_timeline, parse_lines, positioned
from weft.sources import scan
from weft.sources.listing import list_sources
from weft.sources.match import ARCHIVES, Matcher, read_ignore_file
from weft.sources.stores import store_of
from weft.streaming import growing
from weft.streaming.merge import StreamMerge
from weft.streaming.timeline import event_counts, keyed_writer

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

TYPES = ("click", "error", "purchase", "signup", "view")
LEVEL_OF = {"click": "INFO", "error": "ERROR", "purchase": "NOTICE", "signup": "WARN", "view": "DEBUG"}
_CASE = "CASE event_type " + " ".join(f"WHEN '{t}' THEN '{LEVEL_OF[t]}'" for t in TYPES) + " END"
_INDEX = "CASE event_type " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(TYPES)) + " END"
_TEXT = "strftime(ts, '%Y-%m-%d %H:%M:%S.%f')"
_BODY = "'event ' || event_id || ' of user ' || user_id"
#: One row for each event: its source, place in it, nanoseconds, level and line.
_E = f"e AS (SELECT event_id, ts, user_id, event_type, {_INDEX} AS file_idx, event_id AS line_no, epoch_us(ts) * 1000 AS ns, {_CASE} AS lv, event_type || '.log' AS alias, {_TEXT} || ' | ' || {_CASE} || ' | ' || {_BODY} AS line FROM events)"
_LABEL = "CASE lv WHEN 'NOTICE' THEN 'NOTE  ' ELSE rpad(lv, 6, ' ') END"
_LEVEL = "CAST(list_position(['TRACE','DEBUG','INFO','NOTICE','WARN','ERROR','FATAL'], lv) AS INTEGER)"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _micros(ts: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), ts)


def _pick(values: dict[str, object]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("event_type"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    return e.withColumns({"file_idx": _pick({t: i for i, t in enumerate(TYPES)}).cast("int"), "line_no": F.col("event_id"), "lv": _pick(LEVEL_OF), "alias": F.concat("event_type", F.lit(".log")), "eol": F.lit("\n")})


def _stamp(pattern: str) -> Column:
    return F.date_format("ts", pattern)


def _body() -> Column:
    return F.concat(F.lit("event "), F.col("event_id").cast("string"), F.lit(" of user "), F.col("user_id").cast("string"))


def _lines(spark: SparkSession, sf_dir: str, line: Column | None = None, options: TimestampOptions | None = None) -> DataFrame:
    """Parsed lines of events."""
    text = line if line is not None else F.concat(_stamp("yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(" | "), "lv", F.lit(" | "), _body())
    return parse_lines(_events(spark, sf_dir).withColumn("line", text), options)


# Merging


@query("merge_stable", f"WITH {_E} SELECT event_id, ns AS ts_ns, ns AS merge_key, row_number() OVER (ORDER BY ns, file_idx, line_no) - 1 AS out_pos FROM e")
def merge_stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positioned(build_timeline(_lines(spark, sf_dir))).select("event_id", "ts_ns", "merge_key", "out_pos")


_SHUFFLED = f"{_E}, s AS (SELECT *, (event_id * 7919) % 10007 * 10000000 + event_id AS k FROM e), r AS (SELECT *, max(ns) OVER (PARTITION BY file_idx ORDER BY k ROWS UNBOUNDED PRECEDING) AS merge_key FROM s)"


def _shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).withColumn("line_no", (F.col("event_id") * 7919) % 10007 * 10_000_000 + F.col("event_id"))


@query("merge_out_of_order", f"WITH {_SHUFFLED} SELECT event_id, ns AS ts_ns, merge_key, row_number() OVER (ORDER BY merge_key, file_idx, k) - 1 AS out_pos FROM r")
def merge_out_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positioned(build_timeline(_shuffled(spark, sf_dir))).select("event_id", "ts_ns", "merge_key", "out_pos")


_HOURS = f"{_E}, h AS (SELECT *, epoch_us(date_trunc('hour', ts)) * 1000 AS hns FROM e)"


def _hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir, F.concat(_stamp("yyyy-MM-dd HH:00:00"), F.lit(" | "), "lv", F.lit(" | "), _body()))


@query("merge_ties", f"WITH {_HOURS} SELECT event_id, hns AS merge_key, row_number() OVER (ORDER BY hns, file_idx, line_no) - 1 AS out_pos FROM h")
def merge_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positioned(build_timeline(_hourly(spark, sf_dir))).select("event_id", "merge_key", "out_pos")


@query("merge_replay")
def merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positioned(build_timeline(_hourly(spark, sf_dir)), "replay").select("event_id", "merge_key", "out_pos")


_C = r"""c AS (SELECT conv_id, turn, role, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM conversations),
t AS (SELECT *, CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END AS file_idx, (conv_id * 1000 + turn) * 100000 + pos AS line_no, CASE WHEN pos = 0 THEN (1700000000 + conv_id * 60 + turn) * 1000000000 END AS ns FROM c),
w AS (SELECT *, coalesce(max(ns) OVER (PARTITION BY file_idx ORDER BY line_no ROWS UNBOUNDED PRECEDING), 0) AS merge_key, last_value(ns IGNORE NULLS) OVER (PARTITION BY file_idx ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS block_ts FROM t)"""


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of conversations: the first of a turn has a time, the others continue it."""
    c = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    seconds = F.lit(1_700_000_000) + F.col("conv_id") * 60 + F.col("turn")
    stamp = F.substring(format_timestamp(seconds * 1_000_000_000), 1, 19)
    index = F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1).otherwise(2)
    lines = c.withColumns({"file_idx": index, "line_no": (F.col("conv_id") * 1000 + F.col("turn")) * 100_000 + F.col("pos"), "line": F.when(F.col("pos") == 0, F.concat(stamp, F.lit(" "), "line")).otherwise(F.concat(F.lit("  "), "line"))})
    stamped = with_timestamps(lines)
    return stamped.withColumn("ts_ns", F.when(F.col("pos") == 0, F.col("ts_ns")))


@query("merge_continuation", f"WITH {_C} SELECT conv_id, turn, CAST(pos AS BIGINT) AS pos, block_ts, merge_key, row_number() OVER (ORDER BY merge_key, file_idx, line_no) - 1 AS out_pos FROM w")
def merge_continuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positioned(build_timeline(_turns(spark, sf_dir))).select("conv_id", "turn", F.col("pos").cast("bigint").alias("pos"), "block_ts", "merge_key", "out_pos")


@query("merge_no_ts_first", f"WITH {_E}, n AS (SELECT *, CASE WHEN event_type = 'view' THEN 0 ELSE ns END AS k FROM e) SELECT event_id, k AS merge_key, row_number() OVER (ORDER BY k, file_idx, line_no) - 1 AS out_pos FROM n")
def merge_no_ts_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.when(F.col("event_type") == "view", _body()).otherwise(F.concat(_stamp("yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(" "), _body()))
    return positioned(build_timeline(_lines(spark, sf_dir, line))).select("event_id", "merge_key", "out_pos")


# Time bounds

SINCE, UNTIL = 1_704_700_000_000_000_000, 1_705_500_000_000_000_000


CUT = 1_706_650_000_000_000_000


@query("until_cut", f"WITH {_SHUFFLED} SELECT event_id, merge_key FROM r WHERE merge_key <= {CUT}")
def until_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_timeline(_shuffled(spark, sf_dir), MergeOptions(until=CUT)).select("event_id", "merge_key")


_MIDDLE = 1_700_001_800_000_000_000


@query("since_keep_continuation", f"WITH {_C} SELECT conv_id, turn, CAST(pos AS BIGINT) AS pos FROM w WHERE ns IS NULL OR ns >= {_MIDDLE}")
def since_keep_continuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_timeline(_turns(spark, sf_dir), MergeOptions(since=_MIDDLE)).select("conv_id", "turn", F.col("pos").cast("bigint").alias("pos"))


@query("since_drop_orphans", f"WITH {_C} SELECT conv_id, turn, CAST(pos AS BIGINT) AS pos FROM w WHERE block_ts >= {_MIDDLE}")
def since_drop_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_timeline(_turns(spark, sf_dir), MergeOptions(since=_MIDDLE, drop_orphans=True)).select("conv_id", "turn", F.col("pos").cast("bigint").alias("pos"))


@query("time_range", f"WITH {_E} SELECT event_id, ns AS ts_ns FROM e WHERE ns BETWEEN {SINCE} AND {UNTIL}")
def time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_timeline(_lines(spark, sf_dir), MergeOptions(since=SINCE, until=UNTIL)).select("event_id", "ts_ns")


# Timestamps


def _parsing(name: str, line: Callable[[], Column], ns: str, start: str, end: str, options: TimestampOptions | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return with_timestamps(_events(spark, sf_dir).withColumn("line", line()), options=options).select("event_id", "ts_ns", "ts_start", "ts_end")

    run.__name__ = name
    query(name, f"WITH {_E} SELECT event_id, CAST({ns} AS BIGINT) AS ts_ns, CAST({start} AS INTEGER) AS ts_start, CAST({end} AS INTEGER) AS ts_end FROM e")(run)


_SECOND, _MILLI = "ns // 1000000000 * 1000000000", "ns // 1000000 * 1000000"


def _with(pattern: str, before: str = "", after: str = " message") -> Callable[[], Column]:
    return lambda: F.concat(F.lit(before), _stamp(pattern), F.lit(after))


_parsing("parse_iso", _with("yyyy-MM-dd'T'HH:mm:ss.SSSSSS", after="Z message"), "ns", "0", "27")
_parsing("parse_slash", _with("yyyy/MM/dd HH:mm:ss"), _SECOND, "0", "19")
_parsing("parse_compact", _with("yyyyMMdd HH:mm:ss.SSSSSS", "I"), "ns", "1", "25")
_parsing("parse_two_digit_year", _with("yy-M-d HH:mm:ss", after="[INFO] message"), _SECOND, "0", "length(strftime(ts, '%y-%-m-%-d %H:%M:%S'))")
_parsing("parse_frac_comma", _with("yyyy-MM-dd HH:mm:ss,SSS"), _MILLI, "0", "23")
_parsing("parse_space_millis", _with("yyyy-MM-dd HH:mm:ss SSS"), _MILLI, "0", "23")
_parsing("parse_ctime", _with("EEE MMM dd HH:mm:ss 'CST' yyyy"), _SECOND, "0", "28")
_parsing("parse_tz_offset", _with("yyyy-MM-dd HH:mm:ss", after="+05:30 message"), f"{_SECOND} - 19800000000000", "0", "25")
_parsing("parse_ignore_tz", _with("yyyy-MM-dd HH:mm:ss", after="+05:30 message"), _SECOND, "0", "25", TimestampOptions(ignore_timezone=True))
_parsing("parse_prefixed", _with("yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "<165> ", "Z message"), "ns", "6", "33")
_parsing("parse_none", lambda: _body(), "NULL", "NULL", "NULL")
_parsing("parse_day_overflow", lambda: F.concat(F.lit("2024-02-3"), (F.col("event_id") % 2).cast("string"), F.lit(" 10:00:00 message")), "(1709287200 + event_id % 2 * 86400) * 1000000000", "0", "19")
_parsing("parse_search_limit", _with("yyyy-MM-dd HH:mm:ss", "x" * 60), "NULL", "NULL", "NULL", TimestampOptions(search_limit=60))

_parsing("parse_min_length", _with("yyyy-MM-dd HH:mm:ss"), "NULL", "NULL", "NULL", TimestampOptions(shortest=60))


@query("format_ts", f"WITH {_E} SELECT event_id, {_TEXT} || lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0') || ' ' AS text FROM e")
def format_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", format_timestamp(_micros(F.col("ts")) * 1000 + F.col("event_id") % 1000).alias("text"))


# Levels


def _leveling(name: str, line: Callable[[], Column], level: str = _LEVEL) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _lines(spark, sf_dir, line()).select("event_id", "level")

    run.__name__ = name
    query(name, f"WITH {_E} SELECT event_id, CAST({level} AS INTEGER) AS level FROM e")(run)


_S = "yyyy-MM-dd HH:mm:ss,SSS"
_leveling("level_pipe", lambda: F.concat(_stamp(_S), F.lit(" | "), "lv", F.lit(" | "), _body()))
_leveling("level_bracket", lambda: F.concat(F.lit("["), _stamp(_S), F.lit("] ["), "lv", F.lit("] "), _body()))
_leveling("level_bare", lambda: F.concat(_stamp(_S), F.lit(" "), F.lower("lv"), F.lit(" "), _body()))
_leveling("level_glog", lambda: F.concat(F.substring("lv", 1, 1), _stamp("yyyyMMdd HH:mm:ss.SSSSSS"), F.lit(" 123 "), _body()), f"CASE WHEN lv = 'NOTICE' THEN 0 ELSE {_LEVEL} END")
_leveling("level_alias_words", lambda: F.concat(_stamp(_S), F.lit(" "), _pick({"click": "warning", "error": "SEVERE", "purchase": "Critical", "signup": "trace", "view": "FATAL"}), F.lit(": "), _body()), "CASE event_type WHEN 'click' THEN 5 WHEN 'error' THEN 6 WHEN 'purchase' THEN 7 WHEN 'signup' THEN 1 ELSE 7 END")
_leveling("level_reject_suffix", lambda: F.concat(_stamp(_S), F.lit(" "), "lv", F.lit("S_x "), _body()), "0")
_leveling("level_without_timestamp", lambda: F.concat("lv", F.lit(" "), _body()))


@query("level_label", f"WITH {_E} SELECT event_id, {_LABEL} AS label, lv AS name FROM e")
def level_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("event_id", levels.label(F.col("level")).alias("label"), levels.name(F.col("level")).alias("name"))


@query("level_counts", f"WITH {_E} SELECT {_LEVEL} AS level, count(*) AS n FROM e GROUP BY ALL")
def level_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).groupBy("level").agg(F.count("*").alias("n"))


# Rendering

_WIDTH = max(len(t) for t in TYPES) + 4
_STABLE = "row_number() OVER (ORDER BY ns, file_idx, line_no) - 1"


def _rendering(name: str, options: RenderOptions, text: str, line: Callable[[], Column] | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return render(positioned(build_timeline(_lines(spark, sf_dir, line() if line else None))), options, _WIDTH).select("out_pos", "text")

    run.__name__ = name
    query(name, f"WITH {_E} SELECT {_STABLE} AS out_pos, {text} AS text FROM e")(run)


_PREFIX = f"{_TEXT} || '000 '"
_rendering("render_ts", RenderOptions(write_timestamp=True), f"{_PREFIX} || line")
_rendering("render_level", RenderOptions(write_level=True), f"{_LABEL} || line")
_rendering("render_alias_padded", RenderOptions(write_line_alias=True), f"rpad(alias, {_WIDTH}, ' ') || ' - ' || line")
_rendering("strip_ts", RenderOptions(strip_timestamp=True), f"lv || ' | ' || {_BODY}")
_rendering("strip_level", RenderOptions(strip_level=True), f"{_TEXT} || ' | | ' || {_BODY}")
_rendering("strip_both", RenderOptions(strip_timestamp=True, strip_level=True), f"'| ' || {_BODY}")
_rendering("strip_ts_bracket", RenderOptions(strip_timestamp=True), f"'[' || lv || '] ' || {_BODY}", lambda: F.concat(F.lit("["), _stamp("yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("] ["), "lv", F.lit("] "), _body()))
_rendering("strip_ts_prefix_space", RenderOptions(strip_timestamp=True), f"'<165> ' || {_BODY}", lambda: F.concat(F.lit("<165> "), _stamp("yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z "), _body()))

_BLOCKS = f"{_E}, p AS (SELECT *, {_STABLE} AS out_pos FROM e), l AS (SELECT *, coalesce(alias <> lag(alias) OVER (ORDER BY out_pos), true) AS starts FROM p), b AS (SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (ORDER BY out_pos ROWS UNBOUNDED PRECEDING) - 1 AS block_id FROM l)"


def _blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.with_blocks(positioned(build_timeline(_lines(spark, sf_dir))))


@query("render_block_header", f"WITH {_BLOCKS} SELECT out_pos, 1 AS part, line AS text FROM b UNION ALL SELECT out_pos, 0, chr(10) || '--- ' || alias || ' ---' FROM b WHERE starts")
def render_block_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(_blocked(spark, sf_dir), RenderOptions(write_block_alias=True))


_ALL = RenderOptions(write_timestamp=True, write_level=True, write_line_alias=True, write_block_alias=True, strip_timestamp=True, strip_level=True)


@query("render_all", f"WITH {_BLOCKS} SELECT out_pos, 1 AS part, {_PREFIX} || {_LABEL} || rpad(alias, {_WIDTH}, ' ') || ' - | ' || {_BODY} AS text FROM b UNION ALL SELECT out_pos, 0, chr(10) || '--- ' || alias || ' ---' FROM b WHERE starts")
def render_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(_blocked(spark, sf_dir), _ALL, _WIDTH)


@query("blocks", f"WITH {_BLOCKS} SELECT CAST(block_id AS BIGINT) AS block_id, min(alias) AS alias, min(out_pos) AS first_pos, count(*) AS n FROM b GROUP BY block_id")
def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocked(spark, sf_dir).groupBy("block_id").agg(F.min("alias").alias("alias"), F.min("out_pos").alias("first_pos"), F.count("*").alias("n"))


# Metrics


def _bucket_sql(value: str, bounds: tuple[int, ...]) -> str:
    return f"list_min(list_filter([{','.join(map(str, bounds))}], lambda x: x >= {value}))"


@query("block_line_hist", f"WITH {_BLOCKS}, s AS (SELECT count(*) AS c FROM b GROUP BY block_id) SELECT 'BlockLineCounts' AS name, CAST({_bucket_sql('c', metrics.LINE_COUNTS)} AS INTEGER) AS le, count(*) AS n FROM s GROUP BY ALL")
def block_line_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.histogram(metrics.block_sizes(_blocked(spark, sf_dir)), "n", metrics.LINE_COUNTS, "BlockLineCounts")


@query("event_line_hist", f"WITH {_C}, s AS (SELECT count(*) AS c FROM w GROUP BY file_idx, conv_id, turn) SELECT 'SuccessiveLineCounts' AS name, CAST({_bucket_sql('c', metrics.LINE_COUNTS)} AS INTEGER) AS le, count(*) AS n FROM s GROUP BY ALL")
def event_line_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.histogram(metrics.event_sizes(build_timeline(_turns(spark, sf_dir))), "n", metrics.LINE_COUNTS, "SuccessiveLineCounts")


_LENGTHS = f"t AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents), h AS (SELECT CAST({_bucket_sql('strlen(line)', metrics.LINE_LENGTHS)} AS INTEGER) AS le, count(*) AS n FROM t GROUP BY ALL)"


def _document_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    return metrics.histogram(lines.select(F.octet_length("line").alias("n")), "n", metrics.LINE_LENGTHS, "LineLengths")


@query("line_length_hist", f"WITH {_LENGTHS} SELECT 'LineLengths' AS name, le, n FROM h")
def line_length_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _document_lengths(spark, sf_dir)


@query("hist_cumulative", f"WITH {_LENGTHS} SELECT 'LineLengths' AS name, le, n, CAST(sum(n) OVER (ORDER BY le NULLS LAST ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative FROM h")
def hist_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.cumulative(_document_lengths(spark, sf_dir))


@query("length_summary", "SELECT CAST(min(strlen(line)) AS INTEGER) AS min, CAST(max(strlen(line)) AS INTEGER) AS max, CAST(sum(strlen(line)) AS BIGINT) AS sum, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)")
def length_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    return metrics.summary(lines.select(F.octet_length("line").alias("n")), "n")


_COUNTED = RenderOptions(write_timestamp=True, write_level=True, write_line_alias=True, write_block_alias=True)
_RAW, _HEADERS = "sum(strlen(line) + 1)", "sum(CASE WHEN starts THEN strlen(alias) + 10 ELSE 0 END)"


@query(
    "counters",
    f"WITH {_BLOCKS}, a AS (SELECT count(*) AS lines_read, CAST({_RAW} AS BIGINT) AS bytes_raw, CAST({_HEADERS} AS BIGINT) AS bytes_block_alias FROM b) SELECT lines_read, lines_read AS lines_with_timestamp, CAST(0 AS BIGINT) AS lines_without_timestamp, bytes_raw AS bytes_read, bytes_raw, lines_read * 30 AS bytes_timestamps, lines_read * 6 AS bytes_levels, lines_read * {_WIDTH + 3} AS bytes_line_alias, bytes_block_alias, CAST(0 AS BIGINT) AS bytes_missing_newlines, bytes_raw + lines_read * {36 + _WIDTH + 3} + bytes_block_alias AS bytes_output, lines_read * {36 + _WIDTH + 3} + bytes_block_alias AS bytes_overhead FROM a",
)
def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.counters(with_body(_blocked(spark, sf_dir), _COUNTED), _COUNTED, _WIDTH)


_BOUNDS = MergeOptions(since=SINCE, until=CUT)


@query("input_counters", f"WITH {_SHUFFLED}, i AS (SELECT merge_key > {CUT} AS beyond, ns < {SINCE} AS early, strlen(line) + 1 AS b FROM r) SELECT count(*) FILTER (NOT beyond) AS lines_read, CAST(coalesce(sum(b) FILTER (NOT beyond), 0) AS BIGINT) AS bytes_read, count(*) FILTER (NOT beyond AND early) AS lines_skipped, CAST(coalesce(sum(b) FILTER (NOT beyond AND early), 0) AS BIGINT) AS bytes_skipped, count(*) FILTER (beyond) AS lines_not_read, CAST(coalesce(sum(b) FILTER (beyond), 0) AS BIGINT) AS bytes_not_read, count(*) FILTER (NOT beyond AND NOT early) AS lines_processed, CAST(sum(b) AS BIGINT) AS bytes_input FROM i")
def input_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.input_counters(timeline.with_running(_shuffled(spark, sf_dir)), _BOUNDS)


_KEPT = f"{_E}, k AS (SELECT *, row_number() OVER (ORDER BY ns, file_idx, line_no) AS p FROM e WHERE ns BETWEEN {SINCE} AND {UNTIL}), l AS (SELECT *, coalesce(file_idx <> lag(file_idx) OVER (ORDER BY p), true) AS starts FROM k), b AS (SELECT file_idx, count(*) FILTER (starts) AS blocks FROM l GROUP BY file_idx), f AS (SELECT file_idx, count(*) FILTER (ns < {SINCE}) AS n FROM e GROUP BY file_idx HAVING count(*) FILTER (ns <= {UNTIL}) > 0)"


@query("skipped_line_hist", f"WITH {_KEPT}, v AS (SELECT n FROM f UNION ALL SELECT 0 FROM (SELECT unnest(range(blocks - 1)) FROM b)) SELECT 'SkippedLineCounts' AS name, CAST({_bucket_sql('n', metrics.LINE_COUNTS)} AS INTEGER) AS le, count(*) AS n FROM v GROUP BY ALL")
def skipped_line_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = MergeOptions(since=SINCE, until=UNTIL)
    run = timeline.with_running(_lines(spark, sf_dir))
    kept = timeline.with_blocks(positioned(timeline.bounded(run, SINCE, UNTIL)), "file_idx")
    return metrics.histogram(metrics.skipped_sizes(run, kept, options), "n", metrics.LINE_COUNTS, "SkippedLineCounts", "times")


# Catalogues

_P = "p AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+/(.*)$', 1) AS path FROM pages)"


def _filtering(name: str, patterns: list[str], sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = _table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://[^/]+/(.*)$", 1).alias("path"))
        return p.where(paths.includes(F.col("path"), patterns))

    run.__name__ = name
    query(name, f"WITH {_P} SELECT page_id, path FROM p WHERE {sql}")(run)


_filtering("file_filter", ["*1.html", "*[2-4].html"], "NOT regexp_matches(path, '[1-4]\\.html$')")
_filtering("file_filter_negation", ["*", "!*5*"], "regexp_matches(path, '(^|/)[^/]*5[^/]*$')")
_filtering("file_filter_doublestar", ["**", "!**/*7*"], "regexp_matches(path, '(^|/)[^/]*7[^/]*$')")
_filtering("file_filter_root", ["/*1*"], "NOT regexp_matches(path, '^[^/]*1[^/]*$')")


@query("file_filter_archives", f"WITH {_P}, x AS (SELECT page_id, path || ['.zip', '.log', '.tgz', '.gz.txt', '.XZ'][page_id % 5 + 1] AS path FROM p) SELECT page_id, path FROM x WHERE NOT regexp_matches(path, '\\.(zip|tar|gz|rar|7z|tgz|bz2|tbz2|xz|txz)$')")
def file_filter_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://[^/]+/(.*)$", 1).alias("path"))
    ends = F.array(*map(F.lit, (".zip", ".log", ".tgz", ".gz.txt", ".XZ")))
    named = p.select("page_id", F.concat("path", F.element_at(ends, (F.col("page_id") % 5 + 1).cast("int"))).alias("path"))
    return named.where(paths.includes(F.col("path"), ARCHIVES))


@query("alias_resolve", f"WITH {_P} SELECT page_id, CASE WHEN regexp_matches(path, '(^|/)[^/]*1[^/]*$') THEN 'one' WHEN regexp_matches(path, '(^|/)[^/]*2[^/]*$') THEN 'two' ELSE path END AS alias FROM p")
def alias_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://[^/]+/(.*)$", 1).alias("path"))
    return p.select("page_id", paths.alias(F.col("path"), {"*1*": "one", "*2*": "two"}).alias("alias"))


# Files


_PART = 250  # events of a file
_HALF = _PART // 2


def _written(spark: SparkSession, sf_dir: str, write: Callable[[str, list[str], list[str]], bytes], names: Callable[[int], str], file: Column | None = None, folder: str | None = None) -> str:
    """A folder of files that tasks write: one for each _PART events (or value of file), in their order. write: its name, the lines and their types."""
    folder = folder or f"{shared_dir(spark)}/sources-{uuid.uuid4().hex}"
    file = F.floor(F.col("event_id") / _PART) if file is None else file

    def put(key: tuple, rows: pa.Table) -> pa.Table:
        name = names(key[0].as_py())
        rows = rows.sort_by("event_id")
        system, inner = store_of(f"{folder}/{name}")
        system.create_dir(inner.rpartition("/")[0], recursive=True)
        with system.open_output_stream(inner, compression=None) as f:
            f.write(write(name, rows["line"].to_pylist(), rows["event_type"].to_pylist()))
        return pa.table({"name": [name]})

    lines = _logged(_events(spark, sf_dir)).select("event_id", "event_type", "line", file.alias("_file"))
    lines.groupBy("_file").applyInArrow(put, "name string").count()  # the files are the result
    return folder


def _logged(e: DataFrame) -> DataFrame:
    return e.withColumn("line", F.concat(_stamp("yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(" | "), F.col("lv"), F.lit(" | "), _body()))


_KINDS = (".log", ".log.gz", ".log.bz2", ".log.xz", ".zip", ".tar", ".tar.xz")


def _tarred(members: list[tuple[str, bytes]], mode: str) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as t:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def _source(name: str, lines: list[str], _: list[str]) -> bytes:
    """A source of the kind that its name tells: archives have two members of lines and one to leave out; xz files have many blocks."""
    ended = [f"{x}\n".encode() for x in lines]
    members = [("in/a.log", b"".join(ended[:_HALF])), ("left.tmp", b"out"), ("in/b.log", b"".join(ended[_HALF:]))]
    if name.endswith(".zip"):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for member, data in members:
                z.writestr(member, data)
        return out.getvalue()
    if ".tar" in name:
        return _tarred(members, "w:xz" if name.endswith("xz") else "w")
    if name.endswith(".xz"):
        return b"".join(lzma.compress(b"".join(ended[i : i + 40])) for i in range(0, len(ended), 40))
    data = b"".join(ended)
    if name.endswith(".log"):
        return data.replace(b"\n", b"\r\n")[:-2]
    return gzip.compress(data) if name.endswith(".gz") else bz2.compress(data, 1)


def _archives(spark: SparkSession, sf_dir: str) -> str:
    return _written(spark, sf_dir, _source, lambda k: f"{k % 3}/{k:06d}{_KINDS[k % len(_KINDS)]}")


_CUT = f"{_E}, k AS (SELECT *, event_id // {_PART} AS k, event_id % {_PART} AS i FROM e), s AS (SELECT *, {list(_KINDS)}[CAST(k % {len(_KINDS)} + 1 AS INTEGER)] AS kind FROM k)"
_SOURCES = f"{_CUT}, f AS (SELECT *, (k % 3) || '/' || lpad(CAST(k AS VARCHAR), 6, '0') || kind || CASE WHEN kind IN ('.zip', '.tar', '.tar.xz') THEN CASE WHEN i < {_HALF} THEN '!/in/a.log' ELSE '!/in/b.log' END ELSE '' END AS source FROM s)"


@query("archive_scan", f"WITH {_SOURCES} SELECT source AS alias, row_number() OVER (PARTITION BY source ORDER BY event_id) - 1 AS line_no, line, ns AS ts_ns FROM f")
def archive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events from files of every kind, cut in ranges far smaller than they are."""
    m = Merge(spark, [_archives(spark, sf_dir)], MergeOptions(split_bytes=4_001, packed_bytes=1_009), exclude=["*.tmp"])
    return m.parsed().join(m.files.select("file_idx", "alias"), "file_idx").select("alias", "line_no", "line", "ts_ns")


_SIZE = "CAST(sum(octet_length(encode(line)) + CASE kind WHEN '.log' THEN 2 ELSE 1 END) - max(CASE kind WHEN '.log' THEN 2 ELSE 0 END) AS BIGINT)"


@query("file_listing", f"WITH {_SOURCES} SELECT source AS alias, CASE kind WHEN '.log' THEN 'plain' WHEN '.zip' THEN 'zip' ELSE 'tar' END AS kind, {_SIZE} AS size FROM f WHERE kind IN ('.log', '.zip', '.tar', '.tar.xz') AND k % 3 <> 2 GROUP BY source, kind")
def file_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with their sizes by rules on folders, files and members; archives are indexed, not read."""
    return list_sources([_archives(spark, sf_dir)], Matcher(["*.tmp", "*.gz", "*.bz2", "*.xz", "!*.tar.xz", "/2/**"]), spark=spark).to_df(spark).select("alias", "kind", "size")


@query("lines_of_sources", f"WITH {_SOURCES} SELECT source AS alias, line FROM f WHERE source LIKE '0/%' AND kind IN ('.log', '.zip')")
def lines_of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The data source itself; the predicate on aliases chooses sources before any is opened."""
    scan.register(spark)
    rows = spark.read.format("weft_lines").option("exclude", '["*.tmp", "*.log.*", "*.tar*"]').option("split_bytes", 3_001).load(_archives(spark, sf_dir))
    return rows.where("error IS NULL").where(F.col("alias").startswith("0/")).select("alias", "line")


def _repeated_members(name: str, lines: list[str], types: list[str]) -> bytes:
    """A tar with a member for each event type, all of one name."""
    return _tarred([("x.log", "".join(f"{x}\n" for x, y in zip(lines, types, strict=True) if y == t).encode()) for t in TYPES], "w:gz")


@query("archive_repeated_members", f"WITH {_CUT} SELECT CAST(k * 5 + file_idx AS INTEGER) AS file_idx, row_number() OVER (PARTITION BY k, file_idx ORDER BY event_id) - 1 AS line_no, line FROM s")
def archive_repeated_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _written(spark, sf_dir, _repeated_members, lambda k: f"{k:06d}.tgz")
    return Merge(spark, [folder]).parsed().select("file_idx", "line_no", "line")


def _damaged(name: str, lines: list[str], _: list[str]) -> bytes:
    """Half of the lines, then what can't be decoded any more."""
    half = len(lines) // 2
    good, bad = (b"".join(f"{x}\n".encode() for x in own) for own in (lines[:half], lines[half:]))
    if name.endswith(".gz"):
        z = zlib.compressobj(wbits=31)
        return z.compress(good) + z.flush(zlib.Z_FULL_FLUSH)
    pack = bz2.compress if name.endswith(".bz2") else lzma.compress
    return pack(good) + pack(bad)[:20]


_BROKEN = (".log.gz", ".log.bz2", ".log.xz")
_CUTS = f"{_E}, k AS (SELECT event_id, line, lpad(CAST(event_id // {_PART} AS VARCHAR), 6, '0') || {list(_BROKEN)}[CAST((event_id // {_PART}) % 3 + 1 AS INTEGER)] AS name, row_number() OVER (PARTITION BY event_id // {_PART} ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY event_id // {_PART}) // 2 AS n FROM e)"


def _cut_files(spark: SparkSession, sf_dir: str) -> Merge:
    return Merge(spark, [_written(spark, sf_dir, _damaged, lambda k: f"{k:06d}{_BROKEN[k % 3]}")])


@query("source_errors", f"WITH {_CUTS} SELECT DISTINCT name, n AS line_no FROM k")
def source_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each damaged file ends: after all lines that can be decoded."""
    return _cut_files(spark, sf_dir).errors().select(F.element_at(F.split("path", "/"), -1).alias("name"), "line_no")


@query("lines_before_damage", f"WITH {_CUTS} SELECT name AS alias, i AS line_no, line FROM k WHERE i < n")
def lines_before_damage(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _cut_files(spark, sf_dir)
    return m.parsed().join(m.files.select("file_idx", "alias"), "file_idx").select("alias", "line_no", "line")


# Streaming


@query("stream_keys", f"WITH {_E} SELECT event_id, ns AS block_ts, ns AS merge_key FROM e")
def stream_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge keys with state for each source, written to the shared folder by the stream and read again."""
    source = spark.readStream.schema(_table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    line = F.concat(_stamp("yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(" "), _pick(LEVEL_OF), F.lit(" event"))
    lines = source.select(_pick({t: i for i, t in enumerate(TYPES)}).cast("int").alias("file_idx"), F.col("event_id").alias("line_no"), line.alias("line"))
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    keyed_writer(lines, folder, f"{folder}/rows", ()).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/rows").select(F.col("line_no").alias("event_id"), "block_ts", "merge_key")


@query("stream_counts", f"WITH {_E} SELECT epoch_us(date_trunc('hour', ts)) // 1000000 AS start, {_LEVEL} AS level, count(*) AS n FROM e GROUP BY ALL")
def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = spark.readStream.schema(_table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    line = F.concat(_stamp("yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(" "), _pick(LEVEL_OF), F.lit(" event"))
    name = f"stream_counts_{uuid.uuid4().hex}"
    counts = event_counts(source.select(line.alias("line")), window="1 hour")
    counts.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select(F.unix_seconds(F.col("window.start").cast("timestamp")).alias("start"), "level", "n")


_GROWING = f"{_E}, g AS (SELECT *, lpad(CAST(event_id // {5 * _PART} * 5 + event_id % 5 AS VARCHAR), 6, '0') || '.log' AS name FROM e), h AS (SELECT *, max(ns) OVER (PARTITION BY name ORDER BY event_id) AS merge_key FROM g)"


@query("stream_merge", f"WITH {_GROWING} SELECT row_number() OVER (ORDER BY merge_key, name, event_id) - 1 AS out_pos, name, line FROM h")
def stream_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that grow while a stream merges them: half of each is there at its first start, all at the second."""
    growing.register(spark)
    file, names = F.floor(F.col("event_id") / (5 * _PART)) * 5 + F.col("event_id") % 5, lambda k: f"{k:06d}.log"
    half = lambda _, lines, types: "".join(f"{x}\n" for x in lines[: len(lines) // 2]).encode() + b"2024-01-01 00:0"
    whole = lambda _, lines, types: "".join(f"{x}\n" for x in lines).encode()
    state = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    merge = StreamMerge(spark, state, f"{state}/out")
    for write in (half, whole):
        folder = _written(spark, sf_dir, write, names, file, f"{state}/in")
        stream = spark.readStream.format("weft_tail").option("split_bytes", 2_003).option("tasks", spark.sparkContext.defaultParallelism).load(folder)
        query = merge.writer(stream).trigger(availableNow=True).start()
        query.awaitTermination()
    merge.flush(query.lastProgress["batchId"])
    rows = merge.rows().withColumn("name", F.element_at(F.split("path", "/"), -1))
    return timeline.with_position(rows, ["batch", "merge_key", "path", "file_idx", "line_no"]).select("out_pos", "name", "line")


_HOUR = 3_600_000_000_000
_SLOP = f"""RECURSIVE {_E}, m AS (SELECT *, max(ns) OVER (PARTITION BY file_idx ORDER BY line_no) // {_HOUR} AS slot FROM e),
l AS (SELECT slot, max(file_idx) AS largest FROM m GROUP BY slot), t AS (SELECT m.slot, max(file_idx) AS second FROM m JOIN l ON m.slot = l.slot AND file_idx < largest GROUP BY m.slot),
s AS (SELECT l.slot, largest, second, row_number() OVER (ORDER BY l.slot) AS i FROM l LEFT JOIN t ON l.slot = t.slot),
r AS (SELECT i, slot, CAST(NULL AS INTEGER) AS first, largest AS last FROM s WHERE i = 1 UNION ALL SELECT s.i, s.slot, r.last, CASE WHEN r.last = s.largest AND s.second IS NOT NULL THEN s.second ELSE s.largest END FROM r JOIN s ON s.i = r.i + 1)"""


@query("merge_threshold", f"WITH {_SLOP} SELECT event_id, row_number() OVER (ORDER BY m.slot, CASE WHEN file_idx = first THEN 0 ELSE 1 END, file_idx, line_no) - 1 AS out_pos FROM m JOIN r ON m.slot = r.slot")
def merge_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five sources in the order up to an hour."""
    parsed = parse_lines(_logged(_events(spark, sf_dir)))
    return positioned(build_timeline(parsed), threshold=_HOUR).select("event_id", "out_pos")


_SHIFT = "INTERVAL 15 DAYS"  # so that December goes over into January


@query("parse_yearless", f"SELECT event_id, epoch(date_trunc('second', ts - {_SHIFT}))::BIGINT * 1000000000 AS ts_ns FROM events")
def parse_yearless(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five files of lines without a year, over the turn of a year, in chunks smaller than they are; a file was modified at its last line."""
    e = _events(spark, sf_dir).withColumn("ts", F.expr(f"ts - {_SHIFT}"))
    lines = e.select("event_id", "file_idx", "line_no", F.concat(F.lit("<13>"), _stamp("MMM dd HH:mm:ss"), F.lit(" host event")).alias("line"), "ts")
    files = lines.groupBy("file_idx").agg((F.max(_micros(F.col("ts"))) * 1000).alias("modified"))
    parsed = with_further_timestamps(with_timestamps(lines.drop("ts")))
    return with_years(parsed, files, 700).select("event_id", "ts_ns")


@query("parse_epoch", f"WITH {_E}, u AS (SELECT event_id, ns // [1000000000, 1000000, 1000, 1][event_id % 4 + 1] * [1000000000, 1000000, 1000, 1][event_id % 4 + 1] AS ts_ns, length(CAST(ns AS VARCHAR)) - [9, 6, 3, 0][event_id % 4 + 1] AS digits FROM e) SELECT event_id, ts_ns, CAST(1 AS INTEGER) AS ts_start, CAST(1 + digits AS INTEGER) AS ts_end FROM u")
def parse_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds, milli-, micro- and nanoseconds since 1970 in brackets."""
    unit = F.element_at(F.array(*[F.lit(x).cast("bigint") for x in (10**9, 10**6, 1000, 1)]), (F.col("event_id") % 4 + 1).cast("int"))
    number = F.call_function("div", _micros(F.col("ts")) * 1000, unit).cast("string")
    lines = _events(spark, sf_dir).withColumn("line", F.concat(F.lit("["), number, F.lit("] event")))
    return with_further_timestamps(with_timestamps(lines)).select("event_id", "ts_ns", "ts_start", "ts_end")


@query("parse_named_months", "SELECT event_id, epoch(date_trunc('second', ts))::BIGINT * 1000000000 - CASE event_id % 3 WHEN 1 THEN 5400000000000 ELSE 0 END AS ts_ns, event_id % 3 = 1 AS zoned FROM events")
def parse_named_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`7 Jan 2024 ...`, as web servers write it, and the month first."""
    form = F.when(F.col("event_id") % 3 == 0, _stamp("d MMM yyyy HH:mm:ss")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("::1 - ["), _stamp("dd/MMM/yyyy:HH:mm:ss"), F.lit(" +0130]"))).otherwise(F.concat(F.lit("at "), _stamp("MMMM d, yyyy HH:mm:ss")))
    lines = _events(spark, sf_dir).withColumn("line", F.concat(form, F.lit(" GET /")))
    return with_further_timestamps(with_timestamps(lines)).select("event_id", "ts_ns", "zoned")


@query("format_patterns", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '000Z' WHEN 1 THEN epoch_us(ts) // 1000000 || '.' || lpad(CAST(epoch_us(ts) % 1000000 * 1000 AS VARCHAR), 9, '0') ELSE strftime(ts, '%a %d %b %Y, day %j %H:%M') || ' 100%' END AS text FROM events")
def format_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    ns = _micros(F.col("ts")) * 1000
    third = F.col("event_id") % 3
    text = F.when(third == 0, format_as(ns, "iso8601")).when(third == 1, format_as(ns, "epoch")).otherwise(format_as(ns, "%a %d %b %Y, day %j %H:%M 100%%"))
    return _table(spark, sf_dir, "events").select("event_id", text.alias("text"))


@query("merge_anchored", f"WITH {_E}, a AS (SELECT max(ns) AS anchor FROM e WHERE file_idx = 0 AND event_id < 500), m AS (SELECT event_id, file_idx, line_no, CASE WHEN file_idx = 4 THEN anchor ELSE max(ns) OVER (PARTITION BY file_idx ORDER BY line_no) END AS merge_key FROM e, a) SELECT event_id, row_number() OVER (ORDER BY merge_key, file_idx, line_no) - 1 AS out_pos FROM m")
def merge_anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of five sources one has no timestamps: it stands at the file's modification."""
    e = _logged(_events(spark, sf_dir)).withColumn("line", F.when(F.col("file_idx") == 4, _body()).otherwise(F.col("line")))
    anchor = e.where("file_idx = 0 AND event_id < 500").agg((F.max(_micros(F.col("ts"))) * 1000).alias("modified"))
    files = anchor.select(F.explode(F.array(*map(F.lit, range(5)))).alias("file_idx"), "modified")
    placed = timeline.anchored(timeline.with_running(parse_lines(e)), files)
    return positioned(placed).select("event_id", "out_pos")


@query("sink_text", f"WITH {_SOURCES}, m AS (SELECT *, max(ns) OVER (PARTITION BY source ORDER BY event_id) AS merge_key FROM f) SELECT row_number() OVER (ORDER BY merge_key, source, event_id) - 1 AS out_pos, line FROM m")
def sink_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text that a merge writes, read again: files in their order are the output, and last lines have got their newline."""
    out = f"{shared_dir(spark)}/merged-{uuid.uuid4().hex}"
    with Merge(spark, [_archives(spark, sf_dir)], exclude=["*.tmp"]) as m:
        m.write(out)
    scan.register(spark)
    rows = spark.read.format("weft_lines").option("exclude", '["_SUCCESS", "*.crc"]').load(out).where("error IS NULL")
    return timeline.with_position(rows, ["source_path", "line_no"]).select("out_pos", "line")


@query("file_counts", f"WITH {_SOURCES} SELECT CAST(1 + count(DISTINCT k % 3) AS BIGINT) AS dirs_scanned, count(DISTINCT k) AS files_scanned, count(DISTINCT CASE WHEN kind <> '.log.gz' THEN source END) AS files_matched, CAST(0 AS BIGINT) AS errors FROM f")
def file_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = list_sources([_archives(spark, sf_dir)], Matcher(["*.tmp", "*.log.gz"]), spark=spark)
    row = (found.dirs_scanned, found.files_scanned, len(found.sources), len(found.errors))
    return spark.createDataFrame([row], "dirs_scanned long, files_scanned long, files_matched long, errors long")


@query("file_filter_ignore_file", f"WITH {_P} SELECT page_id, path FROM p WHERE NOT regexp_matches(path, '(^|/)[^/]*1[^/]*$') OR regexp_matches(path, '(^|/)[^/]*12[^/]*$')")
def file_filter_ignore_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules from a file in the shared folder, with comments, blank lines and an exception."""
    path = f"{shared_dir(spark)}/ignore-{uuid.uuid4().hex}"
    system, inner = store_of(path)
    system.create_dir(inner.rpartition("/")[0], recursive=True)
    with system.open_output_stream(inner) as f:
        f.write(b"# what is left out\n\n  *1*  \n!*12*\n")
    p = _table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://[^/]+/(.*)$", 1).alias("path"))
    return p.where(paths.includes(F.col("path"), read_ignore_file(path)))


@query("asof_events", f"WITH {_E}, l AS (SELECT * FROM e WHERE event_type = 'purchase'), r AS (SELECT * FROM e WHERE event_type = 'error') SELECT l.event_id, CASE WHEN l.ns - r.ns <= {24 * _HOUR} THEN r.event_id END AS last_error FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ns >= r.ns")
def asof_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each purchase the user's last error of the 24 hours before it."""
    e = _events(spark, sf_dir).select("event_id", "user_id", "event_type", (_micros(F.col("ts")) * 1000).alias("ts_ns"))
    found = asof_join(e.where("event_type = 'purchase'"), e.where("event_type = 'error'").select("user_id", "ts_ns", "event_id"), ["user_id"], order=["event_id"], tolerance=24 * _HOUR)
    return found.select("event_id", F.col("last.event_id").alias("last_error"))


_CLOCKS = "z AS (SELECT event_id, ts + INTERVAL 290 DAYS AS utc FROM events), w AS (SELECT *, utc + CASE WHEN utc < TIMESTAMP '2024-10-27 01:00:00' THEN INTERVAL 2 HOURS ELSE INTERVAL 1 HOUR END AS wall FROM z), t AS (SELECT *, wall >= TIMESTAMP '2024-10-27 02:00:00' AND wall < TIMESTAMP '2024-10-27 03:00:00' AS twice FROM w), b AS (SELECT *, CASE WHEN epoch_us(wall) - epoch_us(lag(wall) OVER (PARTITION BY twice ORDER BY event_id)) < -1800000000 THEN 1 ELSE 0 END AS step FROM t), c AS (SELECT *, max(step) OVER (PARTITION BY twice ORDER BY event_id) AS second FROM b)"


@query("parse_local_zone", f"WITH {_CLOCKS} SELECT event_id, epoch_us(wall - CASE WHEN wall < TIMESTAMP '2024-10-27 02:00:00' OR (twice AND second = 0) THEN INTERVAL 2 HOURS ELSE INTERVAL 1 HOUR END) * 1000 AS ts_ns FROM c")
def parse_local_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log by the clock of Berlin, over the night in which an hour is shown twice."""
    e = _events(spark, sf_dir).withColumn("ts", F.expr("ts + INTERVAL 290 DAYS"))
    late = F.col("ts") >= F.lit("2024-10-27 01:00:00").cast("timestamp_ntz")
    wall = e.withColumn("ts", F.when(late, F.expr("ts + INTERVAL 1 HOUR")).otherwise(F.expr("ts + INTERVAL 2 HOURS")))
    lines = wall.select("event_id", F.lit(0).alias("file_idx"), "line_no", F.concat(_stamp("yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(" x")).alias("line"))
    return with_local_zone(with_timestamps(lines), "Europe/Berlin").select("event_id", "ts_ns")
