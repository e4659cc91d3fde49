"""The merge as one plan: listed sources to lines, parsed lines, the timeline, text and metrics."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from weft.functions.levels import with_levels
from weft.functions.local_time import with_local_zone
from weft.functions.timestamps import TimestampOptions, with_timestamps
from weft.functions.yearless import with_further_timestamps, with_years
from weft.operators import metrics, replay, slop, timeline
from weft.operators.render import RenderOptions, alias_width, render, with_body
from weft.sources.listing import Listing, list_sources
from weft.sources.match import ARCHIVES, Matcher
from weft.operators.storage import deleted, shared_dir
from weft.sources.scan import PACKED_BYTES, SPLIT_BYTES, errors_of, read_rows


@dataclass
class MergeOptions:
    """order: stable (by key, file and line, over any number of rows) or replay (tied files in heap order).

    threshold: nanoseconds by which order may be broken to keep lines of a source together.
    anchor_by_modification: whether files without any timestamp stand at their modification, not first.
    dense_lines: whether lines of a source are numbered without gaps, for which files of many ranges are
    read twice. split_bytes and packed_bytes: of a range of plain and of compressed files.
    """

    since: int | None = None
    until: int | None = None
    drop_orphans: bool = False
    order: str = "stable"
    threshold: int | None = None
    anchor_by_modification: bool = False
    timestamps: TimestampOptions = field(default_factory=TimestampOptions)
    render: RenderOptions = field(default_factory=RenderOptions)
    byte_fidelity: bool = False
    dense_lines: bool = True
    split_bytes: int = SPLIT_BYTES
    packed_bytes: int = PACKED_BYTES


def parse_lines(lines: DataFrame, options: TimestampOptions | None = None, parser: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """raw_lines with timestamps and levels. A parser of one's own adds ts_ns, ts_start, ts_end and zoned.

    With further forms there is _of_year too, for with_years().
    """
    stamped = parser(lines) if parser else with_timestamps(lines, options=options)
    return with_levels(with_further_timestamps(stamped) if options and options.further else stamped)


def build_timeline(parsed: DataFrame, options: MergeOptions | None = None) -> DataFrame:
    """Parsed lines with block_ts and merge_key, within the bounds."""
    o = options or MergeOptions()
    return timeline.bounded(timeline.with_running(parsed), o.since, o.until, o.drop_orphans)


def positioned(line: DataFrame, order: str = "stable", threshold: int | None = None) -> DataFrame:
    """A timeline with out_pos; with a threshold in the stable order up to it."""
    if threshold is not None and order == "stable":
        return slop.with_slop_position(line, threshold)
    if order == "replay":
        return timeline.with_position(replay.with_run_position(line), ["run_pos", "line_no"])
    if order != "stable":
        raise ValueError(f"order is stable or replay: {order}")
    return timeline.with_position(line, ["merge_key", "file_idx", "line_no"])


class Merge:
    """A merge of files: its catalogue, timeline, text and metrics, each a DataFrame made when asked for.

    Sources are read and parsed once, into a table in the shared folder, with the running values of the
    stretches that tasks read; all else reads the columns it needs from there. close() deletes it, and
    frames made from it can't be read then.
    """

    def __init__(self, spark: SparkSession, inputs: list[str], options: MergeOptions | None = None, exclude: list[str] | None = None, aliases: dict[str, str] | None = None, ignore_archives: bool = False, follow_symlinks: bool = False, strict_reference: bool = False, parser: Callable[[DataFrame], DataFrame] | None = None, store: str = ""):
        self.spark, self.options, self.parser = spark, options or MergeOptions(), parser
        rules = [*(exclude or []), *(ARCHIVES if ignore_archives else ())]
        self.listing: Listing = list_sources(inputs, Matcher(rules, strict_reference), aliases, follow_symlinks, store, spark)
        self._folder = f"{shared_dir(spark)}/merge-{uuid.uuid4().hex}"
        self._rows: DataFrame | None = None
        self._timeline: DataFrame | None = None
        self._counted: dict[str, int] | None = None

    def __enter__(self) -> Merge:
        return self

    def __exit__(self, *error: object) -> None:
        self.close()

    def close(self) -> None:
        """Deletes the table of parsed lines."""
        deleted(self.spark, self._folder)
        self._rows = self._timeline = None

    @property
    def files(self) -> DataFrame:
        return self.listing.to_df(self.spark)

    def _table(self) -> DataFrame:
        """All rows, parsed, in the order in which tasks read them; those of damage too."""
        if self._rows is None:
            o = self.options
            rows = read_rows(self.spark, self.listing, o.byte_fidelity, o.dense_lines, o.split_bytes, o.packed_bytes)
            parsed = parse_lines(rows, o.timestamps, self.parser)
            t = o.timestamps
            if t.further:  # years come from all of a file
                parsed = with_years(parsed, self.listing.modified(self.spark))
            if t.zone:
                parsed = with_local_zone(parsed, t.zone)
            own = timeline.in_chunks(parsed) if t.further or t.zone else timeline.in_read_order(parsed)
            own.write.parquet(self._folder)
            self._rows = self.spark.read.parquet(self._folder)
        return self._rows

    def errors(self) -> DataFrame:
        """path, line_no and error of sources that are damaged."""
        return errors_of(self._table(), self.listing)

    def _stretches(self) -> DataFrame:
        return self._table().where("error IS NULL").drop("error")

    def parsed(self) -> DataFrame:
        return self._stretches().drop("_chunk", "_own_max", "_own_last")

    def running(self) -> DataFrame:
        """Parsed lines with block_ts and merge_key, without bounds."""
        rows = timeline.carried(self._stretches())
        return timeline.anchored(rows, self.listing.modified(self.spark)) if self.options.anchor_by_modification else rows

    def _bounded(self) -> DataFrame:
        o = self.options
        alias = self.files.select("file_idx", "source_path", "alias")
        return timeline.bounded(self.running(), o.since, o.until, o.drop_orphans).join(alias, "file_idx")

    def timeline(self) -> DataFrame:
        """All columns of the merged lines: parsed values, block_ts, merge_key, alias, out_pos."""
        if self._timeline is None:
            self._timeline = positioned(self._bounded(), self.options.order, self.options.threshold)
        return self._timeline

    def _blocks(self) -> DataFrame:
        return timeline.with_blocks(self.timeline()) if self.options.render.write_block_alias else self.timeline()

    def rendered(self) -> DataFrame:
        """out_pos, part and text of the output."""
        return render(self._blocks(), self.options.render, alias_width(self.files))

    def write(self, path: str) -> None:
        """Text files whose names are in the output's order; counters are observed by the job that writes.

        Without block headers, and in the stable order, no line needs its position: lines are sorted once, as they are written.
        """
        o, width = self.options, alias_width(self.files)
        direct = o.order == "stable" and o.threshold is None and not o.render.write_block_alias
        rows = self._bounded().orderBy(*timeline.order_columns()) if direct else self._blocks()
        seen = Observation()
        rows = with_body(rows, o.render).observe(seen, *metrics.counter_columns(o.render, width))
        text = render(rows, o.render, width, bodies=True) if direct else render(rows, o.render, width, bodies=True).orderBy("out_pos", "part")
        text.select("text").write.mode("overwrite").text(path)
        if direct:  # a sort above the observation would run it twice
            self._counted = seen.get

    def lines(self) -> Iterator[str]:
        """The output's lines, a partition at a time on the driver."""
        for row in self.rendered().orderBy("out_pos", "part").toLocalIterator(prefetchPartitions=True):
            yield row["text"]

    def counters(self) -> DataFrame:
        """Counters of the output: those that write() observed, or of a pass over the parsed lines."""
        o, width = self.options, alias_width(self.files)
        if self._counted is not None:
            seen = self.spark.createDataFrame([self._counted], ", ".join(f"{k} long" for k in self._counted))
        else:
            rows = self._blocks() if o.render.write_block_alias else self._bounded()
            seen = with_body(rows, o.render).agg(*metrics.counter_columns(o.render, width))
        return metrics.with_totals(seen)

    def input_counters(self) -> DataFrame:
        return metrics.input_counters(self.running(), self.options)

    def histograms(self) -> DataFrame:
        """LineLengths, SuccessiveLineCounts, BlockLineCounts and SkippedLineCounts."""
        line = with_body(timeline.with_blocks(self.timeline(), "file_idx"), self.options.render)
        lengths = metrics.histogram(line.withColumn("n", F.octet_length("body")), "n", metrics.LINE_LENGTHS, "LineLengths")
        events = metrics.histogram(metrics.event_sizes(line), "n", metrics.LINE_COUNTS, "SuccessiveLineCounts")
        skipped = metrics.histogram(metrics.skipped_sizes(self.running(), line, self.options), "n", metrics.LINE_COUNTS, "SkippedLineCounts", "times")
        return lengths.unionByName(events).unionByName(metrics.histogram(metrics.block_sizes(line), "n", metrics.LINE_COUNTS, "BlockLineCounts")).unionByName(skipped)
