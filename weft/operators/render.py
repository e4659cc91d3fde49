"""Timeline rows to text: prefixes, stripping, block headers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.levels import label
from weft.functions.timestamps import format_as, format_timestamp

# A missing timestamp's prefix, the separators, delimiters that go with a stripped timestamp.
NO_TIMESTAMP = " " * 30
ALIAS_END = " - "
HEADER = ("\n--- ", " ---\n")
AFTER = r"[ \t|\])}:,]"
BEFORE = r"(?:^|(?<=[ \t]))[\[(]{1,3}$"


@dataclass(frozen=True)
class RenderOptions:
    write_timestamp: bool = False
    write_level: bool = False
    write_line_alias: bool = False
    write_block_alias: bool = False
    strip_timestamp: bool = False
    strip_level: bool = False
    #: A name or pattern of format_as(); None is the fixed form with nine digits.
    timestamp_format: str | None = None


def with_body(df: DataFrame, options: RenderOptions, line: str = "line") -> DataFrame:
    """df with body: the line without what is stripped.

    A stripped timestamp takes up to three opening brackets before it and up to three delimiters after it
    along (four if no zone ended it). A space parts what was before and after, if neither has one. Of a
    level, its own characters and one delimiter go; a glog letter before a stripped timestamp stays.
    """
    text = F.col(line)
    if not options.strip_timestamp:
        if not options.strip_level:
            return df.withColumn("body", text)
        kept = F.concat(F.substring(text, F.lit(1), F.col("level_start")), F.substring(text, F.col("level_end") + 1, F.length(text)))
        return df.withColumn("body", F.when(F.col("level_end").isNotNull(), kept).otherwise(text))
    before, rest = F.substring(text, F.lit(1), F.col("ts_start")), F.substring(text, F.col("ts_end") + 1, F.length(text))
    df = df.withColumns({"_before": F.regexp_replace(before, BEFORE, ""), "_gone": F.length(F.when(F.col("zoned"), F.regexp_extract(rest, rf"^{AFTER}{{0,3}}", 0)).otherwise(F.regexp_extract(rest, rf"^{AFTER}{{0,4}}", 0)))})
    rest = F.substring(text, F.col("ts_end") + F.col("_gone") + 1, F.length(text))
    if options.strip_level:
        start, stop = F.col("level_start") - F.col("ts_end") - F.col("_gone"), F.col("level_end") - F.col("ts_end") - F.col("_gone")
        rest = F.when(stop > 0, F.concat(F.substring(rest, F.lit(1), F.greatest(start, F.lit(0))), F.substring(rest, stop + 1, F.length(rest)))).otherwise(rest)
    blank = F.col("_before").rlike(r"[ \t]$") | F.substring(text, F.col("ts_end") + F.col("_gone") + 1, F.lit(1)).isin(" ", "\t", "")
    apart = F.when((F.col("_before") == "") | blank, "").otherwise(" ")
    whole = F.concat("_before", apart, rest)
    if options.strip_level:  # lines without a timestamp may have a level too
        bare = F.concat(F.substring(text, F.lit(1), F.col("level_start")), F.substring(text, F.col("level_end") + 1, F.length(text)))
        return df.withColumn("body", F.when(F.col("ts_end").isNotNull(), whole).when(F.col("level_end").isNotNull(), bare).otherwise(text)).drop("_before", "_gone")
    return df.withColumn("body", F.when(F.col("ts_end").isNotNull(), whole).otherwise(text)).drop("_before", "_gone")


def alias_width(files: DataFrame) -> int:
    """The longest alias of all listed files."""
    return files.agg(F.max(F.length("alias")).alias("n")).first()["n"] or 0


def prefix(options: RenderOptions, width: int = 0) -> Column:
    """What stands before a line's body: timestamp, level and alias, as asked."""
    parts: list[Column] = []
    if options.write_timestamp:
        form = options.timestamp_format
        if form is None:
            parts.append(F.coalesce(format_timestamp(F.col("block_ts")), F.lit(NO_TIMESTAMP)))
        else:
            blank = F.repeat(F.lit(" "), F.length(format_as(F.lit(0).cast("bigint"), form)))
            parts += [F.coalesce(format_as(F.col("block_ts"), form), blank), F.lit(" ")]
    if options.write_level:
        parts.append(label(F.col("level")))
    if options.write_line_alias:
        parts += [F.rpad("alias", width, " ") if width else F.col("alias"), F.lit(ALIAS_END)]
    return F.concat(*parts) if parts else F.lit("")


def header(alias: Column) -> Column:
    return F.concat(F.lit(HEADER[0]), alias, F.lit(HEADER[1]))


def render(df: DataFrame, options: RenderOptions, width: int = 0, bodies: bool = False) -> DataFrame:
    """out_pos (if df has it), part (0: header, 1: line) and text of all rows of output; headers need with_blocks().

    A line that ended in a carriage return (with byte fidelity) keeps it; the sink adds the newline.
    bodies: df has its bodies already.
    """
    ending = F.when(F.col("eol").startswith("\r"), "\r").otherwise("") if "eol" in df.columns else F.lit("")
    text = F.concat(prefix(options, width), F.col("body"), ending)
    lines = df if bodies else with_body(df, options)
    place = [c for c in ("out_pos",) if c in df.columns]
    if not options.write_block_alias:
        return lines.select(*place, F.lit(1).alias("part"), text.alias("text"))
    row = F.struct(F.lit(1).alias("part"), text.alias("text"))
    head = F.struct(F.lit(0).alias("part"), F.rtrim(header(F.col("alias")), F.lit("\n")).alias("text"))
    rows = F.when(F.col("block_start"), F.array(head, row)).otherwise(F.array(row))
    return lines.select(*place, F.explode(rows).alias("r")).select(*place, "r.part", "r.text")
