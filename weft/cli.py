"""Command line: merge log files into one timeline."""

from __future__ import annotations

import argparse
import json
import sys
import time
from decimal import Decimal
from typing import Any

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from weft.config import Config
from weft.operators import metrics
from weft.plans.merge import Merge
from weft.sources.match import read_ignore_file


def seconds(text: str) -> int:
    """Nanoseconds of a number of seconds."""
    return int(Decimal(text) * 1_000_000_000)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("weft", description=__doc__, argument_default=argparse.SUPPRESS)
    p.add_argument("paths", nargs="*", help="inputs; they replace those of the configuration")
    p.add_argument("--config")
    p.add_argument("--in", "-i", dest="more", action="append", help="a further input")
    p.add_argument("--out", "-o", dest="output")
    p.add_argument("--log", "-l", help="a file for the metrics; else they go to standard error")
    p.add_argument("--version", "-v", action="version", version="weft 0.1")
    for name in ("--buf-read", "--buf-write"):
        p.add_argument(name, type=int, dest="_", help="taken and left alone: Spark sizes its buffers")
    p.add_argument("--exclude", "-e", dest="more_exclude", action="append")
    p.add_argument("--ignore-file")
    p.add_argument("--alias", action="append", help="pattern=name")
    p.add_argument("--order", choices=["stable", "replay"])
    p.add_argument("--threshold", type=seconds, help="seconds by which order may be broken to keep lines of a source together")
    p.add_argument("--timestamp-format", help="iso8601, epoch, epoch_ms, clf, or a pattern like %%Y-%%m-%%d %%H:%%M:%%S.%%3N")
    p.add_argument("--zone", help="the zone of times without one, such as Europe/Berlin; else UTC")
    p.add_argument("--since")
    p.add_argument("--until")
    p.add_argument("--min-ts-len", type=int)
    p.add_argument("--ts-search-limit", type=int)
    flags = {"ignore-archives": "", "follow-symlinks": "", "write-timestamp": "-t", "strip-timestamp": "-s", "write-level": "", "strip-level": "", "write-block-alias": "-b", "write-line-alias": "-a", "ignore-timezone": "", "further": "", "anchor-by-modification": "", "drop-orphans": "", "metrics": "", "progress": "-p", "dry-run": ""}
    for name, short in flags.items():
        p.add_argument(f"--{name}", *filter(None, [short]), action="store_true")
    return p


def configure(args: list[str]) -> Config:
    given: dict[str, Any] = vars(parser().parse_args(args))
    base = Config()
    if path := given.pop("config", None):
        with open(path, encoding="utf-8") as f:
            base = Config.from_yaml(f.read())
    given["inputs"] = [*(given.pop("paths", None) or base.inputs), *given.pop("more", [])]
    own = read_ignore_file(given.pop("ignore_file")) if "ignore_file" in given else []
    given["exclude"] = [*own, *base.exclude, *given.pop("more_exclude", [])]
    given["aliases"] = base.aliases | dict(x.split("=", 1) for x in given.pop("alias", []))
    return base.overlaid(given)


def run(merge: Merge, c: Config, began: int) -> None:
    """What the command line asks of a merge."""
    if c.dry_run:
        for s in merge.listing.sources:
            print(s.source_path)
    elif c.output:
        merge.write(c.output)
    else:
        for line in merge.lines():
            print(line)
    took = time.monotonic_ns() - began
    damaged = merge.listing.errors if c.dry_run else [(r["path"], r["error"]) for r in merge.errors().toLocalIterator()]
    for path, error in damaged:
        print(f"weft: {path}: {error}", file=sys.stderr)
    if c.metrics:
        report = json.dumps(measured(merge, took) | {"errors": damaged})
        if c.log:
            with open(c.log, "w", encoding="utf-8") as f:
                f.write(report + "\n")
        else:
            print(report, file=sys.stderr)


def measured(merge: Merge, took: int) -> dict[str, Any]:
    """Counters, histograms and speeds; the sources aren't read or parsed again."""
    listing = merge.listing
    files = {"dirs_scanned": listing.dirs_scanned, "files_scanned": listing.files_scanned, "files_matched": len(listing.sources)}
    counted = merge.counters().first().asDict() | merge.input_counters().first().asDict()
    speed = {"duration": metrics.human_time(took), "lines_speed": metrics.per_second(counted["lines_read"], took), "bytes_speed": metrics.per_second(counted["bytes_read"], took, 1024)}
    histograms: dict[str, dict[str, int]] = {}
    for r in merge.histograms().orderBy("name", F.col("le").asc_nulls_last()).collect():  # as many rows as levels at most
        histograms.setdefault(r["name"], {})["more" if r["le"] is None else str(r["le"])] = r["n"]
    return counted | files | speed | {"histograms": histograms}


def main(args: list[str] | None = None) -> int:
    try:
        c = configure(sys.argv[1:] if args is None else args)
        began = time.monotonic_ns()
        spark = SparkSession.builder.appName("weft").config("spark.ui.showConsoleProgress", str(c.progress).lower()).getOrCreate()
        with Merge(spark, c.inputs, c.merge_options(), c.exclude, c.aliases, c.ignore_archives, c.follow_symlinks) as merge:
            run(merge, c, began)
        return 0
    except (OSError, ValueError, PySparkException, Py4JError) as error:
        print(f"weft: {error}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
