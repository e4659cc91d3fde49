"""The merge: golden output, order against a model, bounds, stripping, sources, metrics, command line."""

import bz2
import gzip
import heapq
import io
import itertools
import json
import lzma
import os
import random
import re
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from weft import cli
from weft.config import Config
from weft.operators import metrics, timeline
from weft.operators.render import RenderOptions, with_body
from weft.operators.replay import replay
from weft.plans.merge import Merge, MergeOptions, build_timeline, parse_lines, positioned
from weft.sources.listing import list_sources
from weft.sources.match import Matcher

WIDTH = len("gateway.log")


def written(folder):
    """Two logs of our own, with continuation lines and times in common."""
    rng, files = random.Random(20), {}
    for name, every in (("api.log", 3), ("gateway.log", 5)):
        rows, at = [], 0
        for k in range(12):
            at += rng.choice([0, 1, 2, every])
            rows.append((at, f"2032-10-11 12:13:{at:02d},{every:03d} | {rng.choice(['INFO', 'WARN', 'DEBUG'])} | {name} step {k} {'=' * rng.randrange(30)}"))
            rows += [(None, f"    detail {j} of {k}") for j in range(rng.choice([0, 0, 0, 1, 3]))]
        files[name] = rows
        (folder / name).write_text("".join(f"{x}\n" for _, x in rows))
    return files


def expected(files):
    """(alias, timestamp or None, text with both prefixes) in merge order: a file goes on while no other is before it."""
    base, fractions = 1_980_504_780_000_000_000, {"api.log": 3, "gateway.log": 5}
    stamped = {}
    for name, rows in files.items():
        key, out = 0, []
        for at, text in rows:
            ts = None if at is None else base + at * 10**9 + fractions[name] * 10**6
            key = ts or key
            out.append((key, ts, f"2032-10-11 12:13:{(key - base) // 10**9:02d}.{fractions[name]:03d}000000 {name:{WIDTH}} - {text}"))
        stamped[name] = out
    at, merged = dict.fromkeys(files, 0), []
    names = sorted(files)
    while any(at[n] < len(stamped[n]) for n in names):
        n = min((n for n in names if at[n] < len(stamped[n])), key=lambda n: stamped[n][at[n]][0])
        limit = min((stamped[m][at[m]][0] for m in names if m != n and at[m] < len(stamped[m])), default=None)
        while at[n] < len(stamped[n]) and (limit is None or stamped[n][at[n]][0] <= limit):
            merged.append((n, stamped[n][at[n]][1], stamped[n][at[n]][2]))
            at[n] += 1
    return merged


@pytest.fixture
def small(tmp_path):
    folder = tmp_path / "small"
    folder.mkdir()
    return str(folder), written(folder)


def test_merged_text(spark, small):
    folder, files = small
    m = Merge(spark, [folder], MergeOptions(order="replay", render=RenderOptions(write_timestamp=True, write_line_alias=True)))
    assert list(m.lines()) == [x for _, _, x in expected(files)]
    stable = Merge(spark, [folder], MergeOptions(render=RenderOptions(write_timestamp=True, write_line_alias=True)))
    got = list(stable.lines())
    assert sorted(got) == sorted(x for _, _, x in expected(files)) and [x[:29] for x in got] == sorted(x[:29] for x in got)


def test_metrics_by_model(spark, small):
    folder, files = small
    want = expected(files)
    m = Merge(spark, [folder], MergeOptions(order="replay", render=RenderOptions(write_timestamp=True, write_line_alias=True, write_block_alias=True)))
    runs = [(k, len(list(g))) for k, g in itertools.groupby(n for n, _, _ in want)]
    size = sum(os.path.getsize(f"{folder}/{f}") for f in files)
    n, timed = len(want), sum(t is not None for _, t, _ in want)
    c = m.counters().first()
    headers = sum(len(f"\n--- {k} ---\n") for k, _ in runs)
    assert (c["lines_read"], c["lines_with_timestamp"], c["lines_without_timestamp"]) == (n, timed, n - timed)
    assert (c["bytes_read"], c["bytes_raw"], c["bytes_timestamps"], c["bytes_line_alias"], c["bytes_block_alias"]) == (size, size, 30 * n, (WIDTH + 3) * n, headers)
    assert c["bytes_output"] == size + 30 * n + (WIDTH + 3) * n + headers and c["bytes_overhead"] == c["bytes_output"] - size

    def levels(values, bounds):
        out = {}
        for v in values:
            le = next((b for b in bounds if b >= v), None)
            out[le] = out.get(le, 0) + 1
        return out

    h = {}
    for r in m.histograms().collect():
        h.setdefault(r["name"], {})[r["le"]] = r["n"]
    events = [len(list(g)) for rows in files.values() for _, g in itertools.groupby(itertools.accumulate(at is not None for at, _ in rows))]
    assert h["LineLengths"] == levels([len(x) for rows in files.values() for _, x in rows], metrics.LINE_LENGTHS)
    assert h["SuccessiveLineCounts"] == levels(events, metrics.LINE_COUNTS)
    assert h["BlockLineCounts"] == levels([k for _, k in runs], metrics.LINE_COUNTS)
    assert h["SkippedLineCounts"] == {0: len(runs)}
    i = m.input_counters().first()
    assert (i["bytes_input"], i["lines_read"], i["lines_skipped"], i["lines_not_read"]) == (size, n, 0, 0)
    text = list(m.lines())
    assert "\n".join(text).count("--- ") == len(runs) and text[0] == f"\n--- {runs[0][0]} ---"


def random_files(seed):
    """File, line, timestamp or None."""
    rng = random.Random(seed)
    return [(f, i, rng.choice([None, rng.randrange(1, 40), rng.randrange(1, 40)])) for f in range(rng.randrange(1, 5)) for i in range(rng.randrange(0, 60))]


def model(rows):
    """Running maxima, and the stable order."""
    high, last, out = {}, {}, []
    for f, i, ts in rows:
        high[f] = max(high.get(f, 0), ts or 0)
        last[f] = ts if ts is not None else last.get(f)
        out.append((high[f], f, i, ts, last[f]))
    return sorted(out, key=lambda r: r[:3])


@pytest.mark.parametrize("seed", range(3))
def test_timeline_by_model(spark, seed):
    rows = random_files(seed)
    df = spark.createDataFrame(rows, "file_idx int, line_no bigint, ts_ns bigint").repartition(3)
    for chunk in (7, 100_000):
        line = timeline.with_running(df, chunk)
        got = timeline.with_position(line, ["merge_key", "file_idx", "line_no"]).orderBy("out_pos").collect()
        assert [(r["merge_key"], r["file_idx"], r["line_no"], r["ts_ns"], r["block_ts"]) for r in got] == model(rows)
        assert [r["out_pos"] for r in got] == list(range(len(rows)))


def slow_merge(files):
    """A merge line by line, from a heap of one line of each file; the file in hand goes on while it may."""
    heap = [(keys[0], n, f, 0) for n, (f, keys) in enumerate(sorted(files.items())) if keys]
    heapq.heapify(heap)
    while heap:
        _, n, f, at = heapq.heappop(heap)
        limit = heap[0][0] if heap else None
        while at < len(files[f]) and (limit is None or files[f][at] <= limit):
            yield f, files[f][at]
            at += 1
        if at < len(files[f]):
            heapq.heappush(heap, (files[f][at], n, f, at))


def test_replay_is_an_ordered_merge():
    rng = random.Random(1)
    for _ in range(200):
        files = {f: sorted(rng.sample(range(30), rng.randrange(0, 12))) for f in range(rng.randrange(1, 6))}
        got = list(replay(files))
        assert sorted(got) == sorted((f, k) for f, keys in files.items() for k in keys) and [k for _, k in got] == sorted(k for _, k in got)
        apart = {f: [k * 10 + f for k in keys] for f, keys in files.items()}  # no ties
        assert list(replay(apart)) == list(slow_merge(apart))


def test_bounds(spark):
    rows = [(0, 0, 10), (0, 1, None), (0, 2, 20), (0, 3, None), (0, 4, 50), (0, 5, 30), (1, 0, None), (1, 1, 25)]
    df = spark.createDataFrame(rows, "file_idx int, line_no bigint, ts_ns bigint")
    kept = lambda **b: sorted((r["file_idx"], r["line_no"]) for r in build_timeline(df, MergeOptions(**b)).collect())
    assert kept(until=25) == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 0), (1, 1)]
    assert kept(since=20) == [(0, 1), (0, 2), (0, 3), (0, 4), (0, 5), (1, 0), (1, 1)]
    assert kept(since=20, drop_orphans=True) == [(0, 2), (0, 3), (0, 4), (0, 5), (1, 1)]
    assert kept(since=20, until=20) == [(0, 1), (0, 2), (0, 3), (1, 0)]


def bodies(spark, lines, **options):
    df = parse_lines(spark.createDataFrame(list(enumerate(lines)), "i int, line string"))
    return [r["body"] for r in with_body(df, RenderOptions(**options)).orderBy("i").collect()]


def strip_cases():
    """(line, what is left of it): every opening, bracket run, zone and run of delimiters, by the stated rule."""
    rng = random.Random(8)
    for before, brackets, zone, n in itertools.product(("", "job 7 ", "disk\t", "q=", "a:"), ("", "[", "([", "[[[", "(((("), ("", "Z", "-04:30"), range(6)):
        after = "".join(rng.choice(" |)]}:,\t") for _ in range(n))
        tail = rng.choice(["up", "=9", "done now"]) if n else "=up"
        stamp = f"20{rng.randrange(10, 50)}-0{rng.randrange(1, 10)}-1{rng.randrange(10)}T0{rng.randrange(10)}:4{rng.randrange(10)}:5{rng.randrange(10)}.{rng.randrange(100, 1000)}{zone}"
        kept = before if 1 <= len(brackets) <= 3 and before[-1:] in ("", " ", "\t") else before + brackets
        rest = after[min(n, 3 if zone else 4) :] + tail
        apart = kept and kept[-1] not in " \t" and rest[0] not in " \t"
        yield before + brackets + stamp + after + tail, kept + (" " if apart else "") + rest


def test_strip_timestamp(spark):
    cases = list(strip_cases())
    assert bodies(spark, [x for x, _ in cases], strip_timestamp=True) == [x for _, x in cases] and len(cases) == 450
    assert bodies(spark, ["no time", "", "2031-02-03 04:05:06"], strip_timestamp=True) == ["no time", "", ""]


def test_strip_level(spark):
    """A level goes with one delimiter behind it, with or without its timestamp; other words stay."""
    rng, lines, bare, without = random.Random(4), [], [], []
    for word, behind, lead in itertools.product(("INFO", "warning", "Fatal", "upper"), (" ", "|", ":", ")", "] ", " |"), ("", "2031-02-03 04:05:06.7Z")):
        between, tail = (rng.choice([" ", " | ", " ["]) if lead else ""), f"t{rng.randrange(99)}"
        lines.append(lead + between + word + behind + tail)
        left = tail if word == "upper" else behind[1:] + tail
        left = word + behind + tail if word == "upper" else left
        bare.append(lead + between + left)
        gone = len(between) - len(between[min(3, len(re.match(r"[ |]*", between)[0])) :]) if lead else 0
        without.append(between[gone:] + left)
    assert bodies(spark, lines, strip_level=True) == bare
    assert bodies(spark, lines, strip_level=True, strip_timestamp=True) == without


@pytest.fixture
def tree(tmp_path):
    """A folder with a source of every kind, links, and a damaged archive."""
    text = b"2024-01-01 00:00:00 INFO one\n  two\r\n2024-01-01 00:00:01 WARN three"
    (tmp_path / "in/deep").mkdir(parents=True)
    (tmp_path / "in/deep/a.log").write_bytes(text)
    for name, opened in (("b.log.gz", gzip.open), ("c.log.bz2", bz2.open), ("d.log.xz", lzma.open)):
        with opened(tmp_path / "in" / name, "wb") as f:
            f.write(text)
    with zipfile.ZipFile(tmp_path / "in/e.zip", "w") as z:
        z.writestr("x/e.log", text)
        z.writestr("x/e.tmp", b"no")
    for name, mode in (("f.tar", "w"), ("g.tgz", "w:gz"), ("h.tar.bz2", "w:bz2"), ("i.tar.xz", "w:xz")):
        with tarfile.open(tmp_path / "in" / name, mode) as t:
            info = tarfile.TarInfo("in tar.log")
            info.size = len(text)
            t.addfile(info, io.BytesIO(text))
    (tmp_path / "in/bad.zip").write_bytes(b"not a zip")
    (tmp_path / "in/l+ %41 name.log").write_bytes(text)
    os.symlink(tmp_path / "in/deep/a.log", tmp_path / "in/link.log")
    os.symlink(tmp_path / "nowhere", tmp_path / "in/broken.log")
    (tmp_path / "other").mkdir()
    (tmp_path / "other/o.log").write_bytes(text)
    os.symlink(tmp_path / "other", tmp_path / "in/linked")
    os.symlink(tmp_path / "in", tmp_path / "in/loop")
    return str(tmp_path / "in")


def test_sources(spark, tree):
    found = list_sources([tree], Matcher(["*.tmp"]))
    names = [s.source_path.removeprefix(tree + "/") for s in found.sources]
    assert names == ["b.log.gz", "c.log.bz2", "d.log.xz", "deep/a.log", "e.zip!/x/e.log", "f.tar!/in tar.log", "g.tgz!/in tar.log", "h.tar.bz2!/in tar.log", "i.tar.xz!/in tar.log", "l+ %41 name.log", "link.log"]
    assert sorted(os.path.basename(p) for p, _ in found.errors) == ["bad.zip", "broken.log"]
    followed = [s.source_path for s in list_sources([tree], Matcher(["*.tmp"]), follow_symlinks=True).sources]
    assert f"{tree}/linked/o.log" in followed and len(followed) == len(names) + 1
    for fidelity in (False, True):
        m = Merge(spark, [tree], MergeOptions(byte_fidelity=fidelity), exclude=["*.tmp"])
        rows = m.parsed().select("file_idx", "line_no", "line", "eol", "ts_ns").orderBy("file_idx", "line_no").collect()
        assert len(rows) == 3 * len(names)
        for i in range(len(names)):
            own = rows[3 * i : 3 * i + 3]
            assert [(r["file_idx"], r["line_no"], r["line"]) for r in own] == [(i, 0, "2024-01-01 00:00:00 INFO one"), (i, 1, "  two"), (i, 2, "2024-01-01 00:00:01 WARN three")]
            if fidelity:
                assert [r["eol"] for r in own] == ["\n", "\r\n", ""]
    with pytest.raises(FileNotFoundError):
        list_sources([tree + "/none"])
    with pytest.raises(FileNotFoundError):
        list_sources([tree], Matcher(["*"]))
    assert all(s.kind == "plain" for s in Merge(spark, [tree], ignore_archives=True).listing.sources)


def test_archives_with_repeated_names_and_damage(spark, tmp_path):
    """Members are told apart by their places; damage ends a source, is told, and leaves the rest."""
    for name, mode in (("a.tar", "w"), ("b.tar.gz", "w:gz")):
        with tarfile.open(tmp_path / name, mode) as t:
            for member, text in (("x.log", b"one\ntwo\n"), ("y.log", b"three\n"), ("x.log", b"four\n")):
                info = tarfile.TarInfo(member)
                info.size = len(text)
                t.addfile(info, io.BytesIO(text))
    with pytest.warns(UserWarning), zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        for member, text in (("x.log", "five\n"), ("bad.log", "no\n" * 99), ("x.log", "six\n")):
            z.writestr(member, text)
    data = (tmp_path / "c.zip").read_bytes()
    (tmp_path / "c.zip").write_bytes(data.replace(b"no\nno\n", b"no\nNO\n", 1))  # its checksum no longer holds
    whole = lzma.compress(b"".join(b"line %d\n" % i for i in range(50_000)))
    (tmp_path / "d.log.xz").write_bytes(whole[: len(whole) // 2])
    m = Merge(spark, [str(tmp_path)])
    names = {i: s.source_path.removeprefix(f"{tmp_path}/") for i, s in enumerate(m.listing.sources)}
    got = {}
    for r in m.parsed().select("file_idx", "line_no", "line").orderBy("file_idx", "line_no").collect():
        got.setdefault(r["file_idx"], []).append(r["line"])
    read = [(names[i], x) for i, x in got.items() if not names[i].startswith(("d", "c.zip!/bad"))]
    a = [("x.log", ["one", "two"]), ("y.log", ["three"]), ("x.log", ["four"])]
    assert read == [(f"a.tar!/{n}", x) for n, x in a] + [(f"b.tar.gz!/{n}", x) for n, x in a] + [("c.zip!/x.log", ["five"]), ("c.zip!/x.log", ["six"])]
    partly = next(x for i, x in got.items() if names[i] == "d.log.xz")
    assert len(partly) > 10_000 and partly[:-1] == [f"line {i}" for i in range(len(partly) - 1)] and f"line {len(partly) - 1}".startswith(partly[-1])
    errors = {r["path"].removeprefix(f"{tmp_path}/"): r["error"] for r in m.errors().collect()}
    assert [x for i, x in got.items() if names[i] == "c.zip!/bad.log"] == [["no", "NO", *["no"] * 97]]
    assert set(errors) == {"c.zip!/bad.log", "d.log.xz"} and "BadZipFile" in errors["c.zip!/bad.log"]


def test_endings_are_kept(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"2024-01-01 00:00:00 a\r\n2024-01-01 00:00:01 b\r2024-01-01 00:00:02 c")
    m = Merge(spark, [str(tmp_path)], MergeOptions(byte_fidelity=True))
    assert [x.removeprefix("2024-01-01 00:00:0") for x in m.lines()] == ["0 a\r", "1 b\r", "2 c"]
    c = m.counters().first()
    assert (c["bytes_read"], c["bytes_raw"], c["bytes_missing_newlines"], c["bytes_output"]) == (66, 66, 2, 68)


def test_skipped_counts(spark, tmp_path):
    for f in "ab":
        (tmp_path / f"{f}.log").write_text("".join(f"2024-01-01 00:00:{2 * i + (f == 'b'):02d} {f}{i}\n" for i in range(6)))
    m = Merge(spark, [str(tmp_path)], MergeOptions(since=1_704_067_204_000_000_000, until=1_704_067_208_000_000_000))
    i = m.input_counters().first()
    assert (i["lines_read"], i["lines_skipped"], i["lines_not_read"], i["lines_processed"]) == (9, 4, 3, 5)
    h = {r["le"]: r["n"] for r in m.histograms().where("name = 'SkippedLineCounts'").collect()}
    assert h == {2: 2, 0: 3}


def test_lines_of_split_files_keep_their_order(spark, tmp_path):
    (tmp_path / "big.log").write_text("".join(f"line {i} {'x' * (i % 50)}\n" for i in range(20_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        rows = Merge(spark, [str(tmp_path)]).parsed().select("line_no", "line").orderBy("line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [(r["line_no"], int(r["line"].split()[1])) for r in rows] == [(i, i) for i in range(20_000)]


def test_blocks(spark):
    rng = random.Random(3)
    values = [rng.choice("ab") if rng.random() < 0.9 else None for _ in range(50)]
    df = spark.createDataFrame(list(enumerate(values)), "out_pos bigint, alias string").repartition(3)
    got = timeline.with_blocks(df, chunk=7).orderBy("out_pos").collect()
    block = -1
    for i, r in enumerate(got):
        start = i == 0 or values[i] != values[i - 1]
        block += start
        assert (r["block_id"], r["block_start"]) == (block, start)


def test_histogram_overflow(spark):
    df = spark.createDataFrame([(0,), (1,), (99,), (101,)], "n int")
    assert sorted(((r["le"], r["n"]) for r in metrics.histogram(df, "n", metrics.LINE_COUNTS, "x").collect()), key=str) == [(0, 1), (1, 1), (100, 1), (None, 1)]
    assert len(metrics.LINE_LENGTHS) == 69 and len(metrics.LINE_COUNTS) == 32
    assert metrics.human(1902, 1024) == "1.86 K" and metrics.share(1, 0) == 0
    assert [metrics.human_time(n) for n in (0, 999, 1500, 2_000_000, 61_500_000_000)] == ["0 ns", "999 ns", "1.500 µs", "2.000 ms", "61.500 s"]
    assert metrics.per_second(3000, 2_000_000_000) == "1.50 K/s" and metrics.per_second(5, 0) == "0/s"


def test_histogram_of_weighted_rows(spark):
    df = spark.createDataFrame([(0, 5), (0, 2), (1000, 3)], "n int, times bigint")
    assert sorted((r["le"] is None, r["n"]) for r in metrics.histogram(df, "n", metrics.LINE_COUNTS, "x", "times").collect()) == [(False, 7), (True, 3)]


def test_config_and_command_line(tmp_path, capsys):
    (tmp_path / "c.yaml").write_text("ListFiles:\n  InputPaths: [a, b]\n  FileAliases: {'*.x': X}\nMerge:\n  WriteTimestampPerLine: true\n  MinTimestamp: 2025-01-01T00:00:00.000000001Z\nUnknown: 1\nListFilesConfig:\n  IgnoreArchives: true\n")
    c = cli.configure(["--config", str(tmp_path / "c.yaml"), "-i", "more", "--alias", "*.y=Y", "-a"])
    assert (c.inputs, c.aliases, c.write_timestamp, c.write_line_alias) == (["a", "b", "more"], {"*.x": "X", "*.y": "Y"}, True, True)
    assert c.merge_options().since == 1_735_689_600_000_000_001 and c.ignore_archives
    assert cli.configure(["--config", str(tmp_path / "c.yaml"), "z"]).inputs == ["z"] and Config().order == "stable"
    assert cli.main([str(tmp_path / "missing")]) == 1 and "missing" in capsys.readouterr().err


def test_command_line_merge(spark, capsys, tmp_path, small):
    folder, files = small
    want = [x for _, _, x in expected(files)]
    assert cli.main([folder, "-t", "-a", "--order", "replay", "--metrics"]) == 0
    out = capsys.readouterr()
    assert out.out.splitlines() == want and f'"lines_read": {len(want)}' in out.err
    report = json.loads(next(x for x in out.err.splitlines() if x.startswith("{")))
    assert sum(report["histograms"]["LineLengths"].values()) == len(want) and report["bytes_speed"].endswith("/s")
    assert cli.main([folder, "--dry-run"]) == 0 and capsys.readouterr().out.splitlines() == [f"{folder}/api.log", f"{folder}/gateway.log"]
    assert cli.main([folder, "-t", "-a", "--order", "replay", "-o", str(tmp_path / "out")]) == 0
    text = "".join((tmp_path / "out" / p).read_text() for p in sorted(os.listdir(tmp_path / "out")) if p.startswith("part-"))
    assert text.splitlines() == want


def test_streaming_keys(spark, tmp_path):
    from weft.streaming.timeline import streaming_timeline

    rows = [(0, 0, "2024-01-01 00:00:05.000000007 a"), (0, 1, "  more"), (0, 2, "2024-01-01 00:00:03 b"), (1, 0, "none")]
    spark.createDataFrame(rows, "file_idx int, line_no bigint, line string").coalesce(1).write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema("file_idx int, line_no bigint, line string").parquet(str(tmp_path / "s"))
    streaming_timeline(stream).writeStream.format("memory").queryName("keys").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    five = 1_704_067_205_000_000_007
    got = {(r["file_idx"], r["line_no"]): (r["merge_key"], r["block_ts"]) for r in spark.table("keys").collect()}
    assert got == {(0, 0): (five, five), (0, 1): (five, five), (0, 2): (five, five - 2_000_000_007), (1, 0): (0, None)}


def test_custom_parser(spark):
    def parser(df):
        return df.select("*", F.col("line").cast("bigint").alias("ts_ns"), F.lit(0).alias("ts_start"), F.length("line").alias("ts_end"), F.lit(True).alias("zoned"))

    df = spark.createDataFrame([(0, 0, "7", "\n")], "file_idx int, line_no bigint, line string, eol string")
    assert positioned(build_timeline(parse_lines(df, parser=parser))).first()["merge_key"] == 7
