"""Sources: ranges, damage, indexes, stores. Lines are held against one regular expression over the whole text."""

import bz2
import gzip
import io
import lzma
import os
import pickle
import random
import re
import tarfile
import time
import zipfile

import pytest
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import functions as F

from weft import cli
from weft.operators.render import RenderOptions
from weft.plans.merge import Merge, MergeOptions
from weft.sources import codecs, listing, scan
from weft.sources.listing import Listing, Source, list_sources


def model(data):
    """(line, its end) of bytes."""
    return [(x[: len(x) - len(e)].decode("utf-8", "replace"), e.decode()) for x in re.findall(rb"[^\r\n]*(?:\r\n|\n|\r)|[^\r\n]+", data) for e in [re.search(rb"(?:\r\n|\n|\r|)\Z", x)[0]]]


def lines_of(r, store=""):
    out, error = [], None
    for _, found in scan.read_range(r, store):
        if isinstance(found, scan.Lines):
            ends = [scan._ENDS[k] for k in found.ends.tolist()]
            out += zip(found.text().to_pylist(), ends, strict=True)
        else:
            error = found
    return out, error


def text_of(rng, n, ends=("\n", "\r\n", "\r", "\n\n", "\r\r\n")):
    words = ["", "a", "line", "é世界", "x" * 30, "\x0b\x85", "  "]
    return "".join(rng.choice(words) * rng.randrange(3) + rng.choice(ends) for _ in range(n)) + rng.choice(["", "last"])


def whole(path, size, kind, **sizes):
    return scan.ranges(Listing([Source(path, path, "x", size, kind)]), **sizes)


@pytest.mark.parametrize("seed", range(12))
def test_any_cut_of_a_plain_file_gives_the_same_lines(tmp_path, seed, monkeypatch):
    rng = random.Random(seed)
    data = text_of(rng, rng.choice([0, 1, 7, 60])).encode() + rng.choice([b"", b"\xff\xfe bad\n", b"\r", b"\r\n"])
    (tmp_path / "a").write_bytes(data)
    monkeypatch.setattr(codecs, "PIECE", 1)
    for split in (1, 2, 3, 7, 50, 10**6):
        found = whole(str(tmp_path / "a"), len(data), "plain", split=split)
        for piece in (1, 2, 5, 1000):
            monkeypatch.setattr(scan, "raw", lambda f, a, b, piece=piece: codecs.raw(f, a, b, piece))
            assert [x for r in found for x in lines_of(r)[0]] == model(data)


@pytest.mark.parametrize("seed", range(4))
def test_any_cut_of_a_compressed_file_gives_the_same_lines(tmp_path, seed):
    rng = random.Random(seed)
    parts = [text_of(rng, rng.randrange(3000)).encode() for _ in range(rng.randrange(1, 7))]
    data = b"".join(parts)
    for kind, pack in (("bz2", lambda x: bz2.compress(x, 1)), ("xz", lzma.compress), ("gz", gzip.compress)):
        packed = b"".join(map(pack, parts)) + (b"\0" * 8 if kind != "bz2" else b"")
        (tmp_path / kind).write_bytes(packed)
        for size in (1, 60, 5000, 10**7):
            found = whole(str(tmp_path / kind), len(packed), kind, packed=size)
            got = [lines_of(r) for r in found]
            assert [x for own, _ in got for x in own] == model(data) and not any(e for _, e in got)
            assert kind != "xz" or len(found) == (len(parts) if size == 1 else len(found))


def one_stream(parts):
    """An xz stream of a block for each part, put together from streams of one block."""
    blocks, sizes = b"", []
    for p in parts:
        packed = lzma.compress(p)
        b = codecs.xz_blocks(io.BytesIO(packed))[0]
        blocks += packed[b.at : b.at + -(-b.packed // 4) * 4]
        sizes.append((b.packed, b.size, b.flags))
    index = b"\0" + codecs._numbered(len(sizes)) + b"".join(codecs._numbered(a) + codecs._numbered(n) for a, n, _ in sizes)
    index += bytes(-len(index) % 4)
    index += codecs.zlib.crc32(index).to_bytes(4, "little")
    flags = sizes[0][2]
    foot = (len(index) // 4 - 1).to_bytes(4, "little") + flags
    return codecs.XZ_HEAD + flags + codecs.zlib.crc32(flags).to_bytes(4, "little") + blocks + index + codecs.zlib.crc32(foot).to_bytes(4, "little") + foot + codecs.XZ_FOOT


def test_a_large_xz_file_is_read_by_many_tasks(spark, tmp_path):
    parts = ["".join(f"{k} line {i} {'=' * (i % 9)}\n" for i in range(4000)).encode() for k in range(9)]
    data = one_stream(parts)
    assert lzma.decompress(data) == b"".join(parts)
    (tmp_path / "big.log.xz").write_bytes(data)
    found = list_sources([str(tmp_path)], spark=spark)
    rows = scan.read_lines(spark, found, packed=3000).withColumn("task", F.spark_partition_id()).orderBy("line_no").collect()
    assert [r["line"] for r in rows] == b"".join(parts).decode().splitlines() and [r["line_no"] for r in rows] == list(range(36_000))
    assert len({r["task"] for r in rows}) >= 3
    sparse = Merge(spark, [str(tmp_path)], MergeOptions(packed_bytes=3000, dense_lines=False)).parsed().orderBy("line_no").collect()
    assert [r["line"] for r in sparse] == [r["line"] for r in rows] and sparse[-1]["line_no"] > 36_000


def test_magic_numbers_by_chance_are_no_blocks(tmp_path, monkeypatch):
    """Bits that look like a block's beginning stand inside a block: it is taken on to the next one, and none is lost."""
    rng = random.Random(5)
    data = bz2.compress(bytes(rng.randrange(256) for _ in range(400_000)), 1)
    true = codecs.bz_marks

    def more(file, start, end, size):
        return sorted(true(file, start, end, size) + [(b * 8 + 3, True) for b in (150_000, 300_001) if start <= b < end])

    monkeypatch.setattr(codecs, "bz_marks", more)
    for step in (10**7, 149_990, 150_000, 60_000):
        out = b"".join(b"".join(codecs.bz_range(io.BytesIO(data), a, min(a + step, len(data)), len(data))) for a in range(0, len(data), step))
        assert out == bz2.decompress(data)


def packed_as(kind, data):
    if kind in ("gz", "bz2", "xz"):
        return {"gz": gzip.compress, "bz2": lambda x: bz2.compress(x, 1), "xz": lzma.compress}[kind](data)
    out = io.BytesIO()
    if kind == "zip":
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("a.log", data)
    else:
        with tarfile.open(fileobj=out, mode={"tar": "w", "tgz": "w:gz", "tar.xz": "w:xz"}[kind]) as t:
            info = tarfile.TarInfo("a.log")
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


@pytest.mark.parametrize("kind", ["gz", "bz2", "xz", "tgz", "tar.xz", "tar"])
def test_damage_anywhere_keeps_the_lines_before_it_and_is_told(tmp_path, kind):
    rng = random.Random(kind)
    data = "".join(f"line {i} {rng.random()}\n" for i in range(12_000)).encode()
    packed, want = packed_as(kind, data), data.decode().splitlines()
    path = str(tmp_path / f"a.{kind}")
    best = 0
    for cut in sorted({0, 1, 5, 20, *(rng.randrange(len(packed)) for _ in range(12)), len(packed) - 1}):
        for flipped in (False, True):
            bad = packed[:cut] + (bytes([packed[cut] ^ 0x55]) + packed[cut + 1 :] if flipped else b"")
            if kind == "tar" and flipped:
                continue  # a plain tar has no checksums of contents
            with open(path, "wb") as f:
                f.write(bad)
            try:
                found = list_sources([path])
            except FileNotFoundError:
                continue  # nothing in it is readable
            got, errors = [], [e for _, e in found.errors]
            for r in scan.ranges(found, packed=50_000):
                own, error = lines_of(r)
                got += [x for x, _ in own]
                errors += [error] if error else []
            if not flipped or kind in ("gz", "xz"):
                assert got[:-1] == want[: max(0, len(got) - 1)]
            assert errors or got == want or (kind == "gz" and cut == 0) or len(bad) == 0 or (flipped and cut < 16) or kind in ("tar", "tgz", "tar.xz")
            best = max(best, len(got)) if not flipped else best
    assert best > 6000


def test_damaged_sources_leave_the_merge_alone(spark, tmp_path, capsys):
    """One cut file of each kind beside whole ones: all lines but what is behind the cuts, in the default mode and with byte fidelity."""
    data = "".join(f"2031-01-01 00:00:{i % 60:02d} line {i} {random.Random(i).random()}\n" for i in range(9000)).encode()
    for kind in ("gz", "bz2", "xz", "tgz"):
        packed = packed_as(kind, data)
        (tmp_path / f"ok.{kind}").write_bytes(packed)
        (tmp_path / f"cut.{kind}").write_bytes(packed[: len(packed) * 3 // 4])
    for fidelity in (False, True):
        m = Merge(spark, [str(tmp_path)], MergeOptions(byte_fidelity=fidelity))
        counts = {m.listing.sources[r["file_idx"]].container_path.rpartition("/")[2]: r["count"] for r in m.parsed().groupBy("file_idx").count().collect()}
        assert all(counts[f"ok.{k}"] == 9000 for k in ("gz", "bz2", "xz", "tgz")) and all(2000 < counts[f"cut.{k}"] < 9000 for k in ("gz", "bz2", "xz", "tgz"))
        errors = {r["path"].rpartition(str(tmp_path))[2]: r for r in m.errors().where("line_no IS NOT NULL").collect()}
        assert {"/cut.gz", "/cut.bz2", "/cut.xz", "/cut.tgz!/a.log"} == set(errors)
        assert all(abs(errors[f"/cut.{k}"]["line_no"] - counts[f"cut.{k}"]) == 0 for k in ("gz", "bz2", "xz"))


def test_a_job_that_fails_is_a_message_and_an_exit_code(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "a.log").write_text("one\n")
    monkeypatch.setattr(Merge, "lines", lambda self: iter(self.spark.sql("SELECT assert_true(id < 0, 'broken disk') AS text FROM range(3)").collect()))
    assert cli.main([str(tmp_path)]) == 1
    assert "weft:" in capsys.readouterr().err


def test_long_lines_take_linear_time(tmp_path):
    path = str(tmp_path / "long")
    with open(path, "wb") as f:
        for _ in range(128):
            f.write(b"x" * 1_000_000)
        f.write(b"\nend")
    began = time.process_time()
    got = [x for r in whole(path, os.path.getsize(path), "plain", split=10_000_000) for x, _ in lines_of(r)[0]]
    assert [len(x) for x in got] == [128_000_000, 3] and time.process_time() - began < 20


class Counting(io.BytesIO):
    read_bytes = 0

    def read(self, n=-1):
        data = super().read(n)
        Counting.read_bytes += len(data)
        return data


@pytest.mark.parametrize("kind", ["zip", "tar"])
def test_archives_are_indexed_without_their_contents(kind, monkeypatch):
    data = packed_as(kind, random.Random(1).randbytes(5_000_000))

    class Store:
        def open_input_file(self, path):
            return Counting(data)

    Counting.read_bytes = 0
    monkeypatch.setattr(listing, "store_of", lambda path, store: (Store(), path))
    found, damage = listing.members(f"a.{kind}", kind)
    assert [x[:2] for x in found] == [("a.log", 5_000_000)] and damage is None and Counting.read_bytes < 80_000


def test_members_of_one_archive_are_read_by_many_tasks(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for k in range(8):
            z.writestr(f"{k}.log", f"member {k}\n" * 5000, [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2, zipfile.ZIP_LZMA][k % 4])
    rows = scan.read_lines(spark, list_sources([str(tmp_path)], spark=spark)).withColumn("task", F.spark_partition_id()).groupBy("file_idx", "line").agg(F.count("*").alias("n"), F.max("task").alias("task")).orderBy("file_idx").collect()
    assert [(r["line"], r["n"]) for r in rows] == [(f"member {k}", 5000) for k in range(8)] and len({r["task"] for r in rows}) >= 3


def test_folders_and_archives_are_looked_at_in_tasks(spark):
    assert listing.spread(spark, lambda x: (x, os.getpid()), [1, 2, 3], 4) == [(x, os.getpid()) for x in (1, 2, 3)]
    found = listing.spread(spark, lambda x: (x, os.getpid()), list(range(50)), 4)
    assert [x for x, _ in found] == list(range(50)) and os.getpid() not in {p for _, p in found}


def test_what_a_task_is_sent_does_not_grow_with_the_sources(monkeypatch):
    """Neither the function that finds an xz file's blocks nor the read function holds all sources."""
    sent = []
    monkeypatch.setattr(scan, "spread", lambda spark, f, items, least=0: sent.append(len(cloudpickle.dumps(f))) or [[(0, 1)] for _ in items])
    for n in (10, 1000):
        found = scan.ranges(Listing([Source(f"/in/{k}.xz", f"/in/{k}.xz", f"{k}.xz", 5000 + k, "xz") for k in range(n)]), packed=1000)
        fresh = scan.LineSource({"plan": scan.plan_of(found), "tasks": "4"})
        source = pickle.loads(pickle.dumps(fresh))  # as the planner gets it
        reader = source.reader(None)
        sent.append(len(cloudpickle.dumps((reader, source))))
        assert [r["path"] for p in reader.partitions() for r in p.ranges] == [f"/in/{k}.xz" for k in range(n)]
    assert sent[0] == sent[2] and sent[1] == sent[3]


def box(path):
    """A store of one's own: box:/name stands for a folder that the environment names."""
    return fs.SubTreeFileSystem("/tmp", fs.LocalFileSystem()), path.removeprefix("box:/").lstrip("/")


def test_stores_of_ones_own_and_uris(spark, tmp_path):
    (tmp_path / "deep er").mkdir()
    for k in range(3):
        (tmp_path / "deep er" / f"{k} é%20.log").write_bytes(b"".join(b"%d line %d\n" % (k, i) for i in range(1000)))
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("m.log", "member\n")
    scan.register(spark)
    for path, options in ((f"file://{tmp_path}", {}), (str(tmp_path), {}), (f"box:/{str(tmp_path).removeprefix('/tmp/')}", {"store": "tests.test_sources:box"})):
        df = spark.read.format("weft_lines").options(**options, split_bytes=700).load(path)
        rows = df.orderBy("source_path", "line_no").collect()
        assert len(rows) == 3001 and {r["alias"] for r in rows} == {"deep er/0 é%20.log", "deep er/1 é%20.log", "deep er/2 é%20.log", "z.zip!/m.log"}
        assert [r["line"] for r in rows if r["alias"][8:9] == "1"] == [f"1 line {i}" for i in range(1000)]
        one = df.where(F.col("alias") == "z.zip!/m.log")
        assert [r["line"] for r in one.collect()] == ["member"] and one.rdd.getNumPartitions() == 1
        assert df.where(F.col("source_path").startswith(f"{path}/deep")).count() == 3000
        assert df.where(F.col("alias").isin("z.zip!/m.log", "none")).count() == 1 and df.where("file_idx = 0").count() == 1000


def test_sources_are_read_and_parsed_once(spark, tmp_path):
    """Counters are observed by the job that writes; when sources are gone, all that is known of them is still there."""
    rng, folder = random.Random(2), tmp_path / "in"
    folder.mkdir()
    for name in "abc":
        (folder / f"{name}.log").write_text("".join(f"2031-01-01 00:{rng.randrange(60):02d}:{rng.randrange(60):02d} INFO {name}{i}\n" if rng.random() < 0.8 else f"  more of {name}\n" for i in range(700)))
    (folder / "d.log.gz").write_bytes(gzip.compress(b"2031-01-01 00:30:00 cut off\n" * 99)[:-9])
    render = RenderOptions(write_timestamp=True, write_level=True, write_line_alias=True, strip_timestamp=True)
    for options in (MergeOptions(render=render, split_bytes=1500), MergeOptions(render=render, since=1_924_993_800_000_000_000, until=1_924_995_000_000_000_000, drop_orphans=True)):
        with Merge(spark, [str(folder)], options) as first:
            want = [list(first.lines()), first.counters().first(), first.input_counters().first(), sorted(first.histograms().collect(), key=repr), first.errors().collect()]
        m = Merge(spark, [str(folder)], options)
        m.write(str(tmp_path / "out"))
        (tmp_path / "in").rename(tmp_path / "gone")
        text = [x for p in sorted((tmp_path / "out").glob("part-*")) for x in p.read_text().splitlines()]
        assert m._counted is not None
        got = [list(m.lines()), m.counters().first(), m.input_counters().first(), sorted(m.histograms().collect(), key=repr), m.errors().collect()]
        assert text == want[0] and got == want and len(text) > 100
        m.close()
        (tmp_path / "gone").rename(tmp_path / "in")
