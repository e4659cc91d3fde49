"""Growing files and the ordered merge of a stream, against the batch order of all their lines."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import GroupedData

from weft.operators.timeline import with_running
from weft.plans.merge import parse_lines
from weft.plans.queries import QUERIES
from weft.streaming import growing
from weft.streaming.merge import StreamMerge
from weft.streaming.timeline import keyed_writer


def run(spark, folder, state, **options):
    """One start of the stream, which takes all there is, and ends; the number of its last batch."""
    growing.register(spark)
    merge = StreamMerge(spark, f"{state}/m", f"{state}/out", idle=options.pop("idle", 10))
    query = merge.writer(spark.readStream.format("weft_tail").options(**options).load(str(folder))).start()
    query.processAllAvailable()
    last = query.lastProgress["batchId"] if query.lastProgress else -1
    query.stop()
    batches = [p["batchId"] for p in query.recentProgress if p["numInputRows"]]
    return merge, max(batches) if batches else last


def ordered(rows):
    return [(r["path"].rpartition("/")[2], r["line"]) for r in sorted(rows, key=lambda r: (r["batch"], r["merge_key"], r["path"], r["file_idx"], r["line_no"]))]


def model(files):
    """(name, line) of the stable merge by (running maximum, name, line)."""
    out = []
    for name, lines in files.items():
        high = ""
        for n, line in enumerate(lines):
            high = max(high, line[:19] if line[:2] == "20" else "")
            out.append((high, name, n, line))
    return [(name, line) for _, name, _, line in sorted(out)]


def line(rng, at):
    return f"2031-01-01 00:{at // 60:02d}:{at % 60:02d} INFO {rng.randrange(10**6)}" if rng.random() < 0.8 else f"  detail {rng.randrange(10**6)}"


def test_batches_one_after_another_are_the_batch_merge(spark, tmp_path):
    rng, files, at = random.Random(1), {f"{c}.log": [] for c in "abc"}, dict.fromkeys(("a.log", "b.log", "c.log"), 0)
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(3):  # three starts; files grow between them by unlike amounts, the last line of one is still being written
        for name in files:
            new = []
            for _ in range(rng.randrange(20, 60)):
                at[name] = max(0, at[name] + rng.choice([0, 1, 2, 9, -5]))
                new.append(line(rng, at[name]))
            files[name] += new
            with open(folder / name, "a") as f:
                f.write("".join(f"{x}\n" for x in new) + ("" if k < 2 or name != "c.log" else "half a li"))
        merge, last = run(spark, folder, tmp_path, split_bytes=300)
    merge.flush(last)
    rows = merge.rows().collect()
    assert ordered(rows) == model(files) and len({r["batch"] for r in rows}) == 4 and not any(r["late"] for r in rows)


def test_late_sources_lose_nothing(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    late = "2031-01-01 00:00:01 late"
    (folder / "a.log").write_text("2031-01-01 00:00:05 one\n2031-01-01 00:00:09 two\n")
    run(spark, folder, tmp_path)
    (folder / "b.log").write_text(late + "\n2031-01-01 00:00:20 b\n")
    with open(folder / "a.log", "a") as f:
        f.write("2031-01-01 00:00:30 three\n")
    merge, last = run(spark, folder, tmp_path)
    merge.flush(last)
    rows = merge.rows().collect()
    assert sorted(r["line"] for r in rows) == sorted([late, "2031-01-01 00:00:20 b", "2031-01-01 00:00:05 one", "2031-01-01 00:00:09 two", "2031-01-01 00:00:30 three"])
    assert [r["line"] for r in rows if r["late"]] == [late]
    assert [x for _, x in ordered(rows) if x != late] == sorted(x for x in (r["line"] for r in rows) if x != late)


class Reader:
    """A reader driven by hand: what each poll brings."""

    def __init__(self, folder, **options):
        self.reader = growing.TailReader({"path": str(folder), **options})
        self.at = self.reader.initialOffset()

    def poll(self, restart=False):
        if restart:
            self.reader = growing.TailReader({"path": self.reader.path, "split_bytes": str(self.reader.split)})
        end = self.reader.latestOffset()
        found = [pa.Table.from_batches([b]) for p in self.reader.partitions(self.at, end) for b in self.reader.read(p)]
        self.at = end
        rows = pa.concat_tables(found).to_pylist() if found else []
        assert len({(r["source"], r["line_no"]) for r in rows}) == len(rows)
        return [r["line"] for r in sorted(rows, key=lambda r: (r["source"], r["line_no"]))]


@pytest.mark.parametrize("split", ["1", "5", "1000000"])
def test_rotation_truncation_and_restarts(tmp_path, split):
    log = tmp_path / "a.log"
    r = Reader(tmp_path, split_bytes=split)
    assert r.poll() == []
    log.write_text("one\ntwo\nhal")
    assert r.poll() == ["one", "two"]
    assert r.poll() == []
    log.write_text("one\ntwo\nhalf\n\nlast\n")
    assert r.poll(restart=True) == ["half", "", "last"]
    log.rename(tmp_path / "a.log.1")
    log.write_text("new file\n")
    with open(tmp_path / "a.log.1", "a") as f:
        f.write("behind the rotation\n")
    assert sorted(r.poll()) == ["behind the rotation", "new file"]
    log.write_text("x\ny\n")  # truncated and written anew
    assert r.poll(restart=True) == ["x", "y"]
    (tmp_path / "a.log.1").unlink()
    assert r.poll() == []


def test_long_lines(tmp_path):
    lines = ["a" * 5000, "b", "c" * 200_000, "", "d"]
    (tmp_path / "a.log").write_text("".join(f"{x}\n" for x in lines) + "e" * 100_000)
    assert Reader(tmp_path, split_bytes="999").poll() == lines


def test_many_small_files_are_few_tasks(tmp_path):
    for k in range(200):
        (tmp_path / f"{k:03d}.log").write_text("".join(f"{k} line {i}\n" for i in range(20)))
    reader = growing.TailReader({"path": str(tmp_path), "split_bytes": "50", "tasks": "6"})
    assert 6 <= len(reader.partitions({}, reader.latestOffset())) <= 8
    assert sorted(Reader(tmp_path, split_bytes="50", tasks="6").poll()) == sorted(f"{k} line {i}" for k in range(200) for i in range(20))


def test_keys_of_batches_are_those_of_all_lines(spark, tmp_path):
    rng, rows = random.Random(2), []
    for n in range(90):  # 0 mixed, 1 without a time, 2 before 1970, 3 only from the second batch on, 4 only in the first
        rows += [(0, n, line(rng, rng.randrange(100))), (1, n, "none"), (2, n, f"1969-05-01 00:00:{rng.randrange(60):02d} old" if n > 5 else "none")]
        rows += [(3, n, line(rng, n))] * (n >= 40) + [(4, n, line(rng, n))] * (n < 20)
    schema = "file_idx int, line_no bigint, line string"
    for k in range(3):
        spark.createDataFrame([r for r in rows if r[1] // 30 == k], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    keyed_writer(stream, str(tmp_path / "m"), str(tmp_path / "out"), chunk=7).trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out"))
    assert found.select("batch").distinct().count() == 3
    columns = ["file_idx", "line_no", "line", "ts_ns", "level", "block_ts", "merge_key"]
    want = with_running(parse_lines(spark.createDataFrame(rows, schema)))
    assert sorted(map(tuple, found.select(columns).collect()), key=repr) == sorted(map(tuple, want.select(columns).collect()), key=repr)


def test_stream_keys_takes_no_source_into_one_task(spark, monkeypatch):
    def whole(*_):
        raise AssertionError("a source's lines in one task's memory")

    monkeypatch.setattr(GroupedData, "applyInPandasWithState", whole)
    assert QUERIES["stream_keys"](spark, "/root/testdata/sf0.001").count() == 1000
