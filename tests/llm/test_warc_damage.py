"""WARC files cut at every byte, and with bytes flipped: nothing hangs, and nothing damaged reads as whole."""

import gzip
import io
import random

import pyarrow as pa
import pytest

from weft.llm import warc

PAYLOADS = [b"first payload", b"", random.Random(1).randbytes(700), b"last " * 20]


def archive(kind):
    """The bytes of an archive, and where its records (or their members) end."""
    out, ends = b"", []
    for i, p in enumerate(PAYLOADS):
        block = warc.http_block(p)
        headers = {"WARC-Type": "response", "WARC-Record-ID": f"<{i}>", "Content-Type": "application/http", warc.LENGTH: str(len(p))}
        if kind == "plain":
            headers[warc.BLOCK] = f"sha256:{warc.hashlib.sha256(block).hexdigest()}"
        data = warc.record(headers, block)
        out += {"plain": lambda x: x, "sl": warc.member, "gzip": gzip.compress, "one": lambda x: x}[kind](data)
        ends.append(len(out))
    return (gzip.compress(out), [len(gzip.compress(out))]) if kind == "one" else (out, ends)


class File(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def read(data, kind, payload="bytes", piece=64):
    reader = warc.WarcReader({"path": "x", "payload": payload, "damage": "row"})
    rows = list(reader._rows((warc.Records if kind == "plain" else warc._Gzip)(File(data), piece)))
    return [(r["record_id"], d) for r, d, e in rows if not e], [e for _, _, e in rows if e]


KINDS = ["plain", "sl", "gzip", "one"]


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("payload", ["bytes", "none"])
def test_cut_at_every_byte(kind, payload):
    data, ends = archive(kind)
    want = [(f"<{i}>", p if payload == "bytes" else None) for i, p in enumerate(PAYLOADS)]
    assert read(data, kind, payload) == (want, []) == read(data, kind, payload, 100_000)
    for cut in range(len(data)):
        for piece in (64, 100_000):
            got, errors = read(data[:cut], kind, payload, piece)
            whole = sum(e <= cut for e in ends)
            if kind == "one":
                assert got == want[: len(got)] and (errors or not cut)
            else:
                assert got == want[:whole] and bool(errors) == (cut not in (0, *ends))


@pytest.mark.parametrize("kind", ["plain", "sl", "gzip"])
def test_flipped_bytes(kind):
    """A flipped byte is never in what reads as a whole record, but for the text of a plain file's headers."""
    data, _ = archive(kind)
    want = {f"<{i}>": p for i, p in enumerate(PAYLOADS)}
    for at in range(len(data)):
        bad = data[:at] + bytes([data[at] ^ 0x15]) + data[at + 1 :]
        got, errors = read(bad, kind)
        assert all(d in PAYLOADS or (kind == "plain" and d in map(warc.http_block, PAYLOADS)) for _, d in got)  # a content type may be another
        assert all(kind == "plain" or want.get(i) == d for i, d in got)
        read(bad, kind, "none")
        assert len(got) == 4 or errors or kind == "plain"


def test_padding_garbage_and_headers_without_end():
    data, _ = archive("gzip")
    assert len(read(data + b"\0" * 100, "gzip")[0]) == 4 and not read(data + b"\0" * 100, "gzip")[1]
    got, errors = read(data + b"garbage", "gzip")
    assert len(got) == 4 and errors
    got, errors = read(archive("plain")[0] + b"WARC/1.1\r\n" + b"x: y\r\n" * 300_000, "plain", piece=16_384)
    assert len(got) == 4 and "no end" in str(errors[0])


@pytest.mark.parametrize("compress", ["true", "false"])
def test_damage_fails_or_is_a_row(spark, tmp_path, compress):
    warc.register(spark)
    row = lambda i: {"record_type": "resource", "record_id": f"<{i}>", "payload": random.Random(i).randbytes(50_000)}
    writer = warc.WarcWriter({"path": str(tmp_path), "compress": compress})
    writer.commit([writer.write(iter([pa.RecordBatch.from_pylist([row(i) for i in range(5)])]))])
    path = next(p for p in tmp_path.iterdir())
    path.write_bytes(path.read_bytes()[:-20_000])
    read = spark.read.format("warc")
    rows = read.option("damage", "row").load(str(tmp_path)).collect()
    good = [r for r in rows if r["error"] is None and r["record_type"] == "resource"]
    assert sorted((r["record_id"], bytes(r["payload"])) for r in good) == [(f"<{i}>", row(i)["payload"]) for i in range(4)]
    told = [r for r in rows if r["error"]]
    assert len(told) == 1 and path.name in told[0]["error"] and "at byte" in told[0]["error"] and told[0]["record_id"] is None
    with pytest.raises(Exception, match="is damaged: it is cut"):
        spark.read.format("warc").load(str(tmp_path)).collect()
