"""Media columns: bytes as 8-bit WAV, and spectral-peak pair fingerprints of WAV bytes.

A recording is cut into frames, each frame's short-time Fourier transform is taken, the largest
local maxima of a frame are its peaks, and each peak is paired with the peaks of the next few
frames. A pair is stored as (time, code): the frame of its first peak, and both frequencies and the
distance in time in one number; a recording's fingerprint is the array of its pairs, by time, then code.
Frames are transformed and paired in blocks of `BLOCK`, so a recording takes a few copies of its bytes,
its pairs (at most PEAKS * PEAKS * AHEAD for each HOP bytes, 8 bytes each) and one block's spectra.

An empty table gives an empty result. Null texts are empty texts; an empty text is one padded unit of bytes 255. Repeated rows give
repeated results. A column named as a result is replaced by the result, others pass through.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from weft.llm.common import as_bytes, slices

#: The production parameters: bytes of padding, samples a second, of a frame and between frames, peaks of a frame, frames ahead that a peak pairs with.
UNIT = 576
RATE = 8000
FRAME, HOP = 576, 288
PEAKS, AHEAD = 3, 3
BLOCK = 512


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def padded(data: bytes, unit: int = UNIT) -> bytes:
    return data + b"\xff" * (max(1, -(-len(data) // unit)) * unit - len(data))


def peaks(samples: bytes, frame: int = FRAME, hop: int = HOP, most: int = PEAKS) -> np.ndarray:
    """The frequency bins of each frame's largest local maxima, strongest first; -1 where there are fewer."""
    x = np.frombuffer(samples, np.uint8)
    if len(x) < frame:
        x = np.concatenate([x, np.full(frame - len(x), 128, np.uint8)])
    frames = np.lib.stride_tricks.sliding_window_view(x, frame)[::hop]
    window = np.hanning(frame).astype(np.float32)
    out = np.full((len(frames), most), -1, np.int32)
    for at in range(0, len(frames), BLOCK):
        block = (frames[at : at + BLOCK].astype(np.float32) - 128) * window
        power = np.abs(np.fft.rfft(block, axis=1)[:, 1:]).round(3)
        inner = power[:, 1:-1]
        top = np.where((inner > power[:, :-2]) & (inner >= power[:, 2:]), inner, 0)
        best = np.argsort(-top, axis=1, kind="stable")[:, :most]
        out[at : at + BLOCK] = np.where(np.take_along_axis(top, best, 1) > 0, best + 2, -1)
    return out


def fingerprint(samples: bytes, ahead: int = AHEAD) -> tuple[np.ndarray, np.ndarray]:
    """Times (frames) and codes of all pairs, by time, then code."""
    bins = peaks(samples)
    found = []
    for at in range(0, len(bins), BLOCK):
        times, codes = [], []
        for d in range(1, ahead + 1):
            second = bins[at + d : at + d + BLOCK, None, :]
            first = bins[at : at + len(second), :, None]
            t, i, j = np.nonzero((first >= 0) & (second >= 0))
            times.append(t.astype(np.int32) + np.int32(at))
            codes.append((first[t, i, 0] << 20) | (second[t, 0, j] << 8) | d)
        t, c = np.concatenate(times), np.concatenate(codes)
        order = np.lexsort((c, t))
        found.append((t[order], c[order].astype(np.int32)))
    return np.concatenate([t for t, _ in found]), np.concatenate([c for _, c in found])


def feature(times: np.ndarray, codes: np.ndarray, n_frames: int) -> str:
    """A short form of a fingerprint: frames, pairs, a checksum of the pairs."""
    return f"{n_frames}:{len(codes)}:{zlib.crc32(np.column_stack([times, codes]).astype('<i4').tobytes()):08x}"


def _pairs(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    """Fingerprints as a column of arrays."""
    ends = np.cumsum([0, *(len(t) for t, _ in found)])
    flat = [pa.array(np.concatenate([x[k] for x in found]), pa.int32()) for k in (0, 1)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(flat, names=["time", "code"]))


def media_columns(df: DataFrame, text: str = "text", media: bool = True) -> DataFrame:
    """df with n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature and pairs of each text.

    pairs is the fingerprint, an array of (time, code); media=True adds the WAV itself.
    """
    result = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    result += ", pairs array<struct<time:int,code:int>>" + (", media binary" if media else "")
    fields = T._parse_datatype_string(result).fields
    kept = [c for c in df.columns if c not in {f.name for f in fields}]
    needed = [*kept, *([text] if text not in kept else [])]

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            rows, found, kept_media = [], [], []
            for data in as_bytes(b[text]):
                data = data or b""
                stored = to_wav(padded(data))
                back = from_wav(stored)
                found.append(fingerprint(back))
                rows.append((len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(*found[-1], 1 + (len(back) - FRAME) // HOP)))
                if media:
                    kept_media.append(stored)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            out = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in kept), *out, _pairs(found), *([pa.array(kept_media, pa.binary())] if media else [])], names=[*kept, *(f.name for f in fields)])

    return df.select(*needed).mapInArrow(convert, T.StructType([*(df.schema[c] for c in kept), *fields]))
