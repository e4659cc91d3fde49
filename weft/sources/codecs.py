"""Decoders that hand over what they have decoded before damage stops them, and places where compressed files can be cut.

A bzip2 file is cut anywhere: its blocks begin with a magic number, at any bit, and each is decoded as a
stream of its own. Where that number stands by chance, decoding fails and the block is taken on to the
next one. An xz file is cut at the blocks that the indexes at its streams' ends name.
"""

from __future__ import annotations

import bz2
import io
import lzma
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Iterator
from typing import IO, NamedTuple

PIECE = 1 << 20
#: What damaged bytes raise. Other errors (a failing disk, a file that is gone) are not theirs.
DAMAGE = (EOFError, lzma.LZMAError, zlib.error, zipfile.BadZipFile, tarfile.TarError, ValueError, struct.error)
# Fixed values of the formats.
BZ_BLOCK, BZ_END = 0x314159265359, 0x177245385090
XZ_HEAD, XZ_FOOT = b"\xfd7zXZ\x00", b"YZ"
#: Bytes of a bzip2 block at most, compressed.
BZ_MOST = 1_200_000


def raw(file: IO[bytes], start: int, end: int, piece: int = PIECE) -> Iterator[bytes]:
    """The bytes from start to end."""
    file.seek(start)
    while start < end:
        data = file.read(min(piece, end - start))
        if not data:
            raise EOFError(f"the file ends at {start}, {end - start} bytes early")
        start += len(data)
        yield data


def inflated(packed: Iterator[bytes], bits: int = 31) -> Iterator[bytes]:
    """Of gzip members (31) one after another, or of one raw stream (-15)."""
    decoder, begun = zlib.decompressobj(bits), False
    for data in packed:
        while data:
            if decoder.eof:
                if bits == -15:
                    return
                data = data.lstrip(b"\0")  # members may be padded
                if not data:
                    break
                decoder, begun = zlib.decompressobj(bits), False
            out = decoder.decompress(data, PIECE)
            data, begun = decoder.unconsumed_tail or decoder.unused_data, True
            if out:
                yield out
    while begun and not decoder.eof and (out := decoder.decompress(decoder.unconsumed_tail, PIECE)):
        yield out
    if begun and not decoder.eof:
        raise EOFError("the compressed stream ends early")


def unpacked_xz(packed: Iterator[bytes]) -> Iterator[bytes]:
    decoder, begun = lzma.LZMADecompressor(lzma.FORMAT_XZ), False
    for data in packed:
        while data or (begun and not decoder.eof and not decoder.needs_input):
            if decoder.eof:
                data = data.lstrip(b"\0")  # streams may be padded
                if not data:
                    break
                decoder, begun = lzma.LZMADecompressor(lzma.FORMAT_XZ), False
            out, begun = decoder.decompress(data, PIECE), True
            data = decoder.unused_data if decoder.eof else b""
            if out:
                yield out
    if begun and not decoder.eof:
        raise EOFError("the compressed stream ends early")


def decoded(kind: str, file: IO[bytes]) -> Iterator[bytes]:
    """All of a file of kind plain, gz, bz2 or xz."""
    size = file.seek(0, io.SEEK_END)
    if kind == "bz2":
        return bz_range(file, 0, size, size)
    packed = raw(file, 0, size)
    return {"plain": lambda x: x, "gz": inflated, "xz": unpacked_xz}[kind](packed)


class Chunks(io.RawIOBase):
    """A stream of chunks. Where they stop with damage, zeros follow; error tells it, good how many bytes came before."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.held, self.good, self.error = chunks, memoryview(b""), 0, None

    def readable(self) -> bool:
        return True

    def readinto(self, buffer: memoryview) -> int:
        while not self.held and not self.error:
            try:
                data = next(self.chunks)
            except StopIteration:
                return 0
            except (*DAMAGE, OSError) as error:
                if not damaged(error):
                    raise
                self.error = error
            else:
                self.held, self.good = memoryview(data), self.good + len(data)
        if self.error and not self.held:
            buffer[:] = bytes(len(buffer))
            return len(buffer)
        n = min(len(buffer), len(self.held))
        buffer[:n], self.held = self.held[:n], self.held[n:]
        return n


def damaged(error: BaseException) -> bool:
    """Whether the bytes are at fault: errors of formats, and those of decoders, which carry no number."""
    return isinstance(error, DAMAGE) or (isinstance(error, OSError) and error.errno is None)


# xz


class Block(NamedTuple):
    at: int
    packed: int
    size: int
    flags: bytes


def _number(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        shift += 7
        if b < 128:
            return value, at


def _numbered(value: int) -> bytes:
    out = b""
    while value > 127:
        out, value = out + bytes([value & 127 | 128]), value >> 7
    return out + bytes([value])


def xz_blocks(file: IO[bytes]) -> list[Block]:
    """The blocks of all streams, from the indexes at their ends; ValueError if a file doesn't end as it should."""
    end, out = file.seek(0, io.SEEK_END), []

    def read(at: int, n: int) -> bytes:
        file.seek(at)
        data = file.read(n)
        if at < 0 or len(data) != n:
            raise ValueError("no index")
        return data

    while end:
        foot = read(end - 12, 12)
        if foot[8:] == b"\0" * 4:
            end -= 4
            continue
        check, back = struct.unpack("<II", foot[:8])
        if foot[10:] != XZ_FOOT or zlib.crc32(foot[4:10]) != check:
            raise ValueError("no index")
        length = (back + 1) * 4
        index = read(end - 12 - length, length)
        if index[0] or zlib.crc32(index[:-4]) != struct.unpack("<I", index[-4:])[0]:
            raise ValueError("no index")
        many, at = _number(index, 1)
        own = []
        for _ in range(many):
            packed, at = _number(index, at)
            size, at = _number(index, at)
            own.append((packed, size))
        begin = end - 12 - length - sum(-(-p // 4) * 4 for p, _ in own) - 12
        if read(begin, 6) != XZ_HEAD:
            raise ValueError("no index")
        place, blocks = begin + 12, []
        for packed, size in own:
            blocks.append(Block(place, packed, size, foot[8:10]))
            place += -(-packed // 4) * 4
        out, end = blocks + out, begin
    return out


def xz_range(file: IO[bytes], blocks: list[Block]) -> Iterator[bytes]:
    """The blocks' bytes: each block is made a stream of its own."""
    for b in blocks:
        index = b"\0\1" + _numbered(b.packed) + _numbered(b.size)
        index += bytes(-len(index) % 4)
        index += struct.pack("<I", zlib.crc32(index))
        foot = struct.pack("<I", len(index) // 4 - 1) + b.flags
        head = XZ_HEAD + b.flags + struct.pack("<I", zlib.crc32(b.flags))
        tail = index + struct.pack("<I", zlib.crc32(foot)) + foot + XZ_FOOT
        packed = raw(file, b.at, b.at + -(-b.packed // 4) * 4)

        def stream(head: bytes = head, packed: Iterator[bytes] = packed, tail: bytes = tail) -> Iterator[bytes]:
            yield head
            yield from packed
            yield tail

        yield from unpacked_xz(stream())


# bzip2


def _marks(data: bytes, base: int, magic: int) -> list[int]:
    """The bits, from base bytes on, where a 48-bit magic number stands."""
    found = []
    for shift in range(8):
        # the 5 whole bytes inside it, if it starts `shift` bits into a byte
        inner = ((magic >> shift) & ((1 << 40) - 1)).to_bytes(5, "big") if shift else magic.to_bytes(6, "big")
        at = data.find(inner)
        while at >= 0:
            first = at if shift == 0 else at - 1
            if shift == 0 or (first >= 0 and first + 7 <= len(data) and (int.from_bytes(data[first : first + 7], "big") >> (8 - shift)) & ((1 << 48) - 1) == magic):
                found.append((base + first) * 8 + shift)
            at = data.find(inner, at + 1)
    return sorted(found)


def bz_marks(file: IO[bytes], start: int, end: int, size: int) -> list[tuple[int, bool]]:
    """(bit, whether a block begins there) of the magic numbers that start in bytes start to end; else a stream ends."""
    found: list[tuple[int, bool]] = []
    for at in range(start, end, PIECE):
        to = min(at + PIECE, end)
        file.seek(at)
        data = file.read(min(to + 7, size) - at)
        found += [(m, block) for magic, block in ((BZ_BLOCK, True), (BZ_END, False)) for m in _marks(data, at, magic) if m < to * 8]
    return sorted(found)


def _bz_block(file: IO[bytes], start: int, end: int) -> bytes | None:
    """The block of bits start to end, decoded as a stream of one block; None if there is none."""
    file.seek(start // 8)
    data = file.read(-(-end // 8) - start // 8)
    n = end - start
    bits = (int.from_bytes(data, "big") >> (len(data) * 8 - start % 8 - n)) & ((1 << n) - 1)
    check = (bits >> (n - 80)) & 0xFFFFFFFF
    bits = ((bits << 48 | BZ_END) << 32) | check
    n += 80
    pad = -n % 8
    try:
        return bz2.decompress(b"BZh9" + (bits << pad).to_bytes((n + pad) // 8, "big"))
    except (OSError, ValueError, EOFError):
        return None


def bz_range(file: IO[bytes], start: int, end: int, size: int) -> Iterator[bytes]:
    """The bytes of the blocks that begin in bytes start to end."""
    if start == 0 and size:
        file.seek(0)
        if file.read(3) != b"BZh":
            raise ValueError("not a bzip2 file")
    marks, reach, k = bz_marks(file, start, end, size), end, 0
    while k < len(marks) and marks[k][0] < end * 8:
        at, block = marks[k]
        data, to = None, k
        while block and data is None and to < k + 3:
            to += 1
            while to >= len(marks) and reach < size:  # the last block reaches beyond the range
                marks += bz_marks(file, reach, min(reach + BZ_MOST, size), size)
                reach = min(reach + BZ_MOST, size)
            if to >= len(marks):
                break
            data = _bz_block(file, at, marks[to][0])
        if data is not None:
            yield data
            k = to
        elif block and not _inside(file, at, [m for m, _ in marks[k + 1 : k + 3]], size):
            raise EOFError(f"the block at byte {at // 8} is damaged or cut")
        else:
            k += 1
    if end == size and size and not any(not block for _, block in marks) and not _ends(file, size):
        raise EOFError("the compressed stream ends early")


def _inside(file: IO[bytes], at: int, ends: list[int], size: int) -> bool:
    """Whether a magic number at a bit stands by chance inside a block that begins before it."""
    before = [m for m, block in bz_marks(file, max(0, at // 8 - BZ_MOST), at // 8, size) if block]
    return bool(before) and any(_bz_block(file, before[-1], e) is not None for e in ends)


def _ends(file: IO[bytes], size: int) -> bool:
    """Whether a stream's end mark stands near the file's end."""
    return any(not block for _, block in bz_marks(file, max(0, size - 4096), size, size))
