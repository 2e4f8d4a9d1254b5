"""Files read by ranges from within tasks, and the codecs of their blocks.

Local files and the stores that Arrow's file systems know (file, hdfs, s3, gs) are read by ranges; `can_range` says whether a path is one of
these. Other stores, which only Spark's own readers reach, are read whole by them.
"""

from __future__ import annotations

import struct
import zlib
from urllib.parse import urlparse

import numpy as np

SCHEMES = ("", "file", "hdfs", "s3", "gs")


def can_range(path: str) -> bool:
    return urlparse(path).scheme in SCHEMES


class RangedFile:
    """A file opened for reads of single ranges; `bytes_read` counts what was asked for."""

    def __init__(self, path: str) -> None:
        from pyarrow import fs

        if urlparse(path).scheme in ("", "file"):
            system, where = fs.LocalFileSystem(), urlparse(path).path if path.startswith("file:") else path
        else:
            system, where = fs.FileSystem.from_uri(path)
        self._file = system.open_input_file(where)
        self.size, self.bytes_read = self._file.size(), 0

    @classmethod
    def open(cls, path: str) -> RangedFile | None:
        """None if there is no such file."""
        try:
            return cls(path)
        except FileNotFoundError:
            return None

    def read(self, at: int, n: int) -> bytes:
        n = max(0, min(n, self.size - at))
        self.bytes_read += n
        return self._file.read_at(n, at) if n else b""

    def whole(self) -> bytes:
        return self.read(0, self.size)

    def close(self) -> None:
        self._file.close()

    def __enter__(self) -> RangedFile:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def packbits(data: bytes) -> bytes:
    """Runs of bytes: a count below 128 goes before literal bytes, one above before a byte that repeats."""
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        at += 1
        if n < 128:
            out += data[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += data[at : at + 1] * (257 - n)
            at += 1
    return bytes(out)


def lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first: 256 begins anew, 257 ends, and the width grows one code early, as TIFF has it."""
    table = [bytes([i]) for i in range(256)] + [b"", b""]
    known, out = table.copy(), bytearray()
    bits = have = at = 0
    width, last = 9, b""
    while True:
        while have < width:
            if at >= len(data):
                return bytes(out)
            bits = (bits << 8 | data[at]) & 0xFFFFFF
            have += 8
            at += 1
        have -= width
        code = bits >> have & ((1 << width) - 1)
        if code == 257:
            return bytes(out)
        if code == 256:
            known, width, last = table.copy(), 9, b""
            continue
        if not last:
            entry = known[code]
        else:
            if code > len(known):
                raise ValueError("broken LZW data")
            entry = known[code] if code < len(known) else last + last[:1]
            known.append(last + entry[:1])
        out += entry
        last = entry
        width = 9 if len(known) < 511 else 10 if len(known) < 1023 else 11 if len(known) < 2047 else 12


def unshuffle(data: bytes, size: int) -> bytes:
    """First bytes of all items, then second ones, and so on, back to items; a rest that fills no item stays."""
    n = len(data) // size * size
    return np.frombuffer(data[:n], dtype=np.uint8).reshape(size, -1).T.tobytes() + data[n:]


def _lz4_block(data: bytes, size: int) -> bytes:
    import pyarrow as pa

    return pa.Codec("lz4_raw").decompress(data, decompressed_size=size, asbytes=True)


def _zstd(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(data)


def _snappy(data: bytes, size: int) -> bytes:
    import pyarrow as pa

    return pa.Codec("snappy").decompress(data, decompressed_size=size, asbytes=True)


def blosc(data: bytes) -> bytes:
    """A frame of version 1 or 2 of the public format: a header of 16 bytes, starts of blocks, and blocks of streams that are packed one by one, then byte-shuffled.

    Inner codecs: lz4 (and lz4hc), snappy, zlib, zstd. Bit-shuffled frames and those of the format's own codec raise ValueError.
    """
    flags, item = data[2], data[3]
    size, block, packed = struct.unpack_from("<III", data, 4)
    codec = flags >> 5
    if flags & 0x2:  # stored as it is
        return data[16 : 16 + size]
    if flags & 0x4 or codec == 0:
        raise ValueError("bit-shuffled frames and the codec blosclz are not supported")
    inner = {1: _lz4_block, 2: _snappy, 3: lambda d, n: zlib.decompress(d), 4: lambda d, n: _zstd(d)}[codec]
    blocks = -(-size // block)
    starts = struct.unpack_from(f"<{blocks}i", data, 16)
    out = []
    for k, at in enumerate(starts):
        whole = min(block, size - k * block)
        # a block is dealt to one stream a byte of the item, unless that is switched off or it is the odd last one
        streams = item if not flags & 0x10 and whole == block and 1 < item <= 16 and block // item >= 128 else 1
        parts, each = [], whole // streams
        for _ in range(streams):
            (n,) = struct.unpack_from("<i", data, at)
            raw = data[at + 4 : at + 4 + n]
            parts.append(raw if n == each else inner(raw, each))
            at += 4 + n
        piece = b"".join(parts)
        out.append(unshuffle(piece, item) if flags & 0x1 and item > 1 else piece)
    got = b"".join(out)
    if len(got) != size or packed > len(data):
        raise ValueError("broken frame")
    return got


def unpack(data: bytes, codec: str | None) -> bytes:
    """The bytes of a block in a codec by name; None is plain."""
    if codec is None or codec in ("bytes", "none"):
        return data
    if codec in ("zlib", "gzip"):
        return zlib.decompress(data, zlib.MAX_WBITS | 32)
    if codec == "zstd":
        return _zstd(data)
    if codec == "blosc":
        return blosc(data)
    if codec == "lzw":
        return lzw(data)
    if codec == "packbits":
        return packbits(data)
    raise ValueError(f"codec {codec!r} is not supported")


def undo_predictor(block: np.ndarray, predictor: int, order: str) -> np.ndarray:
    """Rows of (row, column, band) samples of a TIFF as they were before prediction: 1 none, 2 differences along a row, 3 differences of the bytes of floats.

    For 3, a row comes as bytes (row, bytes) of all samples' high bytes first.
    """
    if predictor == 1:
        return block
    if predictor == 2:
        kind = block.dtype
        plain = block.astype(kind.newbyteorder("="))
        unsigned = plain.view(f"u{kind.itemsize}")
        return np.cumsum(unsigned, axis=1, dtype=unsigned.dtype).view(plain.dtype)
    raise ValueError(f"predictor {predictor} is not supported")


def undo_float_predictor(raw: bytes, rows: int, cols: int, bands: int, item: int) -> np.ndarray:
    """Predictor 3: (row, column, band) floats from rows of byte planes, high bytes first, each byte the difference to the one `bands` before it."""
    data = np.frombuffer(raw, dtype=np.uint8)[: rows * cols * bands * item].reshape(rows, cols * item, bands)
    planes = np.cumsum(data, axis=1, dtype=np.uint8).reshape(rows, item, cols * bands)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(f">f{item}").reshape(rows, cols, bands).astype(f"f{item}")
