"""Bands in every form against the plain one, and how much of a file is read."""

import struct
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from terragrist.sources import geotiff, ranged

ROWS, COLS = 70, 90
BOX = (-10.0, 32.5, 12.5, 50.0)


def lzw_pack(data):
    """The plain encoder: longest known run, then one more code."""
    out, bits, have = bytearray(), 0, 0

    def put(code, width):
        nonlocal bits, have
        bits, have = bits << width | code, have + width
        while have >= 8:
            have -= 8
            out.append(bits >> have & 255)

    known = {bytes([i]): i for i in range(256)}
    count, width, run = 258, 9, b""
    put(256, 9)
    for x in data:
        b = bytes([x])
        if run + b in known:
            run += b
            continue
        put(known[run], width)
        known[run + b] = count
        count += 1
        width = 9 if count < 512 else 10 if count < 1024 else 11 if count < 2048 else 12
        run = b
        if count == 4094:
            put(known[run], width)
            put(256, width)
            known = {bytes([i]): i for i in range(256)}
            count, width, run = 258, 9, b""
    if run:
        put(known[run], width)
        count += 1
        width = 9 if count < 512 else 10 if count < 1024 else 11 if count < 2048 else 12
    put(257, width)
    if have:
        put(0, 8 - have)
    return bytes(out)


def packbits_pack(data):
    out = bytearray()
    for at in range(0, len(data), 100):
        part = data[at : at + 100]
        out += bytes([257 - len(part), part[0]]) if len(part) > 1 and len(set(part)) == 1 else bytes([len(part) - 1]) + part
    return bytes(out)


PACK = {None: (1, bytes), "zlib": (8, zlib.compress), "lzw": (5, lzw_pack), "zstd": (50000, lambda d: zstandard.ZstdCompressor().compress(d)), "packbits": (32773, packbits_pack)}


def predicted(block, predictor):
    if predictor == 2:
        u = block.astype(block.dtype.newbyteorder("=")).view(f"u{block.dtype.itemsize}")
        return np.concatenate([u[:, :1], np.diff(u, axis=1)], axis=1).astype(f"u{block.dtype.itemsize}").view(f"u{block.dtype.itemsize}").astype(np.dtype(f"u{block.dtype.itemsize}").newbyteorder(block.dtype.byteorder)).tobytes()
    if predictor == 3:
        rows, cols, bands = block.shape
        planes = block.astype(f">f{block.dtype.itemsize}").reshape(rows, cols * bands).view(np.uint8).reshape(rows, cols * bands, -1).transpose(0, 2, 1).reshape(rows, -1, bands)
        return np.concatenate([planes[:, :1], np.diff(planes, axis=1)], axis=1).astype(np.uint8).tobytes()
    return block.tobytes()


def write(path, data, *, tile=None, strip=16, codec=None, predictor=1, order="<", big=False, crs=4326, nodata=None, planar=False, holes=()):
    data = data.astype(data.dtype.newbyteorder(order))
    rows, cols, bands = data.shape
    number, pack = PACK[codec]
    br, bc = tile or (strip, cols)
    blocks = []
    for plane in [data[:, :, k : k + 1] for k in range(bands)] if planar else [data]:
        for i in range(0, rows, br):
            for j in range(0, cols, bc):
                part = plane[i : i + br, j : j + bc]
                if tile:
                    full = np.zeros((br, bc, plane.shape[2]), dtype=data.dtype)
                    full[: part.shape[0], : part.shape[1]] = part
                    part = full
                blocks.append(b"" if len(blocks) in holes else pack(predicted(np.ascontiguousarray(part), predictor)))
    at, body, where = 16 if big else 8, b"", []
    for x in blocks:
        where.append(at)
        body, at = body + x, at + len(x)
    long = ("Q", 16) if big else ("I", 4)
    o, c = (324, 325) if tile else (273, 279)
    scale = {"f": 3, "i": 2, "u": 1}[data.dtype.kind]
    tags = {256: ("I", 4, [cols]), 257: ("I", 4, [rows]), 258: ("H", 3, [data.dtype.itemsize * 8] * bands), 259: ("H", 3, [number]), 277: ("H", 3, [bands]), 284: ("H", 3, [2 if planar else 1]), 317: ("H", 3, [predictor]), 339: ("H", 3, [scale] * bands)}
    tags |= {o: (*long, where), c: (*long, [len(x) for x in blocks]), 33550: ("d", 12, [0.25, 0.25, 0]), 33922: ("d", 12, [0, 0, 0, -10, 50, 0])}
    tags |= {322: ("I", 4, [bc]), 323: ("I", 4, [br])} if tile else {278: ("I", 4, [strip])}
    if crs:
        tags[34735] = ("H", 3, [1, 1, 0, 1, 2048 if crs == 4326 else 3072, 0, 1, crs])
    if nodata is not None:
        tags[42113] = ("s", 2, [str(nodata).encode() + b"\0"])
    head, room, entry = b"", 8 if big else 4, ("HHQ" if big else "HHI")
    for tag in sorted(tags):
        fmt, kind, values = tags[tag]
        raw = values[0] if fmt == "s" else struct.pack(order + fmt * len(values), *values)
        n = len(raw) if fmt == "s" else len(values)
        if len(raw) > room:
            raw, at, body = struct.pack(order + ("Q" if big else "I"), at), at + len(raw), body + raw
        head += struct.pack(order + entry, tag, kind, n) + raw.ljust(room, b"\0")
    mark = {"<": b"II", ">": b"MM"}[order]
    start = mark + (struct.pack(order + "HHHQ", 43, 8, 0, at) if big else struct.pack(order + "HI", 42, at))
    path.write_bytes(start + body + struct.pack(order + ("Q" if big else "H"), len(tags)) + head + b"\0" * room)
    return str(path)


def band(kind="f4", bands=1, seed=1):
    rng = np.random.default_rng(seed)
    smooth = np.cumsum(rng.integers(-3, 4, (ROWS, COLS, bands)), axis=1) + 100
    return smooth.astype(kind) if np.dtype(kind).kind != "f" else (smooth / 8).astype(kind)


def pixels(df):
    return sorted((round(r[0], 6), round(r[1], 6), r[2]) for r in df.collect())


def plain(data, r=(0, ROWS), c=(0, COLS), k=0, drop=None):
    return sorted((round(-10 + 0.25 * (j + 0.5), 6), round(50 - 0.25 * (i + 0.5), 6), float(data[i, j, k])) for i in range(*r) for j in range(*c) if drop is None or data[i, j, k] != drop)


FORMS = [
    dict(), dict(codec="zlib"), dict(codec="lzw"), dict(codec="zstd"), dict(codec="packbits"), dict(tile=(16, 32)), dict(tile=(32, 16), codec="zlib", predictor=3), dict(tile=(16, 16), codec="lzw", predictor=3, order=">"),
    dict(codec="zlib", predictor=3, big=True), dict(tile=(64, 64), big=True, order=">", codec="zstd"),
]


@pytest.mark.parametrize("form", FORMS, ids=str)
def test_every_form_equals_the_plain_one(spark, tmp_path, form):
    data = band()
    assert pixels(geotiff.read_geotiff(spark, write(tmp_path / "a.tif", data, **form))) == plain(data)


@pytest.mark.parametrize("kind,form", [("i2", dict(codec="zlib", predictor=2)), ("u1", dict(tile=(16, 16), codec="lzw", predictor=2)), ("u4", dict(predictor=2, order=">")), ("f8", dict(codec="zlib", predictor=3))], ids=str)
def test_kinds_of_samples(spark, tmp_path, kind, form):
    data = band(kind, 3)
    for planar in (False, True):
        path = write(tmp_path / f"{planar}.tif", data, planar=planar, **form)
        assert pixels(geotiff.read_geotiff(spark, path, band=2)) == plain(data.astype("f4"), k=1)
    with pytest.raises(Exception, match="band 4 of 3"):
        geotiff.read_geotiff(spark, path, band=4).collect()


def test_windows_nodata_and_masks(spark, tmp_path):
    data = band()
    data[10:20, 10:20] = -9999
    path = write(tmp_path / "a.tif", data, tile=(16, 16), codec="zlib", nodata=-9999, holes=(0,))
    whole = plain(data, drop=-9999)
    kept = [p for p in whole if not (p[0] < -6 and p[1] > 46)]  # block 0 was never written
    assert pixels(geotiff.read_geotiff(spark, path)) == kept
    window = (-8.0, 40.0, -3.0, 46.0)
    inside = [p for p in kept if window[0] < p[0] < window[2] and window[1] < p[1] < window[3]]
    assert pixels(geotiff.read_geotiff(spark, path, window)) == inside
    assert pixels(geotiff.read_geotiff(spark, path, window, mask=F.col("value") > 12)) == [p for p in inside if p[2] > 12]
    found = geotiff.read_geotiff(spark, path).filter("longitude >= -8 and longitude < -3 and latitude > 40 and latitude <= 46")
    assert pixels(found) == inside and found.rdd.getNumPartitions() <= 2
    assert geotiff.read_geotiff(spark, path).filter("longitude > 500").count() == 0
    with pytest.raises(Exception, match="no pixel"):
        geotiff.read_geotiff(spark, path, (100.0, 0.0, 110.0, 10.0)).collect()


def test_reference_systems(spark, tmp_path):
    data = band()
    none, other = write(tmp_path / "n.tif", data, crs=None), write(tmp_path / "o.tif", data, crs=3857)
    with pytest.raises(Exception, match="names no reference system"):
        geotiff.read_geotiff(spark, none).collect()
    assert geotiff.read_geotiff(spark, none, assumed_crs="EPSG:4326").count() == ROWS * COLS
    with pytest.raises(Exception, match="EPSG:3857"):
        geotiff.read_geotiff(spark, other).collect()
    (tmp_path / "x.tif").write_bytes(b"no tiff at all, only text")
    with pytest.raises(Exception, match="no TIFF"):
        geotiff.read_geotiff(spark, str(tmp_path / "x.tif")).collect()


def test_a_small_window_reads_little(tmp_path):
    data = np.random.default_rng(0).normal(size=(1024, 1024, 1)).astype("f4")
    path = write(tmp_path / "a.tif", data, tile=(64, 64))
    reader = geotiff.GeoTiffReader({"path": path, "bounds": "[0.0, 40.0, 1.0, 41.0]"})
    read = []
    old = ranged.RangedFile.close
    ranged.RangedFile.close = lambda self: (read.append(self.bytes_read), old(self))[1]
    try:
        runs = reader.partitions()
        rows = sum(b.num_rows for r in runs for b in reader.read(r))
    finally:
        ranged.RangedFile.close = old
    assert rows == 16 and sum(read) < 40_000 < (tmp_path / "a.tif").stat().st_size / 100  # one tile of 16 KB, headers, and two offsets


def test_blosc_frames():
    """Frames built by the format's description: shuffled, split or not, of several blocks, stored."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    raw = rng.integers(0, 900, 5000).astype("<i4").tobytes()
    shuffle = lambda d, n: np.frombuffer(d, np.uint8).reshape(-1, n).T.tobytes()
    codecs = {1: lambda d: pa.Codec("lz4_raw").compress(d, asbytes=True), 3: zlib.compress, 4: zstandard.ZstdCompressor().compress}
    for number, pack in codecs.items():
        for block in (len(raw), 8000):
            for split in (True, False):
                body, starts, head = b"", [], 16 + 4 * -(-len(raw) // block)
                for at in range(0, len(raw), block):
                    piece = shuffle(raw[at : at + block], 4)
                    n = 4 if split and len(piece) == block else 1
                    starts.append(head + len(body))
                    for k in range(n):
                        part = piece[k * len(piece) // n : (k + 1) * len(piece) // n]
                        packed = pack(part)
                        packed = part if len(packed) >= len(part) else packed
                        body += struct.pack("<i", len(packed)) + packed
                flags = 1 | number << 5 | (0 if split else 0x10)
                frame = struct.pack("<BBBBIII", 2, 1, flags, 4, len(raw), block, head + len(body)) + struct.pack(f"<{len(starts)}i", *starts) + body
                assert ranged.unpack(frame, "blosc") == raw
    stored = struct.pack("<BBBBIII", 2, 1, 0x3, 4, len(raw), len(raw), 16 + len(raw)) + raw
    assert ranged.unpack(stored, "blosc") == raw
    with pytest.raises(ValueError):
        ranged.blosc(struct.pack("<BBBBIII", 2, 1, 0x4 | 1 << 5, 4, 8, 8, 24) + b"\0" * 8)


def test_codecs_of_odd_data():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 255, 3000, 20000):
        for high in (2, 256):
            data = rng.integers(0, high, n).astype(np.uint8).tobytes()
            assert ranged.lzw(lzw_pack(data)) == data and ranged.packbits(packbits_pack(data)) == data
    with pytest.raises(ValueError):
        ranged.unpack(b"", "unknown")
