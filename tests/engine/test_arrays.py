"""Arrays in each form of storage against the plain one, and sparse sampling."""

import json
import os
import zlib

import numpy as np
import pytest
import zstandard

from terragrist.sources.raster import Layout, PointReader, RasterMetadata, ZarrRaster

SHAPE, CHUNKS, INNER = (5, 40, 36), (2, 16, 12), (2, 8, 4)
ABOUT = {"transform_mat3x3": [0.5, 0, -10, 0, -0.5, 50, 0, 0, 1], "index_values": [2, 5, 10, 50, 100], "index_name": "return period"}
META = RasterMetadata("flood", "depth", "p", 2050, "m")
ZSTD = zstandard.ZstdCompressor().compress


def array():
    out = np.random.default_rng(1).normal(size=SHAPE).astype("f4")
    out[:, 16:32, 12:24] = np.nan  # a chunk that is not stored
    return out


def blocks(data, chunks):
    for at in np.ndindex(*(-(-n // c) for n, c in zip(data.shape, chunks))):
        part = data[tuple(slice(i * c, (i + 1) * c) for i, c in zip(at, chunks))]
        if np.isfinite(part).any():
            full = np.full(chunks, np.nan, dtype=data.dtype)
            full[tuple(slice(0, n) for n in part.shape)] = part
            yield at, full


def put(path, raw):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(raw)


def store(folder, data, form):
    folder = str(folder)
    chunks = CHUNKS[-data.ndim :]
    if form[0] == 2:
        _, codec, sep, order = form
        pack = {None: bytes, "zlib": zlib.compress, "zstd": ZSTD}[codec]
        info = {"zarr_format": 2, "shape": data.shape, "chunks": chunks, "dtype": "<f4", "compressor": codec and {"id": codec}, "fill_value": "NaN", "order": order, "filters": None, "dimension_separator": sep}
        put(f"{folder}/.zarray", json.dumps(info).encode())
        put(f"{folder}/.zattrs", json.dumps(ABOUT).encode())
        for at, b in blocks(data, chunks):
            put(f"{folder}/{sep.join(map(str, at))}", pack(b.tobytes(order)))
        return folder
    _, kind, where = form
    chain = [{"name": "bytes", "configuration": {"endian": "big"}}, {"name": "zstd", "configuration": {"level": 1}}, {"name": "crc32c"}]
    pack = lambda b: ZSTD(b.astype(">f4").tobytes()) + b"\0\0\0\0"  # noqa: E731  the sum is not looked at
    info = {"zarr_format": 3, "node_type": "array", "shape": data.shape, "data_type": "float32", "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": chunks}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "fill_value": "NaN", "codecs": chain, "attributes": ABOUT}
    inner = INNER[-data.ndim :]
    if kind == "sharded":
        info["codecs"] = [{"name": "sharding_indexed", "configuration": {"chunk_shape": inner, "codecs": chain, "index_codecs": [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "crc32c"}], "index_location": where}}]
    put(f"{folder}/zarr.json", json.dumps(info).encode())
    for at, b in blocks(data, chunks):
        raw = pack(b)
        if kind == "sharded":
            grid = tuple(c // i for c, i in zip(chunks, inner))
            index = np.full((*grid, 2), 2**64 - 1, dtype="<u8")
            n, raw = 16 * int(np.prod(grid)) + 4, b""
            for k, part in blocks(b, inner):
                piece = pack(part)
                index[k] = len(raw) + (n if where == "start" else 0), len(piece)
                raw += piece
            raw = index.tobytes() + b"\0" * 4 + raw if where == "start" else raw + index.tobytes() + b"\0" * 4
        put(f"{folder}/c/{'/'.join(map(str, at))}", raw)
    return folder


FORMS = [(2, None, ".", "C"), (2, "zlib", "/", "F"), (2, "zstd", ".", "C"), (3, "plain", ""), (3, "sharded", "end"), (3, "sharded", "start")]


@pytest.mark.parametrize("form", FORMS, ids=str)
def test_every_form_gives_the_same_pixels_and_points(spark, tmp_path, form):
    data = array()
    raster = ZarrRaster.open(spark, store(tmp_path / "a", data, form), META)
    got = {(r["axis_index"], r["row"], r["col"]): r["value"] for r in raster.cells().collect()}
    assert len(got) == data.size and all((v is None) if np.isnan(data[k]) else v == data[k] for k, v in got.items())
    rng = np.random.default_rng(2)
    at = [(i, int(r), int(c)) for i, (r, c) in enumerate(zip(rng.integers(0, 40, 60), rng.integers(0, 36, 60)))]
    points = spark.createDataFrame([(i, -10 + 0.5 * (c + 0.4), 50 - 0.5 * (r + 0.6), "x") for i, r, c in at] + [(99, None, 1.0, "x")], "id int, longitude double, latitude double, value string")
    found = {(r["id"], r["axis_value"]): r["value"] for r in raster.points(points).collect()}
    assert len(found) == 300
    for i, r, c in at:
        for k, period in enumerate(ABOUT["index_values"]):
            want = data[k, r, c]
            assert found[i, period] is None if np.isnan(want) else found[i, period] == want


def test_two_dimensions(spark, tmp_path):
    data = array()[0]
    for k, form in enumerate(FORMS):
        about = {**ABOUT, "index_values": [100]}
        folder = store(tmp_path / str(k), data, form)
        for name in (".zattrs", "zarr.json"):
            if os.path.exists(f"{folder}/{name}"):
                said = json.loads(open(f"{folder}/{name}").read())
                put(f"{folder}/{name}", json.dumps(about if name == ".zattrs" else said | {"attributes": about}).encode())
        raster = ZarrRaster.open(spark, folder, META)
        points = spark.createDataFrame([(-10 + 0.5 * 3.5, 50 - 0.5 * 7.5)], "longitude double, latitude double")
        assert [r["value"] for r in raster.points(points).collect()] == [data[7, 3]]


def test_only_chunks_with_points_are_opened(tmp_path):
    data = array()
    rows, cols = np.array([0, 39, 0, 20]), np.array([0, 35, 1, 15])
    for form in ((2, "zstd", ".", "C"), (3, "sharded", "end")):
        folder = store(tmp_path / str(form[0]), data, form)
        info = json.loads(open(f"{folder}/{'zarr.json' if form[0] == 3 else '.zarray'}").read())
        layout = Layout.of(folder, info)
        reader = PointReader(layout)
        got = reader.values(rows, cols)
        assert np.array_equal(got, data[:, rows, cols].T.astype(float), equal_nan=True)
        want = [layout.key(k, i, j) for i, j in ((0, 0), (2, 2)) for k in range(3)]  # the one at (20, 15) is not stored
        assert sorted(reader.opened) == sorted(want)
        every = sum(os.path.getsize(f"{folder}/{k}") for k in want)
        assert reader.bytes_read <= every and (form[0] == 2 or reader.bytes_read < every / 2)


def test_unknown_forms_are_refused(spark, tmp_path):
    folder = store(tmp_path / "a", array(), (3, "plain", ""))
    said = json.loads(open(f"{folder}/zarr.json").read())
    for change in ({"codecs": [{"name": "bytes"}, {"name": "lossy"}]}, {"chunk_grid": {"name": "odd", "configuration": {}}}, {"shape": [3]}):
        put(f"{folder}/zarr.json", json.dumps(said | change).encode())
        with pytest.raises(ValueError):
            ZarrRaster.open(spark, folder, META)
