"""Partitioned lookups with a hot parent, and ingests that are broken off."""

import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from terragrist.functions.fitting import FitPolicy
from terragrist.operators import ingest, lookup
from terragrist.operators.ingest import IngestPolicy
from terragrist.plans import surrogates


def files(folder):
    return [os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")]


def test_a_hot_parent_is_many_files_of_bounded_size(spark, tmp_path):
    rows = spark.range(3000).select(F.format_string("%05d", "id").alias("hex_id"), F.when(F.col("id") < 2800, "hot").otherwise(F.concat(F.lit("p"), (F.col("id") % 7).cast("string"))).alias("h3_r0"), F.col("id").alias("n"))
    path = str(tmp_path / "out")
    lookup.write_partitioned(rows, path, 8, rows_per_file=400)
    sizes = {f: pq.ParquetFile(f).metadata.num_rows for f in files(path)}
    assert max(sizes.values()) <= 400 and sum(sizes.values()) == 3000
    hot = [f for f in sizes if "h3_r0=hot" in f]
    assert 7 <= len(hot) <= 16 and len(sizes) - len(hot) <= 14
    spans = sorted((x[0], x[-1]) for x in (pq.read_table(f, columns=["hex_id"]).column(0).to_pylist() for f in hot) if x == sorted(x))
    assert len(spans) == len(hot) and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))  # sorted, and one range a file
    broken = rows.withColumn("n", F.when(F.col("id" if "id" in rows.columns else "n") == 7, F.raise_error(F.lit("no")).cast("long")).otherwise(F.col("n")))
    with pytest.raises(Exception):
        lookup.write_partitioned(broken, path, 8, mode="overwrite")
    assert spark.read.parquet(path).count() == 3000 and os.listdir(tmp_path) == ["out"]
    lookup.write_partitioned(rows.limit(0), str(tmp_path / "none"), 8)


def test_a_broken_ingest_goes_on_where_it_was(spark, tmp_path, monkeypatch):
    raster = surrogates.stored_raster(spark, "/root/testdata/sf0.001")
    policy = IngestPolicy(4, "flood", "tests", "1", fit=FitPolicy("gumbel_r", min_knots=2, max_normalized_rmse=10.0, on_failure="skip"))
    path = str(tmp_path / "tiles")
    box = (-12.0, 47.0, -8.0, 53.0)  # six tiles, of which four miss the raster
    published, real = [], ingest.publish

    def stops(df, to, **how):
        if len(published) == 1:
            raise RuntimeError("broken off")
        published.append(to.rsplit("=")[-1])
        return real(df, to, **how)

    monkeypatch.setattr(ingest, "publish", stops)
    with pytest.raises(RuntimeError):
        ingest.ingest_tiles(raster, policy, box, 2.0, path)
    first, published[:] = list(published), []
    monkeypatch.setattr(ingest, "publish", lambda df, to, **how: (published.append(to.rsplit("=")[-1]), real(df, to, **how))[1])
    done = {r["tile"]: r["rows"] for r in ingest.ingest_tiles(raster, policy, box, 2.0, path).collect()}
    assert not set(first) & set(published) and set(done) == set(range(6))
    assert {int(t) for t in first + published} == {1, 3} == {t for t in done if done[t]}
    published.clear()
    ingest.ingest_tiles(raster, policy, box, 2.0, path)
    assert published == []
    whole = ingest.canonicalize(raster, policy, (-10.0, 47.0, -8.0, 50.0))
    whole = ingest.with_tiles(whole, box, 2.0).filter("tile is not null")
    key = ["tile", "cell_index", "source_id", "curve_location"]
    found = spark.read.parquet(path)
    got = sorted((int(r[0]), *r[1:]) for r in found.select(*key).collect())
    assert got == sorted(tuple(r) for r in whole.select(*key).collect()) and len(got) == sum(done.values()) > 0
