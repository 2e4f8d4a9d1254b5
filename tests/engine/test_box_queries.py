"""Box queries over more suppliers and parts than one tile holds, against all pairs."""

from terragrist.plans import queries


def _tables(spark, folder):
    suppliers = [(k, k * 7 % 3) for k in (1, 2, 11, 55, 100, 101, 102, 111, 155, 199, 250, 1405)]
    spark.createDataFrame(suppliers, "s_suppkey long, s_nationkey long").write.parquet(f"{folder}/supplier.parquet")
    spark.range(1, 4001, 7).withColumnRenamed("id", "p_partkey").write.parquet(f"{folder}/part.parquet")
    box = lambda x, y, w, h: (x, y, x + w, y + h)
    polys = {k: (n, box(k % 10, k // 10 % 10 + 12 * ((k - 1) // 100), 1 + n % 5 * 0.25, 1.5)) for k, n in suppliers}
    cells = {q: box(q % 40 * 0.3, q // 40 % 40 * 0.3 + 12 * ((q - 1) // 1600), 0.3, 0.3) for q in range(1, 4001, 7)}
    return polys, cells


def _area(a, b):
    return max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))


def test_all_boxes_take_part(spark, tmp_path):
    polys, cells = _tables(spark, tmp_path)
    want = {(str(q), k): a for q, c in cells.items() for k, (_, p) in polys.items() if (a := _area(p, c)) > 1e-9}
    got = {(r["hex_id"], r["poly_rid"]): r["area"] for r in queries.QUERIES["clip_area"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in got)
    assert any(k > 100 for _, k in got) and any(int(q) > 1600 for q, _ in got)
    want = {(a, b) for a, (m, p) in polys.items() for b, (n, q) in polys.items() if a < b and m == n and _area(p, q) > 1e-9}
    assert {(r["a"], r["b"]) for r in queries.QUERIES["overlay_area"](spark, str(tmp_path)).collect()} == want
    assert {r["poly_rid"] for r in queries.QUERIES["polyfill"](spark, str(tmp_path)).collect()} == set(polys)
