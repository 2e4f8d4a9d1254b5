"""Tolerant overlaps against brute force without seeds."""

import itertools
import random

import corpus_pipeline
from terragrist.llm import decontaminate


def test_every_admissible_pattern_has_a_hit():
    for percent in (50, 80, 90, 100):
        for n in range(1, 15):
            other = n - max(1, -(-n * percent // 100))
            places = [{at + p for p in m} for m in decontaminate.masks(n, percent) for at in range(n - m[-1])]
            assert all(any(p.isdisjoint(c) for p in places) for c in itertools.combinations(range(n), other)), (n, percent)


def _brute(doc, item, window=12, percent=80):
    w = min(window, len(item))
    found = []
    for shift in range(-len(item) + 1, len(doc)):
        same = [int(doc[i + shift] == x) for i, x in enumerate(item) if 0 <= i + shift < len(doc)]
        if w and any(sum(same[i : i + w]) * 100 >= w * percent for i in range(len(same) - w + 1)):
            found.append((-sum(same), max(0, shift)))
    return min(found) if found else None


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    items = {n: [word() for _ in range(n)] for n in range(20)}
    docs = {}
    for n, item in items.items():
        for _ in range(12):
            changed = list(item)
            for i in rng.sample(range(n), min(n, rng.randrange(5))):
                changed[i] = word()
            docs[len(docs)] = [word() for _ in range(rng.randrange(6))] + changed + [word() for _ in range(rng.randrange(6))]
    frame = lambda t, name: spark.createDataFrame([(k, " ".join(v)) for k, v in t.items()], f"{name} long, text string")
    got = {(r[0], r[1]): (-r[2], r[4]) for r in decontaminate.overlaps(frame(docs, "doc_id"), frame(items, "item_id")).collect()}
    best = {(d, i): _brute(doc, item) for d, doc in docs.items() for i, item in items.items()}
    assert got == {k: v for k, v in best.items() if v}
    assert {i for _, i in got} == set(range(1, 20))


def test_contaminated_texts_go_with_any_id(spark, tmp_path):
    item = " ".join(f"word{i}" for i in range(14))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, f"so {item}"), (None, "clean"), (5, f"as {item}"), (5, "clean too"), (None, None)]
    out = corpus_pipeline.drop_contaminated(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path))
    assert {tuple(r) for r in out.collect()} == {rows[1], rows[3], rows[4]}
