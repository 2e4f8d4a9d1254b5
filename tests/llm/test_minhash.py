"""Near-duplicate detection against brute force."""

import random
import re

import pytest

from terragrist.llm import minhash
from terragrist.llm.components import connected_components
from terragrist.llm.shared import Scratch


def _sets(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    w = min(width, len(words))
    return frozenset(tuple(words[i : i + w]) for i in range(len(words) - w + 1))


def _brute(rows, width, percent=80):
    sets = {i: _sets(t, width) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                inter = len(sets[a] & sets[b])
                if 100 * inter >= percent * (len(sets[a]) + len(sets[b]) - inter):
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def _texts(n, seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["the", "of", "é", "Ü"]
    out = []
    for i in range(n):
        if out and rng.random() < 0.6:
            words = rng.choice(out)[1].split()
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(vocab)
            out.append((i, " ".join(words)))
        else:
            out.append((i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 2, 5, 8, 30, 60])))))
    return out


@pytest.mark.parametrize("width", [2, 5])
def test_equals_brute_force(spark, width):
    rows = _texts(150) + [(1000, None), (1001, ""), (1002, "  \t\n"), (1003, "one"), (1004, "ONE"), (1005, "A b"), (1006, "a  B")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=width).collect()}
    assert got == _brute(rows, width)


def test_large_group_of_near_copies_stays_whole(spark):
    base = [f"v{i}" for i in range(80)]
    rows = [(i, " ".join([*base[: i % 70], f"x{i}", *base[i % 70 + 1 :]])) for i in range(700)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()
    assert {r["component_id"] for r in got} == {0} and sum(r["kept"] for r in got) == 1


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(None, "a b c d e f", 1, 2), (1, "a b c d e f", 3, 4), (1, "a b c d e f", 3, 4), (2, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long, component_id long")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, None, True), (1, 1, True), (1, 1, True), (2, 2, True)], key=str)


def test_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "u long, v long")
    got = {r["node"]: r["component"] for r in connected_components(edges, Scratch(spark, "t"), "c").collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_one_id_with_several_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, a), (5, a), (5, b), (6, b), (5, b)]
    got = sorted(tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([(1, 26, 1, True), (5, 26, 1, False), (5, 26, 5, True), (5, 26, 5, True), (6, 26, 5, False)])


def test_one_row_of_each_group_stays(spark):
    rows = [(*r, i) for i, r in enumerate(_texts(120, seed=11))]
    rows += [(i % 7, f"{rows[i][1]}", 1000 + i) for i in range(40)]  # ids with several texts
    rows += [(None, rows[i][1], 2000 + i) for i in range(60)] + rows[:20] + [(None, "only without an id " * 3, 5), (None, "only without an id " * 3, 6), (3, None, 7), (3, None, 7), (4, " ", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __kept int")
    got = minhash.drop_copies(df).collect()
    texts = sorted({t for _, t, _ in rows if t and t.split()})
    group = _brute(list(enumerate(texts)), 5)
    of = {t: group[i][1] for i, t in enumerate(texts)}
    kept = [(r[0], r[1]) for r in got if r[1] and r[1].split()]
    assert sorted(of[t] for _, t in kept) == sorted(set(of.values()))
    for i, t in kept:
        ids = [x for x, u, _ in rows if u and u.split() and of[u] == of[t]]
        assert i == min((x for x in ids if x is not None), default=None)
    assert sorted(r[2] for r in got if not (r[1] and r[1].split())) == [7, 7, 8]
    assert minhash.drop_copies(df.limit(0)).collect() == []


def test_a_very_long_text(spark):
    words = [f"w{i % 50_021}" for i in range(1_000_000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:-9], *["new"] * 9])), (3, "x" * 3_000_000)]
    got = {r[0]: r[2] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_sets_are_sent_to_few_families(spark, monkeypatch):
    rng = random.Random(5)
    rows = []
    for g in range(6):  # texts around the threshold, with words of other groups
        for _ in range(70):
            words = [f"g{g}w{i}" for i in range(100)]
            for _ in range(rng.choice([1, 2, 4, 6, 8, 10, 14, 20])):
                words[rng.randrange(100)] = f"g{rng.randrange(6)}w{rng.randrange(100)}"
            rows.append((len(rows), " ".join(words)))
    sent, links, compare = [], [], minhash._block_links

    def counted(left, right, *more):
        sent.append(left.count() + right.count())
        links.append((found := compare(left, right, *more)).count())
        return found

    monkeypatch.setattr(minhash, "_block_links", counted)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()}
    assert got == _brute(rows, 2)
    assert sum(sent) <= 4 * len(rows) and sum(links) <= sum(sent)


def test_sketches_count_equal_coordinates(spark):
    rng = random.Random(8)
    a = [[rng.randrange(-(2**31), 2**31) for _ in range(100)] for _ in range(40)]
    b = [[x if rng.random() < 0.7 else x + rng.choice([1, 2, 4, 8, 16]) for x in row] for row in a]
    sig = spark.createDataFrame([(i, [max(-(2**31), min(2**31 - 1, y)) for y in x]) for i, x in enumerate(a + b)], "node long, sig array<int>")
    sketch = sig.mapInArrow(minhash._sketches, "node long, sketch array<long>")
    pairs = sketch.filter("node < 40").join(sketch.selectExpr("node - 40 AS node", "sketch AS other"), "node")
    got = {r[0]: r[1] for r in pairs.select("node", minhash._different("sketch", "other", 100)).collect()}
    assert got == {i: sum((x ^ y) & 15 != 0 for x, y in zip(a[i], b[i])) for i in range(40)}
