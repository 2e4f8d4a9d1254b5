import re
from collections import Counter, defaultdict
from itertools import permutations
from math import exp, lgamma, log

import numpy as np
import pytest
from pyspark.sql import functions as F

from terragrist.llm import filter_audit, rules, source_audit

DOCS = "doc_id long, text string, lang string, source string"
LABELS = "doc_id long, quality int, toxic int"
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


# --- filter interaction audit


@pytest.mark.parametrize("k", [1, 2, 3, 4, 5])
def test_walk_visits_each_order_once_by_neighbour_swaps(k):
    cells = np.random.default_rng(k).integers(0, 9, (3, 1 << k, 3))
    orders = []
    for order, kept, removed in filter_audit.walk(cells, k):
        gone = 0
        for at, f in enumerate(order):
            out = np.array([m >> f & 1 and not m & gone for m in range(1 << k)], dtype=bool)
            assert (removed[:, at] == cells[:, out].sum(axis=1)).all()
            gone |= 1 << f
            assert (kept[:, at] == cells[:, [not m & gone for m in range(1 << k)], 0].sum(axis=1)).all()
        orders.append(order)
    assert set(orders) == set(permutations(range(k))) and len(set(orders)) == len(orders)
    for a, b in zip(orders, orders[1:]):
        at = [i for i in range(k) if a[i] != b[i]]
        assert len(at) == 2 and at[1] == at[0] + 1


def plain_audit(docs, labels):
    """Documents filtered one by one in every order."""
    least = {}
    for i, t, _, _ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    good = {i for i, q, _ in labels if q == 1} - {None}
    toxic = {i for i, _, x in labels if x == 1} - {None}
    fails = []
    for i, t, _, s in docs:
        t = t or ""
        w = SPACED.findall(t)
        e = i is not None and t in least and least[t] < i
        fails.append((s or "", i, {x for x, y in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search("[#$%&*|]", t)), e)) if y}))
    out = []
    for part in {f[0] for f in fails}:
        own = [f for f in fails if f[0] == part]
        total, rows = Counter(), []
        for order in permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone = [f for f in left if x in f[2]]
                left = [f for f in left if x not in f[2]]
                total[x] += len(gone)
                rows.append(["".join(order), step, len(left), len(gone), sum(x in f[2] for f in own) - len(gone), sum(f[2] == {x} for f in own), sum(f[1] in good for f in gone), sum(f[1] in toxic for f in gone)])
        out += [(part, *r, total[r[0][r[1] - 1]]) for r in rows]
    return sorted(out)


def test_filter_audit_equals_filtering_in_every_order(spark):
    rng = np.random.default_rng(5)
    long = " ".join(f"w{i}" for i in range(220))
    texts = ["", None, "a b", long, long + " # x", " ".join(["again"] * 300), "CAPITALS " + long, "BIG " * 50 + "|", "naïve ünder " + long, long.replace(" ", "\n")]
    docs = [(int(i) if rng.random() > 0.1 else None, texts[rng.integers(len(texts))], "en", [None, "", "a", "b"][rng.integers(4)]) for i in rng.integers(0, 40, 90)]
    labels = [(int(i), int(rng.integers(2)), int(rng.integers(2))) for i in rng.integers(0, 40, 60)] + [(None, 1, 1), (3, None, None)]
    d = spark.createDataFrame(docs, DOCS).withColumn("of", F.lit(1)).withColumn("first", F.lit(2)).withColumn("words", F.lit("x"))
    got = filter_audit.audit(filter_audit.document_masks(d, spark.createDataFrame(labels, LABELS)), "ABCDE")
    assert [f"{n} {t}".replace("bigint", "long") for n, t in got.dtypes] == filter_audit.AUDIT.split(", ")
    assert rows_of(got) == plain_audit(docs, labels)


def test_filter_audit_of_nothing_and_of_one_filter(spark):
    none = filter_audit.document_masks(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS))
    assert rows_of(filter_audit.audit(none, "ABCDE")) == []
    given = spark.createDataFrame([("p", 1, True, None), ("p", 0, True, True), (None, None, None, None)], "part string, mask int, good boolean, toxic boolean")
    assert rows_of(filter_audit.audit(given, "X")) == [("", "X", 1, 1, 0, 0, 0, 0, 0, 0), ("p", "X", 1, 1, 1, 0, 1, 1, 0, 1)]
    with pytest.raises(ValueError):
        filter_audit.audit(given, "AA")


def test_filter_audit_of_a_very_long_text(spark):
    docs = [(1, "word " * 2_000_000, "en", "a"), (2, "word " * 2_000_000, "en", "a")]
    got = filter_audit.document_masks(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], LABELS))
    assert sorted(r.mask for r in got.collect()) == [2, 18]


# --- source divergence audit


def plain_divergence(docs, least=10, top=10):
    find = re.compile(source_audit.TERM)
    lower = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    counts, holds, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, t, lang, s in docs:
        lang, s = lang or "", s or ""
        words = find.findall((t or "").translate(lower))
        groups.add((lang, s))
        counts[lang, s].update(words)
        holds[lang].update(set(words))
    out = []
    for lang, s in groups:
        kept = [t for t, n in holds[lang].items() if n >= least]
        v, of = len(kept), sorted(x for g, x in groups if g == lang)
        n = {x: sum(counts[lang, x][t] for t in kept) for x in of}
        p = lambda x, t: 1 + 1000000000 * (counts[lang, x][t] + 2) // (n[x] + 2 * v)
        q = lambda t: 1 + 1000000000 * (sum(counts[lang, x][t] for x in of) + 2) // (sum(n.values()) + 2 * v)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        pairs = [(x, sum(f(p(s, t), p(x, t)) for t in kept)) for x in of if x != s]
        terms = [(t, f(p(s, t), q(t))) for t in kept if counts[lang, s][t] and p(s, t) > q(t)]
        for part, found, most in (("pair", pairs, None), ("term", terms, top)):
            ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
            out += [(lang, s, part, x, value, rank) for rank, (x, value) in enumerate(ranked, 1)]
    return sorted(out)


def test_divergence_equals_a_plain_version(spark, monkeypatch):
    rng = np.random.default_rng(6)
    words = ["the", "The", "élan", "été", "x2y", "日本", "a-b", "I'm", *[f"w{chr(97 + i)}" for i in range(12)]]
    docs = []
    for i in range(200):
        s = [None, "", "a", "b", "ü", "only"][min(5, int(rng.integers(0, 11)) // 2)]
        t = None if i % 17 == 0 else " ".join(words[k] for k in rng.zipf(1.5, rng.integers(0, 40)) % len(words))
        docs.append((i % 150, t, ["en", "fr", None, "rare"][min(3, int(rng.integers(0, 7)) // 2)] if i else "rare", s))
    docs += [(1, "one", "none-kept", "a"), (2, "", "none-kept", "b"), (3, None, "alone", "a")] + docs[:5]
    d = spark.createDataFrame(docs, DOCS).withColumn("term", F.lit("x")).withColumn("shard", F.lit(1)).withColumn("n", F.lit(1))
    assert rows_of(source_audit.divergence(d)) == plain_divergence(docs)
    assert rows_of(source_audit.divergence(d, least_docs=1, top=2)) == plain_divergence(docs, 1, 2)
    monkeypatch.setattr(source_audit, "SHARD_PAIRS", 50)  # many small shards
    assert rows_of(source_audit.divergence(d)) == plain_divergence(docs)


def test_divergence_of_nothing_and_of_a_very_long_text(spark):
    assert rows_of(source_audit.divergence(spark.createDataFrame([], DOCS))) == []
    long = [(1, "aa bb cc " * 700_000, "en", "x"), (2, "aa", "en", "y")]
    assert rows_of(source_audit.divergence(spark.createDataFrame(long, DOCS), least_docs=1)) == plain_divergence(long, 1)


def test_counts_are_summed_up_anew_when_many(monkeypatch):
    monkeypatch.setattr(source_audit, "COMPACT_ROWS", 10)
    monkeypatch.setattr(source_audit, "DOCS_AT_ONCE", 3)
    import pyarrow as pa

    text = ["a b a", "b c", None, "", "c c c"] * 7
    batch = pa.RecordBatch.from_arrays([pa.array(["l"] * 35), pa.array(["s"] * 35), pa.array(text)], ["lang", "source", "text"])
    found = pa.Table.from_batches(source_audit._count_documents(iter([batch, batch]))).to_pylist()
    assert sorted((r["term"], int(r["n"]), int(r["docs"])) for r in found) == [("a", 28, 14), ("b", 28, 28), ("c", 56, 28)]


# --- quality rules


def plain_measures(t):
    t = t or ""
    w = SPACED.findall(t)
    lines = [x for x in t.split("\n") if SPACED.search(x)]
    times = Counter(zip(w, w[1:], w[2:]))
    again = {i + j for i in range(len(w) - 2) if times[tuple(w[i : i + 3])] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines), len(lines) - len(set(lines)), len(again)


def test_measures_equal_a_plain_version(spark):
    rng = np.random.default_rng(7)
    pieces = ["a", "b", "c d", "\n", " ", "\t", "#", "ü€", "<x>", "e f g", "\n\n", "\x0b"]
    texts = [None, "", " \n ", "a", "a a", "a a a a", "x y z x y z", "l\nl\n l\nl\n"] + ["".join(pieces[k] for k in rng.integers(0, len(pieces), rng.integers(1, 80))) for _ in range(150)]
    texts.append("p q r s " * 100_000)
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in rules.measured(d, "doc_id").collect():
        assert tuple(r)[1:] == plain_measures(texts[r.doc_id]), texts[r.doc_id]


def test_binomial_bound_is_exact(spark):
    cases = [(0, 1, 0.5), (0, 5000, 0.01), (3, 200, 0.01), (40, 5000, 0.01), (199, 20000, 0.01), (900, 100_000, 0.01)]
    for k, n, p in cases:
        want = log(sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * log(p) + (n - j) * log(1 - p)) for j in range(k + 1)) or 1e-300)
        got = spark.range(1).select(rules.log_binomial_cdf(F.lit(k).cast("long"), F.lit(n).cast("long"), p)).first()[0]
        assert got == pytest.approx(want, rel=1e-6, abs=1e-9) or want < -600
    tiny = spark.range(1).select(rules.log_binomial_cdf(F.lit(0).cast("long"), F.lit(10**9), 0.01)).first()[0]
    assert tiny == pytest.approx(10**9 * log(0.99))


def corpus(rng, n, bad_share=0.3, lang="en"):
    """Documents of 60 different words; bad ones with symbols, every 200th good one as well."""
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < bad_share
        text = " ".join(f"w{i}x{k}" + ("#" if (bad or i % 200 == 0) and k % 2 else "") for k in range(60))
        rows.append((i, text, lang, "s"))
        labels.append((i, int(not bad), 0))
    return rows, labels


def test_rules_keep_their_promise_and_catch_bad_ones(spark):
    rows, labels = corpus(np.random.default_rng(8), 3000)
    few, their = corpus(np.random.default_rng(9), 60, lang="few")
    rows += [(i + 10_000, t, g, s) for i, t, g, s in few] + [(None, rows[0][1], None, "s"), (20_000, None, "en", "s"), (20_001, "", None, None)]
    labels += [(i + 10_000, q, x) for i, q, x in their] + [(5, 1, 0), (5, 0, 0), (None, 0, 0), (20_001, 1, 0)]
    d = spark.createDataFrame(rows, DOCS)
    for c in ("stratum", "level", "rule", "is_good", "base_failed", "n_lines", "__text", "__words"):
        d = d.withColumn(c, F.lit("clash"))
    got = rules.judge(d, spark.createDataFrame(labels, LABELS))
    assert got.columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    got = got.collect()
    assert len(got) == len(rows)
    quality = {i: q for i, q, _ in labels if i != 5}
    good = [r for r in got if quality.get(r.doc_id) == 1 and r.doc_id < 3000]
    assert sum(not r.kept for r in good) <= 0.05 * len(good)
    assert not any(r.kept for r in got if r.doc_id is not None and r.doc_id < 3000 and quality.get(r.doc_id) == 0)
    assert all(r.kept for r in got if r.doc_id is not None and 10_000 <= r.doc_id < 20_000)  # too few labels to prove anything
    assert all(r.base_failed and not r.kept for r in got if r.doc_id in (20_000, 20_001))


def test_a_rule_that_cannot_prove_its_risk_is_not_used(spark):
    """The bound must hold for cutoffs beyond which 1 % of good documents or more lie, and for half of the rejections that it would need."""
    ladder = "stratum string, rule string, level int, good long, bad long, n long"
    given = [("a", "symbols", 3, 0, 500, 5000), ("a", "symbols", 4, 20, 900, 5000), ("a", "symbols", 5, 60, 5000, 5000), ("b", "symbols", 3, 0, 500, 400), ("c", "symbols", 3, 20, 150, 5000), ("c", "long_words", 2, 0, 0, 5000)]
    found = rules.thresholds(spark.createDataFrame(given, ladder), 3).collect()
    assert [(r.stratum, r.rule, r.level, r.cutoff) for r in found] == [("a", "symbols", 4, 200)]


def test_rules_of_nothing_and_without_labels(spark):
    empty = spark.createDataFrame([], DOCS)
    assert rules.judge(empty, spark.createDataFrame([], LABELS)).count() == 0
    rows, _ = corpus(np.random.default_rng(3), 20)
    got = rules.judge(spark.createDataFrame(rows + rows[:3], DOCS), spark.createDataFrame([], LABELS)).collect()
    assert len(got) == 23 and all(r.kept for r in got)


def test_rules_run_no_python(spark):
    rows, labels = corpus(np.random.default_rng(4), 50)
    plan = rules.measured(spark.createDataFrame(rows, DOCS), "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
