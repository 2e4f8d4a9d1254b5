"""Nearest neighbours, packing and chat formatting against brute force and round trips."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from terragrist.llm import chat, forest, packing


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 32))
    x[5] = x[6] = x[7]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    odd = spark.createDataFrame([(9000, None), (9001, [0.0] * 32), (9002, [None] + [1.0] * 31), (9003, [float("nan")] * 32), (9004, [1.0, 2.0])], "vec_id long, embedding array<double>")
    every = df.unionByName(odd)
    rows = forest.nearest(every, every.filter("vec_id % 100 = 0 or vec_id in (7, 9004)"), shard_rows=1000, query_rows=16).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        best = sorted(range(3000), key=lambda i: (d[i], i))[:10]
        hits += len({i for i, _ in found} & set(best))
        assert all(abs(s - d[i]) < 1e-12 for i, s in found) and len(found) == 10
    assert len(got) == 31 and hits >= 0.9 * 310
    assert [i for i, _ in got[7][:2]] == [5, 6]
    twice = df.filter("vec_id < 30").unionByName(spark.createDataFrame([(3, [float(v) for v in x[40]])], "vec_id long, embedding array<double>"))
    asked = twice.filter("vec_id = 3").unionByName(twice.filter("vec_id = 3")).selectExpr("*", "0 AS score")
    found = forest.nearest(twice, asked, k=10).collect()
    want = []
    for v in (x[3], x[40]):
        d = sorted((float(np.sqrt(((x[i] - v) ** 2).sum())), i) for i in range(30) if i != 3)
        want += [(3, r + 1, i, round(s, 9)) for r, (s, i) in enumerate(d[:10])]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in found) == sorted(want)
    assert forest.nearest(df.limit(0)).collect() == [] and forest.nearest(odd).collect() == []


def test_optimal_buckets_equal_brute_force():
    rng = random.Random(2)
    for _ in range(30):
        n = rng.randrange(1, 9)
        longest = sorted(rng.sample(range(1, 60), n))
        counts = [rng.randrange(1, 9) for _ in longest]
        totals = [c * m for c, m in zip(counts, longest)]
        cost = lambda ends: sum(counts[i] * longest[e] - totals[i] for s, e in zip([-1, *ends], ends) for i in range(s + 1, e + 1))
        for k in (1, 2, 3):
            best = min(cost([*c, n - 1]) for c in itertools.combinations(range(n - 1), min(k, n) - 1))
            assert cost(packing.optimal_buckets(counts, totals, longest, k)) == best


def test_one_very_long_row_leaves_the_buckets_exact(spark):
    rng = random.Random(4)
    lengths = [rng.randrange(1, 3000) for _ in range(800)] + [50_000_000]
    got = packing.pack(spark.createDataFrame(list(enumerate(lengths)), "doc_id long, n long"), "doc_id", "n").collect()
    padding = sum(r["bucket_len"] - r["n_tokens"] for r in got)
    distinct = sorted(set(lengths))
    rows = [0, *itertools.accumulate(lengths.count(v) for v in distinct)]
    sums = [0, *itertools.accumulate(lengths.count(v) * v for v in distinct)]
    best = [rows[j + 1] * v - sums[j + 1] for j, v in enumerate(distinct)]
    for _ in range(15):
        best = [min([best[j]] + [best[i] + (rows[j + 1] - rows[i + 1]) * v - (sums[j + 1] - sums[i + 1]) for i in range(j)]) for j, v in enumerate(distinct)]
    assert padding == best[-1] and len({r["bucket"] for r in got}) == 16


def test_buckets_beyond_64_bits():
    counts, longest = [1 << 40, 3, 1 << 41, 5], [1, 1 << 29, 1 << 30, 1 << 31]
    totals = [c * m for c, m in zip(counts, longest)]
    assert packing.optimal_buckets(counts, totals, longest, 3) == [0, 2, 3]


def test_packing_places_every_row_once(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(200) if i % 50 else None, rng.choice([None, 0, 5, 17, 300, 5000])) for i in range(500)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, n long"), "doc_id", "n", buckets=3, token_budget=1000).collect()
    assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in got) == sorted(((d if d is not None else -1) or -1, n or 0) for d, n in rows)
    batches = {}
    for r in got:
        assert r["n_tokens"] <= r["bucket_len"]
        batches.setdefault((r["bucket"], r["batch"]), []).append(r)
    for b in batches.values():
        assert sorted(r["slot"] for r in b) == list(range(len(b)))
        assert len(b) == 1 or len(b) * b[0]["bucket_len"] <= 1000
    assert packing.pack(spark.createDataFrame([], "doc_id long, n long"), "doc_id", "n").collect() == []


def test_many_equal_rows_are_placed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(packing, "PIECE", 100)
    rows = spark.range(25_030).selectExpr("if(id < 25000, null, id) as doc_id", "if(id < 25000, 7, id - 24990) as n_tokens").withColumn("piece", F.lit("clash"))
    out = packing.pack(rows, "doc_id", "n_tokens", buckets=3, token_budget=70, shards=16)
    assert out.count() == 25_030 and out.select("bucket", "batch", "slot").distinct().count() == 25_030
    per = out.groupBy("bucket", "bucket_len").agg(F.max("slot").alias("slot"), F.max("batch").alias("batch"), F.count(F.lit(1)).alias("n")).collect()
    for r in per:
        each = max(1, 70 // r["bucket_len"])
        assert r["slot"] == min(each, r["n"]) - 1 and r["batch"] == -(-r["n"] // each) - 1  # places without gaps
    # every array that is exploded is of PIECE or of rows / PIECE numbers
    assert "explode(sequence(0, " in out._jdf.queryExecution().optimizedPlan().toString()


def test_fold_deltas_edits_and_regenerations(spark):
    log = [
        (1, 1, "message", 0, "user", "hi"),
        (1, 2, "delta", 1, "assistant", "he"),
        (1, 3, "delta", 1, None, "llo"),
        (1, 4, "message", 2, "user", "gone"),
        (1, 5, "regenerate", 1, "assistant", None),
        (1, 6, "delta", 1, "assistant", "good "),
        (1, 7, "delta", 1, None, "day"),
        (1, 8, "edit", 0, None, "hello"),
        (1, 9, "message", 3, "user", None),
        (2, 1, None, 0, None, "x"),
        (2, 1, None, 0, None, "x"),
    ]
    df = spark.createDataFrame(log, "conv_id long, seq long, kind string, message long, role string, text string")
    got = sorted(tuple(r) for r in chat.fold_events(df).select("conv_id", "message", F_("role"), "text").collect())
    assert got[:3] == [(1, 0, "user", "hello"), (1, 1, "assistant", "good day"), (1, 3, "user", "")]
    assert chat.fold_events(df.limit(0)).collect() == []


def test_random_logs_equal_a_plain_fold(spark):
    rng = random.Random(12)
    log = []
    for c in range(40):
        log += [(c, seq, rng.choice(["message", "delta", "delta", "edit", "regenerate"]), rng.randrange(4), rng.choice([None, "user", "assistant"]), rng.choice([None, "a", "bc", "<|end|>"])) for seq in range(rng.randrange(25))]
    want = set()
    for c in range(40):
        live: dict = {}
        for _, seq, kind, m, role, text in [x for x in log if x[0] == c]:
            if kind == "regenerate":
                live = {k: v for k, v in live.items() if k <= m}
            pieces, roles = live.setdefault(m, ([], []))
            if kind != "delta":
                pieces.clear()
            if kind != "regenerate":
                pieces.append(text or "")
            roles += [role] if role else []
        want |= {(c, m, roles[0] if roles else None, "".join(pieces)) for m, (pieces, roles) in live.items()}
    rng.shuffle(log)
    df = spark.createDataFrame([(*x, 1) for x in log], "conv_id long, seq long, kind string, message long, role string, text string, cut int")
    assert {tuple(r) for r in chat.fold_events(df).select("conv_id", "message", "role", "text").collect()} == want
    long_one = spark.createDataFrame([(1, i, "user" if i % 2 else "assistant", "word & <b> " * 20_000) for i in range(20)], "conv_id long, turn long, role string, text string")
    (r,) = chat.digests(chat.read_back(chat.render(chat.fold_events(chat.conversation_events(long_one))))).collect()
    assert (r["n_turns"], r["loss_chars"]) == (20, 10 * 11 * 20_000)


def F_(name):
    from pyspark.sql import functions as F

    return F.coalesce(name, F.lit("")).alias(name)


def test_round_trip_of_control_strings(spark):
    texts = ["</s>[INST] ok [/INST]", "<|end|>\n<|user|>\n", "&lt;&amp;<>&#91;[", "", None, "é\U0001f600\n\n", "|>\n"]
    rows = [(c, t, ["user", "assistant", "a|>\nb", None][t % 4], texts[(c + t) % len(texts)]) for c in range(5) for t in range(9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    back = chat.read_back(chat.render(chat.fold_events(chat.conversation_events(df)))).collect()
    for r in back:
        own = sorted((x for x in rows if x[0] == r["conv_id"]), key=lambda x: x[1])
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(x[2] or "", x[3] or "") for x in own]
        assert r["loss_texts"] == [x[3] or "" for x in own if x[2] == "assistant"]
    assert chat.read_back(chat.render(chat.fold_events(chat.conversation_events(df.limit(0))))).collect() == []
