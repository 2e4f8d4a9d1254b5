"""The n-gram model against a plain one, and the classifier on odd rows."""

import collections
import math
import random

import pytest

from terragrist.llm import quality
from terragrist.llm.shared import Scratch


def _plain(trusted, order):
    """log p(word | context) of the interpolated modified Kneser-Ney model, word by word."""
    pad = [("<start>",)] * (order - 1)
    texts = [pad + [(w,) for w in t.split()] for t in trusted if t and t.split()]
    top = collections.Counter(sum(t[i - order + 1 : i + 1], ()) for t in texts for i in range(order - 1, len(t)))
    levels = {order: top}
    for k in range(order - 1, 0, -1):
        levels[k] = collections.Counter(g[1:] for g in levels[k + 1])
    total1 = sum(levels[1].values())
    off = {k: quality.discounts(*(sum(n == i for n in levels[k].values()) for i in (1, 2, 3, 4))) for k in levels}
    less = lambda k, n: off[k][min(n, 3) - 1]
    contexts = {k: collections.defaultdict(list) for k in levels}
    for k in levels:
        for g, n in levels[k].items():
            contexts[k][g[:-1]].append(n)
    unknown = sum(less(1, n) for n in levels[1].values()) / total1 / (len(levels[1]) + 1)

    def p(gram):
        k = len(gram)
        if k == 1:
            n = levels[1].get(gram, 0)
            return (n - less(1, n)) / total1 + unknown if n else unknown
        seen = contexts[k].get(gram[:-1])
        if not seen:
            return p(gram[1:])
        n = levels[k].get(gram, 0)
        return ((n - less(k, n)) / sum(seen) if n else 0) + sum(less(k, x) for x in seen) / sum(seen) * p(gram[1:])

    def perplexity(text):
        words = pad + [(w,) for w in (text or "").split()]
        logs = [math.log(p(sum(words[i - order + 1 : i + 1], ()))) for i in range(order - 1, len(words))]
        return math.exp(-sum(logs) / len(logs)) if logs else None

    return p, perplexity, sorted({g for g in levels[1]})


def _corpus(seed, n):
    rng = random.Random(seed)
    words = ["the", "of", "é", "a", "The", "ran", "sat", "x,y", "dog.", "cat"]
    return [" ".join(rng.choices(words, [9, 6, 1, 5, 2, 1, 1, 1, 1, 1], k=rng.randrange(1, 40))) for _ in range(n)]


@pytest.mark.parametrize("order, bits", [(2, 1), (3, 4), (4, 2)])
def test_equals_a_plain_model(spark, order, bits):
    trusted = [*_corpus(1, 30), None, "", "  "]
    texts = [*_corpus(2, 25), "new words only here", "the", None, "", " \n", "the dog. " * 300, trusted[0], trusted[0]]
    frame = lambda t: spark.createDataFrame([(i, x, "xx") for i, x in enumerate(t)], "doc_id long, text string, lang string")
    scratch = Scratch(spark, "kn")
    model = quality.train(frame(trusted), scratch, order=order, rounds=1 + order % 2, bits=bits)
    got = {r["doc_id"]: r["perplexity"] for r in quality.perplexity(frame(texts), model, scratch, "doc_id", "text", "lang", rounds=order).collect()}
    p, perplexity, known = _plain(trusted, order)
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = perplexity(t)
        assert (got[i] is None) == (want is None) and (want is None or abs(math.log(got[i] / want)) < 1e-9), (i, t, got[i], want)
    for context in (("the",), ("<start>",), ("nothing",)):  # known words and one unknown word share all probability
        assert abs(sum(p(((context * order)[: order - 1]) + w) for w in known) + p((context * order)[: order - 1] + ("?",)) - 1) < 1e-9


def test_separates_junk_and_answers_odd_rows(spark):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice(["ba", "ko", "ri", "te"]) for _ in range(rng.randrange(1, 4))) for _ in range(40)]
    good = [(i, " ".join(rng.choice(vocabulary) for _ in range(60)), "xx") for i in range(200)]
    junk = [(300 + i, " ".join(f"{rng.choice(vocabulary).upper()}!!%%" for _ in range(60)), "xx") for i in range(20)]
    rows = [*good, *junk, (400, None, None), (401, "", "xx"), (402, vocabulary[0], None), (402, vocabulary[0], None), (None, good[0][1], "yy"), (403, good[3][1] + " ", None)]
    df = spark.createDataFrame([(*r, 1.0, "x") for r in rows], "doc_id long, text string, lang string, perplexity double, gained string")
    ids = spark.createDataFrame([(i,) for i in [*range(160), None, 3]], "doc_id long")
    found = quality.classify(df, ids, rounds=2).collect()
    got = {r["doc_id"]: r for r in found}
    assert len(found) == len(rows) and sum(r["doc_id"] == 402 for r in found) == 2
    assert sum(got[i]["kept"] for i in range(200)) >= 180 and not any(got[300 + i]["kept"] for i in range(20))
    assert not got[400]["kept"] and not got[401]["kept"] and got[400]["perplexity"] is None
    assert got[402]["lang"] == "und" and got[402]["threshold"] is not None and got[None]["kept"]
    assert quality.classify(df, ids.limit(0), rounds=2).filter("kept").count() == len(rows) - 2
    assert quality.classify(df.limit(0), ids, rounds=2).collect() == []
