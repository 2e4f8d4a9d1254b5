"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

A rule is a ratio of a text and a ladder of cutoffs, from mild to strict, that are fixed beforehand. Labelled documents are the holdout: a
cutoff is certified in a stratum if the exact binomial test refutes that it rejects more than `risk` of the good documents
there. Cutoffs of a ladder are nested, so they are tested in order without a correction among them; strata and rules share
the error probability `delta` evenly (Bonferroni), and the rules of a stratum share the risk, so that all of them together
reject at most `risk` of its good documents, in all strata at once, with probability 1 - delta. Of the certified cutoffs each rule takes the one that
rejects most bad documents, where a good one counts `cost` times.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terragrist.llm.shared import Scratch

_SPACE = r"[\x20\x09-\x0D]+"
_NO_SPACE = r"[^\x20\x09-\x0D]"
#: Rule: numerator, denominator, whether large values are rejected, and cutoffs in thousandths from mild to strict. Fixed values.
RULES = {
    "symbols": ("n_symbols", "n_words", True, (1000, 500, 300, 200, 150, 100, 70, 50, 30, 20, 10)),
    "duplicate_lines": ("n_dup_lines", "n_lines", True, (900, 700, 500, 400, 300, 250, 200, 150, 100, 50)),
    "repeated_words": ("n_repeat_words", "n_words", True, (450, 400, 350, 300, 250, 200, 150, 100, 50)),
    "long_words": ("word_chars", "n_words", True, (20000, 15000, 12000, 10000, 9000, 8500, 8000, 7500, 7000, 6500, 6000)),
    "short_words": ("word_chars", "n_words", False, (2000, 2500, 3000, 3250, 3500, 3750, 4000, 4250)),
}
#: Strata whose thresholds may be broadcast; more are joined by a shuffle.
BROADCAST_STRATA = 100_000


def measured(docs: DataFrame, *keep: str | Column, text_col: str = "text") -> DataFrame:
    """Columns of `docs` in `keep`, and n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long) of the whole text; null texts have none.

    n_lines are lines with a word. Windows of three words are compared by 64-bit hashes. A text takes time in proportion to n log n of its words.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = docs.select(*keep, text.alias("__text"), F.array_remove(F.split(text, _SPACE), "").alias("__words"))
    d = d.withColumn("__lines", F.filter(F.split("__text", "\n", -1), lambda x: x.rlike(_NO_SPACE)))
    w, n = F.col("__words"), F.size("__words")
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<bigint>"))
    d = d.withColumn("__windows", windows)
    some = F.size(F.array_distinct("__windows")) < F.size("__windows")
    d = d.withColumn("__sorted", F.when(some, F.array_sort(F.transform("__windows", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    s = F.col("__sorted")
    twice = F.filter(s, lambda e, i: F.coalesce(e["x"] == F.get(s, i + 1)["x"], F.lit(False)) | F.coalesce(e["x"] == F.get(s, i - 1)["x"], F.lit(False)))
    d = d.withColumn("__at", F.array_sort(F.transform(twice, lambda e: e["i"])))
    start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    covered = F.aggregate("__at", start, lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])
    found = {
        "n_words": n,
        "word_chars": F.length(F.regexp_replace("__text", _SPACE, "")),
        "n_symbols": F.length(F.regexp_replace("__text", r"[^#*$%&|<>]+", "")),
        "n_lines": F.size("__lines"),
        "n_dup_lines": F.size("__lines") - F.size(F.array_distinct("__lines")),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
    }
    names = [c for c in d.columns if not c.startswith("__")]
    return d.select(*names, *[c.cast("long").alias(name) for name, c in found.items()])


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def level(rule: str) -> Column:
    """How many cutoffs of a rule's ladder a document is beyond; 0 if it has nothing to measure."""
    top, bottom, large, cutoffs = RULES[rule]
    beyond = [1000 * F.col(top) > c * F.col(bottom) if large else 1000 * F.col(top) < c * F.col(bottom) for c in cutoffs]
    out = F.lit(0)
    for b in beyond:
        out = out + F.when(b, 1).otherwise(0)
    return out


def log_binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """ln P(X <= k) of X ~ Binomial(n, p), summed term by term as logarithms, so that it underflows for no n."""

    def step(a: Column, j: Column) -> Column:
        term = a["term"] + F.log((n - j + 1) / j) + F.lit(log(p) - log(1 - p))
        high, low = F.greatest(term, a["sum"]), F.least(term, a["sum"])
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("sum"))

    none = n * F.lit(log(1 - p))
    js = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(js, F.struct(none.alias("term"), none.alias("sum")), step, lambda a: a["sum"])


def ladder_counts(rows: DataFrame) -> DataFrame:
    """(stratum, rule, level, good, bad, n): labelled documents at or beyond each occurring level, and n, the good ones of the stratum.

    `rows`: measured documents with `stratum` and the boolean `is_good`. Counted before the shuffle: a stratum is a few rows a task.
    """
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), level(r).alias("level")) for r in RULES])).alias("e")
    counts = rows.select("stratum", "is_good", each).groupBy("stratum", F.col("e.rule").alias("rule"), F.col("e.level").alias("level"))
    counts = counts.agg(F.count(F.when(F.col("is_good"), 1)).alias("good"), F.count(F.when(~F.col("is_good"), 1)).alias("bad"))
    ladder = Window.partitionBy("stratum", "rule")
    beyond = ladder.orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.select("stratum", "rule", "level", F.sum("good").over(beyond).alias("good"), F.sum("bad").over(beyond).alias("bad"), F.sum("good").over(ladder).alias("n"))


def thresholds(counts: DataFrame, strata: int, *, risk: float = 0.05, delta: float = 0.05, cost: int = 10) -> DataFrame:
    """(stratum, rule, level, cutoff, good, bad, n, log_p): the certified cutoff that each rule takes in each stratum; rules without one are left out.

    `counts`: from ladder_counts, over so many `strata`. `log_p`: logarithm of the exact binomial p-value of 'rejects more than risk / rules of the good documents'.
    Ties go to the milder cutoff.
    """
    each = risk / len(RULES)
    limit = log(delta / max(1, strata * len(RULES)))
    few = (F.col("level") > 0) & (F.col("good") <= each * F.col("n"))  # beyond the expected count the test cannot succeed
    rows = counts.filter(few).withColumn("log_p", log_binomial_cdf(F.col("good"), F.col("n"), each)).filter(F.col("log_p") <= limit)
    rows = rows.withColumn("worth", F.col("bad") - cost * F.col("good")).filter("worth > 0")
    best = Window.partitionBy("stratum", "rule").orderBy(F.desc("worth"), "level")
    cutoff = F.lit(None).cast("int")
    for r, (_, _, _, cutoffs) in RULES.items():
        cutoff = F.when(F.col("rule") == r, F.get(F.array(*[F.lit(c) for c in cutoffs]), F.col("level") - 1)).otherwise(cutoff)
    rows = rows.withColumn("best", F.row_number().over(best)).filter("best = 1")
    return rows.select("stratum", "rule", "level", cutoff.alias("cutoff"), "good", "bad", "n", "log_p")


def judge(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", risk: float = 0.05, delta: float = 0.05, cost: int = 10) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of each row of `docs`.

    kept: neither base_failed nor beyond a certified cutoff of the row's stratum (null strata are one, ''). The holdout is every document with labels of one mind (quality 1: good, 0: bad)
    that base rules do not fail; of repeated ids it has one row. Null ids have no label. A stratum with too few good labels certifies
    nothing and loses nothing beyond base rules. An empty table gives an empty result. Texts are read once; what follows works on one narrow
    row a document.
    """
    scratch = Scratch(docs.sparkSession, "rules")
    rows = measured(docs, F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"), text_col=text_col)
    rows = scratch.table(rows.withColumn("base_failed", base_failed()), "measured")
    said = labels.filter("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    said = said.agg(F.min("quality").alias("low"), F.max("quality").alias("high")).filter("low = high").select("doc_id", (F.col("low") == 1).alias("is_good"))
    columns = [c for c in rows.columns if c != "doc_id"]
    one = rows.filter("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct(*columns)).alias("r")).select("doc_id", "r.*")
    counts = scratch.table(ladder_counts(one.filter("not base_failed").join(said, "doc_id")), "counts")
    strata = counts.select("stratum").distinct().count()
    chosen = thresholds(counts, strata, risk=risk, delta=delta, cost=cost)
    limits = chosen.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("level"))).alias(f"at_{r}") for r in RULES])
    limits = scratch.table(limits, "limits")
    if strata <= BROADCAST_STRATA:
        limits = F.broadcast(limits)
    beyond = F.lit(False)
    for r in RULES:
        beyond = beyond | F.coalesce(level(r) >= F.col(f"at_{r}"), F.lit(False))
    out = rows.join(limits, "stratum", "left")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~beyond).alias("kept"))
