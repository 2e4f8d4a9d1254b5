"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

A seed is a mask over a few consecutive words that looks at some of them and passes over the rest, so that a substituted
word hides from some seeds only. Seed hashes of all training positions meet those of the benchmark in an equi-join. Each
hit gives an alignment (document, item, shift), on which the words around the hit are compared one by one: the overlap
counts if some stretch of `window` aligned words (the whole item, if shorter) has at least `percent` equal ones.

Seeds are chosen for the length of the stretch and the substitutions that it may have, such that every overlap that counts has a hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terragrist.llm.shared import Scratch

#: Masks by words of a stretch and substitutions in it: wherever these are, one of the masks fits between them (found by enumeration).
COMPLETE = {
    (5, 1): ((0, 1, 2), (0, 1, 3)),
    (6, 1): ((0, 1, 2, 3), (0, 1, 3, 4)),
    (7, 1): ((0, 1, 3, 4),),
    (8, 1): ((0, 1, 2, 4, 5), (0, 1, 3, 4, 5)),
    (9, 1): ((0, 1, 2, 3, 5, 6), (0, 1, 3, 4, 5, 6)),
    (10, 2): ((0, 1, 2, 4, 5), (0, 1, 3, 5, 6), (0, 1, 2, 5, 6)),
    (11, 2): ((0, 1, 3, 5, 6), (0, 1, 2, 5, 6)),
    (12, 2): ((0, 1, 2, 4, 6, 7), (0, 1, 2, 3, 5, 6), (0, 1, 4, 5, 6, 7)),
}
#: Letters, digits and non-ASCII characters make words; everything else separates.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Benchmark seeds, and hits, that may be broadcast (16 MB or so); more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def word_hashes(text: Column) -> Column:
    """Hashes of the lower-cased words of a text; null texts have none."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATOR), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def masks(stretch: int, percent: int) -> tuple[tuple[int, ...], ...]:
    """Word positions that the seeds look at, for stretches of so many words. Beyond the table, the run that no choice of substitutions can avoid."""
    equal = max(1, -(-stretch * percent // 100))
    other = stretch - equal
    return COMPLETE.get((stretch, other), (tuple(range(-(-equal // (other + 1)))),))


def _seeds(rows: DataFrame, words: str, at: str, looks: dict[tuple[int, ...], list[int]], stretch: Column | None = None) -> DataFrame:
    """A row for each position and mask: `at`, and the hash `seed`. `looks`: stretches that each mask is for; given `stretch`, a row has only those of its own."""
    n, span = F.size(words), min(m[-1] for m in looks) + 1
    rows = rows.withColumn(at, F.explode(F.when(n >= span, F.sequence(F.lit(0), F.size(words) - span))))
    own = lambda of: F.lit(True) if stretch is None else stretch.isin(of)
    hashes = [F.when((F.col(at) + m[-1] < F.size(words)) & own(of), F.xxhash64(F.lit(k), *[F.get(words, F.col(at) + p) for p in m])) for k, (m, of) in enumerate(looks.items())]
    return rows.withColumn("seed", F.explode(F.array(*hashes))).filter("seed is not null")


def _aligned(hits: DataFrame) -> DataFrame:
    """Only the words that face each other; hits: (doc_id, item_id, shift, words, item_words), shift = place in document - place in item."""
    first = F.greatest(F.lit(0), -F.col("shift"))
    length = F.least(F.size("item_words"), F.size("words") - F.col("shift")) - first
    cut = hits.select("doc_id", "item_id", F.size("item_words").alias("n_item"), (first + F.col("shift")).alias("first_word"), F.slice("words", first + F.col("shift") + 1, length).alias("a"), F.slice("item_words", first + 1, length).alias("b"))
    return cut.repartition("doc_id", "item_id")


def _verified(aligned: DataFrame, window: int, percent: int) -> DataFrame:
    """The best alignment of each document and item, if some stretch of it has enough equal words."""
    h = aligned.withColumn("same", F.zip_with("a", "b", lambda x, y: F.when(x == y, 1).otherwise(0)))
    w = F.least(F.lit(window), F.col("n_item"))
    starts = F.when(F.size("same") >= w, F.sequence(F.lit(0), F.size("same") - w)).otherwise(F.array().cast("array<int>"))
    equal = F.transform(starts, lambda s: F.aggregate(F.slice("same", s + 1, w), F.lit(0), lambda t, x: t + x))
    h = h.withColumn("best", F.array_max(equal)).filter(F.col("best") * 100 >= w * percent)
    h = h.select("doc_id", "item_id", F.aggregate("same", F.lit(0), lambda t, x: t + x).cast("long").alias("n_equal"), F.col("n_item").cast("long"), F.col("first_word").cast("long"))
    best = h.groupBy("doc_id", "item_id", "n_item").agg(F.max(F.struct("n_equal", (-F.col("first_word")).alias("at"))).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.n_equal"), "n_item", (-F.col("b.at")).alias("first_word"))


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", *, window: int = 12, percent: int = 80) -> DataFrame:
    """(doc_id, item_id, n_equal, n_item, first_word): each document and item with a tolerant overlap, once.

    `n_equal`: equal words on the best alignment, of the item's `n_item`; `first_word`: where in the document that
    alignment begins (words from 0); ties to the earlier place. Items of few words count as well, down to one. Null and empty texts, rows with
    null ids, and empty tables give nothing. Repeated rows of one id are one document. Other columns are not looked at.

    Exploded positions carry no word lists: hits are found as (document, item, shift) first, and the few documents with hits are
    read again for the words around them.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), word_hashes(F.col("text")).alias("item_words")).filter("item_id is not null")
    stretch = F.least(F.size("item_words"), F.lit(window))
    looks: dict[tuple[int, ...], list[int]] = {}
    for n in sorted(x[0] for x in items.select(stretch).distinct().collect() if x[0] > 0) or [window]:  # at most `window` rows
        for m in masks(n, percent):
            looks.setdefault(m, []).append(n)
    seeds = scratch.table(_seeds(items, "item_words", "item_at", looks, stretch).select("item_id", "item_at", "seed"), "seeds")
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null")
    near = seeds
    if seeds.count() <= BROADCAST_ROWS:
        near, items = F.broadcast(seeds), F.broadcast(items)
    found = _seeds(d.select("doc_id", word_hashes(F.col("text")).alias("words")), "words", "at", looks).select("doc_id", "at", "seed")
    hits = found.join(near, "seed").select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    hits = scratch.table(hits, "hits")
    ids = hits.select("doc_id").distinct()
    if hits.count() <= BROADCAST_ROWS:
        ids, hits = F.broadcast(ids), F.broadcast(hits)
    words = d.join(ids, "doc_id", "left_semi").select("doc_id", word_hashes(F.col("text")).alias("words"))
    return _verified(_aligned(words.join(hits, "doc_id").join(items, "item_id")), window, percent)


def contaminated_ids(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """Ids of documents that overlap any item, once each."""
    return overlaps(docs, benchmark, **how).select("doc_id").distinct()
