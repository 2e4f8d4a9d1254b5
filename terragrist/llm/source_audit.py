"""Source divergence audit: how the term frequencies of each source differ from those of the other sources of its language, and from the language.

Three steps. Tasks tokenise their documents with vectorised SQL in an embedded database and count terms by (lang, source, term)
before anything is shuffled; rows are dealt by (lang, term), so that a shard knows all sources of its terms and which terms are kept. Kept counts
are written; Spark sums up what each group and language has. Then the kept counts are dealt into shards by a hash of (lang, term) again, each
with a copy of the sums, and a shard's SQL gives partial sums of each pair of sources and its best terms of each group. Spark adds up and
ranks.

All arithmetic is on integers. A database lives in the memory of its task, with one thread and no folder of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terragrist.llm.shared import Scratch

#: What a term is made of: ASCII letters and all characters beyond ASCII. Fixed value.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows that a task gathers before it sums them up again.
COMPACT_ROWS = 1_000_000
#: Documents whose words a task unnests at once, and bytes of text.
DOCS_AT_ONCE, BYTES_AT_ONCE = 2048, 16 << 20
#: Terms times pairs of sources that one shard is given to compute, about: the number of shards follows the work, as each gives a row a pair.
SHARD_PAIRS = 4_000_000
COUNTS = "lang string, source string, term string, n decimal(38,0), docs decimal(38,0)"
_TEXT, _BIG = pa.string(), pa.decimal128(38, 0)
_COUNTS = pa.schema([("lang", _TEXT), ("source", _TEXT), ("term", _TEXT), ("n", _BIG), ("docs", _BIG)])
PARTIAL = "part string, lang string, source string, item string, value decimal(38,0)"
_PARTIAL = pa.schema([("part", _TEXT), ("lang", _TEXT), ("source", _TEXT), ("item", _TEXT), ("value", _BIG)])


def _database():
    """An empty database in this task's memory."""
    try:
        import duckdb
    except ImportError as e:
        raise ImportError("the source audit needs the package duckdb on all executors") from e

    return duckdb.connect(":memory:", config={"threads": 1, "temp_directory": "", "preserve_insertion_order": False})


def _batches(db, sql: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    yield from db.sql(sql).to_arrow_table().cast(schema).to_batches(max_chunksize=65536)


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with a bounded number of bytes in a column; a row of more is a run of its own."""
    at, size, rows = 0, 0, 0
    for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        if rows and (size + (n or 0) > BYTES_AT_ONCE or rows >= DOCS_AT_ONCE):
            yield batch.slice(at, rows)
            at, size, rows = i, 0, 0
        size, rows = size + (n or 0), rows + 1
    if rows:
        yield batch.slice(at, rows)


class _Sums:
    """Counts by (lang, source, term) in a task's database, summed up anew whenever many rows have come together."""

    def __init__(self) -> None:
        self.db = _database()
        self.run("CREATE TABLE sums (lang VARCHAR, source VARCHAR, term VARCHAR, n HUGEINT, docs HUGEINT)")
        self.rows = self.least = 0

    def run(self, sql: str) -> list[tuple]:
        return self.db.execute(sql).fetchall()  # a statement is over when its rows are fetched

    def add(self, select: str) -> None:
        self.rows += self.run(f"INSERT INTO sums {select}")[0][0]
        if self.rows > max(COMPACT_ROWS, 2 * self.least):
            self.compact()

    def compact(self) -> None:
        self.run("CREATE TABLE fresh AS SELECT lang, source, term, CAST(sum(n) AS HUGEINT) AS n, CAST(sum(docs) AS HUGEINT) AS docs FROM sums GROUP BY ALL")
        self.run("DROP TABLE sums")
        self.run("ALTER TABLE fresh RENAME TO sums")
        self.rows = self.least = self.run("SELECT count(*) FROM sums")[0][0]


def _count_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (lang, source, text) to this task's counts of terms, and of documents that hold them."""
    sums = _Sums()
    for batch in batches:
        for some in _slices(batch, 2):
            sums.db.register("given", pa.table([*some.columns, pa.array(range(some.num_rows))], ["lang", "source", "text", "doc"]))
            found = f"SELECT lang, source, doc, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{TERM}')) AS term FROM given"
            sums.add(f"SELECT lang, source, term, sum(n), count(*) FROM (SELECT lang, source, term, doc, count(*) AS n FROM ({found}) GROUP BY ALL) GROUP BY ALL")
            sums.db.unregister("given")
    sums.compact()
    yield from _batches(sums.db, "SELECT * FROM sums", _COUNTS)


def _keep_terms(least: int):
    """Counts of whole (lang, term) to the sums of those in at least so many documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()
        for batch in batches:
            sums.db.register("given", pa.Table.from_batches([batch]))
            sums.add("SELECT * FROM given")  # decimals of no fraction
            sums.db.unregister("given")
        sums.compact()
        yield from _batches(sums.db, f"SELECT * FROM sums QUALIFY sum(docs) OVER (PARTITION BY lang, term) >= {least}", _COUNTS)

    return run


def _divide(table: pa.Table, top: int) -> Iterator[pa.RecordBatch]:
    """One shard: kept counts (term given) and the sums of groups and languages (term null; source null for a language; n: N, docs: V)."""
    db = _database()
    db.register("given", table)
    db.execute("CREATE TABLE k AS SELECT lang, source, term, CAST(n AS HUGEINT) AS n FROM given WHERE term IS NOT NULL").fetchall()
    db.execute("CREATE TABLE g AS SELECT lang, source, CAST(n AS HUGEINT) + 2 * CAST(docs AS HUGEINT) AS base FROM given WHERE term IS NULL").fetchall()
    p = "CAST(1 + CAST(1000000000 AS HUGEINT) * (coalesce({0}, 0) + 2) // {1} AS BIGINT)"
    dense = f"""CREATE TABLE dense AS SELECT t.lang, t.term, g.source, k.n IS NOT NULL AS own, {p.format("k.n", "g.base")} AS p, {p.format("t.n", "l.base")} AS q
        FROM (SELECT lang, term, sum(n) AS n FROM k GROUP BY ALL) t JOIN g l ON l.lang = t.lang AND l.source IS NULL
        JOIN g ON g.lang = t.lang AND g.source IS NOT NULL LEFT JOIN k ON k.lang = t.lang AND k.term = t.term AND k.source = g.source"""
    db.execute(dense).fetchall()
    yield from _batches(
        db,
        """SELECT 'pair' AS part, lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
        FROM dense a JOIN dense b USING (lang, term) WHERE a.source < b.source GROUP BY ALL""",
        _PARTIAL,
    )
    yield from _batches(
        db,
        f"""SELECT 'term' AS part, lang, source, term AS item, CAST((p - q) * (p - q) // (p + q) AS HUGEINT) AS value FROM dense WHERE own AND p > q
        QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, term) <= {top}""",
        _PARTIAL,
    )
    db.close()


def divergence(docs: DataFrame, *, least_docs: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank) of each occurring group (lang, source).

    A term is kept in a language if at least `least_docs` of its documents (rows) hold it; V are kept, N is the sum of a group's kept counts and
    p = 1 + floor(10^9 (count + 2) / (N + 2 V)). Part 'pair' has every other source of the language with the sum of
    floor((p - q)^2 / (p + q)) over kept terms (0 where none is kept); part 'term' the `top` terms that the group has and has more often than its language,
    with that term's value. Ranks go by value, largest first, then by the item's bytes. Null text, lang and source are ''; an empty
    table gives no rows; repeated rows count each; other columns are not looked at.

    The pairs are what is asked for, so the result has as many rows as sources have pairs; a pair of sources costs a shard one row
    whatever their sizes. Frequent terms are summed up in each task before they are dealt.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "source-audit")
    columns = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select(*columns).mapInArrow(_count_documents, COUNTS).repartition(parts, "lang", "term")
    kept = scratch.table(dealt.mapInArrow(_keep_terms(least_docs), COUNTS).drop("docs"), "kept")

    groups = docs.select(*columns[:2]).distinct()
    terms = kept.groupBy("lang", "term").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.count(F.lit(1)).cast("decimal(38,0)").alias("docs"), F.sum("n").cast("decimal(38,0)").alias("n"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").cast("decimal(38,0)").alias("n"))
    none = F.lit(0).cast("decimal(38,0)")
    vocabulary = groups.select("lang").distinct().join(terms, "lang", "left").select("lang", F.coalesce("n", none).alias("n"), F.coalesce("docs", none).alias("docs"))
    by_group = groups.join(own, ["lang", "source"], "left").join(vocabulary.drop("n"), "lang").select("lang", "source", F.coalesce("n", none).alias("n"), "docs")
    sums = scratch.table(by_group.unionByName(vocabulary.select("lang", F.lit(None).cast("string").alias("source"), "n", "docs")), "sums")

    work = sums.groupBy("lang").agg(F.count(F.lit(1)).alias("s"), F.max("docs").cast("double").alias("v")).agg(F.sum(F.col("v") * F.col("s") * F.col("s"))).first()[0] or 0.0
    shards = int(work // SHARD_PAIRS) + 1
    shard = F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).cast("int").alias("shard")
    copies = sums.withColumn("term", F.lit(None).cast("string")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    rows = kept.select("lang", "source", "term", "n", none.alias("docs"), shard).unionByName(copies.select("lang", "source", "term", "n", "docs", "shard"))

    def run(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(_divide(table.select(["lang", "source", "term", "n", "docs"]), top), _PARTIAL)

    partial = scratch.table(rows.groupBy("shard").applyInArrow(run, PARTIAL), "partial")
    found = partial.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    a, b = groups.select("lang", "source"), groups.select("lang", F.col("source").alias("item"))
    pairs = a.join(b, "lang").filter("source < item").join(found, ["lang", "source", "item"], "left").select("lang", "source", "item", F.coalesce("value", none).alias("value"))
    pairs = pairs.withColumn("way", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))))
    pairs = pairs.select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value")
    best = partial.filter("part = 'term'").select("lang", "source", "part", "item", "value")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = pairs.unionByName(best).withColumn("rank", F.row_number().over(order))
    return ranked.filter(f"part = 'pair' or rank <= {int(top)}").select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), "rank")
