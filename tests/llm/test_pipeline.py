"""The pipeline's stages on a small corpus with planted cases, odd rows and clashing columns."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from terragrist.llm import queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n_tokens int, component_id string"


@pytest.fixture(scope="module")
def corpus(tmp_path_factory, spark):
    rng = random.Random(9)
    syllables = {"xx": ["ba", "ko", "ri", "lo"], "yy": ["zu", "éf", "mli", "sto"]}
    word = lambda lang: "".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(2, 6)))
    text = lambda lang, n: " ".join(word(lang) for _ in range(n))
    rows = [(i, text(lang, rng.randrange(40, 120)), lang) for i in range(60) for lang in [rng.choice(["xx", "yy"])]]
    item = text("xx", 25)
    words = rows[5][1].split()
    words[20] = "changed"
    rows += [(100, rows[3][1], rows[3][2]), (101, " ".join(words), rows[5][2]), (102, f"{text('xx', 30)} {item} {text('xx', 30)}", "xx"), (103, f"{text('xx', 40)} mail me@site.org {text('xx', 10)}", "xx")]
    rows += [(200, None, None), (201, "", "xx"), (202, "12 34 !!", None), (203, text("yy", 50), None), (203, None, "yy"), (None, text("xx", 50), "xx")]
    df = spark.createDataFrame([(i, t, lang, "s", len(t) if t else None, 0.5, 7, "x") for i, t, lang in rows], SCHEMA)
    folder = tmp_path_factory.mktemp("sf")
    df.write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    return str(folder)


def test_stages_keep_clean_rows_and_act_on_planted_ones(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, corpus)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{corpus}/{name}")
        docs = spark.read.parquet(f"{corpus}/{name}")
        seen[name] = {r[0] for r in docs.select("doc_id").collect()}
    clean = set(range(60)) | {103, 203, None}
    assert seen["language_id"] == clean | {100, 101, 102}
    assert seen["near_dedup"] == clean | {102}
    assert seen["decontamination"] == clean == seen["packing"]
    masked = spark.read.parquet(f"{corpus}/personal_data").filter("doc_id = 103").first()
    assert "<email>" in masked["text"] and "site.org" not in masked["text"] and masked["n_chars"] == len(masked["text"])


def test_run_gives_the_last_stage(spark, corpus):
    assert corpus_pipeline.run(spark, corpus).select("doc_id").distinct().count() == 63


def test_empty_corpus(spark, corpus, tmp_path):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, corpus)
        assert out.count() == 0
        docs = out if set(docs.columns) <= set(out.columns) else docs


def test_columns_with_the_names_of_marks_stay_as_they_are(spark, corpus):
    marks = ["__text", "__id", "__no_id", "__lang", "__score", "lang_pred", "of", "id", "no_id", "doc", "row", "first", "gone", "a.b", "n", "sig", "group"]
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    for k, name in enumerate(marks):
        docs = docs.withColumn(name, F.concat_ws("-", F.lit(k), F.col("doc_id").cast("string")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, corpus)
        assert out.columns == docs.columns, name
        got = out.select(*[F.col(f"`{c}`") for c in ("doc_id", *marks)]).collect()
        assert len(got) > 50
        for r in got:
            tail = "" if r[0] is None else f"-{r[0]}"
            assert list(r)[1:] == [f"{k}{tail}" for k in range(len(marks))], name


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
