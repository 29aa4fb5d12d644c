"""Every registered query on the smallest tables, against DuckDB where there is SQL for it."""

import duckdb
import pytest

from taxoloom.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _cell(v):
    return f"{v:.6f}".replace("-0.000000", "0.000000") if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(_cell(r[c]) for c in columns) for r in df.collect())
    if name not in ORACLES:
        return
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(_cell(r[names.index(c)]) for c in columns) for r in cur.fetchall())


def test_glued_chunks_of_long_runs_against_sql(spark, tmp_path):
    """The whole query where a chunk is far longer than the stack, beside articles, cue words, empty and missing texts."""
    n = 20000
    texts = ["cat " * n, "of " * n + "the cat", "the 2 big cats such as a dog and other useful hats. The\nThe cat, an", "<b>cats</b> including 3.5 dogs", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in QUERIES["glued_chunks"](spark, str(tmp_path)).select("tag", "n", "words").collect()}
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == set(c.execute(ORACLES["glued_chunks"]).fetchall())
    assert (f"{n - 1}np", 1, 1) in got and ("IN", n + 1, 2) in got


def test_sentences_are_glued_without_a_shuffle_and_tagged_once(spark):
    """Gluing stays within a row, and no filter that Spark infers makes the tags again."""
    for name in ("np_concat", "np_positions", "tagger_words"):
        df = QUERIES[name](spark, SF)
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("_'-]+|[^") == 1 and plan.count("(ous|ful|") + plan.count("[^suix]s$") == 1, name
        assert name == "tagger_words" or "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_glued_sentences_equal_glued_rows(spark):
    """With spans at the start, at the end, side by side, of one word, and none."""
    from pyspark.sql import functions as F

    from taxoloom.operators import corpus, linguistics

    texts = ["Big cats such as the red dogs and 3 hats", "the cat", "of on in", "Cat, dog; the", "The of cats dogs. Hats", ""]
    sents = linguistics.tag(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    a = linguistics.tagged_rows(linguistics.glue_chunks(sents))
    b = corpus.glue_spans(linguistics.tagged_rows(sents), linguistics.chunk_spans(sents)).select(*a.columns)
    got = sorted(map(tuple, a.collect()))
    assert got == sorted(map(tuple, b.collect())) and len(got) > 15
    assert a.where(F.col("tag").endswith("np")).count() >= 6


def test_counts_of_a_document_need_no_shuffle_of_their_own(spark):
    """Texts are dealt by document; no shuffle holds the pairs of document and word."""
    for name in ("tfidf", "top_terms_per_doc"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not [p for p in plan.split("Exchange hashpartitioning(")[1:] if p.startswith("doc_id") and "term_id" in p.split(", [plan_id")[0]], name
        assert "REPARTITION_BY_COL" in plan
