"""The rules on Arrow arrays against the rules as columns."""

import duckdb
from pyspark.sql import functions as F

from taxoloom.operators import linguistics, ruled
from taxoloom.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TEXTS = ["The big red cats of such houses, including 3.5 dogs and 7 _ -' --.", "ÉTÉ ΟΔΟΙ Zürich buses boxes flies skies xs s", "cat of the dog. In on at\nbig quickly hats", "<b>Cat</b>! ed ing 12 1.5 x9 9x other especially", "of", "", "!?", None, "dog", "cat", "wide"]


def documents(spark):
    """The odd texts in one partition, so that a batch holds sentences of several documents side by side."""
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1)


def stored(spark, path):
    documents(spark).write.parquet(f"{path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    return c


def same(a, b):
    a, b = (sorted(map(str, df.collect())) for df in (a, b.select(*a.columns)))
    assert a == b and a


def alike(spark, path, name):
    c = stored(spark, path)
    cur = c.execute(ORACLES[name])
    got = QUERIES[name](spark, str(path)).select(*[d[0] for d in cur.description])
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(map(str, cur.fetchall()))


def test_spans_of_texts_equal_spans_of_tagged_sentences(spark):
    """rules are not evaluated word by word in column expressions; spans end with their sentences."""
    for docs in (documents(spark), spark.read.parquet(f"{SF}/documents.parquet")):
        same(ruled.term_spans(docs), linguistics.term_spans(linguistics.tag(docs)))
    plan = QUERIES["pos_term_spans"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "[^suix]s$" not in plan and "MapInArrow" in plan


def test_articles_are_stripped_without_tags(spark, tmp_path):
    """the query reads words only."""
    alike(spark, tmp_path, "strip_article")
    assert "ical" not in QUERIES["strip_article"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_candidates_of_texts_equal_candidates_of_tagged_sentences(spark, tmp_path):
    """rules are not evaluated word by word in column expressions."""
    for docs in (documents(spark), spark.read.parquet(f"{SF}/documents.parquet")):
        same(ruled.term_candidates(docs), linguistics.term_candidates(linguistics.tag(docs)))
    alike(spark, tmp_path, "pos_term_candidates")
    assert "[^suix]s$" not in QUERIES["pos_term_candidates"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_a_tagger_s_words_are_counted_before_they_are_tagged(spark, tmp_path):
    """rules see each distinct word once."""
    alike(spark, tmp_path, "tagger_words")
    plan = QUERIES["tagger_words"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("[^suix]s$") < plan.index("Aggregate") < plan.index("Generate")


def test_nouns_are_counted_once_for_weights(spark, tmp_path):
    """texts are tagged once, not once for counts and once for document frequencies."""
    alike(spark, tmp_path, "noun_filter_tfidf")
    plan = QUERIES["noun_filter_tfidf"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "_'-]+|[^" not in plan and "ical" not in plan


def test_ids_are_glued_with_one_join_for_the_ids(spark, tmp_path):
    """neither spans nor new places are joined or ranked in a shuffle of words."""
    alike(spark, tmp_path, "glued_ids")
    plan = QUERIES["glued_ids"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan and "row_number" not in plan and plan.count("MapInArrow") == 1


def test_json_of_documents_equals_json_of_words(spark, tmp_path):
    """documents are written where they are, compressed, as the long table is."""
    from taxoloom.sources import readers, writers

    writers.corpus_json_documents(ruled.fields(documents(spark)), f"{tmp_path}/a", "gzip")
    writers.corpus_json(linguistics.tagged_rows(linguistics.tag(documents(spark))), f"{tmp_path}/b")
    same(*(readers.corpus_json(spark, f"{tmp_path}/{x}") for x in "ab"))
    assert "Exchange" not in ruled.fields(documents(spark))._jdf.queryExecution().executedPlan().toString()
    alike(spark, tmp_path, "stored_corpus_json")


def test_a_word_is_scored_and_named_once_a_batch(spark):
    """F8: decoding asks for a word's scores and lemma once, not at every place; a sentence alone gives the same."""
    from taxoloom.operators import tagging

    same(ruled.tag(documents(spark)), linguistics.tag(documents(spark)))
    tagger = tagging.learn(ruled.tag(documents(spark)))
    asked, scores, lemma = [], tagger.scores, tagger.lemma
    tagger.scores = lambda w: asked.append(w) or scores(w)
    tagger.lemma = lambda w, t: asked.append((w, t)) or lemma(w, t)
    sents = [["the", "big", "cats"], [], ["cats"], ["the", "cats", "of", "the", "cats"] * 7]
    got = tagger.many(sents)
    assert len([x for x in asked if x == "cats"]) == 1 and len(set(asked)) == len(asked)
    assert got == [tagger.many([s])[0] for s in sents] and [len(s) for s in got] == [3, 0, 1, 35]


def test_word_vectors_are_learned_in_more_than_one_task(spark, monkeypatch):
    """training is not one task however large the input; every frequent word gets its vector."""
    from taxoloom.operators import learning

    tasks, made = [], learning.Word2Vec
    monkeypatch.setattr(learning, "Word2Vec", lambda **kw: tasks.append(kw.get("numPartitions", 1)) or made(**kw))
    rows = spark.range(400).select(F.array(*(F.concat(F.lit(x), (F.col("id") % 7).cast("string")) for x in "abc")).alias("words"))
    found = learning.word_vectors(rows, size=4, least=5).collect()
    assert tasks == [spark.sparkContext.defaultParallelism] and tasks[0] > 1
    assert {r["term"] for r in found} == {f"{x}{k}" for x in "abc" for k in range(7)} and all(len(r["emb"]) == 4 for r in found)
