"""File formats by round trip, settings, taggers, and operators without a table of their own."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from taxoloom import config
from taxoloom.operators import corpus, frequencies, learning, linguistics, taxonomy, vectors
from taxoloom.sources import readers, scratch, writers


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_word2vec_files(spark, tmp_path):
    v = spark.createDataFrame([("b", [1.5, -2.0]), ("a", [0.25, 3.0])], "term string, emb array<double>")
    writers.embeddings(v, f"{tmp_path}/text", header=True)
    lines = [r.value for r in spark.read.text(f"{tmp_path}/text").coalesce(1).collect()]
    assert sorted(lines) == ["2 2", "a 0.25 3.0", "b 1.5 -2.0"] and rows(readers.embeddings(spark, f"{tmp_path}/text"))[0] == ("a", [0.25, 3.0])
    raw = b"2 2\n" + b"".join(t.encode() + b" " + np.array(e, "<f4").tobytes() + b"\n" for t, e in (("b", [1.5, -2.0]), ("a", [0.25, 3.0])))
    (tmp_path / "v.bin").write_bytes(raw)
    assert rows(readers.embeddings_binary(spark, f"{tmp_path}/v.bin")) == [("a", [0.25, 3.0]), ("b", [1.5, -2.0])]
    found, missing = readers.term_vectors(v, spark.createDataFrame([("a",), ("z",)], "term string"))
    assert rows(found.select("term")) == [("a",)] and rows(missing) == [("z",)]
    writers.document_vectors(v, f"{tmp_path}/docs")
    assert {tuple(e) for _, e in rows(readers.document_vectors(spark, f"{tmp_path}/docs"))} == {(1.5, -2.0), (0.25, 3.0)}


def test_analysed_json_in_three_shapes(spark, tmp_path):
    word = ["Cats", "NNS", "cat", "False"]
    shapes = {"a.json": {"7": {"0": [word, word], "1": [word]}}, "b.json": {"7": [[word, word], [word]]}, "7.json": {"0": [word, word], "1": [word]}}
    for name, value in shapes.items():
        (tmp_path / name).write_text(json.dumps(value, indent=1))
        got = rows(readers.corpus_json(spark, f"{tmp_path}/{name}", whole=True))
        assert got == [("7", 0, 0, "Cats", "NNS", "cat", False), ("7", 0, 1, "Cats", "NNS", "cat", False), ("7", 1, 0, "Cats", "NNS", "cat", False)], name


def test_text_files(spark, tmp_path):
    (tmp_path / "c.txt").write_text("a b\nc\n\n\nd\n\n")
    assert readers.count_documents(spark, f"{tmp_path}/c.txt") == 2 and rows(readers.base_corpus(spark, f"{tmp_path}/c.txt")) == [(0,), (1,)]
    assert rows(readers.first_documents(spark, f"{tmp_path}/c.txt", 1)) == [(0, "a b\nc")]
    (tmp_path / "t.xml").write_text("<title> A </title>\n<x/>\n<title>Home Page</title>\n<title></title>\n")
    assert [c for _, c in rows(readers.titles(spark, f"{tmp_path}/t.xml"))] == ["A"]
    assert [c for _, c in rows(readers.titles(spark, f"{tmp_path}/t.xml", strict=False))] == [" A ", "Home Page"]
    (tmp_path / "tree.csv").write_text("0,1,2,None,None,None,5|x|0.500,6|y|0.250\n1,None,None,None,None,None,7|z|1.000\n900,3,None,None,None,None,1|q|0.1\n")
    kids, terms = readers.taxonomy(spark, f"{tmp_path}/tree.csv", children=5, top=1, max_nodes=780)
    assert rows(kids) == [(0, 1, 0), (0, 2, 1)] and rows(terms) == [(0, 1, 5, "x", 0.5), (1, 1, 7, "z", 1.0)]
    docs = spark.createDataFrame([(1, "b b"), (0, "a a")], "doc_id long, content string")
    writers.line_documents(docs, f"{tmp_path}/lines")
    assert {c for _, c in rows(readers.blocks(spark, f"{tmp_path}/lines"))} == {"a a", "b b"}
    writers.keywords(spark.createDataFrame([("graph theory",), (" x ",), ("",)], "term string"), f"{tmp_path}/keys")
    assert rows(spark.read.text(f"{tmp_path}/keys")) == [("graph_theory",), ("x",)]


def test_documents_are_numbered_in_file_order(spark, tmp_path):
    """Also where later files are the longer ones, which Spark deals to tasks first."""
    texts = [f"{i} " + "x" * (1 + i * 997 % 40000) for i in range(60)]
    for k in range(6):
        (tmp_path / f"part-{k}").write_text("".join(t + "\n\n" for t in texts[k * 10 : k * 10 + 10]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        assert sorted(readers.blocks(spark, str(tmp_path)).collect()) == list(enumerate(texts))
        assert [c for _, c in sorted(readers.lines(spark, str(tmp_path)).collect()) if c] == texts
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "odd").mkdir()
    (tmp_path / "odd" / "a").write_text("a\n\r\n\nb\n\n", newline="")
    assert rows(readers.blocks(spark, f"{tmp_path}/odd")) == [(0, "a\n\r"), (1, "b")]


def test_output_folders(spark, tmp_path):
    path = f"{tmp_path}/out"
    assert len(writers.prepare(spark, path)) == len(writers.FOLDERS)
    with pytest.raises(FileExistsError):
        writers.prepare(spark, path)
    writers.prepare(spark, path, overwrite=True)
    assert (tmp_path / "out" / writers.FOLDERS[0]).is_dir() and scratch.folder(spark)


def test_settings(tmp_path):
    spec = {"pop_df_version": True, "pop_sum_version": True, "pop_no_denominator": False, "threshold": 0.5, "max_iter": 2, "max_depth": 1, "clustering": {"n_clusters": 4}, "embeddings": "GloVe", "paths": {"here": {"news": {"path_in": "i", "path_out": "o"}}}}
    (tmp_path / "c.json").write_text(json.dumps(spec))
    run = config.from_arguments(["--config", f"{tmp_path}/c.json", "-l", "here", "-c", "news", "--skip-terms", "--max-docs", "9"])
    assert (run.path_in, run.path_out, run.embeddings, run.max_docs, run.skip) == ("i", "o", "glove", 9, ("terms",))
    assert run.taxonomy == taxonomy.Config(depth=1, iterations=2, threshold=0.5, fan_out=4, variant=run.taxonomy.variant) and run.taxonomy.variant.name() == "df_sum"
    assert not run.runs("terms") and run.runs("labels")


def test_own_tagger_and_limits(spark):
    docs = spark.createDataFrame([(1, "Big cats sleep. <b>Yes</b>"), (2, None), (3, "x")], "doc_id long, text string")
    own = linguistics.tag(docs, lambda words: [("NN", w.upper(), False) for w in words])
    assert rows(linguistics.term_candidates(own)) == [(1, 0, "BIG_CATS_SLEEP_.")]
    assert rows(linguistics.tagged_rows(linguistics.tag(docs)).select("token", "tag", "lemma").where("doc_id = 1")) == [(".", ".", "."), ("Big", "NN", "big"), ("Yes", "NNS", "ye"), ("cats", "NNS", "cat"), ("sleep", "NN", "sleep")]
    assert rows(frequencies.first_documents(docs, 1, 2).select("doc_id")) == [(2,)]
    tf = spark.createDataFrame([(1, 5, 2)], "doc_id long, term_id long, tf long")
    assert frequencies.holds_term(tf, 1, 5) and not frequencies.holds_term(tf, 2, 5)


def long_runs(spark):
    """Runs far beyond the stack: nouns, prepositions before a noun, adjectives before none; then short ones."""
    n = 20000
    texts = ["cat " * n, "of " * n + "cat", "useful " * n, "cat of useful hat is of cat of"]
    return n, linguistics.tag(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_term_spans_of_long_runs(spark):
    n, sents = long_runs(spark)
    got = {(r.doc_id, tuple(r["at"])) for r in linguistics.term_spans(sents).collect()}
    assert got == {(0, tuple(range(n))), (1, tuple(range(n + 1))), (3, (0, 1, 2, 3)), (3, (5, 6))}


def test_term_candidates_of_long_runs(spark):
    n, sents = long_runs(spark)
    got = {(r.doc_id, r.term) for r in linguistics.term_candidates(sents).collect()}
    assert got == {(0, "_".join(["cat"] * n)), (3, "useful_hat")}


def test_noun_chunks_of_long_runs(spark):
    n, sents = long_runs(spark)
    got = {tuple(r)[:1] + tuple(r)[2:] for r in linguistics.chunk_spans(sents).collect()}
    assert got == {(0, 0, n, n - 1), (1, n, n + 1, 0), (3, 0, 1, 0), (3, 2, 4, 1), (3, 6, 7, 0)}
    article = linguistics.tag(spark.createDataFrame([(1, "The 2 big cats and no dog")], "doc_id long, text string"))
    assert rows(linguistics.chunk_spans(article)) == [(1, 0, 1, 4, 2), (1, 0, 5, 7, 1)]


def test_glued_chunks_of_long_runs(spark):
    n, sents = long_runs(spark)
    glued = corpus.glue_spans(linguistics.tagged_rows(sents), linguistics.chunk_spans(sents))
    by_tag = {(r.doc_id, r.tag, r.n) for r in glued.groupBy("doc_id", "tag").agg(F.count("*").alias("n")).collect()}
    assert by_tag == {(0, f"{n - 1}np", 1), (1, "IN", n), (1, "0np", 1), (2, "JJ", n), (3, "0np", 2), (3, "1np", 1), (3, "IN", 3), (3, "VBP", 1)}
    assert rows(glued.where("doc_id = 3 OR doc_id = 0").where("tag LIKE '%np'").selectExpr("doc_id", "pos", "left(token, 10)")) == [(0, 0, "cat_cat_ca"), (3, 0, "cat"), (3, 2, "useful_hat"), (3, 5, "cat")]


def test_negatives_and_trainers(spark):
    terms = spark.createDataFrame([(f"t{i}",) for i in range(12)], "term string")
    known = spark.createDataFrame([(f"t{i}", f"t{i + 1}") for i in range(11)], "hypo string, hyper string")
    for n in (None, 40, 500):
        got = rows(learning.random_negatives(terms, known, n))
        assert len(got) == len(set(got)) == min(n or 11, 12 * 11 - 11) and not {g[:2] for g in got} & set(rows(known)) and all(a != b for a, b, _ in got)
    words = spark.createDataFrame([(1, 0, 0, "a"), (1, 0, 1, "b")], "doc_id long, sent_id int, pos int, word string")
    averages = spark.createDataFrame([("a", [1.0]), ("z", [2.0])], "term string, emb array<double>")
    assert rows(learning.train_vectors("ELMo", words, averages=averages)) == [("a", [1.0])]
    assert learning.train_vectors("Word2Vec", words, size=4).count() == 2
    assert rows(vectors.from_words(spark.createDataFrame([("a_q_z",)], "term string"), averages)) == [("a_q_z", [1.5])]


def test_taxonomy_keeps_its_invariants(spark):
    rng = np.random.default_rng(3)
    n_terms, n_docs = 120, 400
    topic = rng.integers(0, 5, n_terms)
    emb = [(i, (np.eye(5)[topic[i]] * 3 + rng.normal(size=5) * 0.3).tolist()) for i in range(n_terms)]
    tf = {(d, int(t)): 1 for d in range(n_docs) for t in rng.choice(np.nonzero(topic == d % 5)[0], 8)}
    tf_df = scratch.written(spark.createDataFrame([(d, t, n) for (d, t), n in tf.items()], "doc_id long, term_id long, tf long"))
    docs = spark.range(n_docs).withColumnRenamed("id", "doc_id")
    tfidf = scratch.written(frequencies.tf_idf(tf_df, docs))
    emb_df = scratch.written(spark.createDataFrame(emb, "term_id long, emb array<double>").join(tf_df.select("term_id").distinct(), "term_id", "left_semi"))
    made = taxonomy.generate(tf_df, tfidf, scratch.written(frequencies.postings(tf_df)), emb_df, scratch.written(vectors.document_vectors(tfidf, emb_df)), spark.range(n_terms).selectExpr("id AS term_id", "concat('t', id) AS term"), taxonomy.Config(depth=1, iterations=2))
    edges = rows(made.edges)
    children = [c for _, c, _ in edges]
    assert len(children) == len(set(children)) and sorted(children) == list(range(1, len(children) + 1)) and all(p < c for p, c, _ in edges)
    final = made.final_scores.select("node_id", "term_id").collect()
    assert len(final) == len(set(final)) and {r.node_id for r in final} <= {0, *children}
    root = {r.term_id for r in final if r.node_id == 0}
    pushed = {r.term_id for r in made.node_terms.where("node_id = 0").collect()}
    assert not root & pushed and root | pushed == {r.term_id for r in emb_df.collect()}
    assert made.center_similarities.where("abs(sim) > 1.000001").count() == 0
