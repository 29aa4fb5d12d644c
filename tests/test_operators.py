"""Operators against literal fixtures and invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from taxoloom.functions import text, vectors
from taxoloom.operators import checks, corpus, evaluation, frequencies, labeling, learning, relations, scoring, subcorpus, taxonomy, terms, tree
from taxoloom.operators import vectors as vector_ops
from taxoloom.sources import readers, writers

TF = [(1, 1, 1), (2, 9, 1), (3, 7, 2), (3, 5, 1), (4, 8, 1), (5, 3, 1), (5, 16, 1), (6, 11, 2), (7, 16, 4), (8, 1, 1), (9, 2, 2), (9, 4, 1)]
SUB = {0: [2, 3, 5], 1: [9], 2: [4, 8, 9], 3: [3], 4: [6, 7]}
CLUSTER = {0: [3, 7, 9], 1: [2], 2: [1, 4, 8], 3: [5], 4: [11, 16]}
#: term: bm25 by label, concentration in the own label, shares by label, divergence
EXPECTED = {
    1: ([0, 0, 2.930502, 0, 0], 0.789359, [0, 0, 1, 0, 0], 1.609438),
    2: ([0, 4.412791, 4.058824, 0, 0], 0.571303, [0, 0.544131, 0.455869, 0, 0], 0.920191),
    3: ([2.770073, 0, 0, 0, 0], 0.761448, [1, 0, 0, 0, 0], 1.609438),
    7: ([3.902314, 0, 0, 4.412791, 0], 0.364051, [0.436535, 0, 0, 0.563465, 0], 0.924368),
    16: ([2.770073, 0, 0, 0, 4.904685], 0.871127, [0.255916, 0, 0, 0, 0.744084], 1.040696),
}


@pytest.fixture(scope="module")
def scored(spark):
    tf = spark.createDataFrame(TF, "doc_id long, term_id long, tf long")
    sub = spark.createDataFrame([(0, k, d) for k, ds in SUB.items() for d in ds], "node_id long, label int, doc_id long")
    cluster = spark.createDataFrame([(0, k, t) for k, ts in CLUSTER.items() for t in ts], "node_id long, label int, term_id long")
    return scoring.scored(tf, sub, cluster).cache()


def test_scores_of_the_fixture(scored):
    cells = {(r.term_id, r.label): r for r in scored.collect()}
    for t, (bm25, con, l1, kl) in EXPECTED.items():
        assert [round(cells[t, k].bm25, 6) for k in range(5)] == bm25
        assert [round(cells[t, k].l1, 6) for k in range(5)] == l1
        own = cells[t, 0].own
        assert round(cells[t, own].con, 6) == con
    scores = {r.term_id: r.score for r in scoring.divergence(scored).collect()}
    assert all(round(scores[t], 6) == e[3] for t, e in EXPECTED.items())
    assert all(-1e-9 <= s <= math.log(5) + 1e-9 for s in scores.values())


def test_pseudo_lengths(scored):
    assert {r.label: r.len for r in scoring.pseudo_lengths(scored.select("node_id", "term_id", "own", "label", "df", "tf")).collect()} == {0: 6, 1: 3, 2: 5, 3: 3, 4: 6}


def test_variants(spark):
    assert [scoring.Variant(df_version=d, no_denominator=n, df_sum=s, tf_sum=t).name() for d, n, s, t in ((1, 1, 0, 0), (1, 0, 1, 0), (1, 0, 0, 0), (0, 0, 0, 1), (0, 0, 0, 0))] == ["df_nodenom", "df_sum", "df", "tf_sum", "tf"]
    with pytest.raises(ValueError):
        scoring.total(scoring.Variant(use_pop=False, use_con=False))


def test_push_up(spark):
    s = spark.createDataFrame([(0, t, int(t > 3), v) for t, v in ((1, 0.3), (2, 0.2), (3, 0.24), (4, 0.25), (5, 0.26), (6, 1.0))], "node_id long, term_id long, label int, score double")
    assert {r.term_id for r in scoring.split_general(s, 0.25).where("pushed").collect()} == {2, 3}
    assert {r.term_id for r in scoring.split_general(s, 0.25, keep_least=True).where("pushed").collect()} == {2, 3, 4}


def test_vectors_of_the_fixture(spark):
    docs = spark.createDataFrame([(1, [1.0, 1.0]), (10, [0.5, 2.0]), (3, [2.0, 0.5])], "doc_id long, emb array<double>")
    center = spark.createDataFrame([(0, 0, [1.0, 2.0]), (0, 1, [2.0, 1.0])], "node_id long, label int, emb array<double>")
    sims = {(r.doc_id, r.label): round(r.sim, 6) for r in subcorpus.similarities(docs, center).collect()}
    assert sims == {(1, 0): 0.948683, (1, 1): 0.948683, (10, 0): 0.976187, (10, 1): 0.650791, (3, 0): 0.650791, (3, 1): 0.976187}
    top = {(r.label, r.doc_id) for r in subcorpus.by_retrieval(docs, center).where("rank <= 2").collect()}
    assert top == {(0, 1), (0, 10), (1, 3)}
    emb = spark.createDataFrame([(0, [1.0, 0.5]), (1, [3.0, 1.0]), (2, [1.0, 1.5]), (3, [1.0, 1.0]), (4, [1.0, 4.0])], "term_id long, emb array<double>")
    cluster = spark.createDataFrame([(0, 0, 0), (0, 0, 2), (0, 0, 4), (0, 1, 1), (0, 1, 3)], "node_id long, label int, term_id long")
    near = vector_ops.central_terms(cluster, emb, center).where("rank <= 2")
    assert {(r.label, r.term_id) for r in near.collect()} == {(0, 2), (0, 4), (1, 1), (1, 3)}
    post = spark.createDataFrame([(0, [2, 4]), (1, [4]), (2, [9, 7]), (3, [8, 9]), (4, [6])], "term_id long, docs array<long>")
    pairs = near.select("node_id", "label", "term_id")
    got = {(r.label, r.doc_id) for r in subcorpus.documents_of(pairs, post).collect()}
    assert got == {(0, 9), (0, 7), (0, 6), (1, 4), (1, 8), (1, 9)}


def test_relevance_by_blocks(spark):
    def loop(ranked, posts, m, block):
        use, docs, at = ranked[:-1], [], 0
        while len(set(docs)) < m and at < len(use):
            for t in use[at : at + block]:
                docs += sorted(posts.get(t, []))
            at += block
        return docs

    rng = np.random.default_rng(0)
    for case in range(4):
        ranked = rng.permutation(12).tolist()
        posts = {t: sorted({int(x) for x in rng.integers(0, 15, rng.integers(1, 5))}) for t in range(12)}
        m, block = int(rng.integers(1, 14)), int(rng.integers(1, 5))
        df = spark.createDataFrame([(0, 0, t, n + 1) for n, t in enumerate(ranked)], "node_id long, label int, term_id long, rank int")
        post = spark.createDataFrame(list(posts.items()), "term_id long, docs array<long>")
        got = [r.doc_id for r in subcorpus.by_relevance(df, post, m, block).orderBy("rank").collect()]
        assert got == loop(ranked, posts, m, block), case


def test_extension_and_prefix(spark):
    base = spark.createDataFrame([(0, 0, 5, 1), (0, 0, 5, 2), (0, 0, 6, 3)], "node_id long, label int, doc_id long, rank int")
    other = spark.createDataFrame([(0, 0, 6, 1), (0, 0, 8, 2), (0, 0, 7, 3)], "node_id long, label int, doc_id long, rank int")
    out = subcorpus.extended(base, other)
    assert [(r.doc_id, r["rank"]) for r in out.orderBy("rank").collect()] == [(5, 1), (5, 2), (6, 3), (8, 4), (7, 5)]
    assert {r.doc_id for r in subcorpus.first_m(out, 4).collect()} == {5, 6, 8}
    assert subcorpus.sub_corpus_size(100, 1) == 10


def test_sub_lists(spark):
    rows = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "w array<string>").select(text.sub_lists(F.col("w")).alias("s")).collect()
    assert rows[0].s == [["a"], ["b"], ["c"], ["a", "b"], ["b", "c"]] and rows[1].s == [] and rows[2].s == []


def test_c_values(spark):
    c = spark.createDataFrame([("a_b_c", 5, 3), ("b_c", 9, 2), ("x_y", 4, 2), ("a", 9, 1)], "term string, freq long, length int")
    got = {r.term: r.cval for r in terms.c_values(c).collect()}
    assert got == pytest.approx({"a_b_c": 5 * math.log2(3), "b_c": 9 - 5, "x_y": 4})
    fixed = {r.term: r.cval for r in terms.c_values(c, corrected=True).collect()}
    assert fixed["b_c"] == pytest.approx(4)
    assert terms.c_values(c.limit(0)).count() == 0


def test_vocabulary_is_dense(spark):
    docs = spark.createDataFrame([(d, f"w{d % 7} x{d}\ny w{d % 3}") for d in range(3000)], "doc_id long, text string")
    w = corpus.words(docs)
    vocab = corpus.vocabulary(w)
    assert checks.dense_ids(vocab).first().violations == 0
    assert [r.term for r in vocab.orderBy("term_id").limit(4).collect()] == ["w0", "x0", "y", "w1"]
    enc = corpus.encode(w, vocab, strict=True)
    assert enc.count() == w.count()
    assert checks.same_shape(w, enc.withColumnRenamed("term_id", "word")).first().violations == 0


def test_tree_keeps_out_of_incomplete_parents(spark):
    edges = spark.createDataFrame([(0, 1, 0), (0, 2, 1), (1, 3, 0), (1, 4, 1), (2, 5, 0)], "parent long, child long, child_ord int")
    t = spark.createDataFrame([(n, 1, n, f"t{n}", 1.0) for n in (0, 1, 2, 3, 5)], "node_id long, rank int, term_id long, term string, score double")
    got = {(r.hyper, r.hypo) for r in tree.relations(edges, t, 0, 1).collect()}
    assert got == {("t0", "t1"), ("t0", "t2"), ("t2", "t5")}
    kept = {(r.parent, r.child) for r in tree.without_empty_children(edges, t, 0).collect()}
    assert kept == {(0, 1), (0, 2), (1, 3), (2, 5)}


def test_taxonomy_files(spark, tmp_path):
    edges = spark.createDataFrame([(0, 1, 0), (0, 2, 1)], "parent long, child long, child_ord int")
    t = spark.createDataFrame([(0, 1, 7, "net", 0.5), (0, 2, 8, "3d", 0.25), (1, 1, 9, "a_b", 1.0)], "node_id long, rank int, term_id long, term string, score double")
    writers.taxonomy(tree.rows(edges, t), f"{tmp_path}/t")
    e, n = readers.taxonomy(spark, f"{tmp_path}/t")
    assert sorted(map(tuple, e.collect())) == [(0, 1, 0), (0, 2, 1)]
    assert sorted(map(tuple, n.select(*t.columns).collect())) == sorted(map(tuple, t.collect()))


def test_text_round_trips(spark, tmp_path):
    rows = [(0, 0, 0, "dogs", "NNS", "dog", False), (0, 0, 1, "bark", "VBP", "bark", False), (0, 1, 0, "yes", "UH", "yes", True), (1, 0, 0, "x", "NN", "x", False)]
    t = spark.createDataFrame(rows, "doc_id long, sent_id int, pos int, token string, tag string, lemma string, is_stop boolean").coalesce(1)
    writers.analysed(t, f"{tmp_path}/a")
    back = readers.analysed(spark, f"{tmp_path}/a")
    assert sorted(map(tuple, back.collect())) == rows
    writers.corpus(t.withColumnRenamed("token", "word"), f"{tmp_path}/c")
    assert [(r.doc_id, r.content) for r in readers.blocks(spark, f"{tmp_path}/c").orderBy("doc_id").collect()] == [(0, "dogs bark\nyes"), (1, "x")]
    (tmp_path / "titles.xml").write_text("<title> A b </title>\n<title>Home Page</title>\n<year>1</year>\n<title> </title>\n<title>C</title>\n")
    assert [r.content for r in readers.titles(spark, f"{tmp_path}/titles.xml").orderBy("doc_id").collect()] == ["A b", "C"]
    (tmp_path / "m.json").write_text('{"1": "a", "2": "b"}')
    assert {(r.key, r.value) for r in readers.json_map(spark, f"{tmp_path}/m.json").collect()} == {("1", "a"), ("2", "b")}
    (tmp_path / "g.json").write_text('{"a": {"b": {}, "c": {}}}')
    assert {(r.level, r.term) for r in readers.gold(spark, f"{tmp_path}/g.json").collect()} == {(1, "a"), (2, "b"), (2, "c")}
    v = spark.createDataFrame([("a", [1.0, 2.5]), ("b", [0.0, -1.0])], "term string, emb array<double>")
    writers.embeddings(v, f"{tmp_path}/v")
    assert sorted(map(tuple, readers.embeddings(spark, f"{tmp_path}/v").collect())) == sorted(map(tuple, v.collect()))
    (tmp_path / "prev.csv").write_text("a,b,1\na,b,0\n")
    assert [tuple(r) for r in readers.previous_labels(spark, f"{tmp_path}/prev.csv").collect()] == [("a", "b", 0)]


def test_small_clusters_and_agglomeration(spark):
    e = spark.createDataFrame([(i, [float(i), 1.0]) for i in (4, 2, 9)], "term_id long, emb array<double>")
    assert {(r.term_id, r.label) for r in learning.cluster_terms(e).collect()} == {(2, 0), (4, 1), (9, 2)}
    rng = np.random.default_rng(1)
    big = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=3)]) for i in range(30)], "term_id long, emb array<double>")
    assert {r.label for r in learning.cluster_terms(big).select("label").distinct().collect()} == set(range(5))
    two = np.array([[1, 0], [1, 0.1], [0, 1], [0.1, 1.0]])
    assert learning.agglomerate(two, 2).tolist() == [0, 0, 1, 1]


def test_labels_and_evaluation(spark):
    assert set(labeling.VARIANTS) == {"repr", "sim", "ls", "no_cos", "no_hypo", "no_incl", "only_hypo", "only_incl"}
    post = spark.createDataFrame([(1, [1, 2, 3]), (2, [2, 3]), (3, [9])], "term_id long, docs array<long>")
    incl = labeling.inclusion(post, spark.createDataFrame([(0, 2)], "node_id long, term_id long"), spark.createDataFrame([(0, 1), (0, 3)], "node_id long, term_id long"))
    assert {r.term_id: r.incl for r in incl.collect()} == {1: 0.5, 3: 0.0}
    p = evaluation.precision(spark.createDataFrame([(1,), (0,), (None,), (1,)], "label int")).first()
    assert (p.n, p.n_true) == (3, 2) and p.precision == pytest.approx(2 / 3)
    assert evaluation.precision(spark.createDataFrame([], "label int")).first().precision is None
    rel = spark.range(500).select(F.col("id").cast("string").alias("hyper"), F.lit("x").alias("hypo"))
    assert evaluation.sample(rel).collect() == evaluation.sample(rel.repartition(7)).collect()


def test_frequencies_without_terms(spark):
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    tf = frequencies.term_frequency(spark.createDataFrame([(1, 5), (1, 5), (2, 6)], "doc_id long, term_id long"))
    got = {(r.doc_id, r.term_id): r.tfidf for r in frequencies.tf_idf(tf, docs).collect()}
    assert got == pytest.approx({(1, 5): 2 * math.log(3), (2, 6): math.log(3)})
    assert frequencies.prune(tf, 2).count() == 1


def test_cosine_of_zero_is_null(spark):
    r = spark.sql("SELECT array(0D, 0D) AS a, array(1D, 0D) AS b").select(vectors.cosine(F.col("a"), F.col("b")).alias("x")).first()
    assert r.x is None


def test_taxonomy_small(spark, tmp_path):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path))
    rng = np.random.default_rng(3)
    occ = [(d, int(5 * rng.integers(0, 4) + d % 5)) for d in range(60) for _ in range(6)]
    tf = frequencies.term_frequency(spark.createDataFrame(occ, "doc_id long, term_id long"))
    tfidf = frequencies.tf_idf(tf, tf)
    emb = spark.createDataFrame([(t, [float(t % 5 == k) + 0.01 * float(rng.random()) for k in range(5)]) for t in range(20)], "term_id long, emb array<double>")
    docs = vector_ops.document_vectors(tfidf, emb)
    names = emb.select("term_id", F.concat(F.lit("t"), F.col("term_id").cast("string")).alias("term"))
    made = taxonomy.generate(tf, tfidf, frequencies.postings(tf), emb, docs, names, taxonomy.Config(depth=0, iterations=1, least=1))
    e = made.edges.collect()
    assert {r.parent for r in e} == {0} and [r.child for r in sorted(e, key=lambda r: r.child)] == list(range(1, len(e) + 1)) and len(e) <= 5
