"""Queries that write a table in one of the file formats and read it back, and small helpers over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import frequencies, postings, ruled, subcorpus, tree, vectors
from ..sources import readers, scratch, writers
from .linguistic_queries import TAGGED
from .registry import query, table
from .score_queries import occurrences
from .text_queries import CORPUS, words
from .tree_queries import TREE, edges, terms
from .vector_queries import term_emb


@query("stored_node_terms", f"WITH {TREE} SELECT node_id, rank, term_id, term, score FROM terms")
def stored_node_terms(spark, sf):
    path = scratch.place(spark, "node-terms")
    rows = terms(spark, sf)
    writers.node_rows(rows.where("rank <= 2"), path)
    writers.node_rows(rows.where("rank > 2"), path)
    return readers.node_rows(spark, path).select("node_id", "rank", "term_id", "term", "score")


@query("stored_scores_of_a_node", f"WITH {TREE} SELECT node_id, term_id, score FROM terms WHERE node_id = 3")
def stored_scores_of_a_node(spark, sf):
    """One node's rows, which is the feature: only its folder is read."""
    path = scratch.place(spark, "node-scores")
    writers.node_rows(terms(spark, sf).select("node_id", "term_id", "score"), path)
    return readers.node_rows(spark, path, 3).select("node_id", "term_id", "score")


@query("stored_taxonomy", f"WITH {TREE} SELECT t.node_id, rank, term_id, term, score, coalesce(n, 0)::BIGINT AS n_children FROM terms t LEFT JOIN (SELECT parent, count(*) AS n FROM edges GROUP BY parent) k ON k.parent = t.node_id")
def stored_taxonomy(spark, sf):
    path = scratch.place(spark, "taxonomy")
    writers.taxonomy(tree.rows(edges(spark, sf), terms(spark, sf)), path)
    kids, named = readers.taxonomy(spark, path)
    n = kids.groupBy(F.col("parent").alias("node_id")).agg(F.count("*").alias("n"))
    return named.join(n, "node_id", "left").select("node_id", "rank", "term_id", "term", "score", F.coalesce("n", F.lit(0)).cast("long").alias("n_children"))


@query("stored_vectors", "SELECT vec_id::VARCHAR AS term, len(embedding)::INT AS size, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 1")
def stored_vectors(spark, sf):
    path = scratch.place(spark, "vectors")
    writers.embeddings(term_emb(spark, sf).where("emb is not null and size(emb) > 1"), path, "term_id", header=True)
    total = F.aggregate("emb", F.lit(0.0), lambda a, x: a + x)
    return readers.embeddings(spark, path).select("term", F.size("emb").alias("size"), F.round(total, 4).alias("total"))


@query("stored_json_map", f"WITH {CORPUS} SELECT word AS key, count(*) AS value FROM corpus GROUP BY word")
def stored_json_map(spark, sf):
    """Word counts through several files of JSON objects."""
    path = scratch.place(spark, "json-map")
    writers.json_map(words(spark, sf).groupBy("word").agg(F.count("*").alias("n")).repartition(3), path, "word", "n")
    return readers.json_map(spark, path, "bigint")


@query("stored_binary_vectors", "SELECT term, (i - 1)::INT AS i, round(emb[i]::DOUBLE, 6) AS x FROM (SELECT vec_id::VARCHAR AS term, embedding AS emb FROM embeddings WHERE embedding IS NOT NULL), LATERAL (SELECT unnest(range(1, len(emb) + 1)) AS i)")
def stored_binary_vectors(spark, sf):
    """Whole vectors through binary files that are read in ranges far shorter than a file."""
    path = scratch.place(spark, "binary-vectors")
    writers.embeddings_binary(term_emb(spark, sf).where("emb is not null"), path, "term_id")
    found = readers.embeddings_binary(spark, path, 1 << 16)
    return found.select("term", F.posexplode("emb").alias("i", "x")).withColumn("x", F.round("x", 6))


@query("stored_document_vectors", "SELECT vec_id AS doc_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total FROM embeddings")
def stored_document_vectors(spark, sf):
    path = scratch.place(spark, "document-vectors")
    rows = term_emb(spark, sf).withColumnRenamed("term_id", "doc_id")
    writers.document_vectors_of(rows, path, True, "word2vec")
    total = F.aggregate("emb", F.lit(0.0), lambda a, x: a + x)
    return readers.document_vectors_of(spark, path, True, "word2vec").select("doc_id", F.round(total, 6).alias("total"))


@query("wanted_vectors", "SELECT (SELECT count(*) FROM embeddings WHERE vec_id IN (SELECT p_partkey FROM part)) AS n_found, (SELECT count(*) FROM part WHERE p_partkey NOT IN (SELECT vec_id FROM embeddings)) AS n_missing")
def wanted_vectors(spark, sf):
    v = term_emb(spark, sf).withColumnRenamed("term_id", "term")
    found, missing = readers.term_vectors(v, table(spark, sf, "part").select(F.col("p_partkey").alias("term")))
    return found.agg(F.count("*").alias("n_found")).join(missing.agg(F.count("*").alias("n_missing")))


@query("stored_corpus_json", f"WITH {TAGGED} SELECT doc_id::VARCHAR AS doc_id, sent_id::INT AS sent_id, pos::INT AS pos, token, tag, lemma FROM tagged")
def stored_corpus_json(spark, sf):
    path = scratch.place(spark, "corpus-json")
    writers.corpus_json_documents(ruled.fields(table(spark, sf, "documents")), path, "gzip")
    return readers.corpus_json(spark, path).select("doc_id", "sent_id", "pos", "token", "tag", "lemma")


@query("stored_corpus", f"WITH {CORPUS}, s AS (SELECT doc_id, sent_id, string_agg(word, ' ' ORDER BY pos) AS s FROM corpus GROUP BY ALL) SELECT doc_id, string_agg(s, chr(10) ORDER BY sent_id) AS content FROM s GROUP BY doc_id")
def stored_corpus(spark, sf):
    """Whole documents through the text format; documents are numbered by their order."""
    path = scratch.place(spark, "corpus")
    w = words(spark, sf)
    writers.corpus(w, path)
    back = readers.blocks(spark, path)
    return back.withColumnRenamed("doc_id", "k").join(_ranks(w.select("doc_id").distinct()), "k").select("doc_id", "content")


def _ranks(docs):
    """doc_id and its rank k from 0, counted within ranges of ids."""
    dealt = docs.withColumn("_r", F.floor(F.col("doc_id") / 1024))
    sizes = dealt.groupBy("_r").agg(F.count("*").alias("n"))
    before = sizes.select("_r", F.coalesce(F.sum("n").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inner = Window.partitionBy("_r").orderBy("doc_id")
    return dealt.withColumn("k", F.row_number().over(inner)).join(before, "_r").select("doc_id", (F.col("k") - 1 + F.col("before")).alias("k"))


@query("merged_counts", "WITH t AS (SELECT l_orderkey AS doc_id, l_partkey AS term_id, count(*) AS tf FROM lineitem GROUP BY ALL) SELECT doc_id, term_id, CASE WHEN term_id % 3 = 0 THEN tf + 100 ELSE tf END AS tf, term_id % 3 = 0 AS twice FROM t")
def merged_counts(spark, sf):
    tf = frequencies.term_frequency(occurrences(spark, sf))
    both, twice = frequencies.merged(tf, tf.where("term_id % 3 = 0").withColumn("tf", F.col("tf") + 100))
    marked = both.join(twice.withColumn("t", F.lit(True)), ["doc_id", "term_id"], "left")
    return marked.select("doc_id", "term_id", "tf", F.coalesce("t", F.lit(False)).alias("twice"))


@query("glued_words", "SELECT DISTINCT replace(p_name, ' ', '_') AS term, i - 1 AS i, string_split(p_name, ' ')[i] AS word FROM part, LATERAL (SELECT unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS i)")
def glued_words(spark, sf):
    names = table(spark, sf, "part").select(F.regexp_replace("p_name", " ", "_").alias("term")).distinct()
    return vectors.split_glued(names).select("term", F.col("i").cast("long").alias("i"), "word")


@query(
    "glued_word_vectors",
    "WITH n AS (SELECT DISTINCT p_name, string_split(p_name, ' ') AS w FROM part), u AS (SELECT p_name, unnest(w) AS word FROM n) SELECT replace(p_name, ' ', '_') AS term, round(avg(len(word)), 6) AS x, round(avg(ascii(word)), 6) AS y FROM u GROUP BY p_name",
)
def glued_word_vectors(spark, sf):
    names = table(spark, sf, "part").select(F.regexp_replace("p_name", " ", "_").alias("term")).distinct()
    w = table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("term")).distinct()
    emb = w.select("term", F.array(F.length("term").cast("double"), F.ascii("term").cast("double")).alias("emb"))
    return vectors.from_words(names, emb).select("term", F.round(F.col("emb")[0], 6).alias("x"), F.round(F.col("emb")[1], 6).alias("y"))


@query(
    "important_documents",
    "WITH t AS (SELECT DISTINCT l_partkey AS term_id, l_orderkey AS doc_id FROM lineitem), r AS (SELECT term_id, (term_id % 5)::INT AS label, row_number() OVER (PARTITION BY term_id % 5 ORDER BY term_id) AS rank FROM (SELECT DISTINCT term_id FROM t)) SELECT DISTINCT 0::BIGINT AS node_id, label, doc_id FROM r JOIN t USING (term_id) WHERE rank <= 20",
)
def important_documents(spark, sf):
    tf = frequencies.term_frequency(occurrences(spark, sf))
    label = (F.col("term_id") % 5).cast("int")
    ranked = tf.select("term_id").distinct().select(F.lit(0).cast("long").alias("node_id"), label.alias("label"), "term_id")
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("node_id", "label").orderBy("term_id")))
    return subcorpus.by_importance(ranked, postings.stored(tf), 20)


@query("whole_vectors", "SELECT vec_id AS term_id, (i - 1)::INT AS i, round(2 * embedding[i]::DOUBLE - embedding[1]::DOUBLE, 6) AS diff FROM embeddings, LATERAL (SELECT unnest(range(1, len(embedding) + 1)) AS i)")
def whole_vectors(spark, sf):
    """All components of scaled vectors less another vector."""
    first = F.array_repeat(F.col("emb")[0], F.size("emb"))
    return term_emb(spark, sf).select("term_id", F.posexplode(V.difference(V.scaled(F.col("emb"), F.lit(2.0)), first)).alias("i", "x")).select("term_id", "i", F.round("x", 6).alias("diff"))
