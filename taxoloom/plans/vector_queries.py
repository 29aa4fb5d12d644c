"""Queries over embeddings: a vector's id is a term, its label the cluster."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import frequencies, subcorpus, vectors
from .registry import query, table
from .text_queries import TF, counts

EMB = """
e AS (SELECT vec_id AS term_id, embedding::DOUBLE[] AS emb, label FROM embeddings),
x AS (SELECT label, i, avg(emb[i]) AS x FROM e, LATERAL (SELECT unnest(range(1, len(emb) + 1)) AS i) GROUP BY ALL),
c AS (SELECT label, list(x ORDER BY i) AS center FROM x GROUP BY label)
"""
SIMS = EMB + ", s AS (SELECT term_id, c.label, round(list_cosine_similarity(emb, center), 9) AS sim FROM e CROSS JOIN c)"
OWN = EMB + ", o AS (SELECT e.label, term_id, round(list_cosine_similarity(emb, center), 9) AS sim FROM e JOIN c USING (label)), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sim DESC, term_id)::INT AS rank FROM o)"


def term_emb(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("term_id"), F.transform("embedding", lambda x: x.cast("double")).alias("emb"))


def cluster(spark, sf):
    return table(spark, sf, "embeddings").select(F.lit(0).alias("node_id"), F.col("vec_id").alias("term_id"), "label")


def centers(spark, sf):
    return vectors.centers(cluster(spark, sf), term_emb(spark, sf))


@query("topic_centroids", f"WITH {EMB} SELECT label, (i - 1)::INT AS i, round(x, 6) AS x FROM x")
def topic_centroids(spark, sf):
    return centers(spark, sf).select("label", F.posexplode("emb").alias("i", "x")).withColumn("x", F.round("x", 6))


def sims(spark, sf):
    return subcorpus.similarities(term_emb(spark, sf).withColumnRenamed("term_id", "doc_id"), centers(spark, sf))


@query("cosine_doc_topic", f"WITH {SIMS} SELECT term_id AS doc_id, label, round(sim, 6) AS sim FROM s")
def cosine_doc_topic(spark, sf):
    return sims(spark, sf).select("doc_id", "label", F.round("sim", 6).alias("sim"))


@query("assign_topic", f"WITH {SIMS} SELECT term_id AS doc_id, label FROM (SELECT *, row_number() OVER (PARTITION BY term_id ORDER BY sim DESC, label) AS k FROM s) WHERE k = 1")
def assign_topic(spark, sf):
    return subcorpus.strongest(sims(spark, sf), "sim").select("doc_id", "label")


@query(
    "topic_docs_top_m",
    f"WITH {SIMS}, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY term_id ORDER BY sim DESC, label) AS k FROM s) WHERE k = 1) SELECT label, doc_id, rank FROM (SELECT label, term_id AS doc_id, row_number() OVER (PARTITION BY label ORDER BY sim DESC, term_id) AS rank FROM b) WHERE rank <= 20",
)
def topic_docs_top_m(spark, sf):
    return subcorpus.by_retrieval(term_emb(spark, sf).withColumnRenamed("term_id", "doc_id"), centers(spark, sf)).where("rank <= 20").select("label", "doc_id", "rank")


@query("terms_by_centrality", f"WITH {OWN} SELECT label, term_id, round(sim, 6) AS sim, rank FROM r")
def terms_by_centrality(spark, sf):
    return vectors.central_terms(cluster(spark, sf), term_emb(spark, sf), centers(spark, sf)).select("label", "term_id", F.round("sim", 6).alias("sim"), "rank")


@query("center_terms_top_k", f"WITH {OWN} SELECT label, term_id, rank FROM r WHERE rank <= 10")
def center_terms_top_k(spark, sf):
    ranked = vectors.central_terms(cluster(spark, sf), term_emb(spark, sf), centers(spark, sf))
    return ranked.where("rank <= 10").select("label", "term_id", "rank")


@query("vector_diff", f"WITH {EMB} SELECT term_id, (i - 1)::INT AS i, round(emb[i] - center[i], 6) AS x FROM e JOIN c USING (label), LATERAL (SELECT unnest(range(1, len(emb) + 1)) AS i)")
def vector_diff(spark, sf):
    """Every vector less its topic's centre, whole."""
    c = centers(spark, sf).select("label", F.col("emb").alias("center"))
    rows = table(spark, sf, "embeddings").join(F.broadcast(c), "label")
    diff = V.difference(F.transform("embedding", lambda x: x.cast("double")), F.col("center"))
    return rows.select(F.col("vec_id").alias("term_id"), F.posexplode(diff).alias("i", "x")).withColumn("x", F.round("x", 6))


@query("vector_concat", "SELECT term_id, (i - 1)::INT AS i, round(emb[i], 6) AS x FROM (SELECT vec_id AS term_id, list_concat(embedding::DOUBLE[], list_transform(embedding::DOUBLE[], lambda x: 2 * x)) AS emb FROM embeddings), LATERAL (SELECT unnest(range(1, len(emb) + 1)) AS i)")
def vector_concat(spark, sf):
    """Every vector with its double behind it, whole."""
    first = term_emb(spark, sf)
    second = first.select("term_id", V.scaled(F.col("emb"), F.lit(2.0)).alias("emb"))
    return vectors.combined(first, second).select("term_id", F.posexplode("emb").alias("i", "x")).withColumn("x", F.round("x", 6))


@query("embedding_mean_merge", f"WITH {EMB} SELECT label, (i - 1)::INT AS i, round(x, 6) AS x, n FROM x JOIN (SELECT label, count(*) AS n FROM e GROUP BY label) USING (label)")
def embedding_mean_merge(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("label").alias("term_id"), F.transform("embedding", lambda x: x.cast("double")).alias("emb"), (F.col("vec_id") % 2).alias("part"))
    parts = vectors.mean(rows, ["term_id", "part"]).join(rows.groupBy("term_id", "part").agg(F.count("*").alias("n")), ["term_id", "part"])
    merged = vectors.weighted_merge(parts.where("part = 0"), parts.where("part = 1"))
    return merged.select(F.col("term_id").alias("label"), "n", F.posexplode("emb").alias("i", "x")).withColumn("x", F.round("x", 6))


@query("layer_choice", "SELECT vec_id AS term_id, (i - 1)::INT AS i, round(2 * embedding[i]::DOUBLE, 6) AS mean, round(embedding[i]::DOUBLE, 6) AS first, round(3 * embedding[i]::DOUBLE, 6) AS last FROM embeddings, LATERAL (SELECT unnest(range(1, len(embedding) + 1)) AS i)")
def layer_choice(spark, sf):
    """The mean, the first and the last of three layers (a vector once, twice, three times), whole."""
    e = F.col("emb")
    layers = F.array(e, V.scaled(e, F.lit(2.0)), V.scaled(e, F.lit(3.0)))
    rows = term_emb(spark, sf).select("term_id", F.posexplode(F.arrays_zip(V.layer(layers, 2).alias("mean"), V.layer(layers, 0).alias("first"), V.layer(layers, 1).alias("last"))).alias("i", "x"))
    return rows.select("term_id", "i", *(F.round(f"x.{c}", 6).alias(c) for c in ("mean", "first", "last")))


@query(
    "doc_embedding",
    f"""WITH {TF}, n AS (SELECT max(vec_id) + 1 AS n FROM embeddings), j AS (SELECT doc_id, tfidf, embedding::DOUBLE[] AS emb FROM tfidf, n JOIN embeddings ON vec_id = ('0x' || substr(md5(term), 1, 8))::BIGINT % n)
    SELECT doc_id, (i - 1)::INT AS i, round(avg(tfidf * emb[i]), 6) AS x FROM j, LATERAL (SELECT unnest(range(1, len(emb) + 1)) AS i) GROUP BY doc_id, i""",
)
def doc_embedding(spark, sf):
    """Every term of every document has a vector: that of the id which the term's MD5 gives."""
    docs = table(spark, sf, "documents")
    emb = table(spark, sf, "embeddings").select(F.col("vec_id").alias("term_id"), F.col("embedding").alias("emb"))
    n = emb.agg(F.max("term_id") + 1).first()[0]
    number = F.conv(F.substring(F.md5("term_id"), 1, 8), 16, 10).cast("long") % F.lit(n).cast("long")
    found = frequencies.tf_idf(counts(spark, sf), docs, number=number).select("doc_id", F.col("number").alias("term_id"), "tfidf")
    rows = (docs.agg(F.sum(F.length("text"))).first()[0] or 0) // 8  # about a word of each document's
    return vectors.document_vectors(found, emb, rows).select("doc_id", F.posexplode("emb").alias("i", "x")).withColumn("x", F.round("x", 6))


@query("check_embedded", "SELECT 'embedded' AS \"check\", count(*) AS violations FROM (SELECT DISTINCT l_partkey AS k FROM lineitem) WHERE k NOT IN (SELECT vec_id FROM embeddings)")
def check_embedded(spark, sf):
    from ..operators import checks

    terms = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("term_id")).distinct()
    return checks.embedded(terms, term_emb(spark, sf))
