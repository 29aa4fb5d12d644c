"""Counts over (document, term) occurrences: tf, postings, lengths, tf-idf and pruning.

Occurrence tables hold doc_id and term_id, one row for each occurrence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def term_frequency(occ: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    if terms is not None:
        occ = occ.join(terms.select("term_id"), "term_id", "left_semi")
    return occ.groupBy("doc_id", "term_id").agg(F.count("*").alias("tf"))


def postings(tf: DataFrame) -> DataFrame:
    """Ascending document ids of each term and their number."""
    return tf.groupBy("term_id").agg(F.sort_array(F.collect_list("doc_id")).alias("docs"), F.count("*").alias("df"))


def document_frequency(tf: DataFrame) -> DataFrame:
    return tf.groupBy("term_id").agg(F.count("*").alias("df"))


def lengths(occ: DataFrame) -> DataFrame:
    return occ.groupBy("doc_id").agg(F.count("*").alias("dl"))


def tf_idf(tf: DataFrame, docs: DataFrame, **of_term: Column) -> DataFrame:
    """tf times ln(N / df); N counts all documents, those without terms too. Further columns are made once a term."""
    n = docs.select("doc_id").distinct().agg(F.count("*").alias("n"))
    df = document_frequency(tf).withColumns(of_term)
    return tf.join(df, "term_id").join(F.broadcast(n)).select("doc_id", "term_id", "tf", (F.col("tf") * F.ln(F.col("n") / F.col("df"))).alias("tfidf"), *of_term)


def tf_idf_smooth(tf: DataFrame, docs: DataFrame) -> DataFrame:
    """Smoothed idf ``ln((1 + n) / (1 + df)) + 1``, rows scaled to length one."""
    n = docs.select("doc_id").distinct().agg(F.count("*").alias("n"))
    raw = tf.join(document_frequency(tf), "term_id").join(F.broadcast(n)).withColumn("x", F.col("tf") * (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    size = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("doc_id")))
    return raw.select("doc_id", "term_id", (F.col("x") / size).alias("tfidf"))


def prune(tf: DataFrame, least: int = 3) -> DataFrame:
    """Only terms that occur at least so often in the whole corpus."""
    strong = tf.groupBy("term_id").agg(F.sum("tf").alias("total")).where(F.col("total") >= least)
    return tf.join(strong.select("term_id"), "term_id", "left_semi")


def distribution(tfidf: DataFrame, dl: DataFrame) -> DataFrame:
    """tf and tf-idf of each document's terms with the document's length."""
    return tfidf.join(dl, "doc_id").select("doc_id", "term_id", "tf", "tfidf", "dl")


def top_terms(tfidf: DataFrame, k: int = 10) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy(F.desc(F.round("tfidf", 9)), "term_id")
    return tfidf.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def holds_term(tf: DataFrame, doc_id: int, term_id: int) -> bool:
    return not tf.where((F.col("doc_id") == doc_id) & (F.col("term_id") == term_id)).isEmpty()


def first_documents(docs: DataFrame, n: int, start: int = 0, id_col: str = "doc_id") -> DataFrame:
    """The first ``n`` documents by id from ``start`` on."""
    return docs.where(F.col(id_col) >= start).orderBy(id_col).limit(n)


def merged(*parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Long tables (doc_id, term_id, value columns) as one, and the (doc_id, term_id) that more than one row has.

    Of repeated keys the row of the last part stays.
    """
    both = None
    for i, part in enumerate(parts):
        rows = part.withColumn("_part", F.lit(i))
        both = rows if both is None else both.unionByName(rows)
    values = [c for c in both.columns if c not in ("doc_id", "term_id", "_part")]
    grouped = both.groupBy("doc_id", "term_id").agg(F.max(F.struct("_part", *values)).alias("v"), F.count("*").alias("n"))
    return grouped.select("doc_id", "term_id", *(F.col(f"v.{c}").alias(c) for c in values)), grouped.where("n > 1").select("doc_id", "term_id", "n")

