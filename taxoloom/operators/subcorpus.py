"""Choice of the documents that stand for each cluster of a node."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine
from . import postings as P
from . import ranking


def strengths(tfidf: DataFrame, cluster: DataFrame, weight: str = "idf", node_docs: DataFrame | None = None) -> DataFrame:
    """node_id, doc_id, label, strength: sum of idf (or tf-idf) of the document's cluster terms, dense over labels.

    With ``node_docs`` (node_id, doc_id) only those documents of a node are judged, else all documents for every node.
    """
    value = F.try_divide(F.col("tfidf"), F.col("tf").cast("double")) if weight == "idf" else F.col("tfidf")
    found = tfidf.join(cluster, "term_id").groupBy("node_id", "doc_id", "label").agg(F.sum(value).alias("strength"))
    labels = cluster.select("node_id", "label").distinct()
    if node_docs is None:
        dense = tfidf.select("doc_id").distinct().join(F.broadcast(labels))
    else:
        dense = node_docs.join(tfidf.select("doc_id"), "doc_id", "left_semi").join(F.broadcast(labels), "node_id")
    return dense.join(found, ["node_id", "doc_id", "label"], "left").select("node_id", "doc_id", "label", F.round(F.coalesce("strength", F.lit(0.0)), 9).alias("strength"))


def strongest(rows: DataFrame, value: str = "strength") -> DataFrame:
    """The label of the greatest value for each document, ties to the smallest label.

    An aggregation, so a partial maximum is taken before the shuffle.
    """
    best = rows.groupBy("node_id", "doc_id").agg(F.max(F.struct(F.col(value).alias("v"), (-F.col("label")).alias("l"))).alias("b"))
    return best.select("node_id", "doc_id", (-F.col("b.l")).cast("int").alias("label"), F.col("b.v").alias(value))


def ranked(assigned: DataFrame, value: str = "strength") -> DataFrame:
    """Ranks within node and label by ranges of values, as a few labels hold all documents."""
    return ranking.ranked(assigned, ["node_id", "label"], [F.desc(value), "doc_id"], "rank")


def assigned_by_strength(tfidf: DataFrame, cluster: DataFrame, weight: str = "idf", node_docs: DataFrame | None = None) -> DataFrame:
    """All documents (of each node) under their strongest label; documents without cluster terms go to the first label."""
    return strongest(strengths(tfidf, cluster, weight, node_docs))


def by_strength(tfidf: DataFrame, cluster: DataFrame, weight: str = "idf") -> DataFrame:
    return ranked(assigned_by_strength(tfidf, cluster, weight))


def similarities(items: DataFrame, centers: DataFrame) -> DataFrame:
    """Cosine of every item's ``emb`` with its node's centres, or all centres without ``node_id``; a node has a few at most."""
    c = F.broadcast(centers.select("node_id", "label", F.col("emb").alias("center")))
    met = items.join(c, "node_id") if "node_id" in items.columns else items.join(c)
    return met.withColumn("sim", F.round(cosine(F.col("emb"), F.col("center")), 9)).drop("emb", "center")


def assigned_by_retrieval(doc_emb: DataFrame, centers: DataFrame, node_docs: DataFrame | None = None) -> DataFrame:
    """All documents (of each node) with a vector under their nearest centre."""
    items = doc_emb if node_docs is None else node_docs.join(doc_emb, "doc_id")
    return strongest(similarities(items, centers).where("sim is not null"), "sim")


def by_retrieval(doc_emb: DataFrame, centers: DataFrame) -> DataFrame:
    return ranked(assigned_by_retrieval(doc_emb, centers), "sim")


def first_m(subcorpus: DataFrame, m) -> DataFrame:
    """The first m ranks of each label, then distinct documents: repeats within them shorten the result."""
    return subcorpus.where(F.col("rank") <= m).select("node_id", "label", "doc_id").distinct()


def extended(base: DataFrame, other: DataFrame) -> DataFrame:
    """The base ranks, then the other list's documents that the label doesn't hold yet."""
    ends = base.groupBy("node_id", "label").agg(F.max("rank").alias("last"))
    new = other.join(base, ["node_id", "label", "doc_id"], "left_anti")
    new = ranking.ranked(new, ["node_id", "label"], ["rank"], "k").join(F.broadcast(ends), ["node_id", "label"], "left")
    moved = new.select("node_id", "label", "doc_id", (F.col("k") + F.coalesce("last", F.lit(0))).alias("rank"))
    return base.select("node_id", "label", "doc_id", "rank").union(moved)


def by_relevance(ranked_terms: DataFrame, postings: DataFrame, m: int, block: int = 100) -> DataFrame:
    """Documents of the most central terms, block by block of terms until a label has m distinct ones.

    ``ranked_terms`` holds node_id, label, term_id, rank (1 is the most central). The least central term of a
    label is never used, as in the original. The list keeps repeats; ranks order it by term, then document.
    """
    last = ranked_terms.groupBy("node_id", "label").agg(F.max("rank").alias("n"))
    used = ranked_terms.join(F.broadcast(last), ["node_id", "label"]).where("rank < n").select("node_id", "label", "term_id", F.col("rank").alias("term_rank"), F.floor((F.col("rank") - 1) / block).alias("blk"))
    held = used.join(postings, "term_id")
    rows = P.documents(held.drop("term_id", "term_rank"))
    first = rows.groupBy("node_id", "label", "doc_id").agg(F.min("blk").alias("blk")).groupBy("node_id", "label", "blk").agg(F.count("*").alias("new"))
    before = F.coalesce(F.sum("new").over(Window.partitionBy("node_id", "label").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    all_blocks = held.select("node_id", "label", "blk").distinct().join(first, ["node_id", "label", "blk"], "left").fillna({"new": 0})
    open_ = all_blocks.withColumn("before", before).where(F.col("before") < m).select("node_id", "label", "blk")
    chosen = P.documents(used.join(open_, ["node_id", "label", "blk"], "left_semi").join(postings, "term_id"))  # only these are unpacked again
    return ranking.ranked(chosen, ["node_id", "label"], ["term_rank", "doc_id"], "rank").select("node_id", "label", "doc_id", "rank")


def documents_of(cluster: DataFrame, postings: DataFrame) -> DataFrame:
    """Documents of all terms of a cluster, once for each term."""
    return P.documents(cluster.select("node_id", "label", "term_id").join(postings, "term_id")).select("node_id", "label", "doc_id")


def sub_corpora(scoring: DataFrame, training: DataFrame, retrieval: DataFrame, m: int) -> tuple[DataFrame, DataFrame]:
    """Both lists cut to m; if any label is short, all labels of that list are first extended by retrieval."""

    def cut(base: DataFrame) -> DataFrame:
        sizes = base.groupBy("node_id", "label").agg(F.max("rank").alias("n"))
        short = sizes.groupBy("node_id").agg(F.min("n").alias("least")).where(F.col("least") < m).select("node_id")
        return first_m(extended(base, retrieval.join(F.broadcast(short), "node_id", "left_semi")), m)

    return cut(scoring), cut(training)


def sub_corpus_size(n_docs: int, level: int, fan_out: int = 5) -> int:
    return int(n_docs / (fan_out * (level + 1)))


def by_importance(ranked_terms: DataFrame, postings: DataFrame, k: int = 200) -> DataFrame:
    """Distinct documents of the ``k`` most central terms of each label (node_id, label, term_id, rank)."""
    cluster = ranked_terms.where(F.col("rank") <= k).select("node_id", "label", "term_id")
    if dict(postings.dtypes)["docs"] != "binary":
        return documents_of(cluster, postings).distinct()
    return P.documents(P.union(cluster.join(postings, "term_id"), ["node_id", "label"]))

