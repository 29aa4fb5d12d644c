"""Popularity, concentration and divergence of terms over the sub-corpora of a node's clusters.

All tables carry ``node_id``, so every node of a tree level is scored by one plan. ``cells`` is dense: each
term has a row for each label of its node.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B, WEIGHT = 1.2, 0.5, 3


def by_term():
    return Window.partitionBy("node_id", "term_id")


@dataclass(frozen=True)
class Variant:
    """Which popularity to take and which factors make the total."""

    df_version: bool = True
    no_denominator: bool = True
    df_sum: bool = False
    tf_sum: bool = False
    use_pop: bool = True
    use_con: bool = True

    def name(self) -> str:
        if self.df_version:
            return "df_nodenom" if self.no_denominator else "df_sum" if self.df_sum else "df"
        return "tf_sum" if self.tf_sum else "tf"


def cells(tf: DataFrame, subcorpus: DataFrame, cluster: DataFrame) -> DataFrame:
    """node_id, term_id, own label, label, df and tf within the label's sub-corpus, zero cells included."""
    labels = subcorpus.select("node_id", "label").union(cluster.select("node_id", "label")).distinct()
    dense = cluster.select("node_id", "term_id", F.col("label").alias("own")).join(F.broadcast(labels), "node_id")
    counted = tf.join(subcorpus.select("node_id", "label", "doc_id"), "doc_id").groupBy("node_id", "label", "term_id").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))
    joined = dense.join(counted, ["node_id", "label", "term_id"], "left")
    return joined.select("node_id", "term_id", "own", "label", F.coalesce("df", F.lit(0)).alias("df"), F.coalesce("tf", F.lit(0)).alias("tf"))


def sizes(subcorpus: DataFrame, dl: DataFrame) -> DataFrame:
    """Documents and tokens of each sub-corpus."""
    return subcorpus.join(dl, "doc_id").groupBy("node_id", "label").agg(F.count("*").alias("n_docs"), F.sum("dl").alias("n_tokens"))


def popularity(rows: DataFrame, kind: str, sizes_: DataFrame | None = None) -> DataFrame:
    """``cells`` with a column pop."""
    log_df, log_tf = F.log2(F.col("df") + 1.0), F.log2(F.col("tf") + 1.0)
    if kind == "df_nodenom":
        return rows.withColumn("pop", log_df)
    if kind == "df_sum":
        return rows.withColumn("pop", F.try_divide(log_df, F.sum(log_df).over(by_term())))
    if kind == "tf_sum":
        return rows.withColumn("pop", F.try_divide(log_tf, F.sum(log_tf).over(by_term())))
    if kind not in ("df", "tf"):
        raise ValueError(f"unknown popularity: {kind}")
    with_size = rows.join(F.broadcast(sizes_), ["node_id", "label"], "left")
    value = F.try_divide(log_df, F.col("n_docs").cast("double")) if kind == "df" else F.try_divide(log_tf, F.col("n_tokens").cast("double"))
    return with_size.withColumn("pop", value).drop("n_docs", "n_tokens")


def pseudo_lengths(rows: DataFrame) -> DataFrame:
    """Term occurrences in each label's sub-corpus, and their mean over the node's labels."""
    each = rows.groupBy("node_id", "label").agg(F.sum("tf").alias("len"))
    return each.withColumn("avg_len", F.avg("len").over(Window.partitionBy("node_id")))


def relevance(rows: DataFrame) -> DataFrame:
    """``cells`` with a column bm25."""
    out = rows.join(F.broadcast(pseudo_lengths(rows)), ["node_id", "label"])
    most = F.max("df").over(by_term())
    saturation = F.try_divide(F.col("tf") * (K1 + 1), F.col("tf") + K1 * (1 - B + B * F.try_divide(F.col("len").cast("double"), F.col("avg_len"))))
    spread = F.log2(1.0 + F.col("df")) / F.log2(F.when(most == 0, 2.0).otherwise(1.0) + most)
    return out.withColumn("bm25", F.coalesce(WEIGHT * saturation * spread, F.lit(0.0))).drop("len", "avg_len")


def concentration(rows: DataFrame) -> DataFrame:
    """Rows with bm25 get exp_sum and con."""
    out = rows.withColumn("exp_sum", F.sum(F.exp("bm25")).over(by_term()))
    return out.withColumn("con", F.exp("bm25") / (1 + F.col("exp_sum")))


def total(variant: Variant) -> Column:
    if variant.use_pop and variant.use_con:
        return F.sqrt(F.col("pop") * F.col("con"))
    if variant.use_con:
        return F.sqrt("con")
    if variant.use_pop:
        return F.sqrt("pop")
    raise ValueError("a total needs popularity or concentration")


def normalised(rows: DataFrame) -> DataFrame:
    """Totals as shares of their term's sum; null where the sum is zero."""
    s = F.sum("total").over(by_term())
    return rows.withColumn("l1", F.when(s > 0, F.col("total") / s))


def divergence(rows: DataFrame) -> DataFrame:
    """Per term the Kullback-Leibler divergence of its shares from equal shares; 0 without shares."""
    k = F.count("*").over(by_term())
    part = F.when(F.col("l1") > 0, F.col("l1") * F.ln(F.col("l1") * F.col("k")))
    return rows.withColumn("k", k).groupBy("node_id", "term_id").agg(F.coalesce(F.sum(part), F.lit(0.0)).alias("score"))


def scored(tf: DataFrame, subcorpus: DataFrame, cluster: DataFrame, dl: DataFrame | None = None, variant: Variant | None = None) -> DataFrame:
    """Every cell with pop, bm25, con, total and l1."""
    variant = variant or Variant()
    rows = cells(tf, subcorpus, cluster)
    kind = variant.name()
    rows = popularity(rows, kind, sizes(subcorpus, dl) if kind in ("df", "tf") else None)
    return normalised(concentration(relevance(rows)).withColumn("total", total(variant)))


def own_label(rows: DataFrame) -> DataFrame:
    """The alternative score: each term's total in its own cluster."""
    return rows.where("label = own").select("node_id", "term_id", F.col("total").alias("score"))


def term_scores(rows: DataFrame) -> DataFrame:
    """node_id, term_id, label, and pop, con of the own label with the divergence score."""
    own = rows.where("label = own").select("node_id", "term_id", "label", "pop", "con")
    return own.join(divergence(rows), ["node_id", "term_id"])


def summary(rows: DataFrame, columns=("pop", "con", "score")) -> DataFrame:
    return rows.agg(*(e for c in columns for e in (F.avg(c).alias(f"avg_{c}"), F.median(c).alias(f"median_{c}"))))


def split_general(scores: DataFrame, threshold: float, keep_least: bool = False) -> DataFrame:
    """Each term with ``pushed``: its score is below the threshold.

    With ``keep_least``, of a cluster without pushed terms the lowest is pushed (ties: smallest id).
    """
    below = F.col("score") < threshold
    if keep_least:
        w = Window.partitionBy("node_id", "label")
        none = F.max(below.cast("int")).over(w) == 0
        lowest = F.row_number().over(w.orderBy("score", "term_id")) == 1
        below = below | (none & lowest)
    return scores.withColumn("pushed", below)
