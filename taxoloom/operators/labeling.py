"""Label choice: inclusion and label scores, top terms of each node, and the eight variants."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import postings as P


@dataclass(frozen=True)
class LabelVariant:
    cos: bool
    label_score: bool
    hypo: bool
    incl: bool


#: Name and flags of each variant (fixed values).
VARIANTS = {
    "repr": LabelVariant(False, False, False, False),
    "sim": LabelVariant(True, False, False, False),
    "ls": LabelVariant(True, True, True, True),
    "no_cos": LabelVariant(False, True, True, True),
    "no_hypo": LabelVariant(True, True, False, True),
    "no_incl": LabelVariant(True, True, True, False),
    "only_hypo": LabelVariant(False, True, True, False),
    "only_incl": LabelVariant(False, True, False, True),
}


def inclusion(postings: DataFrame, parent_terms: DataFrame, terms: DataFrame) -> DataFrame:
    """Share of a term's documents that hold a parent term: n / (df + 1).

    ``parent_terms``: node_id, term_id of the node's parent's labels; ``terms``: node_id, term_id to score.
    """
    if dict(postings.dtypes)["docs"] == "binary":  # in blocks
        above = P.union(parent_terms.select("node_id", "term_id").join(postings, "term_id"), ["node_id"])
        met = P.overlap(terms.select("node_id", "term_id").join(postings, "term_id"), above, ["node_id"])
        return met.groupBy("node_id", "term_id").agg((F.sum("both") / (F.sum("n") + 1)).alias("incl"))
    flat = P.documents(postings)
    parents = parent_terms.join(flat, "term_id").select("node_id", "doc_id", F.lit(1).alias("hit")).distinct()
    own = terms.join(flat, "term_id")
    return own.join(parents, ["node_id", "doc_id"], "left").groupBy("node_id", "term_id").agg((F.count("hit") / (F.count("*") + 1)).alias("incl"))


def label_score(hypo: Column, incl: Column, cos: Column, variant: LabelVariant) -> Column:
    """sqrt of the product of the factors in use; one that is off, or null, counts as 1."""
    one = F.lit(1.0)
    factor = lambda on, value: F.coalesce(value, one) if on else one
    return F.sqrt(factor(variant.hypo, hypo) * factor(variant.incl, incl) * factor(variant.cos, (cos + 1) / 2))


def top_labels(scores: DataFrame, k: int = 10) -> DataFrame:
    order = Window.partitionBy("node_id").orderBy(F.desc("score"), "term_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def label_tree(edges: DataFrame, base: DataFrame, postings: DataFrame, variant: LabelVariant, root: int, depth: int, hypo: DataFrame | None = None, k: int = 10) -> DataFrame:
    """Top labels of every expanded node, level by level: a level's labels are its children's parent terms.

    ``base``: node_id, term_id, repr, cos of the candidates; ``hypo``: node_id, term_id, hypo.
    """
    spark = edges.sparkSession
    level = spark.range(1).select(F.lit(root).cast("long").alias("node_id"))
    parents: DataFrame | None = None
    out: DataFrame | None = None
    for at in range(depth + 1):
        rows = base.join(level, "node_id", "left_semi")
        score = F.col("cos") if variant.cos else F.col("repr")
        if variant.label_score and at > 1 and parents is not None:
            rows = rows.join(inclusion(postings, parents, rows.select("node_id", "term_id")), ["node_id", "term_id"], "left")
            rows = rows.join(hypo, ["node_id", "term_id"], "left") if hypo is not None else rows.withColumn("hypo", F.lit(None).cast("double"))
            score = label_score(F.col("hypo"), F.col("incl"), F.col("cos"), variant)
        best = top_labels(rows.select("node_id", "term_id", F.round(score, 9).alias("score")), k)
        out = best if out is None else out.union(best)
        step = edges.join(level, edges["parent"] == level["node_id"]).select("parent", "child")
        parents = step.join(best, step["parent"] == best["node_id"]).select(F.col("child").alias("node_id"), "term_id")
        level = step.select(F.col("child").alias("node_id"))
    return out
