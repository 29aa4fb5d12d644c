"""Evaluation: labels carried over, precision of relations, overlap with a gold taxonomy, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def prefill(relations: DataFrame, previous: DataFrame) -> DataFrame:
    """Relations with the label that an earlier evaluation gave the pair, else null."""
    return relations.join(previous.select("hyper", "hypo", "label"), ["hyper", "hypo"], "left")


def merge_labels(old: DataFrame, new: DataFrame) -> DataFrame:
    """One label for each pair: the newest version wins; columns hyper, hypo, label, version."""
    return old.unionByName(new).groupBy("hyper", "hypo").agg(F.max_by("label", "version").alias("label"))


def precision(labelled: DataFrame) -> DataFrame:
    known = labelled.where("label is not null")
    return known.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("n_true"), F.try_divide(F.sum("label").cast("double"), F.count("*").cast("double")).alias("precision"))


def overlap(labels: DataFrame, gold: DataFrame) -> DataFrame:
    """Distinct labels that are gold terms, over the number of gold terms; one column ``term`` each."""
    hits = labels.select("term").intersect(gold.select("term")).agg(F.count("*").alias("n_hits"))
    size = gold.select("term").distinct().agg(F.count("*").alias("n_gold"))
    return hits.crossJoin(size).withColumn("share", F.try_divide(F.col("n_hits").cast("double"), F.col("n_gold").cast("double")))


def sample(relations: DataFrame, n: int = 100, seed: int = 13) -> DataFrame:
    """n relations without replacement, the same for one seed at any partitioning: those of the least MD5 of seed and row."""
    row = F.concat_ws("\t", F.lit(str(seed)), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in relations.columns))
    return relations.orderBy(F.md5(row.cast("binary")), *relations.columns).limit(n)
