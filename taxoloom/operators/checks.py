"""Consistency checks: each gives one row (check, violations)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _row(name: str, violations: DataFrame) -> DataFrame:
    return violations.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")


def dense_ids(vocab: DataFrame) -> DataFrame:
    """Ids run from 0 without gaps or repeats."""
    stats = vocab.agg(F.count("*").alias("n"), F.countDistinct("term_id").alias("ids"), F.min("term_id").alias("low"), F.max("term_id").alias("high"))
    return _row("dense_ids", stats.where("n > 0 and (ids <> n or low <> 0 or high <> n - 1)"))


def known(relations: DataFrame, terms: DataFrame) -> DataFrame:
    """Both sides of every relation are terms."""
    sides = relations.select(F.col("hyper").alias("term")).union(relations.select(F.col("hypo").alias("term"))).distinct()
    return _row("terms_known", sides.join(terms.select("term"), "term", "left_anti"))


def same_keys(a: DataFrame, b: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Two tables hold the same keys as often; they are met once, and stay where they are if dealt alike by some of the keys."""
    rows = a.select(*keys, F.lit(1).alias("_n")).union(b.select(*keys, F.lit(-1)))
    more = rows.groupBy(*keys).agg(F.abs(F.sum("_n")).alias("_n")).where("_n > 0")
    return more.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("violations")).select(F.lit(name).alias("check"), "violations")


def same_shape(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two corpora have the same number of sentences in each document."""
    count = lambda c: c.groupBy("doc_id").agg(F.countDistinct("sent_id").alias("n"))
    x, y = count(a), count(b)
    return _row("same_shape", x.exceptAll(y).union(y.exceptAll(x)))


def non_empty(docs: DataFrame, corpus: DataFrame) -> DataFrame:
    """Every document holds words."""
    return _row("non_empty", docs.select("doc_id").distinct().join(corpus.select("doc_id"), "doc_id", "left_anti"))


def embedded(terms: DataFrame, term_emb: DataFrame) -> DataFrame:
    """Every term has a vector."""
    return _row("embedded", terms.select("term_id").join(term_emb.select("term_id"), "term_id", "left_anti"))
