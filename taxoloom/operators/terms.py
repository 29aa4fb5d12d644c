"""Term candidates: frequencies, sub-sequences, containment, C-value and the final term filter."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import glue, sub_lists
from ..sources.scratch import written


def candidates(rows: DataFrame, column: str) -> DataFrame:
    """term (words glued), freq and length."""
    words = F.split(F.lower(F.col(column)), " ")
    counted = rows.groupBy(glue(words).alias("term")).agg(F.count("*").alias("freq"))
    return counted.withColumn("length", F.size(F.split("term", "_")))


def sub_sequences(cands: DataFrame) -> DataFrame:
    """term and each proper contiguous sub-sequence (as often as it occurs in the term)."""
    return cands.select("term", F.explode(sub_lists(F.split("term", "_"))).alias("s")).select("term", glue(F.col("s")).alias("sub"))


def containment(terms: DataFrame) -> DataFrame:
    """Pairs of terms of which the second is part of the first, by an equi-join on generated parts."""
    known = terms.select(F.col("term").alias("sub")).distinct()
    return sub_sequences(terms.select("term").distinct()).distinct().join(known, "sub").select("term", "sub")


def c_values(cands: DataFrame, threshold: float = 2.0, corrected: bool = False) -> DataFrame:
    """term and cval of the terms above the threshold.

    Lengths go from long to short; each accepted term adds its frequency to its sub-sequences' t and one to
    their c. As in the original formula ``log2(length) * f - t / c``, and sub-sequences of the longest terms
    keep only the last one's frequency; with ``corrected`` ``log2(length) * (f - t / c)`` and sums throughout.
    Here the last one is the greatest by name. Each length is written, so the plan of one doesn't hold the longer ones'.
    """
    lengths = [r[0] for r in cands.select("length").distinct().orderBy(F.desc("length")).collect()]
    within: DataFrame | None = None  # sub, t, c of all longer terms
    accepted: list[DataFrame] = []
    for n in lengths:
        level = cands.where(F.col("length") == n)
        log = F.log2(F.col("length").cast("double"))
        if within is None:
            scored = level.withColumn("cval", log * F.col("freq"))
        else:
            share = F.col("t") / F.col("c")
            value = log * (F.col("freq") - share) if corrected else log * F.col("freq") - share
            scored = level.join(within.withColumnRenamed("sub", "term"), "term", "left").withColumn("cval", F.when(F.col("c").isNull(), log * F.col("freq")).otherwise(value))
        kept = written(scored.where(F.col("cval") > threshold).select("term", "freq", "length", "cval"), "c-values")
        accepted.append(kept.select("term", "cval"))
        parts = sub_sequences(kept).join(kept.select("term", "freq"), "term")
        if within is None and not corrected:
            parts = parts.groupBy("sub").agg(F.max_by("freq", "term").alias("t")).withColumn("c", F.lit(1))
        else:
            parts = parts.select("sub", F.col("freq").alias("t"), F.lit(1).alias("c"))
        if n > 1:
            within = written((parts if within is None else within.union(parts)).groupBy("sub").agg(F.sum("t").alias("t"), F.sum("c").alias("c")), "c-values")
    return reduce(DataFrame.union, accepted) if accepted else cands.select("term", F.lit(0.0).alias("cval")).limit(0)


def select_terms(cvals: DataFrame, best_tfidf: DataFrame) -> DataFrame:
    """Terms with cval > 8, or best tf-idf > 17, or cval > 6 and best tf-idf > 11."""
    both = cvals.join(best_tfidf, "term", "full")
    c, t = F.coalesce("cval", F.lit(0.0)), F.coalesce("tfidf", F.lit(0.0))
    return both.where((c > 8) | (t > 17) | ((t > 11) & (c > 6))).select("term").distinct()
