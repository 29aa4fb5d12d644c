"""Places of rows among those of equal keys where few keys may hold most rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import written

_ROW_BITS = 33  # of monotonically_increasing_id: the row's number within its partition


def _same(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda a, b: a & b, (left[x].eqNullSafe(right[y]) for x, y in pairs))


def by_ranges(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The rows in ranges of (keys, order), sorted within; a key with many rows lies in several ranges."""
    sort = [F.col(k) for k in keys] + [F.col(c) if isinstance(c, str) else c for c in order]
    return df.repartitionByRange(*sort).sortWithinPartitions(*sort)


def ranked(df: DataFrame, keys: list[str], order: list[str | Column], name: str = "place") -> DataFrame:
    """``df`` with each row's place, from 1, among the rows of equal ``keys`` in ``order``.

    Equal to ``row_number`` over the keys, but no key meets in one task: rows are dealt by ranges of (keys, order),
    counted a range, and a row's place is its number in its range after the counts of the key's earlier ranges. The
    ranges are written once, as two passes over them must see the same rows. Null keys are a key of their own; rows
    that tie in keys and order get any of their places; an empty table stays empty. ``keys`` may be empty (one rank
    over all rows). The counts hold one row for each key and range that meet, so with few keys Spark broadcasts them.
    """
    clash = {name, "_at"} & set(df.columns)
    if clash:
        raise ValueError(f"column {sorted(clash)} is there already")
    dealt = written(by_ranges(df, keys, order).withColumn("_at", F.monotonically_increasing_id()), "ranges").withColumn("_range", F.shiftright("_at", _ROW_BITS))
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    counts = dealt.groupBy(F.col("_range").alias("_r"), *named).agg(F.min("_at").alias("_least"), F.count("*").alias("_n"))
    ranges = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))]).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(ranges), F.lit(0)))
    pairs = [("_range", "_r"), *((k, f"_k{i}") for i, k in enumerate(keys))]
    out = dealt.join(counts, _same(dealt, counts, pairs))
    return out.select(*df.columns, (F.col("_at") - F.col("_least") + F.col("_before") + 1).alias(name))


def top(df: DataFrame, keys: list[str], order: list[str | Column], m: int | Column | str, name: str = "place") -> DataFrame:
    """The first ``m`` rows a key, with their places; ``m`` is a number or a column of ``df``."""
    return ranked(df, keys, order, name).where(F.col(name) <= (m if isinstance(m, (Column, int)) else F.col(m)))
