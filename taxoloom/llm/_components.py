"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._run import written


def _large(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    to_least = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return to_least.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """Every node that has a link, with the smallest node of its component: columns node, root.

    ``links`` holds columns a and b of one orderable type, in any order and number. Hot nodes are safe: each
    round aggregates before it shuffles and joins one row per node to its links, which Spark can split. Each
    round is written to the shared folder, so lineage stays short.
    """
    start = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    table = written(start, name)
    mark = None
    for _ in range(most_rounds):
        new = written(_small(_large(table.df)), name)
        got = new.df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        table.drop()
        table = new
        if tuple(got) == mark:
            roots = table.df.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
            return table.df.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
        mark = tuple(got)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
