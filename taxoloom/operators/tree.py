"""Taxonomy trees as edges (parent, child, child_ord) and node terms (node_id, rank, term_id, term, score)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _level_loop(start: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """Nodes reached from ``start`` (column node) over edges, level by level; trees are shallow."""
    seen, level = start, start
    for _ in range(depth):
        level = edges.join(level.withColumnRenamed("node", "parent"), "parent", "left_semi").select(F.col("child").alias("node"))
        seen = seen.union(level)
    return seen.distinct()


def reachable(edges: DataFrame, root: int, depth: int = 3, expanded: DataFrame | None = None) -> DataFrame:
    """Nodes that a walk from the root visits; with ``expanded`` only such nodes are entered."""
    spark = edges.sparkSession
    start = spark.range(1).select(F.lit(root).cast("long").alias("node"))
    usable = edges if expanded is None else edges.join(expanded, edges["child"] == expanded["node_id"], "left_semi")
    return _level_loop(start, usable, depth)


def without_empty_children(edges: DataFrame, terms: DataFrame, root: int, depth: int = 3) -> DataFrame:
    """Edges under the root whose child has terms, as far as the walk over such edges comes."""
    filled = terms.select(F.col("node_id").alias("child")).distinct()
    kept = edges.join(filled, "child", "left_semi").select("parent", "child", "child_ord")
    return kept.join(_level_loop(edges.sparkSession.range(1).select(F.lit(root).cast("long").alias("parent")).toDF("node"), kept, depth).withColumnRenamed("node", "parent"), "parent", "left_semi").select("parent", "child", "child_ord")


def complete_parents(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Parents all of whose children are nodes of the tree."""
    known = nodes.select(F.col("node_id").alias("child"), F.lit(1).alias("ok")).distinct()
    return edges.join(known, "child", "left").groupBy("parent").agg(F.count("ok").alias("have"), F.count("*").alias("all")).where("have = all").select("parent")


def visited_parents(edges: DataFrame, nodes: DataFrame, root: int, depth: int = 3) -> DataFrame:
    """Parents whose relations are emitted: reached through parents that are complete themselves."""
    whole = edges.join(complete_parents(edges, nodes), "parent", "left_semi")
    seen = _level_loop(edges.sparkSession.range(1).select(F.lit(root).cast("long").alias("node")), whole, depth)
    return complete_parents(edges, nodes).join(seen.withColumnRenamed("node", "parent"), "parent", "left_semi")


def relations(edges: DataFrame, terms: DataFrame, root: int, top_n: int, depth: int = 3) -> DataFrame:
    """All terms of each visited parent with the first ``top_n`` terms of its children."""
    use = edges.join(visited_parents(edges, terms, root, depth), "parent", "left_semi")
    a = terms.select(F.col("node_id").alias("parent"), F.col("term_id").alias("hyper_id"), F.col("term").alias("hyper"), F.col("score").alias("hyper_score"))
    b = terms.where(F.col("rank") <= top_n).select(F.col("node_id").alias("child"), F.col("term_id").alias("hypo_id"), F.col("term").alias("hypo"), F.col("score").alias("hypo_score"))
    return use.join(a, "parent").join(b, "child").select("parent", "child", "hyper_id", "hyper", "hyper_score", "hypo_id", "hypo", "hypo_score")


def joined_terms(terms: DataFrame) -> DataFrame:
    w = F.array_sort(F.collect_list(F.struct("rank", "term")))
    return terms.groupBy("node_id").agg(F.array_join(F.transform(w, lambda x: x["term"]), ", ").alias("terms"))


def topic_relations(edges: DataFrame, terms: DataFrame, root: int, depth: int = 3) -> DataFrame:
    """Joined terms of each visited parent but the root with the joined terms of each child."""
    use = edges.join(visited_parents(edges, terms, root, depth), "parent", "left_semi").where(F.col("parent") != root)
    j = joined_terms(terms)
    a, b = j.select(F.col("node_id").alias("parent"), F.col("terms").alias("hyper_terms")), j.select(F.col("node_id").alias("child"), F.col("terms").alias("hypo_terms"))
    return use.join(a, "parent").join(b, "child").where("hyper_terms <> '' and hypo_terms <> ''").select("parent", "child", "hyper_terms", "hypo_terms")


def rows(edges: DataFrame, terms: DataFrame) -> DataFrame:
    """node_id and its line: id, children (or None), then id|term|score of its terms."""
    kids = edges.groupBy(F.col("parent").alias("node_id")).agg(F.array_sort(F.collect_list(F.struct("child_ord", "child"))).alias("k"))
    kids = kids.select("node_id", F.array_join(F.transform("k", lambda x: x["child"].cast("string")), ",").alias("kids"))
    cell = F.format_string("%d|%s|%.3f", F.col("term_id"), F.col("term"), F.col("score"))
    own = terms.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("rank", cell.alias("cell")))).alias("t"))
    own = own.select("node_id", F.array_join(F.transform("t", lambda x: x["cell"]), ",").alias("cells"))
    both = kids.join(own, "node_id", "full")
    return both.select("node_id", F.concat_ws(",", F.col("node_id").cast("string"), F.coalesce("kids", F.lit("None")), "cells").alias("line"))


def child_ids(clusters: DataFrame, first: int) -> DataFrame:
    """Breadth-first ids for the labels of a level's nodes: (node_id, label, child)."""
    order = Window.orderBy("node_id", "label")  # one row a cluster of a level
    return clusters.select("node_id", "label").distinct().withColumn("child", (F.row_number().over(order) - 1 + first).cast("long"))


def dot(edges: DataFrame, terms: DataFrame) -> DataFrame:
    """Lines of a DOT graph: nodes named by their three best terms, then edges."""
    named = joined_terms(terms.where("rank <= 3"))
    nodes = named.select(F.format_string('  n%d [label="%s"];', F.col("node_id"), F.col("terms")).alias("line"))
    return nodes.union(edges.select(F.format_string("  n%d -> n%d;", F.col("parent"), F.col("child")).alias("line")))
