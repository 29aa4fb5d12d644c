"""Queries over trees, labels and evaluation.

The tree is world (0), regions (1 to 5), nations (10 and up): a nation's terms are its market segments with
the balance of its customers as score; a region's terms are the part brands of the first suppliers' nations.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluation, frequencies, labeling, postings, tree
from ..sources import scratch
from .registry import query, table
from .score_queries import occurrences

TREE = """
edges AS (SELECT 0::BIGINT AS parent, (r_regionkey + 1)::BIGINT AS child, r_regionkey::INT AS child_ord FROM region
          UNION ALL SELECT n_regionkey + 1, n_nationkey + 10, n_nationkey::INT FROM nation),
g AS (SELECT c_nationkey + 10 AS node_id, c_mktsegment AS term, round(avg(c_acctbal), 3) AS score FROM customer GROUP BY ALL
      UNION ALL SELECT n_regionkey + 1, c_mktsegment, round(avg(c_acctbal), 3) FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL
      UNION ALL SELECT 0, c_mktsegment, round(avg(c_acctbal), 3) FROM customer GROUP BY ALL),
terms AS (SELECT node_id::BIGINT AS node_id, row_number() OVER (PARTITION BY node_id ORDER BY score DESC, term)::INT AS rank, ascii(term)::BIGINT AS term_id, term, score FROM g)
"""


def edges(spark, sf):
    r, n = table(spark, sf, "region"), table(spark, sf, "nation")
    top = r.select(F.lit(0).cast("long").alias("parent"), (F.col("r_regionkey") + 1).cast("long").alias("child"), F.col("r_regionkey").cast("int").alias("child_ord"))
    return top.union(n.select((F.col("n_regionkey") + 1).cast("long"), (F.col("n_nationkey") + 10).cast("long"), F.col("n_nationkey").cast("int")))


def terms(spark, sf):
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    by = lambda rows, key: rows.groupBy(key.cast("long").alias("node_id"), F.col("c_mktsegment").alias("term")).agg(F.round(F.avg("c_acctbal"), 3).alias("score"))
    g = by(c, F.col("c_nationkey") + 10).union(by(c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey), F.col("n_regionkey") + 1)).union(by(c, F.lit(0)))
    w = Window.partitionBy("node_id").orderBy(F.desc("score"), "term")
    return g.select("node_id", F.row_number().over(w).alias("rank"), F.ascii("term").cast("long").alias("term_id"), "term", "score")


@query(
    "taxonomy_rows",
    f"""WITH {TREE}, k AS (SELECT parent AS node_id, string_agg(child::VARCHAR, ',' ORDER BY child_ord, child) AS kids FROM edges GROUP BY parent),
    c AS (SELECT node_id, string_agg(format('{{}}|{{}}|{{:.3f}}', term_id, term, score), ',' ORDER BY rank) AS cells FROM terms GROUP BY node_id)
    SELECT node_id, concat_ws(',', node_id::VARCHAR, coalesce(kids, 'None'), cells) AS line FROM k FULL JOIN c USING (node_id)""",
)
def taxonomy_rows(spark, sf):
    return tree.rows(edges(spark, sf), terms(spark, sf))


@query(
    "prune_empty_children",
    f"""WITH RECURSIVE {TREE}, rich AS (SELECT DISTINCT node_id FROM terms WHERE score > 4500), ok AS (SELECT * FROM edges WHERE child IN (SELECT node_id FROM rich)),
    seen AS (SELECT 0::BIGINT AS node UNION SELECT child FROM ok JOIN seen ON parent = node) SELECT parent, child, child_ord FROM ok WHERE parent IN (SELECT node FROM seen)""",
)
def prune_empty_children(spark, sf):
    return tree.without_empty_children(edges(spark, sf), terms(spark, sf).where("score > 4500"), 0)


@query("reachable_nodes", f"WITH RECURSIVE {TREE}, seen AS (SELECT 0::BIGINT AS node UNION SELECT child FROM edges JOIN seen ON parent = node) SELECT node FROM seen")
def reachable_nodes(spark, sf):
    return tree.reachable(edges(spark, sf), 0)


WHOLE = (
    TREE
    + """, nodes AS (SELECT DISTINCT node_id FROM terms), whole AS (SELECT parent FROM edges LEFT JOIN nodes ON node_id = child GROUP BY parent HAVING count(node_id) = count(*)),
seen AS (SELECT 0::BIGINT AS node UNION SELECT child FROM edges JOIN whole USING (parent) JOIN seen ON edges.parent = node), vp AS (SELECT parent FROM whole WHERE parent IN (SELECT node FROM seen))
"""
)


def _relations(n):
    return f"""WITH RECURSIVE {WHOLE} SELECT e.parent, e.child, a.term AS hyper, round(a.score, 3) AS hyper_score, b.term AS hypo, round(b.score, 3) AS hypo_score
    FROM edges e JOIN vp USING (parent) JOIN terms a ON a.node_id = e.parent JOIN terms b ON b.node_id = e.child AND b.rank <= {n}"""


@query("hyp_relations", _relations(1))
def hyp_relations(spark, sf):
    return tree.relations(edges(spark, sf), terms(spark, sf), 0, 1).drop("hyper_id", "hypo_id")


@query("subtopic_relations", _relations(3))
def subtopic_relations(spark, sf):
    return tree.relations(edges(spark, sf), terms(spark, sf), 0, 3).drop("hyper_id", "hypo_id")


@query(
    "topic_level_relations",
    f"""WITH RECURSIVE {WHOLE}, j AS (SELECT node_id, string_agg(term, ', ' ORDER BY rank) AS terms FROM terms GROUP BY node_id)
    SELECT e.parent, e.child, a.terms AS hyper_terms, b.terms AS hypo_terms FROM edges e JOIN vp USING (parent) JOIN j a ON a.node_id = e.parent JOIN j b ON b.node_id = e.child WHERE e.parent <> 0""",
)
def topic_level_relations(spark, sf):
    return tree.topic_relations(edges(spark, sf), terms(spark, sf), 0)


@query(
    "tree_drawing",
    f"""WITH {TREE} SELECT format('  n{{}} [label="{{}}"];', node_id, string_agg(term, ', ' ORDER BY rank)) AS line FROM terms WHERE rank <= 3 GROUP BY node_id UNION ALL SELECT format('  n{{}} -> n{{}};', parent, child) FROM edges""",
)
def tree_drawing(spark, sf):
    return tree.dot(edges(spark, sf), terms(spark, sf))


@query("child_ids", f"WITH {TREE} SELECT node_id, term_id AS label, (row_number() OVER (ORDER BY node_id, term_id) + 99)::BIGINT AS child FROM (SELECT DISTINCT node_id, term_id FROM terms)")
def child_ids(spark, sf):
    return tree.child_ids(terms(spark, sf).select("node_id", F.col("term_id").alias("label")), 100)


POST = "tf AS (SELECT DISTINCT l_partkey AS term_id, l_orderkey AS doc_id FROM lineitem), par AS (SELECT node_id, term_id FROM (SELECT (term_id % 5)::BIGINT AS node_id, term_id, row_number() OVER (PARTITION BY term_id % 5 ORDER BY count(*) DESC, term_id) AS k FROM tf GROUP BY term_id) WHERE k <= 10), own AS (SELECT DISTINCT (term_id % 5)::BIGINT AS node_id, term_id FROM tf)"
INCL = POST + ", pd AS (SELECT DISTINCT node_id, doc_id FROM par JOIN tf USING (term_id)), incl AS (SELECT o.node_id, o.term_id, count(p.doc_id) / (count(*) + 1) AS incl FROM own o JOIN tf USING (term_id) LEFT JOIN pd p ON p.node_id = o.node_id AND p.doc_id = tf.doc_id GROUP BY ALL)"


def included(spark, sf):
    tf = scratch.written(frequencies.term_frequency(occurrences(spark, sf)))  # read more than once
    own = tf.select("term_id").distinct().select((F.col("term_id") % 5).cast("long").alias("node_id"), "term_id")
    # the ten terms of most documents of each node stand for its parent's labels
    often = frequencies.document_frequency(tf).select((F.col("term_id") % 5).cast("long").alias("node_id"), "term_id", F.col("df").alias("score"))
    return labeling.inclusion(postings.stored(tf), labeling.top_labels(often).select("node_id", "term_id"), own)


@query("inclusion_score", f"WITH {INCL} SELECT node_id, term_id, round(incl, 6) AS incl FROM incl")
def inclusion_score(spark, sf):
    return included(spark, sf).withColumn("incl", F.round("incl", 6))


_FACTORS = {"ls": (1, 1, 1), "no_cos": (0, 1, 1), "no_hypo": (1, 0, 1), "no_incl": (1, 1, 0), "only_hypo": (0, 1, 0), "only_incl": (0, 0, 1)}


def _label_sql(name):
    c, h, i = _FACTORS[name]
    return f"round(sqrt({'incl' if i else '1'} * {'(1 / (1 + term_id))' if h else '1'} * {'((sin(term_id) + 1) / 2)' if c else '1'}), 6) AS {name}"


@query("label_score", f"WITH {INCL} SELECT node_id, term_id, {', '.join(map(_label_sql, _FACTORS))} FROM incl")
def label_score(spark, sf):
    # sin(id) stands for a cosine and 1 / (1 + id) for a probability.
    cos, hypo = F.sin(F.col("term_id").cast("double")), 1.0 / (1 + F.col("term_id"))
    score = lambda n: F.round(labeling.label_score(hypo, F.col("incl"), cos, labeling.VARIANTS[n]), 6).alias(n)
    return included(spark, sf).select("node_id", "term_id", *(score(n) for n in _FACTORS))


@query("top_k_labels", f"WITH {INCL} SELECT node_id, term_id, rank FROM (SELECT node_id, term_id, row_number() OVER (PARTITION BY node_id ORDER BY round(incl, 6) DESC, term_id)::INT AS rank FROM incl) WHERE rank <= 10")
def top_k_labels(spark, sf):
    return labeling.top_labels(included(spark, sf).select("node_id", "term_id", F.round("incl", 6).alias("score"))).select("node_id", "term_id", "rank")


@query("label_tree_repr", f"WITH {TREE} SELECT node_id, term_id, score, rank FROM (SELECT node_id, term_id, score, row_number() OVER (PARTITION BY node_id ORDER BY score DESC, term_id)::INT AS rank FROM terms) WHERE rank <= 3")
def label_tree_repr(spark, sf):
    base = terms(spark, sf).select("node_id", "term_id", F.col("score").alias("repr"), F.lit(0.0).alias("cos"))
    post = spark.createDataFrame([], "term_id long, docs array<long>, df long")
    return labeling.label_tree(edges(spark, sf), base, post, labeling.VARIANTS["repr"], 0, 2, k=3).select("node_id", "term_id", "score", "rank")


def _variant_sql(name: str) -> str:
    v = labeling.VARIANTS[name]
    plain = "cos" if v.cos else "repr"
    factors = " * ".join(f for on, f in ((v.hypo, "hypo"), (v.incl, "incl"), (v.cos, "(cos + 1) / 2")) if on) or "1"
    full = f"CASE WHEN depth > 1 THEN sqrt({factors}) ELSE {plain} END" if v.label_score else plain
    return f"""b_{name} AS (SELECT b.*, 1.0 / (1 + b.term_id) AS hypo FROM vb b),
    l0_{name} AS (SELECT * FROM (SELECT node_id, term_id, round({plain}, 9) AS score, row_number() OVER (PARTITION BY node_id ORDER BY round({plain}, 9) DESC, term_id)::INT AS rank FROM b_{name} WHERE depth < 2) WHERE rank <= 3),
    pt_{name} AS (SELECT DISTINCT e.child AS node_id, doc_id FROM edges e JOIN l0_{name} l ON l.node_id = e.parent JOIN vp p ON p.term_id = l.term_id),
    in_{name} AS (SELECT b.node_id, b.term_id, count(t.doc_id) / (count(*) + 1) AS incl FROM b_{name} b JOIN vp p USING (term_id) LEFT JOIN pt_{name} t ON t.node_id = b.node_id AND t.doc_id = p.doc_id GROUP BY ALL),
    l2_{name} AS (SELECT * FROM (SELECT node_id, term_id, s AS score, row_number() OVER (PARTITION BY node_id ORDER BY s DESC, term_id)::INT AS rank FROM (SELECT b.node_id, b.term_id, round({full}, 9) AS s FROM b_{name} b LEFT JOIN in_{name} i USING (node_id, term_id) WHERE depth = 2)) WHERE rank <= 3)"""


_VARIANTS = ", ".join(map(_variant_sql, labeling.VARIANTS))
_ALL = " UNION ALL ".join(f"SELECT '{n}' AS variant, * FROM l{d}_{n}" for n in labeling.VARIANTS for d in (0, 2))


@query(
    "label_tree_variants",
    f"""WITH {TREE}, vb AS (SELECT node_id, term_id, score AS repr, sin(node_id + term_id) AS cos, CASE WHEN node_id = 0 THEN 0 WHEN node_id < 10 THEN 1 ELSE 2 END AS depth FROM terms),
    vp AS (SELECT DISTINCT ascii(c_mktsegment)::BIGINT AS term_id, o_orderdate AS doc_id FROM orders JOIN customer ON o_custkey = c_custkey), {_VARIANTS} SELECT variant, node_id, term_id, round(score, 6) AS score, rank FROM ({_ALL})""",
)
def label_tree_variants(spark, sf):
    """All eight variants over the whole tree; sin(node + term) stands for a cosine, 1 / (1 + term) for a probability."""
    base = terms(spark, sf).select("node_id", "term_id", F.col("score").alias("repr"), F.sin((F.col("node_id") + F.col("term_id")).cast("double")).alias("cos"))
    hypo = base.select("node_id", "term_id", (1.0 / (1 + F.col("term_id"))).alias("hypo"))
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    tf = o.join(c, o.o_custkey == c.c_custkey).select(F.ascii("c_mktsegment").cast("long").alias("term_id"), F.unix_date(F.col("o_orderdate").cast("date")).cast("long").alias("doc_id")).distinct()
    post, out = postings.stored(tf), None
    for name, variant in labeling.VARIANTS.items():
        got = labeling.label_tree(edges(spark, sf), base, post, variant, 0, 2, hypo, k=3).select(F.lit(name).alias("variant"), "node_id", "term_id", F.round("score", 6).alias("score"), "rank")
        out = got if out is None else out.union(got)
    return out


@query("relation_precision", "SELECT count(*) AS n, sum(toxic)::BIGINT AS n_true, round(avg(toxic), 6) AS precision FROM labels WHERE toxic IS NOT NULL")
def relation_precision(spark, sf):
    return evaluation.precision(table(spark, sf, "labels").select(F.col("toxic").alias("label"))).withColumn("precision", F.round("precision", 6))


@query(
    "gold_overlap",
    "WITH l AS (SELECT DISTINCT word AS term FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS word FROM part)), g AS (SELECT DISTINCT word AS term FROM (SELECT unnest(string_split(lower(p_type), ' ')) AS word FROM part)) SELECT (SELECT count(*) FROM (SELECT * FROM l INTERSECT SELECT * FROM g)) AS n_hits, (SELECT count(*) FROM g) AS n_gold, round((SELECT count(*) FROM (SELECT * FROM l INTERSECT SELECT * FROM g)) / (SELECT count(*) FROM g), 6) AS share",
)
def gold_overlap(spark, sf):
    word = lambda c: table(spark, sf, "part").select(F.explode(F.split(F.lower(c), " ")).alias("term"))
    return evaluation.overlap(word("p_name"), word("p_type")).withColumn("share", F.round("share", 6))


@query("prev_label_merge", "SELECT hyper, hypo, arg_max(label, version) AS label FROM (SELECT lang AS hyper, source AS hypo, toxic AS label, doc_id AS version FROM documents JOIN labels USING (doc_id)) GROUP BY ALL")
def prev_label_merge(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(F.col("lang").alias("hyper"), F.col("source").alias("hypo"), F.col("toxic").alias("label"), F.col("doc_id").alias("version"))
    return evaluation.merge_labels(rows.where("version % 2 = 0"), rows.where("version % 2 = 1"))


@query(
    "prev_label_fill",
    """WITH p AS (SELECT hyper, hypo, arg_max(label, version) AS label FROM (SELECT lang AS hyper, source AS hypo, quality AS label, doc_id AS version FROM documents JOIN labels USING (doc_id)) GROUP BY ALL)
    SELECT r.hyper, r.hypo, label FROM (SELECT DISTINCT source AS hypo, lang AS hyper FROM documents UNION ALL SELECT 'none', 'xx') r LEFT JOIN p ON p.hyper = r.hyper AND p.hypo = r.hypo""",
)
def prev_label_fill(spark, sf):
    docs = table(spark, sf, "documents")
    rows = docs.join(table(spark, sf, "labels"), "doc_id").select(F.col("lang").alias("hyper"), F.col("source").alias("hypo"), F.col("quality").alias("label"), F.col("doc_id").alias("version"))
    wanted = docs.select(F.col("lang").alias("hyper"), F.col("source").alias("hypo")).distinct().union(spark.range(1).select(F.lit("xx"), F.lit("none")))
    return evaluation.prefill(wanted, evaluation.merge_labels(rows, rows.limit(0))).select("hyper", "hypo", "label")


@query("random_eval_sample", f"SELECT hyper, hypo FROM ({_relations(3)}) ORDER BY md5('13' || chr(9) || coalesce(hyper, '') || chr(9) || coalesce(hypo, '')), hyper, hypo LIMIT 100")
def random_eval_sample(spark, sf):
    return evaluation.sample(tree.relations(edges(spark, sf), terms(spark, sf), 0, 3).select("hyper", "hypo"), 100)
