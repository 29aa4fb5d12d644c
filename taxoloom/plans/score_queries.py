"""Queries of the scoring core over lineitem as a document-term table (document: order, term: part).

A term's cluster is its id modulo five; sub-corpora are the strongest orders of each cluster.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import frequencies, postings, ranking, scoring, subcorpus
from ..sources import scratch
from .registry import query, table

SUB = """
tf AS (SELECT l_orderkey AS doc_id, l_partkey AS term_id, count(*) AS tf FROM lineitem GROUP BY ALL),
dfs AS (SELECT term_id, count(*) AS df FROM tf GROUP BY term_id), nd AS (SELECT count(DISTINCT doc_id) AS n FROM tf),
tfidf AS (SELECT doc_id, term_id, tf, tf * ln(n / df) AS tfidf FROM tf JOIN dfs USING (term_id), nd),
cl AS (SELECT DISTINCT term_id, (term_id % 5)::INT AS label FROM tf), labels AS (SELECT DISTINCT label FROM cl),
st AS (SELECT d.doc_id, l.label, round(coalesce(strength, 0), 9) AS strength FROM (SELECT DISTINCT doc_id FROM tf) d CROSS JOIN labels l
       LEFT JOIN (SELECT doc_id, label, sum(tfidf / tf) AS strength FROM tfidf JOIN cl USING (term_id) GROUP BY ALL) s ON s.doc_id = d.doc_id AND s.label = l.label),
best AS (SELECT doc_id, label, strength FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY strength DESC, label) AS r FROM st) WHERE r = 1),
rk AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY strength DESC, doc_id) AS rank FROM best),
sc AS (SELECT label, doc_id FROM rk, nd WHERE rank <= n // 5)
"""
CELLS = (
    SUB
    + """, cnt AS (SELECT label, term_id, count(*) AS df, sum(tf)::BIGINT AS tf FROM tf JOIN sc USING (doc_id) GROUP BY ALL),
cells AS (SELECT c.term_id, c.label AS own, l.label, coalesce(df, 0)::BIGINT AS df, coalesce(tf, 0)::BIGINT AS tf FROM cl c CROSS JOIN labels l LEFT JOIN cnt ON cnt.term_id = c.term_id AND cnt.label = l.label),
len AS (SELECT label, sum(tf)::BIGINT AS len FROM cells GROUP BY label), al AS (SELECT avg(len) AS al FROM len),
bm AS (SELECT cells.*, coalesce(3 * (tf * 2.2 / (tf + 1.2 * (1 - 0.5 + 0.5 * len / al))) * log2(1 + df) / log2(CASE WHEN max(df) OVER (PARTITION BY term_id) = 0 THEN 2 ELSE 1 END + max(df) OVER (PARTITION BY term_id)), 0) AS bm25
       FROM cells JOIN len USING (label), al),
con AS (SELECT *, sum(exp(bm25)) OVER (PARTITION BY term_id) AS exp_sum, exp(bm25) / (1 + sum(exp(bm25)) OVER (PARTITION BY term_id)) AS con, log2(df + 1) AS pop FROM bm),
tot AS (SELECT *, sqrt(pop * con) AS total FROM con),
l1 AS (SELECT *, CASE WHEN sum(total) OVER (PARTITION BY term_id) > 0 THEN total / sum(total) OVER (PARTITION BY term_id) END AS l1 FROM tot),
kl AS (SELECT term_id, coalesce(sum(CASE WHEN l1 > 0 THEN l1 * ln(l1 * 5) END), 0) AS score FROM l1 GROUP BY term_id),
ts AS (SELECT l1.term_id, label, pop, con, score FROM l1 JOIN kl USING (term_id) WHERE label = own)
"""
)


def occurrences(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("term_id"))


class Inputs:
    """tf, tf-idf, clusters and sub-corpora of one scale."""

    def __init__(self, spark, sf):
        occ = occurrences(spark, sf)
        self.tf = frequencies.term_frequency(occ)
        self.tfidf = frequencies.tf_idf(self.tf, occ)
        self.cluster = self.tf.select("term_id").distinct().select(F.lit(0).cast("long").alias("node_id"), "term_id", (F.col("term_id") % 5).cast("int").alias("label"))
        self.ranked = subcorpus.by_strength(self.tfidf, self.cluster)
        m = occ.select("doc_id").distinct().agg(F.floor(F.count("*") / 5).alias("m"))
        cut = self.ranked.join(F.broadcast(m)).where("rank <= m")
        self.sub = cut.select("node_id", "label", "doc_id")
        self.dl = frequencies.lengths(occ)

    def cells(self):
        return scoring.cells(self.tf, self.sub, self.cluster)

    def scored(self):
        return scoring.scored(self.tf, self.sub, self.cluster)


def _rounded(rows, *columns):
    for c in columns:
        rows = rows.withColumn(c, F.round(c, 6))
    return rows


@query("subcorpus_strength", f"WITH {SUB} SELECT doc_id, label, round(strength, 6) AS strength FROM best")
def subcorpus_strength(spark, sf):
    i = Inputs(spark, sf)
    return _rounded(subcorpus.strongest(subcorpus.strengths(i.tfidf, i.cluster)).select("doc_id", "label", "strength"), "strength")


@query("doc_cluster_strengths", f"WITH {SUB} SELECT doc_id, label, round(strength, 6) AS strength FROM st")
def doc_cluster_strengths(spark, sf):
    i = Inputs(spark, sf)
    return _rounded(subcorpus.strengths(i.tfidf, i.cluster).select("doc_id", "label", "strength"), "strength")


@query("subcorpus_top_m", f"WITH {SUB} SELECT label, doc_id FROM sc")
def subcorpus_top_m(spark, sf):
    return Inputs(spark, sf).sub.select("label", "doc_id")


@query("df_in_pseudo_docs", f"WITH {CELLS} SELECT term_id, label, df FROM cells")
def df_in_pseudo_docs(spark, sf):
    return Inputs(spark, sf).cells().select("term_id", "label", "df")


@query("tf_in_pseudo_docs", f"WITH {CELLS} SELECT term_id, label, tf FROM cells")
def tf_in_pseudo_docs(spark, sf):
    return Inputs(spark, sf).cells().select("term_id", "label", "tf")


@query("len_pseudo_docs", f"WITH {CELLS} SELECT label, len, round(al, 6) AS avg_len FROM len, al")
def len_pseudo_docs(spark, sf):
    return _rounded(scoring.pseudo_lengths(Inputs(spark, sf).cells()).select("label", "len", "avg_len"), "avg_len")


@query("pseudo_doc_vocab", f"WITH {CELLS} SELECT label, count(*) AS n_terms, sum(term_id)::BIGINT AS id_sum FROM cells WHERE df > 0 GROUP BY label")
def pseudo_doc_vocab(spark, sf):
    c = Inputs(spark, sf).cells().where("df > 0").groupBy("label")
    return c.agg(F.count("*").alias("n_terms"), F.sum("term_id").alias("id_sum"))


def _pop(kind):
    def run(spark, sf):
        i = Inputs(spark, sf)
        sizes = scoring.sizes(i.sub, i.dl) if kind in ("df", "tf") else None
        return _rounded(scoring.popularity(i.cells(), kind, sizes).select("term_id", "label", "pop"), "pop")

    return run


_SIZES = ", z AS (SELECT label, count(*) AS n_docs, sum(dl)::BIGINT AS n_tokens FROM sc JOIN (SELECT l_orderkey AS doc_id, count(*) AS dl FROM lineitem GROUP BY 1) USING (doc_id) GROUP BY label)"
query("pop_df_nodenom", f"WITH {CELLS} SELECT term_id, label, round(log2(df + 1), 6) AS pop FROM cells")(_pop("df_nodenom"))
query("pop_df", f"WITH {CELLS}{_SIZES} SELECT term_id, label, round(log2(df + 1) / n_docs, 6) AS pop FROM cells JOIN z USING (label)")(_pop("df"))
query("pop_df_sum", f"WITH {CELLS} SELECT term_id, label, round(log2(df + 1) / nullif(sum(log2(df + 1)) OVER (PARTITION BY term_id), 0), 6) AS pop FROM cells")(_pop("df_sum"))
query("pop_tf", f"WITH {CELLS}{_SIZES} SELECT term_id, label, round(log2(tf + 1) / n_tokens, 6) AS pop FROM cells JOIN z USING (label)")(_pop("tf"))
query("pop_tf_sum", f"WITH {CELLS} SELECT term_id, label, round(log2(tf + 1) / nullif(sum(log2(tf + 1)) OVER (PARTITION BY term_id), 0), 6) AS pop FROM cells")(_pop("tf_sum"))


@query("bm25", f"WITH {CELLS} SELECT term_id, label, round(bm25, 6) AS bm25 FROM bm")
def bm25(spark, sf):
    return _rounded(scoring.relevance(Inputs(spark, sf).cells()).select("term_id", "label", "bm25"), "bm25")


@query("concentration", f"WITH {CELLS} SELECT term_id, label, round(exp_sum, 6) AS exp_sum, round(con, 6) AS con FROM con")
def concentration(spark, sf):
    return _rounded(Inputs(spark, sf).scored().select("term_id", "label", "exp_sum", "con"), "exp_sum", "con")


@query("l1_norm", f"WITH {CELLS} SELECT term_id, label, round(total, 6) AS total, round(l1, 6) AS l1 FROM l1")
def l1_norm(spark, sf):
    return _rounded(Inputs(spark, sf).scored().select("term_id", "label", "total", "l1"), "total", "l1")


@query("kl_score", f"WITH {CELLS} SELECT term_id, round(score, 6) AS score FROM kl")
def kl_score(spark, sf):
    return _rounded(scoring.divergence(Inputs(spark, sf).scored()).select("term_id", "score"), "score")


@query("own_cluster_score", f"WITH {CELLS} SELECT term_id, round(total, 6) AS score FROM tot WHERE label = own")
def own_cluster_score(spark, sf):
    return _rounded(scoring.own_label(Inputs(spark, sf).scored()).select("term_id", "score"), "score")


@query("term_scores", f"WITH {CELLS} SELECT term_id, label, round(pop, 6) AS pop, round(con, 6) AS con, round(score, 6) AS score FROM ts")
def term_scores(spark, sf):
    return _rounded(scoring.term_scores(Inputs(spark, sf).scored()).drop("node_id"), "pop", "con", "score")


@query(
    "score_avg_median",
    f"WITH {CELLS} SELECT round(avg(pop), 6) AS avg_pop, round(median(pop), 6) AS median_pop, round(avg(con), 6) AS avg_con, round(median(con), 6) AS median_con, round(avg(score), 6) AS avg_score, round(median(score), 6) AS median_score FROM ts",
)
def score_avg_median(spark, sf):
    s = scoring.summary(scoring.term_scores(Inputs(spark, sf).scored()))
    return _rounded(s, *s.columns)


@query("push_up_split", f"WITH {CELLS} SELECT term_id, label, round(score, 6) < 0.35 AS pushed FROM ts")
def push_up_split(spark, sf):
    scores = _rounded(scoring.term_scores(Inputs(spark, sf).scored()), "score")
    return scoring.split_general(scores, 0.35).select("term_id", "label", "pushed")


@query(
    "push_up_keep_least",
    f"""WITH {CELLS}, r AS (SELECT term_id, label, round(score, 6) AS score FROM ts), f AS (SELECT *, score < 0.01 AS low, row_number() OVER (PARTITION BY label ORDER BY score, term_id) AS k, max((score < 0.01)::INT) OVER (PARTITION BY label) AS any_low FROM r)
    SELECT term_id, label, low OR (any_low = 0 AND k = 1) AS pushed FROM f""",
)
def push_up_keep_least(spark, sf):
    scores = _rounded(scoring.term_scores(Inputs(spark, sf).scored()), "score")
    return scoring.split_general(scores, 0.01, keep_least=True).select("term_id", "label", "pushed")


@query(
    "cluster_guard",
    f"WITH {CELLS} SELECT label, count(*) AS n_terms, n_docs, count(*) >= 5 AND n_docs >= 5 AS expand FROM ts JOIN (SELECT label, count(*) AS n_docs FROM sc GROUP BY label) USING (label) WHERE round(score, 6) >= 0.35 GROUP BY label, n_docs",
)
def cluster_guard(spark, sf):
    i = Inputs(spark, sf)
    kept = _rounded(scoring.term_scores(i.scored()), "score").where("score >= 0.35").groupBy("label").agg(F.count("*").alias("n_terms"))
    docs = i.sub.groupBy("label").agg(F.count("*").alias("n_docs"))
    return kept.join(docs, "label").select("label", "n_terms", "n_docs", ((F.col("n_terms") >= 5) & (F.col("n_docs") >= 5)).alias("expand"))


RELEVANT = """
t AS (SELECT l_partkey AS term_id, l_orderkey AS doc_id FROM lineitem GROUP BY ALL), c AS (SELECT term_id, (term_id % 5)::INT AS label, row_number() OVER (PARTITION BY term_id % 5 ORDER BY term_id) AS rank, count(*) OVER (PARTITION BY term_id % 5) AS n FROM (SELECT DISTINCT term_id FROM t)),
rows_ AS (SELECT label, rank AS term_rank, (rank - 1) // 100 AS blk, doc_id FROM c JOIN t USING (term_id) WHERE rank < n),
fb AS (SELECT label, blk, count(*) AS new FROM (SELECT label, doc_id, min(blk) AS blk FROM rows_ GROUP BY ALL) GROUP BY ALL), ab AS (SELECT DISTINCT label, blk FROM rows_),
op AS (SELECT label, blk FROM (SELECT label, blk, coalesce(sum(new) OVER (PARTITION BY label ORDER BY blk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ab LEFT JOIN fb USING (label, blk)) WHERE before < 1000),
bag AS (SELECT label, doc_id, row_number() OVER (PARTITION BY label ORDER BY term_rank, doc_id) AS rank FROM rows_ JOIN op USING (label, blk))
"""


def relevant(spark, sf):
    tf = scratch.written(frequencies.term_frequency(occurrences(spark, sf)))  # read more than once
    terms = tf.select("term_id").distinct().select(F.lit(0).alias("node_id"), (F.col("term_id") % 5).cast("int").alias("label"), "term_id")
    ranked = ranking.ranked(terms, ["label"], ["term_id"], "rank")
    return subcorpus.by_relevance(ranked, postings.stored(tf), 1000)


@query("relevant_docs_iter", f"WITH {RELEVANT} SELECT label, doc_id, rank FROM bag")
def relevant_docs_iter(spark, sf):
    return relevant(spark, sf).select("label", "doc_id", "rank")


@query("relevant_docs_reduced", f"WITH {RELEVANT} SELECT DISTINCT label, doc_id FROM bag WHERE rank <= 1000")
def relevant_docs_reduced(spark, sf):
    return subcorpus.first_m(relevant(spark, sf), 1000).select("label", "doc_id")


@query("relevant_docs_bag", "SELECT (l_partkey % 5)::INT AS label, l_orderkey AS doc_id FROM (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem)")
def relevant_docs_bag(spark, sf):
    tf = frequencies.term_frequency(occurrences(spark, sf))
    cluster = tf.select("term_id").distinct().select(F.lit(0).alias("node_id"), "term_id", (F.col("term_id") % 5).cast("int").alias("label"))
    return subcorpus.documents_of(cluster, postings.stored(tf)).select("label", "doc_id")


@query(
    "subcorpus_extend",
    f"""WITH {RELEVANT}, other AS (SELECT (o_orderkey % 5)::INT AS label, o_orderkey AS doc_id, row_number() OVER (PARTITION BY o_orderkey % 5 ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders),
    new AS (SELECT label, doc_id, row_number() OVER (PARTITION BY label ORDER BY rank) AS k FROM other o WHERE NOT EXISTS (SELECT 1 FROM bag b WHERE b.label = o.label AND b.doc_id = o.doc_id)), e AS (SELECT label, max(rank) AS last FROM bag GROUP BY label)
    SELECT label, doc_id, rank FROM bag UNION ALL SELECT label, doc_id, (k + coalesce(last, 0))::BIGINT FROM new LEFT JOIN e USING (label)""",
)
def subcorpus_extend(spark, sf):
    o = table(spark, sf, "orders").select(F.lit(0).alias("node_id"), (F.col("o_orderkey") % 5).cast("int").alias("label"), F.col("o_orderkey").alias("doc_id"), "o_totalprice")
    other = ranking.ranked(o, ["label"], [F.desc("o_totalprice"), "doc_id"], "rank").drop("o_totalprice")
    return subcorpus.extended(relevant(spark, sf), other).select("label", "doc_id", "rank")


@query("event_postings", "SELECT event_type AS term_id, count(DISTINCT user_id) AS df, round(avg(value), 6) AS avg_value, round(median(value), 6) AS median_value FROM events GROUP BY event_type")
def event_postings(spark, sf):
    e = table(spark, sf, "events").groupBy(F.col("event_type").alias("term_id"))
    return e.agg(F.countDistinct("user_id").alias("df"), F.round(F.avg("value"), 6).alias("avg_value"), F.round(F.median("value"), 6).alias("median_value"))
