"""A level's documents judged for their own nodes only."""

import numpy as np

from taxoloom.operators import subcorpus


def test_documents_are_judged_for_their_nodes_only(spark):
    """the same as judging every document for every node and choosing afterwards, without that product."""
    rng = np.random.default_rng(5)
    tfidf = spark.createDataFrame([(d, int(t), 2, float(rng.random())) for d in range(40) for t in rng.choice(30, 6, replace=False)], "doc_id long, term_id long, tf long, tfidf double")
    cluster = spark.createDataFrame([(t % 5, t // 5 % 3, t) for t in range(25)], "node_id long, label int, term_id long")
    by_node = spark.createDataFrame([(n, d) for n in range(4) for d in range(40) if (d + n) % 3 == 0] + [(1, 99), (7, 3)], "node_id long, doc_id long")
    emb = spark.createDataFrame([(d, [float(x) for x in rng.normal(size=3)]) for d in range(38)], "doc_id long, emb array<double>")
    center = spark.createDataFrame([(n, k, [float(x) for x in rng.normal(size=3)]) for n in range(5) for k in range(3)], "node_id long, label int, emb array<double>")
    rows = lambda df: sorted(tuple(r) for r in df.select("node_id", "doc_id", "label", df.columns[-1]).collect())
    for all_, own in (
        (subcorpus.assigned_by_strength(tfidf, cluster), subcorpus.assigned_by_strength(tfidf, cluster, node_docs=by_node)),
        (subcorpus.assigned_by_retrieval(emb, center), subcorpus.assigned_by_retrieval(emb, center, by_node)),
    ):
        got = rows(own)
        assert got == rows(all_.join(by_node, ["node_id", "doc_id"], "left_semi")) and len(got) > 45
        plan = own._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
