"""Weighted means of vectors a document, dealt without their vectors."""

import collections

import pytest

from taxoloom.operators import checks, vectors
from taxoloom.plans.catalog import QUERIES


@pytest.mark.parametrize("block, cell", [(1 << 18, 6_000_000), (2, 3)])
def test_document_vectors_as_a_loop(spark, monkeypatch, block, cell):
    """One block or several; terms twice, without a vector, with a null in it; a missing document id; no terms."""
    monkeypatch.setattr(vectors, "VECTORS", block)
    monkeypatch.setattr(vectors, "WEIGHTS", cell)
    emb = [(0, [1.0, 2.0]), (1, [0.5, -1.0]), (1, [3.0, 4.0]), (2, [1.0, None]), (3, None), (None, [9.0, 9.0]), (5, [-2.0, 0.25]), (6, [7.0, 1.0])]
    weights = [(d, t, (d or 0) + t / 2 + 0.5) for d in (1, 2, 3, None, 9) for t in range(8) if (d or 4) % (t + 2)] + [(7, 4, 1.0), (8, None, 2.0)]
    want = collections.defaultdict(list)
    for d, t, w in weights:
        want[d] += [[w * x for x in v] for k, v in emb if k == t and t is not None and v and None not in v]
    want = {d: [sum(c) / len(c) for c in zip(*rows)] for d, rows in want.items() if rows}
    df = spark.createDataFrame(weights, "doc_id long, term_id long, tfidf double").repartition(3)
    for kind in ("double", "float"):
        got = vectors.document_vectors(df, spark.createDataFrame(emb, f"term_id long, emb array<{kind}>")).collect()
        assert len(got) == len(want) and all(r.emb == pytest.approx(want[r.doc_id]) for r in got)


def test_no_vector_is_shuffled_for_a_term_of_a_document(spark):
    """partial sums of all documents in every task grew with documents times tasks."""
    plan = QUERIES["doc_embedding"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "aggregate_metrics" not in plan.lower() and "summar" not in plan.lower() and "CoGroups" in plan


def test_keys_are_compared_in_one_pass(spark):
    """as often, nulls alike, in both directions; the pairs aren't dealt by both keys again."""
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (None, "z"), (3, None), (4, "v")], "d long, t string")
    b = spark.createDataFrame([(1, "x"), (2, "y"), (2, "w"), (None, "z"), (3, None), (4, "v"), (4, "v"), (4, "v")], "d long, t string")
    got = lambda x, y: checks.same_keys(x, y, ["d", "t"], "k").collect()
    assert [tuple(r) for r in got(a, b) + got(b, a)] == [("k", 4)] * 2 and got(a, a)[0].violations == got(a.limit(0), b.limit(0))[0].violations == 0
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # a vocabulary of any size
    try:
        plan = QUERIES["check_frequency_keys"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(doc_id" in plan and not [p for p in plan.split("hashpartitioning(")[1:] if "doc_id" in p.split(")")[0] and "term_id" in p.split(")")[0]]
