"""Many blocks packed and unpacked at once, against one at a time."""

import numpy as np
import pyarrow as pa

from taxoloom.operators import postings as P


def lists():
    rng = np.random.default_rng(3)
    sizes = [1, 1, 2, 5, 300, 4096, 8190, 8191, 20000, P.BLOCK, 1]
    return [np.sort(rng.choice(P.BLOCK, n, replace=False)) for n in sizes] + [np.array([0]), np.array([P.BLOCK - 1]), np.array([3, 259]), np.array([3, 258]), np.array([0, P.BLOCK - 1]), np.arange(8191), np.arange(8190)]


def test_many_blocks_are_packed_as_one_by_one(monkeypatch):
    """only dense blocks are packed and unpacked singly."""
    found = lists()
    one = [P.packed(x) for x in found]
    calls = []
    packed, places = P.packed, P.places
    monkeypatch.setattr(P, "packed", lambda x: calls.append(1) or packed(x))
    monkeypatch.setattr(P, "places", lambda x: calls.append(1) or places(x))
    many = P.packed_all(np.concatenate(found), np.cumsum([len(x) for x in found]))
    assert many.to_pylist() == one
    for skip in (0, 3):
        flat, n = P.places_all(many.slice(skip))
        assert n.tolist() == [len(x) for x in found[skip:]] and np.array_equal(flat, np.concatenate(found[skip:]))
    assert len(calls) == 3 * sum(x[0] == P.BITS for x in one) < len(found) * 2


def test_overlaps_of_many_blocks_equal_sets(spark):
    rng = np.random.default_rng(4)
    rows = {(d, t) for t, n in enumerate([1, 3, 500, 40000, 90000, 2]) for d in rng.integers(0, 150000, n).tolist()}
    blocks = P.stored(spark.createDataFrame(sorted(rows), "doc_id long, term_id long"))
    assert {tuple(r) for r in P.documents(blocks).select("doc_id", "term_id").collect()} == rows
    from pyspark.sql import functions as F

    left = blocks.withColumn("node_id", F.lit(0))
    sets = {t: {d for d, u in rows if u == t} for t in range(6)}
    for t in (1, 2, 4):
        got = P.overlap(left, left.where(F.col("term_id") == t).drop("term_id"), ["node_id"]).groupBy("term_id").agg(F.sum("both").alias("n"))
        assert {r["term_id"]: r["n"] for r in got.collect()} == {u: len(sets[u] & sets[t]) for u in range(6)}


def test_counts_are_made_once_for_postings_and_terms(spark):
    """what is read again is written, and only the chosen blocks are unpacked again."""
    from taxoloom.plans.catalog import QUERIES

    sf = "/root/testdata/sf0.001"
    for name, most in (("relevant_docs_iter", 2), ("inclusion_score", 2)):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "l_orderkey" not in plan and plan.count("MapInArrow") <= most, name
