"""Ranks by ranges against a window, and postings in blocks against sets."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from taxoloom.operators import labeling, postings, ranking, subcorpus


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_ranks_as_a_window_gives_them(spark, n):
    """Nearly all rows belong to one key; null keys and values, ties told apart by id."""
    rng = random.Random(n)
    table = [(rng.choice([1] * 9 + [2, None]), rng.choice([None, 1.5, -2.0, float(rng.randint(0, 9))]), i) for i in range(n)]
    df = spark.createDataFrame(table, "label int, value double, id long").repartition(7)
    want = df.withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("value"), "id")).cast("long"))
    assert rows(ranking.ranked(df, ["label"], [F.desc("value"), "id"])) == rows(want)
    assert rows(ranking.ranked(df, [], ["id"], "k").select("id", "k")) == [(i, i + 1) for i in sorted(range(n), key=lambda i: str((i, i + 1)))]
    assert rows(ranking.top(df, ["label"], [F.desc("value"), "id"], 3)) == rows(want.where("place <= 3"))
    with pytest.raises(ValueError):
        ranking.ranked(df, ["label"], ["id"], "value")


def test_one_key_lies_in_several_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        dealt = ranking.by_ranges(spark.range(40_000).select(F.lit(0).alias("label"), F.hash("id").alias("v")), ["label"], ["v"])
        sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 4 and max(sizes) < 2 * sorted(sizes)[2]


KINDS = [[0], [65535], [0, 65535], list(range(65536)), list(range(0, 65536, 3)), [5, 6, 300, 301], sorted(random.Random(1).sample(range(65536), 900))]


@pytest.mark.parametrize("a", KINDS)
def test_packed_blocks(a):
    block = postings.packed(np.array(a))
    assert len(block) <= 8193 and postings.places(block).tolist() == a
    assert np.flatnonzero(np.unpackbits(postings.bits(block))).tolist() == a
    for b in KINDS:
        assert postings.common(block, postings.packed(np.array(b))) == len(set(a) & set(b))


@pytest.fixture(scope="module")
def held(spark):
    """A term in nearly all documents, rare ones, negative ids, and documents far apart."""
    rng = random.Random(3)
    table = [(d, 0) for d in range(0, 300_000, 2)] + [(rng.randint(-100_000, 400_000), t) for t in range(1, 9) for _ in range(3 ** (t % 7))] + [(1 << 40, 3), (7, 3), (7, 3)]
    sets = {}
    for d, t in table:
        sets.setdefault(t, set()).add(d)
    df = spark.createDataFrame(table + [(None, 3), (4, None)], "doc_id long, term_id long")
    return sets, postings.build(df).cache()


def test_counts_and_documents(held):
    sets, blocks = held
    assert rows(postings.document_frequency(blocks)) == rows_of({t: len(d) for t, d in sets.items()})
    got = {}
    for t, d in rows(postings.documents(blocks)):
        got.setdefault(t, []).append(d)
    assert {t: sorted(d) for t, d in got.items()} == {t: sorted(d) for t, d in sets.items()}
    assert blocks.agg(F.max(F.length("docs"))).first()[0] <= 8193 and blocks.agg(F.max("n")).first()[0] <= postings.BLOCK


def rows_of(counts):
    return sorted(counts.items(), key=str)


def test_unions_and_overlaps(spark, held):
    sets, blocks = held
    groups = {0: [1, 2, 3], 1: [0, 6], 2: [5]}
    chosen = spark.createDataFrame([(g, t) for g, ts in groups.items() for t in ts], "node_id long, term_id long")
    union = postings.union(chosen.join(blocks, "term_id"), ["node_id"])
    got = {}
    for g, d in rows(postings.documents(union)):
        got.setdefault(g, []).append(d)
    want = {g: set().union(*(sets[t] for t in ts)) for g, ts in groups.items()}
    assert {g: sorted(d) for g, d in got.items()} == {g: sorted(d) for g, d in want.items()}
    terms = spark.createDataFrame([(g, t) for g in groups for t in sets], "node_id long, term_id long")
    met = postings.overlap(terms.join(blocks, "term_id"), union, ["node_id"]).groupBy("node_id", "term_id").agg(F.sum("both"))
    assert rows(met) == sorted(((g, t, len(sets[t] & want[g])) for g in groups for t in sets), key=str)
    shares = {(r.node_id, r.term_id): r.incl for r in labeling.inclusion(blocks, chosen, terms).collect()}
    arrays = spark.createDataFrame([(t, sorted(d)) for t, d in sets.items()], "term_id long, docs array<long>")
    assert shares == {(r.node_id, r.term_id): r.incl for r in labeling.inclusion(arrays, chosen, terms).collect()}
    assert shares[0, 3] == len(sets[3]) / (len(sets[3]) + 1)


def test_documents_of_central_terms(spark, held):
    sets, blocks = held
    ranked = spark.createDataFrame([(0, 0, t, t + 1) for t in range(5)], "node_id long, label int, term_id long, rank int")
    assert {r.doc_id for r in subcorpus.by_importance(ranked, blocks, 3).collect()} == sets[0] | sets[1] | sets[2]


def test_no_postings(spark):
    blocks = postings.build(spark.createDataFrame([], "doc_id long, term_id string"))
    assert blocks.count() == 0 and postings.documents(blocks).count() == 0 and postings.document_frequency(blocks).count() == 0
