"""Packed pairs of words against a loop, and what is shuffled."""

import collections
from fractions import Fraction

import numpy as np
import pytest

from taxoloom.operators import cooccurrence, learning
from taxoloom.plans.catalog import QUERIES


def brute(sentences, window):
    out = collections.Counter()
    for s in sentences:
        s = [w for w in s or [] if w is not None]
        for i, a in enumerate(s):
            for d, b in enumerate(s[i + 1 : i + 1 + window], 1):
                out[a, b] += Fraction(1, d)
                out[b, a] += Fraction(1, d)
    return {k: float(v) for k, v in out.items()}


@pytest.mark.parametrize("window, numbered, chunk, at_once, share", [(15, 1 << 18, 1 << 22, 1 << 24, 1 << 20), (15, 7, 50, 90, 40), (1, 0, 1, 1, 1000), (30, 7, 10**6, 200, 300)])
def test_as_a_loop(spark, window, numbered, chunk, at_once, share):
    """Frequent words and others, a word beside itself, missing words; chunks, slices and buckets of any size."""
    rng = np.random.default_rng(window)
    words = [f"w{i}" for i in range(30)] + ["\u00e9", "\U0001f600", "x" * 80]
    sents = [[str(w) for w in rng.choice(words, n, p=np.arange(33, 0, -1) / 561)] for n in rng.integers(0, 60, 60)]
    sents += [["once", "once", "once"], ["alone"], [], None, ["a", None, "b"], ["lone", "pair"], ["pair", "lone"]]
    df = spark.createDataFrame([(s,) for s in sents], "words array<string>").repartition(3)
    got = cooccurrence.cooccurrence(df, window=window, numbered=numbered, chunk=chunk, at_once=at_once, share=share).collect()
    want = brute(sents, window)
    assert len(got) == len(want) and {(r.word, r.other): r.weight for r in got} == pytest.approx(want, abs=1e-9)


def test_no_words(spark):
    assert cooccurrence.cooccurrence(spark.createDataFrame([], "words array<string>")).count() == 0


def test_of_rows_of_words(spark):
    rows = [(1, 0, 0, "a"), (1, 0, 2, "b"), (1, 0, 5, "a"), (1, 1, 0, "b"), (2, 0, 0, "b"), (2, 0, 1, "c")]
    got = learning.cooccurrence(spark.createDataFrame(rows, "doc_id long, sent_id int, pos int, word string"), 2).collect()
    assert {(r.word, r.other): r.weight for r in got} == {("a", "b"): 2.0, ("b", "a"): 2.0, ("a", "a"): 1.0, ("b", "c"): 1.0, ("c", "b"): 1.0}


def test_pairs_are_shuffled_packed(spark):
    plan = QUERIES["cooccurrence"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Exchange hashpartitioning(bucket" in plan and "Window" not in plan
