"""Relation patterns against regular expressions over one letter a word, and on very long lists."""

import random
import re
import time

import pytest

from taxoloom.functions import patterns
from taxoloom.operators import linguistics, relations

FIXTURE = [
    (1, 0, "dogs such as poodles , beagles and huskies", "0np such as 0np , 0np and 0np"),
    (2, 0, "such animals as cats , lynxes or tigers", "such 0np as 0np , 0np or 0np"),
    (3, 0, "poodles , beagles and other big_dogs", "0np , 0np and other 1np"),
    (4, 0, "big_cats , including lynxes and tigers", "1np , including 0np and 0np"),
    (5, 0, "the methods work", "DT 0np VBP"),
    (6, 0, "fast graph methods such as search trees , hash tables and sorts", "JJ NN NNS such as NN NNS , NN NNS and NNS"),
]
#: A letter a word: noun, word before a noun, comma, or / and, such, as, other, including / especially, anything else.
LETTERS = {"n": ("cat", "NN"), "m": ("big", "JJ"), ",": (",", ","), "&": ("and", "CC"), "s": ("such", "JJ"), "a": ("as", "IN"), "o": ("other", "JJ"), "i": ("including", "VBG"), "x": ("runs", "VBZ")}


@pytest.fixture(scope="module")
def fixture(spark):
    """A final s is no part of a lemma."""
    rows = [(d, s, i, w, t, re.sub("s$", "", w), False) for d, s, line, tags in FIXTURE for i, (w, t) in enumerate(zip(line.split(), tags.split()))]
    return relations.sentences(spark.createDataFrame(rows, "doc_id long, sent_id int, pos int, token string, tag string, lemma string, is_stop boolean"))


def test_relations_of_analysed_sentences(fixture):
    assert {(r.hyper, r.hypo) for r in relations.chunk_relations(fixture).collect()} >= {("dogs", "huskies"), ("animals", "tigers"), ("big_cats", "tigers")}
    every = {(r.hyper, r.hypo) for r in relations.chunk_relations(fixture, all_hyponyms=True).collect()}
    assert every >= {("dogs", "poodles"), ("dogs", "beagles"), ("dogs", "huskies"), ("big_dogs", "poodles"), ("big_dogs", "beagles"), ("big_cats", "lynxes")}
    assert ("big_cat", "tiger") in {(r.hyper, r.hypo) for r in relations.chunk_relations(fixture, "l").collect()}
    assert {(r.hyper, r.hypo) for r in relations.word_relations(fixture).collect()} == {("fast graph method", "sort"), ("fast graph method", "search tree"), ("fast graph method", "hash table")}


def expected(letters, phrase):
    """Word ranges that backtracking expressions over the letters find."""
    kinds = {
        "such_as": rf"(?P<hyper>{phrase})sa(?:(?P<hypos>(?:{phrase},?)+)&)?(?P<hypo>{phrase})",
        "such_np_as": rf"s(?P<hyper>{phrase})a(?P<hypos>(?:{phrase},?)*)&?(?P<hypo>{phrase})",
        "other": rf"(?P<hypo>{phrase})(?:,(?P<hypos>{phrase}),?)?&o(?P<hyper>{phrase})",
        "including": rf"(?P<hyper>{phrase}),?i(?P<hypos>(?:{phrase},?)*)&?(?P<hypo>{phrase})",
    }
    out = []
    for name, kind in kinds.items():
        for m in re.finditer(kind, letters):
            at = m.start("hypos")
            hypos = [] if at < 0 else [(at + p.start(), at + p.end()) for p in re.finditer(phrase, m["hypos"])]
            out.append((name, m.span("hyper"), hypos, m.span("hypo")))
    return out


@pytest.mark.parametrize("phrase, read", [("n", patterns.glued_symbols), ("[mn]*n", patterns.word_symbols)])
def test_matches_as_regular_expressions(phrase, read):
    rng, met = random.Random(6), 0
    for n in range(60_000):
        letters = "".join(rng.choice(["n", "n", "m", ",", "&", "sa", "s", "a", "o", "&o", "i", "x", "nsan,n", "sna", "n,in"]) for _ in range(rng.randint(1, 9)))
        words = [LETTERS[c] for c in letters]
        tags = ["0np" if c == "n" and phrase == "n" else LETTERS[c][1] for c in letters]
        got = [(m.pattern, (m.hyper.start, m.hyper.end), [(h.start, h.end) for h in m.hypos], (m.hypo.start, m.hypo.end)) for m in patterns.matched(read([w for w, _ in words], tags))]
        assert got == expected(letters, phrase), letters
        met += len(got)
    assert met > 5_000


@pytest.mark.parametrize("middle", ["cat , ", "cat "])
def test_very_long_lists(spark, middle):
    """A list of 100,000, with and without commas, from raw text to relations, beside other sentences."""
    n = 100_000
    docs = spark.createDataFrame([(1, "kinds such as " + middle * n + "and dog"), (2, None), (3, "kinds , including " + middle * n + "cat"), (4, "such cats as dogs")], "doc_id long, text string")
    started = time.time()
    found = relations.word_relations(linguistics.tag(docs)).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in found} == ({1: n + 1, 3: n + 1, 4: 1} if "," in middle else {1: 2, 3: 2, 4: 1})
    chunks = linguistics.extract(docs, all_hyponyms=True)[0].groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in chunks} == ({1: n + 1, 3: n + 1, 4: 1} if "," in middle else {1: 2, 3: 1, 4: 1})
    assert time.time() - started < 120


def test_long_input_is_linear():
    for n in (20_000, 200_000):
        words = ["cat", "such", "as"] * (n // 2) + ["cat", ","] * n
        started = time.time()
        list(patterns.matched(patterns.glued_symbols(words, ["0np" if w == "cat" else "," for w in words])))
        assert time.time() - started < n / 10_000
