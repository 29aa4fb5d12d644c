"""Count-based vectors in blocks against one numpy descent over all pairs, and C-values of many lengths against a loop."""

import itertools
import json
import math

import numpy as np
import pytest

from taxoloom.operators import glove, terms
from taxoloom.sources import readers, writers


@pytest.fixture(scope="module")
def pairs():
    """Two topics of words that meet often within and seldom across."""
    rng, out = np.random.default_rng(0), {}
    for a, b in itertools.permutations(range(40), 2):
        if rng.random() < 0.7:
            out[f"w{a:02}", f"w{b:02}"] = float(np.round(rng.gamma(2, 4 if (a < 20) == (b < 20) else 0.2) + 0.05, 3))
    return out


def plain(pairs, size, rounds):
    """Descent pair by pair, in the order of the table."""
    words = sorted({w for p in pairs for w in p})
    i, j = (np.array([words.index(p[s]) for p in pairs]) for s in (0, 1))
    x = np.array(list(pairs.values()))
    rows, columns = (glove.start(1, side, 0, len(words), size) for side in (0, 1))
    out = []
    for _ in range(rounds):
        out.append(glove.loss(rows, columns, i, j, x, 10.0, 0.75))
        glove.descend(rows, columns, i, j, x, 0.05, 10.0, 0.75, batch=1)
    return out


@pytest.mark.parametrize("block", [2048, 15])
def test_loss_falls_as_in_a_plain_descent(spark, pairs, block):
    df = spark.createDataFrame([(a, b, x) for (a, b), x in pairs.items()] + [("a", None, 1.0), ("w01", "w02", 0.0)], "word string, other string, weight double")
    vectors, losses = glove.train(df.repartition(3), size=6, rounds=22, block=block)
    want = plain(pairs, 6, 22)
    assert losses[-1] < losses[0] / 3 and losses[-1] < 1.25 * want[-1]
    if block == 2048:  # with several blocks a cell's loss is told after the cells before it were trained
        assert losses[0] == pytest.approx(want[0]) and losses[-1] > 0.75 * want[-1]
    emb = {r.term: np.array(r.emb) for r in vectors.collect()}
    assert len(emb) == 40 and all(len(v) == 6 for v in emb.values())
    alike = lambda a, within: np.mean([emb[a] @ emb[b] for b in emb if b != a and ((a < "w20") == (b < "w20")) == within])
    assert np.mean([alike(a, True) > alike(a, False) for a in emb]) > 0.9


def test_no_pairs(spark):
    vectors, losses = glove.train(spark.createDataFrame([], "word string, other string, weight double"))
    assert vectors.count() == 0 and losses == []


def brute_c_values(cands, threshold, corrected):
    held, out = {}, {}
    longest = max(n for _, n in cands.values())
    for n in range(longest, 0, -1):
        last = {}
        for term in sorted(t for t, (_, m) in cands.items() if m == n):
            freq = cands[term][0]
            t, c = held.get(term, (0, 0))
            value = math.log2(n) * freq if not c else math.log2(n) * (freq - t / c) if corrected else math.log2(n) * freq - t / c
            if value <= threshold:
                continue
            out[term] = value
            words = term.split("_")
            for k in range(1, n):
                for i in range(n - k + 1):
                    sub = "_".join(words[i : i + k])
                    if n == longest and not corrected:
                        last[sub] = freq
                    else:
                        t, c = held.get(sub, (0, 0))
                        held[sub] = t + freq, c + 1
        for sub, freq in last.items():
            held[sub] = freq, 1
    return out


@pytest.mark.parametrize("corrected", [False, True])
def test_c_values_of_twelve_lengths(spark, corrected):
    rng = np.random.default_rng(5)
    cands = {}
    for n in range(1, 13):
        for _ in range(8):
            cands["_".join(rng.choice(list("abc"), n))] = (int(rng.integers(2, 30)), n)
    df = spark.createDataFrame([(t, f, n) for t, (f, n) in cands.items()], "term string, freq long, length int")
    got = {r.term: r.cval for r in terms.c_values(df, corrected=corrected).collect()}
    assert got == pytest.approx(brute_c_values(cands, 2.0, corrected))


def test_json_maps_of_lines_and_whole_files(spark, tmp_path):
    table = [(f"k{i}", i) for i in range(50)]
    writers.json_map(spark.createDataFrame(table, "k string, n long").repartition(4), f"{tmp_path}/lines", "k", "n")
    assert sorted(map(tuple, readers.json_map(spark, f"{tmp_path}/lines", "bigint").collect())) == sorted(table)
    (tmp_path / "mixed").mkdir()
    (tmp_path / "mixed/a.json").write_text(json.dumps(dict(table[:20]), indent=1))
    (tmp_path / "mixed/b.json").write_text(json.dumps(dict(table[20:30])))
    (tmp_path / "mixed/c.json").write_text("\n".join(json.dumps({k: n}) for k, n in table[30:]) + "\n\n")
    assert sorted(map(tuple, readers.json_map(spark, f"{tmp_path}/mixed", "bigint").collect())) == sorted(table)
    (tmp_path / "mixed/d.json").write_text('{"a": 1,\n')
    with pytest.raises(Exception, match="no JSON object"):
        readers.json_map(spark, f"{tmp_path}/mixed", "bigint").collect()
