"""Each operator against a brute-force version on small tables: nulls, empties, ties, repeats, clashing names."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from taxoloom.llm import bpe, editprint, licenses, lines, packing, simhash, substring, topk, toxicity, urls
from taxoloom.llm._components import components
from taxoloom.llm._run import written
from taxoloom.llm._skew import join_counted

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
TEXT = "doc_id long, text string"
ODD = [(1, None), (2, ""), (None, "a b"), (3, "x " * 3000), (3, "x " * 3000), (4, "  \n\t "), (5, "é日\U0001f600 's"), (6, "a\nb\nc")]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def empty(spark):
    return spark.createDataFrame([], TEXT)


# ---- top-k ----


def brute_top(vectors, k):
    good = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for row, (i, v) in enumerate(good):
        if i % 5 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for other, (j, w) in enumerate(good) if other != row)[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block,query", [(40, 10), (8192, 2048)])
def test_top_k(spark, block, query):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(150, 6)) * np.exp(rng.normal(size=(150, 1)))
    m[20:60] = m[19]
    data = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(500, None), (505, [float("nan")] * 6), (510, []), (None, [1.0] * 6), (515, [1.0, None])]
    data += [(0, data[7][1]), (0, data[0][1]), (5, data[5][1]), (3, data[60][1])]  # ids and rows that repeat
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    assert rows(topk.top_k(df, lambda i: i % 5 == 0, block_rows=block, query_rows=query)) == brute_top(data, 10)


def test_top_k_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [2.0])], "vec_id long, embedding array<double>")
    assert rows(topk.top_k(few, lambda i: i % 100 == 0)) == [(0, 1, 1, 1024 * 2048), (0, 2, 2, 1024 * 2048)]
    assert rows(topk.top_k(few.limit(0), lambda i: i % 100 == 0)) == []


def test_pruning_keeps_all_that_reach_the_floor():
    rng = np.random.default_rng(4)
    for _ in range(200):
        c = np.floor(rng.normal(size=(40, 5)) * 100)
        q = c[0] + np.floor(rng.normal(size=5) * 20)
        scores = c @ q
        floor = float(np.sort(scores)[-3])
        kept = topk.survivors(q, np.linalg.norm(q), c, np.linalg.norm(c, axis=1), floor)
        assert set(np.nonzero(scores >= floor)[0]) <= set(kept)


# ---- edit fingerprints ----


def test_edit_fingerprints(spark):
    data = [(i, " ".join(random.Random(i).choices("lorem ipsum dolor sit amet".split(), k=i % 40))) for i in range(60)] + [(60, None)]
    got = {r.doc_id: r for r in editprint.fingerprints_with_edits(spark.createDataFrame(data, TEXT), partitions=5).collect()}
    line = sorted(((i, t or "") for i, t in data), reverse=True)
    prints = {}
    for n, (i, t) in enumerate(line):
        after = line[(n + 1) % len(line)][1]
        changed = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert prints.setdefault(t, got[i].fingerprint) == got[i].fingerprint
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert rows(editprint.fingerprints_with_edits(empty(spark))) == []
    assert editprint.fingerprints_with_edits(spark.createDataFrame(ODD, TEXT)).count() == len(ODD)


def test_walk_is_the_same_alone_and_in_a_crowd():
    texts = ["".join(random.Random(i).choices("abc de", k=50 * i)) for i in range(60)]
    together = editprint.walk(texts)
    for i in (0, 1, 7, 30, 59):
        assert (editprint.walk([texts[i]])[0] == together[i]).all()
    near = editprint.likeness(editprint.walk([texts[50]]), editprint.walk([texts[50][:700] + "zz" + texts[50][700:]]))
    assert near[0] > editprint.likeness(together[50:51], together[49:50])[0]


def brute_walk(text):
    """The rule step by step: one character at a time, the bit of step and character moves on, sampled steps are noted."""
    symbols = [ord(c) % 255 + 1 for c in text] + [0]
    limit = editprint.steps_for(len(text))
    out, best, at = [0] * editprint.PLACES, {}, 0
    for t in range(limit):
        h = int(editprint.mix(np.array([t + 977], np.uint64))[0])
        place, priority = h % editprint.PLACES, int(editprint.mix(np.array([h], np.uint64))[0])
        if priority <= best.get(place, 1 << 64):
            best[place] = priority
            out[place] = int(editprint.mix(np.array([symbols[at] + t * 0x100000001B3], np.uint64))[0]) % 15 + 1 if symbols[at] else 0
        at += int(editprint.rule()[t % editprint.PERIOD, symbols[at]])
    return out


@pytest.mark.parametrize("text", ["", "a", "ab c", "Lorem ipsum dolor sit amet. " * 20, "é日\U0001f600" * 50])
def test_walk_is_the_plain_walk(text):
    assert editprint.walk([text])[0].tolist() == brute_walk(text)


def test_classes_lose_no_pair_that_meets(spark):
    rng = random.Random(4)
    base = ["".join(rng.choices("abcdefgh ", k=600)) for _ in range(6)]
    texts = list(base)
    for i in range(40):
        t = list(rng.choice(base))
        for _ in range(rng.randint(1, 12)):
            t[rng.randrange(len(t))] = rng.choice("xyz")
        texts.append("".join(t))
    prints = sorted(set(editprint.as_strings(editprint.walk(texts))))
    m = editprint.as_rows(prints)
    u, v = np.triu_indices(len(prints), 1)
    ok = editprint.likeness(m[u], m[v]) >= 0.85
    want = simhash.forest(u[ok], v[ok], len(prints))
    table = spark.createDataFrame([(n, p) for n, p in enumerate(prints)], "id long, fingerprint string")
    for limit in (8192, 1):
        got = dict(rows(editprint.classes_of(table, 0.85, bucket_limit=limit)))
        assert [got[p] for p in prints] == want.tolist() and 6 <= len(set(want.tolist())) < len(prints)


def test_fingerprints_of_very_long_texts_and_repeated_rows(spark):
    long = "some words here. " * 120_000
    data = [(1, long), (1, long), (2, long[:-5]), (3, None), (3, None)]
    got = editprint.with_classes(editprint.fingerprints_with_edits(spark.createDataFrame(data, TEXT), partitions=3)).collect()
    assert sorted((r.doc_id, r.n_chars, r.class_id) for r in got) == [(1, len(long), 1), (1, len(long), 1), (2, len(long) - 5, 1), (3, 0, 3), (3, 0, 3)]


def test_similar_documents(spark):
    base = "".join(random.Random(3).choices("abcdefgh ", k=800))
    data = [(7, base), (5, base), (9, base[:790] + "x" * 10), (1, "".join(random.Random(9).choices("rstuvwxyz ", k=800)))]
    got = dict(rows(editprint.similar_documents(spark.createDataFrame(data, TEXT))))
    assert got[7] == got[5] == got[9] == 5 and got[1] == 1


# ---- packing ----


def test_packing_round_trip(spark):
    tok = Tokenizer.from_file(BYTE)
    rng = random.Random(5)
    data = ODD + [(100 + i, " ".join(rng.choices(["alpha", "beta.", "gamma!", "don't", "<|endoftext|>", "x\n\n y", "  z"], k=rng.choice([1, 30, 900])))) for i in range(60)]
    df = spark.createDataFrame(data, TEXT).coalesce(2)
    found = packing.pack(df, BYTE).collect()
    want = collections.Counter()
    for i, t in data:
        want[i] += len(tok.encode(t or "", add_special_tokens=False).ids) + 1
    have = collections.Counter()
    for r in found:
        have[r.doc_id] += r.length
    assert want == have
    by_sequence = collections.defaultdict(list)
    for r in found:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 1024
    text = dict(data)
    for r in found:
        if r.doc_id is not None and r.doc_id >= 100:
            ids = np.array([*tok.encode(text[r.doc_id], add_special_tokens=False).ids, 0], "<u4")
            assert r.doc_tokens == len(ids) and zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    assert rows(packing.pack(empty(spark), BYTE)) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 100), st.sampled_from([0.0, 1.0, 8.0])), min_size=1, max_size=40))
def test_windows_are_the_cheapest(steps):
    width, cut = 128, 8.0
    places, costs = [0], [0.0]
    for s, c in steps:
        places.append(places[-1] + s)
        costs.append(c)

    def pad(n):
        return 0 if n in (32, 64) or n == width else width - n

    least = [0.0] + [float("inf")] * len(steps)
    for j in range(1, len(places)):
        for i in range(j):
            n = places[j] - places[i]
            if n <= width:
                least[j] = min(least[j], least[i] + pad(n) + costs[j])
            elif n <= 2 * width:
                least[j] = min(least[j], least[i] + 2 * width - n + cut + costs[j])
    ends = packing.best_windows(places, costs, width, cut)
    price, at, known = 0.0, 0, dict(zip(places, costs))
    for e in ends:
        assert 0 < e - at <= width
        price += (width - (e - at) if at not in known else pad(e - at)) + known.get(e, cut)
        at = e
    assert at == places[-1] and price <= least[-1] + 1e-9


# ---- licences ----


def test_licenses(spark):
    data = [(1, "code\nReleased under the MIT License.\nmore"), (2, "licensed under the apache license version 2.0"), (3, "MIT is a school"), (4, None), (5, "")]
    got = {r.doc_id: r.license for r in licenses.scan(spark.createDataFrame(data, TEXT)).collect() if r.doc_id in (1, 2, 3)}
    assert got == {1: "MIT", 2: "Apache-2.0", 3: None}
    assert licenses.scan(spark.createDataFrame(ODD, TEXT)).where("n_hits > 0").count() == 0


def brute_licenses(text, templates, threshold=0.8):
    """All runs of words against all templates, then the best that don't overlap."""
    w = licenses.words(text)
    found = []
    for a in range(len(w)):
        for b in range(a + 2, len(w) + 1):
            for name, t in templates:
                grams = licenses.bigrams(licenses.words(t))
                d = licenses.dice(licenses.bigrams(w[a:b]), grams)
                if d >= threshold:
                    found.append((-d * sum((licenses.bigrams(w[a:b]) & grams).values()), b - a - 1, a, name, d))
    out, used = [], set()
    for _, size, first, name, d in sorted(found):
        if used.isdisjoint(range(first, first + size + 1)):
            used.update(range(first, first + size + 1))
            out.append((first, name, d))
    return [(name, d) for _, name, d in sorted(out)]


SHORT = [t for t in licenses.TEMPLATES if len(t[1]) < 80]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("released under the mit license licensed cc by nc 4.0 apache version 2.0 foo".split()), max_size=9), max_size=4))
def test_license_pruning_loses_nothing(parts):
    text = "\n".join(" ".join(p) for p in parts)
    assert [(n, pytest.approx(d)) for n, _, _, d in licenses.Scanner(SHORT).scan(text)] == brute_licenses(text, SHORT)


def test_every_license_text_is_found_as_itself(spark):
    rng = random.Random(3)
    noise = lambda: " ".join(f"w{rng.randint(0, 999)}" for _ in range(60))
    data = [(i, f"{noise()}\n/* {t} */\n{noise()}") for i, (_, t) in enumerate(licenses.TEMPLATES)] + [(900, None), (901, None), (902, "w " * 1_000_000 + licenses.TEMPLATES[2][1])]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(data, TEXT)).collect()}
    for i, (name, _) in enumerate(licenses.TEMPLATES):
        assert (got[i].license, got[i].dice, got[i].n_hits) == (name, 1.0, 1), name
    assert got[902].license == "Apache-2.0" and got[900].license is None and licenses.scan(empty(spark)).count() == 0


def test_ties_go_to_the_first_template_by_name():
    scanner = licenses.Scanner([("B", "alpha beta gamma"), ("A", "alpha beta gamma")])
    assert [x[0] for x in scanner.scan("alpha beta gamma; alpha beta gamma")] == ["A", "A"]


def test_licenses_whatever_the_lines(spark):
    long = next(t for n, t in licenses.TEMPLATES if n == "GPL-3.0" and "either version" in t).split()
    data = [
        (1, "This project is released under the MIT License and all rights are reserved."),
        (2, "\n\n".join(" ".join(long[k : k + 3]) for k in range(0, len(long), 3))),
        (3, "words " * 500 + "licensed under CC BY-NC 4.0 " + "words " * 500),
        (4, "This project is released and all rights are reserved."),
    ]
    got = {r.doc_id: (r.license, r.n_hits) for r in licenses.scan(spark.createDataFrame(data, TEXT)).collect()}
    assert got == {1: ("MIT", 1), 2: ("GPL-3.0", 1), 3: ("CC-BY-NC-4.0", 1), 4: (None, 0)}


# ---- lines ----


def brute_lines(data, least=1):
    docs = []
    for i, t in sorted(((i, t or "") for i, t in data), key=lambda x: (x[0] is not None, x[0] or 0, hashlib.md5(x[1].encode()).digest())):
        parts = t.split("\n")
        docs.append((i, [(p, x.strip(" ")) for p, x in enumerate(parts) if x.strip(" ")], parts))
    size = max(len(ls) for _, ls, _ in docs)
    count = collections.Counter(tuple(x for _, x in ls[k : k + n]) for _, ls, _ in docs for n in range(1, size + 1) for k in range(len(ls) - n + 1))
    seen, out = set(), []
    gone = collections.defaultdict(set)
    for d, (_, ls, _) in enumerate(docs):
        for k in range(len(ls) - least + 1):
            key = tuple(x for _, x in ls[k : k + least])
            if key in seen:
                gone[d].update(p for p, _ in ls[k : k + least])
            seen.add(key)
    for d, (i, ls, parts) in enumerate(docs):
        runs = [max((n for n in range(1, len(ls) - k + 1) if count[tuple(x for _, x in ls[k : k + n])] > 1), default=0) for k in range(len(ls))]
        starts = sum(r > 0 and (k == 0 or runs[k - 1] != r + 1) for k, r in enumerate(runs))
        left = "\n".join(x for p, x in enumerate(parts) if p not in gone[d])
        out.append((i, len(ls), len(gone[d]), hashlib.sha256(left.encode()).hexdigest(), max(runs, default=0), starts))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [1, 2, 3])
def test_lines(spark, least):
    rng = random.Random(2)
    pool = ["a", "b c", " d ", "", "one two three four five six seven eight", "e"]
    data = ODD + [(10 + i, "\n".join(rng.choices(pool, k=rng.randint(0, 9)))) for i in range(25)]
    runs = [[f"r{n} {k}" for k in range(n)] for n in range(1, 21)]
    for i in range(40):
        parts = [str(rng.random()) for _ in range(rng.randint(0, 4))]
        for r in rng.sample(runs, 2):
            at = rng.randint(0, len(parts))
            parts[at:at] = r[: rng.randint(1, len(r))]
        data.append((100 + i, "\n".join(parts)))
    data += data[-3:]
    assert rows(lines.dedup(spark.createDataFrame(data, TEXT), least, digest=True)) == brute_lines(data, least)


def test_lines_of_odd_tables(spark):
    assert rows(lines.dedup(empty(spark), digest=True)) == []
    clash = spark.createDataFrame([(1, "a\nb", 7), (2, "a\nb", 8), (3, None, 9)], "doc_id long, text string, n_removed int")
    assert rows(lines.dedup(clash).select("doc_id", "text", "n_removed")) == [(1, "a\nb", 7), (2, "", 8), (3, None, 9)]
    long = "\n".join(f"line {i % 50_000}" for i in range(60_000)) + "\n" + "w " * 500_000
    got = rows(lines.dedup(spark.createDataFrame([(5, long), (4, "line 1")], TEXT), digest=True))
    assert [(i, n, r, longest) for i, n, r, _, longest, _ in got] == [(4, 1, 0, 1), (5, 60_001, 10_001, 10_000)]


# ---- SimHash ----


def brute_simhash(data):
    import xxhash

    prints = []
    for i, t in data:
        w = [x.lower() for x in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())]
        h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
        prints.append((i, sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))))
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if bin(prints[a][1] ^ prints[b][1]).count("1") <= 2:
                root[find(a)] = find(b)
    low = collections.defaultdict(list)
    for n, (i, _) in enumerate(prints):
        if i is not None:
            low[find(n)].append(i)
    return sorted(((i, f"{p:016x}", min(low[find(n)], default=None)) for n, (i, p) in enumerate(prints)), key=str)


@pytest.mark.parametrize("limit", [8192, 1])
def test_simhash(spark, limit):
    rng = random.Random(8)
    base = [rng.choice("abcdefgh") + str(rng.randint(0, 50)) for _ in range(400)]
    data = list(ODD)
    for i in range(120):
        w = list(base) if i % 3 else [str(rng.random()) for _ in range(50)]
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = "q" + str(rng.random())
        data.append((1000 - i, " ".join(w)))
    got = simhash.near_duplicates(spark.createDataFrame(data, TEXT), bucket_limit=limit)
    want = brute_simhash(data)
    assert sorted(((r.doc_id, r.fingerprint.hex(), r.component_id) for r in got.collect()), key=str) == want
    assert len({c for _, _, c in want}) < len({f for _, f, _ in want})


def test_wide_simhash_groups_near_copies(spark):
    rng = random.Random(1)
    base = [str(rng.random()) for _ in range(300)]
    data = []
    for i in range(20):
        w = list(base)
        for _ in range(i % 4):
            w[rng.randrange(300)] = str(rng.random())
        data.append((i, " ".join(w)))
    data += [(100 + i, " ".join(str(rng.random()) for _ in range(200))) for i in range(20)]
    p = simhash.Pivots(4, tuple(simhash.sampled_segments(4, 48, 16)))
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(data, TEXT), 5, 4, 44, p).collect()}
    assert all(got[i] == 0 for i in range(20)) and all(got[i] == i for i in range(100, 120))
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_wide_simhash_loses_no_pair_of_a_large_bucket(spark):
    """Bases with copies that differ in 30 to 44 bits; whatever shares one of the 48 keys is compared, whatever the bucket's size."""
    rng = np.random.default_rng(5)
    fps = []
    for _ in range(20):
        base = rng.integers(0, 2, 256)
        for d in (0, 30, 38, 44):
            bits = base.copy()
            bits[rng.choice(256, d, replace=False)] ^= 1
            fps.append(np.packbits(bits).tobytes())
    fps = sorted(set(fps))
    pivots = simhash.Pivots(4, tuple(simhash.sampled_segments(4, 48, 16)))
    x = np.frombuffer(b"".join(fps), ">u8").astype(np.uint64).reshape(-1, 4)
    keys = [pivots.key(x, j, m) for j, m in enumerate(pivots.segments)]
    pairs = [(a, b) for a in range(len(fps)) for b in range(a) if np.bitwise_count(x[a] ^ x[b]).sum() <= 44 and any(k[a] == k[b] for k in keys)]
    want = simhash.forest(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]), len(fps))
    table = spark.createDataFrame([(f,) for f in fps], "fp binary")
    for limit in (8192, 1):
        links = simhash.fingerprint_links(table, pivots, 44, limit).collect()
        at = {f: n for n, f in enumerate(fps)}
        got = simhash.forest(np.array([at[bytes(r.a)] for r in links]), np.array([at[bytes(r.b)] for r in links]), len(fps))
        assert len(pairs) > 20 and np.array_equal(got, want), limit


def test_components(spark):
    rng = random.Random(6)
    links = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(200 + i, 201 + i) for i in range(40)] + [(0, 500 + i) for i in range(50)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        return x if root[x] == x else find(root[x])

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = dict(rows(components(spark.createDataFrame(links, "a long, b long"))))
    assert got == {x: find(x) for x in root if any(x in (a, b) and a != b for a, b in links)}


# ---- substrings ----


def brute_windows(data, size):
    words = [(i, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for i, t in data]
    count = collections.Counter(tuple(w[k : k + size]) for _, w in words for k in range(len(w) - size + 1))
    out = []
    for i, w in words:
        away = {x for k in range(len(w) - size + 1) if count[tuple(w[k : k + size])] > 1 for x in range(k, k + size)}
        kept = [x for k, x in enumerate(w) if k not in away]
        out.append((i, len(w), len(away), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [35, 70, 6, 2])
def test_substrings(spark, size):
    rng = random.Random(size)
    shared = [[rng.choice("abcdef") + str(rng.randint(0, 9)) for _ in range(rng.choice([size - 1, size, 3 * size]))] for _ in range(6)]
    data = list(ODD)
    for i in range(40):
        w = [str(rng.random()) for _ in range(rng.randint(0, 30))]
        for s in rng.sample(shared, rng.randint(0, 2)):
            at = rng.randint(0, len(w))
            w[at:at] = s
        data.append((50 + i, rng.choice([" ", "\n", "\t "]).join(w)))
    data += data[-3:]
    assert rows(substring.dedup(spark.createDataFrame(data, TEXT), size, digest=True)) == brute_windows(data, size)


def test_substrings_empty_and_clashes(spark):
    assert rows(substring.dedup(empty(spark), digest=True)) == []
    long = " ".join(map(str, range(40)))
    df = spark.createDataFrame([(1, long, 5), (2, "x " + long, 6), (3, None, 7)], "doc_id long, text string, starts int")
    assert rows(substring.dedup(df)) == [(1, "", 5, 40), (2, "x", 6, 40), (3, None, 7, 0)]


def test_substrings_of_a_very_long_text(spark):
    rng = random.Random(1)
    w = [str(rng.random()) for _ in range(150_000)]
    data = [(1, " ".join(w + w[500:600])), (2, " ".join(w[100_000:100_034])), (3, "q" * 2_000_000), (4, " ".join(["same"] * 300_000))]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring.dedup(spark.createDataFrame(data, TEXT), digest=True).collect()}
    assert got == {1: (150_100, 200), 2: (34, 0), 3: (1, 0), 4: (300_000, 300_000)}


def test_substring_levels():
    assert substring.level_lengths(35) == [9, 18] and substring.level_lengths(70) == [9, 18, 35] and substring.level_lengths(2) == [1]


# ---- BPE ----


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from(list("abcdeé'’sStTrReE vVlLdDmM  \n0123½!?.,ßΣİ日́ẞ\U0001f600")), max_size=60))
def test_bpe_matches_the_library(text):
    tok = _library()
    ids, decoded = bpe.coder(WORD).encode_batch([text])
    want = tok.encode(text, add_special_tokens=False).ids
    assert ids[0].tolist() == want and decoded[0] == tok.decode(want, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=30))
def test_bpe_matches_the_library_on_any_characters(text):
    test_bpe_matches_the_library.hypothesis.inner_test(text)


def test_bpe_matches_the_library_on_marks_and_unassigned_points():
    import unicodedata

    rng = random.Random(1)
    marks = [chr(i) for i in range(0x20000) if unicodedata.category(chr(i))[0] == "M"]
    free = [chr(i) for i in range(0x20000) if unicodedata.category(chr(i)) == "Cn"]
    texts = ["a" + rng.choice(marks) + rng.choice(marks) + "o " + rng.choice(free) for _ in range(20_000)]
    ids, decoded = bpe.coder(WORD).encode_batch(texts)
    want = [e.ids for e in _library().encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in ids] == want and decoded == [_library().decode(x, skip_special_tokens=False) for x in want]


_KEPT = []


def _library():
    if not _KEPT:
        _KEPT.append(Tokenizer.from_file(WORD))
    return _KEPT[0]


def test_bpe_rows(spark):
    data = [*ODD, (8, "<|endoftext|>Hi<|startoftext|> there"), (9, "It's 's ''s don''t WE'LL"), (10, "the" * 3000)]
    got = {(r.doc_id, r.n_tokens, tuple(r.ids), r.decoded) for r in bpe.encode_decode(spark.createDataFrame(data, TEXT), WORD).collect()}
    want = set()
    for i, t in data:
        ids = _library().encode(t or "", add_special_tokens=False).ids
        want.add((i, len(ids), tuple(ids), _library().decode(ids, skip_special_tokens=False)))
    assert got == want
    assert rows(bpe.encode_decode(empty(spark), WORD, digests=True)) == []


def test_byte_level_stream_matches_the_library():
    tok, coder = Tokenizer.from_file(BYTE), packing.coder(BYTE)
    rng = random.Random(3)
    texts = ["".join(rng.choice("abs'tT  \n\t01!?.é日\U0001f600") for _ in range(rng.randint(0, 50))) for _ in range(800)]
    flat, ends, _ = coder.stream(texts, 0)
    start = 0
    for t, e in zip(texts, ends.tolist()):
        assert flat[start:e].tolist() == [*tok.encode(t, add_special_tokens=False).ids, 0]
        start = e


# ---- URLs ----

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/")]


def brute_url(url, blocked):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = lambda h: host == h or host.endswith("." + h)
    best = max(((len(h + p), h + p, v) for v, h, p in RULES if fits(h) and path.startswith(p)), default=None)
    return host, path, best and best[1], best[2] if best else "block" if any(map(fits, blocked)) else "allow"


def test_urls(spark):
    hosts = ["WWW.example.com", "example.com", "xexample.com", "a.b.net", "net", "bad.org", "x.bad.org", "", "com", "é.com:80"]
    paths = ["", "/", "/en/", "/en", "/es/x?y=/en/", "?q=://z", "#/en/", "/EN/"]
    data = [(n, u) for n, u in enumerate([None, "", "nothing", "a://", *(f"http://{h}{p}" for h in hosts for p in paths)])]
    df = spark.createDataFrame(data * 2, "page_id long, url string")
    want = sorted(((i, *brute_url(u, ["bad.org"])) for i, u in data * 2), key=str)
    assert rows(urls.judge_urls(df, RULES, ["bad.org"])) == want
    assert rows(urls.judge_urls(df.limit(0), RULES)) == []


def test_colliding_digests_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(urls, "digest", lambda keys: np.zeros(len(list(keys)), np.uint64))
    urls.DigestArray.write(str(tmp_path), {"a.com/": 0, "b.com/": 0, "c.com": 1}, [1])
    array = urls.DigestArray(str(tmp_path))
    got = array.probe(["b.com/", "zz", "c.com", "a.com/"])
    assert got[1] == -1 and len({*got.tolist()}) == 4


# ---- toxicity ----


def test_toxicity_learns_and_folds(spark):
    rng = random.Random(4)
    clean, bad = [f"w{i}or" for i in range(200)], ["vilekin", "grumbo"]
    data, labels = [], []
    for i in range(300):
        w = rng.choices(clean, k=40)
        if i % 5 == 0:
            w[rng.randrange(40)] = rng.choice(bad) + rng.choice(["", "s", "ish"])
        data.append((i, " ".join(w)))
        labels.append((i, int(i % 5 == 0)))
    data += [(900, None), (901, ""), (902, "v1lekin"), (903, "VІLEKIN you"), (904, " ".join(clean[:40])), (904, " ".join(clean[:40]))]
    docs = spark.createDataFrame(data, TEXT)
    model = toxicity.learn(docs, spark.createDataFrame([*labels, (1000, 1), (0, None)], "doc_id long, toxic int"))
    assert {e.strip()[:5] for e in model.entries} <= {"vilek", "grumb"} and len(model.entries) >= 2
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all(0 <= r.score <= 1 for r in got.values())
    assert all(got[i].predicted == y for i, y in labels)
    assert [got[i].predicted for i in (900, 901, 902, 903, 904)] == [0, 0, 1, 1, 0]


def test_toxicity_exceptions_and_no_labels(spark):
    model = toxicity.Model({" clown ": 5.0}, (-2.0, 2.0, 0.5), ("clown fish",))
    assert model.measure("a clown fish")[1] == 0 and model.measure("a clown, a fish")[1] == 1
    none = toxicity.learn(empty(spark), spark.createDataFrame([], "doc_id long, toxic int"))
    assert not none.entries and toxicity.score(spark.createDataFrame(ODD, TEXT), none).count() == len(ODD)
    kept = toxicity.score(spark.createDataFrame([(1, "x", 2.0)], "doc_id long, text string, score double"), model, keep=True)
    assert kept.columns == ["doc_id", "text", "score", "tox_score", "tox_hits", "tox_predicted"]


def brute_measure(model, text):
    """Every place of the folded text against every entry; the heaviest entry at a place counts unless a phrase covers its start."""
    folded = f" {toxicity.fold(text)} "
    spared = {k + i for p in model.exceptions for k in range(len(folded)) if folded.startswith(f" {p} ", k) for i in range(len(p) + 1)}
    best = [max((w for e, w in model.entries.items() if folded.startswith(e, k)), default=0.0) for k in range(len(folded)) if k not in spared]
    return sum(best), sum(b > 0 for b in best), len(folded.split())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("clown fish cl0wn clówn CLOWNS сlown idi0t idiot proof trash $can can tr@sh . clownish".split(" ")), max_size=12))
def test_toxicity_matching_is_the_plain_search(parts):
    model = toxicity.Model({" clown ": 5.0, " clow": 2.0, " idiot": 3.0, " trash ": 1.0}, exceptions=("clown fish", "trash can"))
    assert model.measure(" ".join(parts)) == pytest.approx(brute_measure(model, " ".join(parts)))


def test_toxicity_learns_exceptions_and_keeps_clashing_columns(spark):
    rng = random.Random(5)
    data, labels = [], []
    for i in range(300):
        w = [f"w{rng.randint(0, 200)}or" for _ in range(40)]
        kind = i % 6
        if kind == 0:
            w[10] = "vilekin"
        if i % 30 == 1:
            w[10:12] = ["vilekin", "tree"]
        data.append((i, " ".join(w), 1))
        labels.append((i, int(kind == 0)))
    docs = spark.createDataFrame([*data, (900, "q " * 1_000_000 + "vilekin", 1), (901, None, 1)], "doc_id long, text string, tox_predicted int")
    model = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert "vilekin tree" in model.exceptions
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.select("doc_id").collect()} >= {1, 31, 900, 901} and kept.where("doc_id % 6 = 0 and doc_id < 300").count() == 0


def test_spanning_links_join_what_all_pairs_join():
    rng = np.random.default_rng(1)
    for _ in range(30):
        n = int(rng.integers(1, 400))
        keys = np.sort(rng.integers(0, rng.integers(1, 6), n))
        place = rng.integers(0, rng.integers(2, 3000), n)
        u, v = np.triu_indices(n, 1)
        linked = (keys[u] == keys[v]) & (np.abs(place[u] - place[v]) <= 3)
        want = simhash.forest(u[linked], v[linked], n)
        child, root = simhash.spanning_links(keys, lambda a, b, p=place: np.abs(p[a] - p[b]) <= 3)
        assert np.array_equal(simhash.forest(child, root, n), want)
        assert len(child) == n - len(set(want.tolist()))


def test_spanning_links_leave_out_what_labels_join():
    rng = np.random.default_rng(2)
    for _ in range(30):
        n = int(rng.integers(1, 300))
        keys = np.sort(rng.integers(0, rng.integers(1, 6), n))
        place = rng.integers(0, rng.integers(2, 3000), n)
        labels = rng.integers(0, max(1, n // 2), n)
        u, v = np.triu_indices(n, 1)
        same = (keys[u] == keys[v]) & (labels[u] == labels[v])
        linked = (keys[u] == keys[v]) & (np.abs(place[u] - place[v]) <= 3)
        want = simhash.forest(u[linked | same], v[linked | same], n)
        before = simhash.forest(u[same], v[same], n)
        child, root = simhash.spanning_links(keys, lambda a, b, p=place: np.abs(p[a] - p[b]) <= 3, labels)
        assert np.array_equal(simhash.forest(np.concatenate((child, u[same])), np.concatenate((root, v[same])), n), want)
        assert len(child) == len(set(before.tolist())) - len(set(want.tolist()))


def test_hot_keys_join_like_others(spark):
    rows = spark.range(6000).select(F.when(F.col("id") % 2 == 0, F.lit("hot")).when(F.col("id") % 7 != 0, F.concat(F.lit("k"), F.col("id") % 900)).alias("w"), "id")
    facts = written(rows.where("w is not null").groupBy("w").agg(F.count("*").alias("many"), F.min("id").alias("first")).where("many > 3"), "facts")
    assert facts.df.where("many * 1000 > 6000").count() and facts.df.where("many * 1000 <= 6000").count()
    got = join_counted(rows, facts.df, ["w"], 6000)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(facts.df, ["w"]).collect()))


# ---- pieces whose hashes collide ----


def thue_morse(n):
    word = "ab"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_colliding_pieces_have_their_own_ids(spark, n):
    """Words that a polynomial hash modulo 2**64 can't tell apart, in one batch, in two and after each other."""
    word = thue_morse(n)
    other = word.translate(str.maketrans("ab", "ba"))
    texts = [word, other, f"{other} {word} {other}", "ab", word]
    df = spark.createDataFrame(list(enumerate(texts)), TEXT).coalesce(1)
    library = Tokenizer.from_file(WORD)
    library.no_truncation()
    library.no_padding()
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    got = [r.ids for r in bpe.encode_decode(df, WORD).orderBy("doc_id").collect()]
    assert got == want
    pieces = packing.pack(df, BYTE).orderBy("doc_id", "start").collect()
    library = Tokenizer.from_file(BYTE)
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4")
        assert [r.ids_crc32 for r in pieces if r.doc_id == i] == [zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in pieces if r.doc_id == i]


def test_equal_hashes_never_share_a_row(monkeypatch):
    """Every piece has the same hash here; rows still follow the characters."""
    from taxoloom.llm import _pieces

    monkeypatch.setattr(_pieces, "slice_hashes", lambda codes, starts, ends: np.zeros(len(starts), np.uint64))
    monkeypatch.setattr(_pieces, "mix", lambda x: x * np.uint64(0))
    table = _pieces.PieceTable(lambda piece: ([len(piece)], piece))
    words = ["ab", "aa", "b", "abcd", "abce", "abc", "abcdabcdabcdé", "abcdabcdabcde", "x" * 1000, "x" * 999 + "y", "y" + "x" * 999, "x" * 1001, "\0\0\0\0", "\0\0\0"]
    words += [f"word{i}" for i in range(200)] + words
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    for _ in range(2):
        assert [table.extra[r] for r in table.lookup(codes, starts, ends)] == words
    assert len(table.extra) == len(set(words))
