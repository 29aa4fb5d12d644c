"""The pipeline on a small corpus with planted cases, nulls and clashing columns."""

import random

import corpus_pipeline
from taxoloom.llm import simhash


def _corpus(spark, folder):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9)))
    docs, labels = [], []
    for i in range(120):
        text = "\n".join(" ".join(word() for _ in range(12)) for _ in range(6))
        if i % 6 == 0:
            text += " nastyword"
        docs.append((i, text))
        labels.append((i, 1, int(i % 6 == 0)))
    passage = " ".join(word() for _ in range(60))
    docs[1] = (1, docs[1][1] + " " + passage)
    docs[2] = (2, passage + " " + docs[2][1])
    docs += [(200, docs[7][1]), (201, docs[8][1].replace(" ", "  ", 1)), (300, None), (301, "")]
    rows = [(i, t, "en", "s", len(t or ""), 1) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_removed int").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return passage


def test_stages(spark, tmp_path):
    passage = _corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
    ids = lambda name: {r.doc_id for r in kept[name]}
    assert not ids("toxicity") & set(range(0, 120, 6)) and ids("toxicity") >= {1, 2, 7, 8, 200, 300, 301}
    texts = {r.doc_id: r.text for r in kept["line_dedup"]}
    assert texts[200] == "" and texts[7]
    assert {1, 2, 7, 8} <= ids("simhash_near_dedup") and len({200, 300, 301} & ids("simhash_near_dedup")) == 1
    assert passage in {r.doc_id: r.text for r in kept["line_dedup"]}[1]
    assert all(passage not in (r.text or "") for r in kept["substring_dedup"])
    assert {r.doc_id for r in kept["packing"]} == ids("substring_dedup")


def test_run_and_empty(spark, tmp_path):
    _corpus(spark, tmp_path)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name


def _pair(rng, n, shared):
    """Two texts of n and n shingles of five words, of which ``shared`` are common."""
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=8))
    common = [word() for _ in range(shared + 4)]
    return [" ".join(common + [word() for _ in range(n - shared)]) for _ in range(2)]


def test_near_copies_are_those_of_jaccard_four_fifths(spark):
    rng = random.Random(12)
    data = []
    for i in range(60):
        n = 18 * rng.randint(3, 12)
        for k, shared in ((0, n * 16 // 18), (1000, n * 15 // 18)):  # 16/20 and 15/21
            data += [(k + 2 * i + j, t) for j, t in enumerate(_pair(rng, n, shared))]
    rng.shuffle(data)
    for limits in ({}, {"bucket_limit": 1, "block_shingles": 100}):
        docs = spark.createDataFrame(data if not limits else [x for x in data if x[0] % 1000 < 16], "doc_id long, text string")
        segments = simhash.sampled_segments(4, corpus_pipeline.NEAR_BANDS, corpus_pipeline.NEAR_BITS)
        kept = corpus_pipeline.drop_near_copies(spark, docs, "") if not limits else simhash.keep_one(docs, 5, 4, corpus_pipeline.NEAR_RADIUS, segments, **limits)
        want = {i for i in (r.doc_id for r in docs.collect()) if i >= 1000 or i % 2 == 0}
        assert {r.doc_id for r in kept.collect()} == want


def test_near_copies_are_chosen_by_row(spark):
    rng = random.Random(13)
    a, b, c, d, e = (" ".join("".join(rng.choices("abcdefgh", k=8)) for _ in range(60)) for _ in range(5))
    data = [(None, a), (None, b), (None, c + " x"), (4, c), (4, d), (9, d + " y"), (9, e), (9, e)]
    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(data, "doc_id long, text string"), "")
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted([(None, a), (None, b), (4, c), (4, d), (9, e)], key=str)


def test_later_copies_of_short_lines_go(spark):
    data = [(1, "first text\nread more here\nend one"), (2, "second text\nread more here\nend two"), (3, "x\nread more here\nx")]
    got = corpus_pipeline.drop_repeated_lines(spark, spark.createDataFrame(data, "doc_id long, text string"), "")
    assert sorted(tuple(r) for r in got.collect()) == [(1, data[0][1]), (2, "second text\nend two"), (3, "x")]
