"""Clusterings of many nodes at once against the same steps in numpy on one node, and single links against merging."""

import numpy as np
import pytest

from taxoloom.operators import clustering, learning


def brute_k_means(ids, x, k, rounds=20):
    """Far-first start, then nearest centres and means, on one node in memory."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    order = np.argsort(ids)
    picked = [order[0]]
    while len(picked) < k:
        like = np.round(unit @ unit[picked].T, 9).max(1)
        picked.append(min(range(len(ids)), key=lambda i: (like[i], ids[i])))
    centres, before = unit[picked], None
    for _ in range(rounds):
        labels = np.round(unit @ centres.T, 9).argmax(1)
        if before is not None and (labels == before).all():
            break
        before = labels
        centres = np.stack([unit[labels == j].sum(0) if (labels == j).any() else centres[j] for j in range(k)])
        centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    return dict(zip(ids.tolist(), labels.tolist()))


def frame(spark, nodes):
    rows = [(node, int(i), v.tolist()) for node, (ids, x) in nodes.items() for i, v in zip(ids, x)]
    return spark.createDataFrame(rows, "node_id long, term_id long, emb array<double>")


def made(sizes, dims=6, seed=0):
    rng = np.random.default_rng(seed)
    return {node: (rng.permutation(10 * n)[:n], rng.normal(size=(n, dims)) + 3 * rng.normal(size=(5, dims))[rng.integers(0, 5, n)]) for node, n in sizes.items()}


def test_k_means_of_a_level(spark):
    """Nodes of very unlike sizes, one with fewer terms than clusters; the same rows at any partitioning."""
    nodes = made({0: 700, 3: 40, 5: 5, 8: 3})
    df = frame(spark, nodes)
    got = {(r.node_id, r.term_id): r.label for r in clustering.k_means(df.repartition(5)).collect()}
    assert got == {(r.node_id, r.term_id): r.label for r in clustering.k_means(df.coalesce(1)).collect()}
    for node, (ids, x) in nodes.items():
        want = brute_k_means(ids, x, 5) if len(ids) >= 5 else {int(t): i for i, t in enumerate(sorted(ids))}
        assert {t: label for (n, t), label in got.items() if n == node} == want, node


def test_k_means_of_odd_vectors(spark):
    """Zero, equal and missing vectors, and no rows at all."""
    rows = [(0, i, [0.0, 0.0]) for i in range(3)] + [(0, i, [1.0, 1.0]) for i in range(3, 9)] + [(0, 10, None), (0, 11, [None, 1.0])]
    df = spark.createDataFrame(rows, "node_id long, term_id long, emb array<double>")
    got = {r.term_id: r.label for r in clustering.k_means(df, 3).collect()}
    assert got == dict.fromkeys(range(9), 0)
    more = df.union(spark.createDataFrame([(0, 20, [1.0, -1.0])], df.schema))
    assert {r.term_id: r.label for r in clustering.k_means(more, 3).collect()} == {**dict.fromkeys(range(9), 0), 20: 1}
    assert clustering.k_means(df.limit(0), 3).count() == 0
    plain = {r.term_id: r.label for r in clustering.k_means(spark.createDataFrame([(0, i, [float(x)]) for i, x in enumerate([1, 2, 3, 90, 91, 92])], "node_id long, term_id long, emb array<double>"), 2, "euclidean").collect()}
    assert plain == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 1}


def test_jobs_do_not_grow_with_nodes(spark):
    def jobs(nodes):
        group = f"level-{nodes}"
        spark.sparkContext.setJobGroup(group, "")
        clustering.k_means(frame(spark, made({n: 20 for n in range(nodes)}, seed=nodes)), most_rounds=3).count()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(12) <= jobs(1) + 4


@pytest.mark.parametrize("block", [2048, 16])
def test_single_links(spark, monkeypatch, block):
    """As merging the two nearest clusters until k are left; nodes in one block and in many."""
    monkeypatch.setattr(clustering, "BLOCK", block)
    nodes = made({0: 150, 1: 4, 2: 1}, seed=4)
    nodes[0] = (nodes[0][0], nodes[0][1] * 1.0)
    got = {(r.node_id, r.term_id): r.label for r in learning.cluster_nodes(frame(spark, nodes), 5).collect()}
    for node, (ids, x) in nodes.items():
        order = np.argsort(ids)
        want = learning.agglomerate(x[order], 5, "single") if len(ids) > 5 else np.arange(len(ids))
        assert [got[node, int(t)] for t in ids[order]] == want.tolist(), node


def test_least_spanning_tree(spark):
    nodes = made({0: 60}, seed=9)
    ids, x = nodes[0]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    edges = sorted((1 - unit[i] @ unit[j], i, j) for i in range(60) for j in range(i))
    part, total = list(range(60)), 0.0
    for d, i, j in edges:
        if part[i] != part[j]:
            total += d
            part = [part[i] if p == part[j] else p for p in part]
    got = clustering.spanning_forest(frame(spark, nodes)).collect()
    assert len(got) == 59 and sum(r.distance for r in got) == pytest.approx(total, abs=1e-5)


def test_equal_vectors_link_first(spark):
    rows = [(0, i, [1.0, float(i // 3)]) for i in range(9)]
    df = spark.createDataFrame(rows, "node_id long, term_id long, emb array<double>")
    assert {r.term_id: r.label for r in clustering.single_link(df, 3).collect()} == {i: i // 3 for i in range(9)}
    with pytest.raises(Exception, match="take single"):
        learning.MOST, kept = 5, learning.MOST
        try:
            learning.cluster_nodes(df, 3, "complete").collect()
        finally:
            learning.MOST = kept


@pytest.mark.parametrize("last", [0, 300, 1 << 20])
def test_single_links_of_equal_distances(spark, monkeypatch, last):
    """Copies and right angles, so that ids decide; blocks of 16, edges left for a node's task none, some and all."""
    monkeypatch.setattr(clustering, "BLOCK", 16)
    monkeypatch.setattr(clustering, "LAST", last)
    rng = np.random.default_rng(2)
    ids, x = rng.permutation(400)[:90], np.eye(4)[rng.integers(0, 4, 90)] * rng.choice([1.0, -1.0], (90, 1))
    more = made({7: 120}, seed=6)[7]
    df = frame(spark, {0: (ids, x), 7: (more[0], more[1][:, :4]), 9: (np.array([5]), np.ones((1, 4)))})
    found = sorted((r.node_id, r.distance, r.a, r.b) for r in clustering.spanning_forest(df.repartition(3)).collect())
    rows = {}
    for r in df.collect():
        rows.setdefault(r.node_id, []).append((r.term_id, r.emb))
    want = []
    for node, pairs in rows.items():
        t, v = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
        v = np.rint(np.rint(v / np.linalg.norm(v, axis=1, keepdims=True) * clustering.SCALE) / clustering.SCALE * clustering.UNIT)
        edges = sorted((1 - v[i] @ v[j] / clustering.UNIT**2, int(min(t[i], t[j])), int(max(t[i], t[j]))) for i in range(len(t)) for j in range(i))
        part = {int(i): int(i) for i in t}
        for d, a, b in edges:
            if part[a] != part[b]:
                want.append((node, d, a, b))
                part = {i: part[a] if p == part[b] else p for i, p in part.items()}
    assert found == sorted(want)
    labels = {(r.node_id, r.term_id): r.label for r in clustering.single_link(df, 5).collect()}
    assert len(labels) == 211 and labels == {(r.node_id, r.term_id): r.label for r in clustering.single_link(df.coalesce(1), 5).collect()}


def test_jobs_of_single_links_do_not_grow_with_terms(spark):
    def jobs(terms):
        spark.sparkContext.setJobGroup(f"links-{terms}", "")
        clustering.single_link(frame(spark, made({0: terms}, seed=terms)), 5).count()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"links-{terms}"))

    assert jobs(900) <= jobs(20) + 4
