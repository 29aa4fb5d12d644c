"""Clusterings of the vectors of many nodes at once: k-means of a whole level in one plan, and single links.

Both give the same rows at any partitioning: k-means adds vectors up as whole numbers, single links order edges by
(distance, ids).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .ranking import ranked

#: Vector components are summed as whole numbers of this scale.
SCALE = 1 << 32
#: Scale of unit vectors whose products are exact in double precision: no sum within one exceeds 2**52.
UNIT = 1 << 26
#: Bound of an Arrow batch where a row holds blocks of vectors, unless the session sets its own.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "16m"
#: Rows of a block of a node's terms that meets the other blocks; edges, over all nodes, that are few enough to take a node's in one task.
BLOCK, LAST = 4096, 1 << 20


def _prepared(items: DataFrame, measure: str) -> DataFrame:
    """node_id, term_id, v: whole numbers; of length ``SCALE`` for the cosine (a zero vector stays zero)."""
    kind = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.array(b.column("emb").to_pylist(), float)
                if measure == "cosine":
                    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                yield pa.RecordBatch.from_arrays([b.column("node_id"), b.column("term_id"), pa.array(np.rint(x * SCALE).astype(np.int64).tolist(), kind)], ["node_id", "term_id", "v"])

    rows = items.select("node_id", "term_id", F.col("emb").cast("array<double>").alias("emb")).where("emb IS NOT NULL AND NOT exists(emb, x -> x IS NULL)")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"node_id {kinds['node_id']}, term_id {kinds['term_id']}, v array<long>")


def _flat(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(n, -1) / SCALE


class Centres:
    """Centres of each node, in label order."""

    def __init__(self, measure: str):
        self.measure, self.of = measure, {}

    def put(self, node: int, rows: list[np.ndarray]) -> None:
        found = np.array(rows, float)
        if self.measure == "cosine":
            found /= np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-300)
        self.of[node] = found

    def near(self, node: int, x: np.ndarray) -> np.ndarray:
        """Likeness of rows to the node's centres, the more the nearer; rounded, so that ties are ties everywhere."""
        c = self.of[node]
        if self.measure == "cosine":
            return np.round(x @ c.T, 9)
        return -np.round(((x[:, None, :] - c[None, :, :]) ** 2).sum(2), 9)


def _by_node(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    nodes = b.column("node_id").to_numpy()
    for node in np.unique(nodes):
        yield int(node), np.flatnonzero(nodes == node)


def _start(rows: DataFrame, k: int, measure: str) -> Centres:
    """Far-first: the smallest term, then each time the term that is least like its nearest centre, ties to the smaller term.

    A zero vector has no direction, so by the cosine it is no start unless there is nothing else.
    """
    empty = (F.array_max("v") == 0) & (F.array_min("v") == 0) & F.lit(measure == "cosine")
    first = rows.groupBy("node_id").agg(F.min_by("v", F.struct(empty, "term_id")).alias("v")).collect()
    found = {r["node_id"]: [np.array(r["v"]) / SCALE] for r in first}
    for _ in range(k - 1):
        centres = Centres(measure)
        for node, have in found.items():
            centres.put(node, have)

        def run(batches: Iterator[pa.RecordBatch], centres: Centres = centres) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                x, ids = _flat(b.column("v"), b.num_rows), b.column("term_id").to_numpy()
                best = []
                for node, at in _by_node(b):
                    like = centres.near(node, x[at]).max(1)
                    if centres.measure == "cosine":
                        like[~x[at].any(1)] = 2.0
                    i = at[np.lexsort((ids[at], like))[0]]
                    best.append((int(i), float(like.min())))
                pick = b.take(pa.array([i for i, _ in best]))
                yield pa.RecordBatch.from_arrays([*pick.columns, pa.array([like for _, like in best])], [*pick.schema.names, "like"])

        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
        farthest = rows.mapInArrow(run, f"{kinds}, like double").groupBy("node_id").agg(F.min_by("v", F.struct("like", "term_id")).alias("v"))
        for r in farthest.collect():
            found[r["node_id"]].append(np.array(r["v"]) / SCALE)
    centres = Centres(measure)
    for node, have in found.items():
        centres.put(node, have)
    return centres


def _sums(rows: DataFrame, centres: Centres) -> dict[int, dict[int, tuple[int, ...]]]:
    """Whole sums of each node's labels; a partial sum a batch goes to the shuffle."""
    schema = "node_id long, label int, i int, s long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            whole = b.column("v").flatten().to_numpy().reshape(b.num_rows, -1)
            out = []
            for node, at in _by_node(b):
                labels = centres.near(node, whole[at] / SCALE).argmax(1)
                for label in np.unique(labels):
                    out += [(node, int(label), i, int(s)) for i, s in enumerate((whole[at[labels == label]] >> 12).sum(0))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.int64()))], ["node_id", "label", "i", "s"])

    found: dict[int, dict[int, dict[int, int]]] = {}
    for r in rows.mapInArrow(run, schema).groupBy("node_id", "label", "i").agg(F.sum(F.col("s").cast("decimal(30,0)")).alias("s")).collect():
        found.setdefault(r["node_id"], {}).setdefault(r["label"], {})[r["i"]] = int(r["s"])
    return {n: {label: tuple(s[i] for i in range(len(s))) for label, s in labels.items()} for n, labels in found.items()}


def k_means(items: DataFrame, k: int = 5, measure: str = "cosine", most_rounds: int = 20) -> DataFrame:
    """node_id, term_id, label of node_id, term_id, emb: the terms of every node in ``k`` clusters.

    All nodes are clustered in one plan, so the number of jobs doesn't depend on them. Centres (``k`` a node) go to the
    workers with the plan. A node of fewer than ``k`` terms gets clusters of one, in id order; a label that loses all
    its terms keeps its centre. Vectors with nulls take no part.
    """
    items = items.withColumn("node_id", F.col("node_id").cast("long"))
    rows = written(_prepared(items, measure), "k-means")
    few = rows.groupBy("node_id").agg(F.count("*").alias("n")).where(F.col("n") < k).select("node_id")
    order = Window.partitionBy("node_id").orderBy("term_id")  # fewer than k rows
    single = rows.join(few, "node_id", "left_semi").select("node_id", "term_id", (F.row_number().over(order) - 1).cast("int").alias("label"))
    rows = written(rows.join(few, "node_id", "left_anti"), "k-means")
    centres, before = _start(rows, k, measure), None
    for _ in range(most_rounds):
        sums = _sums(rows, centres)
        if sums == before:
            break
        before, new = sums, Centres(measure)
        if measure == "cosine":
            means = sums
        else:
            sizes = {(r["node_id"], r["label"]): r["n"] for r in _labelled(rows, centres).groupBy("node_id", "label").agg(F.count("*").alias("n")).collect()}
            means = {n: {label: np.array(s, float) / sizes[n, label] for label, s in labels.items()} for n, labels in sums.items()}
        for node, labels in means.items():
            new.put(node, [np.array(labels[j], float) / (SCALE >> 12) if j in labels else centres.of[node][j] for j in range(k)])
        centres = new
    return _labelled(rows, centres).unionByName(single)


def _labelled(rows: DataFrame, centres: Centres) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, labels = _flat(b.column("v"), b.num_rows), np.zeros(b.num_rows, np.int32)
            for node, at in _by_node(b):
                labels[at] = centres.near(node, x[at]).argmax(1)
            yield pa.RecordBatch.from_arrays([b.column("node_id"), b.column("term_id"), pa.array(labels)], ["node_id", "term_id", "label"])

    return rows.mapInArrow(run, f"node_id long, term_id {rows.schema['term_id'].dataType.simpleString()}, label int")


# ---- single links ----


def _grown(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """distance, a, b of the least spanning tree of some points, ties by (a, b); products of ``x`` are exact.

    One tree is grown. The points outside of it stand first, each with its nearest point inside, so a step is one product
    of the rest with the point that came in, and nothing quadratic is held.
    """
    ids, x, left = ids.copy(), x.copy(), len(ids) - 1
    like, near = np.full(len(ids), -np.inf), np.zeros(len(ids), np.int64)
    out_like, out_a, out_b = np.zeros(left), np.zeros(left, np.int64), np.zeros(left, np.int64)
    for k in range(left):
        came, v = ids[left], x[left].copy()
        new = x[:left] @ v
        old, end, mine = like[:left], near[:left], ids[:left]
        closer = new > old
        same = np.flatnonzero(new == old)
        if len(same):
            low, high = np.minimum(mine[same], came), np.maximum(mine[same], came)
            was_low, was_high = np.minimum(mine[same], end[same]), np.maximum(mine[same], end[same])
            closer[same] = (low < was_low) | ((low == was_low) & (high < was_high))
        np.copyto(old, new, where=closer)
        np.copyto(end, came, where=closer)
        at = int(old.argmax())
        ties = np.flatnonzero(old == old[at])
        if len(ties) > 1:
            at = int(ties[np.lexsort((np.maximum(mine[ties], end[ties]), np.minimum(mine[ties], end[ties])))[0]])
        out_like[k], out_a[k], out_b[k] = old[at], min(mine[at], end[at]), max(mine[at], end[at])
        left -= 1
        for c in (ids, like, near):
            c[at], c[left] = c[left], c[at]
        x[[at, left]] = x[[left, at]]
    return 1 - out_like / UNIT**2, out_a, out_b


def _candidates(rows: DataFrame) -> DataFrame:
    """node_id, distance, a, b: the least trees of each two blocks of a node, which hold the node's least tree.

    A block of ``BLOCK`` terms goes to every pair that it is in, in one shuffle. A node of one block is its own pair.
    """
    spark = rows.sparkSession
    sizes = rows.groupBy("node_id").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = rows.join(sizes, "node_id").withColumn("block", F.pmod(F.xxhash64("term_id"), "blocks"))
    schema = "node_id long, blocks long, block long, ids array<long>, x binary"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                held = b.column("rows")[r].values
                x = np.rint(_flat(held.field("v"), len(held)) * UNIT).astype(np.int32)
                ids = held.field("term_id").cast(pa.int64()).to_numpy(zero_copy_only=False)
                yield pa.record_batch([b.column(c).slice(r, 1) for c in ("node_id", "blocks", "block")] + [pa.array([ids], pa.list_(pa.int64())), pa.array([x.tobytes()], pa.binary())], names=["node_id", "blocks", "block", "ids", "x"])

    blocks = dealt.groupBy("node_id", "blocks", "block").agg(F.collect_list(F.struct("term_id", "v")).alias("rows"))
    blocks = written(blocks.mapInArrow(pack, schema), "forest")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    sent = blocks.withColumn("other", other).where((F.col("other") != F.col("block")) | (F.col("blocks") == 1))
    sent = sent.select("node_id", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "ids", "x")
    pairs = blocks.agg(F.sum(F.col("blocks")).alias("n")).first()["n"] or 1  # twice as many as there are pairs, about
    tasks = max(4 * spark.sparkContext.defaultParallelism, min(pairs // 8, 20000))
    met = sent.repartition(tasks, "node_id", "lo", "hi").groupBy("node_id", "lo", "hi").agg(F.collect_list(F.struct("ids", "x")).alias("rows"))

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                held = b.column("rows")[r].values
                ids = held.field("ids").flatten().to_numpy()
                x = np.frombuffer(b"".join(held.field("x").to_pylist()), np.int32).reshape(len(ids), -1).astype(float)
                distance, a, c = _grown(ids, x)
                node = np.full(len(a), b.column("node_id")[r].as_py(), np.int64)
                there = a != c
                yield pa.record_batch([pa.array(v[there]) for v in (node, distance, a, c)], names=["node_id", "distance", "a", "b"])

    return met.select("node_id", "rows").mapInArrow(grow, "node_id long, distance double, a long, b long").distinct()


def _united(p: list[int], q: list[int]) -> tuple[list[bool], dict[int, int]]:
    """Which pairs, taken in their order, joined two parts; and each value's least one of its part."""
    up: dict[int, int] = {}

    def root(v: int) -> int:
        while (w := up.setdefault(v, v)) != v:
            up[v] = v = up.setdefault(w, w)
        return v

    kept = []
    for x, y in zip(p, q):
        x, y = root(x), root(y)
        kept.append(x != y)
        up[max(x, y)] = min(x, y)
    return kept, {v: root(v) for v in list(up)}


def _kruskal(group: pd.DataFrame) -> pd.DataFrame:
    """The least tree's edges of one node, for the few that are left."""
    group = group.sort_values(["distance", "a", "b"])
    return group.loc[_united(group["p"].tolist(), group["q"].tolist())[0], ["node_id", "distance", "a", "b"]]


def _least_terms(group: pd.DataFrame) -> pd.DataFrame:
    """Each term of one node's few edges with the least term that they lead to."""
    parts = _united(group["a"].tolist(), group["b"].tolist())[1]
    return pd.DataFrame({"node_id": group["node_id"].iloc[0], "term_id": list(parts), "part": list(parts.values())})


def _joined(edges: DataFrame) -> DataFrame:
    """node_id, part, root: where each part ends by following edges; of two that chose one another the smaller is the end.

    Pointers are doubled until none moves.
    """
    back = edges.select("node_id", F.col("part").alias("to"), F.col("to").alias("part"), F.lit(True).alias("mutual"))
    up = edges.select("node_id", "part", "to").join(back, ["node_id", "part", "to"], "left")
    up = written(up.select("node_id", "part", F.when(F.col("mutual") & (F.col("part") < F.col("to")), F.col("part")).otherwise(F.col("to")).alias("root")), "links")
    while True:
        step = up.select("node_id", F.col("part").alias("root"), F.col("root").alias("next"))
        new = written(up.join(step, ["node_id", "root"], "left").select("node_id", "part", F.coalesce("next", "root").alias("new"), "root"), "links")
        moved = not new.where("new <> root").isEmpty()
        up = new.select("node_id", "part", F.col("new").alias("root"))
        if not moved:
            return up


def spanning_forest(items: DataFrame) -> DataFrame:
    """node_id, distance, a, b: a least spanning tree of every node's terms by cosine distance, ties by (a, b).

    Exact: every two blocks of ``BLOCK`` terms give their own least tree, so each distance is looked at once and the work is
    quadratic in a node's terms; no task holds more than two blocks. Of these edges each part takes its least in rounds
    that at least halve the parts, until no more than ``LAST`` are left.
    """
    conf = items.sparkSession.conf
    if BATCH_KEY not in conf.getAll:
        conf.set(BATCH_KEY, BATCH_BYTES)
    rows = written(_prepared(items.withColumn("node_id", F.col("node_id").cast("long")), "cosine"), "forest")
    live = _candidates(rows).withColumns({"p": F.col("a"), "q": F.col("b")})
    tree = None
    while True:
        live = written(live, "forest")
        if live.count() <= LAST:
            rest = live.groupBy("node_id").applyInPandas(_kruskal, "node_id long, distance double, a long, b long")
            return rest if tree is None else tree.union(rest)
        ends = live.select("node_id", F.col("p").alias("part"), F.struct("distance", "a", "b", F.col("q").alias("to")).alias("e"))
        ends = ends.union(live.select("node_id", "q", F.struct("distance", "a", "b", "p")))
        edges = written(ends.groupBy("node_id", "part").agg(F.min("e").alias("e")).select("node_id", "part", "e.*"), "forest")
        new = edges.select("node_id", "distance", "a", "b").distinct()
        tree = new if tree is None else tree.union(new)
        roots = _joined(edges)
        for end in ("p", "q"):
            live = live.join(roots.select("node_id", F.col("part").alias(end), F.col("root").alias(f"{end}_root")), ["node_id", end])
        live = live.where("p_root <> q_root").groupBy("node_id", F.least("p_root", "q_root").alias("p"), F.greatest("p_root", "q_root").alias("q"))
        live = live.agg(F.min(F.struct("distance", "a", "b")).alias("e")).select("node_id", "e.*", "p", "q")


def _spread(terms: DataFrame, links: DataFrame) -> DataFrame:
    """node_id, term_id, part: each term's least term along the links, in rounds, for any number of them."""
    part = written(terms.withColumn("part", F.col("term_id")), "forest")
    links = written(links.select("node_id", F.col("a").alias("x"), F.col("b").alias("y")).union(links.select("node_id", "b", "a")), "forest")
    while True:  # every term takes the least part among its neighbours' and that part's own
        across = links.join(part.select("node_id", F.col("term_id").alias("y"), "part"), ["node_id", "y"]).groupBy("node_id", F.col("x").alias("term_id")).agg(F.min("part").alias("near"))
        near = part.join(across, ["node_id", "term_id"], "left").select("node_id", "term_id", "part", F.least("part", F.coalesce("near", "part")).alias("new"))
        hop = near.select("node_id", F.col("term_id").alias("new"), F.col("new").alias("hop"))
        moved = written(near.join(hop, ["node_id", "new"], "left").select("node_id", "term_id", "part", F.least("new", "hop").alias("new")), "forest")
        done = moved.where("new <> part").isEmpty()
        part = moved.select("node_id", "term_id", F.col("new").alias("part"))
        if done:
            return part


def single_link(items: DataFrame, k: int = 5) -> DataFrame:
    """node_id, term_id, label: the forest's longest ``k - 1`` edges a node are cut; labels follow the least terms."""
    tree = written(spanning_forest(items), "forest")
    kept = ranked(tree, ["node_id"], [F.desc("distance"), F.desc("a"), F.desc("b")]).where(F.col("place") > k - 1)
    terms = items.where("emb IS NOT NULL AND NOT exists(emb, x -> x IS NULL)").select(F.col("node_id").cast("long").alias("node_id"), F.col("term_id").cast("long").alias("term_id")).distinct()
    kept = written(kept.select("node_id", "a", "b"), "forest")
    if kept.count() <= LAST:
        least = kept.groupBy("node_id").applyInPandas(_least_terms, "node_id long, term_id long, part long")
        part = written(terms.join(least, ["node_id", "term_id"], "left").select("node_id", "term_id", F.coalesce("part", "term_id").alias("part")), "forest")
    else:
        part = _spread(terms, kept)
    order = Window.partitionBy("node_id").orderBy("part")  # k rows
    labels = part.select("node_id", "part").distinct().withColumn("label", (F.row_number().over(order) - 1).cast("int"))
    return part.join(labels, ["node_id", "part"]).select("node_id", "term_id", "label")
