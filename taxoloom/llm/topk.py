"""Exact top-k inner products by norm-bucketed retrieval.

Candidates are grouped by length (buckets of equal ratio), each bucket cut into blocks of a bounded number
of rows, and the blocks of the longest vectors are scored first. They give every query a k-th best score; in
any other block only a candidate whose cosine with the query reaches

    local threshold = k-th best score / (query length * greatest length in the block)

can still enter. Each block chooses its test by that threshold:

* above 1, nothing in the block can qualify for this query, and the block is skipped;
* if it is high, *coordinate* pruning: a unit vector whose cosine with the unit query is at least t lies, in
  the query's strongest coordinates, within ``q t +- sqrt((1 - t^2)(1 - q^2))``; others are discarded;
* else *length* pruning: candidates with length below k-th best / query length are discarded.

Products of the survivors are exact integers, and ties go to the smaller id. Queries and candidates meet in
(query block, candidate block) groups, so memory is bounded by the two block sizes whatever the table; only
rows that reach the k-th best leave a group. Most groups are pruned before anything is shuffled: a query goes
only to blocks whose greatest length lets it reach its k-th best, queries of like reach share a block, and a
candidate block goes only to query blocks that reach it.

Vectors that are null or hold null, NaN or infinite components take no part, nor do empty ones or null ids.
Vectors of different lengths are multiplied over their common components. Rows are numbered in a written
table, so repeated ids and repeated rows are separate queries and candidates: a query leaves out its own row
only. Only the id and vector columns are read, so other columns can't clash. An empty table, or one without
queries, gives no rows. The driver only holds one row per bucket of lengths (counts and greatest lengths).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._run import ready, written

RATIO = 1.05
HIGH = 0.8


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as a float matrix, padded with zeros (which add nothing to a product)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy().astype(np.float64)
    width = int(sizes.max()) if len(sizes) else 0
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width)[None] < sizes[:, None]] = flat
    return out


def _common(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = min(a.shape[1], b.shape[1])
    return a[:, :n], b[:, :n]


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products; floating point only where every partial sum stays below 2**53."""
    q, c = _common(q, c)
    most = (np.abs(q).max(initial=0.0) * np.abs(c).max(initial=0.0)) * max(1, q.shape[1])
    if most < 2.0**52:
        return (q @ c.T).astype(np.int64)
    return np.array([[sum(int(x) * int(y) for x, y in zip(a, b, strict=True)) for b in c] for a in q], object).reshape(len(q), len(c))


def survivors(q: np.ndarray, q_norm: float, c: np.ndarray, c_norm: np.ndarray, floor: float, focus: int = 4) -> np.ndarray:
    """Rows of a block that can reach ``floor`` with this query, by the test that the block's threshold calls for."""
    everything = np.arange(len(c))
    if floor <= 0 or q_norm == 0 or not len(c):
        return everything
    slack = 1e-9
    threshold = floor / (q_norm * max(c_norm.max(), 1e-300))
    if threshold > 1 + slack:
        return everything[:0]
    if threshold < HIGH:
        return np.nonzero(c_norm * q_norm >= floor * (1 - slack))[0]
    t = min(1.0, threshold)
    unit = q / q_norm
    rows = everything
    for f in np.argsort(-np.abs(unit))[: min(focus, c.shape[1])]:
        x = c[rows, f] / np.maximum(c_norm[rows], 1e-300)
        mid, room = unit[f] * t, math.sqrt(max(0.0, (1 - t * t) * (1 - unit[f] ** 2)))
        high = 1.0 if unit[f] >= t else mid + room
        low = -1.0 if unit[f] <= -t else mid - room
        rows = rows[(x >= low - slack) & (x <= high + slack)]
    return rows


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k and scores.dtype != object:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.nonzero(scores >= cut)[0]
    else:
        keep = np.arange(len(scores))
    order = sorted(keep.tolist(), key=lambda i: (-scores[i], ids[i]))
    return np.array(order[:k], np.int64)


def search_block(qs: pa.Table, cs: pa.Table, k: int) -> pa.Table:
    """Top-k of one candidate block for each query of one query block that has a chance there."""
    names = ["query_row", "query_id", "vec_row", "vec_id", "score"]
    empty = pa.table({n: pa.array([], pa.int64()) for n in names})
    if not qs.num_rows or not cs.num_rows:
        return empty
    q_ids, c_ids, q_rows, c_rows = qs["id"].to_numpy(), cs["id"].to_numpy(), qs["row"].to_numpy(), cs["row"].to_numpy()
    q, c = _common(_matrix(qs["v"]), _matrix(cs["v"]))
    q_norm, c_norm = np.linalg.norm(q, axis=1), np.linalg.norm(c, axis=1)
    floors = qs["floor"].to_pylist()
    out: list[list] = [[] for _ in names]
    for start in range(0, len(q), 256):
        part = slice(start, start + 256)
        alive = [survivors(q[i], q_norm[i], c, c_norm, floors[i] if floors[i] is not None else -math.inf) for i in range(*part.indices(len(q)))]
        if not any(len(a) for a in alive):
            continue
        dense = products(q[part], c) if sum(map(len, alive)) * 4 > len(alive) * len(c) else None
        for n, rows in enumerate(alive):
            i = start + n
            rows = rows[c_rows[rows] != q_rows[i]]
            if not len(rows):
                continue
            s = dense[n, rows] if dense is not None else products(q[i : i + 1], c[rows])[0]
            if floors[i] is not None:
                ok = s >= floors[i]
                rows, s = rows[ok], s[ok]
            top = best(c_ids[rows], s, k)
            found = ([int(q_rows[i])] * len(top), [int(q_ids[i])] * len(top), c_rows[rows[top]].tolist(), c_ids[rows[top]].tolist(), [int(x) for x in s[top]])
            for col, x in zip(out, found, strict=True):
                col += x
    return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(names, out, strict=True)})


def top_k(
    vectors: DataFrame,
    is_query,
    k: int = 10,
    scale: float = 1024.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block_rows: int = 8192,
    query_rows: int = 2048,
) -> DataFrame:
    """For each row for which ``is_query`` (a column on ``id``) holds, its k highest products over all other rows.

    Components are turned into ``floor(scale * x)`` first. Returns query_id, rank, vec_id, score; of several
    query rows of one id each has its own ranks from 1.
    """
    spark = vectors.sparkSession
    ready(spark)
    x = F.col(vector_col)
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    rows = vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0) & finite).select(
        F.col(id_col).cast("long").alias("id"), F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("double")).alias("v")
    )
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, e: a + e * e))
    step = lambda n: F.floor(F.log(F.greatest(n, F.lit(1e-9))) / math.log(RATIO)).cast("int")
    sized = written(rows.withColumn("norm", norm).withColumn("bucket", step(F.col("norm"))).withColumn("row", F.monotonically_increasing_id()), "topk-vectors")
    stats = {r["bucket"]: r["n"] for r in sized.df.groupBy("bucket").agg(F.count("*").alias("n")).collect()}
    queries = sized.df.where(is_query(F.col("id"))).select("row", "id", "v", F.col("norm").alias("q_norm"))
    if not stats or queries.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    blocks, first, parts = 0, {}, {}
    for b in sorted(stats, reverse=True):
        first[b], parts[b] = blocks, -(-stats[b] // (block_rows * 3 // 4))
        blocks += parts[b]
    place = F.create_map(*(F.lit(v) for b in stats for v in (b, first[b])))
    spread = F.create_map(*(F.lit(v) for b in stats for v in (b, parts[b])))
    block = place[F.col("bucket")] + F.pmod(F.xxhash64("row"), spread[F.col("bucket")].cast("long")).cast("int")
    again = spark.read.schema(sized.df.schema).parquet(sized.path)  # columns of its own, apart from the queries'
    cands = again.select("row", "id", "v", block.alias("block"))
    lead, held = 0, 0
    for b in sorted(stats, reverse=True):  # the longest vectors, until there are enough of them for k others
        held += stats[b]
        lead = first[b] + parts[b]
        if held >= 4 * k + 64:
            break

    def meet(qs: DataFrame, low: int) -> DataFrame:
        """Each query with the blocks from ``low`` to below its own ``reach``."""
        per_reach = F.greatest(F.lit(1), F.ceil(F.count("*") / query_rows)).cast("int")
        groups = written(qs.groupBy("reach").agg(per_reach.alias("_n")), "topk-reach")  # at most one row a bucket of lengths
        dealt = qs.join(F.broadcast(groups.df), "reach").withColumn("q", F.pmod(F.xxhash64("row", F.lit("q")), F.col("_n").cast("long")).cast("int"))
        left = dealt.select("reach", "q", "row", "id", "v", "floor", F.explode(F.sequence(F.lit(low), F.col("reach") - 1)).alias("block"))
        other = spark.read.schema(groups.df.schema).parquet(groups.path)
        met = other.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).withColumn("block", F.explode(F.sequence(F.lit(low), F.col("reach") - 1)))
        right = cands.where(F.col("block") >= low).join(met.select("reach", "q", "block"), "block")
        run = lambda key, a, b: search_block(a, b, k)
        by = ["reach", "q", "block"]
        return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, "query_row long, query_id long, vec_row long, vec_id long, score long")

    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "vec_row")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    start = queries.select("row", "id", "v", F.lit(None).cast("long").alias("floor"), F.lit(lead).alias("reach"))
    top = written(ranked(meet(start, 0)), "topk-lead")
    if lead < blocks:
        floors = top.df.where(F.col("rank") == k).select(F.col("query_row").alias("row"), F.col("score").alias("floor"))
        # blocks of buckets that hold no length of floor / query length or more are out of reach (one bucket of slack)
        least = step(F.col("floor") / F.col("q_norm")) - 1
        steps = F.array(*(F.struct(F.lit(b).alias("b"), F.lit(first[b] + parts[b]).alias("end")) for b in sorted(stats)))
        reach = F.when((F.col("floor") > 0) & (F.col("q_norm") > 0), F.coalesce(F.array_max(F.transform(F.filter(steps, lambda s: s["b"] >= least), lambda s: s["end"])), F.lit(0))).otherwise(F.lit(blocks))
        rest = queries.join(floors, "row", "left").withColumn("reach", reach.cast("int")).where(F.col("reach") > lead).select("row", "id", "v", "floor", "reach")
        result = ranked(top.df.select("query_row", "query_id", "vec_row", "vec_id", "score").union(meet(rest, lead)))
    else:
        result = top.df
    return result.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
