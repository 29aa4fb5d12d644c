"""Word vectors from co-occurrence by weighted least squares on logarithms, trained in blocks that never collide.

The loss of a pair is f(x) (w . c + b + b' - ln x)^2 with f(x) = min(1, (x / x_max)^alpha). Words are dealt into blocks;
a pair belongs to a (row block, column block) cell. In one step every row block meets one column block, so all cells of
a step are trained at once in tasks of their own, and as many steps as there are blocks go over all cells once. A task
holds one cell and two blocks of vectors. Pairs are taken in the order of a hash, in small batches with adaptive rates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .ranking import ranked

#: Words of a block, pairs of a batch.
BLOCK, BATCH = 2048, 32


def weight(x: np.ndarray, x_max: float, alpha: float) -> np.ndarray:
    return np.minimum(1.0, (x / x_max) ** alpha)


def start(seed: int, side: int, block: int, n: int, size: int) -> np.ndarray:
    """Vectors and a bias last, and the sums of squared gradients behind them: [2, word, size + 1]."""
    values = (np.random.default_rng([seed, side, block]).random((n, size + 1)) - 0.5) / (size + 1)
    return np.stack([values, np.ones_like(values)])


def loss(rows: np.ndarray, columns: np.ndarray, i: np.ndarray, j: np.ndarray, x: np.ndarray, x_max: float, alpha: float) -> float:
    w, c = rows[0, i], columns[0, j]
    error = (w[:, :-1] * c[:, :-1]).sum(1) + w[:, -1] + c[:, -1] - np.log(x)
    return float((weight(x, x_max, alpha) * error**2).sum() / 2)


def descend(rows: np.ndarray, columns: np.ndarray, i: np.ndarray, j: np.ndarray, x: np.ndarray, rate: float, x_max: float, alpha: float, batch: int = BATCH) -> None:
    """One pass over the pairs, in place; what a batch says of a word is added up, each part at the word's own rate."""
    f, target = weight(x, x_max, alpha), np.log(x)
    for a in range(0, len(i), batch):
        at, to = i[a : a + batch], j[a : a + batch]
        w, c = rows[0, at], columns[0, to]
        pull = (f[a : a + batch] * ((w[:, :-1] * c[:, :-1]).sum(1) + w[:, -1] + c[:, -1] - target[a : a + batch]))[:, None]
        for side, places, other in ((rows, at, c), (columns, to, w)):
            gradient = np.concatenate([pull * other[:, :-1], pull], 1)
            step = rate * gradient / np.sqrt(side[1, places])
            np.subtract.at(side[0], places, step)
            np.add.at(side[1], places, gradient**2)


def train(pairs: DataFrame, size: int = 100, rounds: int = 15, x_max: float = 10.0, alpha: float = 0.75, rate: float = 0.05, seed: int = 1, block: int = BLOCK) -> tuple[DataFrame, list[float]]:
    """term, emb (the sum of a word's two vectors) of word, other, weight; and the loss before each round.

    Null words and weights that aren't positive take no part. Rows that repeat a pair count each.
    """
    pairs = pairs.where("word IS NOT NULL AND other IS NOT NULL AND weight > 0").select("word", "other", F.col("weight").cast("double").alias("x"))
    terms = pairs.select(F.col("word").alias("term")).union(pairs.select("other")).distinct()
    ids = written(ranked(terms, [], ["term"], "k").select("term", (F.col("k") - 1).alias("k")), "glove-ids")
    n_words = ids.count()
    blocks = -(-n_words // block)
    spark = pairs.sparkSession
    if not n_words:
        return ids.select("term", F.array().cast("array<double>").alias("emb")), []
    cells = pairs.join(ids.select(F.col("term").alias("word"), F.col("k").alias("i")), "word").join(ids.select(F.col("term").alias("other"), F.col("k").alias("j")), "other")
    cells = cells.select(F.floor(F.col("i") / block).alias("row"), F.floor(F.col("j") / block).alias("col"), F.struct(F.xxhash64("i", "j").alias("h"), (F.col("i") % block).alias("i"), (F.col("j") % block).alias("j"), "x").alias("p"))
    cells = cells.groupBy("row", "col").agg(F.array_sort(F.collect_list("p")).alias("p"))
    cells = written(cells.select("row", "col", "p.i", "p.j", "p.x"), "glove-cells")
    count = lambda b: min(block, n_words - b * block)
    kind = "row long, rows binary, col long, columns binary, loss double"

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            data = [[start(seed, side, k, count(k), size).tobytes() for k in ids] for side in (0, 1)]
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(data[0], pa.binary()), pa.array(ids, pa.int64()), pa.array(data[1], pa.binary()), pa.array([0.0] * len(ids))], names=["row", "rows", "col", "columns", "loss"])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                row, col = b.column("row")[r].as_py(), b.column("col")[r].as_py()
                rows, columns = (np.frombuffer(b.column(c)[r].as_py()).reshape(2, count(k), size + 1).copy() for c, k in (("rows", row), ("columns", col)))
                before = 0.0
                if b.column("x")[r].is_valid:
                    i, j, x = (b.column(c)[r].values.to_numpy() for c in "ijx")
                    before = loss(rows, columns, i, j, x, x_max, alpha)
                    descend(rows, columns, i, j, x, rate, x_max, alpha)
                yield pa.record_batch([pa.array([row], pa.int64()), pa.array([rows.tobytes()], pa.binary()), pa.array([col], pa.int64()), pa.array([columns.tobytes()], pa.binary()), pa.array([before])], names=["row", "rows", "col", "columns", "loss"])

    held = written(spark.range(0, blocks, 1, min(blocks, 200)).mapInArrow(begin, kind), "glove-blocks")
    losses = []
    for _ in range(rounds):
        total = 0.0
        for s in range(blocks):
            met = held.select("row", "rows", F.pmod(F.col("row") + s, F.lit(blocks)).alias("col")).join(held.select("col", "columns"), "col").join(cells, ["row", "col"], "left")
            held = written(met.select("row", "rows", "col", "columns", "i", "j", "x").repartition("row").mapInArrow(step, kind), "glove-blocks")
            total += held.agg(F.sum("loss")).first()[0]
        losses.append(total)

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                k = b.column("k")[r].as_py()
                a, c = (np.frombuffer(b.column(x)[r].as_py()).reshape(2, count(k), size + 1)[0, :, :-1] for x in ("rows", "columns"))
                yield pa.record_batch([pa.array(np.arange(count(k)) + k * block), pa.array((a + c).tolist(), pa.list_(pa.float64()))], names=["k", "emb"])

    rows = held.select(F.col("row").alias("k"), "rows").join(held.select(F.col("col").alias("k"), "columns"), "k").mapInArrow(both, "k long, emb array<double>")
    return ids.join(rows, "k").select("term", "emb"), losses
