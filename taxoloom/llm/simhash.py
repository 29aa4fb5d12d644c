"""SimHash near-duplicates, with links found through tables of distances to reference fingerprints.

A fingerprint has ``words`` times 64 bits; a bit is set if over half of the shingles' hashes have it set. The
Hamming distance obeys the triangle inequality, so two fingerprints within ``radius`` differ by at most
``radius`` in their distance to any reference ("pivot") fingerprint. Distances are also taken over parts of
the bits only ("segments"):

1. Equal fingerprints become one class.
2. If the segments are ``radius + 1`` disjoint parts that make up all bits, a pair within the radius agrees on
   one whole segment, and so has the same segment distance to every pivot: that vector of distances, hashed,
   is the bucket key, and no pair is lost. (Fingerprints agree in all those distances nearly only if they agree
   on the segment, so this bucketing is by segments; the pivots' own part is step 3.) With larger radii (see ``sampled_segments``) the segments are random
   samples of the bits and a pair is found with a probability given there.
3. Within a bucket, pairs whose pivot distances differ by more than the radius in any coordinate are
   discarded, and the exact Hamming distance of the survivors is checked. A bucket hands on a spanning forest
   of its links, never all its pairs.
4. Buckets of more than about ``bucket_limit`` classes are not gathered in a task. For a radius of two or less each
   of their members is sent to itself and all fingerprints one bit away: two members meet exactly if they are
   within two bits (a shared point is then within one bit of both), and a minimum for each point links them,
   linearly and exactly. For larger radii a bucket is dealt into blocks of half the limit and every two blocks
   meet in a task, so every pair of the bucket is still looked at.
5. Where texts are to be compared by their shingle sets (``keep_one``), components of links are candidates only:
   within each, pairs are verified by the exact Jaccard similarity, and components are formed anew.
6. Components come from ``_components``; each is named by its smallest document id.

Null texts count as empty; a text without words has fingerprint zero. Repeated rows and ids are fine: rows
with one id share a component only if their fingerprints link them. Null ids never name a component that has
another id.
"""

from __future__ import annotations

import random
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructType

from ._components import components
from ._run import lean, ready, written
from ._text import mix

SEED = 42


def shingle_hashes(raw: bytes, size: int) -> np.ndarray:
    """XXH64 of all shingles of the ASCII-lower-cased words, repeats included."""
    w = raw.lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    if len(w) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), SEED)], np.uint64)
    text = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    cut = [text[a:b] for a, b in zip(starts, ends[size - 1 :].tolist(), strict=False)]
    return np.fromiter(map(xxhash.xxh64_intdigest, cut, repeat(SEED)), np.uint64, len(cut))


def fingerprint(raw: bytes, size: int, words: int) -> bytes:
    return fingerprint_of(shingle_hashes(raw, size), words)


def fingerprint_of(h: np.ndarray, words: int) -> bytes:
    if not len(h):
        return bytes(8 * words)
    out = []
    for k in range(words):
        x = h if k == 0 else mix(h + np.uint64(0x9E3779B97F4A7C15 * k % (1 << 64)))
        bits = np.unpackbits(x.byteswap().view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        out.append(np.packbits(2 * bits > len(x)).tobytes())
    return b"".join(out)


def whole_segments(words: int, radius: int) -> list[int]:
    """Disjoint masks that make up all bits, one more than the radius."""
    bits = 64 * words
    edges = [bits * k // (radius + 1) for k in range(radius + 2)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]


def sampled_segments(words: int, count: int, size: int, seed: int = 7) -> list[int]:
    """Random masks. Texts that differ in a share d of the bits meet with probability 1-(1-(1-d)^size)^count.

    For 224 masks of 20 bits that is 0.9998 at d = 0.151, the mean for a Jaccard similarity of 0.8; as d varies from
    pair to pair, 0.99 of such pairs were found when measured. Unrelated texts
    meet once in 2**size times, so the pairs looked at are count * n**2 / 2**(size + 1) for n texts: with 20 bits
    10**8 pairs for a million texts, 10**10 for ten. For more, choose ``size`` near log2(n) and ``count`` near
    8 / 0.849**size (30 bits and 1090 masks for a thousand million texts); work then grows as n**1.24.
    """
    rng = random.Random(seed)
    return [sum(1 << b for b in rng.sample(range(64 * words), size)) for _ in range(count)]


@dataclass(frozen=True)
class Pivots:
    """Reference fingerprints and segments as rows of 64-bit words."""

    words: int
    segments: tuple[int, ...]
    count: int = 16

    def table(self) -> np.ndarray:
        return np.random.default_rng(2024).integers(0, 1 << 64, (self.count, self.words), np.uint64, endpoint=False)

    def _mask(self, m: int) -> np.ndarray:
        return np.frombuffer(m.to_bytes(8 * self.words, "big"), ">u8").astype(np.uint64)

    def distances(self, fps: np.ndarray) -> np.ndarray:
        """Distance of each fingerprint to each pivot."""
        return np.stack([np.bitwise_count(fps ^ p).sum(1, dtype=np.int16) for p in self.table()], 1)

    def key(self, fps: np.ndarray, number: int, mask: int) -> np.ndarray:
        """Hash of the segment distances to all pivots."""
        m = self._mask(mask)
        out = np.full(len(fps), number, np.uint64)
        part = fps & m
        for p in self.table():
            d = np.bitwise_count(part ^ (p & m)).sum(1, dtype=np.uint64)
            out = mix(out * np.uint64(257) + d + np.uint64(1))
        return out.view(np.int64)


def _array(column: pa.Array, words: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u8").astype(np.uint64).reshape(-1, words)


def _bytes(fps: np.ndarray) -> list[bytes]:
    raw, n = fps.astype(">u8").tobytes(), 8 * fps.shape[1]
    return [raw[i : i + n] for i in range(0, len(raw), n)]


def forest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Smallest reachable index of each of n nodes."""
    root = np.arange(n)
    while len(u):
        low = np.minimum(root[u], root[v])
        before = root.copy()
        np.minimum.at(root, root[u], low)
        np.minimum.at(root, root[v], low)
        root = root[root]
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(before, root):
            break
        open_ = root[u] != root[v]
        u, v = u[open_], v[open_]
    return root


def spanning_links(keys: np.ndarray, near, labels: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (rows) of the pairs of equal key that ``near(u, v)`` (a mask) accepts; keys are sorted.

    Rows of equal label count as joined already: their pairs aren't looked at, and give no links.
    """
    n = len(keys)
    root = np.arange(n)
    if labels is not None and n:
        _, first, group = np.unique(np.stack((keys, labels), 1), axis=0, return_index=True, return_inverse=True)
        root = first[group.reshape(-1)]
    own = root == np.arange(n)
    at = np.arange(n)
    us, vs, held = [], [], 0
    step = 0
    while True:
        step += 1
        at = at[at + step < n]
        at = at[keys[at] == keys[at + step]]
        if not len(at):
            break
        if held > 4 * n + 100_000 or step >= 16 and not step & (step - 1):
            root = forest(np.concatenate([*us, np.arange(n)]), np.concatenate([*vs, root]), n)
            us, vs, held = [], [], 0
        u = at[root[at] != root[at + step]]  # pairs that earlier links already join need no look
        ok = near(u, u + step)
        if ok.any():
            us.append(u[ok])
            vs.append(u[ok] + step)
            held += len(us[-1])
    root = forest(np.concatenate([*us, np.arange(n)]), np.concatenate([*vs, root]), n)
    child = np.nonzero((root != np.arange(n)) & own)[0]
    return child, root[child]


def bucket_links(keys: np.ndarray, fps: np.ndarray, pivots: Pivots, radius: int, labels: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links within buckets: discarded by pivot distances first, survivors verified."""
    # unrelated fingerprints lie within some deviations of one distance to any pivot: a wide radius discards none
    table = pivots.distances(fps) if radius <= 2 * (64 * pivots.words) ** 0.5 else np.zeros((len(fps), 0), np.int16)

    def near(u, v):
        left = np.arange(len(u))
        for p in range(table.shape[1]):
            left = left[np.abs(table[u[left], p] - table[v[left], p]) <= radius]
            if not len(left):
                break
        out = np.zeros(len(u), bool)
        out[left] = np.bitwise_count(fps[u[left]] ^ fps[v[left]]).sum(1) <= radius
        return out

    return spanning_links(keys, near, labels)


def fingerprints(docs: DataFrame, size: int, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fingerprint (bytes, the highest bit first) of every whole text."""
    ready(docs.sparkSession)

    def run(batches):
        for b in batches:
            raw = b.column(1).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(x or b"", size, words) for x in raw], pa.binary())], ["id", "fp"])

    schema = StructType().add("id", docs.schema[id_col].dataType).add("fp", BinaryType())
    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(lean(run), schema)


def met_in_blocks(rows: DataFrame, member: str, blocks: F.Column) -> DataFrame:
    """The rows with each ``key`` dealt into ``blocks`` by member, once for every two blocks: all pairs of a key share a new key."""
    own = F.pmod(F.xxhash64(member), blocks)
    met = rows.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), blocks.cast("long") - 1)))
    return met.withColumn("key", F.xxhash64("key", F.least("_own", "_other"), F.greatest("_own", "_other"))).select(*(c for c in rows.columns if c != "count"))


def large_buckets(sample: DataFrame, share: int, bucket_limit: int, name: str) -> DataFrame | None:
    """Keys of a sample of one row in ``share`` that stand for more than ``bucket_limit`` rows, with that count; None if there are none.

    A written table, whose size Spark knows when it plans the joins with it.
    """
    counted = sample.groupBy("key").agg((F.count("*") * share).alias("count"))
    hot = written(counted.where(F.col("count") > bucket_limit), name).df
    return None if hot.isEmpty() else hot


def split_buckets(rows: DataFrame, hot: DataFrame | None, member: str, bucket_limit: int) -> DataFrame:
    """The rows, those of large buckets dealt into blocks that meet two by two."""
    if hot is None:
        return rows
    return rows.join(hot, "key", "left_anti").union(met_in_blocks(rows.join(hot, "key"), member, F.ceil(2 * F.col("count") / bucket_limit)))


def fingerprint_links(fps: DataFrame, pivots: Pivots, radius: int, bucket_limit: int = 8192) -> DataFrame:
    """Links a, b among distinct fingerprints (column fp) that connect whatever is within the radius.

    Fingerprints of equal ``label`` (a column of longs, if there is one) count as connected already.
    """
    ready(fps.sparkSession)
    words = pivots.words
    labelled = ["label"] if "label" in fps.columns else []
    fps = fps.select("fp", *labelled)
    schema = ", ".join(["key long", "fp binary", *("label long" for _ in labelled)])

    def keyed(masks):
        def run(batches):
            for b in batches:
                x = _array(b.column(0), words)
                for j, m in enumerate(masks):
                    yield pa.RecordBatch.from_arrays([pa.array(pivots.key(x, j, m)), *b.columns], ["key", "fp", *labelled])

        return run

    def paired(batches):
        keys, x, labels = np.zeros(0, np.int64), np.zeros((0, words), np.uint64), np.zeros(0, np.int64)

        def out(n):
            f = x[:n]
            a, b = bucket_links(keys[:n], f, pivots, radius, labels[:n] if labelled else None)
            return pa.RecordBatch.from_arrays([pa.array(_bytes(f[a]), pa.binary()), pa.array(_bytes(f[b]), pa.binary())], ["a", "b"])

        for b in batches:
            keys = np.concatenate((keys, b.column(0).to_numpy()))
            x = np.concatenate((x, _array(b.column(1), words)))
            if labelled:
                labels = np.concatenate((labels, b.column(2).to_numpy()))
            done = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if done:
                yield out(done)
                keys, x, labels = keys[done:], x[done:], labels[done:]
        if len(keys):
            yield out(len(keys))

    def links_of(rows: DataFrame) -> DataFrame:
        return rows.repartition(F.col("key")).sortWithinPartitions("key", "fp").mapInArrow(lean(paired), "a binary, b binary")

    def rows_of(table: DataFrame) -> DataFrame:
        return table.mapInArrow(lean(keyed(pivots.segments)), schema)

    rows = rows_of(fps)
    if radius > 2:
        # Which buckets are large is told by one in ``share`` of the fingerprints. A large one that it overlooks is
        # gathered whole, up to some times the limit; nothing else depends on it.
        share = max(1, bucket_limit // 128)
        hot = large_buckets(rows_of(fps.where(F.pmod(F.xxhash64("fp"), F.lit(share)) == 0)), share, bucket_limit, "near-hot")
        return links_of(split_buckets(rows, hot, "fp", bucket_limit))
    hot = rows.groupBy("key").count().where(F.col("count") > bucket_limit)
    cold = links_of(rows.join(hot, "key", "left_anti"))

    def flips(batches):
        one = np.zeros((64 * words, words), np.uint64)
        for i in range(64 * words):
            one[i, i // 64] = np.uint64(1 << (i % 64))
        step = np.concatenate((np.zeros((1, words), np.uint64), one if radius == 2 else one[:0]))
        for b in batches:
            for part in range(0, b.num_rows, 2000):
                col = b.column(0).slice(part, 2000)
                x = _array(col, words)
                points = (x[:, None, :] ^ step[None]).reshape(-1, words)
                at = np.repeat(np.arange(len(x)), len(step))
                yield pa.RecordBatch.from_arrays([pa.array(_bytes(points), pa.binary()), col.take(pa.array(at))], ["z", "a"])

    if radius == 1:
        raise ValueError("a radius of one is not offered; use 0 or 2")
    members = rows.join(hot, "key", "left_semi").select("fp").distinct()
    met = members.mapInArrow(lean(flips), "z binary, a binary")
    least = met.groupBy("z").agg(F.min("a").alias("b"))
    return cold.union(met.join(least, "z").where("a <> b").select("a", "b").distinct())


def near_duplicates(
    docs: DataFrame,
    size: int = 3,
    words: int = 1,
    radius: int = 2,
    pivots: Pivots | None = None,
    bucket_limit: int = 8192,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """id, fingerprint (bytes) and component_id (smallest id of the component) for every row of ``docs``."""
    pivots = pivots or Pivots(words, tuple(whole_segments(words, radius)))
    prints = written(fingerprints(docs, size, words, id_col, text_col), "simhash-prints")
    classes = written(prints.df.groupBy("fp").agg(F.min("id").alias("first")), "simhash-classes")
    tree = components(fingerprint_links(classes.df, pivots, radius, bucket_limit), "simhash-links")
    rooted = classes.df.join(tree.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of_class = rooted.select("fp", "root").join(named, "root").select("fp", "component_id")
    return prints.df.join(of_class, "fp").select(F.col("id").alias(id_col), F.col("fp").alias("fingerprint"), "component_id")


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Number of shared values of two sorted arrays without repeats."""
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


def set_links(keys: np.ndarray, fps: np.ndarray, sets: list[np.ndarray], radius: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of the pairs of equal key whose sets have a Jaccard similarity of ``least`` or more."""
    n = np.fromiter(map(len, sets), np.int64, len(sets))

    def near(u, v):
        out = np.zeros(len(u), bool)
        left = np.nonzero(np.minimum(n[u], n[v]) >= least * np.maximum(n[u], n[v]) - 1e-9)[0]
        left = left[np.bitwise_count(fps[u[left]] ^ fps[v[left]]).sum(1) <= radius]
        for k in left.tolist():
            both = overlap(sets[u[k]], sets[v[k]])
            out[k] = both >= least * (n[u[k]] + n[v[k]] - both) - 1e-9
        return out

    return spanning_links(keys, near)


def keep_one(
    docs: DataFrame,
    size: int,
    words: int,
    radius: int,
    segments: list[int],
    least: float = 0.8,
    bucket_limit: int = 8192,
    block_shingles: int = 1 << 20,
    first_segments: int = 8,
    at_once: int = 36,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Of each group of texts linked by shingle sets of Jaccard similarity ``least`` or more, the row of the smallest id.

    Rows are told apart by id and text (their MD5), so null and repeated ids with unrelated texts stay; a null id
    counts as the largest, and one row stays of rows equal in both. Null and empty texts are one group, as are
    texts without words. An empty table gives no rows; other columns are carried along, whatever their names.
    Texts of equal sets are one class. Fingerprints (of the sets) within ``radius`` that meet in a segment make
    candidates; ``at_once`` segments are searched at a time, which bounds the space of their shuffle. Candidates
    are gathered by component, in blocks of at most about ``block_shingles`` shingles that meet two by two.
    """
    ready(docs.sparkSession)

    def row_key(ident, text):
        return F.unhex(F.md5(F.concat(F.coalesce(ident.cast("string"), F.lit("null")), F.lit(" "), text)))

    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    keyed = docs.select(row_key(docs[id_col], text).alias("row"), docs[id_col].alias("id"), text.alias("text"))

    def run(batches):
        for b in batches:
            sets = [np.unique(shingle_hashes(x, size)) for x in b.column(2).cast(pa.binary()).to_pylist()]
            cls = [xxhash.xxh3_128_digest(h.tobytes()) for h in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(cls, pa.binary()), pa.array([fingerprint_of(h, words) for h in sets], pa.binary()), pa.array(map(len, sets), pa.int64())],
                ["row", "id", "cls", "fp", "n"],
            )

    schema = StructType().add("row", BinaryType()).add("id", docs.schema[id_col].dataType).add("cls", BinaryType()).add("fp", BinaryType()).add("n", LongType())
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")
    classes = written(keyed.mapInArrow(lean(run), schema).groupBy("cls").agg(F.min("fp").alias("fp"), F.min("n").alias("n"), first), "near-classes").df
    fps = written(classes.where("n > 0").select("fp").distinct(), "near-prints")
    # a few segments join most groups; the others then only look for pairs that aren't joined yet
    begin = components(fingerprint_links(fps.df, Pivots(words, tuple(segments[:first_segments])), radius, bucket_limit), "near-begin")
    label = F.xxhash64(F.coalesce("root", "fp")).alias("label")
    labelled = written(fps.df.join(begin.withColumnRenamed("node", "fp"), "fp", "left").select("fp", label), "near-labelled")
    rest = segments[first_segments:]
    parts = [tuple(rest[k : k + at_once]) for k in range(0, len(rest), at_once)]
    met = [written(fingerprint_links(labelled.df, Pivots(words, p), radius, bucket_limit), "near-met") for p in parts]
    links = begin.select(F.col("node").alias("a"), F.col("root").alias("b"))
    for other in met:
        links = links.union(other.df)
    tree = components(links, "near-candidates")
    for t in (fps, labelled, *met):
        t.drop()
    rooted = classes.join(tree.withColumnRenamed("node", "fp"), "fp", "left").select("cls", "fp", "n", F.col("first.row").alias("row"), F.coalesce("root", "fp").alias("root"))
    many = rooted.groupBy("root").agg(F.count("*").alias("c"), F.sum("n").alias("total")).where("c > 1").drop("c")
    members = written(rooted.join(many, "root").select("row", "cls", "fp", F.xxhash64("root").alias("key"), F.ceil(2 * F.col("total") / block_shingles).alias("count")), "near-members")

    def with_set(batches):
        for b in batches:
            sets = [np.unique(shingle_hashes(x, size)).tobytes() for x in b.column(4).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(sets, pa.binary())], ["key", "cls", "fp", "count", "set"])

    def verified(batches):
        keys, cls, fp, sets = np.zeros(0, np.int64), [], [], []

        def out(n):
            a, b = set_links(keys[:n], np.frombuffer(b"".join(fp[:n]), ">u8").astype(np.uint64).reshape(-1, words), sets[:n], radius, least)
            return pa.RecordBatch.from_arrays([pa.array([cls[i] for i in a], pa.binary()), pa.array([cls[i] for i in b], pa.binary())], ["a", "b"])

        for b in batches:
            keys = np.concatenate((keys, b.column(0).to_numpy()))
            cls += b.column(1).to_pylist()
            fp += b.column(2).to_pylist()
            sets += [np.frombuffer(x, np.uint64) for x in b.column(3).to_pylist()]
            done = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if done:
                yield out(done)
                keys, cls, fp, sets = keys[done:], cls[done:], fp[done:], sets[done:]
        if len(keys):
            yield out(len(keys))

    texts = keyed.join(members.df, "row").dropDuplicates(["row"]).select("key", "cls", "fp", "count", "text")
    rows = met_in_blocks(texts.mapInArrow(lean(with_set), "key long, cls binary, fp binary, count long, set binary"), "cls", F.col("count"))
    pairs = rows.select("key", "cls", "fp", "set").repartition(F.col("key")).sortWithinPartitions("key", F.length("set"), "fp")
    near = components(pairs.mapInArrow(lean(verified), "a binary, b binary"), "near-links")
    members.drop()
    named = classes.join(near.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    chosen = named.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias("_chosen"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    own, text = (F.col(names[docs.columns.index(c)]) for c in (id_col, text_col))
    text = F.coalesce(text.cast("string"), F.lit(""))
    kept = plain.withColumn("_row", row_key(own, text)).join(chosen, F.col("_row") == F.col("_chosen"), "left_semi")
    return kept.dropDuplicates(["_row"]).drop("_row").toDF(*docs.columns)
