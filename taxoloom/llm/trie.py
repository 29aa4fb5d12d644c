"""Operator 13: the trie of conversation prefixes, with what a cache of shared prefixes would save.

A node is a distinct sequence of first turns; its key is a SHA-256 chained over its turns' SHA-256, so texts are neither
shuffled nor held. A task walks its conversations and combines what they share into a partial trie, a table of nodes of
bounded size. Partial tries merge as a tree: groups of partitions first, then groups of groups, by node key, summing
members. End lists merge apart from the nodes as sorted runs of bounded length, for one node may end any share of all
conversations. Sums over subtrees are rolled up from the bottom by doubling: in round k every node adds its sum to its
ancestor 2^k above, so a chain of n turns takes log2 n rounds.

A conversation of more than ``long_rows`` turns is placed by ranges and keyed in blocks of ``BLOCK`` turns (the key of a
turn is chained from the blocks before it and the turns before it in its block), so it is never one task's.

Nulls in role and text are empty; null turns come first; rows of equal turn follow in the order of their digests; rows
without conv_id take no part. An empty table gives no rows. Other columns are ignored; a very long text is one turn.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.ranking import ranked
from ._run import lean, ready, written
from ._skew import join_counted

BLOCK = 1024
#: Entries of a partial trie or ids of its end lists before it is passed on, ids in a run of an end list, partial tries a merge.
MOST_NODES, RUN, FAN = 1 << 15, 1 << 12, 32
#: Conversations share with the first of so many by number; a conversation takes at most MOST_LENT turns of it.
FAMILY, MOST_LENT = 20, 3
ROOT = b""
NODES = "key binary, parent binary, depth long, conv_id long, n_convs long, words long, ends array<long>"
_NODES = pa.schema([("key", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("n_convs", pa.int64()), ("words", pa.int64()), ("ends", pa.list_(pa.int64()))])


def _sha(*parts: bytes) -> bytes:
    return hashlib.sha256(b"".join(parts)).digest()


def _lent_to(conv_id: int) -> int:
    return zlib.crc32(str(conv_id).encode()) % (MOST_LENT + 1)


class Chain:
    """Keys of a conversation's prefixes, turn by turn; ``outer`` stands for the whole blocks before."""

    def __init__(self, block: int, outer: bytes = b"", depth: int = 0):
        self.block, self.outer, self.inner, self.depth = block, outer, b"", depth

    def add(self, said: bytes) -> bytes:
        if self.depth and self.depth % self.block == 0 and self.inner:
            self.outer, self.inner = _sha(self.outer, self.inner), b""
        self.inner = _sha(self.inner, said)
        self.depth += 1
        return _sha(self.outer, self.inner)


class PartialTrie:
    """Nodes that a task has met, combined by key."""

    def __init__(self):
        self.nodes, self.n_ends = {}, 0

    def add(self, key: bytes, parent: bytes | None, depth: int, conv_id: int, words: int) -> None:
        node = self.nodes.get(key)
        if node is None:
            self.nodes[key] = [key, parent, depth, conv_id, 1, words, []]
        else:
            node[3] = min(node[3], conv_id)
            node[4] += 1

    def end(self, key: bytes, conv_id: int) -> None:
        self.nodes[key][6].append(conv_id)
        self.n_ends += 1

    def full(self) -> bool:
        return len(self.nodes) >= MOST_NODES or self.n_ends >= MOST_NODES

    def take(self) -> pa.RecordBatch:
        rows, self.nodes, self.n_ends = list(self.nodes.values()), {}, 0
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), _NODES)], schema=_NODES)


def _walk(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Partial tries of whole conversations: a sorted stream of lent turns, then own ones."""
    trie, conv, chain, key, left = PartialTrie(), None, None, ROOT, 0
    for b in batches:
        for c, own, said, words in zip(*(b.column(x).to_pylist() for x in ("conv_id", "own", "said", "words"))):
            if c != conv:
                if conv is not None:
                    trie.end(key, conv)
                    if trie.full():
                        yield trie.take()
                conv, chain, key, left = c, Chain(block), ROOT, _lent_to(c)
                trie.add(ROOT, None, 0, c, 0)
            if own and left:
                left -= 1
                continue
            parent, key = key, chain.add(said)
            trie.add(key, parent, chain.depth, c, words)
    if conv is not None:
        trie.end(key, conv)
        yield trie.take()


def _block_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The inner digest of each block of a sorted stream."""
    at, inner = None, b""
    put = lambda: pa.record_batch([pa.array([x]) for x in (*at, inner)], names=["conv_id", "block", "inner"])
    for b in batches:
        for c, block, said in zip(*(b.column(x).to_pylist() for x in ("conv_id", "block", "said"))):
            if (c, block) != at:
                if at is not None:
                    yield put()
                at, inner = (c, block), b""
            inner = _sha(inner, said)
    if at is not None:
        yield put()


def _outers(part: pd.DataFrame) -> pd.DataFrame:
    """What stands before each block of a conversation: its chained digest and the key of its last turn; a row a block."""
    part = part.sort_values("block")
    outer, parent, rows = b"", ROOT, []
    for c, block, inner in zip(part["conv_id"], part["block"], part["inner"]):
        rows.append((c, block, outer, parent, False))
        inner = bytes(inner)
        parent, outer = _sha(outer, inner), _sha(outer, inner)
    rows[-1] = (*rows[-1][:4], True)
    return pd.DataFrame(rows, columns=["conv_id", "block", "outer", "before", "last"])


def _walk_blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Partial tries of blocks of long conversations, from a sorted stream."""
    trie, at, chain, key, last = PartialTrie(), None, None, ROOT, False
    for b in batches:
        for c, block, said, words, outer, before, is_last in zip(*(b.column(x).to_pylist() for x in ("conv_id", "block", "said", "words", "outer", "before", "last"))):
            if (c, block) != at:
                if at is not None and last:
                    trie.end(key, at[0])
                if trie.full():
                    yield trie.take()
                at, chain, key, last = (c, block), Chain(size, outer, block * size), before, is_last
                if block == 0:
                    trie.add(ROOT, None, 0, c, 0)
            parent, key = key, chain.add(said)
            trie.add(key, parent, chain.depth, c, words)
    if at is not None:
        if last:
            trie.end(key, at[0])
        yield trie.take()


def _light(df: DataFrame) -> DataFrame:
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return df.where("conv_id IS NOT NULL").select(*(F.col(c).cast("long").alias(c) for c in ("conv_id", "turn")), said.alias("said"), words.alias("words"))


def _lent(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """The first turns of each family's first conversation, once for each conversation that takes them."""
    first = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "said")
    base = turns.where(F.col("conv_id") % FAMILY == 0).withColumn("place", F.row_number().over(first)).where(F.col("place") <= MOST_LENT)
    taker = base.withColumn("taker", F.explode(F.sequence(F.col("conv_id") - (FAMILY - 1), F.col("conv_id") + (FAMILY - 1))))
    takes = F.crc32(F.col("taker").cast("string").cast("binary")) % (MOST_LENT + 1)
    taker = taker.where((F.col("taker") - F.col("taker") % FAMILY == F.col("conv_id")) & (takes >= F.col("place")))
    return taker.select(F.col("taker").alias("conv_id"), F.col("place").cast("long").alias("place"), "said", "words").join(ids, "conv_id", "left_semi")


def _short(turns: DataFrame, lent: DataFrame, block: int) -> DataFrame:
    rows = turns.withColumn("own", F.lit(True)).unionByName(lent.withColumn("own", F.lit(False)).withColumnRenamed("place", "turn"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "own", F.col("turn").asc_nulls_first(), "said")
    return rows.select("conv_id", "own", "said", "words").mapInArrow(lean(lambda batches: _walk(batches, block)), NODES)


def _long(turns: DataFrame, lent: DataFrame, block: int) -> DataFrame:
    takes = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_LENT + 1)
    own = ranked(turns, ["conv_id"], [F.col("turn").asc_nulls_first(), "said"]).where(F.col("place") > takes)
    shift = lent.groupBy("conv_id").agg(F.count("*").alias("got"))
    own = own.join(shift, "conv_id", "left").withColumn("place", F.col("place") - takes + F.coalesce("got", F.lit(0)))
    rows = own.select("conv_id", "place", "said", "words").unionByName(lent).withColumn("block", F.floor((F.col("place") - 1) / block))
    rows = written(rows, "trie-long").df
    inner = rows.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "place").select("conv_id", "block", "said").mapInArrow(lean(_block_ends), "conv_id long, block long, inner binary")
    outer = inner.groupBy("conv_id").applyInPandas(_outers, "conv_id long, block long, outer binary, before binary, last boolean")
    walked = rows.join(outer, ["conv_id", "block"]).repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "place")
    return walked.drop("place").mapInArrow(lean(lambda batches: _walk_blocks(batches, block)), NODES)


def partial_tries(df: DataFrame, long_rows: int = 1 << 16, block: int = BLOCK) -> DataFrame:
    """Nodes of the rebuilt conversations, combined within tasks: what ``merged`` takes."""
    if long_rows <= MOST_LENT:
        raise ValueError(f"long_rows must be over {MOST_LENT}")
    turns = _light(df)
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    sizes = written(sizes, "trie-sizes").df
    lent = _lent(turns, sizes.select("conv_id"))
    many = sizes.where(F.col("n") > long_rows).select("conv_id")
    if many.isEmpty():
        return _short(turns, lent, block)
    split = lambda how: (turns.join(many, "conv_id", how), lent.join(many, "conv_id", how))
    return _short(*split("left_anti"), block).union(_long(*split("left_semi"), block))


def merged(partials: DataFrame, fan: int = FAN) -> DataFrame:
    """One row a node: the partial tries of ``fan`` partitions at a time are merged by key until one is left."""
    nodes = partials.drop("ends").withColumn("group", F.spark_partition_id().cast("long"))
    groups = max(1, partials.rdd.getNumPartitions())
    while True:
        groups = -(-groups // fan)
        nodes = nodes.groupBy("key", F.floor(F.col("group") / fan).alias("group")).agg(
            F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.first("words").alias("words")
        )
        if groups == 1:
            return nodes.drop("group")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of at most RUN ids of one node from a sorted stream."""
    key, ids = None, []
    names = ["key", "least", "ids"]
    put = lambda: pa.record_batch([pa.array([key], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], names=names)
    for b in batches:
        for k, c in zip(b.column("key").to_pylist(), b.column("id").to_pylist()):
            if ids and (k != key or len(ids) >= RUN):
                yield put()
                ids = []
            key = k
            ids.append(c)
    if ids:
        yield put()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's whole end list from a sorted stream of runs."""
    key, hasher, keys, digests = None, None, [], []
    for b in batches:
        for k, ids in zip(b.column("key").to_pylist(), b.column("ids").to_pylist()):
            if k != key:
                if key is not None:
                    keys.append(key)
                    digests.append(hasher.hexdigest())
                key, hasher = k, hashlib.sha256(ids.encode())
            else:
                hasher.update(b"," + ids.encode())
        if len(keys) >= 10_000:
            yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(digests)], names=["key", "ends_sha256"])
            keys, digests = [], []
    if key is not None:
        yield pa.record_batch([pa.array([*keys, key], pa.binary()), pa.array([*digests, hasher.hexdigest()])], names=["key", "ends_sha256"])


def end_lists(partials: DataFrame) -> DataFrame:
    """Runs of each node's end list: key, the run's least id, its ids joined by commas."""
    ends = partials.where(F.size("ends") > 0).select("key", F.explode("ends").alias("id"))
    return ends.repartitionByRange("key", "id").sortWithinPartitions("key", "id").mapInArrow(lean(_runs), "key binary, least long, ids string")


def _rolled_up(nodes: DataFrame) -> DataFrame:
    """Sums over all below each node: key, leaves, saved. Depth 1 is the highest that gets any."""
    active = written(nodes.where("depth > 1").select("key", F.col("parent").alias("up"), F.col("leaf").alias("leaves"), "saved"), "trie-active")
    given = []
    while (total := active.df.count()) > 0:
        gifts = written(active.df.groupBy("up").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"), F.count("*").alias("many")), "trie-sums").df
        given.append(gifts)
        more = gifts.withColumnRenamed("up", "key")
        sums = active.df.join(more, "key", "left").select(
            "key", "up", (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"), "many"
        )
        summed = written(sums, "trie-summed")
        above = summed.df.where("many IS NOT NULL").select(F.col("key").alias("up"), F.col("up").alias("up2"), "many")
        raised = join_counted(summed.df.drop("many"), above, ["up"], total).select("key", F.col("up2").alias("up"), "leaves", "saved")
        higher = written(raised, "trie-active")
        active.drop()
        summed.drop()
        active = higher
    active.drop()
    if not given:
        return nodes.limit(0).select("key", F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))
    every = given[0]
    for more in given[1:]:
        every = every.union(more)
    return every.groupBy(F.col("up").alias("key")).agg(F.sum("more_leaves").alias("leaves"), F.sum("more_saved").alias("saved"))


def prefix_trie(df: DataFrame, long_rows: int = 1 << 16, block: int = BLOCK) -> DataFrame:
    """One row a node of the rebuilt conversations; see the module for the method, ties and nulls."""
    ready(df.sparkSession)
    partials = written(partial_tries(df, long_rows, block), "trie-partials").df
    nodes = written(merged(partials), "trie-nodes").df
    kids = nodes.where("depth > 0").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(kids, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = nodes.withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("words"))
    nodes = written(nodes, "trie-kids").df
    below = _rolled_up(nodes)
    root = nodes.agg(F.sum("leaf").alias("all_leaves"), F.sum("saved").alias("all_saved"))
    parents = nodes.where("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("many"))
    children = join_counted(nodes.where("depth > 0"), parents, ["parent"], nodes.count()).drop("many")
    top = nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    runs = end_lists(partials).repartition("key").sortWithinPartitions("key", "least")
    ends = runs.mapInArrow(lean(_hashed), "key binary, ends_sha256 string")
    out = children.unionByName(top).join(below.select("key", F.col("leaves").alias("low_leaves"), F.col("saved").alias("low_saved")), "key", "left").join(ends, "key", "left").crossJoin(F.broadcast(root))
    at_root = F.col("depth") == 0
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        F.when(at_root, F.col("all_leaves")).otherwise(F.col("leaf") + F.coalesce("low_leaves", F.lit(0))).alias("n_leaves"),
        F.when(at_root, F.col("all_saved")).otherwise(F.col("saved") + F.coalesce("low_saved", F.lit(0))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
