"""Document fingerprints by a randomised edit embedding.

All texts share one random walk rule: at step t the walk stands on a character, notes it, and moves on by
one character or not, by a random bit that depends on t and the character alone. The notes of about two steps
a character form the embedding: texts that differ by few edits fall into step again after each edit, so their
embeddings differ in few places (Hamming distance in place of edit distance).

The fingerprint samples the embedding: steps are dealt at random to ``places`` bins, and each bin keeps four
bits (1 to 15) of the note at its step of least random priority among the steps that the text's length
allows. So texts of different lengths sample mostly the same steps, and the whole text is covered. A bin
without a step, or whose step comes after the text's end, is 0. Likeness is the share of bins that agree, less what chance would give.

``fingerprints_with_edits`` adds the fingerprint of an edited text and the likeness to the next document;
``classes_of`` groups fingerprints by banding of sampled bins and verification of all bins.

Null texts count as empty; an empty text has only zeros, and two of those are alike by 1. Rows of one id are
taken in the order of their text's hash; repeated rows are a document each. An empty table gives no rows. Long
texts are walked whole, one after the other. Only the id and text columns are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructType

from ._components import components
from ._run import lean, ready, written
from ._text import mix, strings
from .simhash import large_buckets, spanning_links, split_buckets

PLACES = 128
PERIOD = 4096
#: Characters walked at once, or one longer text; and from how few walkers on each goes by itself.
CHARS, FEW = 8_000_000, 16
_RULE: list[np.ndarray] = []
_NOTES: dict[int, tuple[list[int], dict[int, int]]] = {}


def rule() -> np.ndarray:
    """The random bit for each step (repeating) and character class; class 0 ends a text and never moves."""
    if not _RULE:
        bits = np.random.default_rng(20).integers(0, 2, (PERIOD, 256), np.uint8)
        bits[:, 0] = 0
        _RULE.append(bits)
    return _RULE[0]


def steps_for(n: int) -> int:
    return 2 * n + 4 * math.isqrt(n) + 16 if n else 0


def sampled_steps(limit: int, places: int) -> tuple[list[int], dict[int, int]]:
    """Steps below a power of two of at least ``limit`` that are the best of their bin so far, and their bins."""
    size = 1 << max(12, (limit - 1).bit_length())
    if size not in _NOTES:
        h = mix(np.arange(size, dtype=np.uint64) + np.uint64(977))
        bins, priority = (h % np.uint64(places)).astype(np.int64), mix(h)
        found: dict[int, int] = {}
        for b in range(places):
            own = np.nonzero(bins == b)[0]
            least = np.minimum.accumulate(priority[own])
            for t in own[priority[own] == least].tolist():
                found[t] = b
        _NOTES[size] = sorted(found), found
    return _NOTES[size]


def _note(step: int, symbols: np.ndarray) -> np.ndarray:
    value = (mix(symbols.astype(np.uint64) + np.uint64(step) * np.uint64(0x100000001B3)) % np.uint64(15)).astype(np.uint8) + 1
    return np.where(symbols > 0, value, 0).astype(np.uint8)


def walk(texts: list[str], places: int = PLACES) -> np.ndarray:
    """Fingerprints of the texts: a row of bins each."""
    out = np.zeros((len(texts), places), np.uint8)
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    order = [i for i in order if texts[i]]
    if not order:
        return out
    codes = np.frombuffer("\0".join([texts[i] for i in order] + [""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    symbols = (codes % 255 + 1).astype(np.uint8)
    lengths = np.array([len(texts[i]) for i in order])
    ends = np.cumsum(lengths + 1) - 1
    symbols[ends] = 0
    pos = ends - lengths
    limits = [steps_for(int(n)) for n in lengths]
    minus = -np.array(limits)
    notes, bins = sampled_steps(limits[0], places)
    bits = rule()
    found = np.zeros((len(order), places), np.uint8)
    here, move = np.zeros(len(order), np.uint8), np.zeros(len(order), np.uint8)
    done = 0
    for turn, step in enumerate([*notes, limits[0]]):
        if step > limits[0]:
            step = limits[0]
        t = done
        while t < step:
            k = int(np.searchsorted(minus, -t))
            if k < FEW:
                break
            stop = min(step, t + 256)
            p, h, m = pos[:k], here[:k], move[:k]
            for u in range(t, stop):
                symbols.take(p, out=h, mode="clip")
                bits[u % PERIOD].take(h, out=m, mode="clip")
                np.add(p, m, out=p)
            t = stop
        if t < step:
            k = int(np.searchsorted(minus, -t))
            _alone(symbols, pos[:k], limits[:k], t, notes[turn:], bins, found, bits)
            break
        done = step
        if step == limits[0]:
            break
        k = int(np.searchsorted(minus, -step))
        found[:k, bins[step]] = _note(step, symbols[pos[:k]])
    out[order] = found
    return out


def _alone(symbols, pos, limits, t0: int, notes: list[int], bins, found, bits) -> None:
    """The rest of the walk for the few longest texts, one after the other."""
    rows = [r.tobytes() for r in bits]
    for i in range(len(pos)):
        p, t = int(pos[i]), t0
        end = p + int(np.argmax(symbols[p:] == 0))
        text = symbols[p : end + 1].tobytes()
        p = 0
        for note in [*notes, limits[i]]:
            note = min(note, limits[i])
            for u in range(t, note):
                p += rows[u % PERIOD][text[p]]
            t = note
            if note == limits[i]:
                break
            found[i, bins[note]] = _note(note, np.array([text[p]], np.uint8))[0]


_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def as_strings(rows: np.ndarray) -> list[str]:
    raw, n = _HEX[rows].tobytes().decode(), rows.shape[1]
    return [raw[i : i + n] for i in range(0, len(raw), n)] if n else []


def as_rows(prints: list[str]) -> np.ndarray:
    raw = np.frombuffer("".join(prints).encode(), np.uint8)
    digits = np.where(raw < 58, raw - 48, raw - 87)
    return digits.reshape(len(prints), -1) if prints else np.zeros((0, PLACES), np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of the bins held by either text that agree, less chance; 1 for two empty texts."""
    held = ((a > 0) | (b > 0)).sum(1)
    share = np.where(held == 0, 1.0, (((a == b) & (a > 0)).sum(1)) / np.maximum(held, 1))
    return np.clip((share - 1 / 15) / (14 / 15), 0.0, 1.0)


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as many first characters of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _schema(id_field) -> StructType:
    out = StructType().add("id", id_field.dataType).add("n_chars", LongType())
    for c in ("edited_sha256", "fingerprint", "edited_fingerprint"):
        out = out.add(c, StringType())
    return out.add("near_edited", DoubleType()).add("near_next", DoubleType())


_COLUMNS = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _pairs(ids: list, texts: list[str], following: list[str], prints: np.ndarray, next_prints: np.ndarray, id_type) -> list[pa.Array]:
    changed = [edited(a, b) for a, b in zip(texts, following, strict=True)]
    new = walk(changed)
    return [
        pa.array(ids, id_type), pa.array([len(t) for t in texts], pa.int64()), pa.array([_sha(t) for t in changed], pa.string()), pa.array(as_strings(prints), pa.string()),
        pa.array(as_strings(new), pa.string()), pa.array(likeness(prints, new)), pa.array(likeness(prints, next_prints)),
    ]


def fingerprints_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, with likenesses; see ``edited``.

    The next document is the one that follows by descending id, after the last the first. Documents are dealt
    by id ranges, one shuffle; a partition hands its first and last document to a table of two rows a
    partition, which gives the partitions' last documents their next ones.
    """
    spark = docs.sparkSession
    ready(spark)
    field = docs.schema[id_col]
    plain = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = plain.repartitionByRange(n, F.desc("id")).sortWithinPartitions(F.desc("id"), F.xxhash64("text"))
    schema = _schema(field).add("edge", IntegerType()).add("part", IntegerType()).add("text", StringType())

    def run(batches):
        part = TaskContext.get().partitionId()
        first = True
        ids: list = []
        texts: list[str] = []
        prints = np.zeros((0, PLACES), np.uint8)
        kind = None

        def edge(which: int, ident, text, row):
            cols = [pa.array([ident], kind), pa.array([len(text)], pa.int64()), pa.nulls(1, pa.string()), pa.array(as_strings(row[None]), pa.string()), pa.nulls(1, pa.string()), pa.nulls(1, pa.float64()), pa.nulls(1, pa.float64())]
            return pa.RecordBatch.from_arrays([*cols, pa.array([which], pa.int32()), pa.array([part], pa.int32()), pa.array([text], pa.string())], [*_COLUMNS, "edge", "part", "text"])

        def flush(new_ids, new_texts):
            nonlocal ids, texts, prints
            fresh = walk(new_texts)
            ids, texts, prints = ids + new_ids, texts + new_texts, np.concatenate((prints, fresh))
            m = len(ids) - 1
            if m > 0:
                cols = _pairs(ids[:m], texts[:m], texts[1:], prints[:m], prints[1:], kind)
                rest = [pa.array([0] * m, pa.int32()), pa.array([part] * m, pa.int32()), pa.nulls(m, pa.string())]
                out = pa.RecordBatch.from_arrays([*cols, *rest], [*_COLUMNS, "edge", "part", "text"])
                ids, texts, prints = ids[m:], texts[m:], prints[m:]
                return out
            return None

        held_ids: list = []
        held_texts: list[str] = []
        size = 0
        for b in batches:
            kind = b.column(0).type
            for ident, text in zip(b.column(0).to_pylist(), strings(b.column(1)), strict=True):
                if first:
                    yield edge(1, ident, text, walk([text])[0])
                    first = False
                held_ids.append(ident)
                held_texts.append(text)
                size += len(text)
                if size >= CHARS:
                    if (out := flush(held_ids, held_texts)) is not None:
                        yield out
                    held_ids, held_texts, size = [], [], 0
        if kind is not None:
            if held_ids and (out := flush(held_ids, held_texts)) is not None:
                yield out
            yield edge(2, ids[0], texts[0], prints[0])

    done = written(dealt.mapInArrow(lean(run), schema), "editprint").df
    edges = done.where("edge > 0").select("id", "text", "fingerprint", "edge", "part")
    # a row of two numbers a partition, in one window; the texts themselves are joined by partition
    parts = edges.where("edge = 1").select("part")
    line = Window.orderBy("part")
    head = F.first("part").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    following = parts.select("part", F.coalesce(F.lead("part").over(line), head).alias("next"))
    heads = edges.where("edge = 1").select(F.col("part").alias("next"), F.col("text").alias("t2"), F.col("fingerprint").alias("f2"))
    tails = edges.where("edge = 2").drop("edge").join(following, "part").join(heads, "next").select("id", "text", "fingerprint", "t2", "f2")

    def finish(batches):
        for b in batches:
            for i in range(b.num_rows):
                c = b.slice(i, 1)
                a = [c.column(k).to_pylist() for k in range(5)]
                yield pa.RecordBatch.from_arrays(_pairs(a[0], a[1], a[3], as_rows(a[2]), as_rows(a[4]), c.column(0).type), _COLUMNS)

    out = done.where("edge = 0").select(*_COLUMNS).union(tails.mapInArrow(lean(finish), _schema(field)))
    return out.withColumnRenamed("id", id_col)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fingerprint of every whole text."""
    ready(docs.sparkSession)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(as_strings(walk(strings(b.column(1)))), pa.string())], ["id", "fingerprint"])

    schema = StructType().add("id", docs.schema[id_col].dataType).add("fingerprint", StringType())
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(lean(run), schema).withColumnRenamed("id", id_col)


def classes_of(prints: DataFrame, least: float = 0.8, bands: int = 16, bins: int = 6, bucket_limit: int = 8192, at_once: int = 8) -> DataFrame:
    """fingerprint and class_id (smallest id) of groups linked by likeness of at least ``least``.

    ``prints`` has columns id and fingerprint. Equal fingerprints are one class. Each band is a random sample of
    bins; classes that agree in a band's bins meet in a bucket, and pairs there are verified on all bins. At a
    likeness of 0.8 a pair meets in one of 16 bands of 6 bins with probability 0.995, at 0.9 with 0.999999;
    unrelated texts meet once in 700,000 times. A bucket of more than about ``bucket_limit`` classes (told by a
    sample of them) is dealt into blocks that meet two by two, so every pair of it is still looked at. ``at_once``
    bands are searched at a time, which bounds the space of their shuffle. Fingerprints without a bin (of empty
    texts) are one class.
    """
    classes = written(prints.groupBy("fingerprint").agg(F.min("id").alias("first")), "editprint-classes")
    rng = np.random.default_rng(31)
    picks = [rng.choice(PLACES, bins, replace=False) for _ in range(bands)]

    def keyed(low: int, high: int):
        def run(batches):
            for b in batches:
                rows = as_rows(b.column(0).to_pylist())
                packed = pa.array(_packed(rows), pa.binary())
                for k in range(low, high):
                    key = np.full(len(rows), k + 1, np.uint64)
                    for place in picks[k].tolist():
                        key = mix(key * np.uint64(31) + rows[:, place].astype(np.uint64))
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), packed], ["key", "fp"])

        return run

    def paired(batches):
        keys, prints_ = np.zeros(0, np.int64), []

        def out(k, f):
            rows = _unpacked(f)
            u, v = spanning_links(k, lambda a, b: likeness(rows[a], rows[b]) >= least)
            return pa.RecordBatch.from_arrays([pa.array([f[i] for i in u], pa.binary()), pa.array([f[i] for i in v], pa.binary())], ["a", "b"])

        for b in batches:
            keys = np.concatenate((keys, b.column(0).to_numpy()))
            prints_ += b.column(1).to_pylist()
            done = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if done:
                yield out(keys[:done], prints_[:done])
                keys, prints_ = keys[done:], prints_[done:]
        if len(keys):
            yield out(keys, prints_)

    share, links = max(1, bucket_limit // 128), None
    for low in range(0, bands, at_once):
        run = lean(keyed(low, min(bands, low + at_once)))
        rows = classes.df.select("fingerprint").mapInArrow(run, "key long, fp binary")
        some = classes.df.select("fingerprint").where(F.pmod(F.xxhash64("fingerprint"), F.lit(share)) == 0).mapInArrow(run, "key long, fp binary")
        hot = large_buckets(some, share, bucket_limit, "editprint-hot")
        dealt = split_buckets(rows, hot, "fp", bucket_limit)
        found = written(dealt.repartition(F.col("key")).sortWithinPartitions("key", "fp").mapInArrow(lean(paired), "a binary, b binary"), "editprint-met").df
        links = found if links is None else links.union(found)
    tree = components(links, "editprint-links")
    fp = F.unhex("fingerprint")
    rooted = classes.df.withColumn("fp", fp).join(tree.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("first").alias("class_id"))
    return rooted.select("fingerprint", "root").join(named, "root").select("fingerprint", "class_id")


def _packed(rows: np.ndarray) -> list[bytes]:
    """Two bins a byte, as the hexadecimal string reads."""
    raw, n = (rows[:, ::2] << 4 | rows[:, 1::2]).astype(np.uint8).tobytes(), rows.shape[1] // 2
    return [raw[i : i + n] for i in range(0, len(raw), n)] if n else []


def _unpacked(prints: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(prints), np.uint8).reshape(len(prints), -1)
    out = np.empty((len(prints), 2 * raw.shape[1]), np.uint8)
    out[:, ::2], out[:, 1::2] = raw >> 4, raw & 15
    return out


def similar_documents(docs: DataFrame, least: float = 0.8, bands: int = 16, bins: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and class_id of every document; see ``classes_of``."""
    prints = written(fingerprints(docs, id_col, text_col).toDF("id", "fingerprint"), "editprint-prints").df
    return prints.join(classes_of(prints, least, bands, bins), "fingerprint").select(F.col("id").alias(id_col), "class_id")


def with_classes(done: DataFrame, least: float = 0.8, id_col: str = "doc_id") -> DataFrame:
    """Rows with a ``fingerprint``, each with its class: see ``classes_of``."""
    return done.join(classes_of(done.select(F.col(id_col).alias("id"), "fingerprint"), least), "fingerprint")
