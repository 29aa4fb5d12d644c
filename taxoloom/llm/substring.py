"""Substring dedup: word windows that occur more than once, found by level-wise doubling.

Lengths double from a small one up to the window: 9, 18 and 35 words for 35 (``level_lengths``). Every full
window is represented at each level by one window of that length inside of it: at the lowest by the one of
smallest hash (the leftmost of equals), and at each next by the one of twice the length that starts there, or
ends where it ends if there is no room. The choice depends on the words alone, so equal full windows have
equal representatives, and one in about fourteen short windows is looked at. Level by level, those whose hash
occurs at least twice survive and are extended to twice the length, until none is left or the window is
reached: there all full windows of the surviving representatives are counted. A full window that is repeated
always survives; one that survives the last level has its words removed. Nothing longer needs to be looked
at, for longer repeats are covered by their windows.

Equal texts (by MD5) send their windows once, with a mark, so a text copied thousands of times costs as much
as one copied twice; all windows of a copied text are repeated. Counting aggregates before it shuffles, and
the way back from a hot window to its places is a join that Spark can split.

Null texts count as empty and stay null. Texts with fewer words than a window lose nothing. Repeated rows
count as copies of each other. An empty table gives no rows. Texts of any length are handled whole, in memory
of some words' hashes a task. Other columns of any name are carried along or left out, unread. Hashes of 64
bits pick candidates; full windows are told apart by two independent ones.
"""

from __future__ import annotations

import hashlib
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from ._run import lean, ready, written
from ._text import mix

_STEP = np.uint64(0xD6E8FEB86659FD93)


def word_hashes(words: list[bytes], seed: int = 0) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words, repeat(seed)), np.uint64, len(words))


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _STEP + (b ^ (b >> np.uint64(29))))


def window_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """Hash of every window of so many words, by doubling; the last step overlaps."""
    if len(h) < length:
        return np.zeros(0, np.uint64)
    size = 1
    while 2 * size <= length:
        h = _joined(h[: len(h) - size], h[size:])
        size *= 2
    if size < length:
        h = _joined(h[: len(h) - (length - size)], h[length - size :])
    return h


def picked(short: np.ndarray, span: int) -> np.ndarray:
    """For each run of ``span`` short windows the place of the smallest, the leftmost of equals."""
    n = len(short) - span + 1
    best, at = short, np.arange(len(short))
    size = 1
    while size < span:
        step = min(size, span - size)
        left, right = best[: len(best) - step], best[step:]
        keep = left <= right
        best = np.where(keep, left, right)
        at = np.where(keep, at[: len(at) - step], at[step:])
        size += step
    return at[:n]


def level_lengths(window: int, least: int = 8) -> list[int]:
    """Lengths below ``window``, each half of the next (rounded up), from the smallest of at least ``least``; one at least."""
    out = [(window + 1) // 2]
    while (out[0] + 1) // 2 >= least:
        out.insert(0, (out[0] + 1) // 2)
    return out


def representatives(words: list[bytes], window: int, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For each full window its representatives' hashes and starts: two arrays of a row a level."""
    count = len(words) - window + 1
    h = word_hashes(words)
    first = window_hashes(h, lengths[0])
    start = picked(first, window - lengths[0] + 1)
    hashes, starts = [first[start]], [start]
    begin, before = np.arange(count), lengths[0]
    for length in lengths[1:]:
        start = np.where(start + length <= begin + window, start, start + before - length)
        hashes.append(window_hashes(h, length)[start])
        starts.append(start)
        before = length
    return np.stack(hashes), np.stack(starts)


def candidates(raw: bytes, window: int, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of representatives: hashes and starts, a row a candidate and a column a level."""
    w = raw.split()
    if len(w) < window:
        return np.zeros((0, len(lengths)), np.uint64), np.zeros((0, len(lengths)), np.int64)
    h, s = representatives(w, window, lengths)
    new = np.ones(s.shape[1], bool)
    new[1:] = (s[:, 1:] != s[:, :-1]).any(0)  # equal rows follow one another
    return h[:, new].T, s[:, new].T


def full_windows(raw: bytes, window: int, lengths: list[int], places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes and the start of the full windows whose last representative starts at one of the places."""
    w = raw.split()
    _, s = representatives(w, window, lengths)
    start = np.nonzero(np.isin(s[-1], places))[0]
    out = [window_hashes(word_hashes(w, seed), window)[start] for seed in (0, 1)]
    return out[0], out[1], start


def kept_words(raw: bytes, window: int, starts: np.ndarray | None, everything: bool) -> tuple[int, list[bytes]]:
    """How many words a text has, and those outside of the windows that start at ``starts``."""
    w = raw.split()
    if everything and len(w) >= window:
        return len(w), []
    if starts is None or not len(starts):
        return len(w), w
    edge = np.zeros(len(w) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    free = np.nonzero(np.cumsum(edge)[:-1] == 0)[0]
    return len(w), [w[i] for i in free.tolist()]


def _texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def repeated_windows(keyed: DataFrame, window: int) -> DataFrame:
    """For each text (``_t``, the MD5 of column ``_text``) with a repeated window: ``starts`` of the windows, ``whole``.

    ``whole`` says that the whole text occurs more than once; its starts are then null or partial.
    """
    lengths = level_lengths(window)

    def low(batches):
        for b in batches:
            keys = b.column(0)
            got = [candidates(x, window, lengths) for x in _texts(b.column(1))]
            n = [len(h) for h, _ in got]
            if sum(n):
                hashes, starts = (np.concatenate([g[k] for g in got]) for k in (0, 1))
                lead = np.repeat([int.from_bytes(k[:8], "little", signed=True) for k in keys.to_pylist()], n)
                cols = [keys.take(pa.array(np.repeat(np.arange(len(n)), n)))]
                for j in range(len(lengths)):  # the place as a number of its own
                    place = mix(lead.view(np.uint64) + starts[:, j].astype(np.uint64) * _STEP)
                    cols += [pa.array(np.ascontiguousarray(hashes[:, j]).view(np.int64)), pa.array(place.view(np.int64))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(starts[:, -1].astype(np.int32))], ["_t", *level_names, "at"])

    level_names = [f"{c}{j}" for j in range(len(lengths)) for c in "hp"]
    schema = ", ".join(["_t binary", *(f"{c} long" for c in level_names), "at int"])
    copies = keyed.groupBy("_t").agg(F.count("*").alias("c"), F.min("_id").alias("first")).where("c > 1")
    copied = written(copies, "substring-copies")
    # Written, so that both sides of the joins are exchanges of their own, whose large partitions Spark splits.
    level = written(keyed.select("_t", "_text").mapInArrow(lean(low), schema), "substring-level")
    for j in range(len(lengths)):
        spread = level.df.groupBy(f"h{j}").agg(F.min(f"p{j}").alias("a"), F.max(f"p{j}").alias("b"), F.min("_t").alias("_t"))
        # one place alone is no repeat, unless its text has copies
        alone = spread.where("a = b").join(copied.df.select("_t"), "_t", "left_semi").select(f"h{j}")
        twice = written(spread.where("a <> b").select(f"h{j}").union(alone), "substring-twice")
        survivors = level.df.join(twice.df, f"h{j}", "left_semi").drop(f"h{j}", f"p{j}")
        new = written(survivors, "substring-level")
        level.drop()
        twice.drop()
        level = new
        if level.df.isEmpty():
            break
    found = written(level.df.groupBy("_t").agg(F.collect_set("at").alias("places")).join(copied.df, "_t", "left"), "substring-places")
    level.drop()

    def windows(batches):
        for b in batches:
            got = [full_windows(x, window, lengths, np.array(p)) for x, p in zip(_texts(b.column(1)), b.column(2).to_pylist(), strict=True)]
            n = [len(s) for _, _, s in got]
            if sum(n):
                h, g, at = (np.concatenate([x[k] for x in got]) for k in range(3))
                row = pa.array(np.repeat(np.arange(len(n)), n))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(g.view(np.int64)), b.column(0).take(row), pa.array(at.astype(np.int32)), b.column(3).take(row)], ["h", "g", "_t", "at", "w"])

    # rows of one text and id are alike: if several are sent, they count as the copies that they are
    weight = F.when(F.col("c").isNull(), 1).otherwise(2)
    one_each = keyed.join(found.df, "_t").where(F.col("c").isNull() | F.col("_id").eqNullSafe(F.col("first")))
    full = written(one_each.select("_t", "_text", "places", weight.alias("w")).mapInArrow(lean(windows), "h long, g long, _t binary, at int, w int"), "substring-windows")
    twice = written(full.df.groupBy("h", "g").agg(F.sum("w").alias("c")).where("c > 1").select("h", "g"), "substring-twice")
    starts = full.df.join(twice.df, ["h", "g"], "left_semi").groupBy("_t").agg(F.collect_set("at").alias("starts"))
    whole = copied.df.select("_t", F.lit(True).alias("whole"))
    result = written(starts.join(whole, "_t", "full").select("_t", "starts", F.coalesce("whole", F.lit(False)).alias("whole")), "substring-starts")
    for t in (found, full, twice, copied):
        t.drop()
    return result.df


def dedup(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Remove every word covered by a window that also starts anywhere else, in the same document or another.

    With ``digest``: id, n_words, n_removed, kept_sha256. Else all columns of ``docs``, the text replaced by
    the kept words joined by blanks where something was removed and untouched elsewhere, and n_removed.
    """
    ready(docs.sparkSession)
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    text, ident = names[docs.columns.index(text_col)], names[docs.columns.index(id_col)]
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    keyed = plain.select(F.unhex(F.md5(whole)).alias("_t"), F.col(ident).alias("_id"), whole.alias("_text"))
    found = repeated_windows(keyed, window)
    kept = [ident] if digest else [c for c in names if c != text]
    full = plain.withColumn("_t", F.unhex(F.md5(whole))).join(found, "_t", "left")
    fields = [plain.schema[c] for c in kept]

    def run(batches):
        for b in batches:
            at = len(kept)
            n, removed, out = [], [], []
            raws = b.column(at).cast(pa.binary()).to_pylist()
            for raw, s, e in zip(raws, b.column(at + 1).to_pylist(), b.column(at + 2).to_pylist(), strict=True):
                count, left = kept_words(raw or b"", window, None if s is None else np.array(s), bool(e))
                n.append(count)
                removed.append(count - len(left))
                if digest:
                    out.append(hashlib.sha256(b" ".join(left)).hexdigest())
                else:
                    out.append(b" ".join(left).decode() if count > len(left) else None if raw is None else raw.decode())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(at)), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(out, pa.string())],
                [*kept, "n_words", "n_removed", "out"],
            )

    schema = StructType([*fields]).add("n_words", LongType()).add("n_removed", LongType()).add("out", StringType())
    done = full.select(*kept, F.col(text).cast("string"), "starts", "whole").mapInArrow(lean(run), schema)
    if digest:
        return done.select(F.col(ident).alias(id_col), "n_words", "n_removed", F.col("out").alias("kept_sha256"))
    back = [F.col("out" if c == text else c).alias(o) for c, o in zip(names, docs.columns, strict=True)]
    return done.select(*back, *([] if "n_removed" in docs.columns else ["n_removed"]))
