"""URL filters: rules and blocked entries in one sorted array of 64-bit digests.

Keys are ``host + path-prefix`` strings. Their XXH64 digests are sorted and stored with the strings in
``.npy`` files, which Spark ships to every executor (``addFile``) and workers map into memory. A URL is
probed with every suffix of its host at a label border, joined with every path prefix whose length occurs
among the rules, by a binary search over all probes of a batch; a hit counts only if the stored string is
the probed one, so a digest collision can't decide.

``blocked`` is any list of hosts; ``read_hosts`` takes one from a text file (one host a line, # comments).

Null urls, or urls without ``://``, have an empty host and path and fit nothing. Very long urls are judged
whole, repeated rows each, an empty table gives no rows, and only the id and url columns are read. Rules of equal length
can't both fit unless they are the same string; of repeated rules the last one given counts.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from ._run import ready

#: Hosts that the digest array blocks where no rule fits: invented spam domains (fixed values).
DEFAULT_BLOCKED = tuple(
    f"{name}.example.{tld}" for name in ("ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm") for tld in ("com", "net", "org")
)
RULE, BLOCK = 0, 1
_OPEN: dict[str, DigestArray] = {}


def digest(keys: Iterable[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), np.uint64)


class DigestArray:
    """Sorted digests with the strings they stand for."""

    def __init__(self, folder: str):
        part = lambda name: np.load(os.path.join(folder, f"{name}.npy"), mmap_mode="r")
        self.keys, self.starts, self.blob, self.kinds = part("keys"), part("starts"), part("blob"), part("kinds")
        self.path_lengths = part("path_lengths").tolist()

    @staticmethod
    def write(folder: str, entries: dict[str, int], path_lengths: list[int]) -> None:
        names = list(entries)
        keys = digest(names)
        order = np.argsort(keys, kind="stable")
        raw = [names[i].encode() for i in order]
        np.save(os.path.join(folder, "keys.npy"), keys[order])
        np.save(os.path.join(folder, "starts.npy"), np.cumsum([0, *map(len, raw)], dtype=np.int64))
        np.save(os.path.join(folder, "blob.npy"), np.frombuffer(b"".join(raw) or b"\0", np.uint8))
        np.save(os.path.join(folder, "kinds.npy"), np.array([entries[names[i]] for i in order], np.int8))
        np.save(os.path.join(folder, "path_lengths.npy"), np.array(sorted(path_lengths), np.int64))

    def probe(self, texts: list[str]) -> np.ndarray:
        """Row of each text in the array, or -1."""
        if not texts or not len(self.keys):
            return np.full(len(texts), -1)
        wanted = digest(texts)
        at = np.searchsorted(self.keys, wanted)
        out = np.full(len(texts), -1)
        hit = np.nonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == wanted)[0]
        for i in hit.tolist():
            row, raw = int(at[i]), texts[i].encode()
            while row < len(self.keys) and self.keys[row] == wanted[i]:
                if self.blob[self.starts[row] : self.starts[row + 1]].tobytes() == raw:
                    out[i] = row
                    break
                row += 1
        return out


def read_hosts(spark, path: str) -> list[str]:
    """Hosts of a block list in any store that Spark reads; a setting of the driver's size, not a table."""
    lines = (r.value.split("#", 1)[0].strip() for r in spark.read.text(path).toLocalIterator())
    return sorted({x for x in lines if x})


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path as the operator takes them."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((i for c in "?#" if (i := rest.find(c)) >= 0), default=len(rest))
    rest = rest[:end]
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return host.translate(_LOWER), path


def _judge(array: DigestArray, rules: dict[str, str], urls: list[str | None]) -> list[tuple[str, str, str | None, str]]:
    parts = [split_url(u) for u in urls]
    probes, owner = [], []
    for i, (host, path) in enumerate(parts):
        labels = host.split(".") if host else []
        for k in range(len(labels)):
            suffix = ".".join(labels[k:])
            for n in array.path_lengths:
                if n <= len(path):
                    probes.append(suffix + path[:n])
                    owner.append(i)
            if 0 not in array.path_lengths:
                probes.append(suffix)
                owner.append(i)
    rows = array.probe(probes)
    best: dict[int, str] = {}
    blocked: set[int] = set()
    for j in np.nonzero(rows >= 0)[0].tolist():
        i, key = owner[j], probes[j]
        if array.kinds[rows[j]] == RULE:
            if len(key) > len(best.get(i, "")):
                best[i] = key
        else:
            blocked.add(i)
    return [
        (host, path, best.get(i), rules[best[i]] if i in best else ("block" if i in blocked else "allow"))
        for i, (host, path) in enumerate(parts)
    ]


def judge_urls(
    pages: DataFrame,
    rules: list[tuple[str, str, str]],
    blocked: Iterable[str] = DEFAULT_BLOCKED,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """Judge every url by ``rules`` of (verdict, host, path), else by the blocked hosts.

    Returns id, host, path, rule (host and path of the longest rule that fits, else null) and verdict.
    ``rules`` and ``blocked`` are settings held by the driver, shipped as files, never rows of a table.
    Other columns of ``pages`` are left out, so their names can't clash.
    """
    spark = pages.sparkSession
    ready(spark)
    by_rule = {host.translate(_LOWER) + path: verdict for verdict, host, path in rules}
    entries = {h.translate(_LOWER): BLOCK for h in blocked} | dict.fromkeys(by_rule, RULE)
    if len(entries) < len(set(by_rule)) + len({h.translate(_LOWER) for h in blocked}):
        raise ValueError("a rule with an empty path can't name a blocked host")
    lengths = sorted({len(path) for _, _, path in rules})
    name = f"urls-{uuid.uuid4().hex}"
    top = tempfile.mkdtemp()  # the driver's own; Spark's file server hands the archive to executors from here
    atexit.register(shutil.rmtree, top, ignore_errors=True)
    folder = os.path.join(top, name)
    os.mkdir(folder)
    DigestArray.write(folder, entries, lengths)
    archive = shutil.make_archive(folder, "zip", top, name)
    spark.sparkContext.addArchive(archive)
    shipped = f"{name}.zip/{name}"

    def run(batches):
        where = SparkFiles.get(shipped)
        array = _OPEN.get(where)
        if array is None:
            array = _OPEN[where] = DigestArray(where)
        for batch in batches:
            got = _judge(array, by_rule, batch.column(1).to_pylist())
            cols = list(zip(*got, strict=True)) if got else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.string()) for c in cols)], ["id", "host", "path", "rule", "verdict"]
            )

    kind = pages.schema[id_col].dataType.simpleString()
    out = pages.select(pages[id_col].alias("id"), pages[url_col].cast("string").alias("url")).mapInArrow(
        run, f"id {kind}, host string, path string, rule string, verdict string"
    )
    return out.withColumnRenamed("id", id_col)
