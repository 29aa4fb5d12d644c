"""Toxicity: a weighted lexicon matched by an Aho-Corasick automaton over folded text.

Folding lower-cases, turns homoglyphs (Cyrillic, Greek, full-width letters) and digits or signs that stand
for letters into Latin letters, and every other character into a blank. Lexicon entries are whole words or
beginnings of words; an entry inside an exception phrase doesn't count. A text's measure is the summed weight
of its matches and that sum per hundred words; a logistic function of both gives the score.

``learn`` finds the lexicon and the exceptions from labelled documents. Labels are the only thing gathered on
the driver's side of the model: at most ``max_docs`` labelled rows (by hash of the id, so the same at any
partitioning). Near copies share four min-hashes of their word triples and count as one, so a document's rare
words aren't mistaken for evidence because it was copied. Word and word-beginning counts are summed by a
distributed aggregation. An entry must hold in both halves of the documents by itself, so what one half suggests
is tried on the other. Phrases of a lexicon word and the word beside it that several clean documents and no toxic
one have are exceptions.

Null and empty texts have no match and the lowest score. Texts are scored whole, whatever their length, repeated
rows each; texts without a match tie. Empty tables give no rows, and no labels an empty lexicon. Other columns
of any name are left out or carried along unread.
"""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from ._run import lean, ready, written
from ._text import mix, strings

#: Letters that look like Latin ones (fixed values), then digits and signs used for letters.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "ԁ": "d", "ո": "n", "ѵ": "v", "ԝ": "w", "ѡ": "w", "ʏ": "y", "ɡ": "g", "ӏ": "l", "ⅼ": "l", "ƅ": "b", "ᴄ": "c", "ᴏ": "o", "ᴜ": "u", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꜱ": "s", "ս": "u", "օ": "o", "ց": "g", "հ": "h",
    "α": "a", "ο": "o", "ρ": "p", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "τ": "t", "υ": "u", "χ": "x", "ı": "i",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
PREFIXES = range(3, 9)
_SIGN = re.compile(r"[@$](?![^\W_])|(?<![^\W_])[$]")


class _Fold(dict):
    def __missing__(self, code: int):
        c = chr(code)
        if code >= 0xFF00:
            c = unicodedata.normalize("NFKC", c).lower()
        out = HOMOGLYPHS.get(c) or SUBSTITUTES.get(c) or (c if len(c) == 1 and c.isalpha() else " ")
        self[code] = out
        return out


_FOLD = _Fold()


def fold(text: str) -> str:
    """The text as the automaton reads it."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    text = text.lower()
    if "$" in text or "@" in text:
        text = _SIGN.sub(" ", text)
    return text.translate(_FOLD)


@dataclass
class Model:
    """Entries with their weights: ``" word "`` for a whole word, ``" begin"`` for a beginning."""

    entries: dict[str, float]
    coefficients: tuple[float, float, float] = (-4.0, 2.0, 0.5)
    exceptions: tuple[str, ...] = ()
    threshold: float = 0.7
    _automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def automaton(self):
        if self._automaton is None:
            a = ahocorasick.Automaton()
            for e, w in self.entries.items():
                a.add_word(e, (len(e), w))
            for p in self.exceptions:
                a.add_word(f" {fold(p)} ", (len(p) + 2, None))
            if len(a):
                a.make_automaton()
            self._automaton = a
        return self._automaton

    def measure(self, text: str) -> tuple[float, int, int]:
        """Summed weight of the matches, how many they are, and the number of words."""
        folded = f" {fold(text)} "
        words = len(folded.split())
        a = self.automaton()
        if not len(a):
            return 0.0, 0, words
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for stop, (size, weight) in a.iter(folded):
            start = stop - size + 1
            if weight is None:
                spared.append((start, stop))
            elif weight > best.get(start, 0.0):
                best[start] = weight
        for start, stop in spared:
            for at in [k for k in best if start <= k < stop]:
                del best[at]
        return sum(best.values()), len(best), words

    def phrases(self, folded: str) -> set[str]:
        """Pairs of a matching word and the word before or after it, in a folded text."""
        text, a, out = f" {' '.join(folded.split())} ", self.automaton(), set()
        if not len(a):
            return out
        for stop, (size, weight) in a.iter(text):
            start = stop - size + 1  # a blank
            if weight is None:
                continue
            end = text.index(" ", start + 1)
            after = text.find(" ", end + 1)
            before = text.rfind(" ", 0, start)
            if after > 0:
                out.add(text[start + 1 : after])
            if before >= 0:
                out.add(text[before + 1 : end])
        return out

    def score(self, text: str) -> tuple[float, int]:
        total, hits, words = self.measure(text)
        a, b, c = self.coefficients
        z = a + b * math.log1p(total) + c * math.log1p(100 * total / max(words, 1))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z)))), hits


def _features(folded: str) -> set[str]:
    found = set()
    for w in set(folded.split()):
        if len(w) >= PREFIXES[0]:
            found.add(f" {w} ")
            found.update(f" {w[:k]}" for k in PREFIXES if k <= len(w))
    return found


_SEEDS = np.array([0, 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7], np.uint64)


def _group(folded: str) -> bytes:
    """Four min-hashes of the word triples; near copies mostly share them."""
    w = folded.split()
    h = np.array([xxhash.xxh64_intdigest(" ".join(w[i : i + 3])) for i in range(max(1, len(w) - 2))], np.uint64)
    return mix(h[None] ^ _SEEDS[:, None]).min(1).tobytes()


def holds(p: int, n: int, p_first: int, n_first: int) -> bool:
    """Whether an entry's counts (all, and in the first half of the documents) speak for it in both halves."""
    return all(a > 2 * b for a, b in ((p_first, n_first), (p - p_first, n - n_first)))


def select_entries(counts: list[tuple[str, int, int]], positives: int, negatives: int, least: int) -> dict[str, float]:
    """The most telling words and beginnings, each with its log odds.

    A beginning gives way to a longer one, or a word, that has nearly all its support; what stands under a
    chosen beginning is dropped.
    """
    table = {f: (p, n) for f, p, n in counts}

    def weight(p: int, n: int) -> float:
        return math.log((p + 0.5) / (positives + 1)) - math.log((n + 0.5) / (negatives + 1))

    good = {f for f, (p, n) in table.items() if p >= least and p >= 4 * n and weight(p, n) >= 2}
    heirs: dict[str, int] = {}
    for f in good:
        stem = f.rstrip(" ") if f.endswith(" ") else f[:-1]
        while len(stem) > PREFIXES[0]:
            heirs[stem] = max(heirs.get(stem, 0), table[f][0])
            stem = stem[:-1]
    chosen: dict[str, float] = {}
    for f in sorted(good, key=lambda x: (len(x), x)):
        if any(f[:k] in chosen for k in range(PREFIXES[0] + 1, len(f))):
            continue
        if not f.endswith(" ") and heirs.get(f, 0) >= 0.9 * table[f][0]:
            continue
        chosen[f] = weight(*table[f])
    return chosen


def fit(rows: list[tuple[float, int, int]]) -> tuple[float, float, float]:
    """Logistic coefficients for (summed weight, words, label) rows, by Newton steps with a small ridge."""
    if not rows or len({r[2] for r in rows}) < 2:
        return Model({}).coefficients
    total, words, y = (np.array(c, float) for c in zip(*rows, strict=True))
    x = np.stack([np.ones_like(total), np.log1p(total), np.log1p(100 * total / np.maximum(words, 1))], 1)
    beta, ridge = np.zeros(3), np.diag([1e-3, 1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.solve(h, x.T @ (y - p) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(b) for b in beta)


def learn(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "toxic",
    id_col: str = "doc_id",
    text_col: str = "text",
    max_docs: int = 20_000,
    exceptions: tuple[str, ...] = (),
) -> Model:
    """Lexicon and score function from labelled documents; only labels 0 and 1 count, nulls don't.

    ``labels`` is what the caller lets the model see; of several labels of one id the highest counts.
    ``exceptions`` are phrases to spare besides those that are found.
    """
    spark = docs.sparkSession
    ready(spark)
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(labels[id_col].alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
    picked = known.orderBy(F.xxhash64("_id"), "_id").limit(max_docs)  # the model's sample, a documented bound
    sample = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_t")).join(F.broadcast(picked), "_id").select("_id", "_t", "_y")

    def folded(batches):
        for b in batches:
            texts = [fold(t) for t in strings(b.column(1))]
            yield pa.RecordBatch.from_arrays([pa.array(map(_group, texts), pa.binary()), b.column(2), pa.array(texts, pa.string())], ["g", "y", "t"])

    firsts = sample.mapInArrow(lean(folded), "g binary, y int, t string").groupBy("g", "y").agg(F.min("t").alias("t"))
    base = written(firsts, "toxicity-sample")

    def count(batches):
        seen: dict[str, list[int]] = {}
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                half = 2 * (xxhash.xxh64_intdigest(t) & 1)
                for f in _features(t):
                    seen.setdefault(f, [0, 0, 0, 0])[y + half] += 1
            if len(seen) > 300_000:
                yield _counts(seen)
                seen = {}
        yield _counts(seen)

    sizes = {r["y"]: r["n"] for r in base.df.groupBy("y").agg(F.count("*").alias("n")).collect()}
    positives, negatives = sizes.get(1, 0), sizes.get(0, 0)
    least = max(3, positives // 200)
    sums = [F.sum(c).alias(c) for c in ("p", "n", "p1", "n1")]
    summed = base.df.select("t", "y").mapInArrow(lean(count), "f string, p long, n long, p1 long, n1 long").groupBy("f").agg(*sums)
    # of a bounded sample, so bounded as well
    strong = summed.where((F.col("p") >= least) & (F.col("p") >= 4 * F.col("n"))).collect()
    strong = [(r.f, r.p, r.n) for r in strong if holds(r.p, r.n, r.p1, r.n1)]
    model = Model(select_entries(sorted(strong), positives, negatives, least))

    def phrases(batches):
        for b in batches:
            found = [(f, y) for t, y in zip(strings(b.column(0)), b.column(1).to_pylist(), strict=True) for f in model.phrases(t)]
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in found], pa.string()), pa.array([y for _, y in found], pa.int32())], ["f", "y"])

    beside = base.df.select("t", "y").mapInArrow(lean(phrases), "f string, y int").groupBy("f").agg(F.sum("y").alias("p"), F.count("*").alias("c"))
    spared = sorted(r.f for r in beside.where("p = 0 and c >= 3").collect())
    model = Model(model.entries, exceptions=(*exceptions, *spared))

    def measured(batches):
        for b in batches:
            got = [model.measure(t) for t in strings(b.column(0))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([g[0] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.int32()), b.column(1)], ["s", "w", "y"]
            )

    rows = base.df.select("t", "y").mapInArrow(lean(measured), "s double, w int, y int").collect()
    model.coefficients = fit(sorted(tuple(r) for r in rows))
    base.drop()
    return model


def _counts(seen: dict[str, list[int]]) -> pa.RecordBatch:
    v = np.array(list(seen.values()), np.int64).reshape(-1, 4)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(seen), pa.string()), pa.array(v[:, 1] + v[:, 3]), pa.array(v[:, 0] + v[:, 2]), pa.array(v[:, 3]), pa.array(v[:, 2])],
        ["f", "p", "n", "p1", "n1"],
    )


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Score, number of matches and 0/1 prediction of every whole text; null counts as empty.

    With ``keep`` all columns of ``docs`` stay in front and the three columns are named with a ``tox_``
    prefix; else only the id stays. Repeated rows are scored each.
    """
    ready(docs.sparkSession)
    kept = docs.columns if keep else [id_col]
    text_at = len(kept)
    prefix = "tox_" if keep else ""
    names = [*kept, f"{prefix}score", f"{prefix}hits", f"{prefix}predicted"]

    def run(batches):
        for b in batches:
            got = [model.score(t) for t in strings(b.column(text_at))]
            s = np.array([g[0] for g in got], np.float64)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(text_at)), pa.array(s), pa.array([g[1] for g in got], pa.int32()), pa.array((s >= model.threshold).astype(np.int32))],
                names,
            )

    schema = StructType([docs.schema[c] for c in kept]).add(names[-3], DoubleType()).add(names[-2], IntegerType()).add(names[-1], IntegerType())
    return docs.select(*(docs[c] for c in kept), docs[text_col].alias("_whole_text")).mapInArrow(lean(run), schema)


def keep_clean(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model doesn't reject, with their columns."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    ident, text = (names[docs.columns.index(c)] for c in (id_col, text_col))
    judged = score(docs.toDF(*names), model, ident, text, keep=True)
    return judged.where("tox_predicted = 0").select(*names).toDF(*docs.columns)
