"""License scans: runs of words compared with licence templates by the Dice coefficient of word bigrams.

Text is normalised (lower case; every run of characters other than letters, digits, dots and plus signs is
one blank; dots at word ends go). With A and B the bigram counts of a run of words and a template, Dice is
2 |A and B| / (|A| + |B|), with multiplicity. At a threshold t it can only be reached if |A| lies between
t/(2-t) |B| and (2-t)/t |B|, which bounds the size of runs. Three prunings, all exact, leave few of them:

* a template whose anchor words (words without whose bigrams the threshold is out of reach) aren't in the text
  is passed over;
* a best run begins and ends with a bigram of the template, or dropping it would raise the score;
* between its ends must lie so many bigrams of the template that the threshold can be reached at all.

Runs may start and end anywhere, whatever lines they stand on. Of overlapping matches the one of highest Dice
times matching bigrams stays, then the shorter, then the earlier, then the first template by name. So a notice
inside of a full licence text gives way to the full text.

Null and empty texts match nothing. Repeated rows are scanned each; whole texts of any length are scanned. An
empty table gives no rows. Only the id and text columns are read, so other columns can't clash.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructType

from ._run import lean, ready
from ._text import strings
from .license_texts import TEMPLATES

_GAP = re.compile(r"[^\w.+]+|\.(?![^\W_])|_+")


def words(text: str) -> list[str]:
    return _GAP.sub(" ", text.lower()).split()


def bigrams(w: list[str]) -> Counter:
    return Counter(zip(w, w[1:], strict=False))


def dice(a: Counter, b: Counter) -> float:
    total = sum(a.values()) + sum(b.values())
    return 2 * sum((a & b).values()) / total if total else 0.0


class Scanner:
    def __init__(self, templates=TEMPLATES, threshold: float = 0.8):
        self.threshold = threshold
        self.templates = []
        everywhere: Counter = Counter(x for _, t in templates for x in set(words(t)))
        anchors: set[str] = set()
        for name, text in sorted(templates):
            w = words(text)
            b = bigrams(w)
            n = sum(b.values())
            own: list[str] = []
            for x in sorted(set(w), key=lambda x: (everywhere[x], -len(x), x)):
                left = sum(c for pair, c in b.items() if not set(own) & set(pair))
                if 2 * left < threshold * (left + n):
                    break
                own.append(x)
            anchors |= set(own)
            low, high = n * threshold / (2 - threshold), n * (2 - threshold) / threshold
            self.templates.append((name, b, n, low, high, set(own)))
        self.anchor = re.compile("|".join(map(re.escape, sorted(anchors, key=len, reverse=True)))) if anchors else None

    def scan(self, text: str) -> list[tuple[str, int, int, float]]:
        """Best template of each matching run of words: name, first line, number of lines, Dice."""
        lowered = text.lower()
        if self.anchor is None or not self.anchor.search(lowered):
            return []
        w, line = [], []
        for i, x in enumerate(text.split("\n")):
            got = words(x)
            w += got
            line += [i] * len(got)
        there = set(w)
        templates = [t for t in self.templates if not t[5].isdisjoint(there)]
        if not templates:
            return []
        places: dict[tuple[str, str], list[int]] = {}
        for i, pair in enumerate(zip(w, w[1:], strict=False)):
            places.setdefault(pair, []).append(i)
        found = []
        for name, b, n, low, high, _ in templates:
            spots = sorted(i for pair in b for i in places.get(pair, ()))
            need = int(np.ceil(self.threshold * (low + n) / 2 - 1e-9))  # matches that the smallest run needs
            if len(spots) < need:
                continue
            at = np.array(spots)
            near = np.nonzero(at[need - 1 :] - at[: len(at) - need + 1] < high)[0]
            for k in near.tolist():
                first = spots[k]
                seen: Counter = Counter()
                both = 0
                for last in spots[k:]:
                    size = last - first + 1
                    if size > high:
                        break
                    x = w[last], w[last + 1]
                    seen[x] += 1
                    both += seen[x] <= b[x]
                    d = 2 * both / (size + n)
                    if size >= low and d >= self.threshold:
                        found.append((-d * both, size, first, name, d))
        out, used = [], set()
        for _, size, first, name, d in sorted(found):
            span = range(first, first + size + 1)
            if used.isdisjoint(span):
                used.update(span)
                out.append((first, (name, line[first], line[first + size] - line[first] + 1, d)))
        return [x for _, x in sorted(out)]


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, license (of the best run, else null), dice, n_hits and hits of every whole text.

    ``hits`` lists name, first line, number of lines and Dice of runs that don't overlap, best first chosen.
    Of equal Dice the earliest run gives ``license``.
    """
    ready(docs.sparkSession)
    hit = StructType().add("name", StringType()).add("line", IntegerType()).add("lines", IntegerType()).add("dice", DoubleType())
    kind = pa.list_(pa.struct([("name", pa.string()), ("line", pa.int32()), ("lines", pa.int32()), ("dice", pa.float64())]))
    schema = StructType().add("id", docs.schema[id_col].dataType).add("license", StringType()).add("dice", DoubleType()).add("n_hits", IntegerType()).add("hits", ArrayType(hit))

    def run(batches):
        scanner = Scanner(templates, threshold)
        for b in batches:
            got = [scanner.scan(t) for t in strings(b.column(1))]
            best = [max(g, key=lambda x: (x[3], -x[1]), default=None) for g in got]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array([x and x[0] for x in best], pa.string()), pa.array([x and x[3] for x in best], pa.float64()), pa.array([len(g) for g in got], pa.int32()),
                    pa.array([[dict(zip(("name", "line", "lines", "dice"), x, strict=True)) for x in g] for g in got], kind),
                ],
                ["id", "license", "dice", "n_hits", "hits"],
            )

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(lean(run), schema).withColumnRenamed("id", id_col)
