"""Order-preserving packing of documents into training sequences.

The documents of an input partition, in their order, form one stream of tokens: each document's ids, then a
closing id. Windows of at most ``width`` tokens are cut from the stream so that padding plus penalties is
least. Candidate cuts are document ends (free), sentence ends (``sentence_cost``) and, where neither comes
for ``width`` tokens, places half a width apart. A window between two candidates may be longer than
``width``: then it is filled up once and cut inside a sentence, at ``truncation_cost``. A sequence whose
length is a power of two needs no padding.

``best[j]`` is the least cost of packing the stream up to candidate j. A window of one sequence costs
``width - (p[j] - p[i])``, of two ``2 * width - (p[j] - p[i])`` plus the truncation, so each wants the least
``best[i] + p[i]`` over a window of candidates that only moves forward: two monotone queues give it in
constant time, whatever the width. The last sequence of a block is carried into the next one, so only a
partition's last sequence is cut short by its end. Each partition is packed by itself, without a shuffle and
in memory bounded by one block or one longer document; a task run again gives the same rows.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from ._pieces import PieceTable, split_byte_level
from ._run import lean, ready
from ._text import chunks, codes_of, gather, strings
from .bpe import byte_symbols

CHARS = 1_000_000
_CODERS: dict[str, ByteBpe] = {}
_SENTENCE_END = re.compile(r"[.!?。！？…\n][\"'”’)\]]*$")


class ByteBpe:
    """Ids of whole texts by a byte-level vocabulary file; each distinct piece goes to the library once."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            added = json.load(f).get("added_tokens", [])
        self.added = {t["content"]: t["id"] for t in added}
        self.cut = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if added else None
        self.model = Tokenizer.from_file(path).model
        self.symbols = dict(enumerate(byte_symbols()))
        self.table = PieceTable(self._piece)

    def _piece(self, piece: str) -> tuple[list[int], bool]:
        text = piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.symbols)
        return [t.id for t in self.model.tokenize(text)], bool(_SENTENCE_END.search(piece))

    def stream(self, texts: list[str], closing: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts with the closing id after each, where each text ends, and where sentences end."""
        parts, owners, marks = [], [], []
        for i, text in enumerate(texts):
            at = 0
            if self.cut is not None and any(x in text for x in self.added):
                for m in self.cut.finditer(text):
                    parts.append(text[at : m.start()])
                    owners.append(i)
                    marks.append(self.added[m[0]])
                    at = m.end()
            parts.append(text[at:])
            owners.append(i)
            marks.append(closing)
        codes, offsets = codes_of(parts)
        starts, ends, per_part = split_byte_level(codes, offsets)
        rows = self.table.lookup(codes, starts, ends)
        flat, sizes = gather(self.table.flat, self.table.offsets, rows)
        token_ends = np.cumsum(sizes)
        part_pieces = np.cumsum(per_part)
        part_ends = np.concatenate(([0], token_ends))[part_pieces]
        out = np.insert(flat, part_ends, marks).astype(np.int64)
        shifted_ends = part_ends + np.arange(1, len(parts) + 1)
        last = np.append(np.diff(np.array(owners)) > 0, True) if owners else np.zeros(0, bool)
        closes = np.fromiter(map(self.table.extra.__getitem__, rows.tolist()), bool, len(rows))
        part_of = np.repeat(np.arange(len(parts)), per_part)
        sentence_ends = (token_ends + part_of)[closes]
        return out, shifted_ends[last], sentence_ends


def coder(path: str) -> ByteBpe:
    if path not in _CODERS:
        _CODERS[path] = ByteBpe(path)
    return _CODERS[path]


def candidate_cuts(doc_ends: np.ndarray, sentence_ends: np.ndarray, width: int, sentence_cost: float, truncation_cost: float):
    """Sorted places where a window may end and what a cut there costs. Place 0 comes first."""
    places = np.unique(np.concatenate(([0], sentence_ends, doc_ends)))
    gaps = np.diff(places)
    wide = np.nonzero(gaps > width)[0]
    if len(wide):
        fill = [np.arange(places[k] + width // 2, places[k + 1], width // 2) for k in wide]
        places = np.unique(np.concatenate([places, *fill]))
    costs = np.full(len(places), truncation_cost)
    costs[np.isin(places, sentence_ends)] = sentence_cost
    costs[np.isin(places, doc_ends)] = 0
    return places, costs


def best_windows(places: list[int], costs: list[float], width: int, truncation_cost: float) -> list[int]:
    """Ends of the sequences of least total cost, up to the last place; see the module."""
    n = len(places)
    best, back = [0.0] * n, [0] * n
    row = {p: i for i, p in enumerate(places)}
    powers = [1 << k for k in range(width.bit_length() - 3, width.bit_length() - 1)]
    one: list[int] = [0]
    two: list[int] = []
    head1 = head2 = 0
    enter2 = 0
    value = [0.0] * n
    for j in range(1, n):
        p = places[j]
        while places[one[head1]] < p - width:
            head1 += 1
        i = one[head1]
        least, come = value[i] + width - p, i
        edge = p - width
        while places[enter2] < edge:
            v = value[enter2]
            while len(two) > head2 and value[two[-1]] >= v:
                two.pop()
            two.append(enter2)
            enter2 += 1
        edge -= width
        while head2 < len(two) and places[two[head2]] < edge:
            head2 += 1
        if head2 < len(two):
            cost = value[two[head2]] + 2 * width - p + truncation_cost
            if cost < least:
                least, come = cost, two[head2]
        for size in powers:
            i = row.get(p - size)
            if i is not None and best[i] < least:
                least, come = best[i], i
        best[j] = least = least + costs[j]
        back[j] = come
        value[j] = v = least + p
        while len(one) > head1 and value[one[-1]] >= v:
            one.pop()
        one.append(j)
    cuts, j = [], n - 1
    while j:
        cuts.append(places[j])
        i = back[j]
        if places[j] - places[i] > width:
            cuts.append(places[i] + width)
        j = i
    return cuts[::-1]


class Packer:
    """Packs one partition's stream block by block."""

    def __init__(self, bpe: ByteBpe, first_sequence: int, width: int, closing: int, sentence_cost: float, truncation_cost: float):
        self.bpe, self.next, self.width, self.closing = bpe, first_sequence, width, closing
        self.sentence_cost, self.truncation_cost = sentence_cost, truncation_cost
        self.ids = np.zeros(0, np.int64)  # carried: the tokens of the sequence that is still open
        self.docs: list = []  # carried: the documents in it
        self.starts = np.zeros(0, np.int64)  # where each carried document starts, below 0 if in an earlier sequence
        self.totals = np.zeros(0, np.int64)
        self.sentences = np.zeros(0, np.int64)

    def block(self, docs: list, texts: list[str], final: bool) -> dict[str, np.ndarray]:
        ids, ends, sentences = self.bpe.stream(texts, self.closing)
        shift = len(self.ids)
        sizes = np.diff(np.concatenate(([0], ends)))
        ids = np.concatenate((self.ids, ids))
        docs = self.docs + docs
        starts = np.concatenate((self.starts, ends - sizes + shift)).astype(np.int64)
        totals = np.concatenate((self.totals, sizes)).astype(np.int64)
        sentences = np.concatenate((self.sentences, sentences + shift)).astype(np.int64)
        if not len(ids):
            return self._pieces(ids, docs, starts, totals, np.zeros(1, np.int64))
        places, costs = candidate_cuts(starts + totals, sentences, self.width, self.sentence_cost, self.truncation_cost)
        cuts = best_windows(places.tolist(), costs.tolist(), self.width, self.truncation_cost)
        edges = np.array([0, *cuts], np.int64)
        keep = 0 if final else max(0, len(cuts) - 1)
        if not final:
            edges = edges[: keep + 1]
        out = self._pieces(ids[: edges[-1]], docs, starts, totals, edges)
        at = int(edges[-1])
        open_docs = np.nonzero(starts + totals > at)[0]
        self.ids, self.docs = ids[at:], [docs[i] for i in open_docs]
        self.starts, self.totals = starts[open_docs] - at, totals[open_docs]
        self.sentences = sentences[sentences > at] - at
        return out

    def _pieces(self, ids, docs, starts, totals, edges) -> dict[str, np.ndarray]:
        end = int(edges[-1])
        cuts = np.unique(np.concatenate((edges, np.clip(starts, 0, end))))
        begin, stop = cuts[:-1], cuts[1:]
        doc = np.searchsorted(starts, begin, "right") - 1
        window = np.searchsorted(edges, begin, "right") - 1
        raw = ids.astype("<u4")
        crc = [zlib.crc32(raw[a:b].tobytes()) for a, b in zip(begin.tolist(), stop.tolist(), strict=True)]
        first = self.next
        self.next += len(edges) - 1
        return {
            "doc": [docs[i] for i in doc.tolist()], "start": begin - starts[doc], "length": stop - begin, "ids_crc32": np.array(crc, np.int64),
            "doc_tokens": totals[doc], "sequence_id": first + window, "offset": begin - edges[window],
        }


def pack(
    docs: DataFrame,
    vocabulary: str,
    width: int = 1024,
    closing: int = 0,
    sentence_cost: float = 1.0,
    truncation_cost: float = 8.0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Sequences of at most ``width`` tokens from all documents; one row for each piece of a document.

    Null texts count as empty: only the closing id. Repeated rows are packed as often as they come.
    ``sequence_id`` holds the input partition in its upper bits, so it is unique but not dense.
    Returns id, start, length, ids_crc32, doc_tokens, sequence_id, offset; an empty table gives no rows.
    """
    ready(docs.sparkSession)
    field = docs.schema[id_col].dataType
    kind = field.simpleString()

    def run(batches):
        packer = Packer(coder(vocabulary), TaskContext.get().partitionId() << 40, width, closing, sentence_cost, truncation_cost)

        def rows(found, kind_of_id):
            cols = [pa.array(found.pop("doc"), kind_of_id), *(pa.array(v, pa.int64()) for v in found.values())]
            return pa.RecordBatch.from_arrays(cols, ["id", *found])

        id_type = None
        for batch in batches:
            ids, texts, id_type = batch.column(0).to_pylist(), strings(batch.column(1)), batch.column(0).type
            for a, b in chunks(texts, CHARS):
                yield rows(packer.block(ids[a:b], texts[a:b], False), id_type)
        if id_type is not None:
            yield rows(packer.block([], [], True), id_type)

    rest = ", ".join(f"{c} bigint" for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))
    out = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(lean(run), f"id {kind}, {rest}")
    return out.withColumnRenamed("id", id_col)
