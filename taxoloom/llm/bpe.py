"""BPE encoding and decoding by dynamic programming over the prefixes of each word.

A byte-pair vocabulary gives every prefix of a word exactly one last token: of the vocabulary strings that
end there (found by an automaton over the whole vocabulary, longest first), it is the one that is compatible
with the last token of the prefix before it. Two tokens are compatible if encoding their joined text gives
these two again, that is if no merge across the border comes before the merges that build them. Following
the last tokens back from the end of the word gives its exact ids.

Words repeat, so each worker keeps the ids of up to 700,000 words (a setting) and starts anew beyond that.

Normalising and splitting follow the vocabulary file. Texts of plain characters (assigned, in composed form,
no marks, see ``plain_characters``) take a fast path, on which Python's Unicode tables and the library's agree;
any other text is normalised and split by the file's own normalizer and pre-tokenizer, whose Unicode version
may differ from Python's. The words' ids come from the dynamic programme in both cases.

Null texts count as empty and have no tokens; ``decode`` of no tokens is the empty text. Repeated rows are
encoded each; an empty table gives no rows. A very long text or word is handled whole, by itself. Only the id
and text columns are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from ._pieces import PieceTable, split_words
from ._run import lean, ready
from ._text import chunks, codes_of, gather, strings

#: Characters that one worker handles at a time, or one longer text.
CHARS = 2_000_000
_CODERS: dict[str, WordBpe] = {}


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


_PLAIN: list[np.ndarray] = []


def plain_characters() -> np.ndarray:
    """For each code point whether normalising leaves it alone beside any other such one, in every Unicode version since 6."""
    if not _PLAIN:
        old = unicodedata.ucd_3_2_0
        table = np.zeros(0x110000, bool)
        for i in range(0x20000):
            c = chr(i)
            kind = old.category(c)
            if kind[0] not in "CM" or kind == "Cc":
                table[i] = unicodedata.category(c) == kind and unicodedata.normalize("NFC", c) == c and not 0x1100 <= i < 0x1200
        _PLAIN.append(table)
    return _PLAIN[0]


class WordBpe:
    """Encoder of single words for a vocabulary file with merges and word-end symbols."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        library = Tokenizer.from_file(path)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.end = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.names = {i: t for t, i in self.vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.names.update({i: t for t, i in self.added.items()})
        self.symbols = byte_symbols()
        self.pairs: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for order, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            a, b, whole = self.vocab[left], self.vocab[right], self.vocab[left + right]
            self.pairs.setdefault((a, b), order)
            if whole not in self.made:
                self.made[whole], self.rank[whole] = (a, b), order
        self.good: dict[tuple[int, int], bool] = {}
        self.spines: tuple[dict, dict] = ({}, {})
        self.automaton = ahocorasick.Automaton()
        for text, token in self.vocab.items():
            if self._whole(token):
                key = self._key(text)
                self.automaton.add_word(key, (len(key), token))
        self.automaton.make_automaton()
        self.table = PieceTable(self.word)

    def _key(self, text: str) -> str:
        """The text with its word-end symbol, if any, folded into the last character."""
        if self.end and text.endswith(self.end):
            text = text[: -len(self.end)]
            return text[:-1] + chr(ord(text[-1]) + 0x1000)
        return text

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """Tokens along the right (1) or left (0) edge of a token, with the rank of the merge that ends each."""
        kept = self.spines[side].get(token)
        if kept is None:
            kept, until, at = [], 1 << 60, token
            while True:
                kept.append((at, until))
                if at not in self.made:
                    break
                until = self.rank[at]
                at = self.made[at][side]
            self.spines[side][token] = kept
        return kept

    def _crosses(self, a: int, b: int, before: int) -> bool:
        """Whether a merge across the border of a and b happens before they are built, or before ``before``."""
        for left, left_until in self._spine(a, 1):
            for right, right_until in self._spine(b, 0):
                order = self.pairs.get((left, right))
                if order is not None and order < before and order < left_until and order <= right_until:
                    return True
        return False

    def _whole(self, token: int) -> bool:
        """Whether encoding the token's own text gives the token."""
        if token not in self.made:
            return True
        a, b = self.made[token]
        return self._whole(a) and self._whole(b) and not self._crosses(a, b, self.rank[token])

    def compatible(self, a: int, b: int) -> bool:
        known = self.good.get((a, b))
        if known is None:
            if len(self.good) > 2_000_000:
                self.good.clear()
            known = self.good[a, b] = not self._crosses(a, b, 1 << 60)
        return known

    def word(self, piece: str) -> tuple[list[int], str]:
        """Ids of one word and their decoded text."""
        raw = piece.encode("utf-8", "surrogatepass")
        return self.spelled("".join([self.symbols[b] for b in raw]))

    def spelled(self, text: str) -> tuple[list[int], str]:
        """As ``word``, for a word spelled in the symbols of its bytes."""
        if self.end:
            text = text[:-1] + chr(ord(text[-1]) + 0x1000)
        last = [-1] * (len(text) + 1)
        start = [0] * (len(text) + 1)
        done = 0
        for stop, (size, token) in self.automaton.iter(text):
            stop += 1
            if stop <= done:
                continue
            begin = stop - size
            if begin and (last[begin] < 0 or not self.compatible(last[begin], token)):
                continue
            last[stop], start[stop], done = token, begin, stop
        ids, at = [], len(text)
        while at:
            ids.append(last[at])
            at = start[at]
        ids.reverse()
        return ids, " ".join([self.names[i] for i in ids])

    def normal(self, text: str) -> str:
        """A text of plain characters in lower case, letter by letter; white space is dropped later."""
        return text.lower() if text.isascii() else text.replace("Σ", "σ").lower()

    def _by_library(self, text: str) -> tuple[np.ndarray, str]:
        """Ids and decoded text where the file's own normalizer and pre-tokenizer make the words."""
        got = [self.spelled(w) for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))]
        return np.array([i for ids, _ in got for i in ids], np.int32), " ".join([d for _, d in got])

    def encode_batch(self, texts: list[str]) -> tuple[list[np.ndarray], list[str]]:
        """Ids and decoded text of each text."""
        parts, owners, marks = self._segments(texts)
        raw, offsets = codes_of(parts)
        odd = np.concatenate(([0], np.cumsum(~plain_characters()[raw])))[offsets]
        aside = {k: self._by_library(parts[k]) for k in np.nonzero(np.diff(odd))[0].tolist()}
        codes, offsets = codes_of(["" if k in aside else self.normal(p) for k, p in enumerate(parts)])
        starts, ends, per_part = split_words(codes, offsets)
        rows = self.table.lookup(codes, starts, ends)
        flat, sizes = gather(self.table.flat, self.table.offsets, rows)
        piece_at = np.concatenate(([0], np.cumsum(per_part)))
        token_at = np.concatenate(([0], np.cumsum(sizes)))[piece_at].tolist()
        decoded, row_list, piece_at = self.table.extra, rows.tolist(), piece_at.tolist()
        ids: list[list] = [[] for _ in texts]
        words: list[list] = [[] for _ in texts]
        for k, i in enumerate(owners):
            ids[i].append(flat[token_at[k] : token_at[k + 1]])
            if k in aside and len(aside[k][0]):
                ids[i].append(aside[k][0])
                words[i].append(aside[k][1])
            if piece_at[k + 1] > piece_at[k]:
                words[i].append(" ".join([decoded[r] for r in row_list[piece_at[k] : piece_at[k + 1]]]))
            if marks[k] is not None:
                ids[i].append(np.array([self.added[marks[k]]], np.int32))
                words[i].append(marks[k])
        return [x[0] if len(x) == 1 else np.concatenate(x) for x in ids], [x[0] if len(x) == 1 else " ".join(x) for x in words]

    def _segments(self, texts: list[str]) -> tuple[list[str], list[int], list[str | None]]:
        """Texts cut at added tokens; for each part its text's number and the added token after it."""
        parts, owners, marks = [], [], []
        cut = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        for i, text in enumerate(texts):
            at = 0
            if cut is not None and any(x in text for x in self.added):
                for m in cut.finditer(text):
                    parts.append(text[at : m.start()])
                    owners.append(i)
                    marks.append(m[0])
                    at = m.end()
            parts.append(text[at:])
            owners.append(i)
            marks.append(None)
        return parts, owners, marks

    def decode(self, ids) -> str:
        return " ".join([self.names[int(i)] for i in ids if int(i) in self.names])


def coder(path: str) -> WordBpe:
    """The worker's encoder for this vocabulary file."""
    if path not in _CODERS:
        _CODERS[path] = WordBpe(path)
    return _CODERS[path]


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Ids and decoded text of every whole text; with ``digests`` SHA-256 of both in their place.

    ``vocabulary`` is the path of a tokenizer file that every executor can read. Returns one row for each
    row of ``docs``, repeated rows included: id, n_tokens, and ids and decoded or their digests.
    """
    ready(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        bpe = coder(vocabulary)
        for batch in batches:
            texts = strings(batch.column(1))
            for a, b in chunks(texts, CHARS):
                ids, decoded = bpe.encode_batch(texts[a:b])
                sizes = pa.array([len(x) for x in ids], pa.int64())
                if digests:
                    cols = [
                        pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
                        pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in decoded], pa.string()),
                    ]
                else:
                    cols = [pa.array([x.tolist() for x in ids], pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                names = ["id", "n_tokens", *(["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), sizes, *cols], names)

    rest = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    out = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(lean(run), f"id {kind}, n_tokens bigint, {rest}")
    return out.withColumnRenamed("id", id_col)
