"""Lexico-syntactic hypernym patterns, matched by reading a sentence's symbols once from left to right.

A sentence becomes a list of symbols: a noun phrase, a comma, a cue word or anything else. Each pattern is read by a
small machine that goes over the symbols without going back: a list of noun phrases is passed once, and what it
remembers of it (its phrases, where it ended) decides what is the last hyponym. Lists of any length are fine.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

#: Cue words (fixed values) and the symbols that they are read as.
CUES = {"such": "such", "as": "as", "and": "or", "or": "or", "other": "other", "including": "including", "especially": "including"}
PHRASE, COMMA, ELSE = "phrase", ",", ""
#: Tags of a noun phrase glued into one word, and of nouns and the words before them (fixed values).
GLUED = re.compile(r"\d+np")
NOUN, BEFORE = re.compile(r"NN[PS]{0,2}"), re.compile(r"JJ[RS]{0,2}|IN|VB[NG]")


class Symbol(NamedTuple):
    kind: str
    start: int = 0
    end: int = 0
    inner: int = 0  # where the words after the last noun but one begin; ``start`` if there is but one noun


class Match(NamedTuple):
    pattern: str
    hyper: Symbol
    hypos: list[Symbol]
    hypo: Symbol


def glued_symbols(tokens: list[str], tags: list[str]) -> list[Symbol]:
    """Every glued noun phrase is a phrase."""
    return [Symbol(CUES[w]) if w in CUES else Symbol(PHRASE, i, i + 1, i) if GLUED.fullmatch(t) else Symbol(COMMA if t == "," else ELSE) for i, (w, t) in enumerate(zip(tokens, tags))]


def word_symbols(tokens: list[str], tags: list[str]) -> list[Symbol]:
    """A run of nouns, adjectives, prepositions and participles is a phrase up to its last noun; what is left of it is something else."""
    out: list[Symbol] = []
    start = inner = end = None
    for i, (w, t) in enumerate([*zip(tokens, tags), (None, None)]):
        noun = w not in CUES and t is not None and NOUN.fullmatch(t)
        if noun or (w not in CUES and t is not None and BEFORE.fullmatch(t)):
            start = i if start is None else start
            if noun:
                inner, end = (start if end is None else end), i + 1
            continue
        if start is not None:
            if end is not None:
                out.append(Symbol(PHRASE, start, end, inner))
            if end != i:
                out.append(Symbol(ELSE))
            start = inner = end = None
        if w is not None:
            out.append(Symbol(CUES[w]) if w in CUES else Symbol(COMMA if t == "," else ELSE))
    return out


def _kind(symbols: list[Symbol], i: int) -> str | None:
    return symbols[i].kind if i < len(symbols) else None


def _listed(symbols: list[Symbol], i: int) -> tuple[list[int], int]:
    """Phrases from ``i`` on, each with a comma or none after it, and the place after them."""
    found = []
    while _kind(symbols, i) == PHRASE:
        found.append(i)
        i += 1 + (_kind(symbols, i + 1) == COMMA)
    return found, i


def _tail(symbols: list[Symbol], i: int) -> tuple[list[Symbol], Symbol, int] | None:
    """A list and its last phrase after a conjunction, or else the list's own last phrase; its last noun if it has several."""
    found, after = _listed(symbols, i)
    if _kind(symbols, after) == "or" and _kind(symbols, after + 1) == PHRASE:
        return [symbols[j] for j in found], symbols[after + 1], after + 2
    if not found:
        return None
    *hypos, last = (symbols[j] for j in found)
    if last.inner > last.start:
        hypos.append(Symbol(PHRASE, last.start, last.inner, last.start))
    return hypos, Symbol(PHRASE, last.inner, last.end, last.inner), found[-1] + 1


def _such_as(symbols: list[Symbol], i: int):
    if [_kind(symbols, i + k) for k in range(3)] != [PHRASE, "such", "as"]:
        return None
    found, after = _listed(symbols, i + 3)
    if not found:
        return None
    if _kind(symbols, after) == "or" and _kind(symbols, after + 1) == PHRASE:
        return symbols[i], [symbols[j] for j in found], symbols[after + 1], after + 2
    return symbols[i], [], symbols[found[0]], found[0] + 1


def _such_np_as(symbols: list[Symbol], i: int):
    if [_kind(symbols, i + k) for k in range(3)] != ["such", PHRASE, "as"]:
        return None
    rest = _tail(symbols, i + 3)
    return rest and (symbols[i + 1], *rest)


def _other(symbols: list[Symbol], i: int):
    """At most two phrases before the conjunction, the second after a comma; the first is the hyponym."""
    if _kind(symbols, i) != PHRASE:
        return None
    second = _kind(symbols, i + 1) == COMMA and _kind(symbols, i + 2) == PHRASE
    at = i + 1 + (2 + (_kind(symbols, i + 3) == COMMA) if second else 0)
    if [_kind(symbols, at + k) for k in range(3)] != ["or", "other", PHRASE]:
        return None
    return symbols[at + 2], [symbols[i + 2]] if second else [], symbols[i], at + 3


def _including(symbols: list[Symbol], i: int):
    at = i + 1 + (_kind(symbols, i + 1) == COMMA)
    if _kind(symbols, i) != PHRASE or _kind(symbols, at) != "including":
        return None
    rest = _tail(symbols, at + 1)
    return rest and (symbols[i], *rest)


PATTERNS: dict[str, Callable] = {"such_as": _such_as, "such_np_as": _such_np_as, "other": _other, "including": _including}


def matched(symbols: list[Symbol]) -> Iterator[Match]:
    """Matches of every pattern from left to right; two of one pattern share no symbol."""
    for name, at_place in PATTERNS.items():
        i = 0
        while i < len(symbols):
            found = at_place(symbols, i)
            if found:
                hyper, hypos, hypo, i = found
                yield Match(name, hyper, hypos, hypo)
            else:
                i += 1


SPAN = "struct<start:int,end:int>"
FOUND = f"pattern string, hyper {SPAN}, hypo {SPAN}, hypos array<{SPAN}>"


def matches(sentences: DataFrame, read: Callable[[list[str], list[str]], list[Symbol]] = glued_symbols) -> DataFrame:
    """One row a match: doc_id, sent_id, words, pattern, and word ranges of hyper, hypo and the list's hypos."""
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    of = lambda s: {"start": s.start, "end": s.end}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, found = [], []
            tokens, tags = b.column("tokens").to_pylist(), b.column("tags").to_pylist()
            for r, (w, t) in enumerate(zip(tokens, tags)):
                got = list(matched(read(w, t)))
                rows += [r] * len(got)
                found += got
            kept = [b.column(c).take(pa.array(rows, pa.int64())) for c in ("doc_id", "sent_id", "words")]
            made = [pa.array([m.pattern for m in found], pa.string()), *(pa.array([of(getattr(m, c)) for m in found], span) for c in ("hyper", "hypo")), pa.array([[of(h) for h in m.hypos] for m in found], pa.list_(span))]
            yield pa.RecordBatch.from_arrays([*kept, *made], ["doc_id", "sent_id", "words", "pattern", "hyper", "hypo", "hypos"])

    given = sentences.select("doc_id", "sent_id", "words")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given.schema)
    return given.selectExpr("*", "transform(words, w -> w.token) AS tokens", "transform(words, w -> w.tag) AS tags").mapInArrow(run, f"{kinds}, {FOUND}")
