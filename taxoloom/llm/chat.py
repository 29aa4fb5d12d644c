"""Operator 12: chat formatting whose text reads back to the very turns it came from.

Template, for each turn: ``<|im_start|>role``, a line break, the text, ``<|im_end|>``, a line break. Every rendered turn
is read again by the deterministic parser and compared with its source; a field that doesn't come back the same is
escaped, and the turn is rendered and compared anew until it is identical. Escaping puts one backslash more between
``<`` and ``|`` of every such pair (``<|`` to ``<\\|``, ``<\\|`` to ``<\\\\|``), a line break in a role becomes ``<|nl|>``; the
parser takes one backslash away and knows no other rule, so plain texts stay as they are.

Turns are rendered where they lie, without a shuffle. Reading back streams a conversation's turns in order through one
task, as its digests need, and holds one turn at a time.

A null role or text is empty, null turns come first, rows of equal turn follow in the order of their rendered form, a
null conv_id is a conversation of its own. An empty table gives no rows; other columns are ignored. A very long text
stays one turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._run import lean, ready

#: The template's control strings (fixed values).
START, END, BREAK = "<|im_start|>", "<|im_end|>", "<|nl|>"
ASSISTANT = "assistant"
_ANY, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
PIECES = "conv_id long, turn long, formatted string, loss_start long, loss_end long"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    return _ANY.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text) if "<\\" in text else text


def _role_form(role: str) -> str:
    return escape(role).replace("\n", BREAK)


def _role_of(form: str) -> str:
    return unescape(form.replace(BREAK, "\n"))


class Reader:
    """Turns of formatted text that comes in pieces of any length; raises ValueError off the grammar."""

    def __init__(self):
        self.rest, self.role, self.seen = "", None, 0

    def feed(self, piece: str) -> Iterator[tuple[str, str]]:
        text, at = self.rest + piece, 0
        while True:
            if self.role is None:
                self.rest = text[at : at + len(START)]
                if not text.startswith(START, at):
                    if not START.startswith(text[at : at + len(START)]):
                        raise ValueError("a turn must begin with its control string")
                    return
                end = text.find("\n", at)
                if end < 0:
                    self.rest = text[at:]
                    return
                form = text[at + len(START) : end]
                if START in form or END in form:
                    raise ValueError("a control string stands in a role")
                self.role, at, self.seen = _role_of(form), end + 1, 0
            end = text.find(END, at + self.seen)
            if end < 0 or end + len(END) == len(text):
                self.rest, self.seen = text[at:], max(0, (end if end >= 0 else len(text) - len(END)) - at)
                return
            body = text[at:end]
            if text[end + len(END)] != "\n" or START in body:
                raise ValueError("a control string stands in a text")
            role, self.role, at = self.role, None, end + len(END) + 1
            yield role, unescape(body)

    def close(self) -> None:
        if self.rest or self.role is not None:
            raise ValueError("the text ends within a turn")


def read(formatted: str) -> list[tuple[str, str]] | None:
    """The turns of a whole formatted text; None if it is none."""
    reader = Reader()
    try:
        turns = list(reader.feed(formatted))
        reader.close()
    except ValueError:
        return None
    return turns


def _piece(role_form: str, text_form: str) -> str:
    return f"{START}{role_form}\n{text_form}{END}\n"


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn's formatted text, and where its text stands in it."""
    role_form, text_form = role, text
    for _ in range(2):
        piece = _piece(role_form, text_form)
        if read(piece) == [(role, text)]:
            return piece, len(START) + len(role_form) + 1, len(piece) - len(END) - 1
        if read(_piece(role_form, "")) != [(role, "")]:
            role_form = _role_form(role)
        if read(_piece("", text_form)) != [("", text)]:
            text_form = escape(text)
    piece = _piece(role_form, text_form)
    if read(piece) != [(role, text)]:
        raise AssertionError("an escaped turn doesn't read back")
    return piece, len(START) + len(role_form) + 1, len(piece) - len(END) - 1


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        roles, texts = b.column("role").to_pylist(), b.column("text").to_pylist()
        out = [render(r, t) for r, t in zip(roles, texts)]
        spans = [(s, e) if r == ASSISTANT else (None, None) for r, (_, s, e) in zip(roles, out)]
        columns = [b.column("conv_id"), b.column("turn"), pa.array([p for p, _, _ in out], pa.string()), *(pa.array([s[i] for s in spans], pa.int64()) for i in (0, 1))]
        yield pa.record_batch(columns, names=["conv_id", "turn", "formatted", "loss_start", "loss_end"])


def format_turns(df: DataFrame) -> DataFrame:
    """A row a turn: its formatted text and the span of the text in it that training learns (assistant turns only).

    A conversation's formatted text is its turns' texts joined in the order of (turn, formatted).
    """
    ready(df.sparkSession)
    turns = df.select(*(F.col(c).cast("long").alias(c) for c in ("conv_id", "turn")), *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")))
    return turns.mapInArrow(lean(_rendered), PIECES)


def _in_order(pieces: DataFrame) -> DataFrame:
    return pieces.select("conv_id", "turn", "formatted", "loss_start", "loss_end").repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "formatted")


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, int | None, str, int | None, int | None]]:
    """(new conversation, conv_id, formatted, loss_start, loss_end) of a sorted stream."""
    before = ()
    for b in batches:
        for c, p, s, e in zip(*(b.column(x).to_pylist() for x in ("conv_id", "formatted", "loss_start", "loss_end"))):
            yield before != (c,), c, p, s, e
            before = (c,)


class _Digest:
    def __init__(self, conv_id):
        self.conv_id, self.n, self.chars, self.loss_chars = conv_id, 0, 0, 0
        self.turns, self.loss, self.reader = hashlib.sha256(), hashlib.sha256(), Reader()

    def add(self, piece: str, start: int | None, end: int | None) -> None:
        self.chars += len(piece)
        for role, text in self.reader.feed(piece):
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        if start is not None:
            learned = unescape(piece[start:end])
            self.loss_chars += len(learned)
            self.loss.update(learned.encode("utf-8", "surrogatepass"))

    def row(self) -> tuple:
        self.reader.close()
        return self.conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    string, long = pa.string(), pa.int64()
    schema = pa.schema([("conv_id", long), ("n_turns", long), ("turns_sha256", string), ("loss_chars", long), ("loss_sha256", string), ("formatted_chars", long)])
    held, rows = None, []
    for new, c, piece, start, end in _streams(batches):
        if new:
            rows += [held.row()] if held else []
            held = _Digest(c)
            if len(rows) >= 10_000:
                yield _table(rows, schema)
                rows = []
        held.add(piece, start, end)
    rows += [held.row()] if held else []
    if rows:
        yield _table(rows, schema)


def read_back(pieces: DataFrame) -> DataFrame:
    """One row a conversation of ``format_turns``: what the parser and the loss spans find in its joined text."""
    return _in_order(pieces).mapInArrow(lean(_read), DIGESTS)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
    texts, spans, at, conv = [], [], 0, None
    for new, c, piece, start, end in _streams(batches):
        if new and texts:
            yield _table([(conv, "".join(texts), spans)], schema)
            texts, spans, at = [], [], 0
        conv = c
        if start is not None:
            spans.append({"start": at + start, "end": at + end})
        texts.append(piece)
        at += len(piece)
    if texts:
        yield _table([(conv, "".join(texts), spans)], schema)


def conversations(pieces: DataFrame) -> DataFrame:
    """One row a conversation: its whole formatted text and the spans to learn; for those that fit a row (2 GB)."""
    return _in_order(pieces).mapInArrow(lean(_joined), "conv_id long, formatted string, loss array<struct<start:long,end:long>>")
