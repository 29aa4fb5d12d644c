"""Splitting many texts at once into the pieces that byte-pair tokenizers encode one by one.

Both splitters work on the flat code points of a batch and give the start and end of each piece and the
number of pieces of each text. A piece never crosses from one text to the next.
"""

from __future__ import annotations

import numpy as np

from ._text import LETTER, NUMBER, SPACE, classes, mix, slice_hashes

_QUOTE, _BLANK = ord("'"), ord(" ")
_ONE, _TWO = b"stmd", (b"re", b"ve", b"ll")


def _runs(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of each code point, whether a text starts there, whether a run of one class starts there."""
    kind = classes()[codes]
    first = np.zeros(len(codes) + 1, bool)
    first[offsets] = True
    first = first[:-1]
    run = first.copy()
    if len(codes):
        run[0] = True
        run[1:] |= kind[1:] != kind[:-1]
    return kind, first, run


def _contractions(codes, kind, first, run, after_blank: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of apostrophes that open a contraction, and the place after each contraction."""
    n = len(codes)
    at = np.nonzero((codes == _QUOTE) & run)[0]
    at = at[at + 1 < n]
    at = at[(kind[at + 1] == LETTER) & ~first[at + 1]]
    if not after_blank:
        at = at[first[at] | (codes[at - 1] != _BLANK)]
    places, ends = [], []
    for q in at.tolist():
        a = int(codes[q + 1])
        b = int(codes[q + 2]) if q + 2 < n and kind[q + 2] == LETTER and not first[q + 2] else 0
        if a < 128 and a in _ONE:
            places.append(q)
            ends.append(q + 2)
        elif a < 128 and b < 128 and bytes((a, b)) in _TWO:
            places.append(q)
            ends.append(q + 3)
    return np.array(places, np.int64), np.array(ends, np.int64)


def _per_text(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.searchsorted(starts, offsets))


def split_byte_level(codes: np.ndarray, offsets: np.ndarray):
    """Pieces of the pattern of byte-level BPE: a blank goes with what follows; nothing is dropped."""
    n = len(codes)
    kind, first, run = _runs(codes, offsets)
    border = run.copy()
    start = np.nonzero(run & (kind != SPACE) & ~first)[0]
    start = start[kind[start - 1] == SPACE]
    border[start - 1] = True
    border[start[codes[start - 1] == _BLANK]] = False
    places, ends = _contractions(codes, kind, first, run, after_blank=False)
    border[places + 1] = False
    border[ends[ends < n]] = True
    starts = np.nonzero(border)[0]
    stops = np.append(starts[1:], n) if len(starts) else starts
    return starts, stops, _per_text(starts, offsets)


def split_words(codes: np.ndarray, offsets: np.ndarray):
    """Pieces of the word-end pattern: runs of letters, single numbers, runs of the rest; no white space."""
    n = len(codes)
    kind, first, run = _runs(codes, offsets)
    border = run | (kind == NUMBER)
    places, ends = _contractions(codes, kind, first, run, after_blank=True)
    border[places + 1] = False
    border[ends[ends < n]] = True
    starts = np.nonzero(border)[0]
    stops = np.append(starts[1:], n) if len(starts) else starts
    keep = kind[starts] != SPACE
    starts, stops = starts[keep], stops[keep]
    return starts, stops, _per_text(starts, offsets)


#: Bits of none to three code points; a number of 63 bits holds three, each one more than it is, one to one.
_BITS = np.array([0, (1 << 21) - 1, (1 << 42) - 1, (1 << 63) - 1], np.int64)
_LONG = np.uint64(1 << 63)


def _threes(codes: np.ndarray) -> np.ndarray:
    """The code points at each place and the two after it."""
    wide = codes.astype(np.int64) + 1
    out = wide.copy()
    out[:-1] |= wide[1:] << 21
    out[:-2] |= wide[2:] << 42
    return out


def _keys(codes: np.ndarray, threes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Up to three characters as they are, up to twelve mixed from all of them, longer ones' hashes."""
    first = threes[starts]
    keys = (first & _BITS[np.minimum(lengths, 3)]).view(np.uint64)
    rows = np.nonzero(lengths > 3)[0]
    at, n = starts[rows], lengths[rows]
    mixed = mix(first[rows].view(np.uint64) + n.astype(np.uint64)) + threes[at + n - 3].view(np.uint64)
    more = np.nonzero(n > 6)[0]
    for step in (3, 6):
        mixed[more] = mix(mixed[more]) + threes[at[more] + np.minimum(step, n[more] - 3)].view(np.uint64)
    keys[rows] = mix(mixed) | _LONG
    far = rows[n > 12]
    if len(far):
        flat, sizes = _slices(codes, starts[far], starts[far] + lengths[far])
        stops = np.cumsum(sizes)
        keys[far] = slice_hashes(flat, stops - sizes, stops) | _LONG
    return keys


class PieceTable:
    """Token ids of every piece met so far. At ``limit`` pieces it starts anew.

    Pieces of up to three characters are told apart by these. Hashes only bring equal longer ones together: each one's
    characters are compared with those in the table, and one that shares another's hash has its row by its characters.
    """

    def __init__(self, encode, limit: int = 700_000):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.rows: dict[int, int] = {}
        self.odd: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.offsets = np.zeros(1 << 14, np.int64)
        self.extra: list = []
        self.threes = np.zeros(1 << 16, np.int64)
        self.places = np.zeros(1 << 14, np.int64)  # where each row's characters begin

    def lookup(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The table's row of each piece; new ones are encoded."""
        if not len(starts):
            return np.zeros(0, np.int64)
        threes, lengths = _threes(codes), ends - starts
        keys = _keys(codes, threes, starts, lengths)
        hashes, where, inverse = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.extra) + len(hashes) > self.limit and self.extra:
            self.clear()
        rows = np.fromiter(map(self.rows.get, hashes.tolist(), [-1] * len(hashes)), np.int64, len(hashes))
        missing = np.nonzero(rows < 0)[0]
        if len(missing):
            rows[missing] = self._put(codes, starts[where[missing]], ends[where[missing]])
            self.rows.update(zip(hashes[missing].tolist(), rows[missing].tolist(), strict=True))
        out = rows[inverse]
        other = np.nonzero(lengths > 3)[0]
        other = other[self._differ(threes, starts[other], lengths[other], out[other])]
        for i in other.tolist():
            piece = codes[starts[i] : ends[i]].tobytes().decode("utf-32-le", "surrogatepass")
            if piece not in self.odd:
                self.odd[piece] = int(self._put(codes, starts[i : i + 1], ends[i : i + 1])[0])
            out[i] = self.odd[piece]
        return out

    def _differ(self, threes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Whether the pieces hold other characters than their rows, three at a time."""
        places = self.places[rows]
        differ = lengths != self.places[rows + 1] - places
        live = np.nonzero(~differ)[0]
        a, b, left = starts[live], places[live], lengths[live]
        while len(live):
            differ[live] |= ((threes[a] ^ self.threes[b]) & _BITS[np.minimum(left, 3)]) != 0
            more = np.nonzero((left > 3) & ~differ[live])[0]
            live, a, b, left = live[more], a[more] + 3, b[more] + 3, left[more] - 3
            if len(live) < 64:  # few and long: compare each at once
                for i, x, y, n in zip(live.tolist(), a.tolist(), b.tolist(), left.tolist(), strict=True):
                    whole = n - n % 3
                    differ[i] = not np.array_equal(threes[x : x + whole : 3], self.threes[y : y + whole : 3]) or bool(n % 3 and (threes[x + whole] ^ self.threes[y + whole]) & _BITS[n % 3])
                break
        return differ

    def _put(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """New rows for the pieces."""
        new_codes, lengths = _slices(codes, starts, ends)
        first, at = len(self.extra), int(self.places[len(self.extra)])
        while at + len(new_codes) > len(self.threes):
            self.threes = np.concatenate((self.threes, np.zeros_like(self.threes)))
        while first + len(lengths) + 2 > len(self.places):
            self.places = np.concatenate((self.places, np.zeros_like(self.places)))
        self.threes[at : at + len(new_codes)] = _threes(new_codes)
        self.places[first + 1 : first + 1 + len(lengths)] = at + np.cumsum(lengths)
        text = new_codes.tobytes().decode("utf-32-le", "surrogatepass")
        cuts = np.concatenate(([0], np.cumsum(lengths))).tolist()
        return np.array([self._add(text[i:j]) for i, j in zip(cuts, cuts[1:])], np.int64)

    def _add(self, piece: str) -> int:
        ids, extra = self.encode(piece)
        row = len(self.extra)
        if row + 2 > len(self.offsets):
            self.offsets = np.concatenate((self.offsets, np.zeros_like(self.offsets)))
        at = int(self.offsets[row])
        while at + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.flat[at : at + len(ids)] = ids
        self.offsets[row + 1] = at + len(ids)
        self.extra.append(extra)
        return row


def _slices(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lengths = ends - starts
    stops = np.cumsum(lengths)
    total = int(stops[-1]) if len(stops) else 0
    at = np.arange(total, dtype=np.int64) + np.repeat(starts - (stops - lengths), lengths)
    return codes[at], lengths
