"""Texts of an Arrow batch as flat code-point arrays, and helpers over pieces of them."""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
#: Unicode White_Space, as regex engines understand \s (fixed values).
WHITE_SPACE = (
    *range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
_CLASSES: np.ndarray | None = None


def classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    global _CLASSES
    if _CLASSES is None:
        kinds = {"L": LETTER, "N": NUMBER}
        table = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
        table[list(WHITE_SPACE)] = SPACE
        _CLASSES = table
    return _CLASSES


def strings(column: pa.Array) -> list[str]:
    """Python strings of a column; null counts as empty."""
    return [x if x is not None else "" for x in column.to_pylist()]


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points in a row, and where each text starts (one offset more than texts)."""
    joined = "".join(texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return codes, offsets


def chunks(texts: list[str], limit: int):
    """Ranges [a, b) of texts with at most ``limit`` characters together, or one text."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_POW: list[np.ndarray] = []
BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POW or len(_POW[0]) < n + 1:
        size = max(n + 1, 1 << 16)
        inverse = pow(BASE, -1, 1 << 64)
        out = []
        for b in (BASE, inverse):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        _POW[:] = out
    return _POW[0], _POW[1]


def slice_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the slices; equal slices have equal hashes wherever they stand."""
    up, down = _powers(len(codes))
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(mix(codes.astype(np.uint64) + np.uint64(0x1234567)) * up[: len(codes)], out=total[1:])
    raw = (total[ends] - total[starts]) * down[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(BASE))


def gather(flat: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenation of flat[offsets[r]:offsets[r + 1]] over rows, and each one's length."""
    lengths = offsets[rows + 1] - offsets[rows]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    at = np.arange(total, dtype=np.int64) + np.repeat(offsets[rows] - (ends - lengths), lengths)
    return flat[at], lengths
