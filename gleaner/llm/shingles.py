"""Word shingles of texts as 64-bit numbers, a whole Arrow batch at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SIZE = 5  # words; fixed by the query contract
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SALT = np.random.default_rng(10).integers(0, 1 << 64, 256, np.uint64)  # an arbitrary number for each byte
#: Bytes (A-Z lower-cased) and which of them are white space.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
_SALTED = _SALT[LOWER]
PART = 1 << 18
_KEPT: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``_BASE`` and ``_INVERSE`` to the powers from 0 to n - 1. Those for a block of usual size are kept."""
    if n > 2 * PART or not _KEPT:
        power, back = np.full(max(n, 2 * PART), _BASE), np.full(max(n, 2 * PART), _INVERSE)
        power[0] = back[0] = 1
        power, back = np.multiply.accumulate(power), np.multiply.accumulate(back)
        if n > 2 * PART:
            return power, back
        _KEPT.extend((power, back))
    return _KEPT[0][:n], _KEPT[1][:n]


def scramble(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA0761D6478BD642F)
    x ^= x >> np.uint64(32)
    return x


def text_bytes(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column without nulls, and where each text lies."""
    column = column.cast(pa.large_string())
    _, offsets, values = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(values, np.uint8) if values else np.zeros(0, np.uint8)
    return data, offsets[:-1], offsets[1:]


def word_numbers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all words in ``data``: first byte, end, and a number for its lower-cased bytes."""
    space = (data - np.uint8(9) < 5) | (data == 32)  # as in SPACE
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(data) and not space[0]:
        edge = np.concatenate(([0], edge))
    if len(data) and not space[-1]:
        edge = np.append(edge, len(data))
    first, end = edge[::2].copy(), edge[1::2].copy()
    if not len(first):
        return first, end, np.zeros(0, np.uint64)
    power, back = _powers(len(data))
    term = _SALTED.take(data)
    term *= power
    total = np.concatenate((np.zeros(1, np.uint64), np.add.accumulate(term)))
    number = total[end] - total[first]
    number *= back[first]
    return first, end, scramble(number ^ (end - first).astype(np.uint64))


def parts(starts: np.ndarray, ends: np.ndarray, size: int = PART):
    """Neighbouring texts ``(from, to)`` of about ``size`` bytes together."""
    low = 0
    while low < len(starts):
        high = max(low + 1, int(np.searchsorted(ends, starts[low] + size, "right")))
        yield low, high
        low = high


def shingle_sets(column) -> list[np.ndarray]:
    """The distinct shingles of each text, sorted. A text of fewer words than
    ``SIZE`` has its whole sequence as one; a text without words has none."""
    data, starts, ends = text_bytes(column)
    out: list[np.ndarray] = []
    for low, high in parts(starts, ends):
        # a space between neighbours keeps words of two texts apart
        block = np.concatenate([x for i in range(low, high) for x in (data[starts[i]:ends[i]], _GAP)])
        at = np.cumsum(ends[low:high] - starts[low:high] + 1)
        first, _, number = word_numbers(block)
        bounds = np.concatenate(([0], np.searchsorted(first, at)))
        windows = number.copy()
        for k in range(1, SIZE):
            windows[:-k] = scramble(windows[:-k] * _BASE + number[k:])
        for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if z - a >= SIZE:
                out.append(np.unique(windows[a:z - SIZE + 1]))
            elif z > a:
                short = np.array([z - a], np.uint64)
                for x in number[a:z]:
                    short = scramble(short * _BASE + x)
                out.append(short)
            else:
                out.append(np.zeros(0, np.uint64))
    return out


_GAP = np.array([32], np.uint8)
