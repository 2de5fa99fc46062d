"""Vectorised word, line and shingle hashing over Arrow string buffers.

Everything here works on the UTF-8 bytes of a whole batch at once: one pass
finds the word boundaries, a prefix-sum polynomial hash gives every word (or
line) a 64-bit value, and n-word shingles are mixed from consecutive word
values.  No text is cut: a document longer than the working block is a block
of its own.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, which equals
``[^\\x20\\x09-\\x0D]+`` on the decoded text because those are all ASCII.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

_BASE = np.uint64(0x9E6C63D0876A9A3B)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_STEPS = np.random.default_rng(7).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that close inputs give unrelated values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, BLOCK_BYTES + 1)
        for k, base in ((0, _BASE), (1, _INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets; null counts as empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of rows of about BLOCK_BYTES."""
    data, offsets = buffers(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + BLOCK_BYTES, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def _prefix(data: np.ndarray, values: np.ndarray) -> np.ndarray:
    power, _ = _grown(len(data) + 1)
    h = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * power[: len(data)], out=h[1:])
    return h


def spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, prefix: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit value of each byte span; equal bytes give equal values. The length takes part."""
    prefix = _prefix(data, _LOWER if lower else _BYTES) if prefix is None else prefix
    _, inverse = _grown(len(data) + 1)
    return mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


class Words:
    """The words of a block: byte spans, values, and the first word of every row (``first``, one longer than the rows). space: for each byte whether it parts words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, hashed: bool = True, space: np.ndarray = _SPACE):
        inside = ~space[data]
        before = np.zeros(len(data) + 1, dtype=bool)
        before[1:] = inside
        cut = offsets[:-1][offsets[:-1] < len(data)]
        before[cut] = False
        after = np.zeros(len(data) + 1, dtype=bool)
        after[:-1] = inside
        ends_after = after.copy()
        ends_after[offsets[1:]] = False
        self.data, self.offsets, self.inside = data, offsets, inside
        self.start = np.flatnonzero(inside & ~before[:-1])
        self.end = np.flatnonzero(inside & ~ends_after[1:]) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.prefix = _prefix(data, _LOWER if lower else _BYTES) if hashed else None
        self.value = spans(data, self.start, self.end, lower, self.prefix) if hashed else None


def windows(value: np.ndarray, n: int) -> np.ndarray:
    """A value for each run of n consecutive words, over row borders too: callers drop those."""
    m = len(value) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(m, np.uint64)
    for k in range(n):
        h += value[k : k + m] * _STEPS[k]
    return mix(h)


def whole(value: np.ndarray) -> np.uint64:
    """A value of a sequence shorter than a shingle; sequences of different lengths differ."""
    h = np.uint64(0x51ED27) * np.uint64(len(value) + 1)
    with np.errstate(over="ignore"):
        for k, v in enumerate(value):
            h = h * _BASE + v * _STEPS[k]
    return mix(np.array([h], np.uint64))[0]


def shingle_sets(words: Words, n: int) -> list[np.ndarray]:
    """For each row its sorted distinct n-word shingles; fewer words count as one shingle, none as no shingle."""
    every, out = windows(words.value, n), []
    first = words.first
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            x = np.sort(every[a : b - n + 1])
            if len(x) > 1:
                x = x[np.concatenate(([True], x[1:] != x[:-1]))]
            out.append(x)
        elif b > a:
            out.append(np.array([whole(words.value[a:b])], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
