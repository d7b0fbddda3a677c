"""Word hashes and word shingles of whole texts, computed over the bytes of an Arrow column with numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SEGMENT = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x + _M1
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LETTER = mix(_LOWER.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D) + np.uint64(7))
_LETTER[_SPACE] = 0
_BASE = np.uint64(0xD6E8FEB86659FD93)
_POWERS = np.ones(1, dtype=np.uint64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offset of each row in them; a null row is empty."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if column.buffers()[2] is None or offsets[-1] == offsets[0]:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def _powers(n: int) -> np.ndarray:
    global _POWERS
    while len(_POWERS) < n:
        _POWERS = np.concatenate([_POWERS, _POWERS * (_POWERS[-1:] * _BASE)])
    return _POWERS


def _words_of(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in ``data`` and where each starts; a word also ends at each of ``breaks``."""
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    if len(breaks):
        first[breaks] = solid[breaks]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), starts
    lengths = np.diff(np.append(starts, len(data)))
    within = np.arange(starts[0], len(data), dtype=np.int64) - np.repeat(starts, lengths)
    values = _LETTER[data[starts[0] :]] * _powers(int(lengths.max()))[within]
    return mix(np.add.reduceat(values, starts - starts[0])), starts


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word ``[^\\x20\\x09-\\x0D]+``, A-Z in lower case, and the rows' offsets among them."""
    data, offsets = text_bytes(column)
    rows = len(offsets) - 1
    breaks = offsets[:-1][np.diff(offsets) > 0]
    hashes, places, at = [], [], 0
    while at < len(data):
        end = min(at + _SEGMENT, len(data))
        while end < len(data) and not _SPACE[data[end]]:
            step = _SPACE[data[end : end + 4096]]
            end += int(step.argmax()) if step.any() else len(step)
        inner = breaks[(breaks >= at) & (breaks < end)] - at
        h, s = _words_of(data[at:end], inner)
        hashes.append(h)
        places.append(s + at)
        at = end
    if not hashes:
        return np.zeros(0, dtype=np.uint64), np.zeros(rows + 1, dtype=np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(places), offsets)


def shingle_sets(column: pa.Array, words: int) -> list[np.ndarray]:
    """For each row its distinct shingles as ascending 64-bit hashes.

    A row with fewer words than a shingle has its whole sequence as one; a row
    without words has none.
    """
    hashes, offsets = word_hashes(column)
    out = []
    spans = len(hashes) - words + 1
    if spans > 0:
        every = hashes[:spans].copy()
        for k in range(1, words):
            every = mix(every) * _M1 + hashes[k : k + spans]
        every = mix(every)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(every[a : b - words + 1]))
        elif b > a:
            whole = hashes[a : a + 1].copy()
            for k in range(a + 1, b):
                whole = mix(whole) * _M1 + hashes[k : k + 1]
            out.append(mix(whole + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
