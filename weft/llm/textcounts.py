"""Spans and hashes over the bytes of a text column, for features that are counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from weft.llm.shingles import mix, text_bytes

#: Bytes of text that are looked at together; a longer text is taken in parts, cut at white space.
PIECE = 1 << 19

_P = 0xD6E8FEB86659FD93
_POWERS = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]

SPACES = np.zeros(256, dtype=bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
#: Bytes outside ASCII count as letters.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True
DIGITS = np.zeros(256, dtype=bool)
DIGITS[48:58] = True
UPPER = np.zeros(256, dtype=bool)
UPPER[65:91] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _reach(data: np.ndarray, separator: np.ndarray, words: int) -> int:
    """Bytes from the start of ``data`` that hold so many words and what stands between them, to a separator or the end."""
    size = 256
    while True:
        solid = ~separator[data[:size]]
        ends = np.flatnonzero(solid[:-1] & ~solid[1:]) + 1
        if len(ends) >= words:
            return int(ends[words - 1])
        if size >= len(data):
            return len(data)
        size *= 2


def pieces(column: pa.Array, separator: np.ndarray = SPACES, margin: int = 0, inner: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, int, int, int]]:
    """``data, offsets, first, low, high``: runs of rows of about ``PIECE`` bytes, or parts of one long row, cut at a ``separator``.

    What begins at ``low`` and before ``high`` belongs to the part. Around that a
    part of a long row also has ``margin`` words of its neighbours, so that what
    stands across a cut is seen by the part in which it begins. ``inner``
    separates the words that are counted there, where these are parts of those
    between separators.
    """
    data, offsets = text_bytes(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, side="right")) - 1)
        at, end = int(offsets[row]), int(offsets[last])
        if last > row + 1 or end - at <= PIECE:
            yield data[at:end], offsets[row : last + 1] - at, row, 0, end - at
        else:
            start = at
            while at < end:
                stop = min(at + PIECE, end)
                while stop < end and not separator[data[stop]]:
                    step = separator[data[stop : min(stop + 4096, end)]]
                    stop += int(step.argmax()) if step.any() else len(step)
                left, right = at, stop
                if margin:
                    # to the next separator, so that no margin begins or ends within a word
                    left -= _reach(data[start:at][::-1], separator if inner is None else inner, margin)
                    while left > start and not separator[data[left - 1]]:
                        left -= 1
                    right += _reach(data[stop:end], separator if inner is None else inner, margin)
                    while right < end and not separator[data[right]]:
                        right += 1
                yield data[left:right], np.array([0, right - left]), row, at - left, stop - left
                at = stop
        row = last


def spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``starts, ends, rows`` of the runs without separators; runs end with their row."""
    solid = ~separator[data]
    breaks = offsets[:-1][(np.diff(offsets) > 0) & (offsets[:-1] > 0)]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    first[breaks] = solid[breaks]
    last[breaks - 1] = solid[breaks - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, side="right") - 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_P, pow(_P, -1, 1 << 64))):
            x = np.full(max(n, PIECE + 1), base, dtype=np.uint64)
            x[0] = 1
            _POWERS[k] = np.multiply.accumulate(x)
    return _POWERS[0][:n], _POWERS[1][:n]


def letter_values(alphabet: np.ndarray) -> np.ndarray:
    """A 64-bit value for each byte by what ``alphabet`` makes of it; 0 stands for nothing."""
    values = mix(alphabet.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D) + np.uint64(7))
    values[alphabet == 0] = 0
    return values


class Hasher:
    """Hashes of any spans of one piece, from running sums."""

    def __init__(self, data: np.ndarray, values: np.ndarray) -> None:
        forward, self.back = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(values[data] * forward[: len(data)], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.back[starts])


def hash_word(word: str, values: np.ndarray) -> int:
    data = np.frombuffer(word.encode(), dtype=np.uint8)
    return int(Hasher(data, values)(np.array([0]), np.array([len(data)]))[0])
