"""Words of letters and digits in lower case, and checksums of word runs, over the bytes of a text column.

A word is a run of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z became a-z. The
CRC-32 of a run of words follows from those of its words: appending bytes moves
a checksum by a linear map that depends on their number alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from weft.llm.textcounts import DIGITS, LETTERS, LOWER, Hasher, letter_values, pieces, spans

BETWEEN = ~(LETTERS | DIGITS)
#: The same words, for Spark's and DuckDB's regular expressions over lower-cased text.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_PLAIN = LOWER.copy()
_PLAIN[BETWEEN] = 0
_VALUES = letter_values(_PLAIN)
#: Bytes of a word up to which tables serve; longer words are taken one at a time.
LONG = 64


@dataclass
class Words:
    """The words of a run of rows, or of one part of a long row."""

    data: np.ndarray  # lower-cased bytes
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray  # of the column
    first: int  # rows that the run covers
    last: int
    goes_on: bool  # its first row began in the run before


def words(column: pa.Array) -> Iterator[Words]:
    before = -1
    for data, offsets, first, _, _ in pieces(column, BETWEEN):
        starts, ends, rows = spans(data, offsets, BETWEEN) if len(data) else (np.zeros(0, dtype=np.int64),) * 3
        last = first + len(offsets) - 2
        yield Words(LOWER[data], starts, ends, rows + first, first, last, first == before)
        before = last


def word_hashes(w: Words) -> np.ndarray:
    """A 64-bit hash of each word, never 0."""
    h = Hasher(w.data, _VALUES)(w.starts, w.ends) if len(w.starts) else np.zeros(0, dtype=np.uint64)
    return np.where(h == 0, np.uint64(1), h)


def _after_zero(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    return (x >> np.uint32(8)) ^ table[(x & np.uint32(255)).astype(np.intp)]


def _crc_tables() -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Checksums of a byte before so many zeros; the four bytes of a checksum moved by 0 to ``LONG`` + 1 zeros, and by powers of two."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & np.uint32(1), (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    byte = [table]
    for _ in range(LONG - 1):
        byte.append(_after_zero(byte[-1], table))
    moved = [np.concatenate([np.arange(256, dtype=np.uint32) << np.uint32(8 * j) for j in range(4)])]
    for _ in range(LONG + 1):
        moved.append(_after_zero(moved[-1], table))
    powers = [moved[1]]
    for _ in range(40):
        powers.append(_move(powers[-1], powers[-1], np.zeros(1024, dtype=np.intp)))
    return np.concatenate(byte), np.concatenate(moved), powers


def _move(tables: np.ndarray, crc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Checksums moved by the map that stands at ``at`` in ``tables``."""
    out = tables[at + (crc & np.uint32(255)).astype(np.intp)]
    for j in range(1, 4):
        out = out ^ tables[at + 256 * j + ((crc >> np.uint32(8 * j)) & np.uint32(255)).astype(np.intp)]
    return out


_BYTE, _MOVED, _POWERS = _crc_tables()
_ONES = np.uint32(0xFFFFFFFF)
_SPACE = np.uint32(zlib.crc32(b" "))
#: What the start value and the final flip add to a plain checksum, by length.
_ENDS = _move(_MOVED, np.full(LONG + 1, _ONES), 1024 * np.arange(LONG + 1)) ^ _ONES


def append(crc: np.ndarray, other: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The checksum of two byte strings one after the other, from both checksums and the second one's length."""
    short = length <= LONG + 1
    out = _move(_MOVED, crc, 1024 * np.where(short, length, 0))
    far = np.flatnonzero(~short)
    if len(far):
        x, n = crc[far], length[far]
        for k in range(int(n.max()).bit_length()):
            some = (n >> k & 1).astype(bool)
            x[some] = _move(_POWERS[k], x[some], np.zeros(int(some.sum()), dtype=np.intp))
        out[far] = x
    return out ^ other


def word_crcs(w: Words) -> np.ndarray:
    """The CRC-32 of each word."""
    lengths = w.ends - w.starts
    if not len(lengths):
        return np.zeros(0, dtype=np.uint32)
    short = lengths <= LONG
    out = np.zeros(len(lengths), dtype=np.uint32)
    n = lengths[short]
    if len(n):
        begins = np.cumsum(n) - n
        left = np.repeat(begins + n - 1, n) - np.arange(int(n.sum()))
        byte = w.data[np.repeat(w.starts[short] - begins, n) + np.arange(int(n.sum()))]
        out[short] = np.bitwise_xor.reduceat(_BYTE[left * 256 + byte], begins) ^ _ENDS[n]
    for k in np.flatnonzero(~short).tolist():
        out[k] = zlib.crc32(w.data[w.starts[k] : w.ends[k]].tobytes())
    return out


def run_crcs(column: pa.Array, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``words, rows, crcs`` of each part of a column: CRC-32 of all runs of ``words`` = 1 to ``most`` words of one row, joined by a space.

    Of a row that goes on in the next part the last words are carried over.
    """
    kept: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
    for w in words(column):
        one, length, rows = word_crcs(w), w.ends - w.starts, w.rows
        carried = 0
        if w.goes_on and kept is not None:
            carried = len(kept[0])
            one, length, rows = (np.concatenate([a, b]) for a, b in zip(kept, (one, length, rows), strict=True))
        yield 1, rows[carried:], one[carried:]
        spaced = append(np.full(len(one), _SPACE), one, length) if most > 1 else one
        run = one
        for k in range(2, most + 1):
            if len(one) < k:
                break
            run = append(run[: len(one) - k + 1], spaced[k - 1 :], length[k - 1 :] + 1)
            new = (rows[k - 1 :] == rows[: len(rows) - k + 1]) & (np.arange(k - 1, len(rows)) >= carried)
            yield k, rows[k - 1 :][new], run[new]
        tail = np.flatnonzero(rows == w.last)[-(most - 1) :] if most > 1 else np.zeros(0, dtype=np.intp)
        kept = (one[tail], length[tail], rows[tail])
