"""Quality by nearest-neighbour voting in a latent-semantic space.

Terms are hashed: three-letter sequences, shapes of words, and repeated words.
Their damped counts, weighed by rarity, are projected on the leading singular
directions of a labelled sample. Every document is compared with all sample
vectors by exact cosines, a block of documents at a time, and the nearest ones
vote with weights that grow with similarity.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from weft.llm.common import Scratch, slices
from weft.llm.textcounts import DIGITS, LETTERS, LOWER, SPACES, UPPER, Hasher, letter_values, pieces, spans
from weft.llm.toxicity import labelled_sample

TRIPLES, SHAPES, REPEATS = 2048, 506, 2
#: Shares of words that repeat the word one or two places before, each a term from there on.
RATES = (0.02, 0.1, 0.3)
TERMS = TRIPLES + SHAPES + REPEATS * len(RATES)
#: Labelled rows in the broadcast at most, their dimensions, and how many of them vote.
SAMPLE, DIMENSIONS, NEIGHBOURS = 4_000, 64, 11
SHARPNESS = 8
BLOCK = 256

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[LETTERS] = ord("a")
_CLASS[UPPER] = ord("A")
_CLASS[DIGITS] = ord("0")
_CLASS[SPACES] = 0
_CLASS_VALUES = letter_values(_CLASS)
_WORD_VALUES = letter_values(np.where(SPACES, 0, LOWER).astype(np.uint8))


def term_counts(column: pa.Array) -> np.ndarray:
    """Damped counts of the hashed terms, one row for each text."""
    out = np.zeros((len(column), TERMS), dtype=np.float32)
    words, again = np.zeros(len(column)), np.zeros((len(column), REPEATS))
    for data, offsets, first, low, high in pieces(column, margin=REPEATS):
        rows = len(offsets) - 1
        if not len(data):
            continue
        small = LOWER[data].astype(np.uint32)
        of_byte = np.repeat(np.arange(rows), np.diff(offsets))
        if len(data) > 2:
            inside = of_byte[:-2] == of_byte[2:]
            inside[:low] = inside[high:] = False
            triple = ((small[:-2] << np.uint32(16)) | (small[1:-1] << np.uint32(8)) | small[2:]) * np.uint32(0x9E3779B1)
            at = of_byte[:-2] * TRIPLES + (triple >> np.uint32(21)).astype(np.int64)
            out[first : first + rows, :TRIPLES] += np.bincount(at[inside], minlength=rows * TRIPLES).reshape(rows, TRIPLES)
        starts, ends, row = spans(data, offsets, SPACES)
        own = (starts >= low) & (starts < high)
        # a shape is the classes of a word's bytes, each run of one class once
        kind = _CLASS[data]
        new = np.ones(len(data), dtype=bool)
        new[1:] = kind[1:] != kind[:-1]
        new[starts] = True
        kept = np.flatnonzero(new & (kind > 0))
        shape = Hasher(data[kept], _CLASS_VALUES)(np.searchsorted(kept, starts), np.searchsorted(kept, ends))
        at = (row * SHAPES + (shape % np.uint64(SHAPES)).astype(np.int64))[own]
        out[first : first + rows, TRIPLES : TRIPLES + SHAPES] += np.bincount(at, minlength=rows * SHAPES).reshape(rows, SHAPES)
        word = Hasher(data, _WORD_VALUES)(starts, ends)
        words[first : first + rows] += np.bincount(row[own], minlength=rows)
        for k in range(REPEATS):
            same = (word[k + 1 :] == word[: -k - 1]) & (row[k + 1 :] == row[: -k - 1]) & own[k + 1 :]
            again[first : first + rows, k] += np.bincount(row[k + 1 :][same], minlength=rows)
    out = np.log1p(out)
    for k in range(REPEATS):
        for j, rate in enumerate(RATES):
            out[:, TRIPLES + SHAPES + k * len(RATES) + j] = again[:, k] > rate * np.maximum(words, 20)
    return out


def weighed(counts: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """Counts by rarity; letter sequences and the form of words are half of each row."""
    x = counts * rarity
    for part in (x[:, :TRIPLES], x[:, TRIPLES:]):
        part /= np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-12)
    return x


def nearest(cosine: np.ndarray, k: int) -> np.ndarray:
    """The places of the ``k`` largest values of each row, in ascending order; of equal values those of least place."""
    edge = -np.partition(-cosine, k - 1, axis=1)[:, k - 1 : k]
    above, tied = cosine > edge, cosine == edge
    free = k - above.sum(axis=1, keepdims=True)
    return np.nonzero(above | (tied & (np.cumsum(tied, axis=1) <= free)))[1].reshape(len(cosine), k)


@dataclass
class QualityModel:
    rarity: np.ndarray
    directions: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    even: float

    def project(self, counts: np.ndarray) -> np.ndarray:
        x = weighed(counts, self.rarity) @ self.directions
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def score(self, column: pa.Array) -> np.ndarray:
        out = np.full(len(column), self.even)
        if not len(self.labels):
            return out
        k = min(NEIGHBOURS, len(self.labels))
        for start in range(0, len(column), BLOCK):
            cosine = self.project(term_counts(column.slice(start, BLOCK))) @ self.vectors.T
            near = nearest(cosine, k)
            weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(np.float64) ** SHARPNESS + 1e-9
            out[start : start + len(cosine)] = (weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1)
        return out


def leading_directions(blocks: Callable[[], Iterator[np.ndarray]], width: int, dimensions: int, rounds: int = 5, seed: int = 0) -> np.ndarray:
    """The leading right singular vectors of the rows of all blocks, by power iteration of a random block; no copy of the whole is made."""
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, dimensions)).astype(np.float32))[0]
    for _ in range(rounds):
        q = np.linalg.qr(sum((x.T @ (x @ q) for x in blocks()), np.zeros_like(q)))[0]
    return q


def fit_quality(docs: DataFrame, labels: DataFrame, train: Column, label: str = "quality", limit: int = SAMPLE) -> QualityModel:
    """Fit on at most ``limit`` labelled rows for which ``train`` holds; without any, as for empty tables, all scores are even.

    Repeated rows and labels are as ``labelled_sample`` has them. Texts of any
    length are whole. Of neighbours that are as near, those of least doc_id
    vote. The counts of the sample are made where its texts are; the driver gets them
    in half precision, bounded by the sample, and broadcasts ``limit`` vectors.
    """
    scratch = Scratch(docs.sparkSession)
    sample = labelled_sample(docs, labels, label, train, limit, scratch)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            counts = term_counts(batch.column(0)).astype(np.float16)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in counts], pa.binary()), batch.column(1), batch.column(2)], names=["x", "y", "doc_id"])

    got = sample.select("text", "y", "doc_id").mapInArrow(rows, "x binary, y double, doc_id long").orderBy("doc_id").toArrow()
    scratch.drop(sample)
    y = got.column("y").to_numpy()
    if not len(y):
        empty = np.zeros((0, DIMENSIONS), dtype=np.float32)
        return QualityModel(np.ones(TERMS, dtype=np.float32), np.zeros((TERMS, DIMENSIONS), dtype=np.float32), empty, np.zeros(0), 0.5)
    # half-precision counts stay; whatever is made of them is made a block of rows at a time
    x = np.empty((len(y), TERMS), dtype=np.float16)
    for i, value in enumerate(got.column("x")):
        x[i] = np.frombuffer(value.as_buffer(), dtype=np.float16)
    del got
    seen = sum(((x[k : k + BLOCK] > 0).sum(axis=0) for k in range(0, len(x), BLOCK)), np.zeros(TERMS, dtype=np.int64))
    rarity = np.log((1 + len(x)) / (1 + seen)).astype(np.float32) + np.float32(0.1)
    parts = [slice(k, k + BLOCK) for k in range(0, len(x), BLOCK)]
    directions = leading_directions(lambda: (weighed(x[p].astype(np.float32), rarity) for p in parts), TERMS, DIMENSIONS)
    model = QualityModel(rarity, directions, np.zeros((0, 0), dtype=np.float32), np.zeros(0), float(y.mean()))
    model.vectors, model.labels = np.concatenate([model.project(x[p].astype(np.float32)) for p in parts]), y
    return model
