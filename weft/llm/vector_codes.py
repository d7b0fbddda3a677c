"""Vector codes by product quantisation in whole numbers, over Hilbert-sorted flat blocks.

Vectors are cut into parts; each part has a codebook of entries, and a code
names the nearest entry of each part. Vectors stay where they lie: a chunk is a
row that holds some thousand of them, each part's points sorted along a Hilbert
curve and cut into flat blocks with the least and greatest value of each
component and their sums. Chunks are written once; a round is one pass over
them. From a block's box follow the least and the greatest distance of any of
its points to each entry; an entry whose least distance is above another one's
greatest can't be the nearest of any. If one entry is left, the block's sums
are that entry's without a look at the points, else a small kernel on whole
numbers compares the points with the entries left. A task hands on one sum for
each part and entry, and that alone is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import Scratch, bounded_batches
from weft.llm.embedding_dedup import rows_of

PARTS, ENTRIES, ROUNDS = 16, 64, 2
SCALE = 256
#: Components of a chunk, vectors of a block, and differences that a kernel holds at once.
CHUNK, BLOCK, HELD = 1 << 19, 64, 1 << 21
#: Bits of a place on the curve.
CURVE = 62
#: Components are held below this, so that squares and sums stay whole 64-bit numbers.
MOST = 1 << 24


def hilbert(points: np.ndarray) -> np.ndarray:
    """The place of each row of whole numbers on a Hilbert curve through their box.

    Components are scaled to as many bits as 62 allow for, 8 at most; of more
    than 62 components the first 62 count.
    """
    n, d = points.shape
    d = min(d, CURVE)
    bits = max(1, min(8, CURVE // max(d, 1)))
    low, high = (f(points[:, :d], axis=0, initial=0) if not n else f(points[:, :d], axis=0) for f in (np.min, np.max))
    x = [((points[:, k].astype(np.int64) - low[k]) * ((1 << bits) - 1) // max(int(high[k]) - int(low[k]), 1)) for k in range(d)]
    # from the top bit down, turn and mirror what is below as the curve does
    for bit in range(bits - 1, 0, -1):
        below = (1 << bit) - 1
        for k in range(d):
            swap = np.where(x[k] >> bit & 1, 0, (x[0] ^ x[k]) & below)
            mirror = np.where(x[k] >> bit & 1, below, 0)
            if k:
                x[k] = x[k] ^ swap
            x[0] = x[0] ^ swap ^ mirror if k else x[0] ^ mirror
    for k in range(1, d):
        x[k] = x[k] ^ x[k - 1]
    flip = np.zeros(n, dtype=np.int64)
    for bit in range(bits - 1, 0, -1):
        flip ^= np.where(x[d - 1] >> bit & 1, (1 << bit) - 1, 0) if d else 0
    place = np.zeros(n, dtype=np.int64)
    for bit in range(bits - 1, -1, -1):
        for k in range(d):
            place = place << 1 | ((x[k] ^ flip) >> bit & 1)
    return place


def whole(vectors: np.ndarray, most: int) -> np.ndarray:
    """``floor(256 x)`` of each component, held between ``-most`` and ``most``."""
    return np.clip(np.floor(vectors * SCALE), -most, most).astype(np.int64)


@dataclass
class Chunk:
    """Points ``(part, vector, component)`` in the order of each part's curve, ``order`` their vectors, and the blocks' boxes and sums."""

    order: np.ndarray
    points: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        n = self.points.shape[1]
        return np.minimum(BLOCK, n - BLOCK * np.arange(self.low.shape[1]))

    @classmethod
    def of(cls, vectors: np.ndarray, parts: int) -> Chunk:
        """From whole numbers ``(vector, component)``."""
        cut = vectors.reshape(len(vectors), parts, -1).transpose(1, 0, 2)
        order = np.stack([np.argsort(hilbert(p), kind="stable") for p in cut]).astype(np.int32)
        points = np.take_along_axis(cut, order[:, :, None].astype(np.intp), axis=1)
        starts = np.arange(0, len(vectors), BLOCK)
        low, high, sums = (f.reduceat(points, starts, axis=1) for f in (np.minimum, np.maximum, np.add))
        return cls(order, points.astype(np.int16 if np.abs(points).max(initial=0) < 1 << 15 else np.int32), low, high, sums)


def shortlists(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Which entries may be the nearest of a point in each box, ``(box, entry)``."""
    low, high, e = low[:, None, :], high[:, None, :], entries[None, :, :]
    least = (np.maximum(np.maximum(low - e, e - high), 0) ** 2).sum(axis=2)
    greatest = (np.maximum(np.abs(e - low), np.abs(e - high)) ** 2).sum(axis=2)
    return least <= greatest.min(axis=1, keepdims=True)


def nearest(chunk: Chunk, part: int, entries: np.ndarray, blocks: np.ndarray, short: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``points, entry, distance`` of all points of some blocks, by exact comparison with each block's shortlist; ties to the lower entry."""
    n, width = chunk.points.shape[1:]
    largest = max(int(np.abs(chunk.points[part]).max(initial=0)), int(np.abs(entries).max(initial=0)))
    kind = np.int32 if width * (2 * largest) ** 2 < 1 << 31 else np.int64
    e, many = entries.astype(kind), short.sum(axis=1)
    for m in np.unique(many[blocks]).tolist():
        alike = blocks[many[blocks] == m]
        step = max(1, HELD // (BLOCK * m * width))
        for k in range(0, len(alike), step):
            some = alike[k : k + step]
            listed = np.nonzero(short[some])[1].reshape(len(some), m)
            at = some[:, None] * BLOCK + np.arange(BLOCK)
            held = at < n
            p = chunk.points[part][np.minimum(at, n - 1)].astype(kind)
            distance = np.zeros((len(some), BLOCK, m), dtype=kind)
            for c in range(width):
                distance += (p[:, :, c, None] - e[listed, c][:, None, :]) ** 2
            best = distance.argmin(axis=2)
            entry = np.take_along_axis(listed, best, axis=1)
            yield at[held], entry[held], np.take_along_axis(distance, best[:, :, None], axis=2)[:, :, 0][held].astype(np.int64)


def add_sums(chunk: Chunk, books: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> int:
    """Adds what falls to each entry, ``counts`` and ``sums`` by part and entry; returns the points that were compared one by one."""
    compared = 0
    for part, entries in enumerate(books):
        short = shortlists(chunk.low[part], chunk.high[part], entries)
        one = short.sum(axis=1) == 1
        entry = short.argmax(axis=1)
        np.add.at(counts[part], entry[one], chunk.counts[one])
        np.add.at(sums[part], entry[one], chunk.sums[part][one])
        for at, chosen, _ in nearest(chunk, part, entries, np.flatnonzero(~one), short):
            compared += len(at)
            counts[part] += np.bincount(chosen, minlength=len(entries))
            np.add.at(sums[part], chosen, chunk.points[part][at])
    return compared


def codes_of(chunk: Chunk, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``codes, error``: each vector's entries by part, and its squared distances summed."""
    parts, n = chunk.order.shape
    codes, error = np.zeros((n, parts), dtype=np.uint8), np.zeros(n, dtype=np.int64)
    for part, entries in enumerate(books):
        short = shortlists(chunk.low[part], chunk.high[part], entries)
        for at, chosen, distance in nearest(chunk, part, entries, np.arange(len(short)), short):
            vector = chunk.order[part][at]
            codes[vector, part] = chosen
            error[vector] += distance
    return codes, error


_BINARY = {"order": np.int32, "points": None, "low": np.int64, "high": np.int64, "sums": np.int64}


def _read(row: dict, parts: int, width: int) -> Chunk:
    n = len(row["vec_id"])
    shape = {"order": (parts, n), "points": (parts, n, width)}
    kinds = _BINARY | {"points": np.int16 if row["short"] else np.int32}
    return Chunk(**{k: np.frombuffer(row[k], dtype=kinds[k]).reshape(shape.get(k, (parts, -1, width))) for k in _BINARY})


@dataclass
class VectorCodes:
    coded: DataFrame  # vec_id, label, code, error
    books: np.ndarray  # part, entry, component
    width: int
    compared: list[int] = field(default_factory=list)  # points looked at one by one, by round

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()

    def decoded(self) -> DataFrame:
        """``vec_id, vector``: each code's entries, as the components that they stand for."""
        books, width, parts = self.coded.sparkSession.sparkContext.broadcast(self.books), self.width, len(self.books)

        def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes = np.array([list(bytes.fromhex(c)) for c in batch.column(1).to_pylist()], dtype=np.intp).reshape(-1, parts)
                x = books.value[np.arange(parts), codes].reshape(len(codes), -1)[:, :width] / SCALE
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * width), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["vec_id", "vector"])

        return self.coded.select("vec_id", "code").mapInArrow(decode, "vec_id long, vector array<double>")


def compress_vectors(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> VectorCodes:
    """Codes of ``vectors(vec_id, embedding, label)``, with codebooks of ``entries``, 256 at most, for each of ``parts`` equal parts.

    Vectors that are null or hold null or non-finite components are left out.
    Each component x counts as floor(256 x), held within 24 bits. A codebook
    starts from the vectors of least vec_id, null last, repeated ones in the
    order of their components; with fewer vectors it has fewer entries. In each
    round every part goes to its nearest entry, the lower one of a tie, and an
    entry becomes the floor of its parts' mean; unused ones stay. Vectors of
    different length are filled up with zeros, to a multiple of ``parts``.
    Repeated vec_ids have a row each. An empty table gives no codes and empty
    codebooks. Other columns aren't read.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark)
    number = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    label = vectors.schema["label"].dataType.simpleString()
    sound = "vector IS NOT NULL AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(number).alias("vector"), "label").filter(sound)
    length = int(rows.agg(F.max(F.size("vector"))).first()[0] or 0)
    width = max(1, -(-length // parts))
    most = min(MOST, isqrt((1 << 61) // (width * parts)) // 2)

    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").toArrow().column("vector")
    books = whole(rows_of(first, width * parts), most).reshape(-1, parts, width).transpose(1, 0, 2) if len(first) else np.zeros((parts, 0, width), dtype=np.int64)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = max(1, CHUNK // (width * parts))

        def chunk(table: pa.Table) -> pa.RecordBatch:
            c = Chunk.of(whole(rows_of(table.column("vector"), width * parts), most), parts)
            lists = [pa.ListArray.from_arrays(pa.array([0, table.num_rows], pa.int32()), table.column(k).combine_chunks()) for k in ("vec_id", "label")]
            binary = [pa.array([getattr(c, k).tobytes()], pa.binary()) for k in _BINARY]
            return pa.RecordBatch.from_arrays([*lists, pa.array([c.points.dtype == np.int16]), *binary], names=["vec_id", "label", "short", *_BINARY])

        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= size:
                table = pa.Table.from_batches(held)
                yield chunk(table.slice(0, size))
                held = table.slice(size).to_batches()
        if sum(b.num_rows for b in held):
            yield chunk(pa.Table.from_batches(held))

    packed = f"vec_id array<long>, label array<{label}>, short boolean, " + ", ".join(f"{k} binary" for k in _BINARY)
    chunks = scratch.put(rows.select("vec_id", "vector", "label").mapInArrow(pack, packed))

    out = VectorCodes(None, books, length)
    for _ in range(rounds if books.shape[1] else 0):
        now = spark.sparkContext.broadcast(books)

        def add(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            counts, sums, compared = np.zeros(now.value.shape[:2], dtype=np.int64), np.zeros(now.value.shape, dtype=np.int64), 0
            for batch in batches:
                for row in batch.to_pylist():
                    compared += add_sums(_read(row, parts, width), now.value, counts, sums)
            # the count stands before the components' sums
            part, entry, place = np.nonzero(np.concatenate([counts[:, :, None], sums], axis=2))
            value = np.concatenate([counts[:, :, None], sums], axis=2)[part, entry, place]
            yield pa.RecordBatch.from_arrays([pa.array(np.append(x, y)) for x, y in ((part, -1), (entry, 0), (place, 0), (value, compared))], names=["part", "entry", "place", "value"])

        told = chunks.drop("label").mapInArrow(add, "part long, entry long, place long, value long").groupBy("part", "entry", "place").agg(F.sum("value").alias("value")).toArrow()
        part, entry, place, value = (told.column(k).to_numpy() for k in range(4))
        sums = np.zeros((*books.shape[:2], width + 1), dtype=np.int64)
        real = part >= 0
        sums[part[real], entry[real], place[real]] = value[real]
        out.compared.append(int(value[~real].sum()))
        used = sums[:, :, :1] > 0
        books = np.where(used, sums[:, :, 1:] // np.maximum(sums[:, :, :1], 1), books)
    out.books = books
    last = spark.sparkContext.broadcast(books)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                row = one.drop_columns(["label"]).to_pylist()[0]
                codes, error = codes_of(_read(row, parts, width), last.value)
                text = np.frombuffer(codes.tobytes().hex().encode(), dtype=np.uint8)
                ends = np.arange(len(codes) + 1, dtype=np.int32) * (2 * parts)
                code = pa.StringArray.from_buffers(len(codes), pa.py_buffer(ends.tobytes()), pa.py_buffer(text.tobytes()))
                yield pa.RecordBatch.from_arrays([one.column("vec_id").flatten(), one.column("label").flatten(), code, pa.array(error)], names=["vec_id", "label", "code", "error"])

    out.coded = scratch.put(chunks.mapInArrow(assign, f"vec_id long, label {label}, code string, error long"))
    return out


def code_errors(codes: VectorCodes) -> DataFrame:
    """``vec_id, label, code, error, label_error``: beside each vector's error the sum over its label's, nulls being one label."""
    by_label = codes.coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return codes.coded.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "label", "code", "error", "label_error")
