"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

A rotation of the principal axes is learned that makes the signs of rotated
vectors balanced and close to the vectors. The signs are a binary code; the
code is cut into parts and each part indexes a table. Vectors that share a
part in any table are candidates and are reranked by the cosine of the original
vectors in double precision, bucket by bucket, as matrix products.

Pairs whose codes differ in fewer bits than there are tables always share a
part. A pair that meets in several tables counts in the first one only, so that
links need no deduplication and pairs are never listed: each bucket returns for
each vector its number of links and one vector that it is connected with.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import Scratch, bounded_batches
from weft.llm.components import components

#: Vectors that the rotation is learned from at most, those of least hash.
SAMPLE = 20_000
ROUNDS = 40
BITS, TABLES = 64, 6
#: Bits in which a pair at the threshold is expected to differ at most.
FLIPS = 4.2
#: The share of a sample's pairs at the threshold that must share a part of the code, and vectors among which these pairs are looked for.
RECALL, JUDGED = 0.975, 4096
#: Vectors that one comparison holds at once; larger buckets are compared block by block.
BLOCK = 1024


def bits_worth(variances: np.ndarray, threshold: float, most: int = BITS) -> int:
    """How many of the leading axes to take: as many as leave pairs at the threshold few expected bit flips.

    Such a pair is ``sqrt(2 - 2 t)`` apart, over all axes alike. Where the
    vectors spread little, bits would tell noise apart; then codes are short,
    buckets large and comparisons many. This is where ``learn_rotation`` begins;
    what the pairs of a sample share then says whether fewer bits are needed.
    """
    d = len(variances)
    step = np.sqrt(max(2 - 2 * threshold, 0.0) / d)
    spread = np.sqrt(np.cumsum(np.maximum(variances, 0)) / np.arange(1, d + 1))
    flip = np.minimum(0.5, step / np.maximum(np.pi * spread, 1e-12))
    fits = np.flatnonzero(np.arange(1, d + 1) * flip <= FLIPS)
    return min(most, int(fits.max()) + 1 if len(fits) else 1)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square of a finite component overflows or vanishes."""
    x = vectors / np.maximum(np.abs(vectors).max(axis=1, keepdims=True), np.finfo(np.float64).tiny) if vectors.size else vectors
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), np.finfo(np.float64).tiny)


def rows_of(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """A list column as rows of ``width`` numbers: longer ones are cut, shorter ones filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(lengths), width))
    if (lengths == width).all():
        out[...] = flat.reshape(-1, width)
        return out
    row = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    held = place < width
    out[row[held], place[held]] = flat[held]
    return out


def _rotation(x: np.ndarray, axes: np.ndarray, rounds: int, seed: int) -> np.ndarray:
    """The axes turned so that the signs of the centred ``x`` are balanced and near to it."""
    z, bits = x @ axes, axes.shape[1]
    rotation = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))[0]
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(np.where(z @ rotation >= 0, 1.0, -1.0).T @ z)
        rotation = (u @ vt).T
    return axes @ rotation


def close_pairs(vectors: np.ndarray, labels: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one label whose cosine reaches the threshold."""
    v, found = unit(vectors), [np.zeros((2, 0), dtype=np.int64)]
    for k in range(0, len(v), BLOCK):
        a, b = np.nonzero(v[k : k + BLOCK] @ v.T >= threshold)
        a = a + k
        some = a < b if labels is None else (a < b) & (labels[a] == labels[b])
        found.append(np.stack([a[some], b[some]]))
    a, b = np.concatenate(found, axis=1)
    return a, b


def learn_rotation(sample: np.ndarray, threshold: float = 0.98, bits: int = BITS, rounds: int = ROUNDS, seed: int = 0, labels: np.ndarray | None = None, tables: int = TABLES) -> tuple[np.ndarray, np.ndarray]:
    """``mean, projection``: the signs of ``(unit vector - mean) @ projection`` are the code.

    Of a sample of some size one half teaches and the other one judges: bits
    are taken away until of its pairs at the threshold a share of ``RECALL``
    agrees in the part of some table. Leading axes of a sample spread more in it
    than elsewhere, which only vectors that didn't teach can tell. With fewer
    bits than tables some parts are empty and all vectors of a label meet.
    """
    d = sample.shape[1]
    if len(sample) < 2:
        return np.zeros(d), np.eye(d)[:, : min(bits, d)]
    judged, taught = (sample[::2], sample[1::2]) if len(sample) >= 200 else (sample, sample)
    labels = None if labels is None else labels[::2] if len(sample) >= 200 else labels
    x = unit(taught)
    mean = x.mean(axis=0)
    x = x - mean
    values, axes = np.linalg.eigh(x.T @ x / len(x))
    order = np.argsort(-values, kind="stable")
    bits = bits_worth(values[order], threshold, min(bits, d))
    judged = judged[:JUDGED]
    a, b = close_pairs(judged, labels, threshold)
    while True:
        projection = _rotation(x, axes[:, order[:bits]], rounds, seed)
        if bits == 1 or not len(a):
            return mean, projection
        keys = table_keys(judged, mean, projection, tables)
        if (keys[a] == keys[b]).any(axis=1).mean() >= RECALL:
            return mean, projection
        bits = bits - 1 if bits <= 2 * tables else bits * 7 // 8


def table_keys(vectors: np.ndarray, mean: np.ndarray, projection: np.ndarray, tables: int) -> np.ndarray:
    """The part of each vector's code in each table."""
    code = (unit(vectors) - mean) @ projection >= 0
    out = np.empty((len(vectors), tables), dtype=np.int64)
    for t, part in enumerate(np.array_split(np.arange(code.shape[1]), tables)):
        out[:, t] = code[:, part] @ (1 << np.arange(len(part), dtype=np.int64))
    return out


_META = ["label", "n", "t", "key", "p", "q"]


def _linked(group: dict[str, np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links within a block of a bucket, or between two blocks, that no earlier table shows: ``rep, links, other``."""
    order = np.argsort(group["rep"], kind="stable")
    reps, copies, block, v = group["rep"][order], group["copies"][order], group["block"][order], group["vector"][order]
    table, p, q = int(group["t"][0]), int(group["p"][0]), int(group["q"][0])
    keys = group["keys"][order][:, :table]
    v = unit(v)
    left = np.arange(len(v)) if p == q else np.flatnonzero(block == p)
    right = left if p == q else np.flatnonzero(block == q)
    a, b = np.nonzero(v[left] @ v[right].T >= threshold)
    a, b = left[a], right[b]
    if p == q:
        a, b = a[a < b], b[a < b]
    if table:
        new = ~(keys[a] == keys[b]).any(axis=1)
        a, b = a[new], b[new]
    if not len(a):
        return reps[:0], reps[:0], reps[:0]
    links = np.bincount(a, copies[b], len(v)) + np.bincount(b, copies[a], len(v))
    root = list(range(len(v)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(i), find(j)
        root[max(x, y)] = min(x, y)
    some = np.flatnonzero(links)
    return reps[some], links[some].astype(np.int64), reps[[find(i) for i in some.tolist()]]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Runs of equal bucket and blocks in sorted batches; a run may go on over batches, its size is bounded by the blocks."""
    held: list[dict[str, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        c = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in (*_META, "block", "rep", "copies")}
        keys, flat = batch.column("keys"), batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        c["keys"] = keys.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        ends = np.cumsum(c["n"])
        new = np.flatnonzero(np.any([c[name][1:] != c[name][:-1] for name in _META], axis=0)) + 1
        for start, end in zip([0, *new.tolist()], [*new.tolist(), batch.num_rows], strict=True):
            part = {name: x[start:end] for name, x in c.items()}
            part["vector"] = flat[ends[start] - c["n"][start] : ends[end - 1]].reshape(end - start, -1)
            if held and any(held[0][name][0] != part[name][0] for name in _META):
                yield held[0] if len(held) == 1 else {name: np.concatenate([h[name] for h in held]) for name in held[0]}
                held = []
            held.append(part)
    if held:
        yield held[0] if len(held) == 1 else {name: np.concatenate([h[name] for h in held]) for name in held[0]}


def embedding_near_duplicates(vectors: DataFrame, threshold: float = 0.98, tables: int = TABLES, sample: int = SAMPLE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``vectors(vec_id, embedding, label)``.

    Rows link when labels, whole numbers, are equal and not null, vectors have one length, and
    their cosine in double precision is at least ``threshold``. Vectors that are
    null, empty or zero, or hold a null or non-finite component, link with
    nothing, as do rows without vec_id. Copies are compared once and counted as
    often as they occur; repeated rows are copies. An empty table gives none.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark)
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("vector"), F.col("label").cast("long").alias("label"))
    sound = "vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL AND size(vector) > 0 AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(vector, x -> x <> 0)"
    usable = rows.filter(sound)
    classes = scratch.put(usable.groupBy("label", "vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))

    taken = classes.select("vector", "label", F.xxhash64("rep").alias("h")).orderBy("h").limit(sample).select("vector", "label").toArrow()
    width = max(int(pc.max(pc.list_value_length(taken.column("vector"))).as_py() or 1), 1) if taken.num_rows else 1
    # a part's values grow with the number of vectors, so that a bucket doesn't
    bits = max(BITS, tables * math.ceil(math.log2(max(2, classes.count() / BLOCK))))
    codes = spark.sparkContext.broadcast(learn_rotation(rows_of(taken.column("vector"), width), threshold, bits, labels=taken.column("label").to_numpy(), tables=tables))
    del taken

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, projection = codes.value
        for batch in batches:
            x = rows_of(batch.column("vector"), len(mean))
            x[~x.any(axis=1)] = 1.0
            keys = table_keys(x, mean, projection, tables)
            ends = np.arange(len(keys) + 1, dtype=np.int32) * tables
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))], names=[*batch.schema.names, "keys"])

    coded = scratch.put(classes.mapInArrow(keyed, f"label long, vector {kind}, rep long, copies long, keys array<long>").withColumn("n", F.size("vector")))
    bucket = ["label", "n", "t", "key"]
    entries = coded.select("label", "n", "rep", F.posexplode("keys").alias("t", "key"))
    sizes = entries.groupBy(*bucket).agg(F.count("*").alias("members")).filter("members > 1")
    placed = entries.join(sizes, bucket).withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("rep", "t", "key", "block", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))
    dealt = met.join(coded, "rep").repartition(*_META).sortWithinPartitions(*_META)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for group in _groups(batches):
            out.append(_linked(group, threshold))
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["rep", "links", "other"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["rep", "links", "other"])

    found = scratch.put(dealt.select(*_META, "block", "rep", "copies", "keys", "vector").mapInArrow(compare, "rep long, links long, other long"))

    roots = components(found.select(F.col("rep").alias("a"), F.col("other").alias("b")), scratch).withColumnRenamed("node", "rep")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    by_class = classes.join(links, "rep", "left").join(roots, "rep", "left").select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    good = usable.join(by_class, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    rest = rows.filter(f"NOT coalesce({sound}, false)").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionAll(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
