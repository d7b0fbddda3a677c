"""N-gram Jaccard self-join by vertical partitioning of the global shingle order.

Every document is the set of its distinct word shingles. All shingles have one
global order, rare ones first; the order is cut into fragments of equal mass,
and a document's set falls into one segment for each fragment.

1. A count sketch, sized by the number of rows up to a bound and filled from
   all documents, ranks shingles. Any order gives the same result; this one
   makes few candidates.
2. Documents with equal sets become one class at once, by a 128-bit print.
3. Sets that meet the threshold share a shingle among the first
   ``n - ceil(t * n) + 1`` of the order. Documents that share such a shingle
   are candidates. First each is held against a hub of its bucket, which
   is linear in the bucket; dense groups of copies fall together there. What
   is still apart is screened pair by pair with parity prints. Of the pairs that
   pass, each document's nearest is taken first, then every pair that isn't
   connected by these, without exception, so that no link between components is
   lost.
4. Overlaps of candidates are counted fragment by fragment, each apart from
   the others, and summed for each pair.

Links are kept only as far as they connect: all pairs of a group of copies are
never listed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.llm.common import Scratch, bounded_batches, slices
from weft.llm.components import components
from weft.llm.shingles import mix, shingle_sets

#: The least and the most counters of the sketch, in bits, and rows for each; every task sends as many as it fills.
SKETCH_BITS, MOST_SKETCH_BITS, SKETCH_ROWS = 20, 22, 16
BLOCK = 1 << 14
#: The least and the most bits of the filter that tells which documents are candidates, and bits for each of these.
FILTER_BITS, MOST_FILTER_BITS, FILTER_EACH = 24, 30, 32
FRAGMENTS = 8
#: The same for the filter of shingles that several sets have early in the order.
SHARED_BITS, MOST_SHARED_BITS, SHARED_EACH = 20, 28, 16
#: Words of 64 bits in the parity print of a set.
PARITY = 8
#: How many bits of the prints of ``a`` and ``b`` differ.
BITS_APART = " + ".join(f"bit_count(a.s{k} ^ b.s{k})" for k in range(PARITY))
#: Rounds in which members of a bucket are held against one of them.
HUBS = 1
#: Earlier shared shingles by which a pair that meets again is known.
BEFORE = 32
#: Bytes of text for which sets are held at once.
SLICE_BYTES = 2 << 20


def sum_blocks(parts: DataFrame, kind: str) -> DataFrame:
    """Sum (or, for bits, OR) arrays ``data`` of one ``block``, in two levels so that no task reads many.

    A task holds one array for each block, as much as the whole sketch at most.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(data.as_buffer(), dtype=kind)
                if block not in total:
                    total[block] = x.copy()
                elif kind == "u1":
                    total[block] |= x
                else:  # counters stop at their largest value
                    total[block] += np.minimum(x, np.iinfo(kind).max - total[block])
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["block", "data"])

    levels = math.isqrt(int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))) + 1
    once = parts.repartition(levels).mapInArrow(merge, "block int, data binary")
    return once.repartition(levels, "block").mapInArrow(merge, "block int, data binary")


def collect_blocks(parts: DataFrame, kind: str, size: int) -> np.ndarray:
    out = np.zeros(size, dtype=kind)
    for block, data in sum_blocks(parts, kind).collect():
        x = np.frombuffer(data, dtype=kind)
        out[block * len(x) : block * len(x) + len(x)] = x
    return out


def size_bits(places: int, least: int, most: int) -> int:
    """Bits that tell so many places apart, within bounds."""
    return min(most, max(least, (max(1, places) - 1).bit_length()))


def _bits(table: np.ndarray) -> np.uint64:
    return np.uint64(64 - (len(table).bit_length() - 1))


def shingle_sketch(docs: DataFrame, words: int, bits: int = SKETCH_BITS, text: str = "text") -> np.ndarray:
    """How often the shingles of each of ``2 ** bits`` counters occur, over all documents."""
    slots = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(slots, dtype=np.uint32)
        for batch in slices(batches, text, SLICE_BYTES):
            sets = shingle_sets(batch.column(0), words)
            every = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
            at, n = np.unique((every >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
            counts[at] += np.minimum(n.astype(np.uint32), np.iinfo("u4").max - counts[at])
        blocks = counts.reshape(-1, BLOCK)
        some = np.flatnonzero(blocks.any(axis=1))
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([blocks[i].tobytes() for i in some.tolist()], pa.binary())], names=["block", "data"])

    parts = docs.select(text).mapInArrow(count, "block int, data binary")
    return collect_blocks(parts, "u4", slots)


def order_keys(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Place of each shingle in the global order: by its counter, then by its hash."""
    rank = np.minimum(counts[(shingles >> _bits(counts)).astype(np.int64)], (1 << 24) - 1)
    return (rank.astype(np.uint64) << np.uint64(40)) | (mix(shingles) >> np.uint64(24))


def pivots(counts: np.ndarray, fragments: int) -> np.ndarray:
    """Keys that cut the global order into fragments which hold about equally many occurrences."""
    values, repeats = np.unique(np.minimum(counts, (1 << 24) - 1), return_counts=True)
    mass = np.cumsum(values.astype(np.float64) * repeats)
    cuts = []
    for i in range(1, fragments):
        goal = mass[-1] * i / fragments
        k = int(np.searchsorted(mass, goal))
        before = mass[k - 1] if k else 0.0
        share = (goal - before) / max(mass[k] - before, 1e-9)
        cuts.append((int(values[k]) << 40) | min(int(share * 2**40), 2**40 - 1))
    return np.array(cuts, dtype=np.uint64)


def _sets_table(docs: DataFrame, words: int, num: int, den: int, shared) -> DataFrame:
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in slices(batches, "text", SLICE_BYTES):
            sizes, one, two, heads, parity = [], [], [], [], []
            for s in shingle_sets(batch.column(1), words):
                n = len(s)
                sizes.append(n)
                m = mix(s)
                one.append(int(m.sum(dtype=np.uint64).astype(np.int64)))
                two.append(int(mix(m).sum(dtype=np.uint64).astype(np.int64)))
                keep = n + (-num * n // den) + 1 if n else 0
                keys = order_keys(s, counts)
                heads.append(s[np.argsort(keys, kind="stable")[:keep]].astype(np.int64))
                odd = np.bincount((m & np.uint64(64 * PARITY - 1)).astype(np.int64), minlength=64 * PARITY) & 1
                parity.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            ends = np.cumsum([0, *map(len, heads)]).astype(np.int32)
            flat = np.concatenate(heads) if heads else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int64())), *(pa.array([x[k] for x in parity], pa.int64()) for k in range(PARITY))],
                names=["doc_id", "n", "f1", "f2", "head", *(f"s{k}" for k in range(PARITY))],
            )

    return docs.select("doc_id", "text").mapInArrow(digest, "doc_id long, n long, f1 long, f2 long, head array<long>" + "".join(f", s{k} long" for k in range(PARITY)))


def _bit_filter(ids: DataFrame, bits: int) -> np.ndarray:
    """A bit for each identifier's hash; bits that two share only let more documents through."""
    size = 1 << (bits - 3)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, any_rows = np.zeros(size, dtype=np.uint8), False
        for batch in batches:
            any_rows = True
            at = _slot(batch.column(0).to_numpy(zero_copy_only=False), bits)
            np.bitwise_or.at(packed, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        if any_rows:
            some = [i for i in range(size // BLOCK) if packed[i * BLOCK : (i + 1) * BLOCK].any()]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([packed[i * BLOCK : (i + 1) * BLOCK].tobytes() for i in some], pa.binary())], names=["block", "data"])

    parts = ids.mapInArrow(mark, "block int, data binary")
    return collect_blocks(parts, "u1", size)


def _slot(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def _segments(docs: DataFrame, words: int, shared, wanted, bits: int, cuts: np.ndarray) -> DataFrame:
    """``doc_id, f1, side, fragment, part``: the sets of the wanted documents, cut at the pivots; repeated rows repeat.

    ``side`` has bit 0 for documents of the first of the two filters ``wanted``, bit 1 for those of the second.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, filters = shared.value, wanted.value
        for batch in slices(batches, "text", SLICE_BYTES):
            at = _slot(batch.column(0).to_numpy(zero_copy_only=False), bits)
            side = sum(((flags[at >> 3] >> (at & 7).astype(np.uint8)) & 1) << k for k, flags in enumerate(filters))
            batch, side = batch.filter(pa.array(side > 0)), side[side > 0].tolist()
            if not batch.num_rows:
                continue
            ids, prints, sides, fragments, parts = [], [], [], [], []
            for doc, of, s in zip(batch.column(0).to_pylist(), side, shingle_sets(batch.column(1), words), strict=True):
                one = int(mix(s).sum(dtype=np.uint64).astype(np.int64))
                place = np.searchsorted(cuts, order_keys(s, counts), side="right")
                s = s[np.argsort(place, kind="stable")].astype(np.int64)
                ends = np.cumsum(np.bincount(place, minlength=len(cuts) + 1))
                start = 0
                for k, end in enumerate(ends.tolist()):
                    if end > start:
                        ids.append(doc)
                        prints.append(one)
                        sides.append(of)
                        fragments.append(k)
                        parts.append(s[start:end])
                    start = end
            lengths = np.cumsum([0, *map(len, parts)]).astype(np.int32)
            flat = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(prints, pa.int64()), pa.array(sides, pa.int32()), pa.array(fragments, pa.int32()), pa.ListArray.from_arrays(pa.array(lengths), pa.array(flat, pa.int64()))], names=["doc_id", "f1", "side", "fragment", "part"])

    return docs.select("doc_id", "text").filter("doc_id IS NOT NULL").mapInArrow(cut, "doc_id long, f1 long, side int, fragment int, part array<long>")


def _links(pairs: DataFrame, docs: DataFrame, repeated: DataFrame | None, words: int, num: int, den: int, shared, cuts: np.ndarray, scratch: Scratch) -> DataFrame:
    """Of the pairs ``a, b, fa, fb, na, nb`` those that meet the threshold.

    ``repeated`` has the documents of which a set stands in several rows; their
    fragments are reduced to one of each, so that an overlap counts once.
    """
    spark = docs.sparkSession
    bits = size_bits(pairs.count() * FILTER_EACH, FILTER_BITS, MOST_FILTER_BITS)
    wanted = spark.sparkContext.broadcast([_bit_filter(pairs.select(c), bits) for c in ("a", "b")])
    parts = scratch.put(_segments(docs, words, shared, wanted, bits, cuts))
    if repeated is not None:
        every = parts
        once = every.join(repeated, "doc_id", "left_semi").groupBy("doc_id", "f1", "side", "fragment").agg(F.first("part").alias("part"))
        parts = scratch.put(every.join(repeated, "doc_id", "left_anti").unionByName(once))
        scratch.drop(every)
    left = parts.filter("side & 1 <> 0").select(F.col("doc_id").alias("a"), F.col("f1").alias("fa"), "fragment", F.col("part").alias("x"))
    right = parts.filter("side & 2 <> 0").select(F.col("doc_id").alias("b"), F.col("f1").alias("fb"), "fragment", F.col("part").alias("y"))
    pair = ["a", "b", "fa", "fb", "na", "nb"]
    partial = pairs.join(left, ["a", "fa"]).join(right, ["b", "fb", "fragment"]).select(*pair, F.size(F.array_intersect("x", "y")).cast("long").alias("overlap"))
    summed = partial.groupBy(*pair).agg(F.sum("overlap").alias("overlap"))
    out = scratch.put(summed.filter(F.col("overlap") * den >= (F.col("na") + F.col("nb") - F.col("overlap")) * num).select("a", "b"))
    scratch.drop(parts)
    return out


def _may_meet(num: int, den: int, places: bool = False) -> str:
    """A condition on ``na, nb`` that holds for all pairs at the threshold.

    With ``places``, also on the places ``ia, ib`` at which both have the shared
    shingle: what stands before the first shared one is in one set only.
    """
    least = f"least(na{' - ia' * places}, nb{' - ib' * places})"
    return f"{least} * {num + den} >= (na + nb) * {num}"


def _different(num: int, den: int) -> str:
    """No more bits of the parity prints differ than elements of the sets; sets at the threshold differ in few."""
    return f"({BITS_APART}) * {num + den} <= (a.n + b.n) * {den - num}"


def ngram_jaccard_join(docs: DataFrame, words: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs(doc_id, text)``.

    Two documents link when ``den * |A & B| >= num * |A | B|`` for their sets of
    ``words``-word shingles; ``component_id`` is the least doc_id reachable by
    links, the document's own included. Empty, null and wordless texts have no
    shingles and link with nothing. Texts with fewer words than a shingle have
    one. Repeated rows give repeated result rows; rows that share a doc_id are
    one document, which links as any of their texts does. A null doc_id links with nothing and has a null component.
    Columns besides the two are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = shingle_sketch(docs, words, size_bits(docs.count() // SKETCH_ROWS, SKETCH_BITS, MOST_SKETCH_BITS))
    cuts, shared = pivots(counts, FRAGMENTS), spark.sparkContext.broadcast(counts)
    sets = scratch.put(_sets_table(docs, words, num, den, shared))

    known = sets.filter("n > 0 AND doc_id IS NOT NULL")
    classes = scratch.put(known.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep")))
    one = ["doc_id", "f1", "f2"]
    prints = known.join(classes.select(F.col("rep").alias("doc_id"), "f1", "f2"), one, "left_semi").dropDuplicates(one)
    prints = scratch.put(prints.select("doc_id", "f1", "n", "head", *(f"s{k}" for k in range(PARITY))))
    slim = scratch.put(sets.select("doc_id", "n", "f1", "f2"))
    scratch.drop(sets)
    sets, known = slim, slim.filter("n > 0 AND doc_id IS NOT NULL")
    repeated = scratch.put(known.groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1").select("doc_id"))
    if repeated.isEmpty():
        repeated = None
    shared_by = scratch.put(_shared_shingles(prints, num, den))
    bits = size_bits(shared_by.count() * SHARED_EACH, SHARED_BITS, MOST_SHARED_BITS)
    held = spark.sparkContext.broadcast(_bit_filter(shared_by, bits))
    buckets = scratch.put(_entries(prints, held, bits).join(shared_by, "shingle"))
    done: list[DataFrame] = []
    edges, members = None, buckets.withColumn("root", F.col("doc_id"))
    for salt in range(HUBS):
        pairs = _screened(_hub_pairs(members, salt, num, den), prints, num, den)
        for earlier in done:
            pairs = pairs.join(earlier.select("a", "b"), ["a", "b"], "left_anti")
        done.append(scratch.put(pairs))
        found = _links(done[-1], docs, repeated, words, num, den, shared, cuts, scratch)
        joined = scratch.put(components(found if edges is None else edges.unionAll(found), scratch))
        edges = joined.select(F.col("node").alias("a"), F.col("root").alias("b"))
        members = scratch.put(_open_members(buckets, joined))
    rest = _open_pairs(_with_before(members, repeated), prints, num, den)
    for earlier in done:
        rest = rest.join(earlier.select("a", "b"), ["a", "b"], "left_anti")
    rest, later = scratch.put(rest), []
    if not rest.isEmpty():
        near = scratch.put(_nearest(rest))
        found = _links(near, docs, repeated, words, num, den, shared, cuts, scratch)
        joined = scratch.put(components(edges.unionAll(found), scratch))
        edges = joined.select(F.col("node").alias("a"), F.col("root").alias("b"))
        apart = scratch.put(_still_open(rest, joined).join(near, near.columns, "left_anti"))
        later = [near, apart]
        if not apart.isEmpty():
            edges = edges.unionAll(_links(apart, docs, repeated, words, num, den, shared, cuts, scratch))
    # classes stand for their documents; a document that stands in several joins these
    several = known.join(repeated, "doc_id", "left_semi") if repeated is not None else known.limit(0)
    of = several.join(classes, ["f1", "f2", "n"]).select("doc_id", "rep").distinct()
    across = of.join(of.groupBy("doc_id").agg(F.min("rep").alias("least")), "doc_id").filter("rep <> least").select(F.col("rep").alias("a"), F.col("least").alias("b"))
    last = components(edges.unionAll(across), scratch).select(F.col("node").alias("rep"), "root")
    roots = classes.join(last, "rep", "left").select("f1", "f2", "n", F.coalesce("root", "rep").alias("class_root"))
    roots = scratch.put(roots)
    scratch.drop(prints, shared_by, buckets, members, rest, repeated, classes, *done, *later)
    # a row without words goes where its doc_id's other texts are
    wordless = "n = 0 OR doc_id IS NULL"
    empty = sets.filter("n = 0 AND doc_id IS NOT NULL").select("doc_id").distinct()
    beside = known.join(empty, "doc_id", "left_semi").join(roots, ["f1", "f2", "n"]).groupBy("doc_id").agg(F.min("class_root").alias("class_root"))
    out = sets.filter(f"NOT ({wordless})").join(roots, ["f1", "f2", "n"], "left").select("doc_id", "n", "class_root")
    out = out.unionByName(sets.filter(wordless).join(beside, "doc_id", "left").select("doc_id", "n", "class_root"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("class_root", "doc_id")).alias("component_id"))


def _shared_shingles(prints: DataFrame, num: int, den: int) -> DataFrame:
    """``shingle`` of the buckets in which two sets may meet the threshold by their sizes and the shingle's places.

    A set's size is a bit of 32, round about, in steps of the ratio that sizes
    may have; sizes at the threshold are at the same bit or the next. The
    smaller set of a pair has the shingle so early that what is left of it can
    be the overlap of two sets of its size. A second 32 bits tell the sizes of
    sets that do. Counts and bits are combined before the shuffle; other
    buckets hold no pair.
    """
    entries = prints.select("n", F.posexplode("head").alias("i", "shingle"))
    step = math.log(den / num) * (1 + 1e-9) if num < den else 1e-9
    early = f"if((n - i) * {num + den} >= 2 * n * {num}, {(1 << 32) + 1}L, 1L)"
    bits = F.expr(f"shiftleft({early}, cast(pmod(floor(ln(n) / {step!r}D), 32) as int))")
    tally = entries.groupBy("shingle").agg(F.count("*").alias("sets"), F.bit_or(bits).alias("bits"))
    sizes, first, after = f"(bits & {(1 << 32) - 1}L)", "shiftrightunsigned(bits, 32)", "(shiftrightunsigned(bits, 31) | shiftrightunsigned(bits, 63))"
    return tally.filter(f"{first} <> 0 AND (sets > bit_count({sizes}) OR ({sizes} & {after} & {(1 << 32) - 1}L & if(bits < 0, -1L, -2L)) <> 0)").select("shingle")


def _entries(prints: DataFrame, held, bits: int) -> DataFrame:
    """``doc_id, n, i, shingle``: the places of heads whose shingle the filter holds, so that few others are shuffled."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = held.value
        for batch in batches:
            lengths = batch.column(2).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            at = _slot(flat, bits)
            keep = np.flatnonzero((flags[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
            row = np.repeat(np.arange(len(lengths)), lengths)[keep]
            place = keep - (np.cumsum(lengths) - lengths)[row]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(place, pa.int64()), pa.array(flat[keep], pa.int64())], names=["doc_id", "n", "i", "shingle"])

    return prints.select("doc_id", "n", "head").mapInArrow(spread, "doc_id long, n long, i long, shingle long")


def _screened(pairs: DataFrame, prints: DataFrame, num: int, den: int) -> DataFrame:
    """``a, b, fa, fb, na, nb`` of the pairs whose parity prints don't rule the threshold out."""
    one = pairs.alias("p").join(prints.drop("head").alias("a"), F.expr("p.a = a.doc_id"))
    both = one.join(prints.drop("head").alias("b"), F.expr("p.b = b.doc_id"))
    return both.filter(_different(num, den)).selectExpr("p.a a", "p.b b", "a.f1 fa", "b.f1 fb", "a.n na", "b.n nb").filter(_may_meet(num, den))


def _hub_pairs(members: DataFrame, salt: int, num: int, den: int) -> DataFrame:
    """Each member of a bucket with the bucket's hub, a member by hash, if they aren't connected."""
    hub = F.min(F.struct(F.xxhash64(F.lit(salt), "doc_id", "shingle").alias("h"), F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("i").alias("ib"), F.col("root").alias("rb")))
    hubs = members.groupBy("shingle").agg(hub.alias("m")).select("shingle", "m.b", "m.nb", "m.ib", "m.rb")
    held = members.join(hubs, "shingle").selectExpr("doc_id a", "n na", "i ia", "root ra", "b", "nb", "ib", "rb")
    return held.filter(f"ra <> rb AND {_may_meet(num, den, True)}").selectExpr("least(a, b) a", "greatest(a, b) b").distinct()


def _open_members(buckets: DataFrame, joined: DataFrame) -> DataFrame:
    """The entries of buckets that hold more than one component, each with its root and the bucket's largest component."""
    labelled = buckets.join(joined.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    tally = labelled.groupBy("shingle", "root").agg(F.count("*").alias("members"))
    main = tally.groupBy("shingle").agg(F.count("*").alias("roots"), F.max(F.struct("members", "root")).alias("top")).filter("roots > 1").select("shingle", F.col("top.root").alias("main"))
    return labelled.join(main, "shingle").select("shingle", "doc_id", "n", "i", "root", "main")


def _with_before(members: DataFrame, repeated: DataFrame | None) -> DataFrame:
    """``members`` with ``before``: up to ``BEFORE`` shingles that the document has open buckets for and that come just before in the order.

    Two documents that share one of these have met in its bucket, where places
    and sizes allow for no less than here. Documents with several sets have none.
    """
    line = W.partitionBy("doc_id").orderBy("i", "shingle").rowsBetween(-BEFORE, -1)
    out = members.withColumn("before", F.collect_list("shingle").over(line))
    if repeated is None:
        return out
    marked = out.join(repeated.withColumn("several", F.lit(True)), "doc_id", "left")
    return marked.withColumn("before", F.when(F.col("several"), F.array().cast("array<long>")).otherwise(F.col("before"))).drop("several")


def _open_pairs(members: DataFrame, prints: DataFrame, num: int, den: int) -> DataFrame:
    """``a, b, fa, fb, na, nb, far`` of every pair that shares a bucket, may meet the threshold, and isn't connected yet.

    ``far`` is how many bits of the prints differ for each element of the sets.

    A pair is made in the first bucket that both are in, as far as ``before``
    tells. In each bucket the members outside its largest component are held against
    all the others; within a component no pair is made. Places, sizes and
    parity prints are part of the join's condition. A doc_id with several sets
    has each of its entries with each of them, the entry's own among these.
    """
    signed = members.drop("n").join(prints.select("doc_id", "f1", "n", *(f"s{k}" for k in range(PARITY))), "doc_id")
    x, y = signed.filter("root <> main").alias("a"), signed.alias("b")
    sides = _may_meet(num, den, True)
    for name, column in (("na", "a.n"), ("nb", "b.n"), ("ia", "a.i"), ("ib", "b.i")):
        sides = sides.replace(name, column)
    met = x.join(y, F.expr(f"a.shingle = b.shingle AND a.root <> b.root AND (b.root = b.main OR a.doc_id < b.doc_id) AND {sides} AND {_different(num, den)} AND NOT arrays_overlap(a.before, b.before)"))
    return met.selectExpr("least(a.doc_id, b.doc_id) a", "greatest(a.doc_id, b.doc_id) b", "if(a.doc_id < b.doc_id, a.f1, b.f1) fa", "if(a.doc_id < b.doc_id, b.f1, a.f1) fb", "if(a.doc_id < b.doc_id, a.n, b.n) na", "if(a.doc_id < b.doc_id, b.n, a.n) nb", f"({BITS_APART}) / (a.n + b.n) far").distinct()


def _nearest(pairs: DataFrame) -> DataFrame:
    """For each document the pair with the least ``far``; as many pairs as documents at most."""
    pair = ["a", "b", "fa", "fb", "na", "nb"]
    row = F.struct("far", *pair).alias("m")
    ends = pairs.select(F.col("a").alias("node"), row).unionAll(pairs.select(F.col("b").alias("node"), row))
    return ends.groupBy("node").agg(F.min("m").alias("m")).select(*(f"m.{c}" for c in pair)).distinct()


def _still_open(pairs: DataFrame, joined: DataFrame) -> DataFrame:
    """The pairs whose documents are in different components."""
    ra, rb = (joined.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in ("a", "b"))
    placed = pairs.join(ra, "a", "left").join(rb, "b", "left")
    return placed.filter("coalesce(ra, a) <> coalesce(rb, b)").select("a", "b", "fa", "fb", "na", "nb")
