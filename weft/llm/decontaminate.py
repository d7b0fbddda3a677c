"""Benchmark decontamination with a positional inverted index of the training texts.

Test items are cut into windows of consecutive words. The corpus is asked how
often it holds each test term; a window of which any term never occurs is done.
Of the others the rarest terms, with their offsets in the window, are what the
index is asked for, so that only their postings are stored: for each document
the terms and the places of their occurrences. The index stays dealt out by
documents; windows go to it in blocks of bounded size. There the list of a
window's rarest term, less the term's offset, gives places where the window may
begin, and the lists of the next rarest terms, less theirs, are intersected
with them: at no distance for a phrase, within a slack for a proximity match.
Phrases are then held against the whole window in the text itself.

A document's matches depend on its text alone and are looked up by a print of
it, 128 bits, so that copies are held against their text once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import Scratch, bounded_batches
from weft.llm.shingles import mix
from weft.llm.terms import word_hashes, words

#: Words of a window.
SIZE = 10
#: Rarest terms of a window that are looked up, and words by which those of a proximity match may be off.
ANCHORS, SLACK = 3, 5
#: Windows that go to the index at once.
BLOCK = 1 << 18
#: Values that a sieve is made for at least and at most; beyond, it lets more through, and joins decide.
SIEVE = (1 << 16, 1 << 23)
#: Pairs of a posting and a window that a task looks at together.
PAIRS = 1 << 18

_STEP = np.uint64(0x9E3779B97F4A7C15)


def hashed_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of a column, and the rows' offsets among them."""
    hashes, many = [np.zeros(0, dtype=np.uint64)], np.zeros(len(column), dtype=np.int64)
    for w in words(column):
        hashes.append(word_hashes(w))
        many[w.first : w.last + 1] += np.bincount(w.rows - w.first, minlength=w.last - w.first + 1)
    return np.concatenate(hashes), np.concatenate([[0], np.cumsum(many)])


def run_hash(hashes: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """A hash of the ``length`` words from each of ``starts`` on."""
    out = hashes[starts].copy()
    for k in range(1, length):
        out = mix(out) * _STEP + hashes[starts + k]
    return mix(out + np.uint64(length)).view(np.int64)


def sieve(values: DataFrame, scratch: Scratch) -> np.ndarray:
    """Marks by the low bits of the whole numbers of a one-column table; its size doesn't grow beyond a bound."""
    values = scratch.put(values.distinct())
    size, most = SIEVE
    wanted = values.count() * 64
    while size < min(wanted, most):
        size *= 2
    marks = np.zeros(size, dtype=bool)
    low = values.select(F.col(values.columns[0]).bitwiseAND(size - 1).alias("v")).distinct().toArrow().column("v").to_numpy()
    scratch.drop(values)
    marks[low] = True
    return marks


def _passes(marks: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return marks[(hashes & np.uint64(len(marks) - 1)).astype(np.intp)]


def windows_of(items: DataFrame, size: int = SIZE) -> DataFrame:
    """``item_id, window, terms``: each run of ``size`` words of ``items(item_id, text)``, or all words of an item that has fewer.

    ``window`` is a hash of the run, ``terms`` those of its words.
    """
    bounded_batches(items.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, offsets = hashed_rows(batch.column(1))
            ids = batch.column(0)
            for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                length = min(size, b - a)
                for at in range(a, b - length + 1 if length else a, 10_000):
                    starts = np.arange(at, min(at + 10_000, b - length + 1))
                    terms = hashes[starts[:, None] + np.arange(length)].view(np.int64)
                    held = pa.ListArray.from_arrays(pa.array(np.arange(len(starts) + 1, dtype=np.int32) * length), pa.array(terms.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.repeat(ids[row], len(starts)), pa.array(run_hash(hashes, starts, length)), held], names=["item_id", "window", "terms"])

    return items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").mapInArrow(cut, "item_id string, window long, terms array<long>")


def term_counts(texts: DataFrame, terms: DataFrame, scratch: Scratch) -> DataFrame:
    """``term, n``: how often ``texts(text)`` hold each of ``terms(term)``; those that they don't are left out."""
    held = texts.sparkSession.sparkContext.broadcast(sieve(terms.select("term"), scratch))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, int] = {}
        for batch in batches:
            for w in words(batch.column(0)):
                h = word_hashes(w)
                for term, n in zip(*(x.tolist() for x in np.unique(h[_passes(held.value, h)].view(np.int64), return_counts=True)), strict=True):
                    sums[term] = sums.get(term, 0) + n
                if len(sums) > 1 << 16:
                    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(list(sums.values()), pa.int64())], names=["term", "n"])
                    sums = {}
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(list(sums.values()), pa.int64())], names=["term", "n"])

    return texts.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).join(terms.select("term").distinct(), "term", "left_semi")


def anchored(windows: DataFrame, texts: DataFrame, scratch: Scratch, anchors: int = ANCHORS) -> DataFrame:
    """``window, length, anchors`` of those ``windows(window, terms)`` of which all terms occur in ``texts(text)``.

    ``anchors`` are ``n, at, term`` of the window's rarest terms, the rarest
    first; of terms that are as rare the earlier one.
    """
    each = scratch.put(windows.select("window", F.size("terms").alias("length"), F.posexplode("terms").alias("at", "term")))
    counted = each.join(term_counts(texts, each.select("term").distinct(), scratch), "term")
    listed = counted.groupBy("window", "length").agg(F.array_sort(F.collect_list(F.struct("n", "at", "term"))).alias("all"))
    return listed.filter("size(all) = length").select("window", "length", F.slice("all", 1, anchors).alias("anchors"))


def prints(text: Column) -> tuple[Column, Column]:
    """Two hashes of a text, ``k1`` and ``k2``; a null text is an empty one."""
    whole = F.coalesce(text, F.lit(""))
    return F.xxhash64(whole).alias("k1"), F.xxhash64(F.lit(1), whole).alias("k2")


def positional_index(docs: DataFrame, terms: DataFrame, scratch: Scratch) -> DataFrame:
    """``doc_id, k1, k2, n_words, terms, places``: for each of ``docs(doc_id, text)`` the occurrences of ``terms(term)`` in the order of its words."""
    held = docs.sparkSession.sparkContext.broadcast(sieve(terms.select("term"), scratch))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, offsets = hashed_rows(batch.column(3))
            at = np.flatnonzero(_passes(held.value, hashes))
            edges = np.searchsorted(at, offsets)
            place = at - np.repeat(offsets[:-1], np.diff(edges))
            lists = [pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(x)) for x in (hashes[at].view(np.int64), place.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(offsets)), *lists], names=["doc_id", "k1", "k2", "n_words", "terms", "places"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *prints(F.col("text")), "text").mapInArrow(look, "doc_id long, k1 long, k2 long, n_words long, terms array<long>, places array<int>")


@dataclass
class Block:
    """Windows by their rarest term; ``terms`` and ``offsets`` have a column for each anchor, offset -1 where a window has fewer."""

    window: np.ndarray
    length: np.ndarray
    terms: np.ndarray
    offsets: np.ndarray


def _block(rows: pa.Table, anchors: int) -> Block:
    n = rows.num_rows
    terms, offsets = np.zeros((n, anchors), dtype=np.int64), np.full((n, anchors), -1, dtype=np.int64)
    lists = rows.column("anchors").combine_chunks()
    many = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten()
    row, place = np.repeat(np.arange(n), many), np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    terms[row, place], offsets[row, place] = flat.field("term").to_numpy(), flat.field("at").to_numpy()
    order = np.lexsort((rows.column("window").to_numpy(), terms[:, 0])) if n else np.zeros(0, dtype=np.intp)
    return Block(rows.column("window").to_numpy()[order], rows.column("length").to_numpy()[order].astype(np.int64), terms[order], offsets[order])


def intersect(block: Block, terms: np.ndarray, places: np.ndarray, rows: np.ndarray, n_words: np.ndarray, slack: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``row, window, start, exact`` of the windows of a block that postings sorted by row and place may hold; ``exact`` where no anchor is off.

    Places of all rows are put on one line, with gaps wider than any window and
    slack, so that a list's neighbours of a place are found by binary search.
    """
    gap = int(block.length.max(initial=0)) + 2 * slack + 1
    base = np.cumsum(n_words + gap) - n_words
    line = base[rows] + places
    known, number = np.unique(terms, return_inverse=True)
    span = int(base[-1] + n_words[-1]) + gap if len(base) else 1
    lists = np.sort(number * span + line)
    first, last = np.searchsorted(block.terms[:, 0], terms, side="left"), np.searchsorted(block.terms[:, 0], terms, side="right")
    many = np.cumsum(last - first)
    at = 0
    while at < len(terms):
        # as many postings as have a bounded number of windows, one at least
        end = max(at + 1, int(np.searchsorted(many, (many[at - 1] if at else 0) + PAIRS, side="right")))
        n = (last - first)[at:end]
        post = np.repeat(np.arange(at, end), n)
        w = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + first[post]
        start, exact = line[post] - block.offsets[w, 0], np.ones(len(w), dtype=bool)
        for a in range(1, block.terms.shape[1]):
            asked = block.offsets[w, a] >= 0
            k = np.minimum(np.searchsorted(known, block.terms[w, a]), len(known) - 1)
            wanted = k * span + start + block.offsets[w, a]
            j = np.searchsorted(lists, wanted)
            off = np.minimum(np.abs(lists[np.minimum(j, len(lists) - 1)] - wanted), np.abs(lists[np.maximum(j - 1, 0)] - wanted))
            off[known[k] != block.terms[w, a]] = slack + 1
            off[~asked] = 0
            near = off <= slack
            post, w, start, exact = post[near], w[near], start[near], (exact & (off == 0))[near]
        row = rows[post]
        start = start - base[row]
        yield row, w, start, exact & (start >= 0) & (start + block.length[w] <= n_words[row])
        at = end


def matches(index: DataFrame, windows: DataFrame, scratch: Scratch, slack: int = SLACK, block: int = BLOCK, anchors: int = ANCHORS) -> DataFrame:
    """``k1, k2, starts, lengths, windows, near`` for each text and block of windows that match; lists, the first three of possible phrases.

    ``near`` are the windows of which all anchors stand within the slack.
    Windows come to the index in blocks, of which each is one pass over the
    stored postings.
    """
    spark = index.sparkSession
    bounded_batches(spark)
    blocks = max(1, -(-windows.count() // block))
    out = None
    for number in range(blocks):
        rows = windows.filter(F.pmod("window", F.lit(blocks)) == number).select("window", "length", "anchors").toArrow()
        held = spark.sparkContext.broadcast(_block(rows, anchors))

        def look(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            b = held.value
            for batch in batches:
                lists = batch.column(3)
                edges = lists.offsets.to_numpy().astype(np.int64)
                edges = edges - edges[0]
                rows = np.repeat(np.arange(batch.num_rows), np.diff(edges))
                found = list(intersect(b, lists.flatten().to_numpy(), batch.column(4).flatten().to_numpy().astype(np.int64), rows, batch.column(2).to_numpy(), slack))
                row, w, start, exact = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, dtype=np.int64) for k in range(4))
                exact = exact.astype(bool)
                some, place = np.unique(row, return_inverse=True)
                if not len(some):
                    continue
                order = np.lexsort((start, place))
                order = order[exact[order]]
                ends = np.concatenate([[0], np.cumsum(np.bincount(place[order], minlength=len(some)))]).astype(np.int32)
                phrases = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x[order])) for x in (start.astype(np.int32), b.length[w].astype(np.int32), b.window[w])]
                pairs = np.unique(np.stack([place, w]), axis=1)
                ends = np.concatenate([[0], np.cumsum(np.bincount(pairs[0], minlength=len(some)))]).astype(np.int32)
                near = pa.ListArray.from_arrays(pa.array(ends), pa.array(b.window[pairs[1]]))
                keys = [batch.column(k).take(pa.array(some)) for k in range(2)]
                yield pa.RecordBatch.from_arrays([*keys, *phrases, near], names=["k1", "k2", "starts", "lengths", "windows", "near"])

        found = index.filter("size(terms) > 0").select("k1", "k2", "n_words", "terms", "places").mapInArrow(look, "k1 long, k2 long, starts array<int>, lengths array<int>, windows array<long>, near array<long>")
        found = found.withColumn("block", F.lit(number))
        out = found if out is None else out.unionAll(found)
    return out.dropDuplicates(["k1", "k2", "block"]).drop("block")


def _texts(docs: DataFrame, keys: DataFrame, scratch: Scratch) -> DataFrame:
    """``k1, k2, text`` of the texts that ``keys(k1, k2)`` name and few others, each once; only these are shuffled."""
    held = docs.sparkSession.sparkContext.broadcast(sieve(keys.select("k1"), scratch))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = _passes(held.value, batch.column(0).to_numpy().view(np.uint64))
            if some.any():
                yield batch.filter(pa.array(some))

    schema = "k1 long, k2 long, text string"
    return docs.select(*prints(F.col("text")), "text").filter("text IS NOT NULL").mapInArrow(keep, schema).dropDuplicates(["k1", "k2"])


def verified(docs: DataFrame, candidates: DataFrame, scratch: Scratch) -> DataFrame:
    """``k1, k2, n_hit, windows``: words of a text that are inside phrases, and these phrases' windows; others of ``candidates`` are dropped."""
    keyed = candidates.filter("size(starts) > 0").groupBy("k1", "k2").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "lengths", "windows")))
    keyed = scratch.put(keyed)
    asked = _texts(docs, keyed, scratch).join(keyed, ["k1", "k2"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, offsets = hashed_rows(batch.column(2))
            edges = batch.column(3).offsets.to_numpy().astype(np.int64)
            rows = np.repeat(np.arange(batch.num_rows), np.diff(edges))
            start, length, window = (batch.column(k).flatten().to_numpy() for k in (3, 4, 5))
            start, good = start.astype(np.int64) + offsets[rows], np.zeros(len(rows), dtype=bool)
            for n in np.unique(length).tolist():
                at = np.flatnonzero((length == n) & (start >= offsets[rows]) & (start + n <= offsets[rows + 1]))
                good[at] = run_hash(hashes, start[at], n) == window[at]
            rows, start, length, window = rows[good], start[good], length[good], window[good]
            inside = np.zeros(len(hashes) + 1, dtype=np.int64)
            np.add.at(inside, start, 1)
            np.add.at(inside, start + length, -1)
            hit = np.concatenate([[0], np.cumsum(np.cumsum(inside[:-1]) > 0)])
            pairs = np.unique(np.stack([rows, window]), axis=1)
            ends = np.concatenate([[0], np.cumsum(np.bincount(pairs[0], minlength=batch.num_rows))]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(pairs[1]))
            out = pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(hit[offsets[1:]] - hit[offsets[:-1]]), listed], names=["k1", "k2", "n_hit", "windows"])
            yield out.filter(pa.array(np.diff(ends) > 0))

    return asked.select("k1", "k2", "text", "starts", "lengths", "windows").mapInArrow(check, "k1 long, k2 long, n_hit long, windows array<long>")


def decontaminate(docs: DataFrame, items: DataFrame, size: int = SIZE, slack: int = SLACK, block: int = BLOCK, anchors: int = ANCHORS) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, item_ids, n_near, contaminated`` for each row of ``docs(doc_id, text)``.

    ``items(item_id, text)`` are the test items; a window is ``size`` of their
    words, or all words of an item that has fewer. ``n_hit`` counts words inside
    any occurrence of a window, ``item_ids`` lists, sorted as strings, the items
    with windows that occur. ``n_near`` counts items with a window whose
    ``anchors`` rarest terms all stand within ``slack`` words of where the
    rarest of them puts them, phrases among them; windows with a term that no
    document has aren't looked for. Items that share an item_id are one; a null
    item_id is an empty string. Null and empty texts have no words. Repeated
    doc_ids have a row each. Texts of any length are whole. An empty table of
    documents gives an empty result, one of items no hits. Other columns aren't
    read.
    """
    scratch = Scratch(docs.sparkSession)
    bounded_batches(docs.sparkSession)
    cut = scratch.put(windows_of(items, size))
    owners = scratch.put(cut.select("window", "item_id").distinct())
    distinct = cut.dropDuplicates(["window"]).select("window", "terms")
    windows = scratch.put(anchored(distinct, docs.select("text"), scratch, anchors))
    terms = windows.select(F.explode("anchors.term").alias("term")).distinct()
    index = scratch.put(positional_index(docs, terms, scratch))
    found = scratch.put(matches(index, windows, scratch, slack, block, anchors))
    hits = scratch.put(verified(docs, found, scratch))

    of_items = hits.select("k1", "k2", F.explode("windows").alias("window")).join(owners, "window").groupBy("k1", "k2").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    near = found.select("k1", "k2", F.explode("near").alias("window")).join(owners, "window").groupBy("k1", "k2").agg(F.countDistinct("item_id").alias("n_near"))
    told = scratch.put(near.join(hits.select("k1", "k2", "n_hit"), ["k1", "k2"], "left").join(of_items, ["k1", "k2"], "left"))
    scratch.drop(cut, found)
    zero, none = F.lit(0).cast("long"), F.array().cast("array<string>")
    listed = F.coalesce("item_ids", none)
    out = index.select("doc_id", "k1", "k2", "n_words").join(told, ["k1", "k2"], "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.size(listed).cast("long").alias("n_items"), listed.alias("item_ids"), F.coalesce("n_near", zero).alias("n_near"), (F.coalesce("n_hit", zero) > 0).alias("contaminated"))
