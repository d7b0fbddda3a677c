"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact length. Each source's budget is
whole passes over the source and a rest; the rest is a share of every length,
topped up by a bounded-knapsack search over what remains, which as a rule hits
it to the word. Then as many documents of each length as the counts ask for are
selected by a seeded hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.llm.common import Scratch, running

WORD = r"[^\x20\x09-\x0D]+"
#: Weights that sources have in turn, in code point order, null last.
WEIGHTS = (5, 2, 1)
#: A target stops at so many times its source's size.
MOST = 3
#: Words of a budget that are left to the exact search, besides one longest document.
SEARCHED = 1 << 14
#: Documents of one source and length are ranked in so many parts at least, and in one more for so many rows.
BUCKETS, PART_ROWS = 64, 1 << 18


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of ``counts`` to take of each length, so that their sum comes as near to the budget from below as the search can.

    A share of each length, rounded down, is taken first; then long ones, down
    to a remainder of bounded size; the remainder is fitted by dynamic
    programming over sets of reachable sums, held as bits of one integer.
    """
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    taken = np.array([int(c) * budget // total for c in counts], dtype=np.int64)
    rest = budget - int((lengths * taken).sum())
    order = np.argsort(-lengths, kind="stable")
    for i in order:
        if lengths[i] and rest - SEARCHED >= lengths[i]:
            n = min(int(counts[i] - taken[i]), (rest - SEARCHED) // int(lengths[i]))
            taken[i] += n
            rest -= n * int(lengths[i])
    sums, mask, steps = 1, (1 << (rest + 1)) - 1, []
    for i in order[::-1]:
        size = int(lengths[i])
        free = min(int(counts[i] - taken[i]), rest // size) if size else 0
        part = 1
        while free > 0 and not sums >> rest & 1:
            n = min(part, free)
            steps.append((i, n, sums))
            sums = (sums | sums << (n * size)) & mask
            free -= n
            part *= 2
    at = sums.bit_length() - 1
    for i, n, before in reversed(steps):
        if not before >> at & 1:
            taken[i] += n
            at -= n * int(lengths[i])
    return taken


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``source, source_size`` with the ``target`` of each source.

    Shares by weight of the sum of all sizes; a target stops at ``most`` times
    its source's size and the excess is shared again by weight until none is
    above. Sorted by the level at which they stop, that is one pass: sources
    stop as long as their level isn't above what the others would get. Both
    orders are made over all tasks; sources may be many.
    """
    scratch = Scratch(sizes.sparkSession)
    turned = running(sizes.select("source", "source_size"), [F.col("source").asc_nulls_last()], scratch)
    weighted = turned.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long").alias("weight"), (F.col("source_size") * most).alias("most"))
    levelled = running(weighted, [F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()], scratch, most_before=F.col("most"), weight_before=F.col("weight"))
    levelled = scratch.put(levelled)
    total, weight = levelled.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    level = (F.lit(total) - F.col("most_before")) / (F.lit(weight) - F.col("weight_before"))
    stops = F.col("most") / F.col("weight") <= level
    common = levelled.filter(~stops).agg(F.min_by(level, "place")).first()[0]
    return levelled.select("source", "source_size", F.when(stops, F.col("most")).otherwise(F.lit(common) * F.col("weight")).cast("double").alias("target"))


def _quota(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one source's counts by length: passes over all, and how many more of each length."""
    size, budget = int(pdf["source_size"].iloc[0]), int(round(pdf["target"].iloc[0]))
    passes, rest = divmod(budget, size) if size else (0, 0)
    more = knapsack(pdf["size"].to_numpy(), pdf["n"].to_numpy(), rest) if size else np.zeros(len(pdf), dtype=np.int64)
    return pd.DataFrame({"skey": pdf["skey"], "size": pdf["size"], "source_size": pdf["source_size"], "target": pdf["target"], "passes": passes, "quota": more})


def _skey() -> Column:
    """A key for a source that is never null, so that joins and windows deal rows out alike."""
    return F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), "source"))


def _keyed(docs: DataFrame, seed: int, *carried: Column) -> DataFrame:
    """``doc_id, source, skey, size, order`` of each row, and ``carried``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size, order = F.regexp_count(text, F.lit(WORD)).cast("long"), F.xxhash64(F.lit(seed), F.col("doc_id"), text)
    return docs.select("doc_id", "source", _skey().alias("skey"), size.alias("size"), order.alias("order"), *carried)


def _shares(slim: DataFrame, weights: tuple[int, ...], most: int, scratch: Scratch) -> tuple[DataFrame, int]:
    """``skey, size, bucket, source_size, target, passes, more``: of the rows of one source, length and bucket, how many are taken once more than all are; and the number of buckets."""
    parts = BUCKETS + slim.count() // PART_ROWS
    counts = scratch.put(slim.groupBy("source", "skey", "size", F.pmod("order", F.lit(parts)).alias("bucket")).agg(F.count("*").alias("n")))
    lengths = counts.groupBy("source", "skey", "size").agg(F.sum("n").alias("n"))
    targets = source_targets(counts.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, most)
    targets = targets.withColumn("skey", _skey()).drop("source")
    plan = lengths.drop("source").join(targets, "skey").groupBy("skey").applyInPandas(_quota, "skey string, size long, source_size long, target double, passes long, quota long")
    line = W.partitionBy("skey", "size").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    share = counts.drop("source").withColumn("before", F.coalesce(F.sum("n").over(line), F.lit(0))).join(plan, ["skey", "size"])
    more = F.greatest(F.lit(0), F.least("n", F.col("quota") - F.col("before"))).alias("more")
    return share.select("skey", "size", "bucket", "source_size", "target", "passes", more), parts


def _times(rows: DataFrame, share: DataFrame, parts: int) -> DataFrame:
    """``rows`` with ``source_size``, ``target`` and ``times``, how often each is taken."""
    place = F.row_number().over(W.partitionBy("skey", "size", "bucket").orderBy("order", "doc_id"))
    chosen = rows.withColumn("bucket", F.pmod("order", F.lit(parts))).join(share, ["skey", "size", "bucket"]).withColumn("place", place)
    times = F.when(F.col("size") > 0, F.col("passes") + F.when(F.col("place") <= F.col("more"), 1).otherwise(0)).otherwise(0)
    return chosen.withColumn("times", times.cast("long"))


def mix_sources(docs: DataFrame, seed: int = 0, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` for each row of ``docs(doc_id, text, source)``.

    ``size`` is the number of words, 0 for a null text; ``taken`` counts words
    that the mix takes, a document at most ``most`` times. A null source is a
    source. Documents without words take nothing. Repeated rows count each, and
    so do rows without doc_id. Which documents are taken depends on seed, doc_id
    and text alone. An empty table gives an empty result. Other columns aren't
    read.
    """
    scratch = Scratch(docs.sparkSession)
    slim = scratch.put(_keyed(docs, seed))
    share, parts = _shares(slim, weights, most, scratch)
    return _times(slim, share, parts).select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def mixed_rows(docs: DataFrame, seed: int = 0, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The rows of the mix itself, with all columns of ``docs``, each as often as ``mix_sources`` takes it.

    Rows go through the selection as they are, so that the words written are
    those taken, whatever ids repeat or are null.
    """
    scratch = Scratch(docs.sparkSession)
    share, parts = _shares(scratch.put(_keyed(docs, seed)), weights, most, scratch)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    taken = _times(_keyed(docs, seed, row), scratch.put(share), parts).filter("times > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")).select("row.*")
