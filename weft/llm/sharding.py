"""Shards of near equal size that keep groups whole: a minimax contiguous partition.

Groups of equal texts are the atoms. They are ordered by size, largest first;
groups of one size are a run, so that the whole order is told by one count for
each distinct size. Distinct sizes are few: if they sum to T bytes there are at
most sqrt(2 T) of them, 14 million for 100 TB and some thousands in practice.
Over the runs the smallest feasible capacity is found by binary search, each
candidate checked greedily, and the order is cut where the greedy check cuts.
Everything over rows is DataFrame expressions, aggregations, joins and windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.llm.common import Scratch

#: Parts in which ranks and slots are counted before they are put together.
BUCKETS = 512


def greedy_cuts(runs: list[tuple[int, int]], capacity: int) -> list[tuple[int, int]]:
    """Where shards begin, as (size, rank within its run), if each is filled up to the capacity."""
    cuts, room = [], 0
    for size, count in runs:
        done = min(count, room // size)
        room -= done * size
        each = capacity // size
        while done < count:
            cuts.append((size, done))
            take = min(each, count - done)
            done += take
            room = capacity - take * size
    return cuts


def _shards_needed(runs: list[tuple[int, int]], capacity: int, most: int) -> int:
    """Shards of this capacity that the greedy check fills, or ``most + 1`` where it breaks off."""
    shards = room = 0
    for size, count in runs:
        count -= (fit := min(count, room // size))
        room -= fit * size
        if count:
            each = capacity // size
            more = -(-count // each)
            shards += more
            if shards > most:
                return most + 1
            room = capacity - (count - (more - 1) * each) * size
    return shards


def minimax_cuts(runs: list[tuple[int, int]], shards: int) -> list[tuple[int, int]]:
    """Cuts of least capacity for ``runs`` of (size, count), sizes descending and positive.

    A group as large as an even share of what is left has a shard to itself;
    that changes no minimax value and leaves the rest as even as can be.
    """
    runs, total, cuts = [list(r) for r in runs], sum(s * c for s, c in runs), []
    taken: dict[int, int] = {}
    while runs and shards > 1 and runs[0][0] * shards >= total:
        size = runs[0][0]
        cuts.append((size, taken.get(size, 0)))
        taken[size] = taken.get(size, 0) + 1
        runs[0][1] -= 1
        total -= size
        shards -= 1
        if not runs[0][1]:
            runs.pop(0)
    if not runs:
        return cuts
    rest = [(s, c) for s, c in runs]
    low = max(-(-total // shards), rest[0][0])
    high = low + rest[0][0]
    while low < high:
        middle = (low + high) // 2
        if _shards_needed(rest, middle, shards) <= shards:
            high = middle
        else:
            low = middle + 1
    return cuts + [(s, r + taken.get(s, 0)) for s, r in greedy_cuts(rest, low)]


def _shard_of(cuts: list[tuple[int, int]], size: Column, rank: Column) -> Column:
    """Cuts at or before a place, less one."""
    shard = F.lit(0)
    for s, r in cuts[1:]:
        shard = shard + F.when((size < s) | ((size == s) & (rank >= r)), 1).otherwise(0)
    return shard.cast("int")


def shard_by_bytes(docs: DataFrame, shards: int = 40, overhead: int = 16) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``, one row for each row of ``docs(doc_id, text)``.

    The size of a document is the UTF-8 bytes of its text and ``overhead``; a
    null text has no bytes. Equal texts share a shard, a null one with the
    empty ones. Slots of a shard count from 0 without gaps, in an order that is
    a hash of the row, so that copies and lengths are spread within a shard.
    Repeated rows each have a slot. With fewer groups than shards the last
    shards stay empty; an empty table gives an empty result. Columns
    besides doc_id and text aren't read; a null doc_id stays null.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = scratch.put(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h")))
    key = ["h", "text_crc32", "size"]
    groups = scratch.put(slim.groupBy(*key).agg((F.count("*") * F.col("size")).alias("group_size")))
    runs = sorted(((r[0], r[1]) for r in groups.groupBy("group_size").count().collect()), reverse=True)
    cuts = minimax_cuts(runs, shards)

    # a rank within its run matters only where a cut falls into the run
    split = sorted({s for s, r in cuts if r})
    inside = F.col("group_size").isin(split) if split else F.lit(False)
    parts = groups.filter(inside).withColumn("bucket", F.pmod("h", F.lit(BUCKETS)))
    sizes = parts.groupBy("group_size", "bucket").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(W.partitionBy("group_size").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))).select("group_size", "bucket", F.coalesce("before", F.lit(0)).alias("before"))
    ranked = parts.join(before, ["group_size", "bucket"]).withColumn("rank", F.col("before") + F.row_number().over(W.partitionBy("group_size", "bucket").orderBy(*key)) - 1)
    shard = _shard_of(cuts, F.col("group_size"), F.col("rank"))
    whole = groups.filter(~inside).withColumn("rank", F.lit(0))
    shard_of_group = ranked.select(*key, shard.alias("shard")).unionAll(whole.select(*key, shard.alias("shard")))

    placed = scratch.put(slim.join(shard_of_group, key).withColumn("order", F.xxhash64("doc_id", "h")).withColumn("bucket", F.pmod("order", F.lit(BUCKETS))))
    held = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    first = held.withColumn("first", F.sum("n").over(W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))).select("shard", "bucket", F.coalesce("first", F.lit(0)).alias("first"))
    slot = F.col("first") + F.row_number().over(W.partitionBy("shard", "bucket").orderBy("order", "doc_id", "h")) - 1
    return placed.join(first, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
