"""Importance resampling towards a target distribution, over hashed runs of words.

Runs of one to three words fall into buckets by their CRC-32. Counts of all
documents and of the target give each bucket a gain, the logarithm of their
ratio; a document's weight is the sum over its runs. Seeded Gumbel noise makes
the highest scores a draw without replacement by weight.

Scores are written once. The cutoff is found by bisection: exact counts over
the written scores tell in which half it lies, and among rows that tie there
doc_id is bisected alike. A job counts at all points that the next few halvings
may ask for. Only the rows drawn are then sorted, by range over all tasks, and
ranked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import Scratch, bounded_batches, running
from weft.llm.terms import run_crcs

BUCKETS, RUN = 10_000, 3
#: Halvings of the bisection that one job counts for.
HALVINGS = 4


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, run: int = RUN) -> DataFrame:
    """``bucket, n``: how many runs of one to ``run`` words of ``texts(text)`` fall into each bucket; a null text has none.

    A task sums over its rows first and hands on one array of counts.
    """
    bounded_batches(texts.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, _, crcs in run_crcs(batch.column(0), run):
                sums += np.bincount(crcs % np.uint32(buckets), minlength=buckets)
        held = np.flatnonzero(sums)
        if len(held):
            yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(sums[held])], names=["bucket", "n"])

    return texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, run: int = RUN) -> np.ndarray:
    """Each bucket's gain in thousandths, ``floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets))))`` with counts s of S in ``docs`` and t of T in ``target``."""
    spark = docs.sparkSession
    both = bucket_counts(docs, buckets, run).select("bucket", F.col("n").alias("s"), F.lit(0).alias("t")).unionAll(bucket_counts(target, buckets, run).select("bucket", F.lit(0), "n"))
    # as many rows as there are buckets
    counts = Scratch(spark).put(both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")))
    s_all, t_all = (float(x or 0) for x in counts.agg(F.sum("s"), F.sum("t")).first())
    s, t = F.coalesce("s", F.lit(0)).cast("double"), F.coalesce("t", F.lit(0)).cast("double")
    ratio = ((t + 1) * F.lit(s_all + buckets)) / ((s + 1) * F.lit(t_all + buckets))
    rows = spark.range(buckets).withColumnRenamed("id", "bucket").join(counts, "bucket", "left").select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")).toArrow()
    gains = np.zeros(buckets, dtype=np.int64)
    gains[rows.column("bucket").to_numpy()] = rows.column("gain").to_numpy()
    return gains


def run_weights(docs: DataFrame, gains: np.ndarray, run: int = RUN) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` for each row of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    bounded_batches(spark)
    held = spark.sparkContext.broadcast(gains)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = held.value
        for batch in batches:
            n = batch.num_rows
            words, features, weight = (np.zeros(n, dtype=np.int64) for _ in range(3))
            for k, rows, crcs in run_crcs(batch.column(1), run):
                many = np.bincount(rows, minlength=n)
                features += many
                words += many if k == 1 else 0
                # whole numbers far below 2^53 for one part of a text
                weight += np.bincount(rows, gain[(crcs % np.uint32(len(gain))).astype(np.intp)].astype(np.float64), minlength=n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(features), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int) -> Column:
    """``floor(-1000 ln(-ln(u)))`` of a uniform u from 32 bits of a hash of seed and doc_id; a null doc_id counts as an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def bisect(rows: DataFrame, key: str, k: int, halvings: int = HALVINGS) -> int:
    """The ``k``-th smallest value of the whole-number column ``key``, repeats counted, by counting rows at or below points between its extremes.

    ``k`` is from 1 to the number of rows. One job counts at ``2^halvings - 1``
    points, which are those that so many halvings could ask for.
    """
    low, high = rows.agg(F.min(key), F.max(key)).first()
    while low < high:
        points = sorted({low + (high - low) * i // (1 << halvings) for i in range(1, 1 << halvings)} - {high})
        counts = rows.agg(*(F.count(F.when(F.col(key) <= x, 1)) for x in points)).first()
        enough = [x for x, n in zip(points, counts, strict=True) if n >= k]
        short = [x for x, n in zip(points, counts, strict=True) if n < k]
        low, high = (max(short) + 1 if short else low), (min(enough) if enough else high)
    return low


def first_rows(rows: DataFrame, keys: list[str], k: int) -> Column:
    """A condition that holds for the first ``k`` of ``rows`` in ascending order of whole-number columns, of which the last ones tell rows apart.

    Each key is bisected among the rows that tie in those before it.
    """
    tied, taken = F.lit(True), F.lit(False)
    for at, key in enumerate(keys):
        here = rows.filter(tied) if at else rows
        edge = bisect(here, key, k)
        below, upto = here.agg(F.count(F.when(F.col(key) < edge, 1)), F.count(F.when(F.col(key) <= edge, 1))).first()
        if upto == k:
            return taken | (tied & (F.col(key) <= edge))
        taken, tied, k = taken | (tied & (F.col(key) < edge)), tied & (F.col(key) == edge), k - below
    return taken | tied


def importance_resample(docs: DataFrame, target: DataFrame, share: tuple[int, int] = (5, 100), least_words: int = 20, buckets: int = BUCKETS, run: int = RUN, seed: int = 42) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` for each row of ``docs(doc_id, text)``; ``target(text)`` is what is aimed at.

    Of the N documents with ``least_words`` words or more, the
    ``N * share[0] // share[1]`` of highest score have ranks from 1; others have
    none. Ties go to the smaller doc_id. Repeated doc_ids count each, and tie in
    the order of their weights, then of their rows. A null text has no runs and
    weight 0; a null doc_id comes last among ties. Texts of any length are
    whole. An empty table gives an empty result; an empty target has counts of
    0. Other columns aren't read.
    """
    scratch = Scratch(docs.sparkSession)
    weighed = run_weights(docs, bucket_gains(docs, target, buckets, run), run)
    scores = scratch.put(weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)).withColumn("at", F.monotonically_increasing_id()))
    ours = ["doc_id", "n_words", "n_features", "weight", "score"]
    fits = F.col("n_words") >= least_words
    k = scores.filter(fits).count() * share[0] // share[1]
    if not k:
        return scores.select(*ours, F.lit(None).cast("long").alias("rank"))
    keys = {"_score": -F.col("score"), "_id": F.coalesce("doc_id", F.lit(2**63 - 1)), "_weight": -F.col("weight"), "_at": F.col("at")}
    keyed = scores.withColumns(keys)
    drawn = fits & first_rows(keyed.filter(fits), list(keys), k)
    ranked = running(keyed.filter(drawn), [F.col(c) for c in keys], scratch).select(*ours, (F.col("place") + 1).alias("rank"))
    return ranked.unionAll(keyed.filter(~drawn).select(*ours, F.lit(None).cast("long")))
