"""Which columns and pairs can't be part of any product over the threshold.

Residuals r of now are split into alpha times those of an earlier step, l, at
which the largest sum of the products with a column (or with a pair, of three
columns) was taken, and a rest d. A product's rows are among the column's, so
its sum is no more than ``alpha * last_max`` and the positive or the negative
part of d over the column's rows. Without an earlier step alpha is 0. With real
values a rest weighs as much as the column's value and the most that the other
columns' values can be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def branch_bound(x: DataFrame, now: DataFrame, before: DataFrame, last_max: DataFrame, reach: float | None = None) -> DataFrame:
    """``col_id, alpha, bound``: no pair with the column has a larger sum of the present residuals.

    ``before`` holds the residuals of the step at which ``last_max`` was taken
    over all partners of a column. Each column has its own best alpha, which
    takes a second pass. ``reach`` is None for a binary matrix, else the most
    that the values of other columns in a product multiply to.
    """
    met = x.select("row_id", "col_id", "val").join(now.select("row_id", F.col("r").alias("r")), "row_id").join(before.select("row_id", F.col("r").alias("l")), "row_id", "left").withColumn("l", F.coalesce("l", F.lit(0.0)))
    scale = met.groupBy("col_id").agg(F.sum(F.col("r") * F.col("l")).alias("rl"), F.sum(F.col("l") * F.col("l")).alias("ll"))
    alpha = scale.select("col_id", F.when(F.col("ll") > 0, F.abs(F.col("rl") / F.col("ll"))).otherwise(0.0).alias("alpha"))
    rest = met.join(alpha, "col_id").withColumn("d", F.col("r") - F.col("alpha") * F.col("l")).groupBy("col_id", "alpha").agg(_rest(F.col("d"), F.col("val"), reach).alias("rest"))
    known = rest.join(last_max.select(F.col("i").alias("col_id"), "last_max"), "col_id", "left")
    return known.select("col_id", "alpha", (F.col("alpha") * F.coalesce("last_max", F.lit(0.0)) + F.col("rest")).alias("bound"))


def _rest(d: Column, value: Column, reach: float | None) -> Column:
    if reach is None:
        return F.greatest(F.sum(F.greatest(d, F.lit(0.0))), F.abs(F.sum(F.least(d, F.lit(0.0)))))
    return F.lit(float(reach)) * F.sum(F.abs(value * d))


def rests(alphas: list[float], value: str, reach: float | None) -> list[Column]:
    """Aggregates ``rest0, rest1, ...`` over rows with residuals ``r0`` of now and ``r1, ...`` of earlier steps, those scaled by ``alphas``."""
    parts = [F.col("r0"), *(F.col("r0") - F.lit(a) * F.col(f"r{k}") for k, a in enumerate(alphas, 1))]
    return [_rest(d, F.col(value), reach).alias(f"rest{k}") for k, d in enumerate(parts)]


def bounds(sums: DataFrame, known: DataFrame | None, keys: list[str], steps: list[int], alphas: list[float]) -> DataFrame:
    """``sums`` with ``bound`` in place of its rests, and ``step``, null for a key that isn't known.

    ``known(keys, step, last_max)`` says at which step a key was last looked
    at. A key that wasn't, or at a step that is none of ``steps``, has the
    bound of the present residuals alone; the smaller of both counts.
    """
    rest = [c for c in sums.columns if c.startswith("rest")]
    if known is None or not steps:
        return sums.withColumn("bound", F.col("rest0")).withColumn("step", F.lit(None).cast("int")).drop(*rest)
    told = sums.join(known.select(*keys, "step", "last_max"), keys, "left")
    since = F.lit(None).cast("double")
    for k, (step, a) in enumerate(zip(steps, alphas, strict=True), 1):
        since = F.when(F.col("step") == step, F.abs(F.lit(a)) * F.col("last_max") + F.col(f"rest{k}")).otherwise(since)
    return told.withColumn("bound", F.least("rest0", F.coalesce(since, F.col("rest0")))).drop(*rest, "last_max")


def prunable(bounds: DataFrame, limit: float, key: str = "col_id") -> DataFrame:
    """Keys that nothing over the limit has."""
    return bounds.filter(F.col("bound") <= limit).select(key)


def updateable(bounds: DataFrame, limit: float, *keys: str) -> DataFrame:
    """Keys that something over the limit may have."""
    return bounds.filter(F.col("bound") > limit).select(*(keys or ("col_id",)))


def first_seen(live: DataFrame, seen: DataFrame, *keys: str) -> DataFrame:
    """Those of ``live`` that aren't among ``seen``."""
    names = list(keys or ("col_id",))
    return live.join(seen.select(*names), names, "left_anti")


def remembered(known: DataFrame | None, now: DataFrame, *keys: str) -> DataFrame:
    """``keys, step, last_max`` brought up to date: what was looked at now, and what is known of the others."""
    names = list(keys or ("col_id",))
    now = now.select(*names, "step", "last_max")
    return now if known is None else now.unionByName(first_seen(known, now, *names).select(*names, "step", "last_max"))
