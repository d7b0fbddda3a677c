"""Tables of effects, comparison with a known truth, and summaries of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.functions.ids import decode, order_of
from weft.sources.scratch import Scratch


def effect_table(beta: DataFrame, names: DataFrame, p: int) -> DataFrame:
    """``ord, id, effect, i, j, k, strength`` with names for column numbers; ``effect`` joins them by commas."""
    i, j, k = decode(F.col("id"), p)
    out = beta.select("id", "strength", order_of(F.col("id"), p).alias("ord"), i.cast("int").alias("_i"), j.cast("int").alias("_j"), k.cast("int").alias("_k"))
    for c in ("i", "j", "k"):
        out = out.join(names.select(F.col("col_id").alias(f"_{c}"), F.col("name").alias(c)), f"_{c}", "left")
    return out.select("ord", "id", F.concat_ws(",", "i", "j", "k").alias("effect"), "i", "j", "k", "strength")


def with_equivalents(table: DataFrame, equivalent: DataFrame, names: DataFrame, p: int) -> DataFrame:
    """``table(id, ...)`` with ``equivalent``: the effects, by their names, that can't be told from it, itself left out.

    ``equivalent(rep, equivalent)`` lists numbers; an effect without others has an empty list.
    """
    each = equivalent.select(F.col("rep").alias("_rep"), F.explode("equivalent").alias("id")).filter("id <> _rep")
    named = effect_table(each.select("id", F.lit(0.0).alias("strength")).distinct(), names, p).select("id", "ord", "effect")
    told = each.join(named, "id").groupBy("_rep").agg(F.array_sort(F.collect_list(F.struct("ord", "id", "effect"))).alias("_all"))
    return table.join(told, F.col("_rep") == F.col("id"), "left").select(*table.columns, F.coalesce(F.col("_all.effect"), F.array().cast("array<string>")).alias("equivalent"))


def by_order(table: DataFrame) -> dict[str, DataFrame]:
    """An effect table as one table for each order."""
    return {name: table.filter(F.col("ord") == k) for k, name in ((1, "main"), (2, "pairwise"), (3, "triple"))}


def strongest(effects: DataFrame, below: float, n: int = 10) -> DataFrame:
    """The first ``n`` effects with a strength below a value, the lowest first; equal ones by number."""
    return effects.filter(F.col("strength") < below).orderBy("strength", "id").limit(n)


def nonzero(effects: DataFrame) -> DataFrame:
    return effects.filter("strength <> 0")


def evaluate(found: DataFrame, truth: DataFrame, observed: DataFrame, large: float) -> DataFrame:
    """``i, j, strength, coef, o11, hit, big``: found pairs beside the true ones and the counts of their rows."""
    one = found.dropDuplicates(["i", "j"])
    joined = one.join(truth.select("i", "j", "coef"), ["i", "j"], "full_outer").join(observed.select("i", "j", "o11"), ["i", "j"], "left")
    return joined.select("i", "j", "strength", "coef", F.coalesce("o11", F.lit(0)).alias("o11"), (F.col("strength").isNotNull() & F.col("coef").isNotNull()).alias("hit"), F.coalesce(F.abs("coef") >= large, F.lit(False)).alias("big"))


def summary(evaluated: DataFrame) -> DataFrame:
    return evaluated.groupBy("hit", "big").agg(F.count("*").alias("n"))


def quartiles(df: DataFrame, by: str, value: str) -> DataFrame:
    """``by, q25, q50, q75, n``: exact quartiles of each group, between neighbours by straight lines.

    Rows are sorted by range over all tasks; counts of each task's rows give
    every row its rank, and the few rows at the ranks asked for are kept. No
    task holds a group. Nulls are left out.
    """
    dealt = df.select(F.col(by).alias("g"), F.col(value).cast("double").alias("v")).filter("v IS NOT NULL").repartitionByRange("g", "v").sortWithinPartitions("g", "v")
    # written, so that ranks and counts see one and the same dealing out
    placed = Scratch(df.sparkSession).put(dealt.select("g", "v", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    held = placed.groupBy("g", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    all_of = W.partitionBy("g")
    before = F.sum("n").over(all_of.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    held = held.select(F.col("g").alias("group"), F.col("part").alias("of"), (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(all_of).alias("n"))
    ranked = placed.join(F.broadcast(held), F.expr("g <=> group AND part = of")).select("g", "v", "n", (F.col("at") + F.col("shift")).alias("rank"))
    out = []
    for name, q in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)):
        spot = (F.col("n") - 1) * q
        share = spot - F.floor(spot)
        low, high = (F.max(F.when(F.col("rank") == f(spot), F.col("v"))) for f in (F.floor, F.ceil))
        out.append((low + (high - low) * F.max(share)).alias(name))
    return ranked.groupBy("g").agg(*out, F.max("n").alias("n")).withColumnRenamed("g", by)
