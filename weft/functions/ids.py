"""Identifiers of effects: mains, pairs and triples of p columns share one number space.

A main i is ``i``; a pair a < b is ``(a + 1) p + b``; a triple a < b < c is
``(a + 1) p^2 + b p + c``. The order is told by comparison with p and p^2.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pair_id(i: Column, j: Column, p: int) -> Column:
    return ((F.least(i, j).cast("long") + 1) * p + F.greatest(i, j)).cast("long")


def triple_id(i: Column, j: Column, k: Column, p: int) -> Column:
    s = F.array_sort(F.array(i.cast("long"), j.cast("long"), k.cast("long")))
    return ((s[0] + 1) * p * p + s[1] * p + s[2]).cast("long")


def flat_index(i: Column, j: Column, p: int) -> Column:
    """The place of i <= j among all such pairs, row by row."""
    i, j = i.cast("long"), j.cast("long")
    return (i * p - F.floor(i * (i - 1) / 2) + j - i).cast("long")


def flat_pair(flat: Column, p: int) -> tuple[Column, Column]:
    """The pair i <= j at a place among all such pairs.

    The root gives i or its neighbour; whole numbers decide.
    """
    flat = flat.cast("long")
    start = lambda i: (i * p - F.floor(i * (i - 1) / 2)).cast("long")
    near = F.floor((2 * p + 1 - F.sqrt(F.lit(float((2 * p + 1) ** 2)) - 8 * flat)) / 2).cast("long")
    i = F.when(start(near) > flat, near - 1).when(start(near + 1) <= flat, near + 1).otherwise(near)
    return i, (flat - start(i) + i).cast("long")


def ordered(effects: DataFrame) -> DataFrame:
    """``effects(i, j, k)`` themselves; columns of one effect that don't ascend are an error."""
    wrong = F.coalesce(F.col("i") >= F.col("j"), F.lit(False)) | F.coalesce(F.col("j") >= F.col("k"), F.lit(False)) | (F.col("j").isNull() & F.col("k").isNotNull()) | F.col("i").isNull()
    told = F.when(wrong, F.raise_error(F.concat(F.lit("columns of an effect don't ascend: "), F.concat_ws(",", "i", "j", "k"))).cast(effects.schema["i"].dataType)).otherwise(F.col("i"))
    return effects.withColumn("i", told)


def order_of(effect: Column, p: int) -> Column:
    return F.when(effect < p, 1).when(effect < p * p, 2).otherwise(3)


def decode(effect: Column, p: int) -> tuple[Column, Column, Column]:
    """``i, j, k``; null where an effect of lower order has none."""
    order = order_of(effect, p)
    e = effect.cast("long")
    whole = lambda a, b: F.floor(a / F.lit(b)).cast("long")
    rest = e % (p * p)
    i = F.when(order == 1, e).when(order == 2, whole(e, p) - 1).otherwise(whole(e, p * p) - 1)
    j = F.when(order == 2, e % p).when(order == 3, whole(rest, p))
    return i, j, F.when(order == 3, rest % p)


def effect_columns(effect: int, p: int) -> tuple[int, ...]:
    """The same for a number on the driver."""
    if effect < p:
        return (effect,)
    if effect < p * p:
        return (effect // p - 1, effect % p)
    return (effect // (p * p) - 1, effect % (p * p) // p, effect % p)


def effect_number(columns: tuple[int, ...], p: int) -> int:
    c = sorted(columns)
    return c[0] if len(c) == 1 else (c[0] + 1) * p + c[1] if len(c) == 2 else (c[0] + 1) * p * p + c[1] * p + c[2]
