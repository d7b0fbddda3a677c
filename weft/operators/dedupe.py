"""Effects that can't be told apart: equal columns and products of columns.

A print of an effect is the number of its rows and two sums over hashes of
them. Prints are combined before the shuffle and need no sorted list of rows.
Effects without rows are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType

from weft.functions.ids import pair_id, triple_id
from weft.operators.screen import GRID, TASKS, packed, products
from weft.sources.scratch import Scratch


def _print() -> list[Column]:
    return [F.count("*").alias("nz"), F.sum(F.pmod(F.xxhash64("row_id"), F.lit(1 << 40))).alias("one"), F.bit_xor(F.xxhash64("row_id", F.lit(1))).alias("two")]


def marks(z: DataFrame) -> DataFrame:
    """``id, nz, one, two`` of each effect of ``z(id, row_id)``."""
    return z.groupBy("id").agg(*_print())


#: Rows that a word of bits tells of.
WORD = 64


def words(x: DataFrame) -> DataFrame:
    """``row_id, cells`` of blocks of 64 row numbers: columns in ascending order, each with a bit for each of the block's rows that has it."""
    bit = F.expr(f"shiftleft(1L, cast(pmod(row_id, {WORD}) AS int))")
    each = x.groupBy(F.floor(F.col("row_id") / WORD).alias("row_id"), "col_id").agg(F.bit_or(bit).alias("bits"))
    return each.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("col_id", "bits"))).alias("cells"))


def _word_products(rows: DataFrame, order: int) -> DataFrame:
    """``row_id, i, j[, k], bits`` of the columns that share a row of a block."""
    names = ["i", "j", "k"][:order]
    tasks = max(TASKS, rows.sparkSession.sparkContext.defaultParallelism)
    # dealt out by block and first column, as the blocks are small for the products that come of them
    out = rows.select("row_id", "cells", F.posexplode("cells").alias("q", "c")).select("row_id", F.expr("slice(cells, q + 2, size(cells))").alias("cells"), F.col("c.col_id").alias("i"), F.col("c.bits").alias("bits")).repartition(tasks, "row_id", "i")
    for k in range(1, order):
        out = out.select("row_id", "cells", *names[:k], "bits", F.posexplode("cells").alias("q", "c"))
        out = out.select("row_id", F.expr("slice(cells, q + 2, size(cells))").alias("cells"), *names[:k], F.col("c.col_id").alias(names[k]), F.col("bits").bitwiseAND(F.col("c.bits")).alias("bits")).filter("bits <> 0")
    return out.select("row_id", *names, "bits")


def _word_print() -> list[Column]:
    one, two = F.xxhash64("row_id", "bits"), F.xxhash64("row_id", "bits", F.lit(1))
    return [F.sum(F.bit_count("bits")).cast("long").alias("nz"), F.sum(F.pmod(one, F.lit(1 << 40))).alias("one"), F.bit_xor(two).alias("two")]


def _dense(x: DataFrame, depth: int) -> bool:
    """Whether products of whole blocks of rows are fewer than those of their rows, so that words of bits are worth it."""
    if depth < 2 or not isinstance(x.schema["row_id"].dataType, LongType | IntegerType):
        return False
    made = lambda n: n * (n - 1) / 2 * (1 if depth == 2 else (n + 1) / 3)
    block = F.floor(F.col("row_id") / WORD)
    rows = x.groupBy("row_id").agg(F.count("*").alias("n")).agg(F.sum(made(F.col("n"))).alias("s")).first()["s"] or 0
    blocks = x.select(block.alias("b"), "col_id").distinct().groupBy("b").agg(F.count("*").alias("n")).agg(F.sum(made(F.col("n"))).alias("s")).first()["s"] or 0
    return blocks * 2 < rows


def prints(x: DataFrame, p: int, depth: int = 1, grid: tuple[int, int] | None = None) -> DataFrame:
    """``ord, id, i, j, k, nz, one, two`` of all effects up to ``depth`` that have rows; ``grid`` for long rows.

    Where most rows of a block of row numbers have the same columns, a block's
    products are made at once, by words of bits, and ``one`` and ``two`` are
    sums over hashes of these words.
    """
    none = F.lit(None).cast("int")
    if _dense(x, depth):
        rows, out = words(x), None
        for order, number in ((1, None), (2, pair_id), (3, triple_id))[:depth]:
            names = ["i", "j", "k"][:order]
            made = _word_products(rows, order).groupBy(*names).agg(*_word_print())
            i, j, k = *(F.col(n) for n in names), *[none] * (3 - order)
            one = made.select(F.lit(order).alias("ord"), (number(*(F.col(n) for n in names), p) if number else i.cast("long")).alias("id"), i.alias("i"), j.alias("j"), k.alias("k"), "nz", "one", "two")
            out = one if out is None else out.unionAll(one)
        return out
    out = x.groupBy(F.col("col_id").alias("i")).agg(*_print()).select(F.lit(1).alias("ord"), F.col("i").cast("long").alias("id"), "i", none.alias("j"), none.alias("k"), "nz", "one", "two")
    rows = packed(x, True)
    if depth > 1:
        out = out.unionAll(products(rows, 2, None, True, ["row_id"], grid).groupBy("i", "j").agg(*_print()).select(F.lit(2), pair_id(F.col("i"), F.col("j"), p), "i", "j", none, "nz", "one", "two"))
    if depth > 2:
        out = out.unionAll(products(rows, 3, None, True, ["row_id"], grid).groupBy("i", "j", "k").agg(*_print()).select(F.lit(3), triple_id(F.col("i"), F.col("j"), F.col("k"), p), "i", "j", "k", "nz", "one", "two"))
    return out


def covering(x: DataFrame, z: DataFrame) -> DataFrame:
    """``kept, n, col_id`` for each effect of ``z(id, row_id)``, of ``n`` rows: the columns that all of its rows have."""
    size = z.groupBy("id").agg(F.count("*").alias("n"))
    met = z.select("id", "row_id").join(x.select("row_id", "col_id"), "row_id").groupBy("id", "col_id").agg(F.count("*").alias("times"))
    return met.join(size, "id").filter("times = n").select(F.col("id").alias("kept"), "n", "col_id")


def contained(x: DataFrame, z: DataFrame, p: int, depth: int, distance: int | None, scratch: Scratch) -> tuple[DataFrame, int]:
    """``kept, ord, id`` of all effects up to ``depth`` that have the same rows as an effect of ``z(id, row_id)``, itself among them; and how many were looked at.

    The columns of such an effect are in all rows of the kept one, so that only
    columns that cover it are combined. A combination has these rows; it is the
    same effect unless another row has all its columns too. Rows outside are
    only those of covering columns that aren't equal to the effect themselves.
    """
    cover = covering(x, z)
    sizes = x.groupBy("col_id").agg(F.count("*").alias("nz"))
    mains = scratch.put(cover.join(sizes, "col_id").select("kept", F.col("col_id").alias("i"), (F.col("n") == F.col("nz")).alias("same")))
    out = mains.select("kept", F.lit(1).alias("ord"), F.col("i").cast("long").alias("id"), "same")
    if depth > 1:
        # rows outside a kept effect, with those of its covering columns that aren't equal to it
        loose = mains.filter("NOT same").select("kept", F.col("i").alias("col_id"))
        outside = x.select("row_id", "col_id").join(loose, "col_id").join(z.select(F.col("id").alias("kept"), "row_id"), ["kept", "row_id"], "left_anti")
        rows = outside.groupBy("kept", "row_id").agg(F.sort_array(F.collect_list("col_id")).alias("cells"))
        covers = mains.groupBy("kept").agg(F.sort_array(F.collect_list("i")).alias("cells"))
        grid = GRID if (mains.groupBy("kept").count().agg(F.max("count")).first()[0] or 0) > GRID[0] else None
        met = F.lit(True).alias("met")
        for order, names in ((2, ["i", "j"]), (3, ["i", "j", "k"]))[: depth - 1]:
            number = (pair_id if order == 2 else triple_id)(*(F.col(c) for c in names), p)
            spoiled = products(rows, order, distance, True, ["kept"]).select("kept", *names).distinct()
            made = products(covers, order, distance, True, ["kept"], grid).select("kept", *names).join(spoiled.select("kept", *names, met), ["kept", *names], "left")
            out = out.unionAll(made.select("kept", F.lit(order), number, F.col("met").isNull()))
    out = scratch.put(out)
    scratch.drop(mains)
    return out.filter("same").drop("same"), out.count()


def classes_of(members: DataFrame) -> DataFrame:
    """``id, ord, rep, members`` from ``kept, ord, id``, as ``classes`` has them."""
    reps = members.groupBy("kept").agg(F.min(F.struct("ord", "id")).alias("m"), F.count("*").alias("members"))
    return members.join(reps, "kept").select("id", "ord", F.col("m.id").alias("rep"), "members").distinct()


def like(marked: DataFrame, some: DataFrame) -> DataFrame:
    """Of the prints those that any of ``some(id)`` has."""
    own = ["nz", "one", "two"]
    return marked.join(marked.join(some.select("id"), "id", "left_semi").select(*own).distinct(), own, "left_semi")


def classes(marked: DataFrame) -> DataFrame:
    """``id, ord, rep, members``: each effect's representative, the least by order and number, and the size of its class."""
    reps = marked.groupBy("nz", "one", "two").agg(F.min(F.struct("ord", "id")).alias("m"), F.count("*").alias("members"))
    return marked.join(reps, ["nz", "one", "two"]).select("id", "ord", F.col("m.id").alias("rep"), "members")


def equivalents(classed: DataFrame) -> DataFrame:
    """``rep, equivalent``: all members of each class in ascending order."""
    return classed.groupBy("rep").agg(F.array_sort(F.collect_set("id")).alias("equivalent"))


def fold(beta: DataFrame, classed: DataFrame) -> DataFrame:
    """``id, strength``: strengths of equal effects summed at their representative."""
    return beta.join(classed.select("id", "rep"), "id", "left").groupBy(F.coalesce("rep", "id").alias("id")).agg(F.sum("strength").alias("strength"))
