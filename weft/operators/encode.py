"""Layouts and statistics of a coordinate table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.functions.scalar import gap_bits
from weft.operators.screen import enumerate_pairs
from weft.sources.scratch import Scratch


def sorted_columns(x: DataFrame) -> DataFrame:
    """Dealt by ranges of columns and sorted within them, the layout to write: delta and run-length encodings then do the packing."""
    return x.repartitionByRange("col_id", "row_id").sortWithinPartitions("col_id", "row_id")


def rows_of(x: DataFrame) -> DataFrame:
    """``row_id, cols, vals``: each row's columns in ascending order."""
    packed = x.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("col_id", "val"))).alias("cells"))
    return packed.select("row_id", F.col("cells.col_id").alias("cols"), F.col("cells.val").alias("vals"))


#: Row numbers that one array or one window of a column spans.
SPAN = 1 << 20


def columns_of(x: DataFrame, span: int = SPAN) -> DataFrame:
    """``col_id, part, rows, vals``: each column's rows in ascending order, an array for each ``span`` row numbers that hold any."""
    packed = x.groupBy("col_id", F.floor(F.col("row_id") / span).alias("part")).agg(F.array_sort(F.collect_list(F.struct("row_id", "val"))).alias("cells"))
    return packed.select("col_id", "part", F.col("cells.row_id").alias("rows"), F.col("cells.val").alias("vals"))


def gaps(x: DataFrame, span: int = SPAN) -> DataFrame:
    """``col_id, row_id, gap, bits, restored``: differences to the row before, the first counted from -1, and back again.

    Columns are cut by row numbers, so that no task holds a whole column; the
    last row before each part comes from a table with one row for each part.
    """
    cells = x.select("col_id", "row_id", F.floor(F.col("row_id") / span).alias("part"))
    ends = cells.groupBy("col_id", "part").agg(F.max("row_id").alias("last"))
    before = ends.select("col_id", "part", F.coalesce(F.lag("last").over(W.partitionBy("col_id").orderBy("part")), F.lit(-1)).alias("before"))
    line = W.partitionBy("col_id", "part").orderBy("row_id")
    gap = cells.join(before, ["col_id", "part"]).withColumn("gap", F.col("row_id") - F.coalesce(F.lag("row_id").over(line), "before"))
    restored = F.col("before") + F.sum("gap").over(line.rowsBetween(W.unboundedPreceding, 0))
    return gap.select("col_id", "row_id", "gap", gap_bits(F.col("gap")).alias("bits"), restored.alias("restored"))


def column_stats(x: DataFrame) -> DataFrame:
    """``col_id, nz, col_max``: non-zero cells and the value of greatest size, with its sign."""
    return x.groupBy("col_id").agg(F.count("*").alias("nz"), F.max_by("val", F.struct(F.abs("val"), "val")).alias("col_max"))


def overall_max(x: DataFrame) -> DataFrame:
    """``overall_max``: the greatest size of any value."""
    return x.agg(F.max(F.abs("val")).alias("overall_max"))


def matrix_stats(x: DataFrame) -> DataFrame:
    """``entries, largest, mean_nz, columns, mean_gap`` of all columns that hold anything.

    Gaps of a column sum to its last row number and one.
    """
    per = x.groupBy("col_id").agg(F.count("*").alias("nz"), (F.max("row_id") + 1).alias("reach"))
    return per.agg(F.sum("nz").alias("entries"), F.max("nz").alias("largest"), F.avg("nz").alias("mean_nz"), F.count("*").alias("columns"), (F.sum("reach") / F.sum("nz")).alias("mean_gap"))


def _cell_hash() -> Column:
    return F.xxhash64("row_id", "val")


def column_classes(x: DataFrame, scratch: Scratch) -> DataFrame:
    """``col_id, nz, rep, sure`` as a written table: columns of one size and one sum of hashes have the least of them as ``rep``; ``sure`` tells that all of these are equal.

    A class is looked at by rows: each row that any of its columns has must be
    in all of them, with one value. No columns are paired; both passes read rows
    that are dealt out once.
    """
    cells = x.filter("col_id IS NOT NULL").select("row_id", "col_id", "val")
    prints = cells.groupBy("col_id").agg(F.count("*").alias("nz"), F.bit_xor(_cell_hash()).alias("print"))
    alike = W.partitionBy("nz", "print")
    classed = prints.select("col_id", "nz", F.min("col_id").over(alike).alias("rep"), F.count("*").over(alike).alias("members"))
    shared = cells.join(F.broadcast(classed.filter("members > 1").select("col_id", "rep", "members")), "col_id")
    each = shared.groupBy("rep", "members", "row_id").agg(F.count("val").alias("n"), F.min("val").alias("low"), F.max("val").alias("high"))
    sure = each.groupBy("rep").agg(F.bool_and((F.col("n") == F.col("members")) & (F.col("low") == F.col("high"))).alias("sure"))
    return scratch.put(classed.join(F.broadcast(sure), "rep", "left").select("col_id", "nz", "rep", F.coalesce("sure", F.lit(True)).alias("sure")))


def columns_match(x: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """``a, b, same`` for each of ``pairs(a, b)``, by default all pairs of columns that hold anything: whether both hold the same values in the same rows.

    Classes of equal columns tell; only columns whose hashes agree and whose
    class is not all equal are compared cell by cell. No column is gathered. A
    null value equals none.
    """
    columns = column_classes(x, Scratch(x.sparkSession))
    near = enumerate_pairs(columns).select(F.col("i").alias("a"), F.col("j").alias("b")) if pairs is None else pairs.select("a", "b").distinct()
    told = near
    for c in ("a", "b"):
        told = told.join(columns.select(F.col("col_id").alias(c), *(F.col(n).alias(f"{n}_{c}") for n in ("nz", "rep", "sure"))), c, "left")
    alike, sure = F.col("rep_a").eqNullSafe(F.col("rep_b")), F.coalesce("sure_a", F.lit(True))
    unsure = columns.filter("NOT sure").select("col_id")
    if unsure.isEmpty():
        return told.select("a", "b", alike.alias("same"))
    cells = x.join(F.broadcast(unsure), "col_id")
    one = cells.select(F.col("col_id").alias("a"), F.col("row_id").alias("r"), F.col("val").alias("v"))
    two = cells.select(F.col("col_id").alias("c"), "row_id", F.col("val").alias("w"))
    met = told.filter(alike & ~sure).select("a", "b").join(one, "a").join(two, (F.col("b") == F.col("c")) & F.col("r").eqNullSafe(F.col("row_id")))
    equal = met.groupBy("a", "b").agg(F.sum((F.col("v") == F.col("w")).cast("long")).alias("equal"))
    return told.join(equal, ["a", "b"], "left").select("a", "b", (alike & (sure | (F.coalesce("equal", F.lit(0)) == F.coalesce("nz_a", F.lit(0))))).alias("same"))


def column_by_effect(x: DataFrame, columns: tuple[int, ...]) -> DataFrame:
    """``row_id, val`` of one effect: the product of one, two or three columns."""
    out = None
    for c in columns:
        one = x.filter(F.col("col_id") == c).select("row_id", F.col("val").alias("v"))
        out = one.withColumnRenamed("v", "val") if out is None else out.join(one, "row_id").select("row_id", (F.col("val") * F.col("v")).alias("val"))
    return out


def without_columns(x: DataFrame, removed: DataFrame) -> DataFrame:
    return x.join(removed.select("col_id"), "col_id", "left_anti")


def only_columns(x: DataFrame, kept: DataFrame) -> DataFrame:
    return x.join(kept.select("col_id"), "col_id", "left_semi")
