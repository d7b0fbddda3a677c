"""The product space as a query: sums of a response over every pair or triple of columns that occur together.

Two forms give the same result. The array form holds each row's columns as one
sorted array with the row's response; the first column of a product is exploded
from it, then the next from what is left of the array, so that a task never
holds more than one row's columns and nothing moves before the partial
aggregation. A long row is cut into blocks of columns first; each pair or triple
of its blocks is a key of its own, so that many tasks share its products. The
join form is a band self-join on the row; it has no array to
outgrow a task's memory, and adaptive execution may split long rows' partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts into which columns are dealt where all pairs of them are listed.
PARTS = 64
#: Columns of a row beyond which it is cut, and columns of a block; tasks that the blocks go to at least.
GRID, TASKS = (512, 128), 64
_NAMES = ("i", "j", "k", "i4", "i5", "i6")


def main_screen(x: DataFrame, y: DataFrame, value: str = "y") -> DataFrame:
    """``i, nz, s``: for each column the sum of the response, weighed by its values."""
    return x.join(y.select("row_id", F.col(value).alias("_y")), "row_id").groupBy(F.col("col_id").alias("i")).agg(F.count("*").alias("nz"), F.sum(F.col("val") * F.col("_y")).alias("s"))


def packed(x: DataFrame, binary: bool, *own: str) -> DataFrame:
    """``row_id, cells`` and a row's ``own`` columns: each row's columns in ascending order, with their values unless these are all one."""
    return x.groupBy("row_id", *own).agg(F.sort_array(F.collect_list("col_id" if binary else F.struct("col_id", "val"))).alias("cells"))


def collapsed(x: DataFrame, y: DataFrame) -> DataFrame:
    """``row_id, cells, n, y, m`` for each set of columns that rows of a matrix of ones have: the least of these rows, how many have cells, their responses' sum and how many have one.

    Sums over all rows of any product are sums over the sets that hold its
    columns. Rows without cells share one set, which is null.
    """
    rows = packed(x, True).join(y.select("row_id", F.col("y").cast("double").alias("y")), "row_id", "full_outer")
    return rows.groupBy("cells").agg(F.min("row_id").alias("row_id"), F.count("cells").cast("double").alias("n"), F.coalesce(F.sum("y"), F.lit(0.0)).alias("y"), F.count("y").cast("double").alias("m")).select("row_id", "cells", "n", "y", "m")


def products(rows: DataFrame, order: int, distance: int | None, binary: bool, carried: list[str], grid: tuple[int, int] | None = None) -> DataFrame:
    """``i[, j[, k...]], v`` and the ``carried`` columns, for all products of ``order`` columns within each row of ``rows(cells, ...)``.

    Columns of a row are distinct whole numbers, so that no more than
    ``distance`` of them lie within the distance of another one. With ``grid``
    rows of more columns than its first number are dealt out by blocks of as
    many as its second one.
    """
    if grid and order > 1:
        short = products(rows.filter(F.size("cells") <= grid[0]), order, distance, binary, carried)
        return short.unionAll(_block_products(rows.filter(F.size("cells") > grid[0]), order, distance, binary, carried, grid[1]))
    column = lambda cell: F.col(cell) if binary else F.col(f"{cell}.col_id")
    value = lambda cell: F.lit(1.0) if binary else F.col(f"{cell}.val")
    out = rows.select(*carried, "cells", F.posexplode("cells").alias("q", "c")).select(*carried, "cells", "q", column("c").alias("i"), value("c").alias("v"))
    for done in range(1, order):
        rest = F.slice("cells", F.col("q") + 2, F.size("cells") if distance is None else F.lit(distance))
        have = [*carried, "cells", "q", *_NAMES[:done], "v"]
        out = out.select(*have, F.posexplode(rest).alias("w", "c"))
        out = out.select(*carried, "cells", (F.col("q") + F.col("w") + 1).alias("q"), *_NAMES[:done], column("c").alias(_NAMES[done]), (F.col("v") * value("c")).alias("v"))
        if distance is not None:
            out = out.filter(F.col(_NAMES[done]) - F.col("i") <= distance)
    return out.select(*carried, *_NAMES[:order], "v")


def _block_products(rows: DataFrame, order: int, distance: int | None, binary: bool, carried: list[str], wide: int) -> DataFrame:
    """The same from blocks of each row's columns, ascending within a block and from one to the next.

    A row's blocks are copied once for each key that they are part of; the
    products are made after these have been dealt out. The number of tasks is
    fixed, as the blocks are small for the products that come of them.
    """
    column = lambda cell: F.col(cell) if binary else F.col(f"{cell}.col_id")
    value = lambda cell: F.lit(1.0) if binary else F.col(f"{cell}.val")
    ends = lambda block, at: F.element_at(block, at) if binary else F.element_at(block, at)["col_id"]
    places, blocks = [f"p{k}" for k in range(order)], [f"b{k}" for k in range(order)]
    last = F.ceil(F.size("cells") / wide).cast("int") - 1
    out = rows.select(*carried, "cells")
    for k, place in enumerate(places):
        out = out.select(*carried, "cells", *places[:k], F.explode(F.sequence(F.lit(0) if not k else F.col(places[k - 1]), last)).alias(place))
    cut = [F.slice("cells", F.col(place) * wide + 1, F.lit(wide)).alias(block) for place, block in zip(places, blocks, strict=True)]
    out = out.select(*carried, *places, *cut)
    if distance is not None:
        out = out.filter((F.col(places[0]) == F.col(places[-1])) | (ends(F.col(blocks[-1]), 1) - ends(F.col(blocks[0]), -1) <= distance))
    tasks = max(TASKS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out = out.repartition(tasks, *places, *blocks).withColumn("v", F.lit(1.0))
    for k, block in enumerate(blocks):
        have = [c for c in out.columns if c != block]
        out = out.select(*have, F.explode(block).alias("c"))
        if k:
            out = out.filter(column("c") > F.col(_NAMES[k - 1]))
        if k and distance is not None:
            out = out.filter(column("c") - F.col("i") <= distance)
        out = out.select(*[c for c in have if c != "v"], column("c").alias(_NAMES[k]), (F.col("v") * value("c")).alias("v"))
    return out.select(*carried, *_NAMES[:order], "v")


def _summed(exploded: DataFrame, keys: list[str], binary: bool) -> DataFrame:
    weighed = F.col("y") if binary else F.col("v") * F.col("y")
    return exploded.groupBy(*keys).agg(F.count("*").alias("nz"), F.sum(weighed).alias("s"))


def _array_screen(x: DataFrame, y: DataFrame, order: int, distance: int | None, value: str, binary: bool, grid: tuple[int, int] | None) -> DataFrame:
    rows = packed(x, binary).join(y.select("row_id", F.col(value).alias("y")), "row_id")
    return _summed(products(rows, order, distance, binary, ["y"], grid), list(_NAMES[:order]), binary)


def pair_screen(x: DataFrame, y: DataFrame, distance: int | None = None, value: str = "y", binary: bool = True, grid: tuple[int, int] | None = None) -> DataFrame:
    """``i, j, nz, s`` for every pair i < j of columns that share a row, at most ``distance`` apart; ``grid`` for long rows."""
    return _array_screen(x, y, 2, distance, value, binary, grid)


def triple_screen(x: DataFrame, y: DataFrame, distance: int | None = None, value: str = "y", binary: bool = True, grid: tuple[int, int] | None = None) -> DataFrame:
    """``i, j, k, nz, s`` for every triple i < j < k that shares a row; the distance is from the first to the last."""
    return _array_screen(x, y, 3, distance, value, binary, grid)


def pairs_by_join(x: DataFrame, distance: int | None = None, later: DataFrame | None = None) -> DataFrame:
    """``row_id, i, j, v, w`` of all pairs that share a row; ``v`` is the product, ``w`` the second value.

    The second column comes from ``later`` where that is given, a part of ``x``.
    """
    a, b = x.alias("a"), (x if later is None else later).alias("b")
    near = F.expr("a.row_id = b.row_id AND a.col_id < b.col_id" + (f" AND b.col_id - a.col_id <= {distance}" if distance is not None else ""))
    return a.join(b, near).select(F.col("a.row_id").alias("row_id"), F.col("a.col_id").alias("i"), F.col("b.col_id").alias("j"), (F.col("a.val") * F.col("b.val")).alias("v"), F.col("b.val").alias("w"))


def triples_of_pairs(pairs: DataFrame, live: DataFrame | None = None, distance: int | None = None) -> DataFrame:
    """``row_id, i, j, k, v`` of the triples whose pairs (i, j) and (i, k) are both among ``pairs``; with ``live(i, j)`` (j, k) too."""
    a, b = pairs.alias("a"), pairs.alias("b")
    three = a.join(b, F.expr("a.row_id = b.row_id AND a.i = b.i AND a.j < b.j" + (f" AND b.j - a.i <= {distance}" if distance is not None else "")))
    out = three.select(F.col("a.row_id").alias("row_id"), F.col("a.i").alias("i"), F.col("a.j").alias("j"), F.col("b.j").alias("k"), (F.col("a.v") * F.col("b.w")).alias("v"))
    return out if live is None else out.join(live.select(F.col("i").alias("j"), F.col("j").alias("k")), ["j", "k"], "left_semi")


def pair_screen_by_join(x: DataFrame, y: DataFrame, distance: int | None = None, value: str = "y", binary: bool = True, later: DataFrame | None = None) -> DataFrame:
    """The same as ``pair_screen``, as a band self-join."""
    met = pairs_by_join(x, distance, later)
    return _summed(met.join(y.select("row_id", F.col(value).alias("y")), "row_id"), ["i", "j"], binary)


def triple_screen_by_join(x: DataFrame, y: DataFrame, distance: int | None = None, value: str = "y", binary: bool = True, later: DataFrame | None = None) -> DataFrame:
    """The same as ``triple_screen``, as two band self-joins; second and third columns come from ``later`` where that is given."""
    a, b, c = x.alias("a"), (x if later is None else later).alias("b"), (x if later is None else later).alias("c")
    band = lambda n: f" AND {n}.col_id - a.col_id <= {distance}" if distance is not None else ""
    two = a.join(b, F.expr("a.row_id = b.row_id AND a.col_id < b.col_id" + band("b")))
    three = two.join(c, F.expr("a.row_id = c.row_id AND b.col_id < c.col_id" + band("c")))
    met = three.select(F.col("a.row_id").alias("row_id"), F.col("a.col_id").alias("i"), F.col("b.col_id").alias("j"), F.col("c.col_id").alias("k"), (F.col("a.val") * F.col("b.val") * F.col("c.val")).alias("v"))
    return _summed(met.join(y.select("row_id", F.col(value).alias("y")), "row_id"), ["i", "j", "k"], binary)


def hierarchy_filter(pairs: DataFrame, mains: DataFrame, strong: bool = False) -> DataFrame:
    """Effects whose larger columns, or with ``strong`` all columns, are among ``mains(col_id)``."""
    names = [c for c in ("i", "j", "k") if c in pairs.columns]
    for name in names if strong else names[1:]:
        pairs = pairs.join(mains.select(F.col("col_id").alias(name)), name, "left_semi")
    return pairs


def over_threshold(screened: DataFrame, limit: float) -> DataFrame:
    return screened.filter(F.abs("s") > limit)


def largest_per_main(pairs: DataFrame, symmetric: bool = False) -> DataFrame:
    """``i, last_max``: the largest sum in size among the pairs of a column; with ``symmetric`` for both columns of a pair."""
    rows = pairs.select("i", F.abs("s").alias("s"))
    if symmetric:
        rows = rows.unionAll(pairs.select(F.col("j").alias("i"), F.abs("s").alias("s")))
    return rows.groupBy("i").agg(F.max("s").alias("last_max"))


def largest_per_pair(triples: DataFrame) -> DataFrame:
    """``i, j, last_max``: the largest sum in size among the triples that begin with a pair."""
    return triples.groupBy("i", "j").agg(F.max(F.abs("s")).alias("last_max"))


def expand(x: DataFrame) -> DataFrame:
    """``row_id, i, j, val`` of all products i <= j, the column itself where i = j."""
    a, b = x.alias("a"), x.alias("b")
    met = a.join(b, F.expr("a.row_id = b.row_id AND a.col_id <= b.col_id"))
    return met.select(F.col("a.row_id").alias("row_id"), F.col("a.col_id").alias("i"), F.col("b.col_id").alias("j"), F.when(F.col("a.col_id") == F.col("b.col_id"), F.col("a.val")).otherwise(F.col("a.val") * F.col("b.val")).alias("val"))


def contingency(x: DataFrame, n: int) -> DataFrame:
    """``i, j, o00, o01, o10, o11, omin`` for every pair that occurs together, of ``n`` rows."""
    per = x.groupBy("col_id").agg(F.count("*").alias("nz"))
    a, b = x.alias("a"), x.alias("b")
    both = a.join(b, F.expr("a.row_id = b.row_id AND a.col_id < b.col_id")).groupBy(F.col("a.col_id").alias("i"), F.col("b.col_id").alias("j")).agg(F.count("*").alias("o11"))
    full = both.join(per.select(F.col("col_id").alias("i"), F.col("nz").alias("ni")), "i").join(per.select(F.col("col_id").alias("j"), F.col("nz").alias("nj")), "j")
    cells = full.select("i", "j", (F.lit(n) - F.col("ni") - F.col("nj") + F.col("o11")).alias("o00"), (F.col("nj") - F.col("o11")).alias("o01"), (F.col("ni") - F.col("o11")).alias("o10"), "o11")
    return cells.withColumn("omin", F.least("o00", "o01", "o10", "o11"))


def enumerate_pairs(columns: DataFrame, distance: int | None = None) -> DataFrame:
    """``i, j`` of all pairs of ``columns(col_id)`` at most ``distance`` apart; a range join on blocks as wide as the distance."""
    if distance is None:
        # every column meets each of the parts that the others are dealt into
        left = columns.select(F.col("col_id").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
        right = columns.select(F.col("col_id").alias("j"), F.pmod("col_id", F.lit(PARTS)).alias("part"))
        return left.join(right, "part").filter("i < j").select("i", "j")
    width = max(distance, 1)
    left = columns.select(F.col("col_id").alias("i"), F.explode(F.array(F.floor(F.col("col_id") / width), F.floor(F.col("col_id") / width) + 1)).alias("block"))
    right = columns.select(F.col("col_id").alias("j"), F.floor(F.col("col_id") / width).alias("block"))
    return left.join(right, "block").filter(f"i < j AND j - i <= {distance}").select("i", "j")


def candidate_count(columns: DataFrame, depth: int, distance: int | None = None) -> DataFrame:
    """``n``: the effects of ``columns(col_id)`` up to ``depth`` whose first and last column are at most ``distance`` apart.

    A column is the first of as many pairs, and of as many triples, as the
    number of columns that follow it within the distance allows.
    """
    follow = enumerate_pairs(columns, distance).groupBy("i").agg(F.count("*").alias("m"))
    of = columns.select(F.col("col_id").alias("i")).distinct().join(follow, "i", "left").select(F.coalesce("m", F.lit(0)).alias("m"))
    first = F.lit(1) + (F.col("m") if depth > 1 else F.lit(0)) + (F.col("m") * (F.col("m") - 1) / 2 if depth > 2 else F.lit(0))
    return of.agg(F.coalesce(F.sum(first), F.lit(0)).cast("long").alias("n"))
