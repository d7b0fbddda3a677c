"""Matrices and vectors in text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

NAME = r'^\s*"([^"]*)"\s*,'


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``row_id, value``: the lines of all files in order of name and offset, without empty ones.

    A task reads whole splits of files, one after the other, and counts its
    lines. The first count and the number of lines of each split, a row for
    each split of the input, say how far its lines are moved. Lines themselves
    aren't shuffled, and how splits are dealt to tasks doesn't matter.
    """
    read = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    lines = read.filter("trim(value) <> ''").withColumn("at", F.monotonically_increasing_id())
    splits = lines.groupBy("file", "start").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(W.orderBy("file", "start").rowsBetween(W.unboundedPreceding, -1))
    moved = splits.select("file", "start", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    return lines.join(F.broadcast(moved), ["file", "start"]).select((F.col("at") + F.col("shift")).alias("row_id"), "value")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    """``row_id, name, cells`` of lines ``"name",cell,...``."""
    return _lines(spark, path).select("row_id", F.regexp_extract("value", NAME, 1).alias("name"), F.split(F.regexp_replace("value", NAME, ""), ",").alias("cells"))


def row_names(spark: SparkSession, path: str) -> DataFrame:
    """``row_id, name`` of all lines, those without a non-zero cell included."""
    return _rows(spark, path).select("row_id", "name")


def x_shape(spark: SparkSession, path: str, clamp: bool = False) -> tuple[int, int]:
    """Lines, and cells of each; lines of different length are an error, or with ``clamp`` the shortest one counts."""
    n, least, most = _rows(spark, path).agg(F.count("*"), F.min(F.size("cells")), F.max(F.size("cells"))).first()
    if n and least != most and not clamp:
        raise ValueError(f"lines hold {least} to {most} cells")
    return int(n), int(least or 0)


def read_x_csv(spark: SparkSession, path: str, columns: int | None = None, clamp: bool = False) -> DataFrame:
    """``row_id, col_id, val`` of lines ``"name",0,1,...``; a cell that is neither 0 nor 1 is an error.

    Every line must have the same number of cells, ``columns`` if that is given
    (then no pass is spent on finding it). With ``clamp``, cells beyond those of
    the shortest line are left out.
    """
    width = columns if columns is not None else x_shape(spark, path, clamp)[1]
    wrong = F.size("cells") < width if clamp else F.size("cells") != width
    cells = F.when(wrong, F.raise_error(F.concat(F.lit("a line has another number of cells: "), F.size("cells"))).cast("array<string>")).otherwise(F.slice("cells", 1, max(width, 1)))
    each = _rows(spark, path).select("row_id", F.posexplode(cells).alias("col_id", "cell")).withColumn("cell", F.trim("cell"))
    checked = each.withColumn("val", F.when(F.col("cell") == "1", 1.0).when(F.col("cell") == "0", 0.0).otherwise(F.raise_error(F.concat(F.lit("a cell is neither 0 nor 1: "), "cell")).cast("double")))
    return checked.filter("val <> 0").select("row_id", "col_id", "val")


def read_y_csv(spark: SparkSession, path: str, center: bool = False) -> DataFrame:
    """``row_id, y`` of lines ``"name",number``."""
    y = _lines(spark, path).select("row_id", F.regexp_extract("value", r',\s*([^,"]+?)\s*$', 1).cast("double").alias("y"))
    return center_y(y) if center else y


def center_y(y: DataFrame) -> DataFrame:
    mean = y.agg(F.avg("y")).first()[0]
    return y.select("row_id", (F.col("y") - F.lit(mean)).alias("y"))


def read_matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """``row_id, col_id, val`` of a real coordinate file, or of a folder of its parts in the order of their names; indices start at 1 there and at 0 here."""
    parts = _lines(spark, path).filter("value NOT LIKE '\\%%'").select(F.split(F.trim("value"), r"\s+").alias("c"), "row_id")
    # the first line that is no comment holds the sizes
    first = parts.agg(F.min("row_id")).first()[0]
    return parts.filter(F.col("row_id") != first).select((F.col("c")[0].cast("long") - 1).alias("row_id"), (F.col("c")[1].cast("int") - 1).alias("col_id"), F.col("c")[2].cast("double").alias("val"))


def write_matrix_market(x: DataFrame, path: str, rows: int, columns: int) -> None:
    """``x(row_id, col_id, val)`` as a real coordinate file of ``rows`` and ``columns``, over as many parts as there are partitions."""
    entry = F.concat_ws(" ", (F.col("row_id") + 1).cast("string"), (F.col("col_id") + 1).cast("string"), F.col("val").cast("double").cast("string"))
    head = x.sparkSession.createDataFrame([(-2, "%%MatrixMarket matrix coordinate real general"), (-1, f"{rows} {columns} {x.count()}")], "row_id long, value string")
    body = x.select(F.col("row_id").cast("long").alias("row_id"), F.col("col_id").cast("int").alias("col_id"), entry.alias("value"))
    head.select("row_id", F.lit(0).alias("col_id"), "value").unionAll(body).orderBy("row_id", "col_id").select("value").write.mode("overwrite").text(path)


def write_y_csv(y: DataFrame, path: str) -> None:
    """Lines ``"name",number`` in the order of ``row_id``; a row is named by its number."""
    y.orderBy("row_id").select(F.concat(F.lit('"'), F.col("row_id").cast("string"), F.lit('",'), F.col("y").cast("double").cast("string")).alias("value")).write.mode("overwrite").text(path)


def write_x_csv(x: DataFrame, path: str, columns: int, names: DataFrame | None = None) -> None:
    """Lines ``"name",0,1,...`` in the order of ``row_id``, over as many files as there are partitions.

    With ``names(row_id, name)`` each of its rows is a line, empty ones too;
    without, a row that holds anything is one and named by its number.
    """
    cells = x.groupBy("row_id").agg(F.collect_set("col_id").alias("ones"))
    if names is None:
        cells = cells.withColumn("name", F.col("row_id").cast("string"))
    else:
        cells = names.select("row_id", F.col("name").cast("string").alias("name")).join(cells, "row_id", "left").withColumn("ones", F.coalesce("ones", F.array().cast("array<int>")))
    line = F.concat_ws(",", F.concat(F.lit('"'), "name", F.lit('"')), F.concat_ws(",", F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda c: F.when(F.array_contains("ones", c), "1").otherwise("0"))))
    cells.orderBy("row_id").select(line.alias("value")).write.mode("overwrite").text(path)
