"""Matrices from wide and array tables, and the models made of the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def from_wide(df: DataFrame, row: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Coordinates and a dictionary ``col_id, name`` of a wide table; columns without names of their own are numbered by place."""
    values = F.posexplode(F.array(*(F.col(c).cast("double") for c in columns))).alias("col_id", "val")
    x = df.select(F.col(row).cast("long").alias("row_id"), values).filter("val <> 0")
    names = df.sparkSession.createDataFrame(list(enumerate(columns)), "col_id int, name string")
    return x, names


def from_arrays(df: DataFrame, row: str, values: str) -> DataFrame:
    return df.select(F.col(row).cast("long").alias("row_id"), F.posexplode(values).alias("col_id", "val")).select("row_id", "col_id", F.col("val").cast("double").alias("val")).filter("val <> 0")


def binarise(x: DataFrame) -> DataFrame:
    return x.filter("val <> 0").withColumn("val", F.lit(1.0))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a table that one task packs and joins at most, about.
SHARE = 250_000


def by_row(df: DataFrame, other: DataFrame, rows: int, share: int = SHARE) -> tuple[DataFrame, DataFrame]:
    """``df`` dealt by ``row_id`` over as many partitions as ``rows`` ask for, so that no task's share grows with the table, and ``other`` to join with it.

    Few rows are left to the session's own number of partitions. Of many,
    ``other`` is dealt out in the same way, however small its files are, since
    each task would hold a copy of all of it.
    """
    if rows <= share * 4:
        return df.repartition("row_id"), other
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(usual, -(-rows // share)), "row_id"), other.hint("merge")


def basket(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders by brands of their parts; the response is the order's price in whole cents."""
    part = _table(spark, sf_dir, "part").select("p_partkey", (F.substring("p_brand", 7, 10).cast("int") - 1).alias("col_id"))
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    bought = lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
    # dealt by row once: the distinct, the packing of rows and joins on rows need no other exchange
    x = bought.select(F.col("l_orderkey").alias("row_id"), "col_id")
    y = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), F.round(F.col("o_totalprice") * 100).cast("long").alias("y"))
    x, y = by_row(x, y, lines.count(), SHARE)
    return x.distinct().withColumn("val", F.lit(1.0)), y


def makers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders by the makers of their parts, five columns, and the kinds of these, five more; the response as in ``basket``."""
    x, y = basket(spark, sf_dir)
    either = F.explode(F.array(F.floor(F.col("col_id") / 5).cast("int"), F.col("col_id") % 5 + 5))
    return x.select("row_id", either.alias("col_id")).distinct().withColumn("val", F.lit(1.0)), y


def embed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Vectors by their components; the response is the label."""
    e = _table(spark, sf_dir, "embeddings")
    return from_arrays(e, "vec_id", "embedding"), e.select(F.col("vec_id").alias("row_id"), F.col("label").cast("long").alias("y"))


def _events(spark: SparkSession, sf_dir: str, bins: int) -> tuple[DataFrame, DataFrame]:
    e = _table(spark, sf_dir, "events")
    kinds = e.select("event_type").distinct().withColumn("kind", F.row_number().over(W.orderBy("event_type")) - 1)
    x = e.join(F.broadcast(kinds), "event_type").select(F.col("user_id").alias("row_id"), (F.col("kind") * bins + F.floor(F.hour("ts") / (24 // bins))).cast("int").alias("col_id")).distinct().withColumn("val", F.lit(1.0))
    y = e.groupBy(F.col("user_id").alias("row_id")).agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("y"))
    return x, y


def events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Users by kind of event and quarter of the day; the response is the sum of values in hundredths."""
    return _events(spark, sf_dir, 4)


def events_by_hour(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Users by kind of event and hour of the day, the surveyed matrix of long rows; the response as in ``events``."""
    return _events(spark, sf_dir, 24)
