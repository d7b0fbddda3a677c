"""What the operators share: scratch tables, Arrow batches of bounded size, identifiers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from weft.sources.scratch import Scratch

__all__ = ["Scratch", "arrow_schema", "bounded_batches", "crc_of_id", "free_name", "running", "slices", "table"]

#: Rows and bytes that one Arrow batch carries to a Python worker at most.
BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small: texts may be long, and a batch is held whole by its worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def arrow_schema(df: DataFrame, *added: tuple[str, str], without: tuple[str, ...] = ()) -> StructType:
    """The schema of ``df`` with the columns ``added``, names and types, at its end; any names and nested types are kept as they are."""
    more = [StructField(name, StructType.fromDDL(f"c {kind}")[0].dataType) for name, kind in added]
    return StructType([f for f in df.schema.fields if f.name not in without] + more)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it as long as the table has such a column; names differ by more than case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds about ``limit`` bytes at most; a longer single value stays whole."""
    for batch in batches:
        start, size = 0, 0
        lengths = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        for i, n in enumerate(lengths):
            if i > start and size + n > limit:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if batch.num_rows > start:
            yield batch.slice(start)


def running(df: DataFrame, order: list[Column], scratch: Scratch, **sums: Column) -> DataFrame:
    """``df`` with ``place``, the rows before each one in the order, and for each of ``sums`` what its rows before come to.

    Rows are sorted by range over all tasks and written; the totals of each
    task's rows, a row for each task, move what is counted within it. No task
    sees all rows.
    """
    part, at = free_name(df, "part"), free_name(df, "at")
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = scratch.put(dealt.withColumn(part, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id()))
    before_all = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    totals = placed.groupBy(part).agg(F.count("*").alias("_n"), F.min(at).alias("_first"), *(F.sum(c).alias(f"_{name}") for name, c in sums.items()))
    moved = totals.select(part, "_first", *(F.coalesce(F.sum(f"_{name}").over(before_all), F.lit(0)).alias(f"_{name}") for name in ("n", *sums)))
    line = W.partitionBy(part).orderBy(at).rowsBetween(W.unboundedPreceding, -1)
    joined = placed.join(F.broadcast(moved), part)
    told = {"place": F.col("_n") + F.col(at) - F.col("_first")} | {name: F.col(f"_{name}") + F.coalesce(F.sum(c).over(line), F.lit(0)) for name, c in sums.items()}
    return joined.select(*df.columns, *(c.alias(name) for name, c in told.items()))


def crc_of_id(column: str = "doc_id"):
    """CRC-32 of the identifier's decimal text, by which folds are made."""
    return F.crc32(F.col(column).cast("string").cast("binary"))
