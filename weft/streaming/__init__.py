"""Incremental statistics over streams of matrix rows.

The engine's fits are batch jobs. What a screen sums can be kept up to date on
a stream, though, as sums over rows only grow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_sums(cells: DataFrame) -> DataFrame:
    """``col_id, nz, s`` over a stream of ``row_id, col_id, val, y``; for complete or update output."""
    return cells.groupBy("col_id").agg(F.count("*").alias("nz"), F.sum(F.col("val") * F.col("y")).alias("s"))
