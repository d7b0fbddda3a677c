"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder serves in local mode only; on a
    cluster each machine would write to a disk of its own, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        root = "file://" + tempfile.mkdtemp(prefix="weft-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any file system that Spark reads."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(conf).delete(target, True)


class Scratch:
    """Tables written to the shared folder, so that lineage ends there and a lost executor costs no rerun.

    A table that the returned result still reads lives until the application
    ends; ``drop`` removes one earlier.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark)}/weft-{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        self._paths: dict[int, str] = {}
        atexit.register(self._close)

    def path(self) -> str:
        """A new path of this folder."""
        self._n += 1
        return f"{self.root}/t{self._n}"

    def put(self, df: DataFrame) -> DataFrame:
        path = self.path()
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for t in tables:
            if path := self._paths.pop(id(t), None):
                remove(self.spark, path)

    def _close(self) -> None:
        if self.spark.sparkContext._jsc is not None and self._n:
            try:
                remove(self.spark, self.root)
            except Exception:  # the JVM may be gone already
                return
