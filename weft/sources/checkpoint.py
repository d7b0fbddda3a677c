"""Saved states of a fit: one folder for each save, numbered in the order of saving.

The number, not the count of penalties, says which is newest. A save holds the
tables that the search remembers and, written last, the state itself. It counts
only with the state's ``_SUCCESS`` mark, so that tables and state are read
together or not at all, and an interrupted save is never read. Older saves are
removed when a newer one is complete.
"""

from __future__ import annotations

import json
from dataclasses import asdict, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators.report import by_order, effect_table
from weft.plans.state import FitConfig, FitState
from weft.sources.scratch import remove


def latest(states: DataFrame) -> DataFrame:
    """The newest complete state of ``(save_seq, complete, state...)``."""
    return states.filter("complete").orderBy(F.desc("save_seq")).limit(1)


def read_log(spark: SparkSession, path: str, names: DataFrame, p: int) -> dict[str, DataFrame]:
    """The effects of the newest saved state, whatever its options, as tables ``main``, ``pairwise`` and ``triple``.

    Columns are named by ``names(col_id, name)``. Without a saved state all are empty.
    """
    log = Checkpoints(spark, path, FitConfig())
    state = log.newest()
    beta = [(e, float(b)) for e, b in sorted(state.beta.items()) if b] if state else []
    return by_order(effect_table(spark.createDataFrame(beta, "id long, strength double"), names, p))


def _whole_keys(beta: dict) -> dict[int, float]:
    return {int(k): v for k, v in beta.items()}


class Checkpoints:
    def __init__(self, spark: SparkSession, path: str, config: FitConfig, keep: int = 2) -> None:
        self.spark, self.path, self.config, self.keep = spark, path.rstrip("/"), json.dumps(asdict(config), sort_keys=True), keep

    def _numbers(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        whole = [s.getPath() for s in fs.listStatus(root) if s.isDirectory() and s.getPath().getName().startswith("save=")]
        return sorted(int(p.getName()[5:]) for p in whole if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "state/_SUCCESS")))

    def save(self, state: FitState) -> bool:
        """Writes the state's tables, then the state; the ``keep`` newest saves stay."""
        numbers = self._numbers()
        number = max(numbers, default=0) + 1
        root = f"{self.path}/save={number}"
        for name, table in state.tables.items():
            table.write.mode("overwrite").parquet(f"{root}/{name}")
        plain = {f.name: getattr(state, f.name) for f in fields(state) if f.name != "tables"} | {"tables": sorted(state.tables)}
        row = [(self.config, json.dumps(plain))]
        self.spark.createDataFrame(row, "config string, state string").coalesce(1).write.mode("overwrite").parquet(f"{root}/state")
        for old in numbers[: len(numbers) + 1 - self.keep] if len(numbers) >= self.keep else []:
            remove(self.spark, f"{self.path}/save={old}")
        return True

    def restore(self) -> FitState | None:
        """The newest state, or none if nothing was saved or it was saved under other options."""
        return self._read(self.config)

    def newest(self) -> FitState | None:
        """The newest state under any options."""
        return self._read(None)

    def _read(self, config: str | None) -> FitState | None:
        numbers = self._numbers()
        if not numbers:
            return None
        root = f"{self.path}/save={numbers[-1]}"
        row = self.spark.read.parquet(f"{root}/state").first()
        if config is not None and row["config"] != config:
            return None
        state = json.loads(row["state"])
        state["beta"], state["idle"] = _whole_keys(state["beta"]), _whole_keys(state["idle"])
        state["trail"] = [(lam, _whole_keys(b)) for lam, b in state["trail"]]
        state["history"] = [(step, _whole_keys(b), a) for step, b, a in state["history"]]
        state["tables"] = {name: self.spark.read.parquet(f"{root}/{name}") for name in state["tables"]}
        return FitState(**state)
