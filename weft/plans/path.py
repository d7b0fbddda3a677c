"""The square-root-lasso path over columns and their products.

Every step screens that part of the product space that bounds don't exclude
with Spark queries at the present residuals, adds what exceeds the threshold to
the active set, and solves for the active set on its inner products. The
threshold is the penalty times the norm of the residuals at the end of the step
before. If all effects that have rows are few, their inner products are computed
once and screen every step. A step needs no screen where the last one's sums and
the residuals' change since tell that nothing new can exceed the threshold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.ids import effect_columns
from weft.functions.scalar import default_lambda_min
from weft.operators import dedupe, report, screen, solve
from weft.plans.calibration import agree
from weft.plans.search import Search as _Search
from weft.plans.state import FitConfig, FitState

__all__ = ["FitConfig", "FitResult", "FitState", "fit", "lambda_grid", "lambda_max"]

SHRINK = 0.95


@dataclass
class FitResult:
    effects: DataFrame  # ord, id, i, j, k, strength
    equivalent: DataFrame | None  # rep, equivalent
    intercept: float
    final_lambda: float
    fitted_lambda: float
    sigma: float
    path: list[tuple[int, float, int, float]]  # step, lambda, id, strength
    unbiased: DataFrame | None = None
    unbiased_intercept: float | None = None
    screens: int = 0  # steps that queried the product space
    looked: int = 0  # effects that the search for equivalents looked at
    most_at_once: int = 0  # active effects
    ended_by_calibration: bool = False

    def tables(self, names: DataFrame, p: int) -> dict[str, DataFrame]:
        """``main``, ``pairwise`` and ``triple`` effects by the names of ``names(col_id, name)``, each with the names of its equivalents."""
        spark = self.effects.sparkSession
        none = spark.createDataFrame([], "rep long, equivalent array<long>")
        named = report.effect_table(self.effects.select("id", "strength"), names, p)
        return report.by_order(report.with_equivalents(named, self.equivalent if self.equivalent is not None else none, names, p))


def lambda_max(x: DataFrame, y: DataFrame) -> float:
    """The largest inner product of a column with the response, in size."""
    top = screen.main_screen(x, y).agg(F.max(F.abs("s"))).first()[0]
    if top is None or not np.isfinite(top):
        raise ValueError("the data have no usable value")
    return float(top)


def lambda_grid(highest: float, lowest: float, most: int) -> list[float]:
    out = []
    while highest > lowest and len(out) < most:
        out.append(highest)
        highest *= SHRINK
    return out


def _effects_frame(spark: SparkSession, beta: dict[int, float], p: int) -> DataFrame:
    rows = []
    for e, b in sorted(beta.items()):
        c = [*effect_columns(e, p), None, None]
        rows.append((len(effect_columns(e, p)), e, c[0], c[1], c[2], float(b)))
    return spark.createDataFrame(rows, "ord int, id long, i int, j int, k int, strength double")


def _without_shadowed(m: solve.Gram, state: FitState) -> dict[int, int]:
    """Active effects equal to one of less order or number, and what stands for these.

    Columns of ones and zeros are equal where both counts and the inner product
    are the same.
    """
    size, ids, gone = np.diag(m.g), np.array(m.ids), {}
    for k, e in enumerate(m.ids):
        same = ids[(ids < e) & (size == size[k]) & (m.g[k] == size[k])]
        if len(same):
            gone[e] = int(same.min())
    return gone


def _stand_for(state: FitState, gone: dict[int, int]) -> None:
    """Shadowed effects leave the active set; their strength goes to what stands for them, so that residuals stay as they are."""
    for e, rep in gone.items():
        if b := state.beta.pop(e, 0.0):
            state.beta[rep] = state.beta.get(rep, 0.0) + b
    state.active = [e for e in state.active if e not in gone]


def sweep_order(effects: list[int], seed: int | None) -> list[int]:
    """Effects in the order in which sweeps take them: by number, or by a hash of seed and number that is the same in every run."""
    if seed is None:
        return sorted(effects)
    return sorted(effects, key=lambda e: (hashlib.blake2b(f"{seed}:{e}".encode(), digest_size=8).digest(), e))


def fit(x: DataFrame, y: DataFrame, p: int, config: FitConfig | None = None, resume: FitState | None = None, save: Callable[[FitState], bool | None] | None = None) -> FitResult:
    """Fit ``y(row_id, y)`` on ``x(row_id, col_id, val)`` with ``p`` columns.

    ``save`` is called after every penalty; its last state, given as
    ``resume``, goes on where it stopped. If it returns true it has stored the
    state's tables, which may then go; else they stay until the application
    ends. Rows without any column count with their response. Nulls in either
    table are an error.
    """
    config = config or FitConfig()
    bad = x.filter("row_id IS NULL OR col_id IS NULL OR val IS NULL").limit(1).count() + y.filter("row_id IS NULL OR y IS NULL").limit(1).count()
    if bad:
        raise ValueError("the data hold nulls")
    x = x.select("row_id", F.col("col_id").cast("int").alias("col_id"), F.col("val").cast("double").alias("val")).filter("val <> 0")
    if not config.continuous:
        x = x.withColumn("val", F.lit(1.0))
    search = _Search(x, y, p, config, resume)
    try:
        return _fit(search, x.sparkSession, p, config, resume, save)
    finally:
        search.close()


def _solved(m: solve.Gram | solve.BlockGram, state: FitState, limit: float, config: FitConfig) -> None:
    """Sweeps over the active effects, from and into the state."""
    start = np.array([state.beta.get(e, 0.0) for e in m.ids])
    done = solve.descend(m, start, state.intercept, limit, config.halt_error_diff, config.use_intercept)
    state.beta = {e: float(b) for e, b in zip(m.ids, done.beta, strict=True) if b}
    state.intercept, state.sigma = done.intercept, done.error


def _fit(search: _Search, spark: SparkSession, p: int, config: FitConfig, resume: FitState | None, save: Callable[[FitState], bool | None] | None) -> FitResult:
    n, _, yy = search.totals
    state = resume or FitState(lam=config.lambda_max if config.lambda_max is not None else lambda_max(search.x, search.y), sigma=float(np.sqrt(yy)))
    state = replace(state, beta=dict(state.beta), active=sweep_order(state.active, config.sweep_seed), idle=dict(state.idle), evicted=list(state.evicted), trail=list(state.trail), tables={}, history=[])
    lowest = config.lambda_min if config.lambda_min is not None else default_lambda_min(n, p, config.depth, config.compat)
    most_nz = config.max_nz_beta if config.max_nz_beta is not None else np.inf
    path: list[tuple[int, float, int, float]] = []
    fitted, m = state.lam, search.gram(state.active) if state.active else None
    top, shadowed, most, ended = None, set(), len(state.active), False

    def admit(new: list[int]) -> None:
        nonlocal m, shadowed
        state.active = sweep_order([*state.active, *new], config.sweep_seed)
        state.evicted = [e for e in state.evicted if e not in new]
        m = search.gram(state.active)
        if config.check_duplicates and isinstance(m, solve.Gram) and (gone := _without_shadowed(m, state)):
            _stand_for(state, gone)
            shadowed |= gone.keys()
            m = m.part(state.active)

    while state.lam > lowest and state.counted < config.max_lambdas and not ended:
        if sum(1 for b in state.beta.values() if b) >= most_nz or state.sigma <= 1e-9 * np.sqrt(yy):
            break
        limit = state.lam * state.sigma
        if not state.active and top is not None and top <= limit:
            # nothing is active and nothing would be: only the penalty changes
            if config.calibrate is not None:
                state.trail.append((state.lam, {}))
            state.lam *= SHRINK
            state.step += 1
            continue
        if not search.still(state, limit, m):
            found, replaced, top = search.over(state, limit, m)
            if replaced:
                _stand_for(state, replaced)
            new = [e for e in found if e not in shadowed]
            if new or replaced:
                admit(new)
        if m is None:
            m = search.gram([])
        before = state.intercept
        _solved(m, state, limit, config)
        while state.evicted and (back := [e for e, s in search.sums([e for e in state.evicted if search.allowed(e, state)], state).items() if abs(s) > limit]):
            admit(back)
            _solved(m, state, limit, config)
        most = max(most, len(state.active))
        if not state.active:
            top = None if state.intercept != before else top
        fitted = state.lam
        path += [(state.step, state.lam, e, b) for e, b in state.beta.items()]
        if config.calibrate is not None:
            ended = not agree(state.trail, state.lam, state.beta, config.calibrate)
            state.trail.append((state.lam, dict(state.beta)))
        state.lam *= SHRINK
        state.step += 1
        state.counted += bool(state.active)
        if config.evict_after is not None:
            state.idle = {e: 0 if e in state.beta else state.idle.get(e, 0) + 1 for e in state.active}
            if gone := [e for e in state.active if state.idle[e] >= config.evict_after]:
                state.evicted = sorted({*state.evicted, *gone})
                state.active = [e for e in state.active if state.idle[e] < config.evict_after]
                m = m.part(state.active) if isinstance(m, solve.Gram) else search.gram(state.active)
        if save:
            kept = replace(state, beta=dict(state.beta), active=list(state.active), trail=list(state.trail), history=list(search.history), tables=search.tables())
            search.shared = not save(kept)
    equivalent, beta, looked = None, dict(state.beta), 0
    if config.check_duplicates and beta:
        kept = spark.createDataFrame([(e, b) for e, b in beta.items()], "id long, strength double")
        members, looked = dedupe.contained(search.full, solve.effect_rows(search.full, list(beta), p), p, config.depth, config.max_interaction_distance, search.scratch)
        classed = search.scratch.put(dedupe.classes_of(members))
        beta = {r["id"]: r["strength"] for r in dedupe.fold(kept, classed).collect()}
        equivalent = dedupe.equivalents(classed)
    result = FitResult(_effects_frame(spark, beta, p), equivalent, state.intercept, state.lam, fitted, state.sigma, path, screens=search.screens, looked=looked, most_at_once=most, ended_by_calibration=ended)
    if config.estimate_unbiased and beta:
        ids = sorted(beta)
        plain = solve.least_squares(search.gram(ids), config.use_intercept)
        result.unbiased = _effects_frame(spark, dict(zip(ids, plain.beta.tolist(), strict=True)), p)
        result.unbiased_intercept = plain.intercept
    return result
