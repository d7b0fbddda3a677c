"""Adaptive calibration: whether a path may go on, by comparing solutions at different penalties."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The constant of the published criterion.
BOUND = 0.75


def distances(path: DataFrame) -> DataFrame:
    """``step_a, step_b, ratio`` for all pairs of steps of ``path(step, lambda, id, strength)``: the largest difference of a strength over the sum of penalties."""
    steps = path.select("step", "lambda").distinct()
    a, b = steps.alias("a"), steps.alias("b")
    pairs = a.join(b, F.expr("a.step < b.step")).select(F.col("a.step").alias("step_a"), F.col("a.lambda").alias("la"), F.col("b.step").alias("step_b"), F.col("b.lambda").alias("lb"))
    left = pairs.join(path.select(F.col("step").alias("step_a"), "id", F.col("strength").alias("sa")), "step_a").select("step_a", "step_b", "la", "lb", "id", "sa")
    right = pairs.join(path.select(F.col("step").alias("step_b"), "id", F.col("strength").alias("sb")), "step_b").select("step_a", "step_b", "la", "lb", "id", "sb")
    both = left.join(right, ["step_a", "step_b", "la", "lb", "id"], "full_outer")
    worst = both.groupBy("step_a", "step_b", "la", "lb").agg(F.max(F.abs(F.coalesce("sa", F.lit(0.0)) - F.coalesce("sb", F.lit(0.0)))).alias("diff"))
    return worst.select("step_a", "step_b", (F.col("diff") / (F.col("la") + F.col("lb"))).alias("ratio"))


def may_continue(path: DataFrame, bound: float = BOUND) -> bool:
    return distances(path).filter(F.col("ratio") > bound).isEmpty()


def agree(trail: list[tuple[float, dict[int, float]]], penalty: float, solution: dict[int, float], bound: float = BOUND) -> bool:
    """Whether a new solution differs from none of the earlier ones by more than ``bound`` times the sum of both penalties, in any strength.

    Solutions hold active effects only, and only the new pairs of steps are looked at.
    """
    return all(max((abs(solution.get(e, 0.0) - b.get(e, 0.0)) for e in solution.keys() | b.keys()), default=0.0) <= bound * (penalty + lam) for lam, b in trail)
