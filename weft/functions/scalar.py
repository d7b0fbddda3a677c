"""Scalar functions of the model, as column expressions and as numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def soft_threshold(z: Column, by: Column) -> Column:
    return F.signum(z) * F.greatest(F.abs(z) - by, F.lit(0.0))


def soft(z: float, by: float) -> float:
    return math.copysign(max(abs(z) - by, 0.0), z)


def phi_inverse(x: float) -> float:
    """An approximation of a normal quantile far out in the tail."""
    return math.sqrt(abs(2 * math.log(math.sqrt(2 * math.pi) * x)))


def candidates(p: int, depth: int, distance: int | None = None) -> int:
    """Mains, pairs and triples that a search of this depth looks at; the distance is inclusive."""
    d = p - 1 if distance is None else min(distance, p - 1)
    pairs = sum(min(d, p - 1 - i) for i in range(p))
    triples = sum(math.comb(min(d, p - 1 - i), 2) for i in range(p))
    return p + pairs * (depth > 1) + triples * (depth > 2)


def default_lambda_min(n: int, p: int, depth: int = 2, compat: bool = True) -> float:
    """The least penalty. The usual formula counts all three-way effects at any depth; ``compat=False`` counts those of the depth."""
    number = p * (p + 1) * (p - 1) / 6 if compat or depth == 3 else (p, p * (p + 1) / 2)[depth - 1]
    return 1.1 * math.sqrt(1 / n) * phi_inverse(0.95 / (2 * number))


def gap_bits(gap: Column) -> Column:
    """Bits that a gap needs."""
    return F.length(F.bin(gap))
