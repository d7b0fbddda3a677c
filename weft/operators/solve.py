"""Coordinate descent on inner products that Spark computes.

With G the inner products of all active columns, c theirs with the response and
the intercept as a column of ones, the gradient of a coordinate is
``c_k - sum_j G_kj beta_j + G_kk beta_k``. A sweep needs no pass over rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.ids import decode, effect_columns, order_of
from weft.functions.scalar import soft
from weft.operators.screen import products
from weft.sources.scratch import Scratch

@dataclass
class Gram:
    """Inner products of effects ``ids``; order and duplicates are the caller's."""

    ids: list[int]
    g: np.ndarray
    c: np.ndarray
    sums: np.ndarray
    n: int
    y_sum: float
    yy: float

    def part(self, ids: list[int]) -> Gram:
        place = {e: k for k, e in enumerate(self.ids)}
        at = [place[e] for e in ids]
        return Gram(list(ids), self.g[np.ix_(at, at)], self.c[at], self.sums[at], self.n, self.y_sum, self.yy)


def response_sums(y: DataFrame) -> tuple[int, float, float]:
    r = y.agg(F.count("*"), F.sum(F.col("y").cast("double")), F.sum(F.col("y").cast("double") * F.col("y"))).first()
    return int(r[0]), float(r[1] or 0.0), float(r[2] or 0.0)


def weight(df: DataFrame, of: str = "") -> Column:
    """How many rows of the data one of ``df`` stands for: its ``n``, or one."""
    return F.col(f"{of}n") if "n" in df.columns else F.lit(1.0)


def effect_rows(x: DataFrame, effects: list[int], p: int) -> DataFrame:
    """``id, row_id, val`` of the given effects, and ``n`` if ``x`` has it; their list is bounded by the active set."""
    spark, own = x.sparkSession, ["n"] if "n" in x.columns else []
    by_order: dict[int, list[tuple[int, ...]]] = {1: [], 2: [], 3: []}
    for e in effects:
        columns = effect_columns(e, p)
        by_order[len(columns)].append((e, *columns))
    parts = []
    for order, rows in by_order.items():
        if not rows:
            continue
        asked = F.broadcast(spark.createDataFrame(rows, "id long, " + ", ".join(f"c{k} int" for k in range(order))))
        out = x.select("row_id", *own, F.col("col_id").alias("c0"), F.col("val").alias("v0")).join(asked, "c0")
        for k in range(1, order):
            # only the columns asked for are moved
            some = x.select("row_id", F.col("col_id").alias(f"c{k}"), F.col("val").alias(f"v{k}")).join(F.broadcast(asked.select(f"c{k}").distinct()), f"c{k}", "left_semi")
            out = out.join(some, ["row_id", f"c{k}"])
        value = F.col("v0")
        for k in range(1, order):
            value = value * F.col(f"v{k}")
        parts.append(out.select("id", "row_id", value.alias("val"), *own))
    z = parts[0] if parts else spark.createDataFrame([], "id long, row_id long, val double" + ", n double" * len(own))
    for part in parts[1:]:
        z = z.unionAll(part)
    return z


def rows_of_effects(x: DataFrame, effects: DataFrame, p: int) -> DataFrame:
    """``id, row_id, val`` of ``effects(id)``, of which there may be any number."""
    names = ("i", "j", "k")
    asked = effects.select("id", order_of(F.col("id"), p).alias("ord"), *(c.cast("int").alias(n) for c, n in zip(decode(F.col("id"), p), names, strict=True)))
    out = None
    for order in (1, 2, 3):
        z = asked.filter(F.col("ord") == order)
        for k, name in enumerate(names[:order]):
            cells = x.select("row_id", F.col("col_id").alias(name), F.col("val").alias(f"v{k}"))
            z = z.join(cells, name if not k else ["row_id", name])
        value = F.col("v0")
        for k in range(1, order):
            value = value * F.col(f"v{k}")
        z = z.select("id", "row_id", value.alias("val"))
        out = z if out is None else out.unionAll(z)
    return out


def inner_products(z: DataFrame) -> DataFrame:
    """``p, q, g`` for effects p <= q of ``z(id, row_id, val)`` that share a row."""
    a, b = z.alias("a"), z.alias("b")
    met = a.join(b, F.expr("a.row_id = b.row_id AND a.id <= b.id"))
    return met.groupBy(F.col("a.id").alias("p"), F.col("b.id").alias("q")).agg(F.sum(F.col("a.val") * F.col("b.val") * weight(z, "a.")).alias("g"))


def gram(z: DataFrame, y: DataFrame, ids: list[int], totals: tuple[int, float, float]) -> Gram:
    """One job over the rows of the active effects; the driver gets a number for each pair of them."""
    place = {e: k for k, e in enumerate(ids)}
    g = np.zeros((len(ids), len(ids)))
    c, sums = np.zeros(len(ids)), np.zeros(len(ids))
    if ids:
        # as arrays: a row object for each pair would take a hundred times the room
        met = inner_products(z).toArrow()
        order = np.argsort(np.array(ids))
        p, q = (order[np.searchsorted(np.array(ids)[order], met.column(k).to_numpy())] for k in ("p", "q"))
        g[p, q] = g[q, p] = met.column("g").to_numpy()
    for e, value, total in response_products(z, y).collect():
        c[place[e]], sums[place[e]] = value, total
    n, y_sum, yy = totals
    return Gram(list(ids), g, c, sums, n, y_sum, yy)


def response_products(z: DataFrame, y: DataFrame) -> DataFrame:
    """For each effect of ``z(id, row_id, val)`` its inner product with the response, and its sum over rows that have one."""
    met = z.drop("n").join(y, "row_id")
    return met.groupBy("id").agg(F.sum(F.col("val") * F.col("y")).alias("c"), F.sum(F.col("val") * weight(y)).alias("total"))


def gram_of_sets(rows: DataFrame, ids: list[int], p: int, totals: tuple[int, float, float]) -> Gram:
    """The inner products of ``gram`` for a matrix of ones, from ``rows(cells, n, y, m)``.

    Two effects share the rows that have the columns of both, so that a count
    for each set of columns tells them; a set is made once in a row, not once
    for each two effects that it is the union of.
    """
    columns = [effect_columns(e, p) for e in ids]
    deepest = max(map(len, columns), default=0)
    c, sums, counts = np.zeros(len(ids)), np.zeros(len(ids)), {}
    place = {frozenset(s): k for k, s in enumerate(columns)}
    told = None
    for order in range(1, 2 * deepest + 1):
        made = products(rows, order, None, True, ["n", "y", "m"])
        keys = made.columns[3:-1]
        one = made.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("y").alias("y"), F.sum("m").alias("m")).select(F.array(*keys).alias("s"), "n", "y", "m")
        told = one if told is None else told.unionAll(one)
    if told is not None:
        got = told.toArrow()
        ends, flat = got.column("s").combine_chunks().offsets.to_numpy().tolist(), got.column("s").combine_chunks().flatten().to_numpy().tolist()
        for k, (n, y, m) in enumerate(zip(*(got.column(v).to_numpy().tolist() for v in ("n", "y", "m")), strict=True)):
            s = frozenset(flat[ends[k] : ends[k + 1]])
            counts[s] = n
            if (at := place.get(s)) is not None:
                c[at], sums[at] = y, m
    g, sets = np.zeros((len(ids), len(ids))), [frozenset(s) for s in columns]
    for k, s in enumerate(sets):
        g[k, k:] = g[k:, k] = [counts.get(s | t, 0.0) for t in sets[k:]]
    return Gram(list(ids), g, c, sums, *totals)


class BlockGram:
    """Inner products of more effects than the driver holds, as a table in blocks of ``block`` effects, and what sweeps need of it.

    A sweep takes the blocks in turn. Of a block's rows the driver gets the
    products within the block and, summed by Spark, what the other effects'
    strengths come to; the coordinates of the block then follow one another as
    in any sweep. The driver also has three numbers for each effect.
    """

    def __init__(self, z: DataFrame, y: DataFrame, ids: list[int], totals: tuple[int, float, float], block: int, scratch: Scratch) -> None:
        self.ids, self.block, self.spark = list(ids), block, z.sparkSession
        self.n, self.y_sum, self.yy = totals
        place = {e: k for k, e in enumerate(ids)}
        at = F.broadcast(self.spark.createDataFrame(list(place.items()), "e long, at int"))
        half = inner_products(z)
        full = half.unionAll(half.filter("p <> q").select("q", "p", "g"))
        full = full.join(at.withColumnsRenamed({"e": "p", "at": "row"}), "p").join(at.withColumnsRenamed({"e": "q", "at": "col"}), "q")
        path = scratch.path()
        full.select("row", "col", "g", F.floor(F.col("row") / block).cast("int").alias("part")).repartition("part", "row").write.partitionBy("part").parquet(path)
        self.table = self.spark.read.parquet(path)
        self.c, self.sums, self.size = (np.zeros(len(ids)) for _ in range(3))
        for e, value, total in response_products(z, y).collect():
            self.c[place[e]], self.sums[place[e]] = value, total
        for k, g in self.table.filter("row = col").select("row", "g").collect():
            self.size[k] = g

    def _strengths(self, beta: np.ndarray) -> DataFrame:
        return F.broadcast(self.spark.createDataFrame([(int(k), float(beta[k])) for k in np.flatnonzero(beta)], "col int, b double"))

    def sweep(self, beta: np.ndarray, intercept: float, limit: float, use_intercept: bool) -> float:
        if use_intercept and self.n:
            intercept = (self.y_sum - float(self.sums @ beta)) / self.n
        for part in range(-(-len(beta) // self.block)):
            low, high = part * self.block, min((part + 1) * self.block, len(beta))
            rows = self.table.filter(F.col("part") == part)
            inside = F.col("col").between(low, high - 1)
            g, rest = np.zeros((high - low, high - low)), np.zeros(high - low)
            own = rows.filter(inside).select("row", "col", "g").toArrow()
            g[own.column("row").to_numpy() - low, own.column("col").to_numpy() - low] = own.column("g").to_numpy()
            others = rows.filter(~inside).join(self._strengths(beta), "col").groupBy("row").agg(F.sum(F.col("g") * F.col("b")).alias("s")).toArrow()
            rest[others.column("row").to_numpy() - low] = others.column("s").to_numpy()
            sweep(Gram(self.ids[low:high], g, self.c[low:high] - rest, self.sums[low:high], self.n, self.y_sum, self.yy), beta[low:high], intercept, limit, False)
        return intercept

    def norm(self, beta: np.ndarray, intercept: float) -> float:
        b = self._strengths(beta)
        both = self.table.join(b, "col").join(b.withColumnsRenamed({"col": "row", "b": "a"}), "row").agg(F.sum(F.col("g") * F.col("a") * F.col("b"))).first()[0] or 0.0
        fit = self.yy - 2 * self.c @ beta + both + intercept * (intercept * self.n + 2 * self.sums @ beta - 2 * self.y_sum)
        return float(np.sqrt(max(fit, 0.0)))


@dataclass
class Solution:
    beta: np.ndarray
    intercept: float = 0.0
    error: float = 0.0  # norm of the residuals
    sweeps: int = 0
    trace: list[float] = field(default_factory=list)


def residual_norm(m: Gram | BlockGram, beta: np.ndarray, intercept: float) -> float:
    if isinstance(m, BlockGram):
        return m.norm(beta, intercept)
    fit = m.yy - 2 * m.c @ beta + beta @ m.g @ beta + intercept * (intercept * m.n + 2 * m.sums @ beta - 2 * m.y_sum)
    return float(np.sqrt(max(fit, 0.0)))


def residual_change(m: Gram | BlockGram | None, before: dict[int, float], intercept: float, after: dict[int, float], then: float, n: int) -> float | None:
    """The norm of the difference of two fits' residuals; none where an effect's inner products aren't at hand."""
    moved = {e: after.get(e, 0.0) - before.get(e, 0.0) for e in before.keys() | after.keys()}
    moved = {e: d for e, d in moved.items() if d}
    shift = then - intercept
    if not moved:
        return abs(shift) * float(np.sqrt(n))
    if not isinstance(m, Gram) or not moved.keys() <= set(m.ids):
        return None
    place = {e: k for k, e in enumerate(m.ids)}
    d = np.zeros(len(m.ids))
    for e, x in moved.items():
        d[place[e]] = x
    return float(np.sqrt(max(d @ m.g @ d + 2 * shift * m.sums @ d + n * shift**2, 0.0)))


def residual_products(m: Gram | BlockGram | None, fits: list[tuple[dict[int, float], float]], totals: tuple[int, float, float]) -> np.ndarray | None:
    """Inner products of the residuals of ``fits``, effects and an intercept each; none where an effect's inner products aren't at hand."""
    ids = m.ids if isinstance(m, Gram) else []
    if not {e for beta, _ in fits for e, b in beta.items() if b} <= set(ids):
        return None
    n, y_sum, yy = totals
    b, a = np.array([[beta.get(e, 0.0) for e in ids] for beta, _ in fits]).reshape(len(fits), len(ids)), np.array([x for _, x in fits])
    g, c, sums = (m.g, m.c, m.sums) if ids else (np.zeros((0, 0)), np.zeros(0), np.zeros(0))
    s, t = b @ sums, b @ c + a * y_sum
    return b @ g @ b.T + np.outer(a, s) + np.outer(s, a) + n * np.outer(a, a) - t[:, None] - t[None, :] + yy


def residual_sums(r: DataFrame, value: str = "r") -> DataFrame:
    """``n, total, norm`` of residuals: their count, their sum, and the root of the sum of their squares."""
    v = F.col(value).cast("double")
    return r.agg(F.count(value).alias("n"), F.coalesce(F.sum(v), F.lit(0.0)).alias("total"), F.sqrt(F.coalesce(F.sum(v * v), F.lit(0.0))).alias("norm"))


def plain_limit(penalty: float, n: int) -> float:
    """The threshold of the plain lasso, which knows no norm of residuals: the penalty for each row."""
    return penalty * n


def sweep(m: Gram | BlockGram, beta: np.ndarray, intercept: float, limit: float, use_intercept: bool) -> float:
    """One pass over all coordinates in order, in place; the intercept first and without penalty."""
    if isinstance(m, BlockGram):
        return m.sweep(beta, intercept, limit, use_intercept)
    if use_intercept and m.n:
        intercept = (m.y_sum - float(m.sums @ beta)) / m.n
    for k in range(len(beta)):
        s = m.g[k, k]
        if s <= 0:
            continue
        u = m.c[k] - m.g[k] @ beta - intercept * m.sums[k] + s * beta[k]
        beta[k] = soft(float(u), limit) / s
    return intercept


def descend(m: Gram | BlockGram, beta: np.ndarray, intercept: float, limit: float, halt: float, use_intercept: bool = True, most: int = 100) -> Solution:
    """Sweeps until the norm of the residuals falls by less than the factor ``halt``, ``most`` at most."""
    beta = beta.copy()
    before = residual_norm(m, beta, intercept)
    for done in range(1, most + 1):
        intercept = sweep(m, beta, intercept, limit, use_intercept)
        error = residual_norm(m, beta, intercept)
        if error <= 1e-12 or before / error < halt:
            break
        before = error
    return Solution(beta, intercept, residual_norm(m, beta, intercept), done if most else 0)


def least_squares(m: Gram | BlockGram, use_intercept: bool = True) -> Solution:
    """The unpenalised fit by normal equations; of several, the shortest. In blocks, by sweeps."""
    if isinstance(m, BlockGram):
        return descend(m, np.zeros(len(m.ids)), 0.0, 0.0, 1 + 1e-9, use_intercept)
    if use_intercept:
        g = np.block([[m.g, m.sums[:, None]], [m.sums[None, :], np.array([[float(m.n)]])]])
        solved = np.linalg.lstsq(g, np.append(m.c, m.y_sum), rcond=None)[0]
        beta, intercept = solved[:-1], float(solved[-1])
    else:
        beta, intercept = np.linalg.lstsq(m.g, m.c, rcond=None)[0], 0.0
    return Solution(beta, intercept, residual_norm(m, beta, intercept))


def residuals(x: DataFrame, y: DataFrame, fits: list[tuple[dict[int, float], float]], p: int) -> DataFrame:
    """``row_id, r0, r1, ...``: fitted values less the response for each of ``fits``, effects and an intercept; one pass for all.

    A row of ``y`` that stands for ``n`` has the sum of their residuals, and keeps ``n``.
    """
    ids = sorted({e for beta, _ in fits for e in beta})
    own = ["n"] if "n" in y.columns else []
    out = y.select("row_id", "y", *own)
    if ids:
        strengths = F.broadcast(x.sparkSession.createDataFrame([(e, [float(beta.get(e, 0.0)) for beta, _ in fits]) for e in ids], "id long, b array<double>"))
        parts = effect_rows(x, ids, p).join(strengths, "id").groupBy("row_id").agg(*(F.sum(F.col("val") * F.col("b")[k]).alias(f"f{k}") for k in range(len(fits))))
        out = out.join(parts, "row_id", "left")
    fitted = lambda k: F.coalesce(F.col(f"f{k}"), F.lit(0.0)) if ids else F.lit(0.0)
    return out.select("row_id", *((weight(y) * (fitted(k) + F.lit(float(a))) - F.col("y")).alias(f"r{k}") for k, (_, a) in enumerate(fits)), *own)


def row_products_without(x: DataFrame, beta: DataFrame, column: int) -> DataFrame:
    """``row_id, s``: for each row the sum of its values times ``beta(col_id, strength)``, the given column left out."""
    return x.filter(F.col("col_id") != column).join(beta.select("col_id", "strength"), "col_id").groupBy("row_id").agg(F.sum(F.col("val") * F.col("strength")).alias("s"))


def predict(x: DataFrame, effects: dict[int, float], intercept: float, rows: DataFrame, p: int) -> DataFrame:
    """``row_id, fitted`` for each of ``rows(row_id)``."""
    spark = x.sparkSession
    if not effects:
        return rows.select("row_id", F.lit(intercept).alias("fitted"))
    strength = F.broadcast(spark.createDataFrame([(e, float(b)) for e, b in effects.items()], "id long, b double"))
    parts = effect_rows(x, list(effects), p).join(strength, "id").groupBy("row_id").agg(F.sum(F.col("val") * F.col("b")).alias("f"))
    return rows.select("row_id").join(parts, "row_id", "left").select("row_id", (F.coalesce("f", F.lit(0.0)) + intercept).alias("fitted"))
