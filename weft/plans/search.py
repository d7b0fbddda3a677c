"""The search of the product space at one step of a path."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.ids import effect_columns, effect_number, pair_id, triple_id
from weft.operators import dedupe, encode, prune, screen, solve
from weft.plans.state import FitConfig, FitState
from weft.sources.scratch import Scratch

#: New effects of one step that the driver takes at most; more are an error.
MOST_FOUND = 200_000
#: Rows whose pairs are counted to learn that effects are many.
PROBED = 64


def _number(i: Column, j: Column, k: Column, p: int) -> Column:
    return F.when(j.isNull(), i.cast("long")).when(k.isNull(), pair_id(i, j, p)).otherwise(triple_id(i, j, k, p))


def _row(what: int, a: Column, b: Column | None, s: Column, w: Column, when: Column | None = None) -> Column:
    """A row of what a screen tells, or null unless ``when`` holds."""
    cells = (F.lit(what).alias("what"), a.cast("long").alias("a"), (F.lit(None) if b is None else b).cast("long").alias("b"), s.cast("double").alias("s"), w.cast("double").alias("w"))
    return F.struct(*cells) if when is None else F.when(when, F.struct(*cells))


def _size(w: Column) -> Column:
    """Sizes of about the same root together."""
    return F.floor(2 * F.log2(w))


class Search:
    """The product space of one matrix; tells which effects exceed a threshold.

    If all effects that have rows are few, their inner products are computed
    once and tell the sums at every step. Else a step sums the residuals over
    each column, which also bounds the sums of all products with it; only
    columns whose bound exceeds the threshold are multiplied, and at depth 3
    only triples of which all pairs' bounds do. What a column's products came to
    is remembered with the step, and the residuals of the steps that anything
    remembered goes back to are made again from their effects, together with
    the present ones.

    With ``check_duplicates`` columns equal to an earlier one are left out from
    the start, and a table of effects that were found equal to an active one is
    kept and taken out of every screen.

    A step also leaves, by size of effect, the largest sum of those that stayed
    below. As no sum moves by more than the root of its effect's size times the
    norm of the residuals' change, that tells when a later step needs no screen.

    Of a matrix of ones all rows with the same columns are one row, which knows
    how many they are and the sum of their responses. A search reads the data
    once for that; what it looks at afterwards grows with the sets of columns.
    """

    def __init__(self, x: DataFrame, y: DataFrame, p: int, config: FitConfig, state: FitState | None = None) -> None:
        self.spark, self.scratch, self.rows = x.sparkSession, Scratch(x.sparkSession), None
        self.totals = solve.response_sums(y)
        if not config.continuous:
            self.rows = self.scratch.put(screen.collapsed(x, y))
            x = self.rows.select("row_id", "n", F.explode("cells").alias("col_id")).withColumn("val", F.lit(1.0))
            y = self.rows.filter("m > 0").select("row_id", "y", F.col("m").alias("n"))
        self.full, self.y, self.p, self.config = x.repartition("row_id").persist(), y.persist(), p, config
        self.x = self.full
        if config.check_duplicates and config.max_interaction_distance is None:
            copies = self.scratch.put(dedupe.classes(dedupe.prints(self.full, p)).filter("id <> rep").select(F.col("id").cast("int").alias("col_id")))
            if copies.count():
                self.x = encode.without_columns(self.full, copies).repartition("row_id").persist()
        self.whole: solve.Gram | None = None
        tables = state.tables if state else {}
        self.history: list[tuple[int, dict[int, float], float]] = list(state.history) if state and tables else []
        self.columns, self.pairs, self.skip, self.marks = (self.scratch.put(tables[k]) if k in tables else None for k in ("columns", "pairs", "skip", "marks"))
        self.shared = False
        self.stale: list[DataFrame | None] = []
        #: For each step that looked at products: columns that were multiplied, and all columns.
        self.looked: list[tuple[int, int]] = []
        self.screens = 0
        self.quiet: tuple[list[tuple[float, float]], dict[int, float], float] | None = None
        self.reach = None
        found = self._all_effects()
        if found is not None:
            if self.rows is None or config.max_interaction_distance is not None:
                self.whole = solve.gram(solve.effect_rows(self.x, found, p), self.y, found, self.totals)
            else:
                own = screen.packed(self.x, True, "n").join(self.y.select("row_id", "y", F.col("n").alias("m")), "row_id", "left").fillna(0.0, ["y", "m"])
                self.whole = solve.gram_of_sets(own, found, p, self.totals)
            self.place = {e: k for k, e in enumerate(found)}
            return
        if config.continuous:
            most = encode.overall_max(self.x).first()[0] or 0.0
            self.reach = float(max(most, most**2) if config.depth == 3 else most)
        longest = self.x.groupBy("row_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        self.grid = screen.GRID if longest > screen.GRID[0] else None

    def close(self) -> None:
        self.full.unpersist()
        self.x.unpersist()
        self.y.unpersist()
        if not self.shared:
            self.scratch.drop(self.columns, self.pairs, self.skip, self.marks)
        self.scratch.drop(self.rows)

    def tables(self) -> dict[str, DataFrame]:
        """What is remembered, to be stored with a state."""
        return {k: t for k, t in (("columns", self.columns), ("pairs", self.pairs), ("skip", self.skip), ("marks", self.marks)) if t is not None}

    def _all_effects(self) -> list[int] | None:
        """All effects that have rows, in order, if they are few enough.

        The pairs of a few rows tell cheaply that there are more.
        """
        c, binary = self.config, not self.config.continuous
        if self.p > c.ahead:
            return None
        if c.depth > 1:
            some = screen.products(screen.packed(self.x, binary).limit(PROBED), 2, c.max_interaction_distance, binary, [])
            if some.select("i", "j").distinct().count() > c.ahead:
                return None
        out: list[int] = []
        for screened in (screen.main_screen, screen.pair_screen, screen.triple_screen)[: c.depth]:
            whole = screened(self.x, self.y) if screened is screen.main_screen else screened(self.x, self.y, c.max_interaction_distance, binary=binary)
            rows = whole.drop("nz", "s").limit(c.ahead + 1).collect()
            out += [effect_number(tuple(r), self.p) for r in rows]
            if len(out) > c.ahead:
                return None
        return sorted(out)

    def over(self, state: FitState, limit: float, inner: solve.Gram | solve.BlockGram | None = None) -> tuple[list[int], dict[int, int], float]:
        """Numbers of the effects that aren't active and whose sum of residuals exceeds the limit; active ones that one of these is to stand for; and a value that no sum exceeds.

        ``inner``, products of the active effects, saves a pass over the residuals.
        """
        if self.whole is not None:
            m = self.whole
            beta = np.zeros(len(m.ids))
            for e, b in state.beta.items():
                beta[self.place[e]] = b
            sums = np.abs(m.g @ beta + state.intercept * m.sums - m.c)
            allowed = np.array([self.allowed(e, state) for e in m.ids], dtype=bool)
            sums = np.where(allowed, sums, 0.0)
            active = set(state.active)
            return [m.ids[k] for k in np.flatnonzero(sums > limit) if m.ids[k] not in active], {}, float(sums.max(initial=0.0))
        self.screens += 1
        held: list[DataFrame] = []
        try:
            return self._over(state, limit, inner, held)
        finally:
            for t in held:
                t.unpersist()
            # only now nothing of the step can be asked to be made again from these
            if not self.shared:
                self.scratch.drop(*self.stale)
            self.stale = []

    def _over(self, state: FitState, limit: float, inner: solve.Gram | solve.BlockGram | None, held: list[DataFrame]) -> tuple[list[int], dict[int, int], float]:
        c = self.config
        fits = [(state.beta, state.intercept), *((b, a) for _, b, a in self.history)]
        steps = [t for t, _, _ in self.history]
        told = self._hold(solve.residuals(self.x, self.y, fits, self.p), held)
        alphas = self._alphas(told, fits, inner)
        weight = F.col("r0") if self.reach is None else F.col("val") * F.col("r0")
        per = self.x.drop("n").join(told, "row_id").groupBy("col_id").agg(F.sum(F.col("val") * F.col("val") * solve.weight(told)).alias("w"), F.sum(weight).alias("s"), *prune.rests(alphas, "val", self.reach))
        columns = self._hold(prune.bounds(per, self.columns, ["col_id"], steps, alphas), held)
        # a row for each step that columns go back to
        open_ = F.col("bound") > limit
        groups = columns.groupBy("step").agg(F.count("*").alias("n"), F.sum(open_.cast("long")).alias("live"), F.max(F.abs("s")).alias("top"), F.max(F.when(~open_, F.col("bound"))).alias("closed")).collect()
        n, live = sum(r["n"] for r in groups), sum(r["live"] for r in groups)
        top, closed = (float(max((r[k] for r in groups if r[k] is not None), default=0.0)) for k in ("top", "closed"))
        known = self.spark.createDataFrame([(e,) for e in state.active], "id long")
        known = (known if self.skip is None else known.unionAll(self.skip)).withColumn("known", F.lit(True))
        grown = 1.0 if self.reach is None else max(1.0, self.reach**2)
        numbered = columns.select(F.col("col_id").cast("long").alias("id"), "s", "w", "bound")
        shut = _row(3, _size(F.col("w") * grown), None, F.col("bound"), F.col("w") * grown, (F.col("bound") <= limit) & (F.col("w") > 0) & F.lit(c.depth > 1 and not c.hierarchy))
        # every column that is multiplied is told of, whether or not it has a product
        tried = _row(1, F.col("id"), None, F.lit(0.0), F.lit(0.0), (F.col("bound") > limit) & F.lit(c.depth > 1 and not c.hierarchy))
        parts, live = [self._tagged(numbered, known, limit, shut, tried)], live if c.depth > 1 and not c.hierarchy else 0
        if c.depth > 1 and n:
            if c.hierarchy:
                parts.append(self._hold(self._tagged(self._below_mains(state, told), known, limit, _row(1, F.lit(0), None, F.abs("s"), F.lit(0.0))), held))
            else:
                top = max(top, closed)
                self.looked.append((live, n))
                if live:
                    parts.append(self._multiply(columns, told, limit, steps, alphas, known, held))
        # new effects, the largest sums below the limit by size, and the largest of all, in one query
        every = parts[0]
        for part in parts[1:]:
            every = every.unionAll(part)
        summed = every.filter("what > 0").groupBy("what", F.when(F.col("what") == 3, F.col("a")).alias("a")).agg(F.max("s").alias("s"), F.max("w").alias("w"))
        new = every.filter("what = 0").limit(1 if c.check_duplicates else MOST_FOUND + 1)
        rows = summed.unionAll(new.select("what", "a", "s", "w")).collect()
        top = max([top, *(r["s"] for r in rows if r["what"] in (1, 2) and r["s"] is not None)])
        self.quiet = None if c.hierarchy else ([(r["w"], r["s"]) for r in rows if r["what"] == 3], dict(state.beta), state.intercept)
        found, replaced = sorted(r["a"] for r in rows if r["what"] == 0), {}
        if len(found) > MOST_FOUND and not c.check_duplicates:
            raise ValueError(f"more than {MOST_FOUND} new effects exceed the threshold at one step")
        if live:
            self._remember(state, every, limit, closed, {r["step"]: r["n"] - r["live"] for r in groups})
        if found and c.check_duplicates:
            found, replaced = self._different(every.filter("what = 0").select(F.col("a").alias("id")), state)
        return found, replaced, top

    def _hold(self, df: DataFrame, held: list[DataFrame]) -> DataFrame:
        """Kept until the step ends; what is lost with an executor is made again."""
        held.append(df.persist())
        return df

    def _tagged(self, effects: DataFrame, known: DataFrame, limit: float, *more: Column) -> DataFrame:
        """``what, a, b, s, w`` from ``effects(id, s, w)``: numbers ``a`` of those over the limit (0), and by size ``a`` the largest sums below it (3), both without ``known(id, known)``; and ``more`` such rows."""
        fresh, s = F.col("known").isNull(), F.abs("s")
        own = [_row(0, F.col("id"), None, s, F.col("w"), fresh & (s > limit)), _row(3, _size(F.col("w")), None, s, F.col("w"), fresh & (s <= limit) & (F.col("w") > 0))]
        each = effects.join(known, "id", "left").select(F.explode(F.array_compact(F.array(*own, *more))).alias("r")).select("r.*")
        return each.groupBy("what", "a", "b").agg(F.max("s").alias("s"), F.max("w").alias("w"))

    def _different(self, new: DataFrame, state: FitState) -> tuple[list[int], dict[int, int]]:
        """Of the new effects those that equal none of smaller number, and the active ones that these stand for; the others go to the table of effects to skip."""
        own = ["nz", "one", "two"]
        new = self.scratch.put(new)
        if self.marks is None and state.active:
            active = self.spark.createDataFrame([(e,) for e in state.active], "id long")
            self.marks = self.scratch.put(dedupe.marks(solve.rows_of_effects(self.x, active, self.p)))
        fresh = dedupe.marks(solve.rows_of_effects(self.x, new, self.p)).withColumn("old", F.lit(False))
        both = fresh if self.marks is None else fresh.unionByName(self.marks.withColumn("old", F.lit(True)))
        reps = both.groupBy(*own).agg(F.min("id").alias("rep"), F.min(F.when(F.col("old"), F.col("id"))).alias("was"))
        told = self.scratch.put(fresh.join(reps, own))
        found = told.filter("id = rep")
        rows = found.select("id", "was").limit(MOST_FOUND + 1).collect()
        if len(rows) > MOST_FOUND:
            raise ValueError(f"more than {MOST_FOUND} effects over the threshold at one step are new and differ")
        shadows = told.filter("id <> rep").select("id").unionAll(found.filter("was > id").select(F.col("was").alias("id")))
        before = [self.skip, self.marks]
        self.skip = self.scratch.put(shadows if self.skip is None else shadows.unionAll(self.skip))
        kept = found.select("id", *own)
        if self.marks is not None:
            kept = kept.unionByName(self.marks.join(found.select(F.coalesce("was", "id").alias("id")), "id", "left_anti"))
        self.marks = self.scratch.put(kept)
        self.scratch.drop(new, told)
        self.stale += before
        return sorted(r["id"] for r in rows), {r["was"]: r["id"] for r in rows if r["was"] is not None and r["was"] > r["id"]}

    def still(self, state: FitState, limit: float, m: solve.Gram | None) -> bool:
        """Whether no effect that isn't active can exceed the limit, by what the last screen left and the change since."""
        if self.whole is not None or self.quiet is None:
            return False
        largest, beta, intercept = self.quiet
        moved = solve.residual_change(m, beta, intercept, state.beta, state.intercept, self.totals[0])
        return moved is not None and all(s + np.sqrt(w) * moved <= limit for w, s in largest)

    def sums(self, effects: list[int], state: FitState) -> dict[int, float]:
        """The sums of residuals of some effects."""
        if not effects:
            return {}
        now = solve.residuals(self.x, self.y, [(state.beta, state.intercept)], self.p)
        rows = solve.effect_rows(self.x, effects, self.p).drop("n").join(now, "row_id").groupBy("id").agg(F.sum(F.col("val") * F.col("r0")).alias("s"))
        return {r["id"]: r["s"] for r in rows.collect()}

    def _alphas(self, told: DataFrame, fits: list[tuple[dict[int, float], float]], inner: solve.Gram | solve.BlockGram | None) -> list[float]:
        """How much of the residuals of each earlier step is in the present ones."""
        earlier = len(fits) - 1
        if not earlier:
            return []
        known = solve.residual_products(inner, fits, self.totals)
        if known is not None:
            return [float(known[0, k] / known[k, k]) if known[k, k] > 0 else 0.0 for k in range(1, earlier + 1)]
        got = told.agg(*(F.sum(F.col("r0") * F.col(f"r{k}")) for k in range(1, earlier + 1)), *(F.sum(F.col(f"r{k}") ** 2) for k in range(1, earlier + 1))).first()
        return [float(got[k] or 0.0) / float(got[earlier + k]) if got[earlier + k] else 0.0 for k in range(earlier)]

    def _below_mains(self, state: FitState, told: DataFrame) -> DataFrame:
        """``id, s`` of the products whose later columns, or all of them, are among the non-zero mains; others are never made."""
        c, binary = self.config, not self.config.continuous
        mains = [(e,) for e, b in state.beta.items() if e < self.p and b]
        later = self.x.join(F.broadcast(self.spark.createDataFrame(mains, "col_id int")), "col_id", "left_semi")
        first, now = later if c.hierarchy == "strong" else self.x, told.select("row_id", F.col("r0").alias("y"))
        none = F.lit(None).cast("int")
        screened = screen.pair_screen_by_join(first, now, c.max_interaction_distance, binary=binary, later=later).select("i", "j", none.alias("k"), "s")
        if c.depth > 2:
            screened = screened.unionAll(screen.triple_screen_by_join(first, now, c.max_interaction_distance, binary=binary, later=later).select("i", "j", "k", "s"))
        return screened.select(_number(F.col("i"), F.col("j"), F.col("k"), self.p).alias("id"), "s", F.lit(0.0).alias("w"))

    def _multiply(self, columns: DataFrame, told: DataFrame, limit: float, steps: list[int], alphas: list[float], known: DataFrame, held: list[DataFrame]) -> DataFrame:
        """What ``_tagged`` tells of the products of the columns that may have one over the limit, with the largest sum of each column (1) and pair that is open (2).

        Each effect's sum is shuffled once and told on as a few rows, of which
        only the largest by key are shuffled again.
        """
        c, binary = self.config, not self.config.continuous
        live = prune.updateable(columns, limit)
        narrow = self.x.join(live, "col_id", "left_semi")
        weight, size = (F.col("r0"), F.sum(solve.weight(told))) if binary else (F.col("v") * F.col("r0"), F.sum(F.col("v") * F.col("v")))
        carried = [c for c in told.columns if c != "row_id"]
        rows = screen.packed(narrow, binary).join(told, "row_id")
        made = screen.products(rows, 2, c.max_interaction_distance, binary, carried, self.grid)
        sums, s = [F.sum(weight).alias("s"), size.alias("w")], F.abs("s")
        of = lambda *names: [_row(1, F.col(n), None, s, F.lit(0.0)) for n in names]
        if c.depth == 2:
            pairs = made.groupBy("i", "j").agg(*sums).withColumn("id", pair_id(F.col("i"), F.col("j"), self.p))
            return self._hold(self._tagged(pairs, known, limit, *of("i", "j")), held)
        pairs = made.groupBy("i", "j").agg(*sums, *prune.rests(alphas, "v", self.reach))
        pairs = self._hold(prune.bounds(pairs, self.pairs, ["i", "j"], steps, alphas), held)
        open_pairs = prune.updateable(pairs, limit, "i", "j")
        near = screen.pairs_by_join(narrow, c.max_interaction_distance).join(open_pairs, ["i", "j"], "left_semi")
        three = screen.triples_of_pairs(near, open_pairs, c.max_interaction_distance).join(told.drop(*carried[1 : len(steps) + 1]), "row_id")
        # triples with a closed pair stay below its bound
        grown = F.col("w") * (1.0 if self.reach is None else max(1.0, self.reach**2))
        shut = _row(3, _size(grown), None, F.col("bound"), grown, (F.col("bound") <= limit) & (F.col("w") > 0))
        tried = _row(2, F.col("i"), F.col("j"), F.lit(0.0), F.lit(0.0), F.col("bound") > limit)
        two = self._tagged(pairs.withColumn("id", pair_id(F.col("i"), F.col("j"), self.p)), known, limit, *of("i", "j"), shut, tried)
        triples = three.groupBy("i", "j", "k").agg(*sums).withColumn("id", triple_id(F.col("i"), F.col("j"), F.col("k"), self.p))
        inner = [_row(2, F.col(a), F.col(b), s, F.lit(0.0)) for a, b in (("i", "j"), ("i", "k"), ("j", "k"))]
        return self._hold(two.unionAll(self._tagged(triples, known, limit, *of("i", "j", "k"), *inner)), held)

    def _remember(self, state: FitState, every: DataFrame, limit: float, closed: float, users: dict[int | None, int]) -> None:
        """Brings what is known of columns and pairs up to date; ``users`` counts the columns that weren't multiplied by the step that they go back to.

        Products with what was left out are known to stay below the limit. The
        residuals of a step are kept as long as a column or pair goes back to
        it; of too many steps those that most do.
        """
        floor, step = F.lit(closed if self.config.depth == 2 else limit), F.lit(state.step).alias("step")
        largest = F.greatest(F.max("s"), floor).alias("last_max")
        key = lambda name: F.col("a" if name in ("col_id", "i") else "b").cast("int").alias(name)
        before = [self.columns, self.pairs]
        now = every.filter("what = 1").groupBy(key("col_id")).agg(largest).select("col_id", step, "last_max")
        self.columns = self.scratch.put(prune.remembered(self.columns, now))
        if self.config.depth > 2:
            now = every.filter("what = 2").groupBy(key("i"), key("j")).agg(largest).select("i", "j", step, "last_max")
            self.pairs = self.scratch.put(prune.remembered(self.pairs, now, "i", "j"))
            users = dict(users)
            for r in self.pairs.groupBy("step").agg(F.count("*").alias("n")).collect():
                users[r["step"]] = users.get(r["step"], 0) + r["n"]
        self.stale += [b for b, t in zip(before, (self.columns, self.pairs), strict=True) if b is not t]
        self.history = [*self.history, (state.step, dict(state.beta), state.intercept)]
        users[state.step] = users.get(state.step, 0) + 1
        kept = sorted((t for t, _, _ in self.history if users.get(t)), key=lambda t: (t != state.step, -users[t], -t))[: self.config.snapshots]
        self.history = [h for h in self.history if h[0] in kept]

    def allowed(self, e: int, state: FitState) -> bool:
        if self.config.hierarchy is None or e < self.p:
            return True
        columns = effect_columns(e, self.p)
        return all(state.beta.get(c) for c in (columns if self.config.hierarchy == "strong" else columns[1:]))

    def gram(self, ids: list[int]) -> solve.Gram | solve.BlockGram:
        if self.whole is not None:
            return self.whole.part(ids)
        z = solve.effect_rows(self.x, ids, self.p)
        if len(ids) <= self.config.most_active:
            return solve.gram(z, self.y, ids, self.totals)
        return solve.BlockGram(z, self.y, ids, self.totals, self.config.most_active, self.scratch)
