"""The search of the product space and the path over it: against plain versions and against the unlimited fit."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.functions.ids import effect_number
from weft.operators import dedupe, screen, solve
from weft.plans import path as path_module
from weft.plans import search as search_module
from weft.plans.path import FitConfig, FitState, fit, sweep_order
from weft.plans.search import Search
from weft.sources import checkpoint
from weft.sources.scratch import Scratch


def cells(spark, bits):
    return spark.createDataFrame([(r, c, 1.0) for r, row in enumerate(bits.tolist()) for c, v in enumerate(row) if v], "row_id long, col_id int, val double")


def response(spark, y):
    return spark.createDataFrame([(r, float(v)) for r, v in enumerate(y)], "row_id long, y double")


def strengths(result):
    return {r["id"]: r["strength"] for r in result.effects.collect()}


def by_step(result):
    out = {}
    for step, _, e, b in result.path:
        out.setdefault(step, {})[e] = b
    return out


def planted(seed, n=120, p=8, density=0.5):
    rng = np.random.default_rng(seed)
    bits = (rng.random((n, p)) < density).astype(int)
    y = 4.0 * bits[:, 0] - 5.0 * bits[:, 1] * bits[:, 2] + rng.normal(0, 0.2, n)
    return bits, y


def highest(bits, y):
    return float(np.abs(bits.T @ y).max() / np.linalg.norm(y))


def test_long_row_goes_to_many_tasks(spark):
    """One row of 4000 columns: no task has more than a twentieth of its products."""
    x = spark.range(4000).select(F.lit(0).cast("long").alias("row_id"), F.col("id").cast("int").alias("col_id"), F.lit(1.0).alias("val"))
    made = screen.products(screen.packed(x, True), 2, None, True, [], screen.GRID)
    of_task = made.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in of_task) == 4000 * 3999 // 2
    assert max(r["count"] for r in of_task) < 0.05 * 4000 * 3999 / 2


@pytest.mark.parametrize(("distance", "binary"), [(None, True), (4, True), (None, False)])
def test_blocks_give_the_same_products(spark, distance, binary):
    rng = np.random.default_rng(4)
    rows = [(r, c, float(rng.integers(1, 5))) for r in range(12) for c in range(23) if rng.random() < (0.9 if r % 3 else 0.2)]
    x, y = spark.createDataFrame(rows, "row_id long, col_id int, val double"), response(spark, rng.integers(-9, 9, 12))
    for screened in (screen.pair_screen, screen.triple_screen):
        one, two = (sorted(map(tuple, screened(x, y, distance, binary=binary, grid=g).collect())) for g in (None, (5, 3)))
        assert one == two and one


@pytest.mark.parametrize("distance", [None, 3])
def test_equals_of_kept_effects_without_a_scan_of_all(spark, distance):
    """The same classes as prints of all effects give, from columns that cover the kept ones."""
    rng = np.random.default_rng(6)
    bits = (rng.random((40, 12)) < 0.25).astype(int)
    bits[:, 5] = bits[:, 2]
    bits[:, 7] = bits[:, 0] & bits[:, 3]
    bits[:, 9] = bits[:, 1] & bits[:, 4] & bits[:, 6]
    x, p = cells(spark, bits), 12
    kept = [effect_number(c, p) for c in ((2,), (7,), (9,), (0, 8), (1, 4, 6), (2, 3, 10)) if bits[:, list(c)].all(axis=1).any() and (distance is None or c[-1] - c[0] <= distance)]
    members, looked = dedupe.contained(x, solve.effect_rows(x, kept, p), p, 3, distance, Scratch(spark))
    got = {}
    for r in members.collect():
        got.setdefault(r["kept"], set()).add(r["id"])
    rows = {c: bits[:, list(c)].all(axis=1) for k in (1, 2, 3) for c in itertools.combinations(range(p), k) if distance is None or c[-1] - c[0] <= distance}
    number = {effect_number(c, p): c for c in rows}
    assert got == {e: {f for f, c in number.items() if (rows[c] == rows[number[e]]).all()} for e in kept}
    assert looked < 0.3 * len(kept) * len(rows)
    assert {r["rep"] for r in dedupe.classes_of(members).collect()} == {min(g, key=lambda f: (len(number[f]), f)) for g in got.values()}


def test_equal_effects_never_reach_the_driver(spark, monkeypatch):
    """Copies of columns and products equal to others take no place among the few effects that a step may take."""
    bits, y = planted(3, 80, 5)
    bits = np.hstack([bits, bits[:, [0, 0, 0, 1, 1, 2]]])
    x, y = cells(spark, bits), response(spark, y)
    top = highest(bits, np.array([r["y"] for r in y.orderBy("row_id").collect()]))
    options = {"depth": 2, "check_duplicates": True, "lambda_max": top * 0.9, "lambda_min": top * 0.8, "halt_error_diff": 1.0001}
    wide = fit(x, y, 11, FitConfig(ahead=0, **options))
    monkeypatch.setattr(search_module, "MOST_FOUND", 4)
    narrow = fit(x, y, 11, FitConfig(ahead=0, **options))
    assert by_step(narrow) == by_step(wide) and strengths(narrow).keys() <= {e for e in range(5)} | {effect_number(c, 11) for c in itertools.combinations(range(5), 2)}
    assert all(e < 5 or max(divmod(e, 11)[0] - 1, e % 11) < 5 for step in by_step(wide).values() for e in step)
    with monkeypatch.context() as patch:
        patch.setattr(search_module, "MOST_FOUND", 0)
        with pytest.raises(ValueError, match="new and differ"):
            fit(x, y, 11, FitConfig(ahead=0, **options))


def test_more_active_effects_than_the_driver_holds(spark):
    """In blocks of two effects the fit is the one that holds all inner products."""
    bits, y = planted(5, 60, 6)
    top = highest(bits, y)
    options = {"depth": 1, "lambda_max": top * 0.5, "max_lambdas": 2, "ahead": 0}
    one = fit(cells(spark, bits), response(spark, y), 6, FitConfig(**options))
    two = fit(cells(spark, bits), response(spark, y), 6, FitConfig(most_active=2, **options))
    assert one.most_at_once > 2
    assert [r[:-1] for r in one.path] == [r[:-1] for r in two.path]
    assert [r[-1] for r in two.path] == pytest.approx([r[-1] for r in one.path], rel=1e-9)


def test_effects_leave_and_come_back(spark):
    """An effect that stays at zero leaves the active set; solutions are the same, as it comes back when its sum exceeds the threshold."""
    rng = np.random.default_rng(12)
    bits = (rng.random((90, 9)) < 0.5).astype(int)
    bits[:, 1] = bits[:, 0] & (rng.random(90) < 0.9)
    y = 3.0 * bits[:, 0] + 1.0 * bits[:, 1] - 2.0 * bits[:, 2] * bits[:, 3] + rng.normal(0, 0.5, 90)
    top = highest(bits, y)
    options = {"depth": 2, "lambda_max": top, "max_lambdas": 12, "halt_error_diff": 1 + 1e-11, "ahead": 2000}
    states = {"all": [], "few": []}
    one = fit(cells(spark, bits), response(spark, y), 9, FitConfig(**options), save=states["all"].append)
    two = fit(cells(spark, bits), response(spark, y), 9, FitConfig(evict_after=1, **options), save=states["few"].append)
    assert by_step(one).keys() == by_step(two).keys()
    for step, beta in by_step(one).items():
        other = by_step(two)[step]
        assert {e: other.get(e, 0.0) for e in beta | other} == pytest.approx({e: beta.get(e, 0.0) for e in beta | other}, abs=2e-3)
    sizes = {k: [len(s.active) for s in v] for k, v in states.items()}
    assert any(a < b for a, b in zip(sizes["few"], sizes["all"], strict=True)) and sizes["few"][-1] < sizes["all"][-1]


def test_penalties_without_a_screen(spark):
    """With sums well below the threshold the residuals' small change tells that nothing new can enter."""
    rng = np.random.default_rng(13)
    bits = (rng.random((150, 40)) < 0.02).astype(int)
    bits[:, 0] = rng.random(150) < 0.6
    y = 50.0 * bits[:, 0] + rng.normal(0, 0.1, 150)
    top = highest(bits, y)
    options = {"depth": 2, "lambda_max": top, "max_lambdas": 8, "ahead": 0}
    seldom = fit(cells(spark, bits), response(spark, y), 40, FitConfig(**options))
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(Search, "still", lambda *_: False)
        always = fit(cells(spark, bits), response(spark, y), 40, FitConfig(**options))
    assert by_step(seldom) == by_step(always)
    assert seldom.screens < always.screens


def test_residuals_of_old_steps_bound_columns(spark, monkeypatch):
    """Steps are kept as long as a column goes back to one; with three at most more columns are multiplied, and the path is the same."""
    bits, y = planted(8, 150, 12, 0.25)
    top = highest(bits, y)
    options = {"depth": 2, "lambda_max": top * 0.98, "max_lambdas": 6, "ahead": 0}
    monkeypatch.setattr(Search, "still", lambda *_: False)
    counts, kept, close = [], [], Search.close
    paths = []
    for snapshots in (1, 12):
        looked = []
        with monkeypatch.context() as patch:
            patch.setattr(Search, "close", lambda self, looked=looked: (looked.extend(self.looked), kept.append(len(self.history)), close(self)))
            paths.append(by_step(fit(cells(spark, bits), response(spark, y), 12, FitConfig(snapshots=snapshots, **options))))
        counts.append(sum(k for k, _ in looked))
    assert paths[0] == paths[1] and counts[1] <= counts[0] and kept[0] == 1 <= kept[1]


def test_pruned_search_resumes_with_what_it_knows(spark, tmp_path):
    bits, y = planted(9, 100, 10, 0.3)
    top = highest(bits, y)
    config = FitConfig(depth=3, lambda_max=top * 0.95, max_lambdas=4, ahead=0, check_duplicates=True, calibrate=1e9)
    log = checkpoint.Checkpoints(spark, str(tmp_path / "log"), config)

    class Stop(Exception):
        pass

    def stop(state):
        log.save(state)
        if state.counted == 2:
            raise Stop

    x, y = cells(spark, bits), response(spark, y)
    with pytest.raises(Stop):
        fit(x, y, 10, config, save=stop)
    state = log.restore()
    assert state.counted == 2 and {"columns", "pairs", "marks"} <= state.tables.keys() and state.history and len(state.trail) == state.step
    looked, close = [], Search.close
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(Search, "close", lambda self: (looked.append(self.looked), close(self)))
        whole = fit(x, y, 10, config)
        again = fit(x, y, 10, config, resume=state, save=log.save)
        fit(x, y, 10, config, resume=FitState(**{k: v for k, v in vars(state).items() if k not in ("tables", "history")}))
    assert strengths(again) == pytest.approx(strengths(whole)) and again.sigma == pytest.approx(whole.sigma)
    # looks at what the uninterrupted fit looks at, and without the tables at no less
    assert looked[1] == looked[0][-len(looked[1]) :] if looked[1] else True
    assert sum(k for k, _ in looked[2]) >= sum(k for k, _ in looked[1])
    assert len(list((tmp_path / "log").glob("save=*"))) == log.keep


def test_path_ends_where_solutions_differ(spark):
    bits, y = planted(10, 100, 6)
    options = {"depth": 1, "lambda_max": highest(bits, y), "max_lambdas": 15}
    x, y = cells(spark, bits), response(spark, y)
    whole = fit(x, y, 6, FitConfig(**options))
    steps, lam = by_step(whole), {s: lam for s, lam, _, _ in whole.path}
    ratio = {(a, b): max(abs(steps[a].get(e, 0) - steps[b].get(e, 0)) for e in steps[a] | steps[b]) / (lam[a] + lam[b]) for a in steps for b in steps if a < b}
    bound = sorted(ratio.values())[len(ratio) // 2]
    first = min(b for (_, b), r in ratio.items() if r > bound)
    ended = fit(x, y, 6, FitConfig(calibrate=bound, **options))
    assert ended.ended_by_calibration and max(by_step(ended)) == first and not whole.ended_by_calibration
    assert strengths(ended) == pytest.approx(steps[first])


def test_sweeps_in_a_seeded_order(spark):
    assert sweep_order([5, 1, 9], None) == [1, 5, 9]
    orders = {tuple(sweep_order(list(range(9)), seed)) for seed in range(5)}
    assert len(orders) == 5 and all(sorted(o) == list(range(9)) for o in orders)
    assert sweep_order([3, 7, 1], 2) == [e for e in sweep_order(list(range(9)), 2) if e in (1, 3, 7)]
    bits, y = planted(11, 80, 6)
    options = {"depth": 2, "lambda_max": highest(bits, y), "max_lambdas": 4, "halt_error_diff": 1 + 1e-12}
    x, y = cells(spark, bits), response(spark, y)
    plain, one, two = (fit(x, y, 6, FitConfig(sweep_seed=seed, **options)) for seed in (None, 7, 7))
    assert one.path == two.path
    assert strengths(one) == pytest.approx(strengths(plain), abs=1e-3)


def test_many_pairs_are_told_from_few_rows(spark, monkeypatch):
    """A matrix with many pairs isn't screened whole to learn that."""
    bits = np.ones((3, 30), dtype=int)
    asked = []
    monkeypatch.setattr(screen, "pair_screen", lambda *a, **k: asked.append(a))
    search = Search(cells(spark, bits), response(spark, [1, 2, 3]), 30, FitConfig(depth=2, ahead=100))
    assert search.whole is None and not asked
    search.close()
    assert path_module._Search is Search


def test_rows_with_equal_columns_are_one_row(spark):
    """A search holds each set of columns once, whatever the number of rows, and its inner products are those of all rows."""
    rows = [[c for c in range(4) if (r % 7) >> c & 1] for r in range(60)]
    x = spark.createDataFrame([(r, c, 1.0) for r, own in enumerate(rows) for c in own], "row_id long, col_id int, val double")
    y = spark.createDataFrame([(r, float(r * r % 17)) for r in range(5, 70)], "row_id long, y double")
    for depth, distance in ((2, None), (3, None), (3, 2)):
        search = Search(x, y, 4, FitConfig(depth=depth, max_interaction_distance=distance))
        ids = search.whole.ids
        plain = solve.gram(solve.effect_rows(x, ids, 4), y, ids, solve.response_sums(y))
        for name in ("g", "c", "sums"):
            assert np.allclose(getattr(search.whole, name), getattr(plain, name)), name
        assert (search.whole.n, search.whole.yy) == (plain.n, plain.yy)
        assert search.full.count() == len({(c, tuple(own)) for own in rows for c in own})
        fits = [({ids[0]: 0.5, ids[-1]: -2.0}, 1.5)]
        every = solve.residuals(x, y, fits, 4).agg({"r0": "sum"}).first()[0]
        assert np.isclose(solve.residuals(search.x, search.y, fits, 4).agg({"r0": "sum"}).first()[0], every)
        search.close()


def test_prints_by_words_of_bits_make_the_same_classes(spark, monkeypatch):
    """Long rows are printed 64 at a time: fewer products, and the classes that single rows give."""
    bits = np.random.default_rng(5).random((200, 6)) < 0.85
    bits[:, 5] = bits[:, 1] & bits[:, 2]
    x = cells(spark, bits).withColumn("row_id", F.col("row_id") - 70)
    assert dedupe._dense(x, 3)
    told = []
    for dense in (True, False):
        monkeypatch.setattr(dedupe, "_dense", lambda *_, dense=dense: dense)
        marked = dedupe.prints(x, 6, 3)
        told.append((sorted(map(tuple, dedupe.classes(marked).collect())), sorted((r["id"], r["nz"], r["i"], r["j"] or 0, r["k"] or 0) for r in marked.collect())))
    assert told[0] == told[1]
    assert dedupe._word_products(dedupe.words(x), 3).count() * 2 < screen.products(screen.packed(x, True), 3, None, True, []).count()
