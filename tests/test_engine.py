import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import SF
from weft.functions import ids, scalar
from weft.operators import dedupe, encode, prune, report, screen, solve
from weft.plans import calibration, cli
from weft.plans import path as path_module
from weft.plans.path import FitConfig, FitState, fit
from weft.queries import QUERIES
from weft.sources import checkpoint, tables, text
from weft.streaming import running_sums

# The small matrices, responses, calibration vectors and saved states of FIXTURES.md, sections 3.H1 to 3.H6.
SMALL = ["111001", "101101", "011110", "110001", "111001"]
TRUE_Y = [-12.3, 7.3, 0.0, 2.3, -12.3]
REAL = [[0.2, 1.2, 1.4, -2.3, -0.1], [-0.2, -1.2, 3.4, -1.3, 0.1], [-1.3, 0.2, -3.4, 2.3, 0.7], [0.2, 0.2, 0.4, -3.3, 2.1], [-0.2, -1.2, 3.2, 3.5, 0.1]]


def matrix(spark, lines):
    return spark.createDataFrame([(r, c, 1.0) for r, line in enumerate(lines) for c, v in enumerate(line) if v == "1"], "row_id long, col_id int, val double")


def response(spark, values):
    return spark.createDataFrame([(r, float(v)) for r, v in enumerate(values)], "row_id long, y double")


def effects(result):
    return {tuple(c for c in (r["i"], r["j"], r["k"]) if c is not None): r["strength"] for r in result.effects.collect()}


def test_identifiers_of_three_orders_are_apart(spark):
    for p in (3, 6, 11, 35):
        every = [ids.effect_number(c, p) for k in (1, 2, 3) for c in itertools.combinations(range(p), k)]
        assert len(set(every)) == len(every)
        assert [ids.effect_columns(e, p) for e in every] == [c for k in (1, 2, 3) for c in itertools.combinations(range(p), k)]
    p = 100
    triples = spark.range(p).selectExpr("id a").crossJoin(spark.range(p).selectExpr("id b")).filter("a < b").crossJoin(spark.range(p).selectExpr("id c")).filter("b < c")
    i, j, k = ids.decode(F.col("e"), p)
    back = triples.withColumn("e", ids.triple_id(F.col("c"), F.col("a"), F.col("b"), p)).select("a", "b", "c", i.alias("i"), j.alias("j"), k.alias("k"))
    assert back.filter("a <> i OR b <> j OR c <> k").count() == 0


def test_scalars():
    assert round(scalar.default_lambda_min(1000, 100), 6) == 0.169337
    assert round(scalar.default_lambda_min(2000, 1000), 6) == 0.150652
    assert scalar.soft(3.0, 1.0) == 2.0 and scalar.soft(-3.0, 1.0) == -2.0 and scalar.soft(0.5, 1.0) == 0.0
    for p, d, depth in ((10, None, 2), (10, 3, 2), (8, 4, 3), (6, None, 3)):
        near = lambda c: d is None or c[-1] - c[0] <= d
        assert scalar.candidates(p, depth, d) == sum(near(c) for k in range(1, depth + 1) for c in itertools.combinations(range(p), k))


def test_rows_without_a_column(spark):
    x = matrix(spark, ["10000", "01110", "00001", "11010", "11100"])
    left = encode.without_columns(x, spark.createDataFrame([(3,)], "col_id int"))
    assert [r["cols"] for r in encode.rows_of(left).orderBy("row_id").collect()] == [[0], [1, 2], [4], [0, 1], [0, 1, 2]]


def test_columns_by_effect(spark):
    x = matrix(spark, SMALL)
    rows = lambda c: sorted(r["row_id"] for r in encode.column_by_effect(x, c).collect())
    assert rows((0, 2)) == [0, 1, 4] and rows((0, 2, 3)) == [1]


def test_equal_effects(spark):
    x = matrix(spark, SMALL)
    classed = dedupe.classes(dedupe.prints(x, 6, 3))
    reps = {r["rep"]: sorted(r["equivalent"]) for r in dedupe.equivalents(classed).collect()}
    by = {}
    for k in (1, 2, 3):
        for c in itertools.combinations(range(6), k):
            rows = tuple(i for i, line in enumerate(SMALL) if all(line[j] == "1" for j in c))
            if rows:
                by.setdefault(rows, []).append((k, ids.effect_number(c, 6)))
    assert reps == {min(v)[1]: sorted(e for _, e in v) for v in by.values()}
    mains = {r["id"]: r["rep"] for r in dedupe.classes(dedupe.prints(x, 6)).collect()}
    assert mains == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 0}


def test_equal_effects_of_the_hourly_matrix(spark, tmp_path):
    """Hours of one quarter of the day are columns of their own; the long row's triples are all there."""
    times = [(u, kind, h) for u in range(4) for kind in range(5) for h in range(24) if (u + 1) * (kind * 24 + h) % 7 < 2 and (u == 0 or h % 4)]
    rows = [(n, u, f"t{kind}", f"2024-01-0{1 + n % 9} {h:02d}:30:00", 1.5) for n, (u, kind, h) in enumerate(times)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{tmp_path}/events.parquet")
    cols: dict[int, set[int]] = {}
    for u, kind, h in times:
        cols.setdefault(kind * 24 + h, set()).add(u)
    by: dict[tuple, list] = {}
    for k in (1, 2, 3):
        for c in itertools.combinations(sorted(cols), k):
            users = tuple(sorted(set.intersection(*(cols[j] for j in c))))
            if users:
                by.setdefault(users, []).append((k, ids.effect_number(c, 120)))
    want = {(e, k, min(v)[1], len(v)) for v in by.values() for k, e in v}
    got = QUERIES["duplicate_pairs_triples_hours"](spark, str(tmp_path))
    assert {(r["id"], r["ord"], r["rep"], r["members"]) for r in got.collect()} == want and len(want) > 1350


def test_three_way_fit(spark):
    config = FitConfig(depth=3, lambda_min=0.01, lambda_max=100, max_lambdas=100, halt_error_diff=1.00001, max_nz_beta=7, use_intercept=False, check_duplicates=True)
    got = effects(fit(matrix(spark, SMALL), response(spark, TRUE_Y), 6, config))
    assert got[(0,)] > 0.08 and got[(0, 3)] > 0.35 and got[(0, 1, 2)] < -4.0
    assert sum(abs(b) >= 1e-4 for b in got.values()) < 8


def both_ways(spark, x, y, p, **options):
    """The fit with inner products computed ahead, and the one that screens and prunes at every step."""
    one, two = (fit(x, y, p, FitConfig(**options, ahead=n)) for n in (5000, 0))
    a, b = effects(one), effects(two)
    assert a.keys() == b.keys() and all(math.isclose(a[k], b[k], abs_tol=1e-8) for k in a)
    assert math.isclose(one.final_lambda, two.final_lambda) and math.isclose(one.sigma, two.sigma, rel_tol=1e-9)
    return one, two


def random_bits(seed, n, p, share):
    return ["".join(map(str, r)) for r in (np.random.default_rng(seed).random((n, p)) < share).astype(int)]


def test_screens_per_step_and_ahead_agree(spark):
    lines, noise = random_bits(1, 60, 8, 0.4), np.random.default_rng(1).normal(0, 0.1, 60)
    y = response(spark, [3.0 * (line[0] == "1") - 4.0 * (line[2] == "1" and line[5] == "1") + e for line, e in zip(lines, noise, strict=True)])
    x = matrix(spark, lines)
    assert {(0,), (2, 5)} <= effects(fit(x, y, 8, FitConfig(depth=2, lambda_min=1.0, lambda_max=2.5, halt_error_diff=1.0001))).keys()
    one, _ = both_ways(spark, x, y, 8, depth=2, lambda_min=1.0, halt_error_diff=1.0001, lambda_max=1.6, max_lambdas=4)
    assert effects(one)


@pytest.mark.parametrize("options", [{"depth": 3}, {"depth": 3, "max_interaction_distance": 3}, {"depth": 3, "hierarchy": "compat"}, {"depth": 2, "hierarchy": "strong"}])
def test_both_ways_of_three_way_and_hierarchical_fits(spark, options):
    lines = random_bits(7, 50, 6, 0.5)
    bit = lambda line, *c: all(line[k] == "1" for k in c)
    y = response(spark, [2.0 * bit(line, 1) + 2.0 * bit(line, 3) - 4.0 * bit(line, 1, 3) + 5.0 * bit(line, 0, 2, 3) + 0.01 * r for r, line in enumerate(lines)])
    both_ways(spark, matrix(spark, lines), y, 6, lambda_min=1.0, lambda_max=1.9, halt_error_diff=1.001, max_lambdas=3, **options)


def test_equal_columns_are_skipped_alike(spark):
    """Three equal columns, and products equal to columns: which of them is active doesn't depend on the size of the space."""
    bits = (np.random.default_rng(9).random((80, 6)) < 0.5).astype(int)
    bits[:, 4] = bits[:, 5] = bits[:, 1]
    noise = np.random.default_rng(10).normal(0, 0.2, 80)
    y = response(spark, 3.0 * bits[:, 1] - 2.0 * bits[:, 0] * bits[:, 2] + noise)
    x = matrix(spark, ["".join(map(str, r)) for r in bits])
    one, two = both_ways(spark, x, y, 6, depth=2, check_duplicates=True, lambda_min=1.0, lambda_max=2.0, max_nz_beta=3, max_lambdas=5)
    assert (1,) in effects(one) and not {(4,), (5,)} & effects(one).keys()
    told = [{r["rep"]: r["equivalent"] for r in f.equivalent.collect()} for f in (one, two)]
    assert told[0] == told[1] and {1, 4, 5} <= set(told[0][1])


def test_pruned_search_multiplies_fewer_columns(spark):
    """Columns without a share in anything large are left out of the products, for ones and zeros and for real values."""
    rng = np.random.default_rng(11)
    bits = (rng.random((200, 30)) < 0.1).astype(int)
    bits[:, :4] = (rng.random((200, 4)) < 0.6).astype(int)
    y = 4.0 * bits[:, 0] - 6.0 * bits[:, 1] * bits[:, 2] + rng.normal(0, 0.05, 200)
    cells = [(r, c, float(v)) for r, row in enumerate(bits) for c, v in enumerate(row) if v]
    binary = spark.createDataFrame(cells, "row_id long, col_id int, val double")
    real = spark.createDataFrame([(r, c, round(float(v), 6)) for (r, c, _), v in zip(cells, rng.uniform(-1, 1, len(cells)), strict=True)], "row_id long, col_id int, val double")
    for x, continuous in ((binary, False), (real, True)):
        highest = path_module.lambda_max(x, response(spark, y)) / float(np.linalg.norm(y))
        options = {"depth": 2, "continuous": continuous, "lambda_max": highest * 0.95, "lambda_min": highest * 0.6, "halt_error_diff": 1.0001, "max_lambdas": 4}
        looked = []
        close = path_module._Search.close
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(path_module._Search, "close", lambda self: (looked.extend(self.looked), close(self)))
            both_ways(spark, x, response(spark, y), 30, **options)
        assert looked and all(n == 30 for _, n in looked) and sum(k for k, _ in looked) < 0.8 * sum(n for _, n in looked)


def test_continuous_fit(spark):
    x = spark.createDataFrame([(r, c, REAL[c][r]) for c in range(5) for r in range(5)], "row_id long, col_id int, val double")
    y = 3 + np.array(REAL).T @ np.array([0.3, 1.1, 0.9, -2.2, 1.5])
    result = fit(x, response(spark, y), 5, FitConfig(depth=1, continuous=True, lambda_max=5, lambda_min=1e-5, max_lambdas=500, halt_error_diff=1.00001, max_nz_beta=50))
    assert result.sigma**2 < 1e-4


def test_conditions_of_the_optimum(spark):
    rng = np.random.default_rng(5)
    bits = (rng.random((80, 6)) < 0.5).astype(int)
    y = 2 * bits[:, 1] - 3 * bits[:, 0] * bits[:, 4] + rng.normal(0, 0.3, 80)
    last = {}
    result = fit(matrix(spark, ["".join(map(str, r)) for r in bits]), response(spark, y), 6, FitConfig(depth=2, lambda_min=1.0, halt_error_diff=1.0 + 1e-12), save=lambda s: last.update(before=last.get("now"), now=s))
    limit, beta = result.fitted_lambda * last["before"].sigma, effects(result)
    r = y - result.intercept - sum(b * bits[:, list(c)].prod(axis=1) for c, b in beta.items())
    for k in (1, 2):
        for c in itertools.combinations(range(6), k):
            s = abs(float(r @ bits[:, list(c)].prod(axis=1)))
            assert math.isclose(s, limit, rel_tol=1e-3) if c in beta else s <= limit * 1.05


def test_fit_resumes_from_any_state(spark, tmp_path):
    x, y = matrix(spark, SMALL), response(spark, TRUE_Y)
    config = FitConfig(depth=2, lambda_min=0.2, lambda_max=3.0, use_intercept=False)
    states = []
    whole = fit(x, y, 6, config, save=states.append)
    log = checkpoint.Checkpoints(spark, str(tmp_path / "log"), config)
    assert log.restore() is None
    for s in states[:: max(1, len(states) // 2)]:
        log.save(s)
        again = fit(x, y, 6, config, resume=log.restore())
        assert effects(again) == pytest.approx(effects(whole))
    assert checkpoint.Checkpoints(spark, str(tmp_path / "log"), FitConfig(depth=3)).restore() is None


def test_command_line_and_saved_tables(spark, tmp_path, capsys):
    """Trailing columns without a cell count among the columns; the saved state reads back as tables of effects."""
    x, y = tmp_path / "x.csv", tmp_path / "y.csv"
    x.write_text("".join(f'"r{k}",{",".join(line)},0,0\n' for k, line in enumerate(SMALL)))
    y.write_text("".join(f'"r{k}",{v}\n' for k, v in enumerate(TRUE_Y)))
    options = [str(x), str(y), "--lambda-min", "0.5", "--lambda-max", "2", "--duplicates"]
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    assert cli.main([*options, "--checkpoints", log, "--calibrate"]) == 0
    said = capsys.readouterr().out
    assert "intercept" in said and "path" in said
    assert cli.main([*options, "--out", out, "--columns", "8", "--rows", "5"]) == 0 and cli.main([*options, "--output", "quit"]) == 0
    found = {r["id"]: r["strength"] for r in spark.read.parquet(out).collect()}
    names = spark.createDataFrame([(c, f"v{c}") for c in range(8)], "col_id int, name string")
    told = checkpoint.read_log(spark, log, names, 8)
    assert {r["id"]: r["strength"] for part in told.values() for r in part.collect()} == pytest.approx(found)
    assert all(r["i"].startswith("v") and r["k"] is None for r in told["pairwise"].collect())
    with pytest.raises(SystemExit):
        cli.main([*options, "--columns", "6"])
    result = fit(matrix(spark, SMALL), response(spark, TRUE_Y), 8, FitConfig(depth=2, lambda_min=0.5, lambda_max=2.0, check_duplicates=True))
    by_name = {r["effect"]: r["equivalent"] for part in result.tables(names, 8).values() for r in part.collect()}
    assert by_name.get("v0", ["v5", "v0,v5"]) == ["v5", "v0,v5"] and "v5" not in by_name


def test_columns_of_an_effect_must_ascend(spark):
    good = spark.createDataFrame([(1, None, None), (1, 2, None), (1, 2, 3)], "i int, j int, k int")
    assert ids.ordered(good).count() == 3
    for bad in ((2, 1, None), (1, 3, 2), (1, None, 2), (1, 1, None)):
        with pytest.raises(Exception, match="ascend"):
            ids.ordered(spark.createDataFrame([bad], "i int, j int, k int")).collect()


def test_quartiles_of_a_hot_group(spark):
    rng = np.random.default_rng(8)
    rows = [("hot" if k % 3 else f"g{k % 7}", float(v)) for k, v in enumerate(rng.integers(0, 50, 4000))] + [("one", 3.0), ("none", None)]
    got = {r["g"]: (r["q25"], r["q50"], r["q75"], r["n"]) for r in report.quartiles(spark.createDataFrame(rows, "g string, v double").repartition(9), "g", "v").collect()}
    for g in {g for g, v in rows if v is not None}:
        own = [v for h, v in rows if h == g]
        assert got[g] == pytest.approx((*np.quantile(own, [0.25, 0.5, 0.75]), len(own)))
    assert "none" not in got


def test_newest_state_is_the_last_saved(spark, tmp_path):
    log = checkpoint.Checkpoints(spark, str(tmp_path), FitConfig())
    for counted in (5, 6, 0):
        log.save(FitState(beta={2: 0.3, 12: 0.7, 999: -1231.4}, counted=counted, lam=1000.0))
    assert log.restore().counted == 0 and log.restore().beta[999] == -1231.4
    rows = spark.createDataFrame([(1, True, 5), (2, True, 6), (3, True, 0), (4, False, 9)], "save_seq long, complete boolean, lambda_count long")
    assert checkpoint.latest(rows).first()["lambda_count"] == 0


def test_pruned_columns_have_no_larger_pair(spark):
    rng = np.random.default_rng(2)
    x = matrix(spark, ["".join(map(str, r)) for r in (rng.random((50, 7)) < 0.5).astype(int)])
    before, now = response(spark, rng.normal(size=50)), response(spark, rng.normal(size=50))
    last = screen.largest_per_main(screen.pair_screen(x, before), symmetric=True)
    bounds = {r["col_id"]: r["bound"] for r in prune.branch_bound(x, now.withColumnRenamed("y", "r"), before.withColumnRenamed("y", "r"), last).collect()}
    for r in screen.largest_per_main(screen.pair_screen(x, now), symmetric=True).collect():
        assert r["last_max"] <= bounds[r["i"]] + 1e-9


def test_band_and_forms_agree(spark):
    rng = np.random.default_rng(3)
    x, y = matrix(spark, ["".join(map(str, r)) for r in (rng.random((30, 9)) < 0.5).astype(int)]), response(spark, rng.integers(-9, 9, 30))
    for d in (None, 1, 3):
        for one, two in ((screen.pair_screen, screen.pair_screen_by_join), (screen.triple_screen, screen.triple_screen_by_join)):
            a, b = sorted(map(tuple, one(x, y, d).collect())), sorted(map(tuple, two(x, y, d).collect()))
            assert a == b
            assert d is None or all((r[2] if len(r) == 5 else r[1]) - r[0] <= d for r in a)


def test_text_files(spark, tmp_path):
    (tmp_path / "x.csv").write_text('"r1",1,0,1\n"r2",0,0,0\n\n"r3",1,1,0\n')
    assert sorted((r["row_id"], r["col_id"]) for r in text.read_x_csv(spark, str(tmp_path / "x.csv")).collect()) == [(0, 0), (0, 2), (2, 0), (2, 1)]
    assert text.x_shape(spark, str(tmp_path / "x.csv")) == (3, 3)
    assert [r["name"] for r in text.row_names(spark, str(tmp_path / "x.csv")).orderBy("row_id").collect()] == ["r1", "r2", "r3"]
    (tmp_path / "odd.csv").write_text('"r1",1,0,1\n"r2",0,1,0,1\n')
    with pytest.raises(ValueError, match="3 to 4 cells"):
        text.read_x_csv(spark, str(tmp_path / "odd.csv"))
    with pytest.raises(Exception, match="another number of cells"):
        text.read_x_csv(spark, str(tmp_path / "odd.csv"), columns=4).collect()
    assert sorted((r["row_id"], r["col_id"]) for r in text.read_x_csv(spark, str(tmp_path / "odd.csv"), clamp=True).collect()) == [(0, 0), (0, 2), (1, 1)]
    (tmp_path / "bad.csv").write_text('"r1",1,2\n')
    with pytest.raises(Exception, match="neither 0 nor 1"):
        text.read_x_csv(spark, str(tmp_path / "bad.csv")).collect()
    (tmp_path / "y.csv").write_text('"a",-133.35\n"b",2.5e1\n')
    assert [r["y"] for r in text.read_y_csv(spark, str(tmp_path / "y.csv")).orderBy("row_id").collect()] == [-133.35, 25.0]
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate real general\n% c\n2 1 2\n1 1 -1.5\n2 1 4\n")
    assert sorted(map(tuple, text.read_matrix_market(spark, str(tmp_path / "m.mtx")).collect())) == [(0, 0, -1.5), (1, 0, 4.0)]
    x = matrix(spark, ["101", "010"])
    text.write_x_csv(x, str(tmp_path / "out"), 3)
    assert sorted(map(tuple, text.read_x_csv(spark, str(tmp_path / "out")).collect())) == sorted(map(tuple, x.collect()))


def test_rows_over_several_files_keep_their_places(spark, tmp_path):
    """Files of different size, so that a reader takes them in another order than that of their names; rows without a cell."""
    n = 3000
    x = spark.range(n).filter("id % 5 <> 3").select(F.col("id").alias("row_id"), (F.col("id") * 7 % 11).cast("int").alias("col_id"), F.lit(1.0).alias("val"))
    names = spark.range(n).select(F.col("id").alias("row_id"), F.concat(F.lit("n"), "id").alias("name"))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        text.write_x_csv(x, str(tmp_path / "parts"), 11, names)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        path = str(tmp_path / "parts")
        assert len(list((tmp_path / "parts").glob("part-*"))) > 1
        assert sorted(map(tuple, text.read_x_csv(spark, path).collect())) == sorted(map(tuple, x.collect()))
        assert sorted(map(tuple, text.row_names(spark, path).collect())) == sorted(map(tuple, names.collect()))
        assert text.x_shape(spark, path) == (n, 11)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_expanded_matrix(spark):
    x = matrix(spark, ["101", "110", "011", "111", "000"])
    got = {tuple(r) for r in screen.expand(x).select("row_id", "i", "j").collect()}
    assert got == {(r, i, j) for r, line in enumerate(["101", "110", "011", "111", "000"]) for i in range(3) for j in range(i, 3) if line[i] == line[j] == "1"}


def test_calibration(spark):
    one, two = {1: 1.2, 4: -2.1, 7: 2.1, 21: 13.0, 35: -11.2}, {1: 1.7, 4: -2.1, 7: 2.3, 21: 12.0, 35: -11.3, 107: 0.8}
    rows = [(0, 12.2, e, b) for e, b in one.items()] + [(1, 10.9, e, b) for e, b in two.items()]
    path = spark.createDataFrame(rows, "step int, lambda double, id long, strength double")
    assert calibration.distances(path).first()["ratio"] == pytest.approx(1 / 23.1)
    assert calibration.may_continue(path)


def test_wide_tables_and_reports(spark):
    x, names = tables.from_wide(spark.createDataFrame([(0, 1, 0.0), (1, 0, 2.5)], "id long, a int, b double"), "id", ["a", "b"])
    assert sorted(map(tuple, x.collect())) == [(0, 0, 1.0), (1, 1, 2.5)]
    beta = spark.createDataFrame([(0, 1.5), ((0 + 1) * 2 + 1, -2.0)], "id long, strength double")
    assert {r["effect"]: r["strength"] for r in report.effect_table(beta, names, 2).collect()} == {"a": 1.5, "a,b": -2.0}


def test_bad_input(spark):
    for bad in ({"depth": 4}, {"hierarchy": "weak"}, {"max_interaction_distance": 0}):
        with pytest.raises(ValueError):
            FitConfig(**bad)
    with pytest.raises(ValueError, match="nulls"):
        fit(matrix(spark, SMALL), spark.createDataFrame([(0, None)], "row_id long, y double"), 6)


def test_least_squares_and_prediction(spark):
    x, y = matrix(spark, ["10", "01", "11", "00"]), response(spark, [3.0, 5.0, 7.0, 1.0])
    z = solve.effect_rows(x, [0, 1], 2)
    done = solve.least_squares(solve.gram(z, y, [0, 1], solve.response_sums(y)))
    assert done.beta == pytest.approx([2.0, 4.0]) and done.intercept == pytest.approx(1.0)
    fitted = solve.predict(x, {0: 2.0, 1: 4.0}, 1.0, y, 2)
    assert fitted.join(y, "row_id").filter("abs(fitted - y) > 1e-9").count() == 0


def test_running_sums_over_a_stream(spark, tmp_path):
    cells = spark.createDataFrame([(0, 0, 1.0, 2.0), (1, 0, 1.0, 3.0), (1, 1, 2.0, 3.0)], "row_id long, col_id int, val double, y double")
    cells.write.parquet(str(tmp_path / "cells"))
    stream = spark.readStream.schema(cells.schema).parquet(str(tmp_path / "cells"))
    q = running_sums(stream).writeStream.format("memory").queryName("sums").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.sql("SELECT * FROM sums").collect())) == [(0, 2, 5.0), (1, 1, 6.0)]


def test_many_rows_are_dealt_over_more_tasks(spark, monkeypatch):
    """No task's share of the basket grows with its tables, and the responses aren't copied to each task."""
    usual = tables.basket(spark, SF)[0].rdd.getNumPartitions()
    expected = sorted(map(tuple, screen.main_screen(*tables.basket(spark, SF)).collect()))
    monkeypatch.setattr(tables, "SHARE", 100)
    x, y = tables.basket(spark, SF)
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert x.rdd.getNumPartitions() == -(-lines // 100) > usual
    met = x.join(y, "row_id")
    met.count()
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and met.rdd.getNumPartitions() == -(-lines // 100)
    assert sorted(map(tuple, screen.main_screen(x, y).collect())) == expected


def rows_sent(spark):
    """Rows that all stages so far have written for a shuffle."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(k) for k in range(stages.size()))}


def test_columns_are_compared_without_a_copy_for_each_pair(spark):
    """Each line is dealt out by its part and by its order, not once more for each column that its own is compared with."""
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    was, before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), rows_sent(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sum(r["same"] for r in QUERIES["columns_match"](spark, SF).collect()) == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    sent = sum(n for stage, n in rows_sent(spark).items() if stage not in before)
    assert lines < sent < 4 * lines


@pytest.mark.parametrize("hashed", [True, False])
def test_columns_that_match(spark, monkeypatch, hashed):
    """Equal columns, some with a row or a value of their own, and numbers that no column has; the same where hashes tell nothing."""
    if not hashed:
        monkeypatch.setattr(encode, "_cell_hash", lambda: F.lit(0).cast("long"))
    cols = {0: {0: 1.0, 2: 2.0}, 1: {0: 1.0, 2: 2.0}, 2: {0: 1.0, 2: 3.0}, 3: {0: 1.0, 3: 2.0}, 4: {0: 1.0, 2: 2.0, 3: 1.0}, 5: {0: 1.0, 2: 3.0}, 6: {0: 1.0, 2: 2.0}}
    x = spark.createDataFrame([(r, c, v) for c, rows in cols.items() for r, v in rows.items()], "row_id long, col_id int, val double")
    told = lambda *given: {(r["a"], r["b"]): r["same"] for r in encode.columns_match(x, *given).collect()}
    assert told() == {(a, b): cols[a] == cols[b] for a, b in itertools.combinations(cols, 2)}
    pairs = [(1, 0), (6, 6), (2, 5), (5, 3), (8, 9), (0, 8), (1, 0)]
    assert told(spark.createDataFrame(pairs, "a int, b int")) == {(a, b): cols.get(a) == cols.get(b) for a, b in pairs}
    # a null value equals none
    gaps = x.unionAll(spark.createDataFrame([(5, c, None) for c in (0, 1)], x.schema))
    assert [p for p, same in sorted((tuple(r)[:2], r["same"]) for r in encode.columns_match(gaps).collect()) if same] == [(2, 5)]
