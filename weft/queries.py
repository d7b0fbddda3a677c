"""The registered queries of the engine and the SQL that each must match."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.ids import decode, flat_index, flat_pair, ordered, pair_id, triple_id
from weft.functions.scalar import default_lambda_min, soft_threshold
from weft.operators import dedupe, encode, prune, report, screen, solve
from weft.plans import cli
from weft.plans.calibration import distances
from weft.plans.path import FitConfig, fit, lambda_grid
from weft.sources import tables, text
from weft.sources.checkpoint import Checkpoints, latest, read_log
from weft.sources.scratch import Scratch

BRANDS = 25
EVENT_COLUMNS = 20
HOUR_COLUMNS = 120
BAND = 5
#: Columns of the rows by hour that are cut into blocks, and columns of a block.
CUT = (16, 8)

_BASKET = """
x AS (SELECT DISTINCT l_orderkey r, cast(substr(p_brand, 7) AS int) - 1 c FROM lineitem JOIN part ON l_partkey = p_partkey),
y AS (SELECT o_orderkey r, cast(round(o_totalprice * 100) AS bigint) y FROM orders)"""
_EMBED = """
x AS (SELECT vec_id r, cast(unnest(range(len(embedding))) AS int) c, cast(unnest(embedding) AS double) v FROM embeddings),
y AS (SELECT vec_id r, cast(label AS bigint) y FROM embeddings)"""
_EVENTS = """
k AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 kind FROM (SELECT DISTINCT event_type FROM events)),
x AS (SELECT DISTINCT user_id r, cast(kind * 4 + floor(hour(ts) / 6) AS int) c FROM events JOIN k USING (event_type)),
y AS (SELECT user_id r, sum(cast(round(value * 100) AS bigint))::bigint y FROM events GROUP BY 1)"""
_HOURS = """
k AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 kind FROM (SELECT DISTINCT event_type FROM events)),
x AS (SELECT DISTINCT user_id r, cast(kind * 24 + hour(ts) AS int) c FROM events JOIN k USING (event_type))"""

_HOURS_Y = "y AS (SELECT user_id r, sum(cast(round(value * 100) AS bigint))::bigint y FROM events GROUP BY 1)"
_MAKERS = f"""{_BASKET.replace("x AS (", "bx AS (")},
x AS (SELECT DISTINCT r, unnest([c // 5, c % 5 + 5])::int c FROM bx)"""
MAKERS = 10
#: Where nearly nothing is active in the fits over makers.
MAKER_LAMBDA = 1.4

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n).cast("long") for n in names})


@query(f"WITH {_BASKET} SELECT r row_id, c col_id FROM x")
def encode_coo(spark, sf_dir):
    return encode.sorted_columns(tables.basket(spark, sf_dir)[0]).select("row_id", "col_id")


@query(f"WITH {_EMBED} SELECT r row_id, c col_id, 1.0::double val FROM x WHERE v <> 0")
def binarise(spark, sf_dir):
    return tables.binarise(tables.embed(spark, sf_dir)[0])


@query(f"WITH {_BASKET}, d AS (SELECT r, dense_rank() OVER (ORDER BY r) - 1 n, c FROM x) SELECT n row_id, c col_id FROM d")
def csv_roundtrip_x(spark, sf_dir):
    x, path = tables.basket(spark, sf_dir)[0], Scratch(spark).path()
    text.write_x_csv(x, path, BRANDS)
    return text.read_x_csv(spark, path, BRANDS).select("row_id", "col_id")


@query(f"WITH {_BASKET} SELECT y.r::varchar \"name\", c col_id FROM y LEFT JOIN x USING (r)")
def csv_roundtrip_rows(spark, sf_dir):
    """All orders as named lines, those without parts too, and their names read back."""
    (x, y), path = tables.basket(spark, sf_dir), Scratch(spark).path()
    text.write_x_csv(x, path, BRANDS, y.select("row_id", F.col("row_id").alias("name")))
    return text.row_names(spark, path).join(text.read_x_csv(spark, path), "row_id", "left").select("name", "col_id")


@query(f"WITH {_EMBED} SELECT c col_id, count(*) nz, round(arg_max(v, struct_pack(a := abs(v), b := v)), 6) col_max FROM x WHERE v <> 0 GROUP BY 1")
def col_stats(spark, sf_dir):
    return encode.column_stats(tables.embed(spark, sf_dir)[0]).withColumn("col_max", F.round("col_max", 6))


@query(f"WITH {_BASKET} SELECT r row_id, string_agg(c::varchar, ',' ORDER BY c) cols, count(*) nz FROM x GROUP BY 1")
def csr_rows(spark, sf_dir):
    return encode.rows_of(tables.basket(spark, sf_dir)[0]).select("row_id", F.concat_ws(",", F.col("cols").cast("array<string>")).alias("cols"), F.size("cols").cast("long").alias("nz"))


@query(f"WITH {_BASKET} SELECT c col_id, count(*) nz, sum(r)::bigint row_sum, min(r) first_row, max(r) last_row FROM x GROUP BY 1")
def csc_columns(spark, sf_dir):
    parts = encode.columns_of(tables.basket(spark, sf_dir)[0], 1 << 12)
    return parts.groupBy("col_id").agg(F.sum(F.size("rows")).alias("nz"), F.sum(F.expr("aggregate(rows, 0L, (a, b) -> a + b)")).alias("row_sum"), F.min(F.col("rows")[0]).alias("first_row"), F.max(F.element_at("rows", -1)).alias("last_row"))


@query(f"""WITH {_BASKET}, g AS (SELECT c, r, r - coalesce(lag(r) OVER (PARTITION BY c ORDER BY r), -1) gap FROM x)
SELECT c col_id, r row_id, gap, cast(length(bin(gap)) AS int) bits, r restored FROM g""")
def gap_encoding(spark, sf_dir):
    return encode.gaps(tables.basket(spark, sf_dir)[0], 1 << 12)


@query(f"WITH {_BASKET}, c AS (SELECT c, count(*) nz, max(r) last FROM x GROUP BY 1) SELECT sum(nz)::bigint entries, max(nz) largest, round(avg(nz), 6) mean_nz, count(*) \"columns\", round(sum(last + 1) / sum(nz), 6) mean_gap FROM c")
def matrix_stats(spark, sf_dir):
    return encode.matrix_stats(tables.basket(spark, sf_dir)[0]).withColumns({c: F.round(c, 6) for c in ("mean_nz", "mean_gap")})


@query(f"WITH {_EMBED} SELECT round(max(abs(v)), 6) overall_max FROM x")
def overall_max(spark, sf_dir):
    return encode.overall_max(tables.embed(spark, sf_dir)[0]).withColumn("overall_max", F.round("overall_max", 6))


@query(f"""WITH {_BASKET}, z AS (SELECT r, c FROM x UNION ALL SELECT r, 25 FROM x WHERE c = 0), l AS (SELECT c, list(r ORDER BY r) rows FROM z GROUP BY c)
SELECT a.c a, b.c b, a.rows = b.rows same FROM l a JOIN l b ON a.c < b.c""")
def columns_match(spark, sf_dir):
    """Which of all pairs of columns are equal, a planted copy of the first among them."""
    x = tables.basket(spark, sf_dir)[0]
    # planted row by row, so that the rows are read and dealt out once
    planted = F.when(F.col("col_id") == 0, F.array("col_id", F.lit(BRANDS))).otherwise(F.array("col_id"))
    return encode.columns_match(x.withColumn("col_id", F.explode(planted)))


@query(f"WITH {_BASKET} SELECT row_number() OVER (ORDER BY r) - 1 row_id, y::double y FROM y")
def csv_roundtrip_y(spark, sf_dir):
    path = Scratch(spark).path()
    text.write_y_csv(tables.basket(spark, sf_dir)[1], path)
    return text.read_y_csv(spark, path)


@query(f"WITH {_BASKET} SELECT r row_id, c col_id, (y % 1000)::double val FROM x JOIN y USING (r)")
def matrix_market_roundtrip(spark, sf_dir):
    """Cells with a value as a MatrixMarket file, and read back."""
    (x, y), path = tables.basket(spark, sf_dir), Scratch(spark).path()
    cells = x.join(y, "row_id").select("row_id", "col_id", (F.col("y") % 1000).alias("val"))
    text.write_matrix_market(cells, path, y.count(), BRANDS)
    return text.read_matrix_market(spark, path)


@query("SELECT p_partkey row_id, c col_id, n AS name, v val FROM (SELECT p_partkey, unnest([0, 1, 2]) c, unnest(['p_size', 'p_retailprice', 'p_partkey']) n, unnest([p_size::double, p_retailprice::double, p_partkey::double]) v FROM part) WHERE v <> 0")
def wide_cells(spark, sf_dir):
    """A table's number columns as cells, with their names."""
    x, names = tables.from_wide(tables._table(spark, sf_dir, "part"), "p_partkey", ["p_size", "p_retailprice", "p_partkey"])
    return x.join(F.broadcast(names), "col_id").select("row_id", "col_id", "name", "val")


@query(f"WITH {_BASKET} SELECT r row_id, round(y - sum(y) OVER () / count(*) OVER (), 2) y FROM y")
def center_y(spark, sf_dir):
    return text.center_y(tables.basket(spark, sf_dir)[1]).withColumn("y", F.round("y", 2))


@query(f"WITH {_BASKET} SELECT c i, count(*) nz, sum(y)::bigint s FROM x JOIN y USING (r) GROUP BY 1")
def xty_main(spark, sf_dir):
    return _longs(screen.main_screen(*tables.basket(spark, sf_dir)), "s")


@query(f"WITH {_BASKET} SELECT max(abs(s))::bigint lambda_max FROM (SELECT sum(y) s FROM x JOIN y USING (r) GROUP BY c)")
def lambda_max(spark, sf_dir):
    return screen.main_screen(*tables.basket(spark, sf_dir)).agg(F.round(F.max(F.abs("s"))).cast("long").alias("lambda_max"))


@query(f"WITH {_BASKET} SELECT round(1.1 * sqrt(1.0 / count(*)) * sqrt(abs(2 * ln(sqrt(2 * pi()) * 0.95 / (2.0 * 2600)))), 8) lambda_min FROM y")
def lambda_min_default(spark, sf_dir):
    n = tables.basket(spark, sf_dir)[1].count()
    return spark.range(1).select(F.round(F.lit(default_lambda_min(n, BRANDS)), 8).alias("lambda_min"))


@query(f"""WITH RECURSIVE {_BASKET}, l AS (SELECT 0 step, max(abs(s))::double lam FROM (SELECT sum(y) s FROM x JOIN y USING (r) GROUP BY c)
UNION ALL SELECT step + 1, lam * 0.95 FROM l WHERE step < 199)
SELECT step, round(lam, 3) lam FROM l""")
def lambda_path(spark, sf_dir):
    top = screen.main_screen(*tables.basket(spark, sf_dir)).agg(F.max(F.abs("s"))).first()[0]
    return spark.createDataFrame(list(enumerate(lambda_grid(float(top), 0.0, 200))), "step int, lam double").withColumn("lam", F.round("lam", 3))


def _brands(spark, sf_dir):
    return tables._table(spark, sf_dir, "part").select((F.substring("p_brand", 7, 10).cast("int") - 1).alias("col_id")).distinct()


_PART = "b AS (SELECT DISTINCT cast(substr(p_brand, 7) AS int) - 1 c FROM part)"


@query(f"WITH {_PART} SELECT (a.c + 1::bigint) * 25 + b.c id, a.c::bigint i, b.c::bigint j FROM b a JOIN b ON a.c < b.c")
def pair_id_roundtrip(spark, sf_dir):
    pairs = screen.enumerate_pairs(_brands(spark, sf_dir)).select(pair_id(F.col("j"), F.col("i"), BRANDS).alias("id"))
    i, j, _ = decode(F.col("id"), BRANDS)
    return pairs.select("id", i.alias("i"), j.alias("j"))


@query(f"WITH {_PART} SELECT (a.c + 1::bigint) * 625 + b.c * 25 + d.c id, a.c::bigint i, b.c::bigint j, d.c::bigint k FROM b a JOIN b ON a.c < b.c JOIN b d ON b.c < d.c")
def triple_id_roundtrip(spark, sf_dir):
    pairs = screen.enumerate_pairs(_brands(spark, sf_dir))
    triples = pairs.join(pairs.select(F.col("i").alias("j"), F.col("j").alias("k")), "j")
    ids = triples.select(triple_id(F.col("k"), F.col("i"), F.col("j"), BRANDS).alias("id"))
    i, j, k = decode(F.col("id"), BRANDS)
    return ids.select("id", i.alias("i"), j.alias("j"), k.alias("k"))


@query(f"WITH {_PART} SELECT a.c i, b.c j FROM b a JOIN b ON a.c < b.c AND b.c - a.c <= {BAND}")
def enumerate_pairs_band(spark, sf_dir):
    return screen.enumerate_pairs(_brands(spark, sf_dir), BAND)


@query(f"WITH {_PART} SELECT row_number() OVER (ORDER BY a.c, b.c) - 1 flat, a.c i, b.c j FROM b a JOIN b ON a.c <= b.c")
def flat_index_lookup(spark, sf_dir):
    b = _brands(spark, sf_dir)
    pairs = screen.enumerate_pairs(b).unionAll(b.select(F.col("col_id").alias("i"), F.col("col_id").alias("j")))
    return pairs.select(flat_index(F.col("i"), F.col("j"), BRANDS).alias("flat"), "i", "j")


@query(f"WITH {_PART} SELECT row_number() OVER (ORDER BY a.c, b.c) - 1 flat, a.c::bigint i, b.c::bigint j FROM b a JOIN b ON a.c <= b.c")
def flat_index_decode(spark, sf_dir):
    """Places of the table's pairs among all pairs, and the pairs again from these."""
    i, j = flat_pair(F.col("flat"), BRANDS)
    return flat_index_lookup(spark, sf_dir).select("flat", i.alias("i"), j.alias("j"))


@query(f"""WITH {_PART}, pr AS (SELECT a.c i, b.c j FROM b a JOIN b ON a.c < b.c), tr AS (SELECT pr.i, pr.j, d.c k FROM pr JOIN b d ON d.c > pr.j)
SELECT depth, dist, ((SELECT count(*) FROM b) + CASE WHEN depth > 1 THEN (SELECT count(*) FROM pr WHERE dist = 0 OR j - i <= dist) ELSE 0 END + CASE WHEN depth > 2 THEN (SELECT count(*) FROM tr WHERE dist = 0 OR k - i <= dist) ELSE 0 END)::bigint n
FROM (SELECT unnest([1, 2, 3]) depth), (SELECT unnest([0, 1, 5, 24]) dist)""")
def candidate_counts(spark, sf_dir):
    """How many effects of the table's columns a search looks at, by depth and distance; 0 is no limit."""
    columns = _brands(spark, sf_dir)
    rows = [(depth, d, *screen.candidate_count(columns, depth, d or None).first()) for depth in (1, 2, 3) for d in (0, 1, 5, 24)]
    return spark.createDataFrame(rows, "depth int, dist int, n long")


@query(f"WITH {_BASKET} SELECT a.r row_id, a.c i, b.c j FROM x a JOIN x b ON a.r = b.r AND a.c <= b.c")
def expand_x2(spark, sf_dir):
    return screen.expand(tables.basket(spark, sf_dir)[0]).select("row_id", "i", "j")


_PAIRS = "SELECT a.c i, b.c j, count(*) nz, sum(y.y)::bigint s FROM x a JOIN x b ON a.r = b.r AND a.c < b.c{} JOIN y ON y.r = a.r GROUP BY 1, 2"


@query(f"WITH {_BASKET} {_PAIRS.format('')}")
def pair_screen(spark, sf_dir):
    return screen.pair_screen(*tables.basket(spark, sf_dir))


@query(f"WITH {_BASKET} {_PAIRS.format('')}")
def pair_screen_join(spark, sf_dir):
    return screen.pair_screen_by_join(*tables.basket(spark, sf_dir))


@query(f"WITH {_BASKET} {_PAIRS.format(f' AND b.c - a.c <= {BAND}')}")
def pair_screen_band(spark, sf_dir):
    return screen.pair_screen(*tables.basket(spark, sf_dir), BAND)


@query(f"WITH {_BASKET}, p AS ({_PAIRS.format('')}) SELECT i, j, s FROM p WHERE abs(s) > (SELECT 0.5 * max(abs(s)) FROM p)")
def pair_screen_threshold(spark, sf_dir):
    pairs = screen.pair_screen(*tables.basket(spark, sf_dir)).select("i", "j", "s")
    top = pairs.agg(F.max(F.abs("s"))).first()[0] or 0
    return screen.over_threshold(pairs, 0.5 * top)


@query(f"WITH {_EMBED} SELECT a.c i, b.c j, count(*) nz, round(sum(a.v * b.v * y.y), 6) s FROM x a JOIN x b ON a.r = b.r AND a.c < b.c JOIN y ON y.r = a.r WHERE a.v <> 0 AND b.v <> 0 GROUP BY 1, 2")
def pair_screen_continuous(spark, sf_dir):
    return screen.pair_screen(*tables.embed(spark, sf_dir), binary=False).withColumn("s", F.round("s", 6))


_TRIPLES = "SELECT a.c i, b.c j, d.c k, count(*) nz, sum(y.y)::bigint s FROM x a JOIN x b ON a.r = b.r AND a.c < b.c JOIN x d ON d.r = a.r AND b.c < d.c JOIN y ON y.r = a.r GROUP BY 1, 2, 3"


@query(f"WITH {_BASKET} {_TRIPLES}")
def triple_screen(spark, sf_dir):
    return screen.triple_screen(*tables.basket(spark, sf_dir))


@query(f"WITH {_BASKET} {_TRIPLES}")
def triple_screen_join(spark, sf_dir):
    return screen.triple_screen_by_join(*tables.basket(spark, sf_dir))


@query(f"WITH {_HOURS}, {_HOURS_Y} {_PAIRS.format('')}")
def pair_screen_blocks(spark, sf_dir):
    """Pairs of users' long rows, which many tasks share by blocks of columns."""
    return screen.pair_screen(*tables.events_by_hour(spark, sf_dir), grid=CUT)


@query(f"WITH {_HOURS}, {_HOURS_Y} {_TRIPLES}")
def triple_screen_blocks(spark, sf_dir):
    return screen.triple_screen(*tables.events_by_hour(spark, sf_dir), grid=CUT)


_TOP_MAINS = "m AS (SELECT c FROM (SELECT c, row_number() OVER (ORDER BY sum(y) DESC, c) k FROM x JOIN y USING (r) GROUP BY c) WHERE k <= 8)"


def _top_mains(x, y):
    return screen.main_screen(x, y).orderBy(F.desc("s"), "i").limit(8).select(F.col("i").alias("col_id"))


@query(f"WITH {_BASKET}, {_TOP_MAINS}, p AS ({_PAIRS.format('')}) SELECT * FROM p WHERE j IN (SELECT c FROM m)")
def pair_screen_hierarchy(spark, sf_dir):
    x, y = tables.basket(spark, sf_dir)
    return screen.hierarchy_filter(screen.pair_screen(x, y), _top_mains(x, y)).select("i", "j", "nz", "s")


@query(f"WITH {_BASKET}, {_TOP_MAINS}, p AS ({_PAIRS.format('')}) SELECT * FROM p WHERE i IN (SELECT c FROM m) AND j IN (SELECT c FROM m)")
def pair_screen_hierarchy_strong(spark, sf_dir):
    x, y = tables.basket(spark, sf_dir)
    return screen.hierarchy_filter(screen.pair_screen(x, y), _top_mains(x, y), strong=True).select("i", "j", "nz", "s")


@query(f"WITH {_BASKET}, {_TOP_MAINS} SELECT r row_id, string_agg(c::varchar, ',' ORDER BY c) cols FROM x WHERE c NOT IN (SELECT c FROM m) GROUP BY 1")
def rows_without_columns(spark, sf_dir):
    x, y = tables.basket(spark, sf_dir)
    return encode.rows_of(encode.without_columns(x, _top_mains(x, y))).select("row_id", F.concat_ws(",", F.col("cols").cast("array<string>")).alias("cols"))


@query(f"""WITH {_BASKET}, p AS ({_PAIRS.format('')}),
lm AS (SELECT i, max(abs(s)) last_max FROM (SELECT i, s FROM p UNION ALL SELECT j, s FROM p) GROUP BY 1),
r AS (SELECT r, y::double l, (y - 20000000)::double r1 FROM y),
a AS (SELECT c, abs(sum(r1 * l) / sum(l * l)) alpha FROM x JOIN r USING (r) GROUP BY 1),
d AS (SELECT x.c, alpha, greatest(sum(greatest(r1 - alpha * l, 0)), abs(sum(least(r1 - alpha * l, 0)))) rem FROM x JOIN r USING (r) JOIN a ON a.c = x.c GROUP BY 1, 2)
SELECT c col_id, round(alpha, 8) alpha, round((alpha * last_max + rem) / 1e6, 3) bound FROM d JOIN lm ON lm.i = d.c""")
def branch_bound(spark, sf_dir):
    x, y = tables.basket(spark, sf_dir)
    last = screen.largest_per_main(screen.pair_screen(x, y), symmetric=True)
    now = y.select("row_id", (F.col("y") - 20000000).cast("double").alias("r"))
    bounds = prune.branch_bound(x, now, y.select("row_id", F.col("y").cast("double").alias("r")), last)
    return bounds.select("col_id", F.round("alpha", 8).alias("alpha"), F.round(F.col("bound") / 1e6, 3).alias("bound"))


@query(f"""WITH {_EMBED}, p AS (SELECT a.c i, b.c j, sum(a.v * b.v * y.y) s FROM x a JOIN x b ON a.r = b.r AND a.c < b.c JOIN y ON y.r = a.r GROUP BY 1, 2),
lm AS (SELECT i, max(abs(s)) last_max FROM (SELECT i, s FROM p UNION ALL SELECT j, s FROM p) GROUP BY 1),
r AS (SELECT r, y::double l, (y * 0.9 - 0.1)::double r1 FROM y), o AS (SELECT max(abs(v)) m FROM x),
a AS (SELECT c, abs(sum(r1 * l) / sum(l * l)) alpha FROM x JOIN r USING (r) WHERE v <> 0 GROUP BY 1),
d AS (SELECT x.c, alpha, m * sum(abs(v * (r1 - alpha * l))) rem FROM x JOIN r USING (r) JOIN a ON a.c = x.c, o WHERE v <> 0 GROUP BY 1, 2, m)
SELECT c col_id, round(alpha, 8) alpha, round(alpha * last_max + rem, 5) bound FROM d JOIN lm ON lm.i = d.c""")
def branch_bound_continuous(spark, sf_dir):
    x, y = tables.embed(spark, sf_dir)
    last = screen.largest_per_main(screen.pair_screen(x, y, binary=False), symmetric=True)
    now, before = y.selectExpr("row_id", "y * 0.9D - 0.1D AS r"), y.selectExpr("row_id", "cast(y AS double) AS r")
    bounds = prune.branch_bound(x, now, before, last, reach=encode.overall_max(x).first()[0])
    return bounds.select("col_id", F.round("alpha", 8).alias("alpha"), F.round("bound", 5).alias("bound"))


@query(f"""WITH {_BASKET}, p AS ({_PAIRS.format('')}), v AS (SELECT a.c i, b.c j, y.y::double r0, (y.y - 5000000)::double r1 FROM x a JOIN x b ON a.r = b.r AND a.c < b.c JOIN y ON y.r = a.r),
q AS (SELECT i, j, greatest(sum(greatest(r0, 0)), abs(sum(least(r0, 0)))) rest0, greatest(sum(greatest(r0 - 0.9 * r1, 0)), abs(sum(least(r0 - 0.9 * r1, 0)))) rest1 FROM v GROUP BY 1, 2)
SELECT q.i, q.j, round((CASE WHEN (q.i + q.j) % 2 = 0 THEN least(rest0, 0.9 * abs(p.s) + rest1) ELSE rest0 END) / 1e6, 3) bound FROM q JOIN p ON p.i = q.i AND p.j = q.j""")
def pair_bound(spark, sf_dir):
    """Bounds of pairs, half of which were looked at one step before."""
    x, y = tables.basket(spark, sf_dir)
    rows = screen.packed(x, True).join(y.selectExpr("row_id", "cast(y AS double) AS r0", "cast(y - 5000000 AS double) AS r1"), "row_id")
    sums = screen.products(rows, 2, None, True, ["r0", "r1"]).groupBy("i", "j").agg(*prune.rests([0.9], "v", None))
    known = screen.pair_screen(x, y).filter("(i + j) % 2 = 0").select("i", "j", F.lit(4).alias("step"), F.abs("s").cast("double").alias("last_max"))
    return prune.bounds(sums, known, ["i", "j"], [4], [0.9]).select("i", "j", F.round(F.col("bound") / 1e6, 3).alias("bound"))


@query(f"WITH {_BASKET}, {_TOP_MAINS}, b AS (SELECT c, greatest(sum(greatest(y, 0)), abs(sum(least(y, 0)))) u FROM x JOIN y USING (r) GROUP BY c) SELECT c col_id FROM b WHERE u > (SELECT 0.98 * max(u) FROM b) AND c NOT IN (SELECT c FROM m)")
def first_seen_columns(spark, sf_dir):
    """Columns that may have something near the largest bound and weren't among the leading eight."""
    x, y = tables.basket(spark, sf_dir)
    sums = x.join(y.select("row_id", F.col("y").cast("double").alias("r0")), "row_id").groupBy("col_id").agg(*prune.rests([], "val", None))
    bounds = prune.bounds(sums, None, ["col_id"], [], [])
    top = bounds.agg(F.max("bound")).first()[0] or 0.0
    return prune.first_seen(prune.updateable(bounds, 0.98 * top), _top_mains(x, y))


@query(f"WITH {_BASKET}, p AS ({_PAIRS.format('')}) SELECT i, max(abs(s)) last_max FROM p GROUP BY 1")
def last_max_per_main(spark, sf_dir):
    return screen.largest_per_main(screen.pair_screen(*tables.basket(spark, sf_dir)))


@query(f"WITH {_BASKET}, p AS ({_TRIPLES}) SELECT i, j, max(abs(s)) last_max FROM p GROUP BY 1, 2")
def last_max_per_pair(spark, sf_dir):
    return screen.largest_per_pair(screen.triple_screen(*tables.basket(spark, sf_dir)))


@query(f"WITH {_BASKET} SELECT a.r row_id FROM x a JOIN x b USING (r) JOIN x d USING (r) WHERE a.c = 0 AND b.c = 3 AND d.c = 7")
def column_by_id(spark, sf_dir):
    return encode.column_by_effect(tables.basket(spark, sf_dir)[0], (0, 3, 7)).select("row_id")


_CLASSES = "SELECT f.id, f.ord, first_value(f.id) OVER (PARTITION BY f.f ORDER BY f.ord, f.id) rep, count(*) OVER (PARTITION BY f.f) members FROM f"


@query(f"""WITH {_BASKET}, z AS (SELECT r, c FROM x UNION ALL SELECT r, 25 FROM x WHERE c = 0),
f AS (SELECT c::bigint id, 1 ord, sha256(string_agg(r::varchar, ',' ORDER BY r)) f FROM z GROUP BY c) {_CLASSES}""")
def fingerprint_mains(spark, sf_dir):
    x = tables.basket(spark, sf_dir)[0]
    planted = x.filter("col_id = 0").withColumn("col_id", F.lit(BRANDS))
    return dedupe.classes(dedupe.prints(x.unionAll(planted), BRANDS + 1)).withColumn("ord", F.col("ord").cast("int"))


def _prints_sql(p: int) -> str:
    return f"""f AS (
SELECT c::bigint id, 1 ord, sha256(string_agg(r::varchar, ',' ORDER BY r)) f FROM x GROUP BY c
UNION ALL SELECT (a.c + 1::bigint) * {p} + b.c, 2, sha256(string_agg(a.r::varchar, ',' ORDER BY a.r)) FROM x a JOIN x b ON a.r = b.r AND a.c < b.c GROUP BY a.c, b.c
UNION ALL SELECT (a.c + 1::bigint) * {p**2} + b.c * {p} + d.c, 3, sha256(string_agg(a.r::varchar, ',' ORDER BY a.r)) FROM x a JOIN x b ON a.r = b.r AND a.c < b.c JOIN x d ON d.r = a.r AND b.c < d.c GROUP BY a.c, b.c, d.c)"""


_EVENT_PRINTS = _prints_sql(EVENT_COLUMNS)
_HOUR_PRINTS = _prints_sql(HOUR_COLUMNS)


def _event_classes(spark, sf_dir):
    return dedupe.classes(dedupe.prints(tables.events(spark, sf_dir)[0], EVENT_COLUMNS, 3))


@query(f"WITH {_EVENTS}, {_EVENT_PRINTS} {_CLASSES}")
def duplicate_pairs_triples(spark, sf_dir):
    return _event_classes(spark, sf_dir)


@query(f"WITH {_EVENTS}, {_EVENT_PRINTS}, g AS ({_CLASSES}) SELECT rep, string_agg(id::varchar, ',' ORDER BY id) equivalent FROM g GROUP BY 1")
def equivalence_classes(spark, sf_dir):
    return dedupe.equivalents(_event_classes(spark, sf_dir)).select("rep", F.concat_ws(",", F.col("equivalent").cast("array<string>")).alias("equivalent"))


@query(f"WITH {_EVENTS}, {_EVENT_PRINTS}, g AS ({_CLASSES}) SELECT rep id, sum(id % 7)::bigint strength FROM g GROUP BY 1")
def fold_duplicates(spark, sf_dir):
    classed = _event_classes(spark, sf_dir)
    return dedupe.fold(classed.select("id", (F.col("id") % 7).alias("strength")), classed)


def _hour_classes(spark, sf_dir):
    return dedupe.classes(dedupe.prints(tables.events_by_hour(spark, sf_dir)[0], HOUR_COLUMNS, 3, CUT))


@query(f"WITH {_HOURS}, {_HOUR_PRINTS} {_CLASSES}")
def duplicate_pairs_triples_hours(spark, sf_dir):
    return _hour_classes(spark, sf_dir)


@query(f"WITH {_HOURS}, {_HOUR_PRINTS}, g AS ({_CLASSES}) SELECT rep, string_agg(id::varchar, ',' ORDER BY id) equivalent FROM g GROUP BY 1")
def equivalence_classes_hours(spark, sf_dir):
    return dedupe.equivalents(_hour_classes(spark, sf_dir)).select("rep", F.concat_ws(",", F.col("equivalent").cast("array<string>")).alias("equivalent"))


@query(f"WITH {_HOURS}, {_HOUR_PRINTS}, g AS ({_CLASSES}) SELECT rep id, sum(id % 7)::bigint strength FROM g GROUP BY 1")
def fold_duplicates_hours(spark, sf_dir):
    classed = _hour_classes(spark, sf_dir)
    return dedupe.fold(classed.select("id", (F.col("id") % 7).alias("strength")), classed)


_MAIN_GRAM = "g AS (SELECT a.c p, b.c q, count(*) g FROM x a JOIN x b ON a.r = b.r AND a.c <= b.c GROUP BY 1, 2)"


@query(f"WITH {_BASKET}, {_MAIN_GRAM} SELECT p::bigint p, q::bigint q, g FROM g")
def gram_matrix(spark, sf_dir):
    z = tables.basket(spark, sf_dir)[0].select(F.col("col_id").cast("long").alias("id"), "row_id", "val")
    return _longs(solve.inner_products(z), "g")


@query("SELECT o_orderkey, round(sign(o_totalprice - 250000) * greatest(abs(o_totalprice - 250000) - 50000, 0), 2) + 0.0 z FROM orders")
def soft_threshold_prices(spark, sf_dir):
    o = tables._table(spark, sf_dir, "orders")
    return o.select("o_orderkey", (F.round(soft_threshold(F.col("o_totalprice") - 250000, F.lit(50000.0)), 2) + 0.0).alias("z"))


@query(f"WITH {_BASKET} SELECT round(avg(y), 3) intercept, round(sqrt(sum((y - m)::double * (y - m))) / 1e6, 4) norm FROM (SELECT y, avg(y) OVER () m FROM y)")
def intercept_and_norm(spark, sf_dir):
    y = tables.basket(spark, sf_dir)[1]
    n, total, _ = solve.residual_sums(y, "y").first()
    mean = total / n if n else 0.0
    rest = solve.residual_sums(y.select((F.col("y") - F.lit(mean)).alias("r")))
    return rest.select(F.round(F.lit(mean), 3).alias("intercept"), F.round(F.col("norm") / 1e6, 4).alias("norm"))


@query(f"WITH {_BASKET} SELECT r row_id, sum(c * 0.5)::double s FROM x WHERE c <> 3 GROUP BY 1")
def row_products_without(spark, sf_dir):
    """Each row's product with a vector, one column left out."""
    x = tables.basket(spark, sf_dir)[0]
    beta = spark.range(BRANDS).select(F.col("id").cast("int").alias("col_id"), (F.col("id") * 0.5).alias("strength"))
    return solve.row_products_without(x, beta, 3)


#: A threshold on the scale of the basket's sums, in cents.
LIMIT = 1.0e9


def _main_gram(spark, sf_dir):
    x, y = tables.basket(spark, sf_dir)
    ids = sorted(r[0] for r in x.select("col_id").distinct().collect())
    z = x.select(F.col("col_id").cast("long").alias("id"), "row_id", "val")
    return solve.gram(z, y, ids, solve.response_sums(y)), ids


def _sweep_sql(sweeps: int, limit: str) -> str:
    return f"""WITH RECURSIVE {_BASKET}, {_MAIN_GRAM},
full_g AS (SELECT p, q, g FROM g UNION ALL SELECT q, p, g FROM g WHERE p < q),
cols AS (SELECT c, row_number() OVER (ORDER BY c) i FROM (SELECT DISTINCT c FROM x)),
every AS (SELECT a.c p, b.c q FROM cols a, cols b),
m AS (SELECT cols.i, list(coalesce(full_g.g, 0)::double ORDER BY every.q) AS gl, max(coalesce(full_g.g, 0)) FILTER (WHERE every.p = every.q)::double d, any_value(cy.v)::double v
  FROM every JOIN cols ON cols.c = every.p LEFT JOIN full_g ON full_g.p = every.p AND full_g.q = every.q
  JOIN (SELECT c, sum(y) v FROM x JOIN y USING (r) GROUP BY 1) cy ON cy.c = every.p GROUP BY cols.i),
n AS (SELECT count(*) p FROM cols),
s(step, b) AS (SELECT 0, list_transform(range((SELECT p FROM n)), lambda z: 0.0::double)
 UNION ALL
 SELECT step + 1, list_transform(b, lambda e, q: CASE WHEN q = i THEN nb ELSE e END)
 FROM (SELECT step, b, i, sign(u) * greatest(abs(u) - {limit}, 0) / d nb
  FROM (SELECT s.step, s.b, m.i, m.d, m.v - list_dot_product(m.gl, s.b) + m.d * s.b[m.i] u FROM s JOIN m ON m.i = (s.step % (SELECT p FROM n)) + 1 WHERE s.step < (SELECT p FROM n) * {sweeps})))
SELECT cols.c col_id, round(s.b[cols.i], 4) beta FROM s, cols WHERE s.step = (SELECT max(step) FROM s)"""


def _beta_frame(spark, ids, beta):
    return spark.createDataFrame([(i, float(b)) for i, b in zip(ids, beta, strict=True)], "col_id int, beta double").select("col_id", (F.round("beta", 4) + 0.0).alias("beta"))


@query(_sweep_sql(1, "1e9"))
def cd_sweep(spark, sf_dir):
    m, ids = _main_gram(spark, sf_dir)
    beta = solve.np.zeros(len(ids))
    solve.sweep(m, beta, 0.0, LIMIT, use_intercept=False)
    return _beta_frame(spark, ids, beta)


@query(_sweep_sql(1, "60000.0 * (SELECT count(*) FROM y)"))
def cd_sweep_plain(spark, sf_dir):
    """One sweep at the threshold of the plain lasso."""
    m, ids = _main_gram(spark, sf_dir)
    beta = solve.np.zeros(len(ids))
    solve.sweep(m, beta, 0.0, solve.plain_limit(60000.0, m.n), use_intercept=False)
    return _beta_frame(spark, ids, beta)


@query(_sweep_sql(10, "1e9"))
def lasso_main_sweeps(spark, sf_dir):
    """Ten sweeps over the mains at a fixed threshold."""
    m, ids = _main_gram(spark, sf_dir)
    beta = solve.np.zeros(len(ids))
    for _ in range(10):
        solve.sweep(m, beta, 0.0, LIMIT, use_intercept=False)
    return _beta_frame(spark, ids, beta)


@query(_sweep_sql(40, "0"))
def refit_unbiased(spark, sf_dir):
    """Forty sweeps without penalty."""
    m, ids = _main_gram(spark, sf_dir)
    beta = solve.np.zeros(len(ids))
    for _ in range(40):
        solve.sweep(m, beta, 0.0, 0.0, use_intercept=False)
    return _beta_frame(spark, ids, beta)


_LAST = """SELECT CASE WHEN id < {p} THEN 1 WHEN id < {p2} THEN 2 ELSE 3 END ord, id, (CASE WHEN id < {p} THEN id WHEN id < {p2} THEN id // {p} - 1 ELSE id // {p2} - 1 END)::int i,
  (CASE WHEN id < {p} THEN NULL WHEN id < {p2} THEN id % {p} ELSE id % {p2} // {p} END)::int j, (CASE WHEN id >= {p2} THEN id % {p} END)::int k, round(b[ids.k] / 1e4, 4) strength
FROM (SELECT b FROM s ORDER BY it DESC LIMIT 1), ids WHERE b[ids.k] <> 0"""


def _path_sql(depth: int, most_nz: str = "1e18", most_lambdas: int = 200, model: str = _BASKET, p: int = BRANDS, tail: str = _LAST, different: bool = False, first_lambda: float | None = None) -> str:
    """The whole path in one recursive query: a row for each sweep over all effects in the active list.

    ``fresh`` rows begin a penalty: those whose sweep before changed the norm by less than the factor 1.01.
    With ``different``, of effects that have the same rows only the first is there.
    """
    every = "SELECT c::bigint id, r FROM x"
    if depth > 1:
        every += f" UNION ALL SELECT (a.c + 1::bigint) * {p} + b.c, a.r FROM x a JOIN x b ON a.r = b.r AND a.c < b.c"
    if depth > 2:
        every += f" UNION ALL SELECT (a.c + 1::bigint) * {p**2} + b.c * {p} + d.c, a.r FROM x a JOIN x b ON a.r = b.r AND a.c < b.c JOIN x d ON d.r = a.r AND b.c < d.c"
    first = "SELECT id, r FROM al JOIN (SELECT min(id) id FROM (SELECT id, sha256(string_agg(r::varchar, ',' ORDER BY r)) f FROM al GROUP BY id) GROUP BY f) USING (id)" if different else "SELECT id, r FROM al"
    number = p * (p + 1) * (p - 1) // 6
    highest = "(SELECT max(abs(s))::double FROM (SELECT sum(y) s FROM x JOIN y USING (r) GROUP BY c))" if first_lambda is None else f"{first_lambda}::double"
    return f"""WITH RECURSIVE {model}, al AS ({every}), e AS MATERIALIZED ({first}),
ids AS (SELECT id, row_number() OVER (ORDER BY id) k FROM (SELECT DISTINCT id FROM e)),
ek AS (SELECT k, r FROM e JOIN ids USING (id)),
gs AS (SELECT a.k p, b.k q, count(*)::double g FROM ek a JOIN ek b ON a.r = b.r GROUP BY 1, 2),
gr AS (SELECT a.k p, list(coalesce(gs.g, 0) ORDER BY b.k) w FROM ids a CROSS JOIN ids b LEFT JOIN gs ON gs.p = a.k AND gs.q = b.k GROUP BY 1),
m AS MATERIALIZED (SELECT list(w ORDER BY p) g FROM gr),
v AS MATERIALIZED (SELECT list(c ORDER BY k) c, list(s ORDER BY k) s FROM (SELECT k, sum(y)::double c, count(*)::double s FROM ek JOIN y USING (r) GROUP BY 1)),
t AS MATERIALIZED (SELECT count(*)::double n, sum(y)::double ys, sum(y::double * y) yy, {highest} l0,
  1.1 * sqrt(1.0 / count(*)) * sqrt(abs(2 * ln(sqrt(2 * pi()) * 0.95 / (2.0 * {number})))) lowest FROM y),
s(it, lam, lim, sig, cnt, sweep, before, after, b, a, act) AS (
  SELECT 0, l0, 0.0::double, 0.0::double, 0, 0, 0.0::double, sqrt(yy), list_transform(v.c, lambda z: 0.0::double), 0.0::double, list_transform(v.c, lambda z: false) FROM t, v
  UNION ALL
  SELECT it + 1, lam, lim, sig, cnt, sweep, after, sqrt(greatest(yy - 2 * list_dot_product(c, b) + list_dot_product(b, list_transform(g, lambda w: list_dot_product(w, b))) + a * (a * n + 2 * list_dot_product(v_s, b) - 2 * ys), 0)), b, a, act
  FROM (SELECT it, lam, lim, sig, cnt, sweep, after, a, act, g, c, v_s, yy, n, ys,
          list_reduce(list_concat([b], list_transform(range(1, len(b) + 1), lambda k: [k::double])), lambda acc, y: CASE WHEN act[y[1]::bigint] THEN
            list_concat(acc[1:y[1]::bigint - 1], [sign(c[y[1]::bigint] - list_dot_product(g[y[1]::bigint], acc) - a * v_s[y[1]::bigint] + g[y[1]::bigint][y[1]::bigint] * acc[y[1]::bigint])
              * greatest(abs(c[y[1]::bigint] - list_dot_product(g[y[1]::bigint], acc) - a * v_s[y[1]::bigint] + g[y[1]::bigint][y[1]::bigint] * acc[y[1]::bigint]) - lim, 0) / g[y[1]::bigint][y[1]::bigint]], acc[y[1]::bigint + 1:])
            ELSE acc END) b
        FROM (SELECT it, lam, lim, sig, cnt, sweep, after, b, g, c, v_s, yy, n, ys, (ys - list_dot_product(v_s, b)) / n a,
                CASE WHEN sweep = 1 THEN list_transform(act, lambda f, q: f OR abs(list_dot_product(g[q], b) + a * v_s[q] - c[q]) > lim) ELSE act END act
              FROM (SELECT it, lam, CASE WHEN fresh THEN lam * after ELSE lim END lim, CASE WHEN fresh THEN after ELSE sig END sig, cnt, CASE WHEN fresh THEN 1 ELSE sweep + 1 END sweep, after, b, a, act, m.g, v.c, v.s v_s, t.yy, t.n, t.ys
                    FROM (SELECT it, fresh, after, b, a, act, sig, lim, sweep, CASE WHEN fresh AND it > 0 THEN lam * 0.95 ELSE lam END lam, CASE WHEN fresh AND list_contains(act, true) THEN cnt + 1 ELSE cnt END cnt
                          FROM (SELECT *, it = 0 OR sweep >= 100 OR after <= 1e-12 OR before / after < 1.01 fresh FROM s)), m, v, t
                    WHERE NOT (fresh AND (lam <= t.lowest OR cnt >= {most_lambdas} OR len(list_filter(b, lambda z: z <> 0)) >= {most_nz} OR after <= 1e-9 * sqrt(t.yy)))))))
""" + tail.replace("{p}", str(p)).replace("{p2}", str(p**2))


def _fit(spark, sf_dir, **options):
    """The fit on all orders, those without parts too; strengths in hundreds of the currency."""
    return fit(*tables.basket(spark, sf_dir), BRANDS, FitConfig(**options)).effects.withColumn("strength", F.round(F.col("strength") / 1e4, 4))


@query(_path_sql(1))
def lasso_main_path(spark, sf_dir):
    return _fit(spark, sf_dir, depth=1)


@query(_path_sql(2, "100"))
def lasso_pairwise(spark, sf_dir):
    return _fit(spark, sf_dir, depth=2, max_nz_beta=100)


@query(_path_sql(2, most_lambdas=2))
def lasso_pairwise_pruned(spark, sf_dir):
    """The first penalties of the pairwise fit by screens at every step, where bounds leave columns out."""
    return _fit(spark, sf_dir, depth=2, max_lambdas=2, ahead=0)


@query()
def lasso_threeway(spark, sf_dir):
    return _fit(spark, sf_dir, depth=3, max_nz_beta=100, ahead=4000)


def _makers_fit(spark, sf_dir, resume=None, save=None, **options):
    return fit(*tables.makers(spark, sf_dir), MAKERS, FitConfig(**options), resume=resume, save=save)


def _told(effects):
    return effects.withColumn("strength", F.round(F.col("strength") / 1e4, 4))


@query(_path_sql(3, most_lambdas=10, model=_MAKERS, p=MAKERS, first_lambda=MAKER_LAMBDA))
def lasso_threeway_pruned(spark, sf_dir):
    """Ten penalties of the three-way fit by screens, where bounds leave out columns and pairs."""
    return _told(_makers_fit(spark, sf_dir, depth=3, lambda_max=MAKER_LAMBDA, max_lambdas=10, ahead=0).effects)


@query(_path_sql(2, most_lambdas=15, model=_MAKERS, p=MAKERS, first_lambda=MAKER_LAMBDA))
def lasso_pairwise_long(spark, sf_dir):
    """Fifteen penalties of the pairwise fit by screens."""
    return _told(_makers_fit(spark, sf_dir, depth=2, lambda_max=MAKER_LAMBDA, max_lambdas=15, ahead=0).effects)


class _Interrupted(Exception):
    pass


@query(_path_sql(2, most_lambdas=4, model=_MAKERS, p=MAKERS, first_lambda=MAKER_LAMBDA))
def lasso_resumed(spark, sf_dir):
    """A fit that ends by an error after two penalties; another one goes on from what it saved, bounds and all."""
    options = {"depth": 2, "lambda_max": MAKER_LAMBDA, "max_lambdas": 4, "ahead": 0}
    log = Checkpoints(spark, Scratch(spark).path(), FitConfig(**options))

    def save(state):
        log.save(state)
        if state.counted == 2:
            raise _Interrupted

    try:
        _makers_fit(spark, sf_dir, save=save, **options)
    except _Interrupted:
        return _told(_makers_fit(spark, sf_dir, resume=log.restore(), save=log.save, **options).effects)
    raise RuntimeError("the fit ended before its second penalty")


@query(_path_sql(2, most_lambdas=4, model=_MAKERS, p=MAKERS, tail="""SELECT CASE WHEN id < {p} THEN 'c' || id ELSE 'c' || (id // {p} - 1) || ',c' || (id % {p}) END effect, round(b[ids.k] / 1e4, 4) strength
FROM (SELECT b FROM s ORDER BY it DESC LIMIT 1), ids WHERE b[ids.k] <> 0"""))
def saved_effects(spark, sf_dir):
    """The effects of a fit's newest saved state, by their names."""
    options = {"depth": 2, "max_lambdas": 4}
    path = Scratch(spark).path()
    _makers_fit(spark, sf_dir, save=Checkpoints(spark, path, FitConfig(**options)).save, **options)
    names = spark.range(MAKERS).select(F.col("id").cast("int").alias("col_id"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("name"))
    told = read_log(spark, path, names, MAKERS)
    return _told(told["main"].unionAll(told["pairwise"]).unionAll(told["triple"]).select("effect", "strength"))


@query(_path_sql(1, most_lambdas=5, model=_MAKERS, p=MAKERS))
def command_line_fit(spark, sf_dir):
    """The fit of two text files by the command line, and what it writes."""
    (x, y), scratch = tables.makers(spark, sf_dir), Scratch(spark)
    files = [scratch.path() for _ in range(3)]
    text.write_x_csv(x, files[0], MAKERS, y.select("row_id", F.col("row_id").alias("name")))
    text.write_y_csv(y, files[1])
    cli.main([*files[:2], "--depth", "1", "--max-lambdas", "5", "--out", files[2]])
    return _told(spark.read.parquet(files[2]))


#: Where nearly nothing is active in the fit over events.
EVENT_LAMBDA = 1.05


@query(_path_sql(2, most_lambdas=8, model=_EVENTS, p=EVENT_COLUMNS, different=True, first_lambda=EVENT_LAMBDA, tail="""
, f AS (SELECT id, sha256(string_agg(r::varchar, ',' ORDER BY r)) f FROM al GROUP BY id)
SELECT ids.id, round(b[ids.k], 4) strength, (SELECT string_agg(g.id::varchar, ',' ORDER BY g.id) FROM f JOIN f g USING (f) WHERE f.id = ids.id) equivalent
FROM (SELECT b FROM s ORDER BY it DESC LIMIT 1), ids WHERE b[ids.k] <> 0"""))
def lasso_with_duplicates(spark, sf_dir):
    """The fit over users' events, where many products have the same rows: the first of each class, and the whole class."""
    result = fit(*tables.events(spark, sf_dir), EVENT_COLUMNS, FitConfig(depth=2, lambda_max=EVENT_LAMBDA, max_lambdas=8, ahead=0, check_duplicates=True))
    kept = result.effects.select("id", F.round("strength", 4).alias("strength"))
    if result.equivalent is None:
        return kept.withColumn("equivalent", F.lit(None).cast("string"))
    return kept.join(result.equivalent, F.col("rep") == F.col("id")).select("id", "strength", F.concat_ws(",", F.col("equivalent").cast("array<string>")).alias("equivalent"))


#: How far solutions may differ, in cents for a unit of both penalties.
DIFFER = 60_000.0


@query(_path_sql(2, most_lambdas=20, model=_MAKERS, p=MAKERS, tail=f"""
, d AS (SELECT row_number() OVER (ORDER BY it) n, lam, b FROM s WHERE it > 0 AND (sweep >= 100 OR after <= 1e-12 OR before / after < 1.01)),
r AS (SELECT d.n, max(list_max(list_transform(range(1, len(d.b) + 1), lambda q: abs(d.b[q] - g.b[q]))) / (d.lam + g.lam)) worst FROM d JOIN d g ON g.n < d.n GROUP BY d.n),
last AS (SELECT coalesce((SELECT min(n) FROM r WHERE worst > {DIFFER}), (SELECT max(n) FROM d)) n)
SELECT id, round(b[ids.k] / 1e4, 4) strength, round(lam, 4) lam FROM d JOIN last USING (n), ids WHERE b[ids.k] <> 0"""))
def lasso_calibrated(spark, sf_dir):
    """The fit that ends at the first solution too far from an earlier one."""
    result = _makers_fit(spark, sf_dir, depth=2, max_lambdas=20, calibrate=DIFFER)
    return _told(result.effects).select("id", "strength", F.round(F.lit(result.fitted_lambda), 4).alias("lam"))


@query(f"""WITH {_BASKET}, t AS (SELECT y.y::double y, (x.r IS NOT NULL)::int::double a FROM y LEFT JOIN (SELECT r FROM x WHERE c = 0) x ON x.r = y.r)
SELECT round(regr_slope(y, a), 2) slope, round(regr_intercept(y, a), 2) intercept FROM t""")
def ols_refit(spark, sf_dir):
    x, y = tables.basket(spark, sf_dir)
    z = x.filter("col_id = 0").select(F.lit(0).cast("long").alias("id"), "row_id", "val")
    done = solve.least_squares(solve.gram(z, y, [0], solve.response_sums(y)))
    return spark.createDataFrame([(round(float(done.beta[0]), 2), round(done.intercept, 2))], "slope double, intercept double")


_OBSERVED = """c AS (SELECT c, count(*) n FROM x GROUP BY 1), t AS (SELECT count(DISTINCT r) n FROM x),
o AS (SELECT a.c i, b.c j, count(*) o11 FROM x a JOIN x b ON a.r = b.r AND a.c < b.c GROUP BY 1, 2),
q AS (SELECT o.i, o.j, t.n - ci.n - cj.n + o11 o00, cj.n - o11 o01, ci.n - o11 o10, o11 FROM o JOIN c ci ON ci.c = o.i JOIN c cj ON cj.c = o.j, t)"""


@query(f"WITH {_BASKET}, {_OBSERVED} SELECT *, least(o00, o01, o10, o11) omin FROM q")
def contingency_pairs(spark, sf_dir):
    x = tables.basket(spark, sf_dir)[0]
    return screen.contingency(x, x.select("row_id").distinct().count())


_EVALUATED = f"""{_OBSERVED}, found AS (SELECT i, j, s FROM ({_PAIRS.format('')}) WHERE (i + j) % 3 = 0),
truth AS (SELECT i, j, cast((i * 7 + j * 3) % 11 - 5 AS bigint) coef FROM o WHERE (i + j) % 2 = 0),
e AS (SELECT coalesce(f.i, t.i) i, coalesce(f.j, t.j) j, f.s strength, t.coef FROM found f FULL OUTER JOIN truth t ON f.i = t.i AND f.j = t.j),
ev AS (SELECT e.i, e.j, strength, coef, coalesce(o.o11, 0) o11, strength IS NOT NULL AND coef IS NOT NULL hit, coalesce(abs(coef) >= 3, false) big FROM e LEFT JOIN o ON o.i = e.i AND o.j = e.j)"""


def _evaluated(spark, sf_dir):
    x, y = tables.basket(spark, sf_dir)
    pairs = screen.pair_screen(x, y)
    found = pairs.filter("(i + j) % 3 = 0").select("i", "j", F.col("s").alias("strength"))
    truth = pairs.filter("(i + j) % 2 = 0").select("i", "j", ((F.col("i") * 7 + F.col("j") * 3) % 11 - 5).cast("long").alias("coef"))
    return report.evaluate(found, truth, pairs.select("i", "j", F.col("nz").alias("o11")), 3)


@query(f"WITH {_BASKET}, {_EVALUATED} SELECT * FROM ev")
def evaluate_effects(spark, sf_dir):
    return _evaluated(spark, sf_dir)


@query(f"WITH {_BASKET}, {_EVALUATED} SELECT hit, big, count(*) n FROM ev GROUP BY 1, 2")
def evaluation_summary(spark, sf_dir):
    return report.summary(_evaluated(spark, sf_dir))


@query(f"""WITH {_BASKET}, pth AS (SELECT st step, (100.0::double / st) lam, c id, (s::double / 1e9) / st strength FROM (SELECT c, sum(y) s FROM x JOIN y USING (r) GROUP BY 1), (SELECT unnest([1, 2, 3]) st) WHERE c % st = 0),
st AS (SELECT DISTINCT step, lam FROM pth), ids AS (SELECT DISTINCT id FROM pth)
SELECT a.step step_a, b.step step_b, round(max(abs(coalesce(u.strength, 0) - coalesce(v.strength, 0))) / (a.lam + b.lam), 8) ratio
FROM st a JOIN st b ON a.step < b.step CROSS JOIN ids LEFT JOIN pth u ON u.step = a.step AND u.id = ids.id LEFT JOIN pth v ON v.step = b.step AND v.id = ids.id
GROUP BY a.step, b.step, a.lam, b.lam""")
def adaptive_calibration(spark, sf_dir):
    mains = screen.main_screen(*tables.basket(spark, sf_dir))
    steps = mains.select("i", "s", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("step")).filter("i % step = 0")
    path = steps.select("step", (F.lit(100.0) / F.col("step")).alias("lambda"), F.col("i").alias("id"), (F.col("s") / 1e9 / F.col("step")).alias("strength"))
    return distances(path).withColumn("ratio", F.round("ratio", 8))


@query(f"""WITH {_BASKET} SELECT y.r row_id, (1000.0 + coalesce(sum(CASE WHEN a.c = 0 THEN 5.0 WHEN a.c = 3 THEN -2.0 END), 0) + coalesce(max(p.b), 0))::double fitted
FROM y LEFT JOIN x a ON a.r = y.r AND a.c IN (0, 3) LEFT JOIN (SELECT a.r, 7.0 b FROM x a JOIN x b ON a.r = b.r WHERE a.c = 1 AND b.c = 2) p ON p.r = y.r GROUP BY y.r""")
def predict(spark, sf_dir):
    x, y = tables.basket(spark, sf_dir)
    return solve.predict(x, {0: 5.0, 3: -2.0, 2 * BRANDS + 2: 7.0}, 1000.0, y, BRANDS)


@query("SELECT o_orderkey save_seq, o_custkey lambda_count, o_orderstatus <> 'P' complete, o_totalprice lam FROM orders WHERE o_orderstatus <> 'P' ORDER BY o_orderkey DESC LIMIT 1")
def checkpoint_latest(spark, sf_dir):
    o = tables._table(spark, sf_dir, "orders")
    return latest(o.select(F.col("o_orderkey").alias("save_seq"), F.col("o_custkey").alias("lambda_count"), (F.col("o_orderstatus") != "P").alias("complete"), F.col("o_totalprice").alias("lam")))


@query("""SELECT event_type, round(quantile_cont(value, 0.25), 6) q25, round(quantile_cont(value, 0.5), 6) q50, round(quantile_cont(value, 0.75), 6) q75, count(*) n
FROM (SELECT event_type, value FROM events UNION ALL SELECT 'all', value FROM events) GROUP BY 1""")
def benchmark_quartiles(spark, sf_dir):
    e = tables._table(spark, sf_dir, "events").select("event_type", "value")
    both = e.unionByName(e.select("value"), allowMissingColumns=True).fillna("all", ["event_type"])
    return report.quartiles(both, "event_type", "value").withColumns({c: F.round(c, 6) for c in ("q25", "q50", "q75")})


@query(f"""WITH {_BASKET}, p AS ({_PAIRS.format('')}), e AS (SELECT c::bigint id, 1 ord, c i, NULL::int j, sum(y)::bigint strength FROM x JOIN y USING (r) GROUP BY c UNION ALL SELECT (i + 1::bigint) * 25 + j, 2, i, j, s FROM p)
SELECT ord, id, CASE WHEN j IS NULL THEN 'Brand#' || (i + 1) ELSE 'Brand#' || (i + 1) || ',Brand#' || (j + 1) END effect, 'Brand#' || (i + 1) i, 'Brand#' || (j + 1) j, NULL::varchar k, strength FROM e""")
def effect_report(spark, sf_dir):
    return _effects(spark, sf_dir)


def _effects(spark, sf_dir):
    x, y = tables.basket(spark, sf_dir)
    names = _brands(spark, sf_dir).select("col_id", F.concat(F.lit("Brand#"), (F.col("col_id") + 1).cast("string")).alias("name"))
    mains = _longs(screen.main_screen(x, y), "s").select(F.col("i").cast("long").alias("id"), F.col("s").alias("strength"))
    pairs = screen.pair_screen(x, y).select(pair_id(F.col("i"), F.col("j"), BRANDS).alias("id"), F.col("s").alias("strength"))
    return report.effect_table(mains.unionAll(pairs), names, BRANDS)


@query(f"""WITH {_BASKET}, p AS ({_PAIRS.format('')}), e AS (SELECT c::bigint id, sum(y)::bigint strength FROM x JOIN y USING (r) GROUP BY c UNION ALL SELECT (i + 1::bigint) * 25 + j, s FROM p)
SELECT id, -strength strength FROM e WHERE -strength < -500 ORDER BY -strength, id LIMIT 10""")
def strongest_effects(spark, sf_dir):
    """The first ten effects below -500, of sums with their sign turned."""
    return report.strongest(_effects(spark, sf_dir).select("id", (-F.col("strength")).alias("strength")), -500).select("id", "strength")


@query(f"WITH {_BASKET}, p AS ({_PAIRS.format('')}) SELECT c::bigint id, 1 ord, c i, NULL::int j FROM (SELECT DISTINCT c FROM x) UNION ALL SELECT (i + 1::bigint) * 25 + j, 2, i, j FROM p")
def ordered_effects(spark, sf_dir):
    """Distinct effects seen by either form of the screen, each with ascending columns."""
    x, y = tables.basket(spark, sf_dir)
    none = F.lit(None).cast("int")
    seen = screen.main_screen(x, y).select("i", none.alias("j"), none.alias("k"))
    for pairs in (screen.pair_screen(x, y), screen.pair_screen_by_join(x, y)):
        seen = seen.unionAll(pairs.select("i", "j", none))
    effects = ordered(seen.distinct())
    return effects.select(F.when(F.col("j").isNull(), F.col("i").cast("long")).otherwise(pair_id(F.col("i"), F.col("j"), BRANDS)).alias("id"), F.when(F.col("j").isNull(), 1).otherwise(2).alias("ord"), "i", "j")


@query(f"""WITH {_EVENTS}, {_EVENT_PRINTS}, g AS ({_CLASSES}),
nm AS (SELECT id, ord, CASE ord WHEN 1 THEN 'c' || id WHEN 2 THEN 'c' || (id // 20 - 1) || ',c' || (id % 20) ELSE 'c' || (id // 400 - 1) || ',c' || (id % 400 // 20) || ',c' || (id % 20) END effect FROM g)
SELECT g.id, any_value(nm.effect) effect, (g.id % 7)::double strength, coalesce(string_agg(o.effect, '; ' ORDER BY o.ord, o.id) FILTER (WHERE o.id <> g.id), '') equivalent
FROM g JOIN nm USING (id) JOIN g h ON h.rep = g.id JOIN nm o ON o.id = h.id WHERE g.id = g.rep GROUP BY g.id""")
def effect_equivalents(spark, sf_dir):
    """One effect of each class with the names of all that can't be told from it."""
    classed = _event_classes(spark, sf_dir)
    names = spark.range(EVENT_COLUMNS).select(F.col("id").cast("int").alias("col_id"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("name"))
    reps = classed.filter("id = rep").select("id", (F.col("id") % 7).cast("double").alias("strength"))
    full = report.with_equivalents(report.effect_table(reps, names, EVENT_COLUMNS), dedupe.equivalents(classed), names, EVENT_COLUMNS)
    return full.select("id", "effect", "strength", F.array_join("equivalent", "; ").alias("equivalent"))
