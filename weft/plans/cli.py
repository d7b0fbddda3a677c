"""``python -m weft.plans.cli X.csv Y.csv``: fit two text files and print or write the effects."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from weft.plans.calibration import may_continue
from weft.plans.path import FitConfig, fit
from weft.sources.checkpoint import Checkpoints
from weft.sources.text import read_x_csv, read_y_csv, x_shape


def main(argv: list[str] | None = None) -> int:
    a = argparse.ArgumentParser(description="Interaction search by square-root lasso")
    a.add_argument("x")
    a.add_argument("y")
    a.add_argument("--rows", type=int, help="the first rows to use; default all")
    a.add_argument("--columns", type=int, help="columns of X; default as many as its lines hold")
    a.add_argument("--depth", type=int, default=2, choices=(1, 2, 3))
    a.add_argument("--lambda-min", type=float)
    a.add_argument("--lambda-max", type=float)
    a.add_argument("--max-lambdas", type=int, default=200)
    a.add_argument("--max-nz", type=int)
    a.add_argument("--distance", type=int)
    a.add_argument("--halt", type=float, default=1.01)
    a.add_argument("--hierarchy", choices=("compat", "strong"))
    a.add_argument("--duplicates", action="store_true")
    a.add_argument("--unbiased", action="store_true")
    a.add_argument("--calibrate", action="store_true", help="also tell whether the solutions of the path agree well enough to go on")
    a.add_argument("--checkpoints")
    a.add_argument("--output", choices=("terminal", "file", "quit"), default="terminal", help="print effects, write them, or only fit (and save states)")
    a.add_argument("--out", help="a folder for the effects, as Parquet; implies --output file")
    o = a.parse_args(argv)
    if o.output == "file" and not o.out:
        a.error("--output file needs --out")
    spark = SparkSession.builder.getOrCreate()
    n, p = x_shape(spark, o.x)
    if o.columns is not None and o.columns != p:
        a.error(f"lines of {o.x} hold {p} columns, not {o.columns}")
    if o.rows is not None and o.rows > n:
        a.error(f"{o.x} holds {n} rows, not {o.rows}")
    x, y = read_x_csv(spark, o.x, p), read_y_csv(spark, o.y)
    if o.rows is not None:
        x, y = x.filter(F.col("row_id") < o.rows), y.filter(F.col("row_id") < o.rows)
    config = FitConfig(depth=o.depth, lambda_min=o.lambda_min, lambda_max=o.lambda_max, max_lambdas=o.max_lambdas, max_nz_beta=o.max_nz, max_interaction_distance=o.distance, halt_error_diff=o.halt, hierarchy=o.hierarchy, check_duplicates=o.duplicates, estimate_unbiased=o.unbiased)
    log = Checkpoints(spark, o.checkpoints, config) if o.checkpoints else None
    result = fit(x, y, p, config, resume=log.restore() if log else None, save=log.save if log else None)
    if o.calibrate:
        path = spark.createDataFrame(result.path, "step int, lambda double, id long, strength double")
        print("the path may go on" if may_continue(path) else "the path should have ended")
    if o.out:
        result.effects.write.mode("overwrite").parquet(o.out)
    elif o.output == "terminal":
        print(f"intercept {result.intercept:.6g}, penalty {result.fitted_lambda:.6g}")
        for r in result.effects.orderBy("ord", "id").toLocalIterator():
            print(",".join(str(c) for c in (r["i"], r["j"], r["k"]) if c is not None), f"{r['strength']:.6g}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
