"""Experiment analytics: learning-curve efficiency, early stopping, and the data behind plots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.quantiles import quantiles


def finite(x: Column) -> Column:
    """x, or null where it is not a finite number."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def lce(points: DataFrame) -> DataFrame:
    """(run, lce) from (run, x, y, baseline): trapezoid area over baseline times width.

    Null where the baseline is missing or not positive, for fewer than two points, and where the width is zero.
    """
    w = Window.partitionBy("run").orderBy("x", "y")
    steps = points.where("x is not null and y is not null").withColumn("area", (F.col("x") - F.lag("x").over(w)) * (F.col("y") + F.lag("y").over(w)) / 2)
    each = steps.groupBy("run").agg(F.sum("area").alias("area"), (F.max("x") - F.min("x")).alias("width"), F.count("*").alias("n"), F.max("baseline").alias("baseline"))
    runs = points.select("run").distinct().join(each, "run", "left")
    good = (F.col("baseline") > 0) & (F.col("n") >= 2) & (F.col("width") > 0)
    return runs.select("run", F.when(good, F.col("area") / (F.col("baseline") * F.col("width"))).alias("lce"))


def early_stop(history: DataFrame, tolerance: float = 0.001, patience: int = 3) -> DataFrame:
    """(run, best, stop_iteration) from (run, iteration, v): a fold, since the best only moves when beaten by more than the tolerance.

    A null v changes nothing. A run's history is its iterations, so it fits an array.
    """
    steps = history.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("iteration", "v"))).alias("h"))
    none = F.lit(None).cast("double")
    start = F.struct(none.alias("best"), F.lit(0).alias("k"), F.lit(None).cast("int").alias("stop"))

    def step(s, x):
        better = s["best"].isNull() | (x["v"] > s["best"] + tolerance)
        k = F.when(better, F.lit(0)).otherwise(s["k"] + 1)
        moved = F.struct(F.when(better, x["v"]).otherwise(s["best"]).alias("best"), k.alias("k"), F.when(k >= patience, x["iteration"].cast("int")).alias("stop"))
        return F.when(s["stop"].isNotNull() | x["v"].isNull(), s).otherwise(moved)

    return steps.select("run", F.aggregate("h", start, step).alias("s")).select("run", F.col("s.best").alias("best"), F.col("s.stop").alias("stop_iteration"))


def curve_points(flat: DataFrame, x: str, y: str) -> DataFrame:
    """(experiment_name, x, y): pairs in which both are there."""
    return flat.select("experiment_name", F.col(x).alias("x"), finite(F.col(y)).alias("y")).where("x is not null and y is not null")


def sampled_generations(rows: DataFrame, step: int) -> DataFrame:
    """Rows of every step-th generation, and of the last."""
    each = rows.select("generation").distinct()
    n = each.withColumn("r", F.row_number().over(Window.orderBy("generation")))  # over generations
    kept = n.withColumn("last", F.max("r").over(Window.partitionBy())).where(((F.col("r") - 1) % step == 0) | (F.col("r") == F.col("last"))).select("generation")
    return rows.join(kept, "generation", "left_semi")


def boxplot(rows: DataFrame, value: str, few: int = 50_000) -> DataFrame:
    """(generation, n, low, q1, median, q3, high): exact quartiles, by linear interpolation, of generations of any size."""
    out = quantiles(rows, value, [0.25, 0.5, 0.75], ["generation"], few)
    return out.select("generation", "n", "low", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "high")


def described(rows: DataFrame, value: str, few: int = 50_000) -> DataFrame:
    """One row: count, mean, std, min, quartiles, max."""
    moments = rows.agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))  # one row
    out = quantiles(rows, value, [0.25, 0.5, 0.75], few=few).join(F.broadcast(moments), F.lit(True))
    return out.select("n", "mean", "std", "low", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "high")
