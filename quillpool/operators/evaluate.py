"""Accuracy and macro F1 from (row_id, label, predicted)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def paired(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    return truth.select("row_id", "label").join(predictions.select("row_id", "predicted"), "row_id")


def accuracy(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count("*").alias("n_rows"), F.avg((F.col("label") == F.col("predicted")).cast("double")).alias("accuracy"))


def per_class(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, tp, support, predicted, f1) of every listed label; 0 where a label is neither true nor predicted."""
    each = pairs.select(F.explode(F.array(F.struct(F.col("label").alias("l"), F.lit(1).alias("s"), F.lit(0).alias("p"), F.when(F.col("label") == F.col("predicted"), 1).otherwise(0).alias("t")), F.struct(F.col("predicted").alias("l"), F.lit(0).alias("s"), F.lit(1).alias("p"), F.lit(0).alias("t")))).alias("x")).select("x.*")
    sums = each.groupBy("l").agg(F.sum("t").alias("tp"), F.sum("s").alias("support"), F.sum("p").alias("predicted"))
    out = labels.select("label").join(sums, F.col("label") == F.col("l"), "left").na.fill(0, ["tp", "support", "predicted"])
    total = F.col("support") + F.col("predicted")
    return out.select("label", "tp", "support", "predicted", F.when(total > 0, 2.0 * F.col("tp") / total).otherwise(0.0).alias("f1"))


def macro_f1(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    return per_class(pairs, labels).agg(F.avg("f1").alias("macro_f1"))


def metrics(pairs: DataFrame, labels: DataFrame) -> tuple[float | None, float | None]:
    """Accuracy and macro F1 from one pass: per-class sums hold both."""
    r = per_class(pairs, labels).agg(F.sum("tp"), F.sum("support"), F.avg("f1")).first()
    every = pairs.where("label is not null").count() if r[1] is None else r[1]
    return (r[0] / every if every else None), r[2]
