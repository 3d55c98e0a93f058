"""Pool state: labelled rows L and pool U, by row_id; never by position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def take(pool: DataFrame, chosen: DataFrame) -> DataFrame:
    return pool.join(chosen.select("row_id"), "row_id", "left_semi")


def remaining(pool: DataFrame, chosen: DataFrame) -> DataFrame:
    return pool.join(chosen.select("row_id"), "row_id", "left_anti")


def answered(chosen: DataFrame, truth: DataFrame) -> DataFrame:
    """chosen with the simulated oracle's label, null where the truth has none."""
    return chosen.join(truth.select("row_id", "label"), "row_id", "left")


def selections(answers: DataFrame, chosen: DataFrame, experiment: str | None, iteration: int, strategy: str) -> DataFrame:
    """The selection log's rows: what was asked and answered in a round. The score is null unless rows were taken by entropy."""
    score = F.col("score") if strategy == "ENT" else F.lit(None).cast("double")
    rows = answers.where("label is not null").join(chosen, "row_id")
    return rows.select(F.lit(experiment).cast("string").alias("experiment_name"), F.lit(iteration).alias("iteration"), F.lit(strategy).alias("query_strategy"), "row_id", "text", F.col("label").alias("oracle_label"), score.alias("uncertainty_score"))


def update(labelled: DataFrame, pool: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(L, U) after a batch: valid answers join L; all rows asked for leave U, unless no answer was valid at all.

    answers: (row_id, text, label). The exception is a flag in the plan, so that no job runs here.
    """
    valid = answers.where(F.col("label").isNotNull())
    some = valid.agg((F.count("*") > 0).alias("some"))  # one row
    gone = answers.select("row_id").crossJoin(F.broadcast(some)).where("some")
    return labelled.unionByName(valid.select(*[c for c in labelled.columns]), allowMissingColumns=True), remaining(pool, gone)
