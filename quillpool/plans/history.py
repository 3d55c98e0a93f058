"""The experiment log: runs as rows, flattened to iterations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.commitlog import CommitLog
from ..sources.tables import RUN_FIELDS, log_line, parse_log

ITERATION = [f.split()[0] for f in RUN_FIELDS.split(", ")]


def completed_names(log: DataFrame) -> DataFrame:
    return log.where("status = 'COMPLETED'").select("experiment_name").distinct()


def latest_runs(log: DataFrame) -> DataFrame:
    """Of each experiment the completed run with the greatest timestamp string; of several the first in the log.

    log needs (number, place), a row's place in it.
    """
    rows = log.where("status = 'COMPLETED'")
    best = F.max_by(F.struct(*rows.columns), F.struct("execution_timestamp", (-F.col("number")).alias("n"), (-F.col("place")).alias("p")))
    return rows.groupBy("experiment_name").agg(best.alias("r")).select("r.*")


def flatten(log: DataFrame) -> DataFrame:
    """A row for each iteration of each completed run with a history: run fields first, then the iteration's."""
    named = lambda c: F.coalesce(c, F.lit("N/A"))
    al = "config.al_params."
    rows = log.where("status = 'COMPLETED' and size(history_data) > 0").select("*", F.explode("history_data").alias("h"))
    run = [
        named(F.col("experiment_name")).alias("experiment_name"), F.col("execution_timestamp").alias("timestamp_str"),
        F.try_to_timestamp("execution_timestamp", F.lit("yyyy-MM-dd HH:mm:ss")).alias("timestamp_dt"),
        F.coalesce("manager_wall_time_sec", "total_duration_sec").alias("overall_experiment_duration_sec"), F.col("total_duration_sec").alias("loop_run_duration_sec"),
        F.col("baseline_metrics.baseline_acc").alias("baseline_acc"), F.col("baseline_metrics.baseline_f1").alias("baseline_f1"),
        named(F.col(al + "cold_start_config.type")).alias("cold_start_type"), named(F.col(al + "classifier_config.type")).alias("classifier_type"),
        F.coalesce(F.to_json(F.col(al + "classifier_config.params")), F.lit("{}")).alias("classifier_params_str"),
        named(F.col(al + "query_strategy_config.type")).alias("query_strategy_type"),
        F.expr(f"try_cast({al}query_strategy_config.params['batch_size'] as double)").alias("query_batch_size"),
        F.expr(f"try_cast({al}query_strategy_config.params['entropy_fraction'] as double)").alias("query_entropy_fraction"),
        F.col("config.data_params.min_samples_per_class").alias("min_samples_per_class"), F.col("config.data_params.population_size").alias("population_size_pct"),
        F.col("config.general_params.random_seed").alias("random_seed"),
    ]
    return rows.select(*run, *[F.col(f"h.{c}").alias(c) for c in ITERATION])


def session_summary(runs: DataFrame) -> DataFrame:
    """(status, experiment_name, runs): how the runs of each experiment ended."""
    return runs.groupBy("status", "experiment_name").agg(F.count("*").alias("runs"))


class HistoryManager:
    """The runs in a log that several managers may write to (see sources/commitlog.py)."""

    def __init__(self, spark, path: str):
        self.spark, self.commits = spark, CommitLog(spark, path)

    def log(self, after: int = 0) -> DataFrame:
        """The records, with their (number, place); those after a number alone."""
        return parse_log(self.commits.read(after))

    def adopt(self, path: str) -> int:
        """Takes over the lines of a plain JSON-lines log, a file or a folder."""
        return self.commits.append(self.spark.read.text(path))

    def completed(self) -> set[str]:
        return {r[0] for r in completed_names(self.log()).collect()}

    def record(self, entry: dict) -> None:
        self.commits.append([log_line(entry)])

    def latest(self, name: str) -> DataFrame:
        return latest_runs(self.log().where(F.col("experiment_name") == name))

    def iterations(self, name: str) -> DataFrame:
        return flatten(self.latest(name))
