"""A batch of experiments, one after the other; one failure does not end the batch."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .config import load_configs, valid
from .curves import curve_points
from .history import HistoryManager, session_summary
from .learner import ActiveLearner


class ExperimentManager:
    def __init__(self, spark: SparkSession, config_path: str, log_path: str, load: Callable[[dict], DataFrame]):
        """load: from a configuration's data_params to the raw table."""
        self.spark, self.config_path, self.load = spark, config_path, load
        self.history = HistoryManager(spark, log_path)
        self.configs: list[dict] = []
        self.session: list[tuple[str, str]] = []

    def load_and_prepare(self) -> int:
        self.configs = load_configs(self.config_path)
        return len(self.configs)

    def run_pending(self, force: bool = False) -> list[tuple[str, str]]:
        done = set() if force else self.history.completed()
        self.session = []
        for config in self.configs:
            if not valid(config) or not config["active"] or config["experiment_name"] in done:
                continue
            began, learner, entry = time.time(), None, None
            try:
                learner = ActiveLearner(config)
                learner.setup(self.load(config["data_params"]))
                entry = learner.run().summary()
            except KeyboardInterrupt:
                entry = self._failed(config, learner, "INTERRUPTED", "interrupted")
                raise
            except Exception as error:
                entry = self._failed(config, learner, "FAILED", str(error)[:2000])
            finally:  # logged once, however it ended
                entry["manager_wall_time_sec"] = time.time() - began
                self.history.record(entry)
                self.session.append((config["experiment_name"], entry["status"]))
        return self.session

    @staticmethod
    def _failed(config: dict, learner: ActiveLearner | None, status: str, message: str) -> dict:
        entry = learner.summary() if learner else {"experiment_name": config["experiment_name"], "execution_timestamp": time.strftime("%Y-%m-%d %H:%M:%S"), "config": config, "history_data": []}
        return entry | {"status": status, "error_message": message}

    def summary(self) -> DataFrame:
        return session_summary(self.spark.createDataFrame(self.session, "experiment_name string, status string"))

    def result(self, name: str) -> DataFrame:
        return self.history.latest(name)

    def curve(self, name: str, metric: str = "external_acc") -> DataFrame:
        return curve_points(self.history.iterations(name), "L_size", metric)
