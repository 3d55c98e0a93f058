"""Experiment configurations: a JSON list, control plane only."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REQUIRED = ("experiment_name", "active", "data_params", "al_params")


def load_configs(path: str = "experiments.json") -> list[dict]:
    """The list in the file; empty, never an error, if there is none or it holds something else."""
    try:
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
    except (OSError, ValueError):
        return []
    return found if isinstance(found, list) else []


def valid(config: dict) -> bool:
    return isinstance(config, dict) and all(k in config for k in REQUIRED)


def pending(configs: DataFrame, completed: DataFrame, force: bool = False) -> DataFrame:
    """configs (experiment_name, active, is_valid) still to run; `force` only lifts the completed ones' exclusion."""
    open_ = configs.where(F.col("active") & F.col("is_valid"))
    return open_ if force else open_.join(completed, "experiment_name", "left_anti")
