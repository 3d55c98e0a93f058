"""Labeled tables and logs: readers by file extension, tolerant log scans, appending sinks."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .excel import read_excel

READERS = {".csv": "csv", ".parquet": "parquet", ".json": "json", ".jsonl": "json", ".orc": "orc", ".xlsx": "excel"}


def read_labeled(spark: SparkSession, path: str, text: str, label: str, schema: str | None = None, sheet: int | str = 0) -> DataFrame:
    """A table with the two named columns, by the file's extension (in any case)."""
    extension = os.path.splitext(path.rstrip("/"))[1].lower()
    kind = READERS.get(extension)
    if kind is None:
        raise ValueError(f"unsupported file type {extension!r}; known: {', '.join(sorted(READERS))}")
    if kind == "excel":
        df = read_excel(spark, path, sheet)
    elif kind == "csv":
        reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
        df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    else:
        reader = spark.read.schema(schema) if schema else spark.read
        df = reader.format(kind).load(path)
    return require(df, text, label)


def require(df: DataFrame, *columns: str) -> DataFrame:
    """df, or an error that names the columns it lacks; before any job runs."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; the table has {df.columns}")
    return df


RUN_FIELDS = "iteration INT, L_size INT, internal_acc DOUBLE, internal_f1 DOUBLE, external_acc DOUBLE, external_f1 DOUBLE, iteration_duration_sec DOUBLE, train_duration_sec DOUBLE, eval_duration_sec DOUBLE, query_duration_sec DOUBLE, update_duration_sec DOUBLE, U_size INT, status STRING, error STRING"
NAMED = "STRUCT<type STRING, params MAP<STRING, STRING>>"
CONFIG = f"STRUCT<data_params STRUCT<min_samples_per_class DOUBLE, population_size DOUBLE>, al_params STRUCT<cold_start_config {NAMED}, classifier_config {NAMED}, query_strategy_config {NAMED}>, general_params STRUCT<random_seed DOUBLE>>"
LOG_SCHEMA = f"experiment_name STRING, execution_timestamp STRING, status STRING, config {CONFIG}, baseline_metrics STRUCT<baseline_acc DOUBLE, baseline_f1 DOUBLE, baseline_train_time_sec DOUBLE>, history_data ARRAY<STRUCT<{RUN_FIELDS}>>, total_duration_sec DOUBLE, error_message STRING, manager_wall_time_sec DOUBLE"


def parse_log(lines: DataFrame) -> DataFrame:
    """Run records of (value string, one JSON object a line), with the other columns of lines; a line that is none gets only _corrupt_record."""
    schema = LOG_SCHEMA + ", _corrupt_record STRING"
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record", "allowNonNumericNumbers": "true"})
    others = [c for c in lines.columns if c != "value"]
    return lines.select(*others, parsed.alias("r")).select(*others, "r.*")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_log(spark.read.text(path))


def log_line(entry: dict) -> str:
    """A run record as a line; NaN is kept as such, other objects as text."""
    return json.dumps(entry, ensure_ascii=False, default=str)


def append_log(spark: SparkSession, path: str, entries: list[dict]) -> None:
    """Run records as further files of a plain JSON-lines folder, whose files have no order of their own."""
    spark.createDataFrame([(log_line(e),) for e in entries], "value string").coalesce(1).write.mode("append").text(path)


def append_csv(df: DataFrame, path: str) -> None:
    """Rows as further files of a CSV folder, every file with a header; nothing for an empty table."""
    if not df.isEmpty():
        df.write.mode("append").option("header", True).option("quoteAll", False).option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What append_csv wrote; quoted line ends and quotes come back as they were."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(schema).csv(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table, through its own file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
