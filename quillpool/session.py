"""Session and shared-storage helpers used by every part of the library."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder, read by Spark alone (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, part_bytes: int = 32 << 20) -> DataFrame:
    """df over all cores where its files are too small, or too few, to give each core a part; as it is where they are not.

    Only the estimated size decides, so no job runs, and large inputs are never shuffled by this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * part_bytes else df


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder all executors share.

    It is the cluster's spark.checkpoint.dir; only in a local session that sets none, as in tests, a temporary folder is
    made and removed at exit.
    """
    sc = spark.sparkContext
    wanted = sc.getConf().get("spark.checkpoint.dir")
    if wanted is None:
        current = sc.getCheckpointDir()
        if current:
            return current
        if not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        wanted = tempfile.mkdtemp(prefix="quillpool-")
        atexit.register(shutil.rmtree, wanted, True)
        wanted = f"file://{wanted}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(wanted)
    return wanted


def cut(df: DataFrame) -> DataFrame:
    """Write df reliably to the shared folder and go on from there: computed once, and no executor's loss undoes it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def few(df: DataFrame, most_bytes: int = 32 << 20) -> DataFrame:
    """A table of a row a class, or of a search's genes, written, and sent to every task if its measured size allows: a join by shuffles would take all of a class's rows to one task."""
    df = cut(df)
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))) + 64)).first()[0] or 0
    return F.broadcast(df) if size <= most_bytes else df


def large(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: never sent through the driver, however small Spark takes it to be.

    Of a written table Spark has only a guess from the plan that made it. A side that `few` or F.broadcast marks is still sent.
    """
    return df.hint("merge")


def written(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there to its end; asks the path's own file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
