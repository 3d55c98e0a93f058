"""A folder of Excel workbooks as a data source: `df.write.format("workbooks").save(folder)`, a workbook or more a partition.

Tasks write their rows where they are; nothing comes to the driver. A workbook holds up to `sheet_rows` rows, so a task's
memory is bounded, and no sheet is longer than the format allows. What a task writes counts when the job commits: files
of failed or repeated tasks are removed, and `committed.json` lists those that count.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from .excel import LIST, MOST_ROWS, workbook


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


def _opened(folder: str):
    """The file system of a folder's URI and the folder in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


class WorkbookWriter(DataSourceWriter):
    def __init__(self, folder: str, columns: list[str], sheet: str, sheet_rows: int, overwrite: bool):
        self.folder, self.columns, self.sheet, self.sheet_rows, self.overwrite = folder, columns, sheet, sheet_rows, overwrite

    def write(self, rows: Iterator[Row]) -> Written:
        store, root = _opened(self.folder)
        store.create_dir(root, recursive=True)
        names, held = [], []

        def flush() -> None:
            name = f"part-{uuid.uuid4().hex}.xlsx"
            with store.open_output_stream(f"{root}/{name}") as out:
                out.write(workbook(self.columns, held, self.sheet))
            names.append(name)
            held.clear()

        for row in rows:
            held.append(tuple(row))
            if len(held) == self.sheet_rows:
                flush()
        if held:
            flush()
        return Written(names)

    def _listed(self) -> list[str]:
        store, root = _opened(self.folder)
        try:
            with store.open_input_stream(f"{root}/{LIST}") as f:
                return json.loads(f.read())
        except FileNotFoundError:
            return []

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _opened(self.folder)
        before = self._listed()
        names = sorted(n for m in messages if m is not None for n in m.files)
        if not names and (self.overwrite or not before):  # a table without rows still has columns
            store.create_dir(root, recursive=True)
            names = [f"part-{uuid.uuid4().hex}.xlsx"]
            with store.open_output_stream(f"{root}/{names[0]}") as out:
                out.write(workbook(self.columns, [], self.sheet))
        with store.open_output_stream(f"{root}/{LIST}") as out:
            out.write(json.dumps(names if self.overwrite else [*before, *names]).encode())
        if self.overwrite:
            for name in before:
                store.delete_file(f"{root}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        store, root = _opened(self.folder)
        for m in messages:
            for name in m.files if m is not None else []:
                store.delete_file(f"{root}/{name}")


class Workbooks(DataSource):
    """Options: path, a URI that every executor can write; sheet, its name; sheet_rows, rows a workbook at most."""

    @classmethod
    def name(cls) -> str:
        return "workbooks"

    def writer(self, schema: StructType, overwrite: bool) -> WorkbookWriter:
        rows = int(self.options.get("sheet_rows", 100_000))
        if not 1 <= rows < MOST_ROWS:
            raise ValueError(f"a sheet holds 1 to {MOST_ROWS - 1} rows")
        return WorkbookWriter(self.options["path"], schema.fieldNames(), self.options.get("sheet", "Sheet1"), rows, overwrite)


def write_workbooks(df: DataFrame, folder: str, sheet: str = "Sheet1", sheet_rows: int = 100_000, mode: str = "append") -> None:
    """df as workbooks in a folder; read_excel reads the folder as one table. Columns are numbers, truth values and texts."""
    spark: SparkSession = df.sparkSession
    spark.dataSource.register(Workbooks)
    df.write.format("workbooks").option("sheet", sheet).option("sheet_rows", sheet_rows).mode(mode).save(_uri(spark, folder))


def _uri(spark: SparkSession, path: str) -> str:
    """path with its file system's name, as every task understands it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = str(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toUri())
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full
