"""A log of text lines that several writers append to, in one order and without locks.

An append is an entry with the next number, put in place only if that number is still free; who comes second takes the one
after it. So every reader sees the same order, by number and then by place in the entry, whatever clocks say, and no append
is lost or seen in part. Few lines stand in the entry itself; a table's lines are written first, by tasks, and the entry names
them. A snapshot has all lines up to a number in one table, so readers open that and the entries after it; reading on from a
number opens later entries alone.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "number long, place long, value string"


class Commits:
    """Numbered entries in a folder of its own, on any file system that all writers and readers see."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    # files

    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._at(self.path).getFileSystem(self._conf)

    def _numbers(self, kind: str) -> list[int]:
        """The numbers there are, in order; none in a folder that is not there."""
        fs, folder = self._fs(), self._at(f"{self.path}/{kind}")
        if not fs.exists(folder):
            return []
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(folder) if f.getPath().getName().isdigit())

    def _put(self, kind: str, number: int, text: str) -> bool:
        """Puts a whole file in place under a number; False, and nothing done, if the number is taken."""
        fs, jvm = self._fs(), self._jvm
        draft, final = self._at(f"{self.path}/drafts/{uuid.uuid4().hex}"), self._at(f"{self.path}/{kind}/{number:020d}")
        out = fs.create(draft, True)
        out.write(text.encode())
        out.close()
        fs.mkdirs(final.getParent())
        try:
            uri = fs.makeQualified(final).toUri()
            if uri.getScheme() == "file":  # a link is made in one step or not at all; renaming would replace
                paths = jvm.java.nio.file.Paths
                jvm.java.nio.file.Files.createLink(paths.get(uri), paths.get(fs.makeQualified(draft).toUri()))
            else:
                none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(uri, self._conf).rename(draft, final, none)
            return True
        except Exception:
            if not fs.exists(final):
                raise
            return False
        finally:
            fs.delete(draft, False)

    def _commit(self, text: str) -> int:
        """Puts an entry in place under the next free number, and returns it."""
        number = self.last() + 1
        while not self._put("entries", number, text):
            number += 1
        return number

    def last(self) -> int:
        """The greatest number, 0 if there is none."""
        return max([0, *self._numbers("entries")[-1:]])

    def _new_table(self) -> str:
        return uuid.uuid4().hex


class CommitLog(Commits):
    """Lines in the order of their entries."""

    # writing

    def append(self, lines: list[str] | DataFrame) -> int:
        """The number under which lines, a list or the rows of (value) in their order, are in the log. Nothing takes none: -1."""
        if isinstance(lines, DataFrame):
            name = self._new_table()
            lines.select(F.monotonically_increasing_id().alias("place"), "value").write.parquet(f"{self.path}/data/{name}")
            text = json.dumps({"data": name}) + "\n"
        else:
            if not lines:
                return -1
            text = "".join(json.dumps({"place": i, "value": v}, ensure_ascii=False) + "\n" for i, v in enumerate(lines))
        return self._commit(text)

    def snapshot(self) -> int:
        """Copies all lines into one table; later reads start there. The number up to which it reaches."""
        number, name = self.last(), self._new_table()
        if number and number not in self._numbers("snapshots"):
            self.read(upto=number).write.parquet(f"{self.path}/data/{name}")
            self._put("snapshots", number, json.dumps({"data": name}) + "\n")  # another writer's is as good
        return number

    # reading

    def read(self, after: int = 0, upto: int | None = None) -> DataFrame:
        """(number, place, value) of the entries after one number, up to another; (number, place) is the log's order."""
        upto = self.last() if upto is None else upto
        parts, start = [], after
        known = [n for n in self._numbers("snapshots") if after < n <= upto]
        if known:
            start = known[-1]
            named = self.spark.read.json(f"{self.path}/snapshots/{start:020d}", schema="data string").first()
            parts.append(self.spark.read.parquet(f"{self.path}/data/{named.data}").where(F.col("number") > after))
        files = [f"{self.path}/entries/{n:020d}" for n in self._numbers("entries") if start < n <= upto]
        if files:
            entries = self.spark.read.json(files, schema="place long, value string, data string").select(F.col("_metadata.file_name").cast("long").alias("number"), "place", "value", "data")
            parts.append(entries.where("data is null").select("number", "place", "value"))
            for r in entries.where("data is not null").select("number", "data").orderBy("number").collect():  # a row for each table appended since
                parts.append(self.spark.read.schema("place long, value string").parquet(f"{self.path}/data/{r.data}").select(F.lit(r.number).cast("long").alias("number"), "place", "value"))
        out = self.spark.createDataFrame([], SCHEMA)
        for part in parts:
            out = out.unionAll(part)
        return out
