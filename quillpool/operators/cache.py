"""Embedding caches by content: a row's vector is found again by its text and by what the embedder was fitted on.

A fingerprint tells fits apart: it covers row ids, texts, labels and settings, in any order of rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from ..sources.commitlog import Commits

VECTORS = "digest string, vec array<double>"


def row_sums(rows: DataFrame, *by: str) -> DataFrame:
    """(*by, n, a, b): how many rows, and the sums of two 60-bit parts of the MD5 of each row's values.

    The same for any order and partitioning; no group is gathered. Columns are taken in the order of their names.
    """
    values = [F.coalesce(F.col(c).cast("string"), F.lit("\x01")) for c in sorted(rows.columns)]
    h = F.md5(F.concat_ws("\x1f", *values))
    part = lambda at: F.sum(F.conv(F.substring(h, at, 15), 16, 10).cast("decimal(38,0)"))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), part(1).alias("a"), part(17).alias("b"))


def fingerprint(rows: DataFrame, *settings) -> str:
    """Hex digest of a table, as a set of rows, and of settings."""
    total = row_sums(rows).first()
    return hashlib.sha256(repr((sorted(rows.columns), total.n, str(total.a), str(total.b), settings)).encode()).hexdigest()


def digest(*values: Column) -> Column:
    """Hex SHA-256 of a row's values; null is a value of its own."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), v.cast("string")), F.lit("0")) for v in values]), 256)


class RowCache(Commits):
    """Vectors by content: each different text is embedded once by each fit, whoever asks, whatever its row is called.

    An entry names a table (digest, vec) and the fit it is of; it is there whole or not at all, and several writers may add
    entries at once (see sources/commitlog.py). Two that embed the same text at the same time both add it; their vectors are
    equal, and `compact` keeps one.
    """

    made = 0  # texts that the last call of vectors embedded

    def tables(self, fit: str) -> list[str]:
        """Paths of the tables of a fit, from its last compaction on."""
        files = [f"{self.path}/entries/{n:020d}" for n in self._numbers("entries")]
        if not files:
            return []
        entries = self.spark.read.json(files, schema="fit string, data string, instead array<string>").where(F.col("fit") == fit).collect()  # a row an append
        gone = {d for e in entries for d in e.instead or []}
        return [f"{self.path}/data/{e.data}" for e in entries if e.data not in gone]

    def read(self, fit: str) -> DataFrame:
        """(digest, vec) of a fit; a digest may be there more than once, always with the same vector."""
        found = self.tables(fit)
        return self.spark.read.schema(VECTORS).parquet(*found) if found else self.spark.createDataFrame([], VECTORS)

    def vectors(self, rows: DataFrame, fit: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """(row_id, vec) of rows (row_id, text); make: from (row_id, text) to (row_id, vec), of the texts that are not there yet."""
        keyed = rows.select("row_id", "text", digest(F.col("text")).alias("digest"))
        wanted = keyed.select("digest", "text").dropDuplicates(["digest"])
        missing = cut(wanted.join(self.read(fit).select("digest"), "digest", "left_anti").select(F.col("digest").alias("row_id"), "text"))
        self.made = missing.count()
        if self.made:
            name = self._new_table()
            made = make(missing).select(F.col("row_id").alias("digest"), F.col("vec").cast("array<double>").alias("vec"))
            made.write.parquet(f"{self.path}/data/{name}")
            self._commit(json.dumps({"fit": fit, "data": name}) + "\n")
        once = self.read(fit).join(keyed.select("digest"), "digest", "left_semi").dropDuplicates(["digest"])
        return keyed.select("row_id", "digest").join(once, "digest").select("row_id", "vec")

    def compact(self, fit: str) -> int:
        """Puts all tables of a fit in place as one, each digest once; the number of tables that it replaces.

        What others add in the meantime stays beside it. Old files remain for readers that still hold them.
        """
        before = self.tables(fit)
        if len(before) > 1:
            name = self._new_table()
            self.spark.read.schema(VECTORS).parquet(*before).dropDuplicates(["digest"]).write.parquet(f"{self.path}/data/{name}")
            self._commit(json.dumps({"fit": fit, "data": name, "instead": [b.rsplit("/", 1)[1] for b in before]}) + "\n")
        return len(before)
