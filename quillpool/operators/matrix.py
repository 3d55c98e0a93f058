"""Sparse matrices of any size, as a table of blocks in compressed rows.

A row's or column's key has a block, by hash, and a place in it, so blocks are even whatever the keys are. A product joins
blocks on the dimension that both share, multiplies them where they meet, and adds up the results of one place; nothing has
the width of the matrix, and no key becomes a column.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

SIZE = 2_048  # keys of a block
BLOCK = "i int, j int, n int, m int, starts array<int>, places array<int>, values array<double>"


def indexed(keys: DataFrame, size: int) -> DataFrame:
    """(key, block, place) of the different keys (key): about `size` to a block."""
    keys = cut(keys.select("key").distinct())  # counted, then placed: made once
    blocks = max(1, -(-keys.count() // size))
    placed = keys.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
    return cut(placed.withColumn("place", (F.row_number().over(Window.partitionBy("block").orderBy("key")) - 1).cast("int")))


def compressed(row: np.ndarray, col: np.ndarray, value: np.ndarray, n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, places, values) of entries in any order; those of one place are added, and zeros left out."""
    at, inverse = np.unique(row.astype(np.int64) * m + col, return_inverse=True)
    summed = np.bincount(inverse, value, len(at)) if len(at) else np.zeros(0)
    at, summed = at[summed != 0], summed[summed != 0]
    starts = np.searchsorted(at, np.arange(n + 1, dtype=np.int64) * m)
    return starts.astype(np.int32), (at % m).astype(np.int32), summed


def rows_of(starts: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(starts) - 1), np.diff(starts))


def multiplied(a, b, m: int, at_once: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The product of two compressed blocks, b with m columns; some entries of a at a time."""
    (sa, ca, va), (sb, cb, vb) = a, b
    row, n = rows_of(sa), len(sa) - 1
    fan = np.diff(sb)[ca]
    ends, parts, at = np.cumsum(fan), [], 0
    while at < len(ca):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + at_once, "right")))
        f = fan[at:to]
        mine = np.repeat(np.arange(at, to), f)
        other = np.arange(len(mine)) - np.repeat(np.cumsum(f) - f, f) + np.repeat(sb[ca[at:to]], f)
        s, c, v = compressed(row[mine], cb[other], va[mine] * vb[other], n, m)
        parts.append((rows_of(s), c, v))
        at = to
    if not parts:
        return np.zeros(n + 1, np.int32), np.zeros(0, np.int32), np.zeros(0)
    return compressed(*(np.concatenate(x) for x in zip(*parts)), n, m)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["i", "j", "n", "m", "starts", "places", "values"])


def _summed(frame: pd.DataFrame) -> pd.DataFrame:
    """Blocks of one place, added."""
    i, j, n, m = (int(frame[x].iloc[0]) for x in "ijnm")
    rows = np.concatenate([rows_of(np.asarray(s, np.int64)) for s in frame["starts"]])
    columns, values = (np.concatenate([np.asarray(x) for x in frame[name]]) for name in ("places", "values"))
    return _frame([(i, j, n, m, *compressed(rows, columns, values, n, m))])


@dataclass(frozen=True)
class BlockMatrix:
    """rows, columns: (key, block, place); blocks: BLOCK, those with entries."""

    rows: DataFrame
    columns: DataFrame
    blocks: DataFrame

    @staticmethod
    def of(entries: DataFrame, rows: DataFrame | None = None, columns: DataFrame | None = None, size: int = SIZE) -> BlockMatrix:
        """From (row, column, value); entries of one place are added. rows, columns: an index to share with other matrices."""
        rows = indexed(entries.select(F.col("row").alias("key")), size) if rows is None else rows
        columns = indexed(entries.select(F.col("column").alias("key")), size) if columns is None else columns
        sized = lambda index, block, n: F.broadcast(index.groupBy(F.col("block").alias(block)).agg(F.count("*").cast("int").alias(n)))  # noqa: E731  a row a block
        a = rows.select(F.col("key").alias("row"), F.col("block").alias("i"), F.col("place").alias("r"))
        b = columns.select(F.col("key").alias("column"), F.col("block").alias("j"), F.col("place").alias("c"))
        placed = entries.join(a, "row").join(b, "column").join(sized(rows, "i", "n"), "i").join(sized(columns, "j", "m"), "j")

        def pack(frame: pd.DataFrame) -> pd.DataFrame:
            i, j, n, m = (int(frame[x].iloc[0]) for x in "ijnm")
            return _frame([(i, j, n, m, *compressed(frame["r"].to_numpy(), frame["c"].to_numpy(), frame["value"].to_numpy(float), n, m))])

        return BlockMatrix(rows, columns, cut(placed.select("i", "j", "n", "m", "r", "c", "value").groupBy("i", "j").applyInPandas(pack, BLOCK)))

    def transposed(self) -> BlockMatrix:
        def turn(frames):
            for frame in frames:
                out = []
                for r in frame.itertuples(index=False):
                    s, c, v = np.asarray(r.starts, np.int64), np.asarray(r.places, np.int64), np.asarray(r[6], float)
                    out.append((r.j, r.i, r.m, r.n, *compressed(c, rows_of(s), v, r.m, r.n)))
                yield _frame(out)

        return BlockMatrix(self.columns, self.rows, self.blocks.mapInPandas(turn, BLOCK))

    def product(self, other: BlockMatrix) -> BlockMatrix:
        """self x other; other's rows have the index of self's columns."""
        right = other.blocks.select(F.col("i").alias("k"), F.col("j").alias("l"), F.col("m").alias("p"), F.col("starts").alias("s2"), F.col("places").alias("c2"), F.col("values").alias("v2"))
        met = self.blocks.withColumnRenamed("j", "k").join(right, "k")

        def multiply(frames):
            for frame in frames:
                out = []
                for r in frame.itertuples(index=False):
                    a = np.asarray(r.starts, np.int64), np.asarray(r.places, np.int64), np.asarray(r.v1, float)
                    b = np.asarray(r.s2, np.int64), np.asarray(r.c2, np.int64), np.asarray(r.v2, float)
                    out.append((r.i, r.l, r.n, r.p, *multiplied(a, b, r.p)))
                yield _frame(out)

        partial = met.select("i", "l", "n", "p", "starts", "places", F.col("values").alias("v1"), "s2", "c2", "v2").mapInPandas(multiply, BLOCK)
        return BlockMatrix(self.rows, other.columns, cut(partial.groupBy("i", "j").applyInPandas(_summed, BLOCK)))

    def entries(self) -> DataFrame:
        """(row, column, value) of what is not 0."""

        def spread(frames):
            for frame in frames:
                for r in frame.itertuples(index=False):
                    s = np.asarray(r.starts, np.int64)
                    yield pd.DataFrame({"i": r.i, "r": rows_of(s), "j": r.j, "c": r.places, "value": r[6]})

        long = self.blocks.mapInPandas(spread, "i int, r int, j int, c int, value double")
        a = self.rows.select(F.col("key").alias("row"), F.col("block").alias("i"), F.col("place").alias("r"))
        b = self.columns.select(F.col("key").alias("column"), F.col("block").alias("j"), F.col("place").alias("c"))
        return long.join(a, ["i", "r"]).join(b, ["j", "c"]).select("row", "column", "value")

    def norms(self, kind: str = "l2") -> DataFrame:
        """(row, norm) of each row, 0 for those without entries: "l1" or "l2"."""
        if kind not in ("l1", "l2"):
            raise ValueError("a norm is 'l1' or 'l2'")

        def sums(frames):
            for frame in frames:
                for r in frame.itertuples(index=False):
                    s, v = np.asarray(r.starts, np.int64), np.asarray(r[6], float)
                    total = np.bincount(rows_of(s), np.abs(v) if kind == "l1" else v * v, r.n)
                    yield pd.DataFrame({"block": r.i, "place": range(r.n), "s": total})

        found = self.blocks.mapInPandas(sums, "block int, place int, s double").groupBy("block", "place").agg(F.sum("s").alias("s"))
        total = F.coalesce("s", F.lit(0.0))
        return self.rows.join(found, ["block", "place"], "left").select(F.col("key").alias("row"), (total if kind == "l1" else F.sqrt(total)).alias("norm"))
