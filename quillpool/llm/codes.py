"""Vectors as short codes: a part's nearest codebook entry, found in float32 and proven in int64.

Components become integers, so nearest entries, means and errors are exact and the same on any cluster. A float32 matrix
product screens the entries of a codebook; each product comes with a bound on its rounding error, and every entry whose
interval reaches below the least upper end is compared again in int64. Ties go to the lower index. A round is one pass over
the vectors: tasks send sums for each entry they used, never rows, and the driver holds the codebooks alone (entries x
dimensions numbers).

Defined results: a null vector, and one with a null, infinite or NaN component, is dropped. A vector of another length
than that of the least id (null last) has a null code and null errors, and takes no part in training. Rows of one id are
rows of their own; the first codebooks are cut from the least ids (of equal ones from the least vector). Fewer vectors than
entries make smaller codebooks. Null labels are one label. A length that `parts` does not divide, and components so large
that a squared distance does not fit a long, raise ValueError. An empty table gives an empty table. Further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

UNIT = 2.0**-24  # half the distance from 1 to the next float32


@dataclass(frozen=True)
class Codebooks:
    """books: int64, part x entry x position in the part."""

    books: np.ndarray
    scale: int = 1024

    @property
    def dimensions(self) -> int:
        return self.books.shape[0] * self.books.shape[2]

    def sha256(self) -> str:
        return sha256(",".join(map(str, self.books.reshape(-1).tolist())).encode()).hexdigest()


def nearest(points: np.ndarray, book: np.ndarray, at_once: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each point's nearest entry, ties to the lower index; all int64."""
    width = max(1, points.shape[1])
    index, error = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
    norms = (book * book).sum(1)
    book32, norms32, lengths = book.astype(np.float32).T, norms.astype(np.float32), np.sqrt(norms.astype(float))
    # a product of n terms is off by at most n * UNIT / (1 - n * UNIT) times the lengths, in whatever order it is summed;
    # four more roundings: both conversions, the entry's square, the difference
    n = (width + 4) * UNIT
    share = 2 * n / (1 - n) * 1.001
    step = max(1, at_once // max(1, len(book)))
    for start in range(0, len(points), step):
        some = points[start : start + step]
        screened = norms32 - 2 * (some.astype(np.float32) @ book32)
        off = share * np.sqrt((some * some).sum(1).astype(float))[:, None] * lengths + 4 * UNIT * norms
        open_ = screened - off <= (screened + off).min(1)[:, None]
        row, entry = np.nonzero(open_)
        exact = np.concatenate([_squared(some[row[at : at + at_once // width + 1]] - book[entry[at : at + at_once // width + 1]]) for at in range(0, len(row), at_once // width + 1)])
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        least = np.minimum.reduceat(exact, first)
        best = np.flatnonzero(exact == np.repeat(least, np.diff(np.r_[first, len(row)])))
        chosen = best[np.r_[True, row[best][1:] != row[best][:-1]]]  # entries ascend inside a row
        index[start : start + step], error[start : start + step] = entry[chosen], least
    return index, error


def _squared(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


def _integers(column: pa.Array, dimensions: int, scale: int, parts: int) -> np.ndarray:
    """floor(scale * component) of each row, as rows x parts x width."""
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(float) * scale)
    most = 2.0 ** ((61 - np.log2(max(1, dimensions // parts))) / 2)  # twice that, squared, width times, fits a long
    if len(flat) and np.abs(flat).max() > most:
        raise ValueError(f"components of more than {most / scale:.0f} have squared distances that do not fit a long")
    return flat.astype(np.int64).reshape(-1, parts, dimensions // parts)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, vec) of the rows whose vec is whole and finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vectors.select("vec_id", "label", "vec").where(F.col("vec").isNotNull() & ~F.exists("vec", bad))


def start(vectors: DataFrame, entries: int = 256, parts: int = 4, scale: int = 1024) -> Codebooks | None:
    """Codebooks cut from the vectors of the least ids; None without any vector."""
    least = lambda df: [r.vec for r in df.orderBy(F.col("vec_id").asc_nulls_last(), "vec").select("vec").limit(entries).collect()]
    found = least(vectors)
    if not found:
        return None
    dimensions = len(found[0])
    if any(len(v) != dimensions for v in found):
        found = least(vectors.where(F.size("vec") == dimensions))
    if dimensions % parts:
        raise ValueError(f"vectors of {dimensions} components have no {parts} equal parts")
    flat = pa.array([list(map(float, v)) for v in found], pa.list_(pa.float64()))
    return Codebooks(_integers(flat, dimensions, scale, parts).transpose(1, 0, 2).copy(), scale)


def _sums(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """(slot, n, total): of each entry (part * entries + index) the parts it was nearest to, and their sum."""
    parts, entries, width = books.books.shape
    sent = vectors.sparkSession.sparkContext.broadcast(books)

    def held(counts: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        used = np.flatnonzero(counts)
        total = pa.ListArray.from_arrays(np.arange(0, len(used) * width + 1, max(1, width), dtype=np.int32)[: len(used) + 1] if width else np.zeros(len(used) + 1, np.int32), pa.array(sums[used].reshape(-1)))
        return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used]), total], ["slot", "n", "total"])

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64)
        for b in batches:
            points = _integers(b.column(0), books.dimensions, books.scale, parts)
            for part in range(parts):
                slot = nearest(points[:, part], sent.value.books[part])[0] + part * entries
                np.add.at(sums, slot, points[:, part])
                counts += np.bincount(slot, minlength=len(counts))
        yield held(counts, sums)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64)
        for b in batches:
            slot = b.column(0).to_numpy()
            np.add.at(counts, slot, b.column(1).to_numpy())
            np.add.at(sums, slot, b.column(2).flatten().to_numpy().reshape(-1, width))
        yield held(counts, sums)

    kind = "slot int, n long, total array<long>"
    each = vectors.where(F.size("vec") == books.dimensions).select("vec").mapInArrow(seen, kind)
    return each.repartition(min(parts * entries, vectors.sparkSession.sparkContext.defaultParallelism), "slot").mapInArrow(added, kind)


def train(vectors: DataFrame, entries: int = 256, parts: int = 4, rounds: int = 4, scale: int = 1024) -> Codebooks | None:
    """Codebooks of usable vectors (vec_id, label, vec) after so many rounds; None without any vector.

    A round replaces each entry that was nearest to some part by the floored mean of those parts.
    """
    if not 1 <= entries <= 256:
        raise ValueError("two hexadecimal digits name 1 to 256 entries")
    books = start(vectors, entries, parts, scale)
    for _ in range(rounds if books else 0):
        moved = books.books.copy()
        flat = moved.reshape(-1, moved.shape[2])
        for r in _sums(vectors, books).collect():  # at most a row for each entry
            flat[r.slot] = np.array(r.total, np.int64) // r.n
        books = Codebooks(moved, scale)
    return books


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, code, error) of usable vectors: entries' indexes in two hexadecimal digits each, and the squared distance."""
    sent, parts = vectors.sparkSession.sparkContext.broadcast(books), books.books.shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fits = np.array([n == books.dimensions for n in b.column(2).value_lengths().to_pylist()], bool)
            points = _integers(b.column(2).filter(pa.array(fits)), books.dimensions, books.scale, parts)
            index, error = zip(*(nearest(points[:, p], sent.value.books[p]) for p in range(parts)))
            code, total = np.full(b.num_rows, None, object), np.zeros(b.num_rows, np.int64)
            code[fits], total[fits] = [bytes(c).hex() for c in np.stack(index, 1).astype(np.uint8)], sum(error)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(code, pa.string()), pa.array(total, mask=~fits)], ["vec_id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    return vectors.select("vec_id", "label", "vec").mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def decode(coded: DataFrame, books: Codebooks) -> DataFrame:
    """coded with `approximate`, the vector that the code stands for: the middles of its entries' steps."""
    middles = ((books.books + 0.5) / books.scale).tolist()  # entries x dimensions numbers
    part = lambda p: F.element_at(F.lit(middles[p]).cast("array<array<double>>"), (F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int") + 1))
    return coded.withColumn("approximate", F.when(F.col("code").isNotNull(), F.concat(*[part(p) for p in range(len(middles))])))


def compress(vectors: DataFrame, entries: int = 256, parts: int = 4, rounds: int = 4, scale: int = 1024, broadcast_rows: int = 20_000) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of the usable rows of (vec_id, label, vec)."""
    whole = usable(vectors)
    books = train(whole, entries, parts, rounds, scale)
    if books is None:
        return whole.select("vec_id", *[F.lit(None).cast(kind).alias(name) for name, kind in (("code", "string"), ("error", "long"), ("label_error", "long"), ("codebooks_sha256", "string"))]).limit(0)
    coded = cut(encode(whole, books))  # small rows; vectors are not read again
    sums = cut(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")))
    # a row for each label: broadcast while that is few, else an ordinary join, whose hot keys adaptive execution splits
    sums = F.broadcast(sums) if sums.count() <= broadcast_rows else sums
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("of")), "left")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
