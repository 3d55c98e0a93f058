"""Cold starts: the first rows to label, at random or as medoids."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.draws import draw
from ..session import cut
from .medoids import blocks, distances, least_totals, swapped
from .select import random_sampling

MATRIX_ROWS = 4_000  # a distance matrix of 128 MB; above that bounds and blocks of this size take its place


def per_class(rows: DataFrame, n: int, seed=42) -> DataFrame:
    """n rows of each label, first in seeded order."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("label").orderBy(draw(seed, F.col("row_id")), "row_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= n).drop("rank")  # limits each group before the shuffle


def total_distances(vectors: DataFrame, pivots: DataFrame, block: int = MATRIX_ROWS, at_once: int = 16) -> DataFrame:
    """(row_id, total): each row's summed Euclidean distance to all pivots.

    vectors, pivots: (row_id, vec array<double>). Pivots are read from a written table in blocks, each sent to every task
    as a matrix; one pass over the rows sums the distances to `at_once` blocks.
    """
    kind = f"row_id {vectors.schema['row_id'].dataType.simpleString()}, total double"

    def sums(sent: list) -> DataFrame:
        def run(frames):
            for frame in frames:
                points = np.stack(frame["vec"].to_numpy()).astype(float) if len(frame) else np.zeros((0, 1))
                totals = np.zeros(len(frame))
                for others in sent:
                    for start in range(0, len(frame), 64):
                        totals[start : start + 64] += distances(points[start : start + 64], others.value[1]).sum(1)
                yield pd.DataFrame({"row_id": frame["row_id"], "total": totals})

        return vectors.select("row_id", "vec").mapInPandas(run, kind)

    parts = [cut(sums(sent)) for sent in blocks(cut(pivots.select("row_id", "vec")), ["row_id", "vec"], block, at_once)]
    if not parts:
        return vectors.select("row_id", F.lit(0.0).alias("total"))
    return reduce(DataFrame.unionAll, parts).groupBy("row_id").agg(F.sum("total").alias("total")) if len(parts) > 1 else parts[0]


def _changes(d: np.ndarray, to: np.ndarray) -> np.ndarray:
    """How the summed distance changes if a medoid (rows) gives way to a candidate (columns).

    d: distances of some points to the candidates; to: theirs to the medoids.
    """
    order = np.argsort(to, axis=1, kind="stable")
    near = to[np.arange(len(to)), order[:, 0]]
    second = to[np.arange(len(to)), order[:, 1]] if to.shape[1] > 1 else np.full(len(to), np.inf)
    gain = np.minimum(d - near[:, None], 0)  # with every medoid still there
    out = np.repeat(gain.sum(0)[None, :], to.shape[1], 0)
    lost = np.minimum(d, second[:, None]) - near[:, None] - gain  # more, for points whose own medoid goes
    for m in range(to.shape[1]):
        out[m] += lost[order[:, 0] == m].sum(0)
    return out


def medoids(points: np.ndarray, k: int) -> np.ndarray:
    """Partitioning around medoids: starts from the k points of least total distance, then swaps while that helps."""
    d = distances(points, points)
    chosen = np.argsort(d.sum(axis=1), kind="stable")[:k]
    while True:
        change = _changes(d, d[:, chosen])
        change[:, chosen] = np.inf
        m, j = np.unravel_index(np.argmin(change), change.shape)
        if change[m, j] >= -1e-9:
            return np.sort(chosen)
        chosen[m] = j


def kmedoids(vectors: DataFrame, k: int, seed=42, sample: int | None = None, samples: int = 5, matrix_rows: int = MATRIX_ROWS) -> DataFrame:
    """(row_id, rank) of k medoids; all rows if there are no more than k.

    Of up to `matrix_rows` rows one task has all distances. Beyond, the first medoids are found by bounds, and swaps start with
    a pass over all rows and candidates; further ones take rows whose medoids changed (see medoids.py). `sample` asks for less:
    of several seeded samples of so many rows the medoids of the least cost over all rows (CLARA).
    """
    kind = f"row_id {vectors.schema['row_id'].dataType.simpleString()}, rank long"

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("row_id").reset_index(drop=True)
        if len(frame) <= k:
            chosen = np.arange(len(frame))
        else:
            chosen = medoids(np.stack(frame["vec"].to_numpy()).astype(float), k)
        return pd.DataFrame({"row_id": frame["row_id"].to_numpy()[chosen], "rank": np.arange(1, len(chosen) + 1)})

    def found(rows: DataFrame) -> DataFrame:
        return rows.select(F.lit(0).alias("all"), "row_id", "vec").groupBy("all").applyInPandas(search, kind)

    n = vectors.count()
    if sample is not None and n > sample:
        tried = [cut(found(vectors.join(random_sampling(vectors, sample, seed if i == 0 else f"{seed}-{i}").select("row_id"), "row_id", "left_semi"))) for i in range(samples)]
        return min(tried, key=lambda chosen: cost(vectors, chosen))
    if n <= max(matrix_rows, k):
        return found(vectors)
    written = cut(vectors.select("row_id", "vec"))
    first = least_totals(written, k, block=matrix_rows).rows
    chosen = [(r.row_id, r.vec) for r in written.join(F.broadcast(first), "row_id").orderBy("total", "row_id").select("row_id", "vec").collect()]  # k rows
    chosen, _ = swapped(written, chosen, matrix_rows)
    return vectors.sparkSession.createDataFrame([(i, k + 1) for k, i in enumerate(sorted(i for i, _ in chosen))], kind)


def least_total(vectors: DataFrame, k: int, digits: int = 9, matrix_rows: int = MATRIX_ROWS) -> DataFrame:
    """(row_id, total): the k rows of the least summed distance to all rows. Few rows are all summed, of many those that bounds leave."""
    if vectors.count() > matrix_rows:
        return least_totals(vectors, k, digits, block=matrix_rows).rows
    return total_distances(vectors, vectors).select("row_id", F.round("total", digits).alias("total")).orderBy("total", "row_id").limit(k)


def cost(vectors: DataFrame, chosen: DataFrame) -> float:
    """The summed distance of all rows to the nearest of the chosen ones, whose vectors are sent to every task."""
    near = vectors.join(F.broadcast(chosen.select("row_id")), "row_id", "left_semi").select("vec").collect()
    sent = vectors.sparkSession.sparkContext.broadcast(np.array([r.vec for r in near], float))

    def run(frames):
        for frame in frames:
            total = 0.0
            for start in range(0, len(frame), 64):  # a block of rows at a time
                block = np.stack(frame["vec"].to_numpy()[start : start + 64])
                total += np.sqrt(((block[:, None, :] - sent.value[None, :, :]) ** 2).sum(-1)).min(axis=1).sum()
            yield pd.DataFrame({"cost": [total]})

    return vectors.select("vec").mapInPandas(run, "cost double").agg(F.sum("cost")).first()[0]


def select_initial(config: dict, pool: DataFrame, n_classes: int, seed=42, vectors: DataFrame | None = None) -> DataFrame:
    """(row_id, rank) by {"type": "RND" | "KM", "params": {"n_samples" or "n_clusters": n}}; n is else the number of classes.

    KM takes "sample": n as well, to seek medoids in samples.
    """
    code, params = config.get("type", "RND"), config.get("params") or {}
    n = params.get("n_samples", params.get("n_clusters", n_classes))
    if code == "RND":
        return random_sampling(pool, n, seed).select("row_id", "rank")
    if code == "KM":
        if vectors is None:
            raise ValueError("KM needs vectors")
        return kmedoids(vectors, n, seed, params.get("sample"))
    raise ValueError(f"unknown cold start {code!r}; known: RND, KM")
