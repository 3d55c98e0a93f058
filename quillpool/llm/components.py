"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014).

Edges stay in DataFrames; each round halves depths, and is cut by a reliable checkpoint. A node's neighbours are never
gathered: a round takes their minimum (summed map-side) and joins it back, so a star of any size is dealt with by splits.
A graph of at most `alone` edges, counted first, is joined by one task in one pass instead; its labels are the same.

Defined results: edges with a null end, and from a node to itself, link nothing; repeated edges count once; an empty
table gives an empty table; if `rounds`, which halve depths, do not suffice, an error is raised.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not held:
        return
    u, v = (np.concatenate(x) for x in zip(*held))
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, label = at[: len(u)], at[len(u) :], np.arange(len(ids))
    while not np.array_equal(la := label[a], lb := label[b]):
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(nxt := label[label], label):
            label = nxt
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[label])], ["node", "label"])


def components(edges: DataFrame, rounds: int = 100, alone: int = 100_000) -> DataFrame:
    """(node, label): the least node of its component, for each node of the edges (src, dst); both long."""
    e = cut(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    if e.count() <= alone:
        return e.repartition(1).mapInArrow(_joined, "node long, label long")
    for _ in range(rounds):
        # done when all edges are stars: a node has one edge down, or edges from above
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up")))
        if ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 or (down = 1 and up = 1)").isEmpty():
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        e = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
    else:
        raise RuntimeError(f"components are not complete after {rounds} rounds")
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return stars.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
