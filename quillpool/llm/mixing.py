"""Mixing sources to target weights by hash-threshold histograms.

A document's place in its source's order is a 60-bit hash of its id. A source's budget of words becomes a threshold on
that hash: words are summed by source and the hash's leading bits, a running sum finds the bucket in which the budget
ends, and only that bucket is summed again by the next bits, until it holds one hash. Documents below the threshold are
taken by a filter; nothing is sorted but histograms. Budgets are nested: a larger budget takes all that a smaller one does.

Sources are weighed in turn by `weights`, by code point with null last, and share `share` of all words; a source gives
each document at most `repeats` times, and what it cannot give is shared again by weight.

Defined results: a null or blank text has size 0 and is taken 0 times; null is a source of its own; rows with the same
doc_id share a hash and are taken together; a null doc_id hashes as the empty string; further columns are ignored by
`mix` and passed through by `mixed`; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .names import free_names, own
from .rules import BLANKS, words_of

BITS = 60


def place(doc_id: Column) -> Column:
    """The leading 60 bits of the id's MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def targets(sized: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, repeats: int = 2) -> DataFrame:
    """(source, source_size, target). Resharing ends where the sources below their limit have one ratio of target to weight."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())  # over sources, not documents
    turn = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    s = sums.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(repeats))
    full = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = full.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    s = (
        s.withColumn("budget", share * F.sum("source_size").over(every))
        .withColumn("given", F.coalesce(F.sum("most").over(upto), F.lit(0.0)))
        .withColumn("rest", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
    )
    # if every source before this one, by limit over weight, is at its limit, the rest have this ratio
    s = s.withColumn("ratio", (F.col("budget") - F.col("given")) / F.col("rest"))
    open_ = F.col("ratio") <= F.col("most") / F.col("weight")
    s = s.withColumn("level", F.min(F.when(open_, F.struct(F.col("most") / F.col("weight"), "ratio"))).over(every)["ratio"])
    return s.select("source", "source_size", F.coalesce(F.least(F.col("most"), F.col("level") * F.col("weight")), F.col("most")).alias("target"))


def thresholds(sized: DataFrame, budgets: DataFrame, level_bits: int = 12, broadcast_rows: int = 20_000) -> DataFrame:
    """(source, below): the documents whose hash is less than `below` come nearest to the source's budget.

    budgets: (source, budget). Each level sums only the documents in its sources' boundary buckets.
    """
    few = budgets.count() <= broadcast_rows  # a row for each source
    small = F.broadcast if few else (lambda d: d)
    edge = budgets.select(F.col("source").alias("e_source"), F.col("budget").cast("double").alias("left"), F.lit(0).cast("long").alias("bucket"))
    inside = sized.select("source", "size", "place")
    shift = BITS
    done = None
    while True:
        width = min(level_bits, shift)
        at = F.shiftright("place", shift) == F.col("bucket")
        rows = inside.join(small(edge), F.col("source").eqNullSafe(F.col("e_source")) & at, "inner")
        sums = rows.groupBy("source", "left", F.shiftright("place", shift - width).alias("b")).agg(F.sum("size").alias("words"), F.min("place").alias("lo"), F.max("place").alias("hi"))
        run = F.sum("words").over(Window.partitionBy("source").orderBy("b"))
        sums = sums.withColumn("upto", run)
        over = sums.where(F.col("upto") > F.col("left"))
        first = cut(over.groupBy("source").agg(F.min(F.struct("b", "upto", "words", "lo", "hi", "left")).alias("x")).select("source", "x.*"))
        # a bucket of one hash is the boundary itself: taken if that is nearer to the budget than leaving it
        single = first.where("lo = hi").select("source", F.when(F.col("upto") - F.col("left") < F.col("left") - (F.col("upto") - F.col("words")), F.col("hi") + 1).otherwise(F.col("lo")).alias("below"))
        done = single if done is None else done.unionByName(single)
        shift -= width
        more = first.where("lo < hi")
        if shift == 0 or more.isEmpty():
            break
        edge = more.select(F.col("source").alias("e_source"), (F.col("left") - F.col("upto") + F.col("words")).alias("left"), F.col("b").alias("bucket"))
    return done


def _sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.size(words_of(F.coalesce("text", F.lit("")))).cast("long").alias("size"), place(F.col("doc_id")).alias("place"))


def sources(sized: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, repeats: int = 2, broadcast_rows: int = 20_000) -> DataFrame:
    """(source, source_size, target, whole, below): a source's documents are taken `whole` times, and once more below the hash `below`."""
    goal = cut(targets(sized, weights, share, repeats))
    # whole rounds of a source, then a last one in part
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    goal = goal.withColumn("whole", F.least(whole, F.lit(repeats)))
    part = goal.select("source", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)).alias("budget"))
    part = part.where("budget > 0")
    below = thresholds(sized, part, broadcast_rows=broadcast_rows).select(F.col("source").alias("t_source"), "below")
    return cut(goal.join(below, F.col("source").eqNullSafe(F.col("t_source")), "left").select("source", "source_size", "target", "whole", "below"))


def _few(plan: DataFrame, broadcast_rows: int) -> DataFrame:
    return F.broadcast(plan) if plan.count() <= broadcast_rows else plan  # a row for each source


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, repeats: int = 2, broadcast_rows: int = 20_000) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken): how often the mix takes each row, and so many words."""
    sized = cut(_sized(docs))
    plan = sources(sized, weights, share, repeats, broadcast_rows).withColumnRenamed("source", "g_source")
    out = sized.join(_few(plan, broadcast_rows), F.col("source").eqNullSafe(F.col("g_source")), "inner")
    copies = F.when(F.col("size") > 0, F.col("whole") + F.when(F.col("place") < F.col("below"), 1).otherwise(0)).otherwise(F.lit(0)).cast("int")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, repeats: int = 2, broadcast_rows: int = 20_000) -> DataFrame:
    """The rows of docs as often as the mix takes them: a filter on the row's own hash, so texts stay in the scan."""
    source, whole, below, copy = free_names(docs, 4)
    plan = sources(cut(_sized(docs)), weights, share, repeats, broadcast_rows)
    plan = plan.select(F.col("source").alias(source), F.col("whole").alias(whole), F.col("below").alias(below))
    rows = docs.join(_few(plan, broadcast_rows), F.col("source").eqNullSafe(F.col(source)), "inner")
    blank = F.length(F.btrim(F.coalesce("text", F.lit("")), F.lit(BLANKS))) == 0
    copies = F.when(blank, 0).otherwise(F.col(whole) + F.when(place(F.col("doc_id")) < F.col(below), 1).otherwise(0)).cast("int")
    return rows.withColumn(copy, F.explode(F.array_repeat(F.lit(1), copies))).select(*own(docs))
