"""Exact quantiles of groups of any size, without sorting or holding a group.

A group's wanted ranks start with the interval of all its values. A mergeable sketch of the values inside proposes a narrower
interval around each rank, an exact count of what lies below and inside makes it certain, and so on in the narrower one,
until an interval has few different values; their counts, summed map-side, then give the value at the rank. Each round
leaves about a two-hundredth of the rows, several ranks and groups go through the same passes, and the state is a row for
each group and rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

GRID = 1_024  # steps of a sketch's quantiles
ACCURACY = 10_000  # a sketch's ranks are right to this part of the rows
REACH = 2  # steps on either side of a rank, more than a sketch is off


def _joined(rows: DataFrame, state: DataFrame, by: list[str], broadcast_rows: int) -> DataFrame:
    """rows inside the state's intervals; state: by, rank, lo, hi."""
    few = state.count() <= broadcast_rows
    right = state.withColumnsRenamed({c: f"s_{c}" for c in by})
    on = (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"s_{c}"))
    return rows.join(F.broadcast(right) if few else right, on).drop(*[f"s_{c}" for c in by])


def order_statistics(rows: DataFrame, ranks: DataFrame, by: list[str], few: int = 50_000, broadcast_rows: int = 20_000) -> DataFrame:
    """(*by, rank, value): the value at each rank, from 0, of its group's sorted values.

    rows: (*by, v double), v neither null nor NaN; ranks: (*by, rank, lo, hi, kinds), distinct: the group's least
    and greatest value, and how many values it has. few: how many different values an interval may have in the end.
    """
    key = [*by, "rank"]
    state = cut(ranks.select(*key, "lo", "hi", F.lit(0).cast("long").alias("below"), "kinds"))
    while True:
        open_ = (F.col("kinds") > few) & (F.col("lo") < F.col("hi"))
        active = state.where(open_)
        if active.isEmpty():
            break
        grid = F.percentile_approx("v", F.array(*[F.lit(i / GRID) for i in range(GRID + 1)]), F.lit(ACCURACY))
        found = _joined(rows, active, by, broadcast_rows).groupBy(*key).agg(F.count("*").alias("inside"), F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.first("below").alias("below"), grid.alias("grid"))
        at = (F.col("rank") - F.col("below")) / F.col("inside") * GRID
        edge = lambda i, end, beyond: F.when(beyond, F.col(end)).otherwise(F.element_at("grid", i.cast("int") + 1))
        low, high = F.floor(at) - REACH, F.ceil(at) + REACH
        proposed = cut(found.select(*key, "below", edge(F.greatest(low, F.lit(0)), "lo", low <= 0).alias("lo"), edge(F.least(high, F.lit(GRID)), "hi", high >= GRID).alias("hi"), F.col("lo").alias("from")))
        lower = proposed.select(*key, "below", F.col("lo").alias("start"), F.col("from").alias("lo"), "hi")
        counted = _joined(rows, lower, by, broadcast_rows).groupBy(*key).agg(
            F.count_if(F.col("v") < F.col("start")).alias("less"), F.count_if(F.col("v") >= F.col("start")).alias("inside"), F.approx_count_distinct(F.when(F.col("v") >= F.col("start"), F.col("v"))).alias("kinds"),
            F.first("start").alias("lo"), F.first("hi").alias("hi"), F.first("below").alias("below"),
        )
        counted = cut(counted)
        inside = (F.col("rank") >= F.col("below") + F.col("less")) & (F.col("rank") < F.col("below") + F.col("less") + F.col("inside"))
        if not counted.where(~inside).isEmpty():
            raise RuntimeError("a sketch was further off than it may be")
        state = cut(state.where(~open_).unionByName(counted.select(*key, "lo", "hi", (F.col("below") + F.col("less")).alias("below"), "kinds")))
    counts = _joined(rows, state, by, broadcast_rows).groupBy(*key, "below", "v").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*key).orderBy("v"))  # over few different values
    return counts.withColumn("upto", F.col("below") + upto).where(F.col("upto") > F.col("rank")).groupBy(*key).agg(F.min("v").alias("value"))


def quantiles(rows: DataFrame, value: str, shares: list[float], by: list[str] | None = None, few: int = 50_000) -> DataFrame:
    """(*by, n, low, high, q): how many values a group has, the least, the greatest, and its quantiles by linear interpolation.

    Null and NaN values are left out; a group that has no others is there with n 0 and nulls. Rows of small groups, of up to
    `few` values, are taken as they are.
    """
    by = list(by or [])
    v = F.col(value).cast("double")
    rows = rows.select(*by, F.when(~F.isnan(v), v).alias("v"))
    sizes = cut(rows.groupBy(*by).agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")))
    rows, groups = rows.where("v is not null"), sizes.where("n > 0")
    places = F.array(*[F.lit(float(s)) for s in shares])
    wanted = groups.select(*by, F.col("low").alias("lo"), F.col("high").alias("hi"), F.col("n").alias("kinds"), F.explode(F.flatten(F.transform(places, lambda s: F.array(F.floor(s * (F.col("n") - 1)), F.ceil(s * (F.col("n") - 1)))))).alias("rank")).distinct()
    at = order_statistics(rows, wanted, by, few)
    held = at.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"))  # two ranks a share

    def between(s: Column) -> Column:
        place = s * (F.col("n") - 1)
        below, above = F.element_at("at", F.floor(place)), F.element_at("at", F.ceil(place))
        return below + (place - F.floor(place)) * (above - below)

    right = held.withColumnsRenamed({c: f"s_{c}" for c in by})
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"s_{c}"))
    out = sizes.join(right if by else F.broadcast(right), on, "left")
    return out.select(*by, "n", "low", "high", F.when(F.col("n") > 0, F.transform(places, between)).alias("q"))
