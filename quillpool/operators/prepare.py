"""From a raw labeled table to population, pool and label dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import draw
from ..functions.text import normal_label
from ..session import few


def drop_null(df: DataFrame, *columns: str) -> DataFrame:
    return df.na.drop("any", subset=list(columns))


def rare_grouped(df: DataFrame, label: str, least: int | None, name: str = "_RARE_GROUP_") -> DataFrame:
    """Labels with fewer rows than `least` become one; the counts are summed map-side and joined back."""
    if least is None or least <= 1:
        return df
    counts = df.groupBy(label).count().where(F.col("count") < least).select(F.col(label).alias("__rare"))
    joined = df.join(few(counts), F.col(label) == F.col("__rare"), "left")
    return joined.withColumn(label, F.when(F.col("__rare").isNotNull(), F.lit(name)).otherwise(F.col(label))).drop("__rare")


def label_ids(df: DataFrame, label: str, row_id: str, first_seen: bool = True) -> DataFrame:
    """(label, label_id): numbered by first appearance, or sorted."""
    each = df.groupBy(F.col(label).alias("label")).agg(F.min(row_id).alias("first"))
    order = ["first", "label"] if first_seen else ["label"]
    return each.select("label", (F.row_number().over(Window.orderBy(*order)) - 1).alias("label_id"))  # a row for each class


def encoded(df: DataFrame, ids: DataFrame, label: str, unknown: int | None = None) -> DataFrame:
    """df with label_id. Rows of an unknown label get `unknown`, or stop the job where that is None."""
    out = df.join(few(ids.select(F.col("label").alias("__l"), F.col("label_id"))), F.col(label) == F.col("__l"), "left").drop("__l")
    missing = F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(F.col(label).cast("string"), F.lit("null")))).cast("int") if unknown is None else F.lit(unknown)
    return out.withColumn("label_id", F.coalesce("label_id", missing))


def decoded(df: DataFrame, ids: DataFrame) -> DataFrame:
    """df with the label of its label_id; null where it has none."""
    return df.join(few(ids), "label_id", "left")


def quotas(counts: DataFrame, share: float) -> DataFrame:
    """(label, quota) from (label, n): ceil(share * total) rows, by largest remainder; ties by label."""
    every = Window.partitionBy()
    exact = F.lit(share) * F.col("n")
    q = counts.withColumn("base", F.floor(exact + F.lit(1e-9))).withColumn("rest", F.round(exact - F.floor(exact + F.lit(1e-9)), 9))
    q = q.withColumn("extra", F.ceil(F.lit(share) * F.sum("n").over(every) - F.lit(1e-9)) - F.sum("base").over(every))
    rank = F.row_number().over(Window.orderBy(F.col("rest").desc(), "label"))  # a row for each class
    return q.select("label", (F.col("base") + F.when(rank <= F.col("extra"), 1).otherwise(0)).cast("long").alias("quota"))


def ranked(df: DataFrame, by: list[str], row_id: str, seed) -> DataFrame:
    """df with `rank`, its place in the seeded order of its group.

    Ranks come from counts of hash prefixes, so that no group is sorted as a whole: a window is over one (group, prefix).
    """
    keyed = df.withColumn("__draw", draw(seed, F.col(row_id))).withColumn("__prefix", F.substring("__draw", 1, 3))
    sizes = keyed.groupBy(*by, "__prefix").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy("__prefix").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(by)], F.col("__prefix").alias("__p"), before.alias("__before"))
    inner = F.row_number().over(Window.partitionBy(*by, "__prefix").orderBy("__draw", row_id))
    on = F.col("__prefix") == F.col("__p")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"__g{i}"))
    out = keyed.withColumn("__inner", inner).join(sizes, on)
    return out.withColumn("rank", F.col("__inner") + F.col("__before")).select(*df.columns, "rank")


def stratified(df: DataFrame, label: str, row_id: str, share: float, seed) -> DataFrame:
    """df with boolean `held`: ceil(share * n) rows, spread over the classes; never fails, however small a class is."""
    wanted = quotas(df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n")), share)
    wanted = few(wanted.select(F.col("label").alias("__l"), "quota"))
    out = ranked(df, [label], row_id, seed).join(wanted, F.col(label).eqNullSafe(F.col("__l")))
    return out.withColumn("held", F.col("rank") <= F.col("quota")).drop("__l", "quota", "rank")


def unstratified(df: DataFrame, row_id: str, share: float, seed) -> DataFrame:
    n = df.count()
    held = -(-n * round(share * 1_000_000) // 1_000_000)
    return ranked(df.withColumn("__all", F.lit(0)), ["__all"], row_id, seed).withColumn("held", F.col("rank") <= held).drop("__all", "rank")


def can_stratify(counts: DataFrame) -> DataFrame:
    """One row: the least class size, the number of classes, and whether every class has two rows."""
    return counts.agg(F.min("n").alias("min_count"), F.count("*").alias("n_classes"), (F.coalesce(F.min("n"), F.lit(0)) >= 2).alias("stratify"))


def prepare(df: DataFrame, text: str, label: str, row_id: str, least: int | None = 2, rare: str = "_RARE_GROUP_", population: float = 0.5, seed=42) -> DataFrame:
    """row_id, text, label, label_id and part: P for the held-out population, U for the pool."""
    clean = drop_null(df, text, label).select(F.col(row_id).alias("row_id"), F.col(text).alias("text"), normal_label(F.col(label)).alias("label"))
    grouped = rare_grouped(clean, "label", least, rare)
    ids = label_ids(grouped, "label", "row_id")
    parts = stratified(encoded(grouped, ids, "label"), "label", "row_id", 1 - population, seed)  # U is the test side
    return parts.select("row_id", "text", "label", "label_id", F.when(F.col("held"), "U").otherwise("P").alias("part"))
