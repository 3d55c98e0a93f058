"""Scores of a fixed set of rows, kept up to date while a vectorizer is fitted again and again.

The rows are tokenised once, into a written index (row_id, term, weight). A new model's class weights are set against those of
the one before; only (label, term) pairs whose weight changed, or that came or left, meet the index, and what they add is
added to each row's sums. Neither a text nor an unchanged weight is looked at again.

This holds where a row's own weights do not depend on the model: binary, term frequency and smoothed term frequency without
a norm. Others (inverse document frequencies, norms over the model's vocabulary) need a full pass by the model itself;
`maintainable` tells which is which.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, shared_dir
from .vectorizer import BROADCAST_BYTES, WEIGHTS, FittedVectorizer, ProductVectorizer, counted, row_terms, tf_part, with_probas


def maintainable(settings: ProductVectorizer) -> bool:
    """Whether rows' weights are the same in every model with these settings."""
    return WEIGHTS[settings.query] in ("binary", "termfrequency", "tfsmooth") and settings.query_norm is None


class MaintainedScores:
    """labels: all that any of the models may have. `changed` is the number of weights that the last update took up."""

    def __init__(self, settings: ProductVectorizer, rows: DataFrame, labels: list):
        """rows: (row_id, text); row ids are distinct."""
        if not maintainable(settings):
            raise ValueError(f"weights of rows by {settings.query!r} depend on the model")
        kind, span = WEIGHTS[settings.query], settings.ngram_range
        terms = row_terms(rows, *span).withColumn("tf", F.lit(1).cast("long")) if kind == "binary" else counted(rows, *span)
        path = f"{shared_dir(rows.sparkSession)}/terms-{uuid.uuid4().hex}"
        terms.select("row_id", "term", tf_part(kind).alias("w")).write.parquet(path)
        self.index = rows.sparkSession.read.parquet(path)
        self.labels, self.weights, self.changed = labels, None, 0
        self.sums = cut(rows.select("row_id", F.array_repeat(F.lit(0.0), len(labels)).alias("sums")))

    def update(self, model: FittedVectorizer) -> None:
        """From now on the scores are the model's."""
        new = cut(model.class_terms.select("label", "term", "weight"))
        if self.weights is None:
            delta = new.withColumnRenamed("weight", "d")
        else:
            old = self.weights.withColumnRenamed("weight", "before")
            d = F.coalesce("weight", F.lit(0.0)) - F.coalesce("before", F.lit(0.0))
            delta = new.join(old, ["label", "term"], "full").select("label", "term", d.alias("d")).where("d <> 0")
        place = F.array_position(F.array(*[F.lit(v) for v in self.labels]), F.col("label")).cast("int")
        delta = cut(delta.select(place.alias("place"), "term", "d"))
        n, size = delta.agg(F.count("*"), F.sum(F.octet_length("term") + 64)).first()
        self.changed, self.weights = n, new
        if n:
            delta = F.broadcast(delta) if size <= BROADCAST_BYTES else delta  # by its measured size
            each = self.index.join(delta, "term").groupBy("row_id", "place").agg(F.sum(F.col("w") * F.col("d")).alias("d"))
            each = each.groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct("place", "d"))).alias("m"))  # an entry for each label
            moved = F.transform("sums", lambda s, i: s + F.coalesce(F.element_at("m", i + 1), F.lit(0.0)))
            self.sums = cut(self.sums.join(each, "row_id", "left").select("row_id", F.when(F.col("m").isNull(), F.col("sums")).otherwise(moved).alias("sums")))

    def scored(self, labels: list) -> DataFrame:
        """(row_id, scores, probas) of all rows, in the order of a model's labels."""
        places = [self.labels.index(v) + 1 for v in labels]
        chosen = F.col("sums") if places == list(range(1, len(self.labels) + 1)) else F.transform(F.array(*[F.lit(p) for p in places]), lambda p: F.element_at("sums", p))
        return with_probas(self.sums.select("row_id", F.transform(chosen, lambda s: F.round(s, 9)).alias("scores")))
