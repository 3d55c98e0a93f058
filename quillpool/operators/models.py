"""Classifiers by code: PVBin on texts; GNB, LSVC, LR and SGD on feature vectors (array<double> column `vec`)."""

from __future__ import annotations

import inspect
from abc import ABC, abstractmethod
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linear
from .cache import RowCache, fingerprint
from .vectorizer import ProductVectorizer, predicted, with_probas

class NoProbabilities(ValueError):
    """Raised by models that only decide; queries then fall back to random rows."""


class Classifier(ABC):
    """What get_model returns. Subclasses that register_model knows can be named in any configuration.

    `needs` is the column that rows have beside row_id and label: text, or vec (array<double>).
    """

    needs = "text"
    labels: list

    @abstractmethod
    def fit(self, df: DataFrame) -> Classifier:
        """Learns from (row_id, `needs`, label) and sets `labels`, sorted."""

    @abstractmethod
    def predict(self, df: DataFrame) -> DataFrame:
        """(row_id, predicted) of (row_id, `needs`)."""

    def scored(self, df: DataFrame) -> DataFrame:
        """(row_id, scores, probas), arrays in the order of the labels."""
        raise NoProbabilities(f"{type(self).__name__} gives no probabilities")


class FeatureClassifier(Classifier):
    needs = "vec"


class Embedder(ABC):
    """What get_embedder returns: rows as vectors."""

    @abstractmethod
    def fit(self, df: DataFrame) -> Embedder:
        """Learns from (row_id, text, label)."""

    @abstractmethod
    def transform(self, df: DataFrame) -> DataFrame:
        """(row_id, vec) of (row_id, text)."""

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    @property
    @abstractmethod
    def dimension(self) -> int: ...


class TextClassifier(Classifier):
    """fit(df: row_id, text, label); predict and scored of (row_id, text)."""

    def __init__(self, **params):
        params.setdefault("method", "binary")
        params.setdefault("query", "binary")
        if isinstance(params.get("ngram_range"), list):
            params["ngram_range"] = tuple(params["ngram_range"])
        self.vectorizer = ProductVectorizer(**params)

    def fit(self, df: DataFrame) -> TextClassifier:
        self.model = self.vectorizer.fit(df)
        self.labels = self.model.labels
        return self

    def scored(self, df: DataFrame) -> DataFrame:
        return self.model.scored(df)

    def predict(self, df: DataFrame) -> DataFrame:
        return self.model.predict(df)


def gaussian_params(df: DataFrame, smoothing: float = 1e-9) -> DataFrame:
    """(label, n, dim, mean, var): population variances, each with that share of the greatest variance over all rows added."""
    flat = df.select("label", F.posexplode("vec").alias("dim", "x"))
    floor = flat.groupBy("dim").agg(F.var_pop("x").alias("v")).agg((F.max("v") * smoothing).alias("floor"))
    each = flat.groupBy("label", "dim").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("var"))
    return each.crossJoin(F.broadcast(floor)).select("label", "n", "dim", "mean", (F.col("var") + F.col("floor")).alias("var"))


class GaussianNB(FeatureClassifier):
    """The log posteriors as expressions over a model of classes x dimensions, sent with the plan; if it is large, as arrays."""

    most_inline = 5_000  # numbers that a plan is made to hold

    def __init__(self, var_smoothing: float = 1e-9, priors: list[float] | None = None):
        """priors: the classes' probabilities, by label; else their shares of the rows."""
        self.smoothing, self.priors = var_smoothing, priors

    def fit(self, df: DataFrame) -> GaussianNB:
        rows = gaussian_params(df, self.smoothing).groupBy("label").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("dim", "mean", "var"))).alias("d")).orderBy("label").collect()  # a row for each class
        self.labels = [r.label for r in rows]
        total = sum(r.n for r in rows)
        if self.priors is not None and (len(self.priors) != len(rows) or abs(sum(self.priors) - 1) > 1e-8 or min(self.priors) < 0):
            raise ValueError("priors are a probability for each class and add up to 1")
        shares = self.priors or [r.n / total for r in rows]
        self.model = [(p, [x.mean for x in r.d], [x["var"] for x in r.d]) for p, r in zip(shares, rows)]
        return self

    def scored(self, df: DataFrame) -> DataFrame:
        import math

        def score(prior: float, means: list[float], variances: list[float]):
            fixed = (math.log(prior) if prior else -math.inf) - 0.5 * sum(math.log(2 * math.pi * v) for v in variances)
            terms = F.zip_with(F.zip_with("vec", F.lit(means), lambda x, m: (x - m) * (x - m)), F.lit(variances), lambda q, v: q / v)
            return F.lit(fixed) - 0.5 * F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)

        if sum(len(means) for _, means, _ in self.model) > self.most_inline:
            return with_probas(self._by_arrays(df))
        rows = df.select("row_id", F.array(*[F.round(score(*m), 9) for m in self.model]).alias("scores"))
        return with_probas(rows)

    def _by_arrays(self, df: DataFrame) -> DataFrame:
        prior, means, variances = (np.array([m[i] for m in self.model], float) for i in range(3))
        with np.errstate(divide="ignore"):
            prior = np.log(prior)
        sent = df.sparkSession.sparkContext.broadcast((prior - 0.5 * np.log(2 * np.pi * variances).sum(1), means, variances))

        def run(frames):
            fixed, means, variances = sent.value
            for frame in frames:
                out = []
                for at in range(0, len(frame), 64):  # 64 rows x classes x dimensions at a time
                    x = np.stack(frame["vec"].to_numpy()[at : at + 64]).astype(float)
                    out += list(np.round(fixed - 0.5 * ((x[:, None, :] - means) ** 2 / variances).sum(2), 9))
                yield pd.DataFrame({"row_id": frame["row_id"], "scores": out})

        return df.select("row_id", "vec").mapInPandas(run, f"row_id {df.schema['row_id'].dataType.simpleString()}, scores array<double>")

    def predict(self, df: DataFrame) -> DataFrame:
        return predicted(self.scored(df), self.labels)


class Linear(FeatureClassifier):
    """One coefficient row a class. `iterations` and `converged` tell how training ended; a warning, if short of its tolerance."""

    labels: list
    coef: np.ndarray
    intercept: np.ndarray
    iterations = 0
    converged = True

    def decisions(self, df: DataFrame) -> DataFrame:
        """(row_id, scores): each class's distance from its plane, rounded to 9 places."""
        sent = df.sparkSession.sparkContext.broadcast((self.coef, self.intercept))

        def run(frames):
            coef, intercept = sent.value
            for frame in frames:
                x = np.stack(frame["vec"].to_numpy()).astype(float) if len(frame) else np.zeros((0, coef.shape[1]))
                yield pd.DataFrame({"row_id": frame["row_id"], "scores": list(np.round(x @ coef.T + intercept, 9))})

        return df.select("row_id", "vec").mapInPandas(run, f"row_id {df.schema['row_id'].dataType.simpleString()}, scores array<double>")

    def predict(self, df: DataFrame) -> DataFrame:
        return predicted(self.decisions(df), self.labels)

    def _packed(self, df: DataFrame, shard_rows: int, seed) -> tuple[DataFrame, np.ndarray, int]:
        """Blocks of training rows, the rows of each label, and the number of dimensions."""
        counted = df.groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("d")).where("label is not null").orderBy("label").collect()
        if not counted:
            raise ValueError("there are no labelled rows")
        self.labels, n = [r.label for r in counted], np.array([r.n for r in counted])
        self.shards = max(1, -(-int(n.sum()) // shard_rows))
        return linear.packed(df, self.labels, self.shards, seed), n, max(r.d for r in counted)

    def _done(self, name: str) -> Linear:
        if not self.converged:
            linear.not_met(name, self.iterations)
        return self


class LinearSVM(Linear):
    """Squared hinge loss and a squared penalty, of which the intercept is a part; gives no probabilities."""

    def __init__(self, C: float = 1.0, tol: float = 1e-4, max_iter: int = 1000, fit_intercept: bool = True, intercept_scaling: float = 1.0, class_weight=None, penalty: str = "l2", loss: str = "squared_hinge", multi_class: str = "ovr"):
        if penalty != "l2" or loss != "squared_hinge" or multi_class != "ovr":
            raise ValueError("LSVC has penalty 'l2', loss 'squared_hinge' and multi_class 'ovr'")
        if C <= 0 or fit_intercept and intercept_scaling <= 0:
            raise ValueError("C and intercept_scaling are above 0")
        self.C, self.tol, self.max_iter, self.class_weight = float(C), float(tol), int(max_iter), class_weight
        self.scale = float(intercept_scaling) if fit_intercept else 0.0

    def fit(self, df: DataFrame) -> LinearSVM:
        blocks, n, d = self._packed(df, 100_000, 0)
        weight = linear.class_weights(n, self.labels, self.class_weight)
        w, self.iterations, self.converged = linear.squared_hinge(blocks, len(n), d, weight, self.C, self.scale, self.tol, self.max_iter)
        self.coef, self.intercept = w[:, :d], w[:, d] * self.scale if self.scale else np.zeros(len(n))
        return self._done("LSVC")


class Descent(Linear):
    """Stochastic descent on shards of `shard_rows` rows, by batches, with the shards' mean after each epoch.

    Log loss and modified Huber loss give probabilities, each class's own, made to add up to 1.
    """

    def __init__(
        self, loss: str = "hinge", penalty: str | None = "l2", alpha: float = 1e-4, l1_ratio: float = 0.15, fit_intercept: bool = True, max_iter: int = 1000, tol: float | None = 1e-3,
        n_iter_no_change: int = 5, learning_rate: str = "optimal", eta0: float = 0.01, power_t: float = 0.5, average: bool = False, class_weight=None, random_state=0, batch_rows: int = 32, shard_rows: int = 20_000,
    ):
        share = {"l2": 0.0, "l1": 1.0, "elasticnet": l1_ratio, None: 0.0}
        if penalty not in share:
            raise ValueError(f"unknown penalty {penalty!r}; known: elasticnet, l1, l2, None")
        if linear.BLOCK % int(batch_rows):
            raise ValueError(f"batch_rows divides {linear.BLOCK}")
        self.loss = "log_loss" if loss == "log" else loss
        self.rate = linear.Schedule(learning_rate, float(alpha), float(eta0), float(power_t), self.loss)
        self.alpha, self.l1_share = (float(alpha) if penalty else 0.0), share[penalty]
        self.fit_intercept, self.max_iter, self.tol, self.patience = fit_intercept, int(max_iter), tol, int(n_iter_no_change)
        self.average, self.class_weight, self.seed, self.batch, self.shard_rows = bool(average), class_weight, random_state, int(batch_rows), int(shard_rows)

    def fit(self, df: DataFrame) -> Descent:
        blocks, n, d = self._packed(df, self.shard_rows, self.seed)
        weight = linear.class_weights(n, self.labels, self.class_weight)
        per_epoch = -(-int(n.sum()) // (self.shards * self.batch))
        w, self.iterations, self.converged = linear.descend(blocks, len(n), d, weight, self.loss, self.alpha, self.l1_share, self.rate, self.batch, per_epoch, self.fit_intercept, self.average, self.tol, self.patience, self.max_iter)
        self.coef, self.intercept = w[:, :d], w[:, d]
        return self._done("SGD")

    def scored(self, df: DataFrame) -> DataFrame:
        if self.loss not in ("log_loss", "modified_huber"):
            raise NoProbabilities(f"SGD with loss {self.loss!r} gives no probabilities")
        own = (lambda s: 1 / (1 + F.exp(-s))) if self.loss == "log_loss" else (lambda s: (F.greatest(F.least(s, F.lit(1.0)), F.lit(-1.0)) + 1) / 2)
        rows = self.decisions(df).withColumn("own", F.transform("scores", own)).withColumn("total", F.aggregate("own", F.lit(0.0), lambda a, x: a + x))
        return rows.select("row_id", "scores", F.transform("own", lambda p: F.when(F.col("total") > 0, p / F.col("total")).otherwise(1.0 / len(self.labels))).alias("probas"))


class Logistic(Linear):
    """Multinomial logistic regression; the intercept is not penalised."""

    def __init__(self, penalty: str | None = "l2", C: float = 1.0, l1_ratio: float | None = None, fit_intercept: bool = True, class_weight=None, max_iter: int = 100, tol: float = 1e-6, multi_class: str = "auto"):
        """The penalty is C's inverse for the summed loss. tol: of the mean objective, between iterations."""
        if penalty not in ("l1", "l2", "elasticnet", None) or multi_class not in ("auto", "multinomial"):
            raise ValueError("LR has penalty 'l1', 'l2', 'elasticnet' or None, and one multinomial model")
        self.share = {"l1": 1.0, "l2": 0.0, None: 0.0, "elasticnet": l1_ratio}[penalty]
        if self.share is None:
            raise ValueError("penalty 'elasticnet' needs l1_ratio")
        self.strength = 1 / float(C) if penalty else 0.0
        self.fit_intercept, self.class_weight, self.max_iter, self.tol = fit_intercept, class_weight, int(max_iter), float(tol)

    def fit(self, df: DataFrame) -> Logistic:
        from pyspark.ml.classification import LogisticRegression

        counted = df.where("label is not null").groupBy("label").count().orderBy("label").collect()
        if not counted:
            raise ValueError("there are no labelled rows")
        self.labels, n = [r.label for r in counted], np.array([r["count"] for r in counted], float)
        weight = linear.class_weights(n, self.labels, self.class_weight)
        place = F.array_position(F.array(*[F.lit(v) for v in self.labels]), F.col("label")) - 1
        rows = df.where("label is not null").select(array_to_vector(F.col("vec").cast("array<double>")).alias("features"), place.cast("double").alias("y"))
        rows = rows.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weight]), F.col("y").cast("int") + 1)).persist()
        found = LogisticRegression(
            featuresCol="features", labelCol="y", weightCol="weight", family="multinomial", standardization=False, regParam=self.strength / float(n @ weight),
            elasticNetParam=self.share, fitIntercept=self.fit_intercept, maxIter=self.max_iter, tol=self.tol,
        ).fit(rows)
        rows.unpersist()
        self.iterations, self.converged = found.summary.totalIterations, found.summary.totalIterations < self.max_iter
        self.coef, self.intercept = found.coefficientMatrix.toArray(), found.interceptVector.toArray()
        if len(self.coef) < len(self.labels):  # of one label alone
            self.coef, self.intercept = np.zeros((len(self.labels), self.coef.shape[1])), np.zeros(len(self.labels))
        return self._done("LR")

    def scored(self, df: DataFrame) -> DataFrame:
        return with_probas(self.decisions(df))


MODELS: dict[str, Callable[..., Classifier]] = {"PVBin": TextClassifier, "GNB": GaussianNB, "LSVC": LinearSVM, "LR": Logistic, "SGD": Descent}

#: Settings that choose a solver, or what it prints, and not what it finds; they may stand in a configuration.
WITHOUT_EFFECT = {"GNB": (), "LSVC": ("dual", "verbose", "random_state"), "LR": ("solver", "dual", "verbose", "random_state", "n_jobs", "warm_start", "intercept_scaling"), "SGD": ("shuffle", "verbose", "n_jobs", "warm_start")}


def register_model(code: str, make: Callable[..., Classifier]) -> None:
    """From now on {"type": code, "params": {...}} is make(**params)."""
    MODELS[code] = make


def get_model(config: dict) -> Classifier:
    code = config.get("type")
    if code not in MODELS:
        raise ValueError(f"unknown classifier {code!r}; known: {', '.join(MODELS)}")
    params = {k: v for k, v in (config.get("params") or {}).items() if k not in WITHOUT_EFFECT.get(code, ())}
    return made(code, MODELS[code], params)


def made(code: str, make: Callable, params: dict):
    """make(**params); a ValueError that names the settings it does not know."""
    known = inspect.signature(make).parameters.values()
    if not any(p.kind is p.VAR_KEYWORD for p in known):
        if unknown := sorted(set(params) - {p.name for p in known}):
            raise ValueError(f"unknown settings of {code}: {', '.join(unknown)}; known: {', '.join(p.name for p in known)}")
    return make(**params)


def needs_vectors(config: dict) -> bool:
    return bool(config.get("type")) and get_model(config).needs == "vec"


def aligned(long: DataFrame, labels: DataFrame) -> DataFrame:
    """(row_id, label, proba) with every listed label, 0 where the model has none; long: (row_id, label, proba)."""
    rows = long.groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct("label", "proba"))).alias("m"))  # an entry for each class
    wanted = labels.agg(F.array_sort(F.collect_set("label")).alias("names"))
    return rows.crossJoin(F.broadcast(wanted)).select("row_id", "m", F.explode("names").alias("label")).select("row_id", "label", F.coalesce(F.element_at("m", F.col("label")), F.lit(0.0)).alias("proba"))


class ProbabilityEmbedder(Embedder):
    """Rows as their class probabilities. It is fitted with the labels of the rows it is given."""

    def __init__(self, cache: str | None = None, **params):
        """cache: a folder for embeddings, kept by what they were fitted on and by text; only texts that it lacks are embedded."""
        self.vectorizer, self.cache = ProductVectorizer(**params), cache

    def fit(self, df: DataFrame) -> ProbabilityEmbedder:
        if "label" not in df.columns:
            raise ValueError("fitting needs labels")
        self.model = self.vectorizer.fit(df)
        self.fitted_on = fingerprint(df.select("row_id", "text", "label"), self.vectorizer) if self.cache else None
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        make = lambda rows: self.model.scored(rows).select("row_id", F.col("probas").alias("vec"))
        return RowCache(df.sparkSession, self.cache).vectors(df, self.fitted_on, make) if self.cache else make(df)

    @property
    def dimension(self) -> int:
        return len(self.model.labels)


def _probability_embedder(vectorizer_params: dict | None = None, cache_dir: str | None = None) -> ProbabilityEmbedder:
    params = dict(vectorizer_params or {})
    if isinstance(params.get("ngram_range"), list):
        params["ngram_range"] = tuple(params["ngram_range"])
    return ProbabilityEmbedder(cache=cache_dir, **params)


EMBEDDERS: dict[str, Callable[..., Embedder]] = {"PVProb": _probability_embedder}


def register_embedder(code: str, make: Callable[..., Embedder]) -> None:
    """From now on {"type": code, "params": {...}} is make(**params)."""
    EMBEDDERS[code] = make


def get_embedder(config: dict) -> Embedder:
    code = config.get("type")
    if code not in EMBEDDERS:
        raise ValueError(f"unknown embedder {code!r}; known: {', '.join(EMBEDDERS)}")
    return made(code, EMBEDDERS[code], config.get("params") or {})
