"""The active-learning loop. The driver holds settings and the history; rows stay in tables keyed by row_id.

Each round fits on L, evaluates on the held-out part of L and on P, asks the oracle for a batch of U, and moves it. A
round's state is cut by a reliable checkpoint, so that plans do not grow. Where a model's scores can be maintained
(operators/maintained.py), P and U are tokenised once a run, and a round takes up the class weights that changed.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import coldstart, evaluate, pool
from ..operators.maintained import MaintainedScores, maintainable
from ..operators.models import NoProbabilities, TextClassifier, get_embedder, get_model, needs_vectors
from ..operators.prepare import prepare, stratified, unstratified
from ..operators.select import NEED_PROBAS, random_sampling, select_batch
from ..operators.vectorizer import predicted
from ..session import cut
from ..sources.tables import append_csv
from .oracle import SimulatedOracle, get_oracle

SECTIONS = ("data_params", "al_params")


def baseline_metrics(rows: DataFrame, classifier: dict, labels: DataFrame, test_size: float = 0.05, seed=42) -> dict:
    """Accuracy, macro F1 and training time of a model of nearly all rows; what fails is None."""
    out = {"baseline_acc": None, "baseline_f1": None, "baseline_train_time_sec": None}
    try:
        parts = cut(split(rows, test_size, seed))
        began = time.time()
        model = get_model(classifier).fit(parts.where("not held"))
        out["baseline_train_time_sec"] = time.time() - began
        test = parts.where("held")
        out["baseline_acc"], out["baseline_f1"] = evaluate.metrics(evaluate.paired(test, model.predict(test)), labels)
    except Exception as error:  # a baseline is optional
        out["error"] = str(error)[:500]
    return out


def split(rows: DataFrame, share: float, seed) -> DataFrame:
    """rows with `held`: by class if every class has two rows, else of all."""
    least = rows.groupBy("label").count().agg(F.min("count")).first()[0] or 0
    return stratified(rows, "label", "row_id", share, seed) if least >= 2 else unstratified(rows, "row_id", share, seed)


@dataclass
class ActiveLearner:
    config: dict
    history: list[dict] = field(default_factory=list)
    status: str = "INITIALIZED"

    def __post_init__(self):
        missing = [s for s in SECTIONS if s not in self.config]
        if missing:
            raise ValueError(f"the configuration lacks {missing}")
        al = self.config["al_params"]
        general = self.config.get("general_params") or {}
        self.seed = general.get("random_seed", int(time.time()))
        self.selection_log = general.get("selection_log_file") if general.get("verbose") else None  # a CSV folder
        self.classifier = al.get("classifier_config") or {"type": "PVBin", "params": {}}
        self.strategy = al.get("query_strategy_config") or {"type": "RND", "params": {"batch_size": 10}}
        self.cold_start = al.get("cold_start_config") or {"type": "RND", "params": {}}
        self.internal_size = al.get("internal_test_size", 0.0)
        self.max_iterations = al.get("max_iterations", 1000)
        self.budget = al.get("target_budget_pct", 1.0)
        self.metric, self.patience, self.tolerance = al.get("early_stopping_metric"), al.get("early_stopping_patience"), al.get("early_stopping_tolerance", 0.001)
        self.best, self.waited, self.error, self.model, self.baseline = None, 0, None, None, {}
        self.kept: MaintainedScores | None = None
        if self.strategy.get("type") != "RND" and self.strategy.get("type") not in NEED_PROBAS:
            raise ValueError(f"unknown query strategy {self.strategy.get('type')!r}; known: RND, {', '.join(NEED_PROBAS)}")

    # --- setup

    def setup(self, data: DataFrame) -> ActiveLearner:
        """data: the raw table, or one with row_id, text and label if data_params names no columns."""
        self.status = "SETTING_UP"
        try:
            d = self.config["data_params"]
            rows = prepare(data, d.get("text_column", "text"), d.get("label_column", "label"), d.get("row_id_column", "row_id"), d.get("min_samples_per_class", 1), d.get("rare_group_label", "_RARE_GROUP_"), d.get("population_size", 0.5), self.seed)
            rows = cut(rows)
            if rows.isEmpty():
                raise ValueError("no row has both a text and a label")
            self.labels = cut(rows.select("label").distinct())
            embedding = self.config.get("embedder_global_config") or {"type": "PVProb", "params": {}}
            late = embedding.get("fit_on", "all") == "L"  # by default it sees all labels, also those of P
            if self._needs_vectors() and not late:
                rows = cut(rows.join(get_embedder(embedding).fit_transform(rows), "row_id"))
            self.rows = rows
            self.P, pool_ = rows.where("part = 'P'"), rows.where("part = 'U'")
            base = self.config.get("baseline_classifier_config")
            if base:
                self.baseline = baseline_metrics(rows, base, self.labels, base.get("test_size", 0.05), self.seed)
            self.oracle = get_oracle(self.config["al_params"].get("oracle_config") or {"type": "simulated"}, rows.select("row_id", "label"), [r[0] for r in self.labels.collect()])
            self.n_pool = pool_.count()
            vectors = rows.select("row_id", "vec") if "vec" in rows.columns else None
            first = cut(coldstart.select_initial(self.cold_start, pool_.select("row_id"), self.labels.count(), self.seed, None if vectors is None else pool.take(vectors, pool_)))
            # the first labels come from the oracle, as later ones do
            answers = cut(self.oracle.query(pool.take(pool_, first)))
            self.L = cut(answers.where("label is not null").select(*rows.columns))
            self.U = cut(pool.remaining(pool_, first))
            if self._needs_vectors() and late:
                vectors = cut(get_embedder(embedding).fit(self.L).transform(rows))
                self.P, self.U, self.L = (x.join(vectors, "row_id") for x in (self.P, self.U, self.L))
            self.status = "READY"
        except Exception as error:
            self.status, self.error = "SETUP_FAILED", str(error)
            raise
        return self

    def _needs_vectors(self) -> bool:
        models = (self.classifier, self.config.get("baseline_classifier_config") or {})
        return self.cold_start.get("type") == "KM" or any(map(needs_vectors, models))

    # --- one round

    def step(self) -> bool:
        """One round; False if there is nothing more to do."""
        self.status = "STEPPING" if self.status == "READY" else self.status
        return self._round()

    def run(self) -> ActiveLearner:
        if self.status not in ("READY", "STEPPING", "COMPLETED"):
            self.status = "ERROR"
            raise RuntimeError("set up first")
        self.history, self.best, self.waited, self.status, self.kept = [], None, 0, "RUNNING", None
        began = time.time()
        try:
            while len(self.history) < self.max_iterations and self._round():
                pass
            self.status = "COMPLETED"
        except Exception as error:
            self.status, self.error = "FAILED", str(error)
            raise
        finally:
            self.duration = time.time() - began
        return self

    def _round(self) -> bool:
        k, began = len(self.history) + 1, time.time()
        n_l, n_u = self.L.count(), self.U.count()
        if n_l / self.n_pool >= self.budget or n_u == 0:
            return False
        record = dict.fromkeys(("internal_acc", "internal_f1", "external_acc", "external_f1"))
        times = dict.fromkeys(("train_duration_sec", "eval_duration_sec", "query_duration_sec", "update_duration_sec"), 0.0)
        try:
            scored, at = None, time.time()
            if n_l:
                parts = self._split(n_l, k)
                self.model = get_model(self.classifier).fit(parts.where("not held"))
                at = self._clock(times, "train_duration_sec", at)
                held = parts.where("held")
                if self._splits(n_l):
                    record["internal_acc"], record["internal_f1"] = evaluate.metrics(evaluate.paired(held, self.model.predict(held)), self.labels)
                self._maintain()
                known = self.model.predict(self.P) if self.kept is None else predicted(self.kept.scored(self.model.labels), self.model.labels)
                record["external_acc"], record["external_f1"] = evaluate.metrics(evaluate.paired(self.P, known), self.labels)
                at = self._clock(times, "eval_duration_sec", at)
            chosen = cut(self._query(k))
            at = self._clock(times, "query_duration_sec", at)
            answers = cut(self.oracle.query(pool.take(self.U, chosen)))
            if self.selection_log:
                append_csv(pool.selections(answers, chosen, self.config.get("experiment_name"), k, self.asked), self.selection_log)
            L, U = pool.update(self.L, self.U, answers)
            self.L, self.U = cut(L), cut(U)
            self._clock(times, "update_duration_sec", at)
        except Exception as error:
            self.history.append({"iteration": k, "L_size": n_l, "U_size": n_u, **record, **times, "iteration_duration_sec": time.time() - began, "status": "FAILED_ITERATION", "error": str(error)[:500]})
            raise
        self.history.append({"iteration": k, "L_size": n_l, **record, **times, "iteration_duration_sec": time.time() - began, "U_size": self.U.count(), "status": "COMPLETED_ITERATION" if n_l else "SKIPPED_EMPTY_TRAIN", "error": None})
        return not self._stops()

    @staticmethod
    def _clock(times: dict, name: str, since: float) -> float:
        now = time.time()
        times[name] = now - since
        return now

    def _splits(self, n_l: int) -> bool:
        return n_l >= 10 and self.internal_size > 0

    def _split(self, n_l: int, k: int) -> DataFrame:
        return cut(split(self.L, self.internal_size, self.seed + k)) if self._splits(n_l) else self.L.withColumn("held", F.lit(False))

    def _maintain(self) -> None:
        """Brings the scores of P and U up to the model; without effect on models whose scores cannot be maintained."""
        if not isinstance(self.model, TextClassifier) or not maintainable(self.model.vectorizer):
            return
        if self.kept is None:
            rows = self.P.select("row_id", "text").unionAll(self.U.select("row_id", "text"))
            self.kept = MaintainedScores(self.model.vectorizer, rows, [r[0] for r in self.labels.orderBy("label").collect()])
        self.kept.update(self.model.model)

    def _query(self, k: int) -> DataFrame:
        if self.model is not None and self.strategy["type"] in NEED_PROBAS:
            try:
                scored = self.model.scored(self.U) if self.kept is None else pool.take(self.kept.scored(self.model.labels), self.U)
                self.asked = self.strategy["type"]
                return select_batch(self.strategy, self.U, scored, self.seed + k)
            except NoProbabilities as error:  # this round falls back to random rows; any other error is one
                self.error = str(error)[:500]
        self.asked = "RND"
        return random_sampling(self.U, self.strategy["params"]["batch_size"], self.seed + k)

    def _stops(self) -> bool:
        v = self.history[-1].get(self.metric) if self.metric and self.patience else None
        if v is None:
            return False
        if self.best is None or v > self.best + self.tolerance:
            self.best, self.waited = v, 0
        else:
            self.waited += 1
        return self.waited >= self.patience

    # --- results

    def history_frame(self, spark) -> DataFrame:
        from ..sources.tables import RUN_FIELDS
        from .history import ITERATION

        return spark.createDataFrame([tuple(h.get(c) for c in ITERATION) for h in self.history], RUN_FIELDS)

    def summary(self) -> dict:
        return {
            "experiment_name": self.config.get("experiment_name"), "execution_timestamp": time.strftime("%Y-%m-%d %H:%M:%S"), "status": self.status,
            "config": self.config, "baseline_metrics": self.baseline, "history_data": list(self.history), "total_duration_sec": getattr(self, "duration", None), "error_message": self.error,
        }


def run_active_learning(P: DataFrame, U: DataFrame, L: DataFrame, classifier: dict, strategy: dict, max_iterations: int = 1000, budget: float = 1.0, seed=42) -> tuple[list[dict], object]:
    """The loop from given sets (row_id, text, label): labels come from U itself, and nothing stops it early."""
    learner = ActiveLearner({"data_params": {}, "al_params": {"classifier_config": classifier, "query_strategy_config": strategy, "max_iterations": max_iterations, "target_budget_pct": budget}, "general_params": {"random_seed": seed}})
    learner.P, learner.U, learner.L, learner.n_pool = P, U, L, U.count() + L.count()
    learner.labels = cut(P.select("label").union(U.select("label")).union(L.select("label")).distinct())
    learner.oracle = SimulatedOracle(U.select("row_id", "label"))
    learner.status = "READY"
    learner.run()
    return learner.history, learner.model
