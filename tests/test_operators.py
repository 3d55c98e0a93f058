"""Hand-made cases, invariants and degraded modes."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillpool.functions import text as T
from quillpool.operators import coldstart, evaluate, models, pool, prepare, select
from quillpool.operators.vectorizer import ProductVectorizer, class_counted
from quillpool.plans import config, curves, genetic, history, learner, manager, oracle
from quillpool.sources import tables


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_label_normalise(spark):
    assert one(spark, T.normal_label(F.lit("  Pão\t de  AÇÚCAR "))) == "pao de acucar"
    assert one(spark, T.normal_label(F.lit("Straße"))) == "strasse"
    assert one(spark, T.tokens(F.lit("Straße, naïve_1!"))) == ["strae", "naive_1"]


def test_seam_ngrams(spark):
    rows = spark.createDataFrame([(1, "a b", "c"), (2, "!", "c"), (50_000, "c d", "c"), (3, "z", "k")], "row_id long, text string, label string")
    got = {(r.label, r.term): r.tf for r in class_counted(rows, 1, 2).collect()}
    assert {t for c, t in got if c == "c"} == {"a", "b", "c", "d", "a b", "b c", "c d"}


@pytest.mark.parametrize("high", [2, 3, 4])
def test_seams_over_chunks(spark, high):
    rng = random.Random(high)
    rows = [(i * rng.choice([1, 3_000, 9_999]) + i * 7, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 3))), rng.choice("xy")) for i in range(60)]
    rows = list({r[0]: r for r in rows}.values())
    want = {}
    for label in "xy":
        toks = [t for _, text, c in sorted(rows) if c == label for t in text.split()]
        for n in range(1, high + 1):
            for i in range(len(toks) - n + 1):
                key = (label, " ".join(toks[i : i + n]))
                want[key] = want.get(key, 0) + 1
    got = class_counted(spark.createDataFrame(rows, "row_id long, text string, label string").repartition(5), 1, high).collect()
    assert {(r.label, r.term): r.tf for r in got} == want


def test_weights(spark):
    train = spark.createDataFrame([(1, "x y y", "a"), (2, "x z", "b")], "row_id long, text string, label string")
    ln2 = math.log(2)
    for method, x, y in (("binary", 1, 1), ("termfrequency", 1, 2), ("tfsmooth", 1, 1 + ln2), ("tf_smooth", 1, 1 + ln2), ("tfidf", 0, 2 * ln2), ("tfidfscikit", 1, 2 * (math.log(3 / 2) + 1))):
        for norm in (None, "l1", "l2"):
            model = ProductVectorizer(method=method, query=method, norm=norm, query_norm=norm).fit(train)
            got = {r.term: r.weight for r in model.class_terms.where("label = 'a'").collect()}
            size = {None: 1, "l1": abs(x) + abs(y), "l2": math.hypot(x, y)}[norm]
            assert got["x"] == pytest.approx(x / size) and got["y"] == pytest.approx(y / size)
            asked = {r.term: r.weight for r in model.query_terms(spark.createDataFrame([(9, "x y y unseen")], "row_id long, text string")).collect()}
            qx, qy = (1, 2 * (ln2 + 1)) if method == "tfidf" else (x, y)
            size = {None: 1, "l1": qx + qy, "l2": math.hypot(qx, qy)}[norm]
            assert set(asked) == {"x", "y"} and asked["x"] == pytest.approx(qx / size) and asked["y"] == pytest.approx(qy / size)
    for wrong in ({"method": "tfidf "}, {"norm": "max"}, {"ngram_range": (2, 1)}):
        with pytest.raises(ValueError):
            ProductVectorizer(**wrong)


def test_no_shared_term(spark):
    train = spark.createDataFrame([(1, "x", "b"), (2, "y", "a")], "row_id long, text string, label string")
    model = ProductVectorizer().fit(train)
    rows = spark.createDataFrame([(5, "q"), (6, ""), (7, None)], "row_id long, text string")
    assert {r.row_id: r.predicted for r in model.predict(rows).collect()} == {5: "a", 6: "a", 7: "a"}
    assert all(r.probas == [0.5, 0.5] for r in model.scored(rows).collect())
    with pytest.raises(ValueError):
        ProductVectorizer().fit(train.limit(0)).scored(rows)


def test_uncertainty(spark):
    got = spark.createDataFrame([([1.0, 0.0],), ([0.7, 0.3],), ([1.0],)], "p array<double>").select(select.entropy(F.col("p")).alias("e"), select.margin(F.col("p")).alias("m")).collect()
    q = np.array([1 - 1e-9, 1e-9])
    assert got[0].e == pytest.approx(-(q * np.log2(q)).sum()) and got[1].m == pytest.approx(0.4) and got[2].m is None
    assert select.hybrid_counts(5, 0.5) == (2, 3) and select.hybrid_counts(3, 0.5) == (2, 1)


def test_selection(spark):
    rows = spark.createDataFrame([(i, [i / 100, 1 - i / 100]) for i in range(100)], "row_id long, probas array<double>")
    ids = {}
    for code in ("RND", "ENT", "LCO", "SMA", "HYB"):
        got = select.select_batch({"type": code, "params": {"batch_size": 11}}, rows, rows, 3).collect()
        ids[code] = [r.row_id for r in got]
        assert len(set(ids[code])) == 11 and sorted(r["rank"] for r in got) == list(range(1, 12))
        again = select.select_batch({"type": code, "params": {"batch_size": 11}}, rows.repartition(7), rows.repartition(5), 3).collect()
        assert sorted(ids[code]) == sorted(r.row_id for r in again)
    assert ids["ENT"][0] == 50 and ids["SMA"][0] == ids["LCO"][0] == 50
    assert select.random_sampling(rows, 1000).count() == 100 and select.random_sampling(rows, 0).count() == 0
    for wrong in ({"type": "ENT", "params": {}}, {"type": "X", "params": {"batch_size": 1}}, {"type": "HYB", "params": {"batch_size": 1, "entropy_fraction": 2}}):
        with pytest.raises(ValueError):
            select.select_batch(wrong, rows, rows)
    single = spark.createDataFrame([(i, [1.0]) for i in range(9)], "row_id long, probas array<double>")
    assert select.smallest_margin(single, 4, 1).count() == 4


def test_macro_f1(spark):
    pairs = spark.createDataFrame([(1, "a", "a"), (2, "a", "b"), (3, "b", "b"), (4, "c", "b")], "row_id long, label string, predicted string")
    labels = spark.createDataFrame([(x,) for x in "abcz"], "label string")
    assert evaluate.macro_f1(pairs, labels).first()[0] == pytest.approx(0.2916667)
    assert evaluate.metrics(pairs, labels) == (0.5, pytest.approx(0.2916667))


def test_lce_and_early_stop(spark):
    points = [("ok", 10, 0.2, 0.8), ("ok", 20, 0.4, 0.8), ("ok", 40, 0.5, 0.8), ("zero", 1, 0.1, 0.0), ("zero", 2, 0.1, 0.0), ("none", 1, 0.1, None), ("none", 2, 0.1, None), ("one", 1, 0.1, 0.5), ("flat", 3, 0.1, 0.5), ("flat", 3, 0.2, 0.5)]
    got = {r.run: r.lce for r in curves.lce(spark.createDataFrame(points, "run string, x double, y double, baseline double".replace("x double", "x int")).withColumn("x", F.col("x").cast("double"))).collect()}
    assert got == {"ok": pytest.approx(0.5), "zero": None, "none": None, "one": None, "flat": None}
    v = [0.5, 0.5005, 0.6, 0.6, None, 0.6005, 0.7]
    r = curves.early_stop(spark.createDataFrame([("r", i + 1, x) for i, x in enumerate(v)], "run string, iteration int, v double"), 0.001, 2).first()
    assert (r.best, r.stop_iteration) == (0.6, 6)


def test_split(spark):
    rows = spark.createDataFrame([(i, "a" if i % 10 else "b" if i else "rare") for i in range(101)], "row_id long, label string")
    for share in (0.05, 0.5, 0.33):
        got = prepare.stratified(rows, "label", "row_id", share, 5).collect()
        assert len(got) == 101 and sum(r.held for r in got) == math.ceil(share * 101)
        for label in "ab":
            mine = [r for r in got if r.label == label]
            assert abs(sum(r.held for r in mine) - share * len(mine)) < 1
        again = prepare.stratified(rows.repartition(9), "label", "row_id", share, 5).where("held").collect()
        assert {r.row_id for r in again} == {r.row_id for r in got if r.held}
        assert sum(r.held for r in prepare.unstratified(rows, "row_id", share, 5).collect()) == math.ceil(share * 101)


def test_labels(spark):
    rows = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b")], "row_id long, label string")
    ids = prepare.label_ids(rows, "label", "row_id")
    assert {r.label: r.label_id for r in ids.collect()} == {"b": 0, "a": 1}
    assert [r.label_id for r in prepare.encoded(rows, ids.where("label = 'a'"), "label", -1).orderBy("row_id").collect()] == [-1, 1, -1]
    with pytest.raises(Exception, match="unknown label"):
        prepare.encoded(rows, ids.where("label = 'a'"), "label").collect()
    assert prepare.rare_grouped(rows, "label", 2).where("label = '_RARE_GROUP_'").count() == 1
    assert prepare.rare_grouped(rows, "label", 1) is rows and prepare.rare_grouped(rows, "label", None) is rows


def test_pool_update(spark):
    u = spark.createDataFrame([(i, f"t{i}") for i in range(6)], "row_id long, text string").withColumn("label", F.lit(None).cast("string"))
    none = u.limit(0)
    truth = spark.createDataFrame([(0, "a"), (1, "b"), (2, None)], "row_id long, label string")
    L, U = pool.update(none, u, pool.answered(u.where("row_id < 3").drop("label"), truth))
    assert {r.row_id for r in L.collect()} == {0, 1} and {r.row_id for r in U.collect()} == {3, 4, 5}
    L, U = pool.update(none, u, pool.answered(u.where("row_id between 2 and 4").drop("label"), truth))
    assert L.count() == 0 and U.count() == 6


def test_readers(spark, tmp_path):
    (tmp_path / "a.CSV").write_text('t,l\n"x, ""y""\nz",b\n')
    got = tables.read_labeled(spark, str(tmp_path / "a.CSV"), "t", "l").collect()
    assert [(r.t, r.l) for r in got] == [('x, "y"\nz', "b")]
    with pytest.raises(ValueError, match="missing columns"):
        tables.read_labeled(spark, str(tmp_path / "a.CSV"), "t", "label")
    with pytest.raises(ValueError, match="unsupported"):
        tables.read_labeled(spark, "x.txt", "t", "l")
    assert config.load_configs(str(tmp_path / "none.json")) == []
    (tmp_path / "bad.json").write_text("{}")
    assert config.load_configs(str(tmp_path / "bad.json")) == []
    assert not config.valid({"experiment_name": "x"})


def test_broken_log_lines(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.txt").write_text('{"experiment_name": "x", "status": "COMPLETED", "baseline_metrics": {"baseline_acc": NaN}, "history_data": [{"iteration": 1}]}\n{"experiment\n{"experiment_name": "y", "status": "FAILED"}\n')
    log = tables.read_log(spark, str(tmp_path / "log"))
    assert history.completed_names(log).count() == 1 and log.where("_corrupt_record is not null").count() == 1


def test_medoids():
    rng = np.random.default_rng(0)
    points = np.concatenate([rng.normal(c, 0.1, (30, 2)) for c in (0, 5, 10)])
    got = coldstart.medoids(points, 3)
    assert sorted(i // 30 for i in got) == [0, 1, 2]
    assert len(coldstart.medoids(points, 1)) == 1


def test_cold_start(spark):
    vectors = spark.createDataFrame([(i, [float(i % 3) * 10, i / 100]) for i in range(30)], "row_id long, vec array<double>")
    got = [r.row_id for r in coldstart.select_initial({"type": "KM", "params": {"n_samples": 3, "method": "pam"}}, vectors, 9, 1, vectors).collect()]
    assert {i % 3 for i in got} == {0, 1, 2}
    assert coldstart.select_initial({"type": "KM", "params": {}}, vectors, 40, 1, vectors).count() == 30
    assert coldstart.select_initial({"type": "RND"}, vectors, 4, 1).count() == 4
    with pytest.raises(ValueError):
        coldstart.select_initial({"type": "Q"}, vectors, 4)


def test_chat_oracle(spark):
    def client():
        seen = {}

        def call(messages):
            text = messages[1]["content"].split("Text: ")[1].split("\n")[0]
            seen[text] = seen.get(text, 0) + 1
            if text == "flaky" and seen[text] < 2 or text == "down":
                raise oracle.ApiError("busy")
            return {"bad": "not json", "odd": json.dumps({"predicted_category": "zzz"})}.get(text, json.dumps({"predicted_category": "a"}))

        return call

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["fine", "flaky", "down", "bad", "odd"])], "row_id long, text string")
    got = oracle.get_oracle({"type": "chat", "params": {"client": client, "retry_delay": 0.0}}, labels=["b", "a"]).query(rows).collect()
    assert {r.text: r.label for r in got} == {"fine": "a", "flaky": "a", "down": None, "bad": None, "odd": None}
    assert one(spark, oracle.prompt(F.lit("{labels} x"), F.array(F.lit("a"), F.lit("b")), "L {labels} T {text}.")) == "L 'a', 'b' T {labels} x."
    assert oracle.get_oracle({}, rows.withColumn("label", F.lit("a"))).query(rows).where("label = 'a'").count() == 5
    with pytest.raises(ValueError):
        oracle.get_oracle({"type": "?"})


def texts(spark, n=90):
    rng = random.Random(1)
    vocab = {"a": "red rose petal garden", "b": "blue wave ocean deep", "c": "iron bolt gear steel"}
    return spark.createDataFrame([(i, " ".join(rng.choice(vocab["abc"[i % 3]].split()) for _ in range(3)) + f" n{i % 5}", "abc"[i % 3]) for i in range(n)], "row_id long, text string, label string")


def loop(strategy="ENT", classifier=None, **more):
    al = {"classifier_config": classifier or {"type": "PVBin", "params": {"ngram_range": [1, 1]}}, "cold_start_config": {"type": "RND", "params": {"n_samples": 12}}, "query_strategy_config": {"type": strategy, "params": {"batch_size": 5}}, "max_iterations": 2}
    return {"experiment_name": "t", "active": True, "data_params": {}, "al_params": al | more, "general_params": {"random_seed": 1}}


def test_loop_keeps_sets_apart(spark):
    rows = texts(spark)
    run = learner.ActiveLearner(loop(internal_test_size=0.2)).setup(rows).run()
    ids = [{r.row_id for r in d.collect()} for d in (run.L, run.U, run.P)]
    assert sum(map(len, ids)) == 90 and len(set.union(*ids)) == 90
    assert run.status == "COMPLETED" and [h["L_size"] for h in run.history] == [12, 17] and len(ids[0]) == 22
    assert run.history[-1]["U_size"] == len(ids[1]) and run.history[0]["internal_acc"] is not None
    assert run.history_frame(spark).count() == 2
    with pytest.raises(ValueError):
        learner.ActiveLearner({})
    with pytest.raises(RuntimeError):
        learner.ActiveLearner(loop()).run()


def test_loop_degraded(spark):
    rows = texts(spark)
    # a model without probabilities queries at random, in that round only
    run = learner.ActiveLearner(loop("LCO", {"type": "LSVC", "params": {"max_iter": 2}}, max_iterations=1)).setup(rows).run()
    assert "no probabilities" in run.error and run.history[0]["status"] == "COMPLETED_ITERATION"
    # an empty start queries at random
    empty = learner.ActiveLearner(loop(cold_start_config={"type": "RND", "params": {"n_samples": 0}})).setup(rows).run()
    assert empty.history[0]["status"] == "SKIPPED_EMPTY_TRAIN" and empty.history[1]["L_size"] == 5
    budget = learner.ActiveLearner(loop(target_budget_pct=0.3)).setup(rows).run()
    assert [h["L_size"] for h in budget.history] == [12]
    stopped = learner.ActiveLearner(loop(max_iterations=9, early_stopping_metric="external_acc", early_stopping_patience=1, early_stopping_tolerance=2.0)).setup(rows).run()
    assert len(stopped.history) == 2
    parts = [rows.where(f"row_id % 3 = {k}") for k in range(3)]
    hist, model = learner.run_active_learning(*parts, {"type": "PVBin"}, {"type": "SMA", "params": {"batch_size": 20}}, 3)
    assert [h["L_size"] for h in hist] == [30, 50] and model is not None


def test_feature_models(spark):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, [float(x) for x in rng.normal([6 * (i % 3), -6 * (i * i % 3)], 0.3)], "xyz"[i % 3]) for i in range(90)], "row_id long, vec array<double>, label string")
    for code, params in (("GNB", {}), ("LR", {}), ("LSVC", {"max_iter": 10}), ("SGD", {}), ("SGD", {"loss": "log_loss"})):
        model = models.get_model({"type": code, "params": params}).fit(rows)
        assert evaluate.accuracy(evaluate.paired(rows, model.predict(rows))).first().accuracy > 0.9
        if code in ("LSVC",) or params == {} and code == "SGD":
            with pytest.raises(models.NoProbabilities):
                model.scored(rows)
        else:
            assert all(abs(sum(r.probas) - 1) < 1e-6 for r in model.scored(rows).collect())
    with pytest.raises(ValueError):
        models.get_model({"type": "?"})
    vecs = models.get_embedder({"type": "PVProb"}).fit_transform(texts(spark))
    assert all(abs(sum(r.vec) - 1) < 1e-9 for r in vecs.collect())
    with pytest.raises(ValueError):
        models.ProbabilityEmbedder().fit(texts(spark).drop("label"))


def test_large_gaussian_models_are_arrays(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(i, rng.normal(i % 7, 0.4, 3).tolist(), f"c{i % 7}") for i in range(140)], "row_id long, vec array<double>, label string").cache()
    model = models.get_model({"type": "GNB"}).fit(rows)
    want = {r.row_id: r.scores for r in model.scored(rows).collect()}
    monkeypatch.setattr(models.GaussianNB, "most_inline", 0)
    got = model.scored(rows)
    assert "MapInPandas" in got._jdf.queryExecution().toString()
    assert all(np.allclose(r.scores, want[r.row_id], atol=1e-6) for r in got.collect())


def test_manager(spark, tmp_path):
    rows = texts(spark)
    configs = [loop(max_iterations=1), loop() | {"experiment_name": "off", "active": False}, {"experiment_name": "invalid"}, loop("?") | {"experiment_name": "fails", "data_params": {"text_column": "none"}}]
    (tmp_path / "e.json").write_text(json.dumps(configs))
    m = manager.ExperimentManager(spark, str(tmp_path / "e.json"), str(tmp_path / "log"), lambda d: rows)
    assert m.load_and_prepare() == 4
    assert m.run_pending() == [("t", "COMPLETED"), ("fails", "FAILED")]
    assert m.history.completed() == {"t"} and m.history.iterations("t").count() == 1
    assert [n for n, _ in m.run_pending()] == ["fails"]
    assert {r.status: r.runs for r in m.summary().collect()} == {"FAILED": 1}
    assert m.curve("t").count() == 1


def test_crossover_and_mutation(spark):
    rng = random.Random(2)
    pairs = [(i, rng.sample(range(20), 6), rng.sample(range(20), 6)) for i in range(30)] + [(99, [1], [2])]
    for r in genetic.crossover(spark.createDataFrame(pairs, "pair int, a array<long>, b array<long>")).collect():
        a, b = next((set(x), set(y)) for p, x, y in pairs if p == r.pair)
        assert len(set(r.genes)) == len(a) == len(r.genes) and set(r.genes) <= a | b
    genes = spark.createDataFrame([(i, p, p) for i in range(3) for p in range(5)], "individual_id int, gene_pos int, row_id long")
    rows = spark.range(8).select(F.col("id").alias("row_id"))
    for strength, changed in ((2, 2), (5, 3)):  # three rows are outside
        got = genetic.mutation(genes, rows, strength).collect()
        for i in range(3):
            mine = [r for r in got if r.individual_id == i]
            assert len({r.row_id for r in mine}) == 5 and sum(r.row_id != r.gene_pos for r in mine) == changed


def test_genetic_run(spark, tmp_path):
    rows = texts(spark, 45)
    best = genetic.GeneticOptimizer(size=4, population=4, generations=3, elitism_rate=0.5).run(rows)
    tops = [h[1] for h in best.history]
    assert tops == sorted(tops) and best.best_metric == max(tops) and len(set(best.best)) == 4
    worst = genetic.GeneticOptimizer(size=4, population=4, generations=2, goal="minimize", metric="macro_f1").run(rows)
    assert worst.best_metric == min(h[6] for h in worst.history)
    with pytest.raises(ValueError):
        genetic.GeneticOptimizer(size=4, metric="x")
    settings, goals = {"size": 3, "population": 2, "generations": 1}, (("accuracy", "maximize"),)
    assert genetic.run_goals(rows, str(tmp_path / "g"), settings, goals) == [("accuracy_maximize", True)]
    assert genetic.run_goals(rows, str(tmp_path / "g"), settings, goals) == [("accuracy_maximize", False)]
    assert spark.read.parquet(str(tmp_path / "g" / "accuracy_maximize" / "best")).count() == 3


def test_cache(spark, tmp_path):
    from quillpool.operators.cache import fingerprint

    rows = texts(spark, 12)
    assert fingerprint(rows, 1) == fingerprint(rows.orderBy(F.col("row_id").desc()).repartition(3), 1)
    assert len({fingerprint(rows, 1), fingerprint(rows, 2), fingerprint(rows.where("row_id > 0"), 1), fingerprint(rows.withColumn("label", F.lit("a")), 1)}) == 4
    embedder = models.get_embedder({"type": "PVProb", "params": {"cache_dir": str(tmp_path / "e")}})
    first = sorted(map(tuple, embedder.fit_transform(rows).collect()))
    assert first == sorted(map(tuple, embedder.fit_transform(rows.orderBy(F.col("row_id").desc())).collect())) and len(list((tmp_path / "e" / "data").iterdir())) == 1


def test_embedder_on_start_only(spark):
    run = learner.ActiveLearner(loop("ENT", {"type": "GNB"}, max_iterations=1) | {"embedder_global_config": {"type": "PVProb", "fit_on": "L"}}).setup(texts(spark)).run()
    assert run.history[0]["status"] == "COMPLETED_ITERATION" and run.history[0]["external_acc"] is not None


def test_label_places(spark):
    base = ProductVectorizer()
    model = base.set_params(method="binary").fit(texts(spark, 9))
    assert base.method == "tfidf" and [model.index_of(x) for x in "ab?"] == [0, 1, -1] and model.label_of(2) == "c" and model.label_of(3) is None


def test_total_distances_of_all_rows(spark):
    points = np.random.default_rng(2).normal(size=(4_500, 3))  # more than a block
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(points.tolist())], "row_id long, vec array<double>")
    want = np.sqrt(((points[:, None, :] - points[None, :, :]) ** 2).sum(-1)).sum(1)
    for more in ({}, {"block": 1000, "at_once": 2}):
        got = {r.row_id: r.total for r in coldstart.total_distances(rows, rows, **more).collect()}
        assert np.allclose([got[i] for i in range(4_500)], want)


@pytest.mark.parametrize("k", [1, 4])
def test_medoids_of_the_whole_pool(spark, k):
    """By blocks as by one matrix, and no exchange of a medoid for another row is better."""
    points = np.random.default_rng(k).normal(size=(230, 3)) + np.repeat([[0, 0, 0], [6, 0, 0]], [150, 80], 0)
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(points.tolist())], "row_id long, vec array<double>").repartition(5).cache()
    got = [r.row_id for r in coldstart.kmedoids(rows, k, matrix_rows=60).orderBy("rank").collect()]
    assert got == coldstart.medoids(points, k).tolist() == [r.row_id for r in coldstart.kmedoids(rows, k).orderBy("rank").collect()]
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    cost = lambda chosen: d[:, chosen].min(1).sum()
    assert all(cost([*got[:m], j, *got[m + 1 :]]) > cost(got) - 1e-6 for m in range(k) for j in range(230))
    assert coldstart.cost(rows, spark.createDataFrame([(i,) for i in got], "row_id long")) == pytest.approx(cost(got))


def test_medoids_of_the_best_sample(spark):
    rng = np.random.default_rng(6)
    points = np.concatenate([rng.normal(size=(390, 2)), rng.normal(size=(10, 2)) + 500])  # a rare group far away
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(points.tolist())], "row_id long, vec array<double>").cache()
    costs = {n: coldstart.cost(rows, coldstart.kmedoids(rows, 2, 1, sample=30, samples=n)) for n in (1, 5)}
    want = np.sqrt(((points[:, None] - points[[r.row_id for r in coldstart.kmedoids(rows, 2, 1, sample=30).collect()]]) ** 2).sum(-1)).min(1).sum()
    assert costs[5] <= costs[1] and abs(costs[5] - want) < 1e-6
    assert costs[5] < 2_000  # the rare group has a medoid


def test_seams_of_text_ids_and_groups(spark):
    rng = random.Random(8)
    rows = [(f"{rng.getrandbits(40):x}", " ".join(rng.choice("abc") for _ in range(rng.randint(0, 4))), rng.choice("xy"), rng.randint(0, 1)) for _ in range(80)]
    want = {}
    for label in "xy":
        for g in (0, 1):
            toks = [t for _, text, c, h in sorted(rows) if (c, h) == (label, g) for t in text.split()]
            for n in (2, 3):
                for i in range(len(toks) - n + 1):
                    key = (g, label, " ".join(toks[i : i + n]))
                    want[key] = want.get(key, 0) + 1
    got = class_counted(spark.createDataFrame(rows, "row_id string, text string, label string, g int").repartition(7), 2, 3, ("g", "label")).collect()
    assert {(r.g, r.label, r.term): r.tf for r in got} == want


def test_equal_timestamps_keep_the_order_of_the_log(spark, tmp_path):
    log = history.HistoryManager(spark, str(tmp_path / "log"))
    run = {"experiment_name": "e", "status": "COMPLETED", "execution_timestamp": "2024-01-01 00:00:00"}
    for name, iterations in (("first", 1), ("then a longer one", 40), ("last", 2)):
        log.record(run | {"error_message": name, "history_data": [{"iteration": k} for k in range(iterations)]})
    assert [r.error_message for r in log.latest("e").collect()] == ["first"]
    assert [r.error_message for r in log.log().orderBy("number", "place").collect()] == ["first", "then a longer one", "last"]


def test_selection_log(spark, tmp_path):
    path = str(tmp_path / "log")
    settings = loop()
    settings["general_params"] |= {"verbose": True, "selection_log_file": path}
    rows = texts(spark).withColumn("text", F.concat("text", F.lit(' said "so",\nand left')))
    run = learner.ActiveLearner(settings).setup(rows).run()
    got = tables.read_csv(spark, path, "experiment_name STRING, iteration INT, query_strategy STRING, row_id BIGINT, text STRING, oracle_label STRING, uncertainty_score DOUBLE").collect()
    assert len(got) == 10 and {r.iteration for r in got} == {1, 2} and {r.query_strategy for r in got} == {"ENT"}
    known = {r.row_id: (r.text, r.label) for r in run.rows.collect()}
    assert all((r.text, r.oracle_label) == known[r.row_id] and r.uncertainty_score >= 0 for r in got)
    settings = loop("RND")
    settings["general_params"] |= {"verbose": True, "selection_log_file": path + "2"}
    learner.ActiveLearner(settings).setup(rows).run()
    assert spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path + "2").where("uncertainty_score is null").count() == 10


def test_registered_models(spark):
    class Longest(models.Classifier):
        def __init__(self, shift=0):
            self.shift = shift

        def fit(self, df):
            self.labels = [r.label for r in df.select("label").distinct().orderBy("label").collect()]
            return self

        def predict(self, df):
            names = F.array(*map(F.lit, self.labels))
            return df.select("row_id", F.element_at(names, (F.pmod(F.col("row_id") + self.shift, F.lit(len(self.labels))) + 1).cast("int")).alias("predicted"))

    class Two(models.Embedder):
        dimension = 2

        def fit(self, df):
            return self

        def transform(self, df):
            return df.select("row_id", F.array(F.length("text").cast("double"), F.pmod("row_id", F.lit(3)).cast("double")).alias("vec"))

    models.register_model("Longest", Longest)
    models.register_embedder("Two", Two)
    try:
        rows = texts(spark)
        model = models.get_model({"type": "Longest", "params": {"shift": 0}}).fit(rows)
        assert evaluate.accuracy(evaluate.paired(rows, model.predict(rows))).first().accuracy == 1
        with pytest.raises(models.NoProbabilities):
            model.scored(rows)
        run = learner.ActiveLearner(loop("ENT", {"type": "Longest"})).setup(rows).run()
        assert run.history[-1]["external_acc"] == 1 and run.asked == "RND"
        settings = loop("RND", {"type": "GNB"}) | {"embedder_global_config": {"type": "Two"}}
        assert learner.ActiveLearner(settings).setup(rows).run().history[-1]["external_acc"] == 1
    finally:
        del models.MODELS["Longest"], models.EMBEDDERS["Two"]


def test_prompts(spark):
    text, labels = F.lit("a {labels} $text"), F.array(F.lit("x"), F.lit("y"))
    assert one(spark, oracle.prompt(text, labels, "{text}|{text}|${text}|$labels|{unknown}|$5|{kind}", kind=F.lit("k"))) == "a {labels} $text|a {labels} $text|a {labels} $text|'x', 'y'|{unknown}|$5|k"
    assert one(spark, oracle.prompt(F.lit(None).cast("string"), labels, "[{text}]")) == "[]"
    seen = []
    asked = oracle.ChatOracle(["x", "y"], lambda **given: lambda messages: json.dumps({"predicted_category_name": "x" if given == {"model": "m", "api_key": "k", "schema": oracle.ANSWER_WITH_CODE} and messages[1]["content"] == "7: one" else "?", "predicted_category_code": 1}), model="m", api_key="k", user="{row_id}: {text}", schema=oracle.ANSWER_WITH_CODE, fields=("row_id",))
    got = asked.query(spark.createDataFrame([(7, "one"), (8, "two")], "row_id long, text string")).orderBy("row_id").collect()
    assert [r.label for r in got] == ["x", None] and not seen
    with pytest.raises(ValueError):
        oracle.ChatOracle(["x"], None, schema="a STRING")


def test_genetic_search_with_any_classifier(spark, tmp_path):
    rows = texts(spark, 45)
    embedder = models.get_embedder({"type": "PVProb"}).fit(rows)
    path = str(tmp_path / "log")
    settings = {"size": 12, "population": 3, "generations": 2, "elitism_rate": 0.4, "log_path": path}
    for classifier, more in (({"type": "GNB"}, {"embedder": embedder}), ({"type": "PVBin", "params": {"method": "tfidf", "norm": "l2"}}, {"labels": ["a", "b", "c", "zz"]})):
        found = genetic.GeneticOptimizer(classifier=classifier, **settings, **more).run(rows)
        assert len(found.log) == 6 and found.best_metric == max(x[2] for x in found.log) and len(set(found.best)) == 12
    one_class = genetic.GeneticOptimizer(size=3, population=2, generations=1, classifier={"type": "LSVC"}, embedder=embedder).run(rows.withColumn("label", F.lit("a")))
    assert one_class.best is None or one_class.best_metric == 1
    log = spark.read.option("header", True).csv(path).collect()
    assert len(log) == 12 and log[0].asDict().keys() == set(genetic.DETAILS)
    assert all(r.l0_size == "12" and float(r.fitness_calc_time_sec) >= 0 and 0 <= float(r.accuracy_on_full) <= 1 and len(r.l0_indices_hash) == 10 for r in log)
    with pytest.raises(ValueError):
        genetic.GeneticOptimizer(size=46).run(rows)


def test_goals_as_csv(spark, tmp_path):
    settings, goals = {"size": 3, "population": 2, "generations": 1}, (("macro_f1", "minimize"),)
    genetic.run_goals(texts(spark, 30), str(tmp_path / "g"), settings, goals, csv=True)
    best = spark.read.option("header", True).csv(str(tmp_path / "g" / "macro_f1_minimize" / "best_csv")).collect()
    assert len(best) == 3 and {r.l0_indices_str for r in best} == {",".join(sorted((r.row_id for r in best), key=int))}


def test_set_keys(spark):
    genes = spark.createDataFrame([(0, 0, 5), (0, 1, 7), (1, 0, 7), (1, 1, 5), (2, 0, 5), (2, 1, 8)], "individual_id int, gene_pos int, row_id long")
    keys = {r.individual_id: r.key for r in genetic.set_keys(genes).collect()}
    assert keys[0] == keys[1] != keys[2]


def test_vectorizer_without_labels(spark):
    rows = spark.createDataFrame([(1, "x y y"), (2, "x z")], "row_id long, text string")
    model, weights = ProductVectorizer(method="termfrequency", query="termfrequency").fit_transform(rows)
    assert model.labels == ["1", "2"]
    assert {(r.row_id, r.term): r.weight for r in weights.collect()} == {(1, "x"): 1, (1, "y"): 2, (2, "x"): 1, (2, "z"): 1}
    assert {r.term: (r["1"], r["2"]) for r in model.term_document_matrix().collect()} == {"x": (1, 1), "y": (2, 0), "z": (0, 1)}
    assert {r.term: r["9"] for r in model.term_query_matrix(spark.createDataFrame([(9, "z z q")], "row_id long, text string")).collect()} == {"z": 2}


def test_shared_folder_must_be_named_on_a_cluster():
    from types import SimpleNamespace

    from quillpool.session import shared_dir

    conf = SimpleNamespace(get=lambda key: None)
    cluster = SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: conf, getCheckpointDir=lambda: None, master="spark://host:7077"))
    with pytest.raises(ValueError):
        shared_dir(cluster)


def test_excel(spark, tmp_path):
    from quillpool.sources import excel

    rows = [("a <b> & \"c\"\n d", 1, 0.5, True, None), (None, 2, 3.0, False, None), ("é 日本", None, None, None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "text string, `whole number` long, share double, flag boolean, nothing string").coalesce(1)
    path = str(tmp_path / "t.XLSX")
    excel.write_excel(df, path, "data & more")
    for sheet in (0, "data & more"):
        got = tables.read_labeled(spark, path, "text", "flag", sheet=sheet)
        assert [t for _, t in got.dtypes] == ["string", "bigint", "double", "boolean", "string"]
        assert [tuple(r) for r in got.collect()] == rows[:3]  # rows without any value are left out
    with pytest.raises(Exception, match="no sheet"):
        excel.read_excel(spark, path, "other").count()
    # shared strings, cells without places, gaps, errors and formulas
    main = f'xmlns="{excel.MAIN}"'
    sheet = f'<worksheet {main}><sheetData><row><c t="s"><v>0</v></c><c t="s"><v>1</v></c><c/><c t="str"><v>d</v></c></row><row r="3"><c r="B3" t="e"><v>#N/A</v></c><c r="D3"><f>1+1</f><v>2</v></c><c r="E3"><v>9</v></c></row><row r="4"><c r="A4" t="s"><v>1</v></c><c r="D4" t="inlineStr"><is><r><t>x</t></r><r><t>y</t></r></is></c></row></sheetData></worksheet>'
    shared = f"<sst {main}><si><t>a</t></si><si><r><t>b</t></r><r><t> c</t></r><rPh><t>no</t></rPh></si></sst>"
    import io
    import zipfile

    book = io.BytesIO(excel.workbook(["x"], []))
    out = io.BytesIO()
    with zipfile.ZipFile(book) as old, zipfile.ZipFile(out, "w") as new:
        for name in old.namelist():
            new.writestr(name, sheet if name.endswith("sheet1.xml") else old.read(name))
        new.writestr("xl/sharedStrings.xml", shared)
    (tmp_path / "u.xlsx").write_bytes(out.getvalue())
    got = excel.read_excel(spark, str(tmp_path / "u.xlsx"))
    assert got.columns == ["a", "b c", "d"] and sorted(map(tuple, got.collect()), key=str) == [("b c", None, "xy"), (None, None, "2")]
    excel.write_excel(df.limit(0), str(tmp_path / "e.xlsx"))
    assert excel.read_excel(spark, str(tmp_path / "e.xlsx")).count() == 0


def test_rows_of_a_class_are_not_gathered(spark):
    """Rows meet a table of classes where they are: no join deals them out by label alone."""
    from quillpool.operators import prepare
    from quillpool.plans import genetic

    rows = texts(spark).unionByName(spark.createDataFrame([(1000, "rare", "once")], "row_id long, text string, label string"))
    grouped = genetic.dataset(rows, "text", "label", "row_id", 2, rows.select("label").distinct().unionByName(spark.createDataFrame([("_RARE_GROUP_",)], "label string")))
    ids = prepare.label_ids(rows, "label", "row_id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (grouped, prepare.encoded(rows, ids, "label"), prepare.decoded(prepare.encoded(rows, ids, "label").drop("label"), ids), prepare.stratified(rows, "label", "row_id", 0.3, 1)):
            df.collect()
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert not [x for x in plan.splitlines() if "SortMergeJoin" in x and "prefix" not in x], plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [r.label for r in grouped.where("row_id = 1000").collect()] == ["_RARE_GROUP_"] and grouped.count() == rows.count()


def test_terms_of_rows_are_not_shuffled(spark):
    """Texts are dealt out by row, then their terms counted in place; two rows of one id are one."""
    from quillpool.operators.vectorizer import counted

    rows = spark.createDataFrame([(1, "a b a"), (1, "b c"), (2, "a"), (3, None)], "row_id long, text string")
    out = counted(rows, 1, 2).groupBy("row_id").agg(F.count("*").alias("n"), F.sum("tf").alias("tf"))
    assert sorted(map(tuple, out.collect())) == [(1, 6, 8), (2, 1, 1)]
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert "Exchange" in plan and "term" not in "".join(x for x in plan.splitlines() if "Exchange" in x)
