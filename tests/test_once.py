"""What is done once: rows embedded by a cache, prompts asked of a chat model, and texts tokenised by a loop."""

import json
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillpool.operators import maintained, models, vectorizer
from quillpool.operators.cache import RowCache
from quillpool.operators.vectorizer import ProductVectorizer
from quillpool.plans import learner, oracle

from .test_operators import loop, texts

# --- embeddings


def lengths(rows):
    return rows.select("row_id", F.array(F.coalesce(F.length("text"), F.lit(-1)).cast("double")).alias("vec"))


def table(spark, rows):
    return spark.createDataFrame(rows, "row_id string, text string")


def test_each_text_is_embedded_once(spark, tmp_path):
    store = RowCache(spark, str(tmp_path / "c"))
    first = [("a", "x"), ("b", "yy"), ("c", "x"), ("d", None), ("e", "")]
    got = lambda rows, fit="f": sorted((r.row_id, r.vec[0]) for r in store.vectors(table(spark, rows), fit, lengths).collect())
    want = lambda rows: sorted((i, float(len(t)) if t is not None else -1.0) for i, t in rows)
    assert got(first) == want(first) and store.made == 4  # null and empty are two texts
    more = [*first, ("f", "yy"), ("g", "new")]
    assert got(more) == want(more) and store.made == 1
    assert got(more) == want(more) and store.made == 0
    assert got(first, "other fit") == want(first) and store.made == 4
    assert got([]) == []
    assert store.compact("f") == 2 and store.compact("f") == 1
    assert got(more) == want(more) and store.made == 0 and store.read("f").count() == 5


def test_writers_of_one_cache(spark, tmp_path):
    """Several at once, of overlapping texts: all get their vectors, and all entries stay readable."""
    path, out, errors, gate = str(tmp_path / "c"), {}, [], threading.Barrier(4)

    def work(k):
        try:
            gate.wait()
            rows = [(f"{k}-{i}", "t" * (i + 3 * k)) for i in range(12)]
            out[k] = (rows, RowCache(spark, path).vectors(table(spark, rows), "f", lengths).collect())
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors
    for rows, got in out.values():
        assert sorted((r.row_id, r.vec[0]) for r in got) == sorted((i, float(len(t))) for i, t in rows)
    store = RowCache(spark, path)
    assert store.read("f").select("digest").distinct().count() == 21
    store.compact("f")
    assert store.read("f").count() == 21


def test_embedder_with_a_cache(spark, tmp_path):
    rows = texts(spark)
    embedder = models.get_embedder({"type": "PVProb", "params": {"cache_dir": str(tmp_path / "c")}}).fit(rows)
    got = {r.row_id: r.vec for r in embedder.transform(rows).collect()}
    plain = {r.row_id: r.vec for r in models.get_embedder({"type": "PVProb"}).fit(rows).transform(rows).collect()}
    assert got.keys() == plain.keys() and all(np.allclose(got[i], plain[i]) for i in got)
    store = RowCache(spark, str(tmp_path / "c"))
    assert store.read(embedder.fitted_on).count() == rows.select("text").distinct().count()
    with pytest.raises(ValueError, match="unknown settings"):
        models.get_embedder({"type": "PVProb", "params": {"cache": "x"}})


# --- prompts


def asker(folder, dies_after=None):
    """A client that writes down what it is asked, and after some answers kills its task."""

    def client(**_):
        answered = [0]

        def call(messages):
            if dies_after is not None and answered[0] == dies_after:
                raise SystemExit("the executor is lost")
            answered[0] += 1
            text = messages[1]["content"].split("Text: ")[1].split("\n")[0]
            with open(f"{folder}/{text}", "a") as f:
                f.write("x")
            return json.dumps({"predicted_category": "ab"[len(text) % 2]})

        return call

    return client


def test_no_prompt_is_asked_twice(spark, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()
    rows = spark.createDataFrame([(i, f"t{i % 25:02}") for i in range(60)], "row_id long, text string").repartition(6)
    settings = {"ledger": f"file://{tmp_path}/ledger", "retry_delay": 0.0}
    ask = lambda dies=None: oracle.get_oracle({"type": "chat", "params": settings | {"client": asker(str(seen), dies)}}, labels=["a", "b"]).query(rows).collect()
    with pytest.raises(Exception):  # noqa: B017
        ask(3)
    told = {f.name: len(f.read_text()) for f in seen.iterdir()}
    assert 0 < len(told) < 25
    got = ask()
    assert len(got) == 60 and all(r.label == "ab"[len(r.text) % 2] for r in got)
    assert {f.name: len(f.read_text()) for f in seen.iterdir()} == {f"t{i:02}": 1 for i in range(25)}
    ask()
    assert all(len(f.read_text()) == 1 for f in seen.iterdir())


def test_columns_of_any_name_pass(spark):
    rows = spark.createDataFrame([(1, "t", "m", "d")], "row_id long, text string, _messages string, _digest string")
    client = lambda **_: lambda messages: json.dumps({"predicted_category": "a"})
    got = oracle.get_oracle({"type": "chat", "params": {"client": client}}, labels=["a"]).query(rows).first()
    assert (got._messages, got._digest, got.label) == ("m", "d", "a")


def test_token_bucket():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    bucket = oracle.TokenBucket(2.0, 3, lambda: now[0], sleep)
    for _ in range(5):
        bucket.take()
    assert slept == [0.5, 0.5] and now[0] == 1.0  # three at once, then two a second
    now[0] += 100
    for _ in range(4):
        bucket.take()
    assert slept == [0.5, 0.5, 0.5]
    with pytest.raises(ValueError):
        oracle.TokenBucket(0)


# --- scores


@pytest.mark.parametrize("settings", [{"method": "binary"}, {"method": "tfidfscikit", "norm": "l2", "query": "tfsmooth", "ngram_range": (1, 2)}, {"method": "termfrequency", "query": "termfrequency"}])
def test_maintained_scores_are_those_of_the_model(spark, settings):
    rows = texts(spark, 120).cache()
    v = ProductVectorizer(**settings)
    kept = maintained.MaintainedScores(v, rows, ["a", "b", "c", "never"])
    for chosen in ("row_id in (0, 3, 9)", "row_id < 12", "row_id < 12 and row_id <> 3 or row_id = 40", "row_id < 30", "row_id < 30"):
        model = v.fit(rows.where(chosen))
        kept.update(model)
        got = {r.row_id: (r.scores, r.probas) for r in kept.scored(model.labels).collect()}
        want = {r.row_id: (r.scores, r.probas) for r in model.scored(rows).collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[i][0], want[i][0], atol=1e-8) and np.allclose(got[i][1], want[i][1]) for i in want)
    assert kept.changed == 0  # nothing changed, nothing was joined


def test_weights_that_depend_on_the_model_are_not_maintained(spark):
    for settings in ({"query": "tfidf"}, {"query_norm": "l2"}):
        assert not maintained.maintainable(ProductVectorizer(**settings))
        with pytest.raises(ValueError):
            maintained.MaintainedScores(ProductVectorizer(**settings), texts(spark), ["a"])


def test_a_loop_reads_texts_once(spark, monkeypatch):
    """Over all rounds P and U are tokenised once; a round joins the weights that changed, ever fewer as L grows."""
    indexed, changed, sizes = [], [], []
    make, update, terms = maintained.MaintainedScores.__init__, maintained.MaintainedScores.update, vectorizer.FittedVectorizer.query_terms
    monkeypatch.setattr(maintained.MaintainedScores, "__init__", lambda self, s, rows, labels: (indexed.append(rows.count()), make(self, s, rows, labels))[1])
    monkeypatch.setattr(maintained.MaintainedScores, "update", lambda self, model: (update(self, model), changed.append((self.changed, model.class_terms.count())))[0])
    monkeypatch.setattr(vectorizer.FittedVectorizer, "query_terms", lambda self, df: (sizes.append(df.count()), terms(self, df))[1])
    run = learner.ActiveLearner(loop(max_iterations=4)).setup(texts(spark)).run()
    assert indexed == [78] and len(changed) == 4 and sizes == []  # 90 rows less the first 12 labelled
    assert all(c < n for c, n in changed[1:])
    plain = loop(max_iterations=4)
    monkeypatch.setattr(learner, "maintainable", lambda s: False)
    same = learner.ActiveLearner(plain).setup(texts(spark)).run()
    assert [(h["L_size"], h["external_acc"], h["external_f1"]) for h in run.history] == [(h["L_size"], h["external_acc"], h["external_f1"]) for h in same.history]
    assert len(sizes) == 8  # two passes a round without


def test_errors_are_not_random_rounds(spark):
    with pytest.raises(ValueError, match="strategy"):
        learner.ActiveLearner(loop("?"))
    broken = loop("HYB")
    broken["al_params"]["query_strategy_config"]["params"]["entropy_fraction"] = 7
    run = learner.ActiveLearner(broken).setup(texts(spark))
    with pytest.raises(ValueError):
        run.run()
    assert run.status == "FAILED" and run.history[-1]["status"] == "FAILED_ITERATION"


# --- populations


def test_children_are_scored_by_difference(spark, monkeypatch):
    """Every member of every generation, after crossover and mutation, as if it were scored from nothing; and by less work."""
    from quillpool.operators.vectorizer import row_terms
    from quillpool.plans import genetic

    rows = texts(spark, 60).cache()
    terms, labels = row_terms(rows, 1, 2).cache(), rows.select("label").distinct()
    asked, scored = [], genetic.GeneticOptimizer._scored

    def both(self, genes, rows, line, labels, todo):
        everyone = [r.individual_id for r in genes.select("individual_id").distinct().collect()]
        near = lambda df: {r.individual_id: (round(r.accuracy, 9), round(r.macro_f1, 9)) for r in df.collect()}
        assert near(line.fitness(rows, labels, everyone)) == near(genetic.fitness(genes, rows, terms, 1, 2, labels))
        asked.append(line.changed)
        return scored(self, genes, rows, line, labels, todo)

    monkeypatch.setattr(genetic.GeneticOptimizer, "_scored", both)
    search = genetic.GeneticOptimizer(size=10, population=4, generations=3, crossover_rate=0.8, mutation_rate=0.6, mutation_strength=2, elitism_rate=0.5, seed=3).run(rows)
    assert asked == search.changed and all(n < asked[0] for n in asked[1:])


def test_cost_follows_exchanged_genes(spark):
    from quillpool.plans import genetic

    rows = texts(spark, 60).cache()
    genes = lambda *ids: spark.createDataFrame([(0, i) for i in ids], "individual_id int, row_id long")
    line, counted = genetic.Lineage(rows, 1, 2), []
    for own, parents in ((range(30), {}), (range(30), {0: 0}), ([*range(29), 31], {0: 0}), ([*range(20), *range(40, 50)], {0: 0}), (range(30), {})):
        line.move(genes(*own), parents)
        counted.append(line.changed)
    assert counted[1] == 0 < counted[2] < counted[3] < counted[0] == counted[4]
    assert line.scores.groupBy("row_id", "label").count().where("count > 1").isEmpty()


# --- workbooks


def test_workbooks_of_all_partitions(spark, tmp_path):
    """More rows than a workbook holds here, from several partitions; tasks write them, and a failed job leaves no row."""
    from quillpool.sources import excel, tables, workbooks

    folder = str(tmp_path / "books.xlsx")
    rows = spark.range(530, numPartitions=4).select(F.concat(F.lit("name <"), "id").alias("name"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("n"), (F.col("id") / 4).alias("x"), (F.col("id") % 2 == 0).alias("even"))
    workbooks.write_workbooks(rows, folder, "data", sheet_rows=60)
    files = [f for f in (tmp_path / "books.xlsx").iterdir() if f.name.endswith(".xlsx")]
    assert len(files) == 12  # 132 or 133 rows a partition: three each
    read = lambda: sorted(str(tuple(r)) for r in tables.read_labeled(spark, folder, "name", "n", sheet="data").collect())
    want = sorted(map(str, (tuple(r) for r in rows.collect())))
    assert read() == want
    broken = rows.withColumn("n", F.when(F.col("name") < "name <5", F.col("n")).otherwise(F.raise_error(F.lit("lost")).cast("long")))
    with pytest.raises(Exception):  # noqa: B017
        workbooks.write_workbooks(broken, folder, "data", sheet_rows=20)
    assert read() == want
    workbooks.write_workbooks(rows.limit(3).withColumn("more", F.lit("m")), folder, "data")
    assert len(read()) == 533 and excel.read_excel(spark, folder, "data").where("more = 'm'").count() == 3
    workbooks.write_workbooks(rows.limit(0), folder, "data", mode="overwrite")
    assert excel.read_excel(spark, folder).count() == 0 and excel.read_excel(spark, folder).columns == ["name", "n", "x", "even"]
    with pytest.raises(Exception, match="a sheet holds"):
        workbooks.write_workbooks(rows, str(tmp_path / "other"), sheet_rows=2_000_000)


# --- classes


def test_most_of_many_classes_are_never_scored(spark):
    """5,000 classes: the two best of each row, and predictions, as from the whole score matrix; with far fewer scores made."""
    rng = np.random.default_rng(7)
    common = [f"c{i}" for i in range(30)]
    own = lambda c: [f"w{c // 8}x{i}" for i in range(4)] + [f"v{c}y{i}" for i in range(6)]  # noqa: E731  eight classes share some words
    text = lambda c: " ".join([*rng.choice(own(c), 6), *rng.choice(common, 6)])
    train = spark.createDataFrame([(c, " ".join([*own(c), *rng.permutation(common)[:24]]), f"k{c:04}") for c in range(5_000)], "row_id long, text string, label string")
    rows = spark.createDataFrame([(i, text(int(rng.integers(0, 5_000)))) for i in range(150)] + [(900, "nothing known"), (901, ""), (902, "c1")], "row_id long, text string").cache()
    model = ProductVectorizer(method="tfidfscikit", query="binary").fit(train)
    terms = model.query_terms(rows).cache()
    whole = model.products(terms).withColumn("score", F.round("score", 9)).cache()
    want = {}
    for r in whole.collect():
        want.setdefault(r.row_id, []).append((-r.score, r.label))
    found = model.best(terms, 2)
    got = {}
    for r in found.rows.orderBy("row_id", "rank").collect():
        got.setdefault(r.row_id, []).append((-r.score, r.label))
    assert got == {i: sorted(v)[:2] for i, v in want.items()}
    assert found.scores.count() < whole.count() / 5
    assert {r.row_id: r.predicted for r in model.predict(rows).collect()} == {r.row_id: (sorted(want[r.row_id])[0][1] if r.row_id in want else "k0000") for r in rows.collect()}
