"""Medoids by bounds and linear models by passes, against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillpool.functions.draws import draw
from quillpool.operators import coldstart, evaluate, linear, medoids, models


def table(spark, points, parts=4):
    return spark.createDataFrame([(i, p) for i, p in enumerate(np.asarray(points).tolist())], "row_id long, vec array<double>").repartition(parts).cache()


def totals(points):
    return np.concatenate([np.sqrt(((points[a : a + 500, None] - points[None]) ** 2).sum(-1)).sum(1) for a in range(0, len(points), 500)])


# --- medoids


@pytest.mark.parametrize("offset", [0.0, 1e4])
def test_bounds_hold(offset):
    rng = np.random.default_rng(1)
    for points in (rng.normal(size=(300, 5)), rng.normal(size=(300, 2)) ** 3, np.repeat(rng.normal(size=(3, 4)), 100, 0), np.zeros((10, 3)), rng.normal(size=(1, 3))):
        points = points + offset
        centre = points.mean(0)
        z = points - centre
        y = np.concatenate([np.ones((len(z), 1)), z, (z * z).sum(1)[:, None]], 1)
        lower, upper = medoids.Gram(centre, y.T @ y).bounds(points)
        t = totals(points)
        assert (lower <= t + 1e-9).all() and (t <= upper + 1e-9).all()


@pytest.mark.parametrize("kind", ["spread", "copies", "far", "few"])
def test_least_totals_are_exact(spark, kind):
    rng = np.random.default_rng(3)
    points = rng.normal(size=(900, 6)) + np.repeat([[0] * 6, [3] * 6], [700, 200], 0)
    if kind == "copies":
        points[50:650] = points[50]  # two thirds are one point
    if kind == "far":
        points[:4] *= 1e4
    if kind == "few":
        points = points[:6]
    t = np.round(totals(points), 4)
    want = sorted(zip(t, range(len(t))))[:10]
    found = medoids.least_totals(table(spark, points), 10, digits=4, parts=3, block=70, at_once=2)
    assert [(round(r.total, 4), r.row_id) for r in found.rows.collect()] == [(round(float(a), 4), i) for a, i in want]
    assert coldstart.least_total(table(spark, points), 10, 4, matrix_rows=100).collect() == coldstart.least_total(table(spark, points), 10, 4).collect()


def test_distances_grow_slower_than_pairs(spark):
    """From 2,000 rows, all of which are summed, to 50,000: a power below 1.6, and a small share of all pairs."""
    rng = np.random.default_rng(5)
    points = rng.normal(size=(10, 16))[rng.integers(0, 10, 50_000)] + 0.5 * rng.normal(size=(50_000, 16))
    counted = medoids.least_totals(table(spark, points, 8), 10, digits=4).distances
    assert counted < 50_000**2 / 20 and np.log(counted / 2_000**2) / np.log(25) < 1.6


def test_medoids_beyond_one_matrix(spark):
    """More rows than one task's matrix: the same medoids as plain partitioning around medoids, by fewer distances."""
    rng = np.random.default_rng(8)
    points = np.concatenate([rng.normal(size=(2_000, 3)), rng.normal(size=(1_500, 3)) + 5, rng.normal(size=(700, 3)) - 6])
    want = coldstart.medoids(points, 3).tolist()
    rows = table(spark, points, 8)
    assert len(points) > coldstart.MATRIX_ROWS
    assert [r.row_id for r in coldstart.kmedoids(rows, 3).orderBy("rank").collect()] == want
    first = [(r.row_id, points[r.row_id].tolist()) for r in medoids.least_totals(rows, 3).rows.orderBy("total", "row_id").collect()]
    chosen, counted = medoids.swapped(rows, first)
    assert sorted(i for i, _ in chosen) == want and counted[0] == 4_200
    assert len(counted) > 2 and min(counted[1:]) < 4_200  # a swap takes up only rows whose medoids changed


def test_rows_do_not_pass_the_driver(spark, monkeypatch):
    """Pairs meet in tasks: neither totals nor swaps send rows out from the driver."""
    monkeypatch.setattr(medoids, "blocks", None)
    rng = np.random.default_rng(4)
    points = np.concatenate([rng.normal(size=(60, 3)), rng.normal(size=(40, 3)) + 4])
    rows = table(spark, points)
    first = [(r.row_id, points[r.row_id].tolist()) for r in medoids.least_totals(rows, 2, block=30).rows.orderBy("total", "row_id").collect()]
    assert [i for i, _ in first] == np.argsort(totals(points), kind="stable")[:2].tolist()
    assert sorted(i for i, _ in medoids.swapped(rows, first, block=30)[0]) == coldstart.medoids(points, 2).tolist()


def test_quick_distances_keep_to_their_error():
    rng = np.random.default_rng(6)
    points = np.concatenate([rng.normal(size=(300, 8)) + 1e4, np.full((5, 8), 1e4), 1e4 + 1e-7 * rng.normal(size=(5, 8))])
    quick = medoids.Quick(points.mean(0), float(np.linalg.norm(points - points.mean(0), axis=1).max()))
    off = quick.distances(points, points, quick.ready(points), quick.ready(points, True)) - medoids.distances(points, points)
    assert np.abs(off).max() <= quick.error < 1e-7


@pytest.mark.parametrize("kind", ["sphere", "copies", "far"])
@pytest.mark.parametrize("k", [1, 4])
def test_sums_of_swaps_keep_to_their_error(kind, k):
    """In single precision, over several swaps: never off by more than the error that goes with them, which stays small."""
    rng = np.random.default_rng(7)
    points = rng.normal(size=(700, 16))
    if kind == "sphere":
        points /= np.linalg.norm(points, axis=1)[:, None]
    if kind == "copies":
        points[100:400] = points[100]
    if kind == "far":
        points = points + np.repeat([[1e4] * 16, [1e4 + 5] * 16], [400, 300], 0)
    centre = points.mean(0)
    radius = float(np.linalg.norm(points - centre, axis=1).max())
    chosen, before = points[:k], None
    sums, z = medoids.Sums(points, centre, radius, k), (points - centre).astype(np.float32)
    for step in range(4):
        state = medoids.states(points, chosen, 4 * radius)
        old = np.stack([np.zeros(700), np.zeros(700), state[:, 2]], 1) if before is None else before
        moved = (old != state).any(1)
        sums.add(z[moved], np.concatenate([old, state], 1)[moved])
        order = np.argsort(state[:, 2], kind="stable")
        want = medoids.shares(medoids.distances(points, points[order]), *state[order].T, k)
        assert (np.abs(sums.sums - want) <= sums.errors).all()
        assert np.median(sums.errors) < 2e-4 * radius * 700 * (step + 1)
        before, chosen = state, np.concatenate([chosen[:-1], points[[600 - 20 * step]]])


@pytest.mark.parametrize("few", [0, 1_024])
def test_swaps_leave_few_candidates_open(spark, monkeypatch, few):
    """No structure, many dimensions: swaps as in plain partitioning, and only a small share of candidates is summed again."""
    points = np.random.default_rng(9).normal(size=(1_500, 32))
    points /= np.linalg.norm(points, axis=1)[:, None]
    points[700:720] = points[3]
    rows = table(spark, points)
    first = [(r.row_id, points[r.row_id].tolist()) for r in medoids.least_totals(rows, 4).rows.orderBy("total", "row_id").collect()]
    summed, kept = [], {name: getattr(medoids, name) for name in ("best_of", "best_of_many")}
    monkeypatch.setattr(medoids, "FEW", few)
    for name in kept:
        monkeypatch.setattr(medoids, name, lambda t, some, *more, name=name: summed.append((name, some.count() if name.endswith("many") else len(some))) or kept[name](t, some, *more))
    assert sorted(i for i, _ in medoids.swapped(rows, first)[0]) == coldstart.medoids(points, 4).tolist()
    assert {name for name, _ in summed} == {"best_of" if few else "best_of_many"}
    assert len(summed) > 3 and np.mean([n for _, n in summed]) < 1_500 / 20


# --- linear models


def labelled(spark, n=400, dim=5, classes="xyz", seed=2, spread=1.0):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, len(classes), n)
    x = rng.normal(size=(len(classes), dim))[y] * 2 + spread * rng.normal(size=(n, dim))
    return x, y, spark.createDataFrame([(i, x[i].tolist(), classes[y[i]]) for i in range(n)], "row_id long, vec array<double>, label string").repartition(5)


def plain_squared_hinge(x, sign, C, weight):
    """Newton's method with the whole Hessian."""
    w = np.zeros(x.shape[1])
    value = lambda w: w @ w / 2 + C * (weight * np.maximum(0, 1 - sign * (x @ w)) ** 2).sum()
    for _ in range(200):
        short = np.maximum(0, 1 - sign * (x @ w))
        g = w - 2 * C * x.T @ (weight * sign * short)
        on = short > 0
        step = -np.linalg.solve(np.eye(len(w)) + 2 * C * (x[on] * weight[on][:, None]).T @ x[on], g)
        size = 1.0
        while value(w + size * step) > value(w) + 1e-4 * size * g @ step and size > 1e-9:
            size /= 2
        w = w + size * step
        if np.linalg.norm(g) < 1e-10:
            break
    return w


@pytest.mark.parametrize("params", [{}, {"C": 0.03, "class_weight": "balanced"}, {"C": 20.0, "intercept_scaling": 2.0, "class_weight": {"x": 3.0}}, {"fit_intercept": False}])
def test_squared_hinge_is_plain(spark, params):
    x, y, rows = labelled(spark)
    model = models.get_model({"type": "LSVC", "params": params | {"dual": True}}).fit(rows)
    assert model.converged and 0 < model.iterations < 30
    scale = params.get("intercept_scaling", 1.0) if params.get("fit_intercept", True) else 0.0
    wider = np.concatenate([x, np.full((len(x), 1), scale)], 1) if scale else x
    counts = np.bincount(y)
    weight = {"balanced": counts.sum() / (3 * counts), None: np.ones(3)}.get(params.get("class_weight") if not isinstance(params.get("class_weight"), dict) else "", np.array([3.0, 1.0, 1.0]))
    for k in range(3):
        w = plain_squared_hinge(wider, np.where(y == k, 1.0, -1.0), params.get("C", 1.0), weight[y])
        assert np.abs(model.coef[k] - w[:5]).max() < 1e-4 and abs(model.intercept[k] - (w[5] * scale if scale else 0.0)) < 1e-4
    want = {i: "xyz"[k] for i, k in enumerate(np.argmax(x @ model.coef.T + model.intercept, 1))}
    assert {r.row_id: r.predicted for r in model.predict(rows).collect()} == want


def test_short_of_tolerance_is_told(spark):
    _, _, rows = labelled(spark)
    for code, params in (("LSVC", {"max_iter": 1}), ("SGD", {"max_iter": 2}), ("LR", {"max_iter": 1})):
        with pytest.warns(RuntimeWarning, match="tolerance"):
            model = models.get_model({"type": code, "params": params}).fit(rows)
        assert not model.converged


def plain_descent(x, y, order, classes, loss, alpha, l1_share, eta, batch, epochs, shards, weight, average, per_epoch):
    """One step after the other. order: of each shard its rows."""
    slopes = {
        "hinge": lambda z: -1.0 if z < 1 else 0.0, "log_loss": lambda z: -1 / (1 + np.exp(z)), "squared_hinge": lambda z: -2 * max(0.0, 1 - z),
        "modified_huber": lambda z: -4.0 if z < -1 else -2 * max(0.0, 1 - z),
    }
    w, means = np.zeros((classes, x.shape[1] + 1)), []
    for k in range(epochs):
        ends, averages = [], []
        for rows in order:
            now, t, passed = w.copy(), k * per_epoch, []
            for at in range(0, len(rows), batch):
                t += 1
                some, g = rows[at : at + batch], np.zeros_like(w)
                for i in some:
                    wide = np.append(x[i], 1.0)
                    for c in range(classes):
                        sign = 1.0 if y[i] == c else -1.0
                        g[c] += weight[y[i]] * sign * slopes[loss](sign * (now[c] @ wide)) * wide / len(some)
                now[:, :-1] *= 1 - eta(t) * alpha * (1 - l1_share)
                now -= eta(t) * g
                now[:, :-1] = np.sign(now[:, :-1]) * np.maximum(np.abs(now[:, :-1]) - eta(t) * alpha * l1_share, 0)
                passed.append(now.copy())
            ends.append(now)
            averages.append(np.mean(passed, 0))
        n = np.array([len(r) for r in order], float)
        w = np.tensordot(n / n.sum(), np.array(ends), 1)
        means.append(np.tensordot(n / n.sum(), np.array(averages), 1))
    return np.mean(means, 0) if average else w


@pytest.mark.parametrize(
    "params",
    [
        {"loss": "hinge"}, {"loss": "log_loss", "penalty": "l1", "alpha": 0.01}, {"loss": "modified_huber", "penalty": "elasticnet", "l1_ratio": 0.4, "class_weight": {"y": 2.0}},
        {"loss": "squared_hinge", "learning_rate": "invscaling", "eta0": 0.02, "average": True}, {"loss": "log_loss", "learning_rate": "constant", "eta0": 0.05, "penalty": None},
    ],
)
def test_descent_is_plain(spark, params):
    x, y, rows = labelled(spark, n=230)
    model = models.Descent(**params, max_iter=3, tol=None, batch_rows=16, shard_rows=60, random_state=4).fit(rows)
    keys = rows.select("row_id", draw(4, F.col("row_id")).alias("d"), (F.conv(F.substring(draw("shard-4", F.col("row_id")), 1, 8), 16, 10).cast("long") % 4).alias("s")).collect()
    order = [[r.row_id for r in sorted((r for r in keys if r.s == s), key=lambda r: r.d)] for s in range(4)]
    weight = np.array([1.0, 2.0, 1.0]) if "class_weight" in params else np.ones(3)
    share = {"l1": 1.0, "elasticnet": 0.4}.get(params.get("penalty"), 0.0)
    alpha = params.get("alpha", 1e-4)
    rate = linear.Schedule(params.get("learning_rate", "optimal"), alpha, params.get("eta0", 0.01), 0.5, params["loss"])
    want = plain_descent(x, y, order, 3, params["loss"], alpha if params.get("penalty", "l2") else 0.0, share, rate, 16, 3, 4, weight, params.get("average", False), -(-230 // 64))
    assert np.allclose(np.c_[model.coef, model.intercept], want, atol=1e-8)
    assert model.iterations == 3 and model.converged


def test_descent_comes_near_the_minimum(spark):
    """Held-out accuracy as that of the regression, for each loss; and the same whatever the partitions."""
    x, y, rows = labelled(spark, n=1_500, dim=8, spread=1.5)
    train, test = rows.where("row_id % 5 <> 0").cache(), rows.where("row_id % 5 = 0").cache()
    accuracy = lambda m: evaluate.accuracy(evaluate.paired(test, m.predict(test))).first().accuracy
    best = accuracy(models.get_model({"type": "LR"}).fit(train))
    for loss in linear.LOSSES:
        params = {"loss": loss, "alpha": 0.001} | ({"learning_rate": "invscaling", "eta0": 0.01} if loss == "squared_hinge" else {})
        model = models.get_model({"type": "SGD", "params": params}).fit(train)
        assert model.converged and accuracy(model) > best - 0.03
    again = models.get_model({"type": "SGD", "params": params}).fit(train.repartition(3))
    assert np.allclose(again.coef, model.coef)
    slow = models.get_model({"type": "SGD", "params": {"learning_rate": "adaptive", "eta0": 0.05, "shard_rows": 300}}).fit(train)
    assert slow.converged and accuracy(slow) > best - 0.03
    sparse = models.get_model({"type": "SGD", "params": {"penalty": "l1", "alpha": 0.3}}).fit(train)
    assert (sparse.coef == 0).any()


def test_divergence_is_told(spark):
    """Middle of three classes on a line, steps far too long for a loss that grows with the square: no numbers come out, and it says so."""
    rows = spark.createDataFrame([(i, [3.0 * (i % 3), -2.0 * (i % 3)], "xyz"[i % 3]) for i in range(90)], "row_id long, vec array<double>, label string")
    with pytest.raises(ValueError, match="diverged"):
        models.get_model({"type": "SGD", "params": {"loss": "squared_hinge", "learning_rate": "constant", "eta0": 5.0}}).fit(rows)


def test_probabilities_of_descent(spark):
    _, _, rows = labelled(spark, n=150)
    for loss in ("log_loss", "modified_huber"):
        got = models.get_model({"type": "SGD", "params": {"loss": loss}}).fit(rows).scored(rows).collect()
        assert all(abs(sum(r.probas) - 1) < 1e-9 and min(r.probas) >= 0 for r in got)
    for params in ({}, {"loss": "squared_hinge", "learning_rate": "invscaling", "eta0": 0.01}):
        with pytest.raises(models.NoProbabilities):
            models.get_model({"type": "SGD", "params": params}).fit(rows).scored(rows)


def test_blocks_are_packed_whole(spark, monkeypatch):
    x, y, rows = labelled(spark, n=500)
    monkeypatch.setattr(linear, "BLOCK", 64)
    got = linear.packed(rows, ["x", "y", "z"], 3, 1).collect()
    sizes = [(r.shard, len(r.y) // 8) for r in got]
    assert sum(n for _, n in sizes) == 500 and all(n <= 64 for _, n in sizes) and len([n for _, n in sizes if n < 64]) <= 3
    seen = np.concatenate([np.frombuffer(r.x, float).reshape(-1, 5) for r in got])
    assert sorted(map(tuple, seen)) == sorted(map(tuple, x))


@pytest.mark.parametrize("code, params", [("LR", {"penalty": "l3"}), ("LR", {"classweight": "balanced"}), ("LSVC", {"loss": "hinge"}), ("LSVC", {"epsilon": 1}), ("GNB", {"smoothing": 1}), ("SGD", {"loss": "huber"}), ("SGD", {"eta": 1}), ("SGD", {"learning_rate": "constant", "eta0": 0.0})])
def test_unknown_settings_raise(code, params):
    with pytest.raises(ValueError):
        models.get_model({"type": code, "params": params})


def test_settings_count(spark):
    x, y, rows = labelled(spark, n=200, spread=2.0)
    score = lambda code, **p: np.array([r.scores for r in models.get_model({"type": code, "params": p}).fit(rows).scored(rows).orderBy("row_id").collect()])
    assert not np.allclose(score("GNB"), score("GNB", var_smoothing=1.0))
    assert np.allclose(score("GNB", priors=[0.2, 0.3, 0.5]) - score("GNB"), np.log([0.2, 0.3, 0.5]) - np.log(np.bincount(y) / 200), atol=1e-6)
    assert not np.allclose(score("LR"), score("LR", class_weight={"x": 9.0}))
    lasso = models.get_model({"type": "LR", "params": {"penalty": "l1", "C": 0.02, "solver": "saga"}}).fit(rows)
    assert (lasso.coef == 0).any() and not models.get_model({"type": "LR", "params": {"fit_intercept": False}}).fit(rows).intercept.any()


def test_logistic_is_plain(spark):
    """The gradient of the penalised loss vanishes at the coefficients."""
    x, y, rows = labelled(spark, n=300)
    for params in ({}, {"C": 0.1, "class_weight": "balanced"}):
        model = models.get_model({"type": "LR", "params": params | {"tol": 1e-10, "max_iter": 500}}).fit(rows)
        z = x @ model.coef.T + model.intercept
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        n = np.bincount(y)
        weight = (300 / (3 * n) if "class_weight" in params else np.ones(3))[y][:, None]
        g = (weight * (p - np.eye(3)[y])).T @ x + model.coef / params.get("C", 1.0)
        assert np.abs(g).max() < 0.02 and abs((weight * (p - np.eye(3)[y])).sum(0)).max() < 0.02
