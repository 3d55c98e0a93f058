"""Linear classifiers on feature vectors, one against the rest, trained by passes over packed rows.

Training rows are dealt once to shards by a hash of their id, ordered by a seeded draw, and packed as blocks of numbers; a
pass broadcasts the coefficients (classes x dimensions) and adds up an array of fixed size. So results do not depend on
partitioning, and neither rows nor anything that grows with them comes to the driver.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.draws import draw
from ..session import cut

BLOCK = 4_096  # rows a block; a multiple of every batch size


def packed(rows: DataFrame, labels: list, shards: int = 1, seed=0) -> DataFrame:
    """(shard, x, y): blocks of a shard's rows (row_id, vec, label) in seeded order, as float64 and the labels' places as int64."""
    place = F.array_position(F.array(*[F.lit(v) for v in labels]), F.col("label")) - 1
    shard = (F.conv(F.substring(draw(f"shard-{seed}", F.col("row_id")), 1, 8), 16, 10).cast("long") % shards).cast("int")
    ready = rows.select(shard.alias("shard"), draw(seed, F.col("row_id")).alias("d"), "row_id", F.col("vec").cast("array<double>").alias("vec"), place.alias("y")).where("y >= 0")
    ready = ready.repartition(max(shards, 1), "shard").sortWithinPartitions("shard", "d", "row_id").select("shard", "vec", "y")

    def run(frames):
        held, of = [], None

        def blocks(least: int):
            """Blocks of what is held, whole ones, and at the end (least 1) the last one."""
            nonlocal held
            while sum(len(f) for f in held) >= least:
                some = pd.concat(held)
                held = [some.iloc[BLOCK:]]
                some = some.iloc[:BLOCK]
                yield pd.DataFrame({"shard": [of], "x": [np.stack(some["vec"].to_numpy()).astype(float).tobytes()], "y": [some["y"].to_numpy(np.int64).tobytes()]})

        for frame in frames:
            for s, part in frame.groupby("shard", sort=False):
                if s != of:
                    yield from blocks(1)
                    of = s
                held.append(part)
                yield from blocks(BLOCK)
        yield from blocks(1)

    return cut(ready.mapInPandas(run, "shard int, x binary, y binary"))


def unpacked(frame: pd.DataFrame):
    """(shard, rows as a matrix, labels' places) of each block."""
    for shard, x, y in frame[["shard", "x", "y"]].itertuples(index=False):
        y = np.frombuffer(y, np.int64)
        yield shard, np.frombuffer(x, float).reshape(len(y), -1), y


def summed(blocks: DataFrame, each: Callable, state) -> np.ndarray:
    """The sum, over all blocks, of each(state, x, y), an array of one size."""
    sent = blocks.sparkSession.sparkContext.broadcast(state)

    def run(frames):
        total = None
        for frame in frames:
            for _, x, y in unpacked(frame):
                some = each(sent.value, x, y)
                total = some if total is None else total + some
        if total is not None:
            yield pd.DataFrame({"sums": [total.reshape(-1)]})

    out = total_of(blocks.mapInPandas(run, "sums array<double>"))
    sent.unpersist()
    return out


def total_of(partial: DataFrame, fan_in: int = 64) -> np.ndarray:
    """The sum of arrays (sums), a row a task: added up by tasks of their own until a few are left."""

    def add(frames):
        total = None
        for frame in frames:
            for row in frame["sums"]:
                total = np.array(row, float) if total is None else total + row
        if total is not None:
            yield pd.DataFrame({"sums": [total]})

    tasks = partial.rdd.getNumPartitions()
    while tasks > fan_in:
        tasks = -(-tasks // fan_in)
        partial = partial.repartition(tasks).mapInPandas(add, "sums array<double>")
    return np.sum([np.array(r.sums) for r in partial.collect()], axis=0)  # at most fan_in rows


def class_weights(counts: np.ndarray, labels: list, wanted) -> np.ndarray:
    """A weight for each label: 1, by a dictionary, or "balanced": against its number of rows."""
    if wanted is None:
        return np.ones(len(labels))
    if wanted == "balanced":
        return counts.sum() / (len(labels) * np.maximum(counts, 1))
    if isinstance(wanted, dict):
        if unknown := set(wanted) - set(labels):
            raise ValueError(f"class_weight names labels that no row has: {sorted(map(str, unknown))}")
        return np.array([float(wanted.get(v, 1.0)) for v in labels])
    raise ValueError("class_weight is None, 'balanced' or a dictionary")


def not_met(what: str, iterations: int) -> None:
    warnings.warn(f"{what} did not reach its tolerance in {iterations} iterations", RuntimeWarning, stacklevel=3)


# --- squared hinge, by Newton steps


def _margins(w: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """1 where a row is of the class, -1 elsewhere; and how far inside the margin it is, 0 outside of it."""
    sign = np.where(np.arange(len(w)) == y[:, None], 1.0, -1.0)
    return sign, np.maximum(0, 1 - sign * (x @ w.T))


def _slope(state, x, y):
    """Loss and gradient of each class."""
    w, weight, scale = state
    x = _wider(x, scale)
    sign, short = _margins(w, x, y)
    c = weight[y][:, None]
    return np.concatenate([(c * short * short).sum(0)[:, None], -2 * (c * sign * short).T @ x], 1)


def _curved(state, x, y):
    """The Hessian of the loss times a vector of each class."""
    w, weight, scale, v = state
    x = _wider(x, scale)
    _, short = _margins(w, x, y)
    return 2 * ((short > 0) * weight[y][:, None] * (x @ v.T)).T @ x


def _along(state, x, y):
    """The loss of each class after each of some shares of a step."""
    w, weight, scale, step, sizes = state
    x = _wider(x, scale)
    sign = np.where(np.arange(len(w)) == y[:, None], 1.0, -1.0)
    at, by, c = sign * (x @ w.T), sign * (x @ step.T), weight[y][:, None]
    return np.stack([(c * np.maximum(0, 1 - at - s * by) ** 2).sum(0) for s in sizes])


def _wider(x: np.ndarray, scale: float) -> np.ndarray:
    return np.concatenate([x, np.full((len(x), 1), scale)], 1) if scale else x


SIZES = 0.5 ** np.arange(12)


def squared_hinge(blocks: DataFrame, classes: int, dimensions: int, weight: np.ndarray, C: float = 1.0, scale: float = 1.0, tol: float = 1e-4, max_iter: int = 1000) -> tuple[np.ndarray, int, bool]:
    """(coefficients, steps, whether the tolerance was met) of  |w|^2 / 2 + C sum max(0, 1 - y w x)^2  for each class.

    scale: the value of one more component, whose coefficient is the intercept; 0 for none. The objective curves by at least
    1 everywhere, so the coefficients are off by at most the gradient's length, which `tol` bounds. Steps are found by
    conjugate gradients on products of the Hessian with a vector, a pass each.
    """
    w, step = np.zeros((classes, dimensions + bool(scale))), 0
    while True:
        found = summed(blocks, _slope, (w, weight, scale)).reshape(classes, -1)
        loss, grad = C * found[:, 0] + (w * w).sum(1) / 2, w + C * found[:, 1:]
        lengths = np.sqrt((grad * grad).sum(1))
        open_ = lengths > tol
        if not open_.any() or step == max_iter:
            return w, step, not open_.any()
        move, rest = np.zeros_like(w), -grad * open_[:, None]
        towards, size = rest.copy(), (rest * rest).sum(1)
        goal = (np.minimum(0.1, np.sqrt(lengths)) * lengths) ** 2  # closer as the gradient falls
        for _ in range(10 * w.shape[1]):
            busy = open_ & (size > goal) & (size > (tol / 10) ** 2)
            if not busy.any():
                break
            curved = towards + C * summed(blocks, _curved, (w, weight, scale, towards * busy[:, None])).reshape(classes, -1)
            share = np.where(busy, size / np.maximum((towards * curved).sum(1), 1e-300), 0.0)
            move += share[:, None] * towards
            rest = rest - share[:, None] * curved * busy[:, None]
            now = (rest * rest).sum(1)
            towards = np.where(busy[:, None], rest + (now / np.maximum(size, 1e-300))[:, None] * towards, towards)
            size = np.where(busy, now, size)
        after = C * summed(blocks, _along, (w, weight, scale, move, SIZES)).reshape(len(SIZES), classes)
        after += (((w + SIZES[:, None, None] * move) ** 2).sum(2)) / 2
        fits = after <= loss + 1e-4 * SIZES[:, None] * (grad * move).sum(1)
        share = np.where(open_ & fits.any(0), SIZES[fits.argmax(0)], 0.0)
        if not share.any():  # as near as numbers of this length come
            return w, step, False
        w, step = w + share[:, None] * move, step + 1


# --- stochastic descent


def _losses(loss: str) -> tuple[Callable, Callable]:
    """The loss of a signed margin, and its slope."""
    if loss == "hinge":
        return lambda z: np.maximum(0, 1 - z), lambda z: np.where(z < 1, -1.0, 0.0)
    if loss == "log_loss":
        return lambda z: np.logaddexp(0, -z), lambda z: -1 / (1 + np.exp(np.clip(z, -500, 500)))
    if loss == "squared_hinge":
        return lambda z: np.maximum(0, 1 - z) ** 2, lambda z: -2 * np.maximum(0, 1 - z)
    if loss == "modified_huber":
        return lambda z: np.where(z >= -1, np.maximum(0, 1 - z) ** 2, -4 * z), lambda z: np.where(z >= -1, -2 * np.maximum(0, 1 - z), -4.0)
    raise ValueError(f"unknown loss {loss!r}; known: hinge, log_loss, modified_huber, squared_hinge")


FAR = 1e6  # times the loss of no coefficients at all: nothing is learnt any more
LOSSES = ("hinge", "log_loss", "modified_huber", "squared_hinge")


class Schedule:
    """The length of the t-th step (from 1); adaptive ones are divided by 5 by the caller."""

    def __init__(self, kind: str, alpha: float, eta0: float, power_t: float, loss: str):
        self.kind, self.alpha, self.eta0, self.power_t = kind, alpha, eta0, power_t
        if kind not in ("optimal", "constant", "invscaling", "adaptive"):
            raise ValueError(f"unknown learning_rate {kind!r}; known: adaptive, constant, invscaling, optimal")
        if kind != "optimal" and not eta0 > 0:
            raise ValueError(f"learning_rate {kind!r} needs eta0 > 0")
        usual = np.sqrt(1 / np.sqrt(alpha)) if alpha else 1.0  # the length that coefficients are expected to have
        slope = abs(float(_losses(loss)[1](np.array(-usual))))
        self.first = 1 / (usual / max(1.0, slope) * alpha) if alpha else 0.0
        if kind == "optimal" and not alpha > 0:
            raise ValueError("learning_rate 'optimal' needs alpha > 0")

    def __call__(self, t: int) -> float:
        if self.kind == "optimal":
            return 1 / (self.alpha * (self.first + t - 1))
        return self.eta0 / t**self.power_t if self.kind == "invscaling" else self.eta0


def epoch(w: np.ndarray, blocks, weight: np.ndarray, loss: str, rate: Schedule, t: int, alpha: float, l1_share: float, batch: int, intercept: bool):
    """(w, mean of w over the steps, steps, rows, each class's summed loss) after one shard's batches, in order; w: classes x (dimensions + 1)."""
    value, slope = _losses(loss)
    with np.errstate(over="ignore", invalid="ignore"):  # the caller looks at what comes out
        return _stepped(w, blocks, weight, value, slope, rate, t, alpha, l1_share, batch, intercept)


def _stepped(w, blocks, weight, value, slope, rate, t, alpha, l1_share, batch, intercept):
    w, mean, steps, rows, total = w.copy(), np.zeros_like(w), 0, 0, np.zeros(len(w))
    for x, y in blocks:
        for at in range(0, len(x), batch):
            some, of = x[at : at + batch], y[at : at + batch]
            sign = np.where(np.arange(len(w)) == of[:, None], 1.0, -1.0)
            z = sign * (some @ w[:, :-1].T + w[:, -1])
            c = weight[of][:, None]
            total += (c * value(z)).sum(0)
            g = c * sign * slope(z) / len(some)
            eta = rate(t + steps + 1)
            w[:, :-1] *= max(0.0, 1 - eta * alpha * (1 - l1_share))
            w[:, :-1] -= eta * g.T @ some
            if intercept:
                w[:, -1] -= eta * g.sum(0)
            if l1_share:
                w[:, :-1] = np.sign(w[:, :-1]) * np.maximum(np.abs(w[:, :-1]) - eta * alpha * l1_share, 0)
            steps, rows = steps + 1, rows + len(some)
            mean += (w - mean) / steps
    return w, mean, steps, rows, total


def descend(
    blocks: DataFrame, classes: int, dimensions: int, weight: np.ndarray, loss: str = "hinge", alpha: float = 1e-4, l1_share: float = 0.0, rate: Schedule | None = None, batch: int = 32,
    per_epoch: int = 1, intercept: bool = True, average: bool = False, tol: float | None = 1e-3, patience: int = 5, max_iter: int = 1000,
) -> tuple[np.ndarray, int, bool]:
    """(coefficients with the intercept last, epochs, whether the loss came to rest).

    In an epoch every shard descends by itself from the same coefficients; the next ones are the shards' mean, weighted by
    their rows. It ends where no class's mean loss of an epoch has fallen by `tol` for `patience` epochs on end (an adaptive
    rate is divided by 5 first, down to a millionth). per_epoch: by how many steps an epoch moves the schedule on. average: the
    result is the mean over all steps.
    """
    rate = rate or Schedule("optimal", alpha, 0.0, 0.5, loss)
    w, mean, seen, best, waited, divided = np.zeros((classes, dimensions + 1)), np.zeros((classes, dimensions + 1)), 0, np.full(classes, np.inf), 0, 1.0

    for k in range(max_iter):
        sent = blocks.sparkSession.sparkContext.broadcast((w, k, divided))

        def run(frames):
            start, k, divided = sent.value
            slower = lambda t: rate(t) / divided
            state: dict = {}
            out = np.zeros(2 * start.size + 1 + classes)
            for frame in frames:
                for shard, x, y in unpacked(frame):
                    # a shard's blocks follow one another, so only one shard's coefficients are held
                    if shard not in state:
                        _close(state, out)
                        state[shard] = [start, np.zeros_like(start), 0, 0, np.zeros(classes)]
                    now, average, steps, rows, total = state[shard]
                    now, m, s, n, more = epoch(now, [(x, y)], weight, loss, slower, k * per_epoch + steps, alpha, l1_share, batch, intercept)
                    state[shard] = [now, (average * steps + m * s) / (steps + s), steps + s, rows + n, total + more]
            _close(state, out)
            yield pd.DataFrame({"sums": [out]})

        out = total_of(blocks.mapInPandas(run, "sums array<double>"))
        sent.unpersist()
        size = w.size
        rows, now = max(out[2 * size], 1.0), out[2 * size + 1 :]
        w, stepped, now = (out[:size] / rows).reshape(w.shape), (out[size : 2 * size] / rows).reshape(w.shape), now / rows
        if not np.isfinite(w).all() or now.max() > FAR * float(_losses(loss)[0](np.array(0.0))) * max(1.0, weight.max()):
            raise ValueError("descent diverged: scale the vectors, or choose a shorter step, a greater alpha or another loss")
        mean, seen = (mean * seen + stepped) / (seen + 1), seen + 1
        waited = waited + 1 if tol is not None and (now > best - tol).all() else 0
        best = np.minimum(best, now)
        if waited >= patience:
            if rate.kind == "adaptive" and rate.eta0 / divided > 1e-6:
                divided, waited = divided * 5, 0
                continue
            return (mean if average else w), k + 1, True
    return (mean if average else w), max_iter, tol is None


def _close(state: dict, out: np.ndarray) -> None:
    for w, mean, _, rows, total in state.values():
        out[: w.size] += rows * w.reshape(-1)
        out[w.size : 2 * w.size] += rows * mean.reshape(-1)
        out[2 * w.size] += rows
        out[2 * w.size + 1 :] += total
    state.clear()
