"""Blocked sparse matrices against numpy."""

import numpy as np
import pytest

from quillpool.operators import matrix
from quillpool.operators.matrix import BlockMatrix


def entries(spark, dense, left, right):
    at = [(f"{left}{i}", f"{right}{j}", float(dense[i, j])) for i, j in zip(*np.nonzero(dense))]
    return spark.createDataFrame(at + at[:1], "row string, column string, value double")  # entries of one place are added


def as_dense(m, left, right, shape):
    out = np.zeros(shape)
    for r in m.entries().collect():
        out[int(r.row[len(left) :]), int(r.column[len(right) :])] += r.value
    return out


def test_products_transposes_and_norms(spark):
    rng = np.random.default_rng(1)
    a, b = (rng.integers(-2, 4, shape) * (rng.random(shape) < 0.2) for shape in ((70, 90), (90, 8)))
    a[3], b[:, 2] = 0, 0
    a[:2, 5], b[5, :2] = (1, -1), 0  # what cancels is left out
    ea, eb = entries(spark, a, "r", "k"), entries(spark, b, "k", "c")
    a[tuple(np.argwhere(a)[0])] *= 2
    b[tuple(np.argwhere(b)[0])] *= 2
    keys = spark.createDataFrame([(f"k{i}",) for i in range(90)], "key string")
    inner = matrix.indexed(keys, 16)
    assert inner.groupBy("block").count().count() == 6
    A, B = BlockMatrix.of(ea, columns=inner, size=16), BlockMatrix.of(eb, rows=inner, size=16)
    assert A.blocks.count() > 6
    assert (as_dense(A, "r", "k", a.shape) == a).all() and (as_dense(A.transposed(), "k", "r", a.T.shape) == a.T).all()
    C = A.product(B)
    assert np.allclose(as_dense(C, "r", "c", (70, 8)), a @ b) and C.entries().where("value = 0").isEmpty()
    assert np.allclose(as_dense(B.transposed().product(A.transposed()), "c", "r", (8, 70)), (a @ b).T)
    for kind, want in (("l1", np.abs(a).sum(1)), ("l2", np.sqrt((a * a).sum(1)))):
        got = {r.row: r.norm for r in A.norms(kind).collect()}
        assert all(abs(got[f"r{i}"] - w) < 1e-9 for i, w in enumerate(want) if w)
    with pytest.raises(ValueError):
        A.norms("l3")
    assert BlockMatrix.of(ea.limit(0)).entries().count() == 0


@pytest.mark.parametrize("at_once", [1, 7, 1 << 20])
def test_blocks_multiply_in_steps(at_once):
    rng = np.random.default_rng(2)
    a, b = (rng.integers(-3, 4, s) * (rng.random(s) < 0.4) for s in ((9, 11), (11, 5)))
    pack = lambda d: matrix.compressed(*np.nonzero(d), d[np.nonzero(d)].astype(float), *d.shape)
    s, c, v = matrix.multiplied(pack(a), pack(b), 5, at_once)
    out = np.zeros((9, 5))
    out[matrix.rows_of(s), c] = v
    assert np.allclose(out, a @ b)
