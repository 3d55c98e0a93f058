"""Exact quantiles against numpy, by one sort of small groups and by rounds of large ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillpool.operators.quantiles import quantiles
from quillpool.plans import curves

SHARES = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


@pytest.mark.parametrize("few", [50_000, 20])
def test_quantiles_are_exact(spark, few):
    rng = np.random.default_rng(3)
    groups = {
        "spread": rng.normal(size=4_000), "wide": np.r_[rng.normal(size=500) * 1e-9, [1e300, -1e300, 1e10]], "ties": np.r_[np.full(3_000, 7.0), rng.integers(0, 4, 100)],
        "one": np.array([3.5]), "two": np.array([1.0, 2.0]), "edges": np.r_[np.full(900, 1.0), np.full(901, 2.0), rng.random(60) + 1], None: rng.random(300),
    }
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("none", None), ("one", None), ("two", float("nan")), ("nan", float("nan"))]
    df = spark.createDataFrame(rows, "g string, x double").repartition(4)
    got = {r.g: r for r in quantiles(df, "x", SHARES, ["g"], few).collect()}
    assert got.keys() == {*groups, "none", "nan"}
    for g, vs in groups.items():
        assert got[g].n == len(vs) and (got[g].low, got[g].high) == (vs.min(), vs.max())
        assert np.allclose(got[g].q, np.quantile(vs, SHARES), rtol=1e-9, atol=0 if g == "wide" else 1e-12)
    assert got["none"].n == got["nan"].n == 0 and got["none"].q is None
    assert quantiles(df.limit(0), "x", SHARES, ["g"], few).count() == 0


def test_a_group_of_five_million(spark):
    """One group that no task holds: its quartiles, and the passes' state, are those of a small one."""
    n = 5_000_000
    rows = spark.range(n, numPartitions=4).select(F.lit(1).alias("generation"), F.pmod(F.col("id") * 7_919, F.lit(n)).cast("double").alias("x"))
    r = curves.boxplot(rows, "x", few=2_000).first()
    assert (r.n, r.low, r.q1, r.median, r.q3, r.high) == (n, 0.0, *[s * (n - 1) for s in (0.25, 0.5, 0.75)], n - 1.0)
    d = curves.described(rows.limit(1_000), "x", few=100).first()
    assert d.n == 1_000 and d.low <= d.q1 <= d.median <= d.q3 <= d.high
