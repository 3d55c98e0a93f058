"""Every query of the catalog against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from quillpool.plans.catalog import ORACLE_SQL, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def cells(frame):
    out = []
    for row in frame[sorted(frame.columns)].itertuples(index=False, name=None):
        out.append(tuple("null" if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("NaT", "<NA>") else f"{v:.6f}" if isinstance(v, float) else str(v) for v in row))
    return sorted(out)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        path = f"{DATA}/{name}"
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert cells(got) == cells(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_vectorizer_over_all_texts(spark):
    from collections import Counter, defaultdict

    from quillpool.operators.vectorizer import class_counted
    from quillpool.plans.catalog import docs

    # brute force from each row's own terms: single words do not run across texts
    of = defaultdict(Counter)
    rows = docs(spark, DATA)
    for r in class_counted(rows.select("row_id", "text", rows.row_id.cast("string").alias("label")), 1, 1).join(rows.selectExpr("cast(row_id as string) as label", "label as lang"), "label").collect():
        of[r.lang][r.term] += r.tf
    counts = {(label, term): n for label, c in of.items() for term, n in c.items()}
    df, n = Counter(term for _, term in counts), len(of)
    assert {(r.label, r.term): r.tf for r in QUERIES["term_document"](spark, DATA).collect()} == counts
    for name, f in {"unsmoothed": lambda d: math.log(n / d) + 1, "shifted": lambda d: math.log(n / d), "smooth": lambda d: math.log((1 + n) / (1 + d)) + 1}.items():
        got = {r.term: (r.df, r.idf) for r in QUERIES[f"idf_{name}"](spark, DATA).collect()}
        assert {t: d for t, (d, _) in got.items()} == df and all(abs(v - f(d)) < 1e-6 for d, v in got.values())
    raw = {(r.label, r.term): r.weight for r in QUERIES["tf_raw"](spark, DATA).collect()}
    assert set(counts) <= set(raw) and len(raw) > len(counts)  # pairs of words as well
    for name in ("tf_binary", "tf_sublinear", "tfidf_l1", "tfidf_l2"):
        assert {(r.label, r.term) for r in QUERIES[name](spark, DATA).select("label", "term").collect()} == set(raw)


def test_entry(spark):
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() == 1


def test_models_are_plain(spark):
    """Queries without SQL, over the whole table, against numpy."""
    import numpy as np

    from quillpool.operators.coldstart import medoids

    from .test_exact import plain_squared_hinge

    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").orderBy("vec_id").collect()
    x, ids, y = np.array([r.embedding for r in rows], float), [r.vec_id for r in rows], np.array([str(r.label) for r in rows])
    assert [r.row_id for r in QUERIES["cold_kmedoids"](spark, DATA).orderBy("rank").collect()] == [ids[i] for i in medoids(x, 10)]
    labels, wider = sorted(set(y)), np.c_[x, np.ones(len(x))]
    w = np.array([plain_squared_hinge(wider, np.where(y == v, 1.0, -1.0), 1.0, np.ones(len(x))) for v in labels])

    def share(name, z, gap):
        """Of rows whose two best scores differ by more, the share predicted as by scores z."""
        ordered, got = np.sort(z, 1), {r.row_id: r.predicted for r in QUERIES[name](spark, DATA).collect()}
        sure = ordered[:, -1] - ordered[:, -2] > gap
        assert sure.mean() > 0.5
        return np.mean([got[i] == labels[k] for i, k, s in zip(ids, np.argmax(z, 1), sure) if s])

    assert share("lsvc_predict", wider @ w.T, 1e-3) == 1.0
    beta, goal = np.zeros((len(labels), wider.shape[1])), (y[:, None] == np.array(labels)).astype(float)
    step = 1 / (0.5 * np.linalg.norm(wider, 2) ** 2 + 1)
    for _ in range(20_000):  # plain descent of the summed multinomial loss; the intercept is free
        p = np.exp(wider @ beta.T)
        slope = (p / p.sum(1, keepdims=True) - goal).T @ wider
        slope[:, :-1] += beta[:, :-1]
        beta -= step * slope
    assert share("lr_predict", wider @ beta.T, 0.02) > 0.99
    for name in ("sgd_predict", "sgd_log_predict"):
        got = {r.row_id: r.predicted for r in QUERIES[name](spark, DATA).collect()}
        assert np.mean([got[i] == v for i, v in zip(ids, y)]) > 0.2  # of ten labels that vectors hardly tell apart
