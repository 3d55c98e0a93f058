"""Every query of the engine, each beside SQL that says the same where SQL can.

Queries run over whole tables. `text -> lang` of documents stands for labelled texts, embeddings for feature vectors,
events for metric curves and for the runs of logs, which are appended to a log and read from it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.draws import draw
from ..operators import cache, coldstart, evaluate, matrix, models, pool, prepare, select
from ..operators.vectorizer import ProductVectorizer, class_counted, class_weights, counted, document_frequency, idf, row_terms
from ..session import cut, shared_dir, spread, table
from ..sources import commitlog, tables, workbooks
from . import config, curves, genetic, history, learner, oracle
from . import sqltext as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), "text", F.col("lang").alias("label")))


def start(spark: SparkSession, d: str) -> DataFrame:
    """Ten texts of each class."""
    return coldstart.per_class(docs(spark, d), 10)


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "embeddings")).select(F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("vec"), F.col("label").cast("string").alias("label"))


def profile(spark: SparkSession, d: str, **settings):
    settings = {"method": "binary", "ngram_range": (1, 2), "query": "binary"} | settings
    return ProductVectorizer(**settings).fit(start(spark, d))


PV = S.with_(S.DOCS, S.L0, S.model("m", "l0", "docs"))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# --- sources and sinks


@query("SELECT l_returnflag, l_linestatus, count(*) AS n_rows, round(sum(l_quantity), 2) AS sum_qty FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def src_parquet(spark, d):
    rows = tables.read_labeled(spark, f"{d}/lineitem.parquet", "l_returnflag", "l_linestatus")
    return rows.where("l_shipdate <= timestamp'1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n_rows"), F.round(F.sum("l_quantity"), 2).alias("sum_qty"))


@query("SELECT p_type AS label, count(*) AS n_rows, count(DISTINCT p_name) AS n_names, sum(p_size)::BIGINT AS sum_size FROM part GROUP BY ALL")
def src_csv(spark, d):
    path = f"{shared_dir(spark)}/items-{uuid.uuid4().hex}.csv"
    table(spark, d, "part").select("p_name", "p_type", "p_size").write.option("header", True).csv(path)
    rows = tables.read_labeled(spark, path, "p_name", "p_type", "p_name STRING, p_type STRING, p_size INT")
    return rows.groupBy(F.col("p_type").alias("label")).agg(F.count("*").alias("n_rows"), F.count_distinct("p_name").alias("n_names"), F.sum("p_size").alias("sum_size"))


@query("SELECT p_brand AS label, count(*) AS n_rows, count(DISTINCT p_name) AS n_names, sum(p_size)::BIGINT AS sum_size, round(sum(p_retailprice), 2) AS sum_price FROM part GROUP BY ALL")
def src_excel(spark, d):
    path = f"{shared_dir(spark)}/items-{uuid.uuid4().hex}.xlsx"
    workbooks.write_workbooks(table(spark, d, "part").select("p_name", "p_brand", "p_size", "p_retailprice").repartition(4), path)
    rows = tables.read_labeled(spark, path, "p_name", "p_brand")
    return rows.groupBy(F.col("p_brand").alias("label")).agg(F.count("*").alias("n_rows"), F.count_distinct("p_name").alias("n_names"), F.sum("p_size").alias("sum_size"), F.round(F.sum("p_retailprice"), 2).alias("sum_price"))


def event_runs(spark, d) -> DataFrame:
    """(day, user_id, value): a user's day of events as a run record, its events but errors as iterations; some lines are cut off."""
    e = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), "ts", "event_id", "event_type", "value")
    error, u = F.col("event_type") == "error", F.col("user_id")
    steps = F.array_sort(F.collect_list(F.when(~error, F.struct("ts", "event_id", "event_type", "value"))))  # of one user and day
    g = e.groupBy("user_id", "day").agg(F.count_if(error).alias("errors"), F.max("value").alias("most"), F.min("value").alias("least"), steps.alias("steps"))
    i, one = (lambda n: (n + 1).cast("int")), F.lit("COMPLETED_ITERATION")
    history_data = F.transform("steps", lambda x, n: F.struct(
        i(n).alias("iteration"), (10 * i(n)).alias("L_size"), (x["value"] / 1000).alias("internal_acc"), (x["value"] / 500).alias("external_acc"),
        F.when(x["event_type"] != "signup", x["value"] / 600).alias("external_f1"), x["value"].alias("iteration_duration_sec"), (x["value"] / 2).alias("train_duration_sec"),
        (x["value"] / 4).alias("query_duration_sec"), (x["value"] / 8).alias("update_duration_sec"), (1000 - 10 * i(n)).alias("U_size"), one.alias("status"),
        F.when(x["event_type"] == "click", F.lit("late")).alias("error"),
    ))
    pick = lambda *of: F.element_at(F.array(*[F.lit(x) for x in of]), (u % len(of) + 1).cast("int"))
    named = lambda kind, params=None: F.struct(kind.alias("type"), *([params.alias("params")] if params is not None else []))
    strategy = F.create_map(F.lit("batch_size"), pick("many", "10", "20"), F.lit("entropy_fraction"), pick("0.25", "0.5"))
    config_ = F.struct(
        F.struct((u % 5).cast("double").alias("min_samples_per_class"), F.lit(0.5).alias("population_size")).alias("data_params"),
        F.struct(
            named(pick(None, "RND", "KM")).alias("cold_start_config"),
            named(pick("PVBin", None, "GNB"), F.when(u % 2 == 0, F.create_map(F.lit("method"), F.lit("binary")))).alias("classifier_config"), named(F.lit("ENT"), strategy).alias("query_strategy_config"),
        ).alias("al_params"),
        F.struct((42 + u % 2).cast("double").alias("random_seed")).alias("general_params"),
    )
    stamp = F.when(u % 10 == 9, F.lit("soon")).otherwise(F.date_format(F.date_trunc("week", F.col("day").cast("timestamp")), "yyyy-MM-dd HH:mm:ss"))
    line = F.to_json(F.struct(
        F.concat(F.lit("user-"), u).alias("experiment_name"), stamp.alias("execution_timestamp"), F.when(F.col("errors") >= 2, "FAILED").otherwise("COMPLETED").alias("status"), config_.alias("config"),
        F.struct((F.col("most") / 500).alias("baseline_acc"), (F.col("least") / 500).alias("baseline_f1")).alias("baseline_metrics"), history_data.alias("history_data"),
        F.col("most").alias("total_duration_sec"), F.when(u % 2 == 1, F.col("most") + 1).alias("manager_wall_time_sec"),
    ))
    return g.select("day", "user_id", F.when((u * 31 + F.dayofyear("day")) % 41 == 0, F.substring(line, 1, 40)).otherwise(line).alias("value"))


def run_log(spark, d) -> DataFrame:
    """The runs in two appends to a log, those of each month's first half and the rest; a snapshot lies between."""
    log, lines = commitlog.CommitLog(spark, f"{shared_dir(spark)}/runs-{uuid.uuid4().hex}"), cut(event_runs(spark, d))
    early = F.dayofmonth("day") <= 15
    log.append(lines.where(early).orderBy("day", "user_id"))
    log.snapshot()
    log.append(lines.where(~early).orderBy("day", "user_id"))
    return tables.parse_log(log.read())


RUNS = """ev AS (SELECT user_id AS u, ts::DATE AS day, count(*) FILTER (event_type = 'error') AS errors, max(value) AS most, min(value) AS least,
  coalesce(list({'t': event_type, 'v': value} ORDER BY ts, event_id) FILTER (event_type <> 'error'), []) AS steps FROM events GROUP BY ALL),
line AS (SELECT *, CASE WHEN day(day) <= 15 THEN 1 ELSE 2 END AS number, row_number() OVER (ORDER BY day(day) > 15, day, u) AS place, (u * 31 + dayofyear(day)) % 41 = 0 AS corrupt FROM ev),
runs AS (SELECT *, 'user-' || u AS experiment_name, CASE WHEN u % 10 = 9 THEN 'soon' ELSE strftime(date_trunc('week', day), '%Y-%m-%d %H:%M:%S') END AS execution_timestamp,
  CASE WHEN errors >= 2 THEN 'FAILED' ELSE 'COMPLETED' END AS status FROM line WHERE NOT corrupt)"""


@query(f"WITH {RUNS} SELECT l.number::BIGINT AS number, experiment_name, status, CASE WHEN corrupt THEN -1 ELSE len(l.steps) END::INT AS n_iterations, corrupt FROM line l LEFT JOIN runs USING (u, day, corrupt)")
def log_scan(spark, d):
    return run_log(spark, d).select("number", "experiment_name", "status", F.coalesce(F.size("history_data"), F.lit(-1)).alias("n_iterations"), F.col("_corrupt_record").isNotNull().alias("corrupt"))


@query("SELECT event_type AS experiment_name, 'COMPLETED' AS status, count(*)::INT AS l_size FROM events GROUP BY event_type")
def log_append(spark, d):
    manager = history.HistoryManager(spark, f"{shared_dir(spark)}/log-{uuid.uuid4().hex}")
    for r in table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy("event_type").collect():
        manager.record({"experiment_name": r.event_type, "status": "COMPLETED", "execution_timestamp": "2024-01-31 00:00:00", "history_data": [{"iteration": 1, "L_size": r.n, "external_acc": float("nan")}]})
    return manager.log().select("experiment_name", "status", F.col("history_data")[0]["L_size"].alias("l_size"))


@query("SELECT ts::DATE::VARCHAR AS day, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def hist_csv_sink(spark, d):
    path = f"{shared_dir(spark)}/history-{uuid.uuid4().hex}"
    days = table(spark, d, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    tables.append_csv(days.where("event_type = 'click'"), path)
    tables.append_csv(days.where("event_type <> 'click'"), path)
    return tables.read_csv(spark, path, "day DATE, event_type STRING, n BIGINT, mean DOUBLE").withColumn("day", F.col("day").cast("string"))


def _row_sums_sql(name: str, *columns: str) -> str:
    h = f"md5(concat_ws(chr(31), {', '.join(f'coalesce({c}::VARCHAR, chr(1))' for c in sorted(columns))}))"
    part = lambda at: f"sum(('0x' || substr({h}, {at}, 15))::BIGINT)::VARCHAR"
    return f"{name} AS (SELECT lang, source, count(*) AS n, {part(1)} AS {name}_a, {part(17)} AS {name}_b FROM documents GROUP BY ALL)"


@query(f"WITH {_row_sums_sql('t', 'lang', 'source', 'text')}, {_row_sums_sql('f', 'doc_id', 'lang', 'source', 'text')} SELECT t.lang, t.source, t.n, t_a, t_b, f_a, f_b FROM t JOIN f USING (lang, source)")
def cache_fingerprint(spark, d):
    rows = table(spark, d, "documents")  # what a cache's keys are made of, of each language and source
    text = lambda c: F.col(c).cast("string")
    t = cache.row_sums(rows.select("lang", "source", "text"), "lang", "source").select("lang", "source", "n", text("a").alias("t_a"), text("b").alias("t_b"))
    f = cache.row_sums(rows.select("doc_id", "lang", "source", "text"), "lang", "source").select("lang", "source", text("a").alias("f_a"), text("b").alias("f_b"))
    return t.join(f, ["lang", "source"])


@query(
    "SELECT 'some' AS asked, count(*) AS n_rows, count(DISTINCT coalesce('=' || text, '0')) AS n_made FROM documents WHERE lang = 'en' "
    "UNION ALL SELECT 'all', count(*), count(DISTINCT coalesce('=' || text, '0')) - (SELECT count(DISTINCT coalesce('=' || text, '0')) FROM documents WHERE lang = 'en') FROM documents UNION ALL SELECT 'again', count(*), 0 FROM documents"
)
def cache_rows(spark, d):
    """Documents of one language, then all, then all again, by a cache that embeds each text once; lengths stand for a model."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), "text", "lang")
    store = cache.RowCache(spark, f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}")
    length, out = F.length("text").cast("double"), []
    make = lambda some: some.select("row_id", F.array(F.coalesce(length, F.lit(0.0)), F.coalesce(F.octet_length("text").cast("double"), F.lit(0.0))).alias("vec"))
    for name, some in (("some", rows.where("lang = 'en'")), ("all", rows), ("again", rows)):
        out.append((name, store.vectors(some, "lengths", make).count(), store.made))
    return spark.createDataFrame(out, "asked string, n_rows long, n_made long")


# --- preparation


@query("SELECT doc_id, quality FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL AND quality IS NOT NULL")
def clean_dropna(spark, d):
    joined = table(spark, d, "documents").select("doc_id", "text").join(table(spark, d, "labels"), "doc_id", "left")
    return prepare.drop_null(joined, "text", "quality").select("doc_id", "quality")


@query(f"SELECT doc_id, md5({S.normal_label('text')}) AS digest FROM documents")
def label_normalize(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.normal_label(F.col("text"))).alias("digest"))


@query("SELECT doc_id, CASE WHEN count(*) OVER (PARTITION BY lang) < 120 THEN '_RARE_GROUP_' ELSE lang END AS label FROM documents")
def rare_group(spark, d):
    return prepare.rare_grouped(table(spark, d, "documents").select("doc_id", F.col("lang").alias("label")), "label", 120)


@query("SELECT lang AS label, count(*) AS n FROM documents GROUP BY lang")
def class_counts(spark, d):
    return docs(spark, d).groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT lang AS label, min(doc_id) AS first_row, (row_number() OVER (ORDER BY lang))::INT AS sorted_place FROM documents GROUP BY lang")
def distinct_labels(spark, d):
    each = docs(spark, d).groupBy("label").agg(F.min("row_id").alias("first_row"))
    return each.withColumn("sorted_place", F.row_number().over(Window.orderBy("label")))


IDS = "ids AS (SELECT label, (row_number() OVER (ORDER BY min(row_id), label) - 1)::INT AS label_id FROM docs GROUP BY label)"


@query(f"WITH {S.DOCS}, {IDS} SELECT row_id, label_id FROM docs JOIN ids USING (label)")
def label_encode(spark, d):
    rows = docs(spark, d)
    return prepare.encoded(rows, prepare.label_ids(rows, "label", "row_id"), "label").select("row_id", "label_id")


@query(f"WITH {S.DOCS} SELECT row_id, (dense_rank() OVER (ORDER BY label) - 1)::INT AS label_id FROM docs")
def label_encode_sorted(spark, d):
    rows = docs(spark, d)
    return prepare.encoded(rows, prepare.label_ids(rows, "label", "row_id", first_seen=False), "label").select("row_id", "label_id")


@query(f"WITH {S.DOCS}, {IDS} SELECT r.row_id, coalesce(i.label_id, -1)::INT AS label_id, i.label FROM docs r LEFT JOIN (SELECT * FROM ids WHERE label <> 'de') i USING (label)")
def label_decode(spark, d):
    rows = docs(spark, d)
    ids = prepare.label_ids(rows, "label", "row_id").where("label <> 'de'")
    return prepare.decoded(prepare.encoded(rows, ids, "label", unknown=-1).select("row_id", "label_id"), ids).select("row_id", "label_id", "label")


@query("SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM documents JOIN labels USING (doc_id) WHERE quality = 0 AND toxic = 1)")
def label_isin(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source")
    known = rows.join(table(spark, d, "labels").where("quality = 0 and toxic = 1"), "doc_id").select("source").distinct()
    return rows.join(known, "source", "left_semi").select("doc_id", "source")


@query("SELECT min(n) AS min_count, count(*) AS n_classes, min(n) >= 2 AS stratify FROM (SELECT count(*) AS n FROM documents GROUP BY lang)")
def strat_guard(spark, d):
    return prepare.can_stratify(docs(spark, d).groupBy("label").agg(F.count("*").alias("n")))


@query(f"WITH {S.DOCS}, {S.held('h', 'docs', 0.3, 42)} SELECT row_id, label, held FROM h")
def stratified_split(spark, d):
    return prepare.stratified(docs(spark, d).select("row_id", "label"), "label", "row_id", 0.3, 42)


@query(f"WITH {S.DOCS} SELECT row_id, row_number() OVER (ORDER BY {S.draw(42, 'row_id')}, row_id) <= ceil(0.3 * count(*) OVER ()) AS held FROM docs")
def split_random(spark, d):
    return prepare.unstratified(docs(spark, d).select("row_id"), "row_id", 0.3, 42)


@query(f"WITH {S.DOCS}, {S.L0}, {S.held('h', 'l0', 0.2, 43)} SELECT row_id, label, held FROM h")
def split_internal(spark, d):
    return learner.split(start(spark, d).select("row_id", "label"), 0.2, 43)


@query(f"WITH {S.DOCS}, {S.prepared()}, ids AS (SELECT label, (row_number() OVER (ORDER BY min(row_id), label) - 1)::INT AS label_id FROM clean GROUP BY label) SELECT row_id, label, label_id, CASE WHEN held THEN 'U' ELSE 'P' END AS part FROM pu JOIN ids USING (label)")
def prepare_pu(spark, d):
    return prepare.prepare(docs(spark, d), "text", "label", "row_id", 1).select("row_id", "label", "label_id", "part")


@query(f"WITH {S.DOCS}, {S.prepared()} SELECT label, count(*) AS n_rows, count(*) FILTER (WHERE held) AS n_pool FROM pu GROUP BY label")
def union_pu(spark, d):
    rows = prepare.prepare(docs(spark, d), "text", "label", "row_id", 1)
    both = rows.where("part = 'P'").unionByName(rows.where("part = 'U'"))
    return both.groupBy("label").agg(F.count("*").alias("n_rows"), F.count_if(F.col("part") == "U").alias("n_pool"))


# --- vectorizer

C1 = S.with_(S.DOCS, S.class_terms("c", "docs", 1, 1))


@query(S.with_(S.DOCS, S.class_terms("c", "docs", 2, 2)) + "SELECT label, count(*) AS n_terms, sum(tf)::BIGINT AS n_bigrams, max(tf) AS max_tf FROM c GROUP BY label")
def class_documents(spark, d):
    return class_counted(docs(spark, d), 2, 2).groupBy("label").agg(F.count("*").alias("n_terms"), F.sum("tf").alias("n_bigrams"), F.max("tf").alias("max_tf"))


@query(S.with_(S.DOCS, S.row_terms("r", "docs", 1, 2)) + "SELECT row_id, count(*) AS n_terms, sum(tf)::BIGINT AS n_grams, max(tf) AS max_tf, max(length(term)) AS longest FROM r GROUP BY row_id")
def ngrams_1_2(spark, d):
    return counted(docs(spark, d), 1, 2).groupBy("row_id").agg(F.count("*").alias("n_terms"), F.sum("tf").alias("n_grams"), F.max("tf").alias("max_tf"), F.max(F.length("term")).cast("long").alias("longest"))


@query(C1 + "SELECT label, term, tf FROM c")
def term_document(spark, d):
    return class_counted(docs(spark, d), 1, 1)


WIDE = S.with_(S.DOCS, S.class_terms("c", "docs", 1, 1), "v AS (SELECT term, count(*) AS df FROM c GROUP BY term)", S.weighted("w", "c", "label", "v", "(SELECT count(DISTINCT label) FROM docs)", "tfidfscikit", "l2", True))


@query(WIDE + "SELECT term, w.label AS class, round(weight, 6) AS weight FROM w")
def term_matrix(spark, d):
    model, _ = ProductVectorizer("tfidfscikit", norm="l2", query="tfidfscikit", query_norm="l2").fit_transform(docs(spark, d))
    wide = model.term_document_matrix()  # a column for each class
    pairs = F.explode(F.array(*[F.struct(F.lit(x).alias("class"), F.col(f"`{x}`").alias("weight")) for x in model.labels])).alias("p")
    return rounded(wide.select("term", pairs).select("term", "p.*").where("weight <> 0"), "weight")


@query(PV + "SELECT row_id, count(*) AS n_terms, round(sum(weight), 6) AS weight FROM m_q GROUP BY row_id")
def term_query(spark, d):
    return profile(spark, d).query_terms(docs(spark, d)).groupBy("row_id").agg(F.count("*").alias("n_terms"), F.round(F.sum("weight"), 6).alias("weight"))


def _weights(name: str, kind: str, norm: str | None = None, documents: bool = True, low: int = 1, high: int = 2):
    n = "(SELECT count(DISTINCT label) FROM docs)"
    sql = S.with_(S.DOCS, S.class_terms("c", "docs", low, high), "v AS (SELECT term, count(*) AS df FROM c GROUP BY term)", S.weighted("w", "c", "label", "v", n, kind, norm, documents))

    def f(spark, d):
        rows = docs(spark, d)
        n = rows.agg(F.count_distinct("label")).first()[0]
        return rounded(class_weights(class_counted(rows, low, high), n, kind, norm), "weight")

    f.__name__ = name
    query(sql + "SELECT label, term, round(weight, 6) AS weight FROM w")(f)


_weights("tf_binary", "binary")
_weights("tf_raw", "termfrequency")
_weights("tf_sublinear", "tfsmooth")
_weights("tfidf_l1", "tfidfscikit", "l1")
_weights("tfidf_l2", "tfidf", "l2")


def _idf(name: str, kind: str, documents: bool):
    n = "(SELECT count(DISTINCT label) FROM docs)"
    formula = {"tfidf": f"ln({n}::DOUBLE / df)" + ("" if documents else " + 1"), "tfidfscikit": f"ln((1.0::DOUBLE + {n}) / (1.0::DOUBLE + df)) + 1"}[kind]

    def f(spark, d):
        counts = cut(class_counted(docs(spark, d), 1, 1))
        return document_frequency(counts).select("term", "df", F.round(idf(kind, counts.select("label").distinct().count(), documents), 6).alias("idf"))

    f.__name__ = name
    query(C1 + f", v AS (SELECT term, count(*) AS df FROM c GROUP BY term) SELECT term, df, round({formula}, 6) AS idf FROM v")(f)


_idf("idf_unsmoothed", "tfidf", False)
_idf("idf_shifted", "tfidf", True)
_idf("idf_smooth", "tfidfscikit", True)


@query(PV + "SELECT row_id, label, score FROM m_s")
def pv_score(spark, d):
    model = profile(spark, d)
    return rounded(model.products(model.query_terms(docs(spark, d))), "score")


@query(PV + "SELECT row_id, label, score FROM m_s")
def score_matrix(spark, d):
    """The same as a product of sparse matrices: documents by terms, and terms by classes."""
    model, rows = profile(spark, d), docs(spark, d)
    a = model.query_terms(rows).select(F.col("row_id").alias("row"), F.col("term").alias("column"), F.col("weight").alias("value"))
    b = model.class_terms.select(F.col("term").alias("row"), F.col("label").alias("column"), F.col("weight").alias("value"))
    right = matrix.BlockMatrix.of(b)
    left = matrix.indexed(rows.select(F.col("row_id").alias("key")), matrix.SIZE)  # from ids alone, no text is read for it
    scores = matrix.BlockMatrix.of(a, left, right.rows).product(right).entries()
    return rounded(scores.select(F.col("row").alias("row_id"), F.col("column").alias("label"), F.col("value").alias("score")), "score")


@query(PV + "SELECT row_id, predicted FROM m_p")
def pv_predict(spark, d):
    return profile(spark, d).predict(docs(spark, d))


TFIDF = {"method": "tfidf", "query": "tfidf", "norm": "l2", "query_norm": "l2"}


@query(S.with_(S.DOCS, S.L0, S.model("m", "l0", "docs", **TFIDF)) + "SELECT row_id, label, round(score, 6) AS score, round(proba, 6) AS proba FROM m_d")
def pv_proba(spark, d):
    return rounded(profile(spark, d, **TFIDF).long(docs(spark, d)), "score", "proba")


@query(PV + ", l AS (SELECT DISTINCT label FROM l0 UNION SELECT 'zz'), p AS (SELECT row_id, label, proba FROM m_d) SELECT r.row_id, l.label, round(coalesce(p.proba, 0), 6) AS proba FROM docs r CROSS JOIN l LEFT JOIN p ON p.row_id = r.row_id AND p.label = l.label")
def proba_align(spark, d):
    long = profile(spark, d).long(docs(spark, d)).select("row_id", "label", "proba")
    labels = docs(spark, d).select("label").distinct().unionByName(spark.createDataFrame([("zz",)], "label string"))
    return rounded(models.aligned(long, labels), "proba")


ALL_DOCS = S.with_(S.DOCS, S.model("m", "docs", "docs", high=1, **TFIDF))


@query(ALL_DOCS + "SELECT row_id, count(*) AS dimension, string_agg(round(proba * 1000)::BIGINT::VARCHAR, ',' ORDER BY label) AS vec FROM m_d GROUP BY row_id")
def pv_embedding(spark, d):
    rows = docs(spark, d)
    out = models.ProbabilityEmbedder(ngram_range=(1, 1), **TFIDF).fit_transform(rows)
    return out.select("row_id", F.size("vec").cast("long").alias("dimension"), F.array_join(F.transform("vec", lambda p: F.round(p * 1000).cast("long").cast("string")), ",").alias("vec"))


# --- selection

UNSURE = S.with_(S.DOCS, S.L0, S.model("m", "l0", "docs", **TFIDF), S.uncertainty("u", "m_d"))
BATCH = 50


def scored(spark, d) -> DataFrame:
    return profile(spark, d, **TFIDF).scored(docs(spark, d))


@query(UNSURE + "SELECT row_id, entropy FROM u")
def entropy_score(spark, d):
    return scored(spark, d).select("row_id", F.round(select.entropy(F.col("probas")), 6).alias("entropy"))


@query(UNSURE + "SELECT row_id, margin FROM u")
def margin_score(spark, d):
    return scored(spark, d).select("row_id", F.round(select.margin(F.col("probas")), 6).alias("margin"))


def _ranked(sql: str, order: str, score: str, n: int = BATCH) -> str:
    return sql + f"SELECT row_id, rank::INT AS rank, {score} AS score FROM (SELECT *, row_number() OVER (ORDER BY {order}, row_id) AS rank FROM u) WHERE rank <= {n}"


@query(S.with_(S.DOCS) + f"SELECT row_id, rank::INT AS rank FROM (SELECT *, row_number() OVER (ORDER BY {S.draw(42, 'row_id')}, row_id) AS rank FROM docs) WHERE rank <= {BATCH}")
def sel_random(spark, d):
    return select.random_sampling(docs(spark, d), BATCH).select("row_id", "rank")


@query(_ranked(UNSURE, "entropy DESC", "entropy"))
def sel_entropy(spark, d):
    return select.max_entropy(scored(spark, d), BATCH)


@query(_ranked(UNSURE, "confidence", "confidence"))
def sel_least_confidence(spark, d):
    return select.least_confidence(scored(spark, d), BATCH)


@query(_ranked(UNSURE, "margin", "margin"))
def sel_margin(spark, d):
    return select.smallest_margin(scored(spark, d), BATCH)


@query(
    UNSURE[:-1] + ", f AS (SELECT row_id, entropy, row_number() OVER (ORDER BY entropy DESC, row_id) AS rank FROM u QUALIFY rank <= 12), "
    f"g AS (SELECT row_id, 12 + row_number() OVER (ORDER BY {S.draw(42, 'row_id')}, row_id) AS rank FROM u WHERE row_id NOT IN (SELECT row_id FROM f) QUALIFY rank <= 25) "
    "SELECT row_id, rank::INT AS rank, entropy AS score FROM f UNION ALL SELECT row_id, rank::INT, NULL FROM g"
)
def sel_hybrid(spark, d):
    return select.select_batch({"type": "HYB", "params": {"batch_size": 25, "entropy_fraction": 0.5}}, docs(spark, d), scored(spark, d))


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_remaining(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), "lang")
    return pool.remaining(rows, table(spark, d, "labels").select(F.col("doc_id").alias("row_id"))).select(F.col("row_id").alias("doc_id"), "lang")


@query(S.with_(S.DOCS, S.first("f", "docs", 40, 7)) + "SELECT row_id, label FROM f")
def cold_random(spark, d):
    rows = docs(spark, d)
    return pool.take(rows, coldstart.select_initial({"type": "RND", "params": {"n_samples": 40}}, rows, 4, 7)).select("row_id", "label")


# --- evaluation

PAIRS = "pairs AS (SELECT row_id, label, predicted FROM docs JOIN m_p USING (row_id))"
LABELS = "lab AS (SELECT DISTINCT label FROM docs UNION SELECT 'zz')"


def pairs(spark, d) -> DataFrame:
    rows = docs(spark, d)
    return evaluate.paired(rows, profile(spark, d).predict(rows))


def labels_and_absent(spark, d) -> DataFrame:
    return docs(spark, d).select("label").distinct().unionByName(spark.createDataFrame([("zz",)], "label string"))


@query(PV + f", {PAIRS} SELECT count(*) AS n_rows, round(avg((label = predicted)::INT), 6) AS accuracy FROM pairs")
def eval_accuracy(spark, d):
    return rounded(evaluate.accuracy(pairs(spark, d)), "accuracy")


@query(PV + f", {PAIRS}, {LABELS}, {S.per_class('pc', 'pairs', 'lab')} SELECT label, tp, support, predicted, round(f1, 6) AS f1 FROM pc")
def eval_per_class(spark, d):
    return rounded(evaluate.per_class(pairs(spark, d), labels_and_absent(spark, d)), "f1")


@query(PV + f", {PAIRS}, {LABELS}, {S.per_class('pc', 'pairs', 'lab')} SELECT round(avg(f1), 6) AS macro_f1 FROM pc")
def eval_macro_f1(spark, d):
    return rounded(evaluate.macro_f1(pairs(spark, d), labels_and_absent(spark, d)), "macro_f1")


@query(
    S.with_(S.DOCS, S.held("h", "docs", 0.05, 42), "tr AS (SELECT row_id, text, label FROM h WHERE NOT held)", "te AS (SELECT row_id, text, label FROM h WHERE held)", S.model("m", "tr", "te"))[:-1]
    + f", pairs AS (SELECT row_id, label, predicted FROM te JOIN m_p USING (row_id)), lab AS (SELECT DISTINCT label FROM docs), {S.per_class('pc', 'pairs', 'lab')} "
    "SELECT (SELECT round(avg((label = predicted)::INT), 6) FROM pairs) AS baseline_acc, (SELECT round(avg(f1), 6) FROM pc) AS baseline_f1"
)
def baseline_metrics(spark, d):
    rows = docs(spark, d)
    found = learner.baseline_metrics(rows, {"type": "PVBin", "params": {"ngram_range": (1, 2)}}, rows.select("label").distinct())
    if found.get("error"):
        raise RuntimeError(found["error"])
    return rounded(spark.createDataFrame([(found["baseline_acc"], found["baseline_f1"])], "baseline_acc double, baseline_f1 double"), "baseline_acc", "baseline_f1")


# --- the loop


def _truth(spark, d) -> DataFrame:
    return table(spark, d, "labels").select(F.col("doc_id").alias("row_id"), F.col("quality").cast("string").alias("label"))


ASKED = f"{S.DOCS}, {S.first('asked', 'docs', 200, 9)}"


@query(f"WITH {ASKED} SELECT a.row_id, l.quality::VARCHAR AS label FROM asked a JOIN labels l ON l.doc_id = a.row_id WHERE l.quality IS NOT NULL")
def oracle_apply(spark, d):
    rows = docs(spark, d).select("row_id", "text")
    chosen = pool.take(rows, select.random_sampling(rows, 200, 9))
    return oracle.get_oracle({"type": "simulated"}, _truth(spark, d)).query(chosen).where("label is not null").select("row_id", "label")


@query(f"WITH {ASKED} SELECT row_id, label, length(text) AS n_chars FROM asked")
def pool_take(spark, d):
    rows = docs(spark, d)
    return pool.take(rows, select.random_sampling(rows, 200, 9)).select("row_id", "label", F.length("text").cast("long").alias("n_chars"))


@query(
    f"WITH {S.DOCS}, {S.first('l', 'docs', 40, 7)}, u AS (SELECT * FROM docs WHERE row_id NOT IN (SELECT row_id FROM l)), {S.first('asked', 'u', 200, 9)}, "
    "got AS (SELECT a.row_id FROM asked a JOIN labels x ON x.doc_id = a.row_id WHERE x.quality IS NOT NULL) "
    "SELECT row_id, 'L' AS part FROM l UNION ALL SELECT row_id, 'L' FROM got UNION ALL SELECT row_id, 'U' FROM u WHERE row_id NOT IN (SELECT row_id FROM asked)"
)
def pool_update(spark, d):
    rows = docs(spark, d).select("row_id", "text", F.lit(None).cast("string").alias("label"))
    first = select.random_sampling(rows, 40, 7)
    labelled, rest = pool.take(rows, first), pool.remaining(rows, first)
    answers = pool.answered(pool.take(rest, select.random_sampling(rest, 200, 9)).drop("label"), _truth(spark, d))
    L, U = pool.update(labelled, rest, answers)
    return L.select("row_id", F.lit("L").alias("part")).unionByName(U.select("row_id", F.lit("U").alias("part")))


def _curve(spark, d) -> DataFrame:
    """Of each user the events in order, as a run's iterations."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, d, "events").select(F.col("user_id").alias("run"), place.alias("iteration"), (F.col("value") / 500).alias("v"))


@query(
    f"WITH RECURSIVE {S.EVENTS}, st AS (SELECT run, 0::BIGINT AS iteration, NULL::DOUBLE AS best, 0 AS k, NULL::INT AS stop FROM (SELECT DISTINCT run FROM ev) "
    "UNION ALL SELECT s.run, e.iteration, CASE WHEN s.best IS NULL OR e.v > s.best + 0.001 THEN e.v ELSE s.best END, CASE WHEN s.best IS NULL OR e.v > s.best + 0.001 THEN 0 ELSE s.k + 1 END, "
    "CASE WHEN NOT (s.best IS NULL OR e.v > s.best + 0.001) AND s.k + 1 >= 15 THEN e.iteration::INT END FROM st s JOIN ev e ON e.run = s.run AND e.iteration = s.iteration + 1 WHERE s.stop IS NULL) "
    "SELECT run, round(first(best ORDER BY iteration DESC), 6) AS best, coalesce(max(stop), -1) AS stop_iteration FROM st GROUP BY run"
)
def early_stop(spark, d):
    return rounded(curves.early_stop(_curve(spark, d), 0.001, 15), "best").na.fill(-1, ["stop_iteration"])


def _loop_config(iterations: int, **more) -> dict:
    al = {"classifier_config": {"type": "PVBin", "params": {"ngram_range": [1, 1]}}, "cold_start_config": {"type": "RND", "params": {"n_samples": 40}}, "query_strategy_config": {"type": "ENT", "params": {"batch_size": 50}}, "max_iterations": iterations}
    return {"experiment_name": "docs", "active": True, "data_params": {"min_samples_per_class": 1}, "al_params": al | more, "general_params": {"random_seed": 42}}


def _loop_parts() -> list[str]:
    """The loop's first round: l1 is labelled, q1 is asked of r1."""
    parts = [S.DOCS, S.prepared(), "pop AS (SELECT row_id, text, label FROM pu WHERE NOT held)", "u1 AS (SELECT row_id, text, label FROM pu WHERE held)", S.first("l1", "u1", 40, 42)]
    parts += ["r1 AS (SELECT * FROM u1 WHERE row_id NOT IN (SELECT row_id FROM l1))", S.model("a", "l1", "pop", high=1), S.model("b", "l1", "r1", high=1), S.uncertainty("ub", "b_d")]
    return [*parts, "q1 AS (SELECT row_id FROM ub ORDER BY entropy DESC, row_id LIMIT 50)"]


def _loop_sql() -> str:
    parts = [*_loop_parts(), "l2 AS (SELECT * FROM l1 UNION ALL SELECT * FROM r1 WHERE row_id IN (SELECT row_id FROM q1))", S.model("c", "l2", "pop", high=1), "lab AS (SELECT DISTINCT label FROM pu)"]
    for k in "ac":
        parts += [f"{k}p AS (SELECT row_id, label, predicted FROM pop JOIN {k}_p USING (row_id))", S.per_class(f"{k}f", f"{k}p", "lab")]
    row = "SELECT {i} AS iteration, {l}::BIGINT AS l_size, {u}::BIGINT AS u_size, (SELECT round(avg((label = predicted)::INT), 6) FROM {k}p) AS external_acc, (SELECT round(avg(f1), 6) FROM {k}f) AS external_f1"
    n = "(SELECT count(*) FROM {})"
    return S.with_(*parts) + row.format(i=1, l=n.format("l1"), u=f"greatest({n.format('r1')} - 50, 0)", k="a") + " UNION ALL " + row.format(i=2, l=n.format("l2"), u=f"greatest({n.format('r1')} - 100, 0)", k="c")


@query(_loop_sql())
def al_curve_small(spark, d):
    done = learner.ActiveLearner(_loop_config(2)).setup(docs(spark, d)).run()
    out = spark.createDataFrame([(h["iteration"], h["L_size"], h["U_size"], h["external_acc"], h["external_f1"]) for h in done.history], "iteration int, l_size long, u_size long, external_acc double, external_f1 double")
    return rounded(out, "external_acc", "external_f1")


@query(S.with_(*_loop_parts()) + "SELECT 'docs' AS experiment_name, 1 AS iteration, 'ENT' AS query_strategy, ub.row_id, md5(r1.text) AS text_md5, r1.label AS oracle_label, ub.entropy AS uncertainty_score FROM q1 JOIN ub USING (row_id) JOIN r1 USING (row_id)")
def selection_log(spark, d):
    path = f"{shared_dir(spark)}/selections-{uuid.uuid4().hex}"
    settings = _loop_config(1)
    settings["general_params"] |= {"verbose": True, "selection_log_file": path}
    learner.ActiveLearner(settings).setup(docs(spark, d)).run()
    kind = "experiment_name STRING, iteration INT, query_strategy STRING, row_id BIGINT, text STRING, oracle_label STRING, uncertainty_score DOUBLE"
    return tables.read_csv(spark, path, kind).withColumn("text", F.md5("text")).withColumnRenamed("text", "text_md5")


@query()
def al_history(spark, d):
    settings = {"query_strategy_config": {"type": "HYB", "params": {"batch_size": 10, "entropy_fraction": 0.5}}, "internal_test_size": 0.2, "early_stopping_metric": "external_acc", "early_stopping_patience": 1}
    return learner.ActiveLearner(_loop_config(3, **settings)).setup(docs(spark, d)).run().history_frame(spark)


# --- logs


@query(f"WITH {RUNS} SELECT experiment_name, execution_timestamp, most AS total_duration_sec FROM (SELECT *, row_number() OVER (PARTITION BY experiment_name ORDER BY execution_timestamp DESC, place) AS k FROM runs WHERE status = 'COMPLETED') WHERE k = 1")
def latest_run(spark, d):
    return history.latest_runs(run_log(spark, d)).select("experiment_name", "execution_timestamp", "total_duration_sec")


@query(f"WITH {RUNS} SELECT DISTINCT experiment_name FROM runs WHERE status = 'COMPLETED'")
def completed_names(spark, d):
    return history.completed_names(run_log(spark, d))


FLAT = f"""WITH {RUNS}, h AS (SELECT *, unnest(steps) AS s, unnest(range(1, len(steps) + 1)) AS i FROM runs WHERE status = 'COMPLETED'),
flat AS (SELECT experiment_name, execution_timestamp AS timestamp_str, try_strptime(execution_timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp_dt, CASE WHEN u % 2 = 1 THEN most + 1 ELSE most END AS overall_experiment_duration_sec,
  most AS loop_run_duration_sec, round(most / 500, 6) AS baseline_acc, round(least / 500, 6) AS baseline_f1, ['N/A', 'RND', 'KM'][u % 3 + 1] AS cold_start_type, ['PVBin', 'N/A', 'GNB'][u % 3 + 1] AS classifier_type,
  CASE WHEN u % 2 = 0 THEN '{{"method":"binary"}}' ELSE '{{}}' END AS classifier_params_str, 'ENT' AS query_strategy_type, [NULL, 10.0, 20.0][u % 3 + 1]::DOUBLE AS query_batch_size, [0.25, 0.5][u % 2 + 1]::DOUBLE AS query_entropy_fraction,
  (u % 5)::DOUBLE AS min_samples_per_class, 0.5::DOUBLE AS population_size_pct, (42 + u % 2)::DOUBLE AS random_seed, i::INT AS iteration, (10 * i)::INT AS L_size, round(s.v / 1000, 6) AS internal_acc, NULL::DOUBLE AS internal_f1,
  round(s.v / 500, 6) AS external_acc, CASE WHEN s.t <> 'signup' THEN round(s.v / 600, 6) END AS external_f1, s.v AS iteration_duration_sec, round(s.v / 2, 6) AS train_duration_sec, NULL::DOUBLE AS eval_duration_sec,
  round(s.v / 4, 6) AS query_duration_sec, round(s.v / 8, 6) AS update_duration_sec, (1000 - 10 * i)::INT AS U_size, 'COMPLETED_ITERATION' AS status, CASE WHEN s.t = 'click' THEN 'late' END AS error FROM h)"""


@query(FLAT + " SELECT * FROM flat")
def log_flatten(spark, d):
    flat = history.flatten(run_log(spark, d))
    return rounded(flat, "baseline_acc", "baseline_f1", "internal_acc", "external_acc", "external_f1", "train_duration_sec", "query_duration_sec", "update_duration_sec")


@query(FLAT + " SELECT experiment_name, L_size AS x, external_f1 AS y FROM flat WHERE external_f1 IS NOT NULL")
def curve_points(spark, d):
    return rounded(curves.curve_points(history.flatten(run_log(spark, d)), "L_size", "external_f1"), "y")


@query(f"WITH {RUNS}, c AS (SELECT DISTINCT 'user-' || user_id AS experiment_name, user_id % 4 <> 0 AS active, user_id % 7 <> 0 AS is_valid FROM events) SELECT * FROM c WHERE active AND is_valid AND experiment_name NOT IN (SELECT experiment_name FROM runs WHERE status = 'COMPLETED' AND execution_timestamp >= '2024-01-29')")
def pending_experiments(spark, d):
    configs = table(spark, d, "events").select(F.concat(F.lit("user-"), "user_id").alias("experiment_name"), (F.col("user_id") % 4 != 0).alias("active"), (F.col("user_id") % 7 != 0).alias("is_valid")).distinct()
    return config.pending(configs, history.completed_names(run_log(spark, d).where("execution_timestamp >= '2024-01-29'")))


@query(f"WITH {RUNS} SELECT status, experiment_name, count(*) AS runs FROM runs GROUP BY ALL")
def session_summary(spark, d):
    return history.session_summary(run_log(spark, d).where("_corrupt_record is null"))


@query(
    f"WITH {S.EVENTS}, p AS (SELECT run, iteration::DOUBLE AS x, v AS y, CASE WHEN run % 7 = 0 THEN 0 ELSE 0.8::DOUBLE END AS baseline FROM ev), "
    "s AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM p WINDOW w AS (PARTITION BY run ORDER BY x, y)) "
    "SELECT run, round(CASE WHEN max(baseline) > 0 AND count(*) >= 2 AND max(x) > min(x) THEN sum((x - px) * (y + py) / 2) / (max(baseline) * (max(x) - min(x))) END, 6) AS lce FROM s GROUP BY run"
)
def lce(spark, d):
    base = F.when(F.col("run") % 7 == 0, 0.0).otherwise(0.8)
    return rounded(curves.lce(_curve(spark, d).select("run", F.col("iteration").cast("double").alias("x"), F.col("v").alias("y"), base.alias("baseline"))), "lce")


# --- feature models

EMB = "emb AS (SELECT vec_id AS row_id, embedding, label::VARCHAR AS label FROM embeddings), fx AS (SELECT row_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS dim FROM emb), fl AS (SELECT max(v) * 1e-9 AS f FROM (SELECT var_pop(x) AS v FROM fx GROUP BY dim)), gp AS (SELECT label, count(*) AS n, dim, avg(x) AS mean, var_pop(x) + (SELECT f FROM fl) AS var FROM fx GROUP BY label, dim)"


@query(f"WITH {EMB} SELECT label, n, dim::INT AS dim, round(mean, 6) AS mean, round(var, 6) AS var FROM gp")
def gnb_params(spark, d):
    return rounded(models.gaussian_params(vectors(spark, d)), "mean", "var")


@query(f"WITH {EMB}, sc AS (SELECT x.row_id, g.label, round(ln(any_value(g.n)::DOUBLE / (SELECT count(*) FROM emb)) - 0.5 * sum(ln(2 * pi() * g.var) + (x.x - g.mean) ** 2 / g.var), 6) AS s FROM fx x JOIN gp g USING (dim) GROUP BY x.row_id, g.label) SELECT row_id, first(label ORDER BY s DESC, label) AS predicted FROM sc GROUP BY row_id")
def gnb_predict(spark, d):
    rows = vectors(spark, d)
    return models.get_model({"type": "GNB"}).fit(rows).predict(rows)


def _ml(code: str, name: str | None = None, **params):
    def f(spark, d):
        rows = vectors(spark, d)
        return models.get_model({"type": code, "params": params}).fit(rows).predict(rows)

    f.__name__ = name or f"{code.lower()}_predict"
    query()(f)


_ml("LR")
_ml("LSVC")
_ml("SGD")
_ml("SGD", "sgd_log_predict", loss="log_loss")


@query("WITH t AS (SELECT a.vec_id AS row_id, round(sum(sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2)))), 4) AS total FROM embeddings a CROSS JOIN embeddings b GROUP BY a.vec_id) SELECT row_id, total FROM t ORDER BY total, row_id LIMIT 10")
def kmedoid_init(spark, d):
    return coldstart.least_total(vectors(spark, d).select("row_id", "vec"), 10, digits=4)


@query()
def cold_kmedoids(spark, d):
    return coldstart.select_initial({"type": "KM", "params": {"n_clusters": 10}}, vectors(spark, d), 10, 42, vectors(spark, d))


# --- genetic search

GA = f"clean AS (SELECT row_id, text, {S.normal_label('label')} AS label FROM docs), sz AS (SELECT label, count(*) AS n FROM clean GROUP BY label), ga AS (SELECT row_id, text, CASE WHEN n < 5 THEN '_RARE_GROUP_' ELSE label END AS label FROM clean JOIN sz USING (label))"
PEOPLE = f"genes AS (SELECT individual_id::INT AS individual_id, (k - 1)::INT AS gene_pos, row_id FROM (SELECT i.range AS individual_id, row_id, row_number() OVER (PARTITION BY i.range ORDER BY {S.draw(42, 'i.range', 'row_id')}, row_id) AS k FROM ga CROSS JOIN range(5) i) WHERE k <= 20)"
POP = f"WITH {S.DOCS}, {GA}, {PEOPLE}"


def ga_rows(spark, d) -> DataFrame:
    return genetic.dataset(docs(spark, d), "text", "label", "row_id", 5)


def people(spark, d) -> DataFrame:
    return genetic.init_population(ga_rows(spark, d).select("row_id"), 20, 5)


@query(f"WITH {S.DOCS}, {GA} SELECT row_id, label, md5(text) AS text_md5 FROM ga")
def ga_dataset(spark, d):
    return ga_rows(spark, d).select("row_id", "label", F.md5("text").alias("text_md5"))


@query(POP + " SELECT individual_id, gene_pos, row_id FROM genes")
def ga_init_population(spark, d):
    return people(spark, d).select(F.col("individual_id").cast("int").alias("individual_id"), "gene_pos", "row_id")


def _fitness_sql() -> str:
    docs_ = f"gt AS (SELECT individual_id, label, {S.tokens("string_agg(text, ' ' ORDER BY row_id)")} AS t FROM genes JOIN ga USING (row_id) GROUP BY ALL)"
    terms = "gk AS (SELECT DISTINCT individual_id, label, unnest(t) AS term FROM gt UNION SELECT DISTINCT individual_id, label, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM gt)"
    score = "fs AS (SELECT individual_id, row_id, label, count(*) AS s FROM r JOIN gk USING (term) GROUP BY ALL)"
    best = "fp AS (SELECT i.individual_id, ga.row_id, ga.label, coalesce((SELECT first(f.label ORDER BY s DESC, f.label) FROM fs f WHERE f.individual_id = i.individual_id AND f.row_id = ga.row_id), (SELECT min(label) FROM gt WHERE gt.individual_id = i.individual_id)) AS predicted FROM ga CROSS JOIN (SELECT DISTINCT individual_id FROM genes) i)"
    each = "fc AS (SELECT i.individual_id, l.label, count(*) FILTER (WHERE p.label = l.label AND p.predicted = l.label) AS tp, count(*) FILTER (WHERE p.label = l.label) AS sup, count(*) FILTER (WHERE p.predicted = l.label) AS pre FROM (SELECT DISTINCT label FROM ga) l CROSS JOIN (SELECT DISTINCT individual_id FROM genes) i JOIN fp p ON p.individual_id = i.individual_id GROUP BY ALL)"
    fit = "fit AS (SELECT individual_id, round(sum(tp)::DOUBLE / sum(sup), 6) AS accuracy, round(avg(CASE WHEN sup + pre > 0 THEN 2.0::DOUBLE * tp / (sup + pre) ELSE 0 END), 6) AS macro_f1 FROM fc GROUP BY individual_id)"
    return ", ".join([POP, docs_, terms, S.row_terms("r", "ga", 1, 2), score, best, each, fit])


FIT = _fitness_sql()


def fit_table(spark, d) -> DataFrame:
    rows = ga_rows(spark, d)
    out = genetic.fitness(people(spark, d), rows, row_terms(rows, 1, 2), labels=rows.select("label").distinct())
    return rounded(out.select(F.col("individual_id").cast("int").alias("individual_id"), "accuracy", "macro_f1"), "accuracy", "macro_f1")


@query(FIT + " SELECT individual_id, accuracy, macro_f1 FROM fit")
def ga_fitness(spark, d):
    return fit_table(spark, d)


@query(FIT + ", b AS (SELECT individual_id, accuracy FROM fit ORDER BY accuracy DESC, individual_id LIMIT 1) SELECT ga.row_id, ga.label, b.accuracy AS metric_value, 'ACCURACY' AS metric_type, 'MAXIMIZE' AS optimization_goal, (SELECT string_agg(row_id::VARCHAR, ',' ORDER BY row_id) FROM genes JOIN b USING (individual_id)) AS l0_indices_str FROM b JOIN genes USING (individual_id) JOIN ga USING (row_id)")
def ga_best_l0(spark, d):
    best = fit_table(spark, d).orderBy(F.col("accuracy").desc(), "individual_id").first()
    chosen = people(spark, d).where(F.col("individual_id") == best.individual_id)
    return genetic.best_rows(ga_rows(spark, d), chosen, best.accuracy, "accuracy", "maximize").drop("text")


PROFILE = (
    "pr AS (SELECT individual_id, count(*) AS l0_size, count(DISTINCT label) AS num_classes_in_l0, substr(sha256(string_agg(row_id::VARCHAR, ',' ORDER BY row_id)), 1, 10) AS l0_indices_hash FROM genes JOIN ga USING (row_id) GROUP BY individual_id), "
    r"tk AS (SELECT individual_id, count(*) AS num_tokens, count(DISTINCT w) AS num_distinct_tokens FROM (SELECT individual_id, unnest(string_split_regex(lower(text), '\s+')) AS w FROM genes JOIN ga USING (row_id)) WHERE w <> '' GROUP BY individual_id), "
    "md AS (SELECT individual_id, first(label ORDER BY n DESC, p) AS most_frequent_class_in_l0 FROM (SELECT individual_id, label, count(*) AS n, min(gene_pos) AS p FROM genes JOIN ga USING (row_id) GROUP BY ALL) GROUP BY individual_id)"
)
PROFILE_COLUMNS = "individual_id, l0_size, num_tokens, num_distinct_tokens, num_classes_in_l0, most_frequent_class_in_l0, l0_indices_hash"


@query(f"{POP}, {PROFILE} SELECT {PROFILE_COLUMNS} FROM pr JOIN tk USING (individual_id) JOIN md USING (individual_id)")
def l0_profile(spark, d):
    return genetic.profiles(people(spark, d), ga_rows(spark, d)).withColumn("individual_id", F.col("individual_id").cast("int"))


@query(f"{FIT}, {PROFILE} SELECT 0 AS generation, {PROFILE_COLUMNS}, printf('%.6f', accuracy) AS accuracy_on_full, printf('%.6f', macro_f1) AS f1_macro_on_full FROM fit JOIN pr USING (individual_id) JOIN tk USING (individual_id) JOIN md USING (individual_id)")
def ga_fitness_log(spark, d):
    path = f"{shared_dir(spark)}/fitness-{uuid.uuid4().hex}"
    scores = fit_table(spark, d).select(F.lit(0).alias("generation"), "individual_id", F.col("accuracy").alias("acc"), F.col("macro_f1").alias("f1"), F.lit(None).cast("double").alias("seconds"))
    tables.append_csv(genetic.details(people(spark, d), ga_rows(spark, d), scores), path)
    kind = "generation INT, individual_id INT, l0_size BIGINT, accuracy_on_full STRING, f1_macro_on_full STRING, num_tokens BIGINT, num_distinct_tokens BIGINT, num_classes_in_l0 BIGINT, most_frequent_class_in_l0 STRING, l0_indices_hash STRING, fitness_calc_time_sec STRING"
    return tables.read_csv(spark, path, kind).drop("fitness_calc_time_sec")  # no two runs take the same time


GENES = f"genes AS (SELECT individual_id, row_id FROM (SELECT i.range::INT AS individual_id, row_id, row_number() OVER (PARTITION BY i.range ORDER BY {S.draw(42, 'i.range', 'row_id')}, row_id) AS k FROM emb CROSS JOIN range(3) i) WHERE k <= 150)"


@query(
    f"WITH {EMB}, {GENES}, tr AS (SELECT individual_id, row_id, label, dim, x FROM genes JOIN fx USING (row_id)), tf AS (SELECT individual_id, max(v) * 1e-9 AS f FROM (SELECT individual_id, var_pop(x) AS v FROM tr GROUP BY individual_id, dim) GROUP BY individual_id), "
    "tp AS (SELECT individual_id, label, dim, count(*) AS n, avg(x) AS mean, var_pop(x) + any_value(f) AS var FROM tr JOIN tf USING (individual_id) GROUP BY individual_id, label, dim), "
    "sc AS (SELECT x.row_id, any_value(x.label) AS truth, g.individual_id, g.label, round(ln(any_value(g.n)::DOUBLE / 150) - 0.5 * sum(ln(2 * pi() * g.var) + (x.x - g.mean) ** 2 / g.var), 6) AS s FROM fx x JOIN tp g USING (dim) GROUP BY x.row_id, g.individual_id, g.label), "
    "pr AS (SELECT individual_id, row_id, any_value(truth) AS truth, first(label ORDER BY s DESC, label) AS predicted FROM sc GROUP BY individual_id, row_id), "
    "cl AS (SELECT i.individual_id, l.label, (SELECT count(*) FROM pr p WHERE p.individual_id = i.individual_id AND p.truth = l.label AND p.predicted = l.label) AS tp, (SELECT count(*) FROM pr p WHERE p.individual_id = i.individual_id AND p.truth = l.label) AS sup, (SELECT count(*) FROM pr p WHERE p.individual_id = i.individual_id AND p.predicted = l.label) AS pre FROM (SELECT DISTINCT label FROM emb) l CROSS JOIN range(3) r(individual_id) JOIN (SELECT DISTINCT individual_id FROM genes) i ON i.individual_id = r.individual_id) "
    "SELECT individual_id, round(sum(tp)::DOUBLE / sum(sup), 6) AS accuracy, round(avg(CASE WHEN sup + pre > 0 THEN 2.0::DOUBLE * tp / (sup + pre) ELSE 0 END), 6) AS macro_f1 FROM cl GROUP BY individual_id"
)
def ga_fitness_gnb(spark, d):
    rows = vectors(spark, d)
    search = genetic.GeneticOptimizer(size=150, population=3, generations=1, classifier={"type": "GNB"}).run(rows)
    return rounded(spark.createDataFrame([x[1:] for x in search.log], "individual_id int, accuracy double, macro_f1 double"), "accuracy", "macro_f1")


# metric logs: events as individuals, their days as generations; one kind of event has failed
GA_LOG = "gl AS (SELECT (day(ts) - 1)::INT AS generation, event_id AS individual_id, CASE WHEN event_type = 'error' THEN NULL ELSE value / 500 END AS acc, CASE WHEN event_type = 'error' THEN NULL ELSE (value / 500) ** 2 END AS f1, CASE WHEN event_type = 'error' THEN 'Error' ELSE printf('%.6f', value / 500) END AS acc_text FROM events)"


def ga_log(spark, d) -> DataFrame:
    v = F.col("value") / 500
    failed = F.col("event_type") == "error"
    return table(spark, d, "events").select(
        (F.dayofmonth("ts") - 1).alias("generation"), F.col("event_id").alias("individual_id"), F.when(failed, F.lit(float("-inf"))).otherwise(v).alias("acc"),
        F.when(failed, F.lit(float("nan"))).otherwise(v * v).alias("f1"), F.when(failed, F.lit("Error")).otherwise(F.format_string("%.6f", v)).alias("acc_text"),
    )


STATS = ", ".join(f"round({f}({m}), 6) AS {f}_{n}" for m, n in (("acc", "acc"), ("f1", "f1")) for f in ("max", "avg", "min"))
STAT_NAMES = [f"{f}_{n}" for n in ("acc", "f1") for f in ("max", "avg", "min")]


@query(f"WITH {GA_LOG} SELECT generation, {STATS} FROM gl GROUP BY generation")
def ga_generation_stats(spark, d):
    return rounded(genetic.generation_stats(ga_log(spark, d)), *STAT_NAMES)


@query(f"WITH {GA_LOG} SELECT generation, individual_id, round(f1, 6) AS best FROM gl WHERE f1 IS NOT NULL ORDER BY f1, generation, individual_id LIMIT 1")
def ga_best_overall(spark, d):
    return rounded(genetic.best_overall(ga_log(spark, d), "f1", "minimize"), "best")


@query(f"WITH {GA_LOG} SELECT individual_id, round(acc, 6) AS fitness FROM gl WHERE acc IS NOT NULL ORDER BY acc DESC, individual_id LIMIT 100")
def ga_elite(spark, d):
    fit = ga_log(spark, d).select("individual_id", curves.finite(F.col("acc")).alias("fitness"))
    return rounded(genetic.elite(fit, 1000, 0.1), "fitness")


TOURNAMENT = f"sl AS (SELECT range::INT AS slot FROM range(200)), dr AS (SELECT slot, k.range AS k, {S.draw_int('1000', 42, 'slot', 'k.range')}::INT AS individual_id FROM sl CROSS JOIN range(3) k)"


@query(f"WITH {GA_LOG}, {TOURNAMENT} SELECT slot, first(individual_id ORDER BY (acc IS NULL), acc DESC, k) AS individual_id FROM dr LEFT JOIN gl USING (individual_id) GROUP BY slot")
def ga_tournament(spark, d):
    fit = ga_log(spark, d).select(F.col("individual_id").cast("int").alias("individual_id"), curves.finite(F.col("acc")).alias("fitness"))
    return genetic.tournament(fit, 1000, 200, 3)


CROSS = (
    "ar AS (SELECT individual_id, list(row_id ORDER BY gene_pos) AS g FROM genes GROUP BY individual_id), "
    f"cp AS (SELECT a.individual_id AS pair, a.g AS a, b.g AS b, 1 + {S.draw_int('19', 42, 'a.individual_id')} AS c FROM ar a JOIN ar b ON b.individual_id = a.individual_id + 1), "
    "ch AS (SELECT pair, 0 AS child, a[1:c] || b[c + 1:] || a || b AS s FROM cp UNION ALL SELECT pair, 1, b[1:c] || a[c + 1:] || b || a FROM cp), "
    "cu AS (SELECT pair, child, unnest(s) AS row_id, unnest(range(len(s))) AS p FROM ch), cd AS (SELECT pair, child, row_id, min(p) AS p FROM cu GROUP BY ALL)"
)


@query(f"{POP}, {CROSS} SELECT pair, child::INT AS child, string_agg(row_id::VARCHAR, ',' ORDER BY p) AS genes FROM (SELECT *, row_number() OVER (PARTITION BY pair, child ORDER BY p) AS k FROM cd) WHERE k <= 20 GROUP BY ALL")
def ga_crossover(spark, d):
    arrays = people(spark, d).groupBy("individual_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("gene_pos", "row_id"))), lambda s: s["row_id"]).alias("g"))
    couples = arrays.select(F.col("individual_id").cast("int").alias("pair"), F.col("g").alias("a")).join(arrays.select((F.col("individual_id") - 1).cast("int").alias("pair"), F.col("g").alias("b")), "pair")
    return genetic.crossover(couples).select("pair", "child", F.array_join("genes", ",").alias("genes"))


@query(
    f"{POP}, mk AS (SELECT *, row_number() OVER (PARTITION BY individual_id ORDER BY {S.draw('42', 'individual_id', "'p'", 'gene_pos')}, gene_pos) AS k FROM genes), "
    "pl AS (SELECT i.individual_id, ga.row_id FROM ga CROSS JOIN (SELECT DISTINCT individual_id FROM genes) i WHERE NOT EXISTS (SELECT 1 FROM genes g WHERE g.individual_id = i.individual_id AND g.row_id = ga.row_id)), "
    f"fr AS (SELECT individual_id, row_id, row_number() OVER (PARTITION BY individual_id ORDER BY {S.draw('42', 'individual_id', "'r'", 'row_id')}, row_id) AS k FROM pl) "
    "SELECT m.individual_id, m.gene_pos, CASE WHEN m.k <= 3 THEN coalesce(f.row_id, m.row_id) ELSE m.row_id END AS row_id FROM mk m LEFT JOIN fr f ON f.individual_id = m.individual_id AND f.k = m.k AND m.k <= 3"
)
def ga_mutation(spark, d):
    return genetic.mutation(people(spark, d), ga_rows(spark, d).select("row_id"), 3).withColumn("individual_id", F.col("individual_id").cast("int"))


def _parts(spark, d) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_name").alias("text"), F.col("p_type").alias("label"))


@query()
def ga_run(spark, d):
    done = genetic.GeneticOptimizer(size=12, population=4, generations=2, elitism_rate=0.25).run(_parts(spark, d))
    return spark.createDataFrame(done.log, "generation int, individual_id int, accuracy double, macro_f1 double")


GOALS = ("accuracy_maximize", "accuracy_minimize", "macro_f1_maximize", "macro_f1_minimize")


@query("SELECT * FROM (VALUES " + ", ".join(f"({k}, '{g}', {k == 0 or g == GOALS[1]})" for k in (0, 1) for g in GOALS) + ") x(attempt, name, ran)")
def ga_resume(spark, d):
    folder = f"{shared_dir(spark)}/goals-{uuid.uuid4().hex}"
    settings = {"size": 12, "population": 2, "generations": 1}
    runs = [genetic.run_goals(_parts(spark, d), folder, settings)]
    tables.remove(spark, f"{folder}/{GOALS[1]}/history")  # as if that goal's run had been broken off
    runs.append(genetic.run_goals(_parts(spark, d), folder, settings))
    return spark.createDataFrame([(k, n, r) for k, x in enumerate(runs) for n, r in x], "attempt int, name string, ran boolean")


@query(f"WITH {GA_LOG} SELECT individual_id, generation, try_cast(acc_text AS DOUBLE) AS accuracy_on_full FROM gl")
def fitness_log_clean(spark, d):
    return ga_log(spark, d).select("individual_id", "generation", F.expr("try_cast(acc_text as double)").alias("accuracy_on_full"))


@query(f"WITH {GA_LOG}, g AS (SELECT generation, row_number() OVER (ORDER BY generation) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT generation FROM gl)) SELECT generation, individual_id FROM gl JOIN g USING (generation) WHERE (r - 1) % 7 = 0 OR r = n")
def gen_sample(spark, d):
    return curves.sampled_generations(ga_log(spark, d), 7).select("generation", "individual_id")


@query(f"WITH {GA_LOG}, s AS (SELECT generation, max(acc) AS m FROM gl GROUP BY generation) SELECT generation, round(m, 6) AS max_acc, round(max(m) OVER (ORDER BY generation), 6) AS best_so_far FROM s")
def ga_convergence(spark, d):
    stats = genetic.generation_stats(ga_log(spark, d))
    best = F.max("max_acc").over(Window.orderBy("generation").rowsBetween(Window.unboundedPreceding, 0))  # a row for each generation
    return rounded(stats.select("generation", "max_acc", best.alias("best_so_far")), "max_acc", "best_so_far")


BOX = "count({v}) AS n, round(min({v}), 6) AS low, round(quantile_cont({v}, 0.25), 6) AS q1, round(quantile_cont({v}, 0.5), 6) AS median, round(quantile_cont({v}, 0.75), 6) AS q3, round(max({v}), 6) AS high"


@query(f"WITH {GA_LOG} SELECT generation, {BOX.format(v='acc')} FROM gl GROUP BY generation")
def ga_boxplot(spark, d):
    rows = ga_log(spark, d).select("generation", curves.finite(F.col("acc")).alias("acc"))
    return rounded(curves.boxplot(rows, "acc"), "low", "q1", "median", "q3", "high")


@query(f"SELECT round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, {BOX.format(v='value')} FROM events")
def ga_time_stats(spark, d):
    return rounded(curves.described(table(spark, d, "events"), "value"), "mean", "std", "low", "q1", "median", "q3", "high")


# --- chat oracle


@query(f"WITH l AS (SELECT string_agg('''' || lang || '''', ', ' ORDER BY lang) AS s FROM (SELECT DISTINCT lang FROM documents)) SELECT conv_id, turn, md5('Categories: ' || s || chr(10) || 'Text: ' || text || chr(10) || 'Which category fits best?') AS prompt_md5 FROM conversations, l")
def prompt_render(spark, d):
    names = F.broadcast(docs(spark, d).agg(F.array_sort(F.collect_set("label")).alias("names")))  # a class list
    return table(spark, d, "conversations").crossJoin(names).select("conv_id", "turn", F.md5(oracle.prompt(F.col("text"), F.col("names"))).alias("prompt_md5"))


@query("SELECT event_id, CASE WHEN (props->>'k')::INT BETWEEN 10 AND 49 THEN props->>'k' END AS label FROM events")
def answer_validate(spark, d):
    allowed = F.array(*[F.lit(str(i)) for i in range(10, 50)])
    return table(spark, d, "events").select("event_id", oracle.valid_answer(F.col("props"), allowed, "k", "k STRING").alias("label"))
