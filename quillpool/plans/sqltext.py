"""SQL (DuckDB) for what the queries compute, as pieces of WITH clauses."""

from __future__ import annotations

DOCS = "docs AS (SELECT doc_id AS row_id, text, lang AS label FROM documents)"
EVENTS = "ev AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS iteration, value / 500 AS v FROM events)"


def draw(seed, *ids: str) -> str:
    return f"md5('{seed}-' || {" || '-' || ".join(f'{i}::VARCHAR' for i in ids)})"


def draw_int(n: str, seed, *ids: str) -> str:
    return f"(('0x' || substr({draw(seed, *ids)}, 1, 8))::BIGINT % ({n}))"


def fold(x: str) -> str:
    return rf"regexp_replace(strip_accents(lower({x})), '[^\x00-\x7F]', '', 'g')"


def tokens(x: str) -> str:
    return f"regexp_extract_all({fold(x)}, '[a-z0-9_]+')"


def first(name: str, rows: str, n: int, seed=42, by: str | None = None) -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"{name} AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER ({part}ORDER BY {draw(seed, 'row_id')}, row_id) AS rn FROM {rows}) WHERE rn <= {n})"


L0 = first("l0", "docs", 10, 42, "label")


def terms(name: str, source: str, key: str, low: int, high: int) -> str:
    """(key, term, tf) of (key, t)."""
    runs = []
    for n in range(low, high + 1):
        run = "t" if n == 1 else f"list_transform(range(1, len(t) - {n - 2}), lambda i: {" || ' ' || ".join(f't[i + {k}]' for k in range(n))})"
        runs.append(f"SELECT {key}, unnest({run}) AS term FROM {source}")
    return f"{name} AS (SELECT {key}, term, count(*) AS tf FROM ({' UNION ALL '.join(runs)}) GROUP BY ALL)"


def class_terms(name: str, train: str, low: int, high: int) -> str:
    return f"{name}_t AS (SELECT label, {tokens("string_agg(text, ' ' ORDER BY row_id)")} AS t FROM {train} GROUP BY label), {terms(name, name + '_t', 'label', low, high)}"


def row_terms(name: str, rows: str, low: int, high: int) -> str:
    return f"{name}_t AS (SELECT row_id, {tokens('text')} AS t FROM {rows}), {terms(name, name + '_t', 'row_id', low, high)}"


def weighted(name: str, source: str, key: str, vocabulary: str, n: str, kind: str, norm: str | None, documents: bool) -> str:
    tf = {"binary": "1.0::DOUBLE", "tfsmooth": "1 + ln(tf)"}.get(kind, "tf::DOUBLE")
    idf = {"tfidf": f"ln({n}::DOUBLE / df)" + ("" if documents else " + 1"), "tfidfscikit": f"ln((1.0::DOUBLE + {n}) / (1.0::DOUBLE + df)) + 1"}.get(kind, "1.0::DOUBLE")
    raw = f"SELECT {key}, term, ({tf}) * ({idf}) AS weight FROM {source} JOIN {vocabulary} USING (term)"
    if norm is None:
        return f"{name} AS ({raw})"
    total = f"sum(abs(weight)) OVER (PARTITION BY {key})" if norm == "l1" else f"sqrt(sum(weight * weight) OVER (PARTITION BY {key}))"
    return f"{name} AS (SELECT {key}, term, CASE WHEN z > 0 THEN weight / z ELSE weight END AS weight FROM (SELECT *, {total} AS z FROM ({raw})))"


def model(tag: str, train: str, rows: str, method: str = "binary", query: str = "binary", norm: str | None = None, query_norm: str | None = None, low: int = 1, high: int = 2) -> str:
    """Tables tag_a, tag_q (weights), tag_d (row_id, label, score, proba: dense) and tag_p (row_id, predicted)."""
    n = f"(SELECT count(DISTINCT label) FROM {train})"
    return ", ".join(
        [
            class_terms(f"{tag}_c", train, low, high), row_terms(f"{tag}_r", rows, low, high), f"{tag}_v AS (SELECT term, count(*) AS df FROM {tag}_c GROUP BY term)",
            weighted(f"{tag}_a", f"{tag}_c", "label", f"{tag}_v", n, method, norm, True), weighted(f"{tag}_q", f"{tag}_r", "row_id", f"{tag}_v", n, query, query_norm, False),
            f"{tag}_s AS (SELECT q.row_id, a.label, round(sum(a.weight * q.weight), 9) AS score FROM {tag}_q q JOIN {tag}_a a USING (term) GROUP BY ALL)",
            f"{tag}_e AS (SELECT r.row_id, l.label, coalesce(s.score, 0) AS score FROM {rows} r CROSS JOIN (SELECT DISTINCT label FROM {train}) l LEFT JOIN {tag}_s s ON s.row_id = r.row_id AND s.label = l.label)",
            f"{tag}_x AS (SELECT *, exp(score - max(score) OVER (PARTITION BY row_id)) AS e FROM {tag}_e)",
            f"{tag}_d AS (SELECT row_id, label, score, e / sum(e) OVER (PARTITION BY row_id) AS proba FROM {tag}_x)",
            f"{tag}_p AS (SELECT row_id, first(label ORDER BY score DESC, label) AS predicted FROM {tag}_e GROUP BY row_id)",
        ]
    )


def uncertainty(name: str, dense: str) -> str:
    """(row_id, entropy, confidence, margin), rounded."""
    q = "least(greatest(proba, 1e-9), 1 - 1e-9)"
    return f"{name} AS (SELECT row_id, round(-sum({q} * log2({q})), 6) AS entropy, round(max(proba), 6) AS confidence, round(max(proba) - CASE WHEN count(*) > 1 THEN list_sort(list(proba), 'DESC')[2] END, 6) AS margin FROM {dense} GROUP BY row_id)"


def per_class(name: str, pairs: str, labels: str) -> str:
    return f"""{name} AS (SELECT label, tp, support, predicted, CASE WHEN support + predicted > 0 THEN 2.0::DOUBLE * tp / (support + predicted) ELSE 0 END AS f1 FROM (
        SELECT l.label, (SELECT count(*) FROM {pairs} p WHERE p.label = l.label AND p.predicted = l.label) AS tp, (SELECT count(*) FROM {pairs} p WHERE p.label = l.label) AS support,
               (SELECT count(*) FROM {pairs} p WHERE p.predicted = l.label) AS predicted FROM {labels} l))"""


def held(name: str, rows: str, share: float, seed) -> str:
    """rows with `held`, by class."""
    return f"""{name}_n AS (SELECT label, count(*) AS n FROM {rows} GROUP BY label),
    {name}_b AS (SELECT *, floor({share} * n + 1e-9) AS base, round({share} * n - floor({share} * n + 1e-9), 9) AS rest FROM {name}_n),
    {name}_q AS (SELECT label, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, label) <= ceil({share} * sum(n) OVER () - 1e-9) - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM {name}_b),
    {name} AS (SELECT r.* EXCLUDE (rk), rk <= quota AS held FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {draw(seed, 'row_id')}, row_id) AS rk FROM {rows}) r JOIN {name}_q USING (label))"""


def normal_label(x: str) -> str:
    out = f"lower({x}::VARCHAR)"
    for letter, spelled in (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("þ", "th"), ("ø", "o"), ("đ", "d"), ("ł", "l")):
        out = f"replace({out}, '{letter}', '{spelled}')"
    return rf"trim(regexp_replace(regexp_replace(strip_accents({out}), '[^\x00-\x7F]', '', 'g'), '\s+', ' ', 'g'))"


def prepared(share_held: float = 0.5, seed=42) -> str:
    return f"clean AS (SELECT row_id, text, {normal_label('label')} AS label FROM docs WHERE text IS NOT NULL AND label IS NOT NULL), {held('pu', 'clean', share_held, seed)}"


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "
