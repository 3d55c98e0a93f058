"""DuckDB SQL for the queries that SQL can express: other ways to the same rows."""

from __future__ import annotations

from .licenses import as_regex, mandatory, parse
from .notices import NOTICES, PHRASES

# Sizes, targets by water level, and the documents below each source's hash threshold, found here by sorting hashes.
OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS place
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
             source_size * 2.0::DOUBLE AS most FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER a, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER a, 0)) AS ratio
      FROM w WINDOW a AS (ORDER BY most / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT arg_min(ratio, most / weight) AS level FROM l WHERE ratio <= most / weight),
t AS (SELECT source, source_size, coalesce(least(most, level * weight), most) AS target FROM l, level),
p AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2) ELSE 0 END AS whole FROM t),
h AS (SELECT source, place, sum(size) AS words FROM d GROUP BY source, place),
c AS (SELECT h.source, place, words, sum(words) OVER (PARTITION BY h.source ORDER BY place) AS upto, greatest(target - whole * source_size, 0) AS budget
      FROM h JOIN p ON h.source IS NOT DISTINCT FROM p.source),
f AS (SELECT source, min(place) AS edge, arg_min(upto - budget < budget - (upto - words), place) AS with_edge FROM c WHERE upto > budget AND budget > 0 GROUP BY source)
SELECT d.doc_id, d.size, p.source_size, p.target,
       (d.size * (p.whole + CASE WHEN d.place < f.edge OR (d.place = f.edge AND f.with_edge) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN f ON d.source IS NOT DISTINCT FROM f.source
"""

# Every 50-byte string of every document, in blocks so that no substring is far from its start.
OP9_SQL = r"""
WITH h AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
b AS (SELECT r, doc_id, k.unnest * 1000 AS base, substr(x, (k.unnest * 2000 + 1)::BIGINT, 2098) AS y FROM h, unnest(range((n + 999) // 1000)) k),
s AS (SELECT r, coalesce(doc_id, 9223372036854775807) AS doc_id, base + p.unnest AS p, md5_number(substr(y, (p.unnest * 2 + 1)::BIGINT, 100)) AS w FROM b, unnest(range(length(y) // 2 - 49)) p),
f AS (SELECT w, min(doc_id) AS f FROM s GROUP BY w HAVING min(doc_id) < max(doc_id)),
g AS (SELECT r, p, CASE WHEN p > lag(p) OVER (PARTITION BY r ORDER BY p) + 50 THEN 1 ELSE 0 END AS fresh FROM s JOIN f USING (w) WHERE doc_id > f),
i AS (SELECT r, p, sum(fresh) OVER (PARTITION BY r ORDER BY p) AS span FROM g),
c AS (SELECT r, min(p) AS a, max(p) + 50 AS z FROM i GROUP BY r, span),
k AS (SELECT c.r, a, z, substr(x, (2 * coalesce(lag(z) OVER w, 0) + 1)::BIGINT, (2 * (a - coalesce(lag(z) OVER w, 0)))::BIGINT) AS before, CASE WHEN lead(a) OVER w IS NULL THEN substr(x, (2 * z + 1)::BIGINT) ELSE '' END AS after FROM c JOIN h USING (r) WINDOW w AS (PARTITION BY c.r ORDER BY a)),
o AS (SELECT r, sum(z - a) AS removed, count(*) AS spans, string_agg(before || after, '' ORDER BY a) AS kept FROM k GROUP BY r)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM h LEFT JOIN o USING (r)
"""


def _sketches(name: str, rows: str, values: str) -> str:
    """Exact quantiles by (lang, source), by lang, and of all; groups of under 50 rows are left out."""
    return f"""
{name}_g AS (SELECT lang, source, {values} FROM {rows} GROUP BY lang, source HAVING count(*) >= 50),
{name}_l AS (SELECT lang, {values} FROM {rows} GROUP BY lang HAVING count(*) >= 50),
{name}_a AS (SELECT {values} FROM {rows})"""


def _quantiles(rate: str, *shares: float) -> str:
    return "[" + ", ".join(f"list_sort(list({rate}))[greatest(ceil({q} * count(*)), 1)::INT]" for q in shares) + "]"


def _above(n: str, size: str, fence: str, unit: str = "1.0::DOUBLE") -> str:
    return f"coalesce({n} > greatest({fence}, 0) * {size} + 3 * sqrt({unit} * (greatest({fence}, 0) * {size} + {unit})), false)"


def _below(n: str, size: str, fence: str) -> str:
    return f"coalesce({n} < greatest({fence}, 0) * {size} - 3 * sqrt(greatest({fence}, 0) * {size} + 1), false)"


def _with_sketches(rows: str, name: str) -> str:
    return f"FROM {rows} x LEFT JOIN {name}_g g ON x.lang IS NOT DISTINCT FROM g.lang AND x.source IS NOT DISTINCT FROM g.source LEFT JOIN {name}_l l ON x.lang IS NOT DISTINCT FROM l.lang CROSS JOIN {name}_a a"


def _rules_sql() -> str:
    rates = {"symbols": ("n_symbols", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words")}
    own = "coalesce(g.q, l.q, a.q)"
    spread = f"greatest({own}[2] - {own}[1], i.w)"
    odd = f"{_above('word_chars', 'n_words', f'{own}[2] + 3 * {spread}')} OR {_below('word_chars', 'n_words', f'{own}[1] - 3 * {spread}')}"
    tails = ", ".join(f"{_quantiles(f'{n}::DOUBLE / greatest({s}, 1)', 0.5, 0.95)} AS {k}" for k, (n, s) in rates.items())
    beyond = lambda q: f"(2 * {q}[2] - {q}[1])"
    fence = lambda k: f"least({beyond(f'coalesce(g.{k}, l.{k}, a.{k})')}, {beyond(f'a.{k}')})"
    unit = "greatest(x.n_words::DOUBLE / greatest(x.n_lines, 1), 1.0::DOUBLE)"
    failed = ", ".join(f"CASE WHEN {_above('x.' + n, 'x.' + s, fence(k), unit if k == 'repeats' else '1.0::DOUBLE')} THEN '{k}' END" for k, (n, s) in rates.items())
    reasons = f"list_filter([{failed}, CASE WHEN odd THEN 'word_length' END], lambda v: v IS NOT NULL)"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
e AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
w3 AS (SELECT r, i.unnest AS i, [w[i.unnest], w[i.unnest + 1], w[i.unnest + 2]] AS g FROM d, unnest(range(1, len(w) - 1)) i),
w2 AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM w3) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + j.unnest) AS n FROM w2, unnest([0, 1, 2]) j GROUP BY r),
m AS (SELECT e.r, doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words FROM e LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
ok AS (SELECT * FROM b WHERE NOT base_failed), {_sketches('s', 'ok', _quantiles('word_chars::DOUBLE / greatest(n_words, 1)', 0.25, 0.75) + ' AS q')},
z AS (SELECT x.*, {odd} AS odd {_with_sketches('b', 's')} LEFT JOIN (SELECT lang, list_sort(list(q[2] - q[1]))[greatest(ceil(0.5 * count(*)), 1)::INT] AS w FROM s_g GROUP BY lang) i ON x.lang IS NOT DISTINCT FROM i.lang),
fine AS (SELECT * FROM z WHERE NOT base_failed AND NOT odd), {_sketches('t', 'fine', tails)},
v AS (SELECT x.*, {reasons} AS why {_with_sketches('z', 't')})
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND len(why) = 0 AS kept, array_to_string(why, ',') AS reasons FROM v
"""


# Ranks in sorted lists in place of sketches, which have every row of groups of some thousands.
OP10_SQL = _rules_sql()


def _codes_sql(rounds: int = 4) -> str:
    """All distances to all entries, as one number with the entry's place: its least one is the nearest entry, ties to the lower."""
    nearest = lambda name, book: f"""
{name} AS MATERIALIZED (SELECT r, part, any_value(p.x) AS x, min(((list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, b.x) + list_inner_product(b.x, b.x))::BIGINT * 256 + b.entry)) AS best
  FROM p JOIN {book} b USING (part) GROUP BY r, part)"""  # noqa: E731
    steps = []
    for k in range(rounds):
        steps.append(nearest(f"a{k}", f"b{k}"))
        steps.append(f"""
c{k} AS (SELECT part, best % 256 AS entry, i.unnest AS i, sum(x[i.unnest])::BIGINT AS s, count(*) AS n FROM a{k}, w, unnest(range(1, w.w + 1)) i GROUP BY ALL),
m{k} AS (SELECT part, entry, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY i) AS x FROM c{k} GROUP BY part, entry),
b{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN m{k} m USING (part, entry))""")
    return f"""
WITH f AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
w AS MATERIALIZED (SELECT len(v) // 4 AS w, len(v) AS n FROM f ORDER BY vec_id NULLS LAST, v LIMIT 1),
k AS MATERIALIZED (SELECT f.*, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS place FROM f, w WHERE len(v) = n),
p AS MATERIALIZED (SELECT r, place, q.unnest AS part, list_slice(v, q.unnest * w + 1, q.unnest * w + w)::DOUBLE[] AS x FROM k, w, unnest(range(4)) q),
b0 AS MATERIALIZED (SELECT part, place AS entry, x FROM p WHERE place < 256),{",".join(steps)},{nearest("z", f"b{rounds}")},
e AS (SELECT r, string_agg(format('{{:02x}}', best % 256), '' ORDER BY part) AS code, sum(best // 256)::BIGINT AS error FROM z GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda v: v::BIGINT), ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM f LEFT JOIN e USING (r), h
"""


OP11_SQL = _codes_sql()


def _licenses_sql() -> str:
    """Templates as regular expressions over the words, each followed by a space."""
    named = lambda label, m, found: f"CASE WHEN {found} THEN {{'label': '{label}', 'm': {m}}} END"
    at = [f"list_filter(range(len(w)), lambda i: {' AND '.join(f'''w[i + {k}] = '{x}' ''' for k, x in enumerate(phrase.split(), 1))})" for _, phrase in PHRASES]
    base = [named(label, len(phrase.split()), f"len(p{k}) > 0") for k, (label, phrase) in enumerate(PHRASES)]
    more = [named(label, mandatory(tree), f"regexp_matches(s, ' {as_regex(tree)}')") for label, tree in ((label, parse(markup)) for label, markup in NOTICES)]
    whole = lambda items: f"list_filter([{', '.join(items)}], lambda v: v IS NOT NULL)"
    names = lambda found: f"array_to_string(list_sort(list_distinct(list_transform({found}, lambda v: v.label))), ',')"
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n_words, ' ' || array_to_string(w, ' ') || ' ' AS s, {', '.join(f'{a} AS p{k}' for k, a in enumerate(at))} FROM d),
f AS (SELECT doc_id, n_words, flatten([{', '.join(f'p{k}' for k in range(len(at)))}]) AS places, {whole(base)} AS base, {whole(more)} AS more FROM p)
SELECT doc_id, n_words::BIGINT AS n_words, len(places)::BIGINT AS n_base, list_min(places)::BIGINT AS first_word, list_max(places)::BIGINT AS last_word, {names('base')} AS base_labels, {names('list_concat(base, more)')} AS labels,
       coalesce(list_max(list_transform(list_concat(base, more), lambda v: v.m / (v.m + 4.0::DOUBLE))), 0.0::DOUBLE) AS score FROM f
"""


OP12_SQL = _licenses_sql()


def _variants_sql() -> str:
    """Near words by what is left of both without one letter: of equal lengths at the same place, else the shorter itself."""
    table = []
    for c in range(16):  # checksums of half a byte
        for _ in range(4):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    half = lambda c: f"xor(([{', '.join(f'{x}::BIGINT' for x in table)}])[({c} & 15) + 1], {c} >> 4)"
    return f"""
WITH RECURSIVE o AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
g AS (SELECT doc_id, run, count(*) AS n FROM o WHERE length(run) >= 6 GROUP BY doc_id, run),
y AS (SELECT *, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x)::BIGINT - 64] END)) AS bytes FROM g),
h AS (SELECT run, n, xor(list_reduce(bytes, lambda c, b: {half(half('xor(c, b)'))}, 4294967295::BIGINT), 4294967295::BIGINT) AS h FROM y),
l AS (SELECT n, CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h),
v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM l WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
s AS MATERIALIZED (SELECT word, n, length(word) AS size, i.unnest AS i, substr(word, 1, i.unnest) || substr(word, i.unnest + 2) AS less FROM v, unnest(range(length(word))) i),
near AS (SELECT a.word, b.word AS near, b.n AS near_n FROM s a JOIN s b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION SELECT s.word, v.word, v.n FROM s JOIN v ON s.less = v.word UNION SELECT v.word, s.word, s.n FROM s JOIN v ON s.less = v.word),
c AS (SELECT word, count(*) AS n_near, max(near_n) AS most FROM near GROUP BY word),
t AS (SELECT c.word, n_near, most, min(near) AS near FROM c JOIN near ON near.word = c.word AND near.near_n = c.most GROUP BY ALL),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 5 * v.n THEN near END AS form, CASE WHEN most >= 5 * v.n THEN most END AS form_n FROM v LEFT JOIN t USING (word)),
r AS (SELECT word, word AS at, form AS further FROM f UNION ALL SELECT r.word, f.word, f.form FROM r JOIN f ON f.word = r.further)
SELECT f.word, f.form, r.at AS root, f.n, f.n_near, f.form_n FROM f JOIN r ON r.word = f.word AND r.further IS NULL
"""


OP13_SQL = _variants_sql()
