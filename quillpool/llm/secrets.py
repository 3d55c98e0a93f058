"""Secret scans: base patterns, plus multipart credential linking.

The base kinds (assign, access, hex) are reported wherever they match. Weak candidates (an account name or short access
id, a mixed-case token, an endpoint) are common in clean text, so they are reported only if the parts that complete them
lie in the same scope: at most `scope` code points away in the same document, without a character in common. An
identifier needs a secret, a secret needs an identifier, an endpoint needs one of each that do not overlap one another.
The interval join is a sweep over the places where a document's spans begin and end. A frame of `scope` places before a
span holds the ends of what lies left of it, one after it the starts of what lies right of it; extreme ends and starts in
a frame say whether a complement is there, and whether two that do not overlap are. So the cost follows the number of
spans and `scope`, never the number of pairs.

Everything is DataFrame expressions. Texts stay in the scan: what is shuffled is one small array a document.

Defined results: a null text counts as empty; an empty text has no spans (base_sha256 is that of the empty string);
repeated rows are scanned once and returned as often as they came; a null doc_id is an ordinary key; further columns are
ignored by `secret_spans` and passed through by `redact`, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .names import free_names, own

# fixed values: the base patterns, in the order in which kinds are listed
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a run of AKIA[A-Z0-9]+ of 20 or more characters
HEX = r"[0-9a-f]{24,}"  # a run of [0-9a-f]+ of 24 or more characters

# weak candidates: meaningless alone
WEAK_ACCESS = r"""\b(?:A(?:KIA|SIA|ROA|IDA)[A-Z0-9]{8,15}(?![A-Z0-9])|(?i:user(?:name)?|login|client_?id|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,})"""
WEAK_SECRET = r"[A-Za-z0-9+/_-]{20,}={0,2}"
ENDPOINT = r"""\b(?:https?|s?ftp|s3|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\x20\x09-\x0D"'<>]+"""

KINDS = ("assign", "access", "hex", "weak_access", "weak_secret", "endpoint")
BASE = 3
SECRETS, IDENTIFIERS = ("assign", "hex", "weak_secret"), ("access", "weak_access")


def _found(text: Column, kind: int, pattern: str, group: int | None = None, needs: Column | None = None) -> Column:
    """array<struct<kind, idx, gap, len, ok>>: every match, with the code points between it and the one before."""
    gaps = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    kept = F.lit(True)
    if group is not None:
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        matches = F.zip_with(matches, values, lambda m, v: F.struct(F.length(m).alias("len"), (F.length(v) >= 6).alias("ok")))
    elif kind == KINDS.index("weak_secret"):
        mixed = lambda m: m.rlike("[0-9]") & m.rlike("[a-z]") & m.rlike("[A-Z]")
        matches = F.transform(matches, lambda m: F.struct(F.length(m).alias("len"), mixed(m).alias("ok")))
    else:
        matches = F.transform(matches, lambda m: F.struct(F.length(m).alias("len"), kept.alias("ok")))
    pairs = F.zip_with(gaps, matches, lambda g, m: F.struct(F.length(g).alias("gap"), m["len"].alias("len"), m["ok"].alias("ok")))
    pairs = F.filter(pairs, lambda p: p["len"].isNotNull())
    spans = F.transform(pairs, lambda p, i: F.struct(F.lit(kind).alias("kind"), i.alias("idx"), p["gap"].alias("gap"), p["len"].alias("len"), p["ok"].alias("ok")))
    return spans if needs is None else F.when(needs, spans).otherwise(F.array().cast("array<struct<kind:int,idx:int,gap:int,len:int,ok:boolean>>"))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text")).withColumn("text_key", F.xxhash64("text"))


def secret_spans(docs: DataFrame, scope: int = 400) -> DataFrame:
    """(doc_id, text_key, copies, spans array<struct<start, kind, end>>): one row for each different (doc_id, text)."""
    keyed = _keyed(docs)
    text = F.col("text")
    found = F.concat(
        _found(text, 0, ASSIGN, group=2, needs=text.rlike("[:=]")),
        _found(text, 1, ACCESS, needs=F.contains(text, F.lit("AKIA"))),
        _found(text, 2, HEX),
        _found(text, 3, WEAK_ACCESS, needs=text.rlike(r"[:=]|A(?:KIA|SIA|ROA|IDA)")),
        _found(text, 4, WEAK_SECRET),
        _found(text, 5, ENDPOINT, needs=F.contains(text, F.lit("://"))),
    )
    # one exchange: all that follows is by the same two columns
    each = keyed.select("doc_id", "text_key", found.alias("found")).groupBy("doc_id", "text_key").agg(F.any_value("found").alias("found"), F.count("*").alias("copies"))
    rows = each.select("doc_id", "text_key", "copies", F.explode_outer("found").alias("s")).select("doc_id", "text_key", "copies", "s.*")
    doc = ["doc_id", "text_key"]
    start = F.sum(F.col("gap") + F.col("len")).over(Window.partitionBy(*doc, "kind").orderBy("idx")) - F.col("len")
    rows = rows.withColumn("start", start.cast("long")).withColumn("end", F.col("start") + F.col("len"))
    # a failed match only counts towards the others' places; it stays as a row that keeps the document
    rows = rows.withColumn("kind", F.when(F.col("ok"), F.col("kind")))
    place = lambda at, opens: F.struct(F.when(F.col("kind").isNotNull(), F.col(at)).alias("at"), F.lit(opens).alias("opens"))
    events = F.when(F.col("kind").isNull(), F.array(place("start", 1))).otherwise(F.array(place("end", 0), place("start", 1)))
    rows = rows.select(*doc, "copies", "kind", "start", "end", F.explode(events).alias("e")).select(*doc, "copies", "kind", "start", "end", "e.at", "e.opens")

    base, opens, closes = F.col("kind") < BASE, F.col("opens") == 1, F.col("opens") == 0
    # at equal places ends come before starts, and base kinds before others
    so_far = Window.partitionBy(*doc).orderBy("at", "opens", "kind", "end").rowsBetween(Window.unboundedPreceding, -1)
    begun = F.coalesce(F.sum(F.when(base & opens, 1)).over(so_far), F.lit(0))
    ended = F.coalesce(F.sum(F.when(base & closes, 1)).over(so_far), F.lit(0))
    rows = rows.withColumn("begun", begun).withColumn("ended", ended)

    around = Window.partitionBy(*doc).orderBy("at")
    frames = {"l": (around.rangeBetween(-scope, 0), closes), "r": (around.rangeBetween(0, scope), opens)}
    kinds = {"secret": F.col("kind").isin([KINDS.index(k) for k in SECRETS]), "id": F.col("kind").isin([KINDS.index(k) for k in IDENTIFIERS])}
    seen = []
    for side, (frame, edge) in frames.items():
        for name, of in kinds.items():
            seen.append(F.min(F.when(of & edge, F.col("end"))).over(frame).alias(f"{side}_{name}_end"))
            seen.append(F.max(F.when(of & edge, F.col("start"))).over(frame).alias(f"{side}_{name}_start"))
    rows = rows.select("*", *seen)
    # what lies left is seen where a span begins, what lies right where it ends
    at = {"l": opens, "r": closes}
    sides = [F.max(F.when(at[side], F.col(f"{side}_{name}_{x}"))).alias(f"{side}_{name}_{x}") for side in at for name in kinds for x in ("end", "start")]
    counted = [F.max(F.when(opens, F.col("begun") - F.col("ended"))).alias("open"), F.max(F.when(opens, F.col("begun"))).alias("before"), F.max(F.when(closes, F.col("begun"))).alias("after")]
    rows = rows.groupBy(*doc, "kind", "start", "end").agg(F.max("copies").alias("copies"), *sides, *counted)
    there = lambda side, name: F.col(f"{side}_{name}_end").isNotNull()
    apart = lambda side: (F.col(f"{side}_secret_end") <= F.col(f"{side}_id_start")) | (F.col(f"{side}_id_end") <= F.col(f"{side}_secret_start"))
    no = F.lit(False)
    near_secret, near_id = there("l", "secret") | there("r", "secret"), there("l", "id") | there("r", "id")
    both = (there("l", "secret") & there("r", "id")) | (there("l", "id") & there("r", "secret")) | F.coalesce(apart("l"), no) | F.coalesce(apart("r"), no)
    linked = F.when(F.col("kind") == 3, near_secret).when(F.col("kind") == 4, near_id).otherwise(both)
    # overlapped by a base span that began before it, with it, or inside it
    inside = (F.col("open") > 0) | (F.col("after") - F.col("before") > 0)
    keep = base | (linked & ~F.coalesce(inside, no))
    span = F.when(keep, F.struct("start", "kind", "end"))
    return rows.groupBy(*doc).agg(F.max("copies").alias("copies"), F.array_sort(F.collect_list(span)).alias("spans"))


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def digest(docs: DataFrame, scope: int = 400) -> DataFrame:
    """One row for each row of docs: counts of the base kinds, a hash of the base spans, and all spans as text."""
    found = secret_spans(docs, scope)
    base = F.filter("spans", lambda s: s["kind"] < BASE)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    out = found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["kind"] >= BASE)).cast("long").alias("n_linked"), "copies",
    )
    return out.select(*[c for c in out.columns if c != "copies"], F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")


def redact(docs: DataFrame, scope: int = 400, mark: str = "[secret]", broadcast_spans: int = 1_000_000) -> DataFrame:
    """docs with every reported span replaced by `mark` (overlapping spans by one); n_chars, where there is one, follows."""
    of, id_, key, runs = free_names(docs, 4)
    found = secret_spans(docs, scope).where(F.size("spans") > 0)
    # runs of overlapping spans, as (start, end)
    joined = F.aggregate(
        F.col("spans"),
        F.array().cast("array<struct<start:bigint,end:bigint>>"),
        lambda a, s: F.when(
            (F.size(a) > 0) & (F.element_at(a, -1)["end"] >= s["start"]),
            F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(F.element_at(a, -1)["start"].alias("start"), F.greatest(F.element_at(a, -1)["end"], s["end"]).alias("end")))),
        ).otherwise(F.concat(a, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))),
    )
    found = cut(found.select(F.col("doc_id").alias(id_), F.col("text_key").alias(key), joined.alias(runs)))
    total = found.agg(F.coalesce(F.sum(F.size(runs) + 1), F.lit(0))).first()[0]
    found = F.broadcast(found) if total <= broadcast_spans else found
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(of) == F.col(key))
    out = docs.withColumn(of, F.xxhash64(F.coalesce("text", F.lit("")))).join(found, same, "left")
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(runs, lambda r: r["end"]))
    starts = F.concat(F.transform(runs, lambda r: r["start"]), F.array(F.length("text").cast("long")))
    parts = F.transform(F.arrays_zip(ends.alias("e"), starts.alias("s")), lambda z: F.substring(F.col("text"), (z["e"] + 1).cast("int"), (z["s"] - z["e"]).cast("int")))
    if "n_chars" in docs.columns:
        # of what the cleaned text will be
        rest = F.aggregate(F.col(runs), F.length("text").cast("long"), lambda n, r: n - (r["end"] - r["start"]) + len(mark))
        out = out.withColumn("n_chars", F.when(F.col(runs).isNull(), F.col("n_chars")).otherwise(rest))
    out = out.withColumn("text", F.when(F.col(runs).isNull(), F.col("text")).otherwise(F.array_join(parts, mark)))
    return out.select(*own(docs))
