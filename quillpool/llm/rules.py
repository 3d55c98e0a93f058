"""Quality rules with thresholds that adapt to each language and source.

One native pass turns a text into counts. Quantile sketches (Greenwald-Khanna summaries, merged map-side and again over
the shuffle) of the rates give each (lang, source) its own fences, in two rounds:

1. mean word length lies within FAR times the distance between the quartiles, that of the group or the median of those of
   its language's groups, whichever is more (a group may be largely copies of one text);
2. of the documents that pass this, the median and the 95th percentile of each other rate give a fence as far beyond the
   percentile as that is beyond the median. It is bound by the same fence of all documents, so that a group that is
   largely junk does not set its own measure.

No fence has a fixed slack. A rate is a count over a size, so a document fails where its count lies more than ERRORS
standard errors (of a count, which is its square root) beyond what the fence allows for its size: short documents need
more evidence. Repeated words come by lines, so they count in units of the words that a line of the document has. The fences are joined back; where a group has under `min_rows` documents, those of its language, then those
of all documents hold.

Defined results: a null or empty text has zero counts and base_failed (under 50 words); null lang or source are groups
of their own; repeated rows are judged each; further columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

# fixed values: the word and symbol classes
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
BLANKS = " \t\n\x0b\x0c\r"


def words_of(text: Column) -> Column:
    """Runs of anything but space and tab to carriage return; empty for null and blank texts."""
    inner = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(inner) > 0, F.split(inner, SPACE)).otherwise(F.array().cast("array<string>"))


def _repeated_words(grams: Column, words: Column) -> Column:
    """Words inside windows that occur twice or more; grams[i] is a hash of the i-th window.

    Sorted (hash, position) pairs put equal windows side by side, so the work is n log n however often one repeats; of
    neighbours with one hash the words are compared.
    """
    same = lambda x, y: (x["g"] == y["g"]) & (F.slice(words, x["i"] + 1, 3) == F.slice(words, y["i"] + 1, 3))
    pairs = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    linked = F.transform(
        F.arrays_zip(pairs.alias("p"), F.concat(F.array(F.lit(None).cast("struct<g:bigint,i:int>")), F.slice(pairs, 1, F.size(grams) - 1)).alias("b"), F.concat(F.slice(pairs, 2, F.size(grams)), F.array(F.lit(None).cast("struct<g:bigint,i:int>"))).alias("a")),
        lambda z: F.when(same(z["p"], z["b"]) | same(z["p"], z["a"]), z["p"]["i"]),
    )
    at = F.sort_array(F.array_compact(linked))
    # each position covers three words, less where the next one starts sooner
    return F.aggregate(at, F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")), lambda s, x: F.struct(x.alias("last"), (s["n"] + F.least(F.lit(3), x - s["last"])).cast("long").alias("n")), lambda s: s["n"])


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base counts of each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    first = docs.select("doc_id", "lang", "source", text.alias("text")).select("doc_id", "lang", "source", "text", words_of(F.col("text")).alias("w"))
    n = F.size("w")
    grams = F.when(n >= 3, F.zip_with(F.zip_with(F.slice("w", 1, n - 2), F.slice("w", 2, n - 2), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), F.slice("w", 3, n - 2), lambda s, c: F.xxhash64(s["a"], s["b"], c))).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
    second = first.select(
        "doc_id", "lang", "source", n.cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"), lines.alias("lines"), grams.alias("grams"), "w",
    )
    third = second.withColumn("varied", F.size(F.array_distinct("grams")))
    return third.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols",
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("varied") == F.size("grams"), F.lit(0).cast("long")).otherwise(_repeated_words(F.col("grams"), F.col("w"))).alias("n_repeat_words"),
    )


#: Each rate: a count, and what it is a share of.
LENGTH = ("word_chars", "n_words")
RATES = {"symbols": ("n_symbols", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words")}
UNITS = {"repeats": "greatest(n_words / greatest(n_lines, 1), 1.0D)"}  # of others one
FAR, ERRORS, TAIL = 3.0, 3.0, 0.95


def _rate(count: str, size: str) -> Column:
    return F.col(count) / F.greatest(F.col(size), F.lit(1))


def _above(count: str, size: str, fence: Column, unit: str = "1.0D") -> Column:
    """Whether the count is surely more than the fence, a rate, allows; false where there is no fence. unit: what comes at once."""
    expected, unit = F.greatest(fence, F.lit(0.0)) * F.col(size), F.expr(unit)
    return F.coalesce(F.col(count) > expected + ERRORS * F.sqrt(unit * (expected + unit)), F.lit(False))


def _below(count: str, size: str, fence: Column) -> Column:
    expected = F.greatest(fence, F.lit(0.0)) * F.col(size)
    return F.coalesce(F.col(count) < expected - ERRORS * F.sqrt(expected + 1), F.lit(False))


def _with_groups(rows: DataFrame, measured: DataFrame, columns: dict[str, Column], min_rows: int, broadcast_rows: int) -> DataFrame:
    """rows with each sketch of their group (g_), their language (l_) and all documents (a_) of `measured`."""
    out = rows
    for tag, by in (("g", ["lang", "source"]), ("l", ["lang"]), ("a", [])):
        found = measured.groupBy(*by).agg(F.count("*").alias("n"), *[c.alias(f"{tag}_{name}") for name, c in columns.items()])
        if not by:
            out = out.join(F.broadcast(found.drop("n")), F.lit(True), "left")  # one row
            continue
        found = cut(found.where(F.col("n") >= min_rows).drop("n").withColumnsRenamed({c: f"{tag}_{c}" for c in by}))
        # a row for each group: broadcast while that is few, else an ordinary join, whose hot keys adaptive execution splits
        found = F.broadcast(found) if found.count() <= broadcast_rows else found
        on = [F.col(c).eqNullSafe(F.col(f"{tag}_{c}")) for c in by]
        out = out.join(found, on[0] if len(on) == 1 else on[0] & on[1], "left").drop(*[f"{tag}_{c}" for c in by])
    return out


def judge(docs: DataFrame, min_rows: int = 50, accuracy: int = 10_000, broadcast_rows: int = 20_000) -> DataFrame:
    """Base counts of each row, base_failed, kept, and `reasons`, the rates beyond their group's fences."""
    base = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    measured = cut(counts(docs).withColumn("base_failed", base))  # small rows; texts are read once
    sketch = lambda rate, *at: F.percentile_approx(_rate(*rate), F.array(*map(F.lit, at)), F.lit(accuracy))
    first = lambda name: F.coalesce(*[F.col(f"{tag}_{name}") for tag in "gla"])

    passed = measured.where("not base_failed")
    sized = _with_groups(measured, passed, {"length": sketch(LENGTH, 0.25, 0.75)}, min_rows, broadcast_rows)
    groups = passed.groupBy("lang", "source").agg(F.count("*").alias("n"), sketch(LENGTH, 0.25, 0.75).alias("q")).where(F.col("n") >= min_rows)
    usual = cut(groups.groupBy(F.col("lang").alias("i_lang")).agg(F.percentile_approx(F.col("q")[1] - F.col("q")[0], 0.5, F.lit(accuracy)).alias("i_spread")))
    sized = sized.join(F.broadcast(usual) if usual.count() <= broadcast_rows else usual, F.col("lang").eqNullSafe(F.col("i_lang")), "left")
    spread = F.greatest(first("length")[1] - first("length")[0], F.col("i_spread"))  # the latter is null without groups
    odd = _above(*LENGTH, first("length")[1] + FAR * spread) | _below(*LENGTH, first("length")[0] - FAR * spread)
    sized = cut(sized.withColumn("odd", odd).drop("g_length", "l_length", "a_length", "i_lang", "i_spread"))

    tails = {name: sketch(rate, 0.5, TAIL) for name, rate in RATES.items()}
    out = _with_groups(sized, sized.where("not base_failed and not odd"), tails, min_rows, broadcast_rows)
    fence = lambda c: 2 * c[1] - c[0]
    bad = [F.when(_above(*rate, F.least(fence(first(name)), fence(F.col(f"a_{name}"))), UNITS.get(name, "1.0D")), F.lit(name)) for name, rate in RATES.items()]
    reasons = F.array_compact(F.array(*bad, F.when(F.col("odd"), F.lit("word_length"))))
    counts_ = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return out.select("doc_id", "lang", "source", *counts_, (~F.col("base_failed") & (F.size(reasons) == 0)).alias("kept"), F.array_join(reasons, ",").alias("reasons"))
