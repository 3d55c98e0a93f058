"""URL filters: rules first, then logistic regression on hashed character n-grams of host and path.

The model is trained on a small labelled table (`train_rows` at most, those that hash lowest, each seen `epochs` times)
by stochastic gradient steps. Rules are inlined as an expression, longest first, so deciding a URL takes no join. N-grams are
taken of the characters and of their shape, in which runs of letters and of digits are one sign by kind and length, so that
joined words, numbers and the form of a path count as well.

What is labelled decides what is found. `labelled` reads a table, (url string, label int, 1 to block), or makes one from two
lists of words where none is given; n-grams know the words of the table and what shares letters or shape with them, and no
others. With a family of words left out of the made table, hosts of that family alone are found with recall 0 to 1, by how
much they resemble the rest (see README and the test of it).

Defined results: a null URL or one without "://" has empty host and path, so no rule fits and the model judges empty
strings (by its intercept); repeated rows are judged each; a URL of any length is judged whole; an empty labelled table
gives a model that allows all; further columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of hosts to block and to allow, from which the labelled table is made where none is given.
BLOCKED_WORDS = """
    adult sex xxx porn nude erotic escort camgirls casino poker bet betting slots gambling jackpot lottery roulette pills pharma
    viagra cialis drugs steroid replica fake counterfeit warez crack keygen torrent pirate malware phishing hack spam junk
    scam loan payday credit bitcoin ads advert adserver banner popup tracker tracking click clicks linkfarm seo backlinks
    prize winner win free cheap discount miracle weight
""".split()
ALLOWED_WORDS = """
    library news daily world garden docs project encyclopedia university physics weather books museum forum bikes city maps
    travel school science history music theatre river mountain kitchen recipes health hospital clinic research archive
    journal paper press radio sport football chess painting gallery photo letters language grammar code software data
    engine forest animals birds ocean climate energy transport railway airport hotel bakery coffee market farmers council
    parliament law justice charity church teacher student children family home design fashion fabric wood steel
""".split()
SITES = ("", "www.", "m.", "blog.")
DOMAINS = ("com", "net", "org", "test", "info")
PATHS = ("", "/", "/en/{n}", "/fr/{n}.html", "/de/{n}/", "/es/{n}?page=2", "/posts/{n}#top", "/item?id={n}", "/{n}")


ONSETS = "b c d f g h k l m n p r s t v w z th st tr ch sh br gl".split()
VOWELS = "a e i o u ea ou y".split()
CODAS = ["", "", "n", "r", "s", "t", "nd", "ng", "st", "th", "le", "ly"]


def labelled_rows(seed: int = 17, blocked: list[str] = BLOCKED_WORDS, allowed: list[str] = ALLOWED_WORDS) -> list[tuple[str, int]]:
    """(url, 1 to block): each word alone, joined with others of its kind, and beside invented names; and more of these.

    What stands around a word (site, domain, path) is drawn alike for both kinds, so that only words tell.
    """
    rng, pick = random.Random(seed), random.Random(seed).choice
    invented = lambda: "".join(pick(ONSETS) + pick(VOWELS) + pick(CODAS) for _ in range(rng.randint(1, 3)))
    out = []

    def add(name: str, label: int) -> None:
        host = f"{rng.choice(SITES)}{name}" + rng.choice(("", f".{invented()}")) + f".{rng.choice(DOMAINS)}"
        out.append((f"http://{host}{rng.choice(PATHS).format(n=rng.randint(1, 9999))}", label))

    for words, label, times in ((blocked, 1, 3), (allowed, 0, 1)):
        for word in words * times:
            for name in (word, f"{word}-{rng.choice(words)}", f"{rng.choice(words)}-{word}", f"{word}{rng.choice(words)}", f"{word}-{invented()}", f"{invented()}-{word}"):
                add(name, label)
    for _ in range(10 * len(allowed)):  # most hosts are names
        add(rng.choice((invented(), rng.choice(allowed) + invented(), invented() + invented())), 0)
    for _ in range(4 * len(allowed)):  # and joined names are none the worse for it
        add(rng.choice((f"{invented()}-{invented()}", f"{invented()}-{rng.choice(allowed)}")), 0)
    return out


def labelled(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(url string, label int): a Parquet, CSV (with a header) or JSON-lines table, by the file's extension, else the made one."""
    schema = "url string, label int"
    if path is None:
        return spark.createDataFrame(labelled_rows(), schema)
    kind = {"csv": "csv", "json": "json", "jsonl": "json", "parquet": "parquet"}.get(path.rstrip("/").rsplit(".", 1)[-1].lower())
    if kind is None:
        raise ValueError("a labelled table is a .parquet, .csv, .json or .jsonl file")
    return spark.read.format(kind).schema(schema).option("header", True).option("escape", '"').load(path)


def host_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ://, up to / ? # or the end, A-Z lower-cased. Path: from there up to ? # or the end."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def rule_of(rules: list[tuple[str, str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest (verdict, host, path) that fits the host or a domain above it, and starts the path."""
    name, verdict = [], []
    for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name.append(F.when(fits, F.lit(h + p)))
        verdict.append(F.when(fits, F.lit(v)))
    none = F.lit(None).cast("string")
    return F.coalesce(*name, none), F.coalesce(*verdict, none)


def grams(texts: list[str], low: int, high: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of low to high characters (code points) of each text, and how many each text has."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.uint64)
    doc = np.repeat(np.arange(len(texts)), size)
    last = np.repeat(np.cumsum(size), size) - np.arange(len(flat))  # characters from here to the text's end
    slots, owners = [], []
    h = np.zeros(len(flat), np.uint64)
    for n in range(1, high + 1):
        ahead = np.zeros(len(flat), np.uint64)
        if n <= len(flat):
            ahead[: len(flat) - n + 1] = flat[n - 1 :]
        h = h * np.uint64(0x100000001B3) + ahead + np.uint64(1)
        if n >= low:
            fits = last >= n
            mixed = (h[fits] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)) >> np.uint64(64 - bits)
            slots.append(mixed.astype(np.int64)), owners.append(doc[fits])
    slots, owners = np.concatenate(slots), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return slots[order], np.bincount(owners, minlength=len(texts))


RUNS = re.compile(r"([A-Za-z]+)|([0-9]+)|([^\x00-\x7f]+)")


def shape(text: str) -> str:
    """text with each run of letters, digits or other than ASCII as one sign, and how long it is, roughly."""

    def sign(m: re.Match) -> str:
        n = len(m[0])
        return ("a" if m[1] else "0" if m[2] else "u") + ("" if n == 1 else "2" if n <= 3 else "5" if n <= 6 else "9" if n <= 10 else "+")

    return RUNS.sub(sign, text)


def features(texts: list[str], low: int, high: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of each text's n-grams and of its shape's, as pairs (text's place, slot), different and in order."""
    slots, n = grams(texts, low, high, bits)
    other, m = grams([shape(t) for t in texts], low, high + 1, bits)
    owner = np.concatenate([np.repeat(np.arange(len(texts)), n), np.repeat(np.arange(len(texts)), m)])
    pairs = np.unique((owner << bits) + np.concatenate([slots, other ^ (0x5A5A & ((1 << bits) - 1))]))
    return pairs >> bits, pairs & ((1 << bits) - 1)


def _parts(hosts: list[str], paths: list[str]) -> list[str]:
    return [f"^{h}$|{p}" if h or p else "" for h, p in zip(hosts, paths)]


def train(table: DataFrame, bits: int = 16, low: int = 3, high: int = 5, train_rows: int = 4000, epochs: int = 30, rate: float = 2.0, decay: float = 1e-4) -> np.ndarray:
    """Weights, the intercept last, from (url, label), label 1 to block."""
    host, path = host_path(F.col("url"))
    rows = table.where("url is not null and label is not null").select(host.alias("host"), path.alias("path"), F.col("label").cast("int").alias("label"), F.xxhash64("url").alias("key"))
    got = rows.orderBy("key", "label", "host", "path").limit(train_rows).collect()  # bounded by train_rows
    w = np.zeros((1 << bits) + 1)
    owner, slots = features(_parts([r.host for r in got], [r.path for r in got]), low, high, bits)
    n = np.bincount(owner, minlength=len(got))
    data = [(slots[e - k : e], r.label) for e, k, r in zip(np.cumsum(n), n, got) if k]
    rng = np.random.default_rng(5)
    for epoch in range(epochs):
        for i in rng.permutation(len(data)):
            at, y = data[i]
            x = 1 / np.sqrt(len(at))
            p = 1 / (1 + np.exp(-(w[at].sum() * x + w[-1])))
            step = rate / (1 + epoch / 5) * (y - p)
            w[at] += step * x - rate * decay * w[at]
            w[-1] += 0.1 * step
    return w


def score(rows: DataFrame, weights: np.ndarray, bits: int = 16, low: int = 3, high: int = 5) -> DataFrame:
    """Rows with host and path, and `score` (1: block) for those with needs_score; 0 for the others."""
    sent = rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for b in batches:
            out = np.zeros(b.num_rows)
            todo = np.flatnonzero(b.column("needs_score").to_numpy(zero_copy_only=False))
            hosts, paths = b.column("host").to_pylist(), b.column("path").to_pylist()
            for at in range(0, len(todo), 2000):
                part = todo[at : at + 2000]
                owner, slots = features(_parts([hosts[i] for i in part], [paths[i] for i in part]), low, high, bits)
                kinds = np.maximum(np.bincount(owner, minlength=len(part)), 1)
                z = np.bincount(owner, w[slots], len(part)) / np.sqrt(kinds) + w[-1]
                out[part] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], [*b.schema.names, "score"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return rows.mapInArrow(run, f"{kinds}, score double")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], table: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of each row."""
    host, path = host_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(rules, F.col("host"), F.col("path"))
    rows = rows.select("*", rule.alias("rule"), verdict.alias("ruled")).withColumn("needs_score", F.col("ruled").isNull())
    scored = score(rows, train(table))
    learnt = F.when(F.col("score") > threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", learnt).alias("verdict"), F.when(F.col("ruled").isNull(), F.col("score")).alias("score"))
