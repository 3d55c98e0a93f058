"""Spelling variants: words one inserted, deleted or replaced code point apart, found by generating whole neighbourhoods.

Every word emits each different word that one deletion, replacement or insertion over the vocabulary's own letters makes of
it; those that are words are its near words. A candidate is at distance one by the way it was made, so nothing is measured.
Neighbourhoods of a thousand candidates a word are made as 64-bit hashes, from hashes of beginnings and endings, and looked
up in a broadcast table of vocabulary hashes; only what is found there becomes a string, and joins the vocabulary as one. A
broadcast holds the hashes of at most `shard_words` words: a larger vocabulary takes a pass for each shard of it, and no
pass moves any candidates but those found.

No letter is emitted twice: of a run of one letter the first is deleted, and a letter is inserted before a run of it, never
inside or behind.

Defined results: null texts have no words; a null id counts as an empty one; of equal words and counts the smaller word (by
code points) decides; repeated rows count again; an empty table gives an empty table; further columns are ignored. Words of
any length have whole neighbourhoods, a stretch of positions at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

# fixed values: letters, and the odds and the place of a dropped letter
RUN = r"[a-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DROP_ONE_IN = 199

BASE, MIX = np.uint64(0x9E3779B97F4A7C55), np.uint64(0xD6E8FEB86659FD93)


def vocabulary(docs: DataFrame, least_length: int = 6, least_count: int = 5) -> DataFrame:
    """(word, n): the letter runs of (doc_id, text), some with a letter dropped, of so many code points and occurrences."""
    text = F.translate("text", UPPER, LOWER)
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("run"))
    named = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))
    runs = runs.where(F.length("run") >= least_length).select("run", F.crc32(named).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    dropped = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % DROP_ONE_IN == 0, dropped).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def letters(words: DataFrame) -> np.ndarray:
    """The different code points of (word): an alphabet, however many words there are."""
    found = words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct().collect()
    return np.array(sorted(ord(r.c) for r in found), np.uint64)


# --- hashes: a word's code points are the digits of a number, modulo 2^64


def powers(n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(n, BASE)], dtype=np.uint64)


def ends(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first k letters, and of the letters from k on, for k = 0..length. codes: words of one length as rows."""
    n, length = codes.shape
    first, last, power = np.zeros((n, length + 1), np.uint64), np.zeros((n, length + 1), np.uint64), powers(length)
    for k in range(length):
        first[:, k + 1] = first[:, k] * BASE + codes[:, k]
    for k in range(length - 1, -1, -1):
        last[:, k] = codes[:, k] * power[length - 1 - k] + last[:, k + 1]
    return first, last


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(29))


def codes_of(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1).astype(np.uint64)


def by_length(words: list[str], cells: int) -> Iterator[list[str]]:
    """Words of one length, so many at a time that their letters are at most `cells`."""
    lengths: dict[int, list[str]] = {}
    for w in words:
        lengths.setdefault(len(w), []).append(w)
    for length, some in lengths.items():
        step = max(1, cells // max(1, length))
        for at in range(0, len(some), step):
            yield some[at : at + step]


class Hashes:
    """Which 64-bit numbers a sorted array holds: a bitmap tells most that are not."""

    def __init__(self, held: np.ndarray):
        self.held = held
        bits = max(10, int(len(held) * 16).bit_length())
        self.shift = np.uint64(64 - bits)
        place = held >> self.shift
        self.map = np.zeros(1 << (bits - 3), np.uint8)
        np.bitwise_or.at(self.map, place >> np.uint64(3), np.left_shift(np.uint8(1), (place & np.uint64(7)).astype(np.uint8)))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Flat places of those numbers of h that are held."""
        h = mixed(h.reshape(-1))
        place = h >> self.shift
        maybe = np.flatnonzero(self.map[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1)
        at = np.searchsorted(self.held, h[maybe])
        return maybe[self.held[np.minimum(at, len(self.held) - 1)] == h[maybe]] if len(self.held) else maybe[:0]


def neighbours(words: list[str], alphabet: np.ndarray, known: Hashes, at_once: int = 1 << 16) -> Iterator[tuple[str, str]]:
    """(word, candidate): the neighbours of words of one length whose hash is known."""
    codes = codes_of(words)
    length = codes.shape[1]
    first, last = ends(codes)
    power = powers(length + 1)
    names, none = [chr(int(c)) for c in alphabet], np.uint64(0x110000)
    before = np.concatenate([np.full((len(words), 1), none), codes], 1)  # before[k]: the letter in front of place k
    step = max(1, at_once // max(1, len(words) * len(alphabet)))
    for a in range(0, length + 1, step):
        z = min(a + step, length)  # places of letters
        if a < z:
            k = np.arange(a, z)
            gone = first[:, k] * power[length - 1 - k] + last[:, k + 1]
            for i in known.find(gone):
                row, at = divmod(int(i), z - a)
                if before[row, a + at] != codes[row, a + at]:
                    yield words[row], words[row][: a + at] + words[row][a + at + 1 :]
            other = gone[:, :, None] + (first[:, k] * (power[length - k] - power[length - 1 - k]))[:, :, None] + alphabet * power[length - 1 - k][:, None]
            for i in known.find(other):
                row, at, c = np.unravel_index(int(i), other.shape)
                if codes[row, a + at] != alphabet[c]:
                    yield words[row], words[row][: a + at] + names[c] + words[row][a + at + 1 :]
        k = np.arange(a, min(a + step, length + 1))  # places between letters
        more = (first[:, k] * power[length + 1 - k] + last[:, k])[:, :, None] + alphabet * power[length - k][:, None]
        for i in known.find(more):
            row, at, c = np.unravel_index(int(i), more.shape)
            if before[row, a + at] != alphabet[c]:
                yield words[row], words[row][: a + at] + names[c] + words[row][a + at :]


# --- tables


def _hashed(words: DataFrame) -> DataFrame:
    """(h, word) of each word: its hash, mixed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for some in by_length(b.column(0).to_pylist(), 1 << 18):
                h = mixed(ends(codes_of(some))[0][:, -1])
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(some, pa.string())], ["h", "word"])

    return words.select("word").mapInArrow(run, "h long, word string")


def _shard(hashed: DataFrame, shard: int, shards: int) -> np.ndarray:
    """The sorted hashes of one shard of the vocabulary; their number is bounded by the number of shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.column(0).to_numpy().tobytes()], pa.binary())], ["block"])

    mine = hashed.where(F.pmod(F.col("h"), F.lit(shards)) == shard).select("h").mapInArrow(run, "block binary")
    return np.sort(np.concatenate([np.frombuffer(r.block, np.uint64) for r in mine.collect()] or [np.zeros(0, np.uint64)]))


def near(words: DataFrame, shard_words: int = 4_000_000, task_words: int = 20_000) -> DataFrame:
    """(word, near, near_n): the near words of each word of (word, n), words distinct."""
    total, alphabet = words.count(), letters(words)
    spark = words.sparkSession
    shards = max(1, -(-total // (shard_words * 3 // 4)))  # shards by hash differ in size a little
    hashed = cut(_hashed(words))
    dealt = words.select("word").repartition(max(spark.sparkContext.defaultParallelism, total // task_words))
    sent_letters = spark.sparkContext.broadcast(alphabet)

    def found(shard: int) -> DataFrame:
        sent = spark.sparkContext.broadcast(_shard(hashed, shard, shards))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = Hashes(sent.value)
            for b in batches:
                for some in by_length(b.column(0).to_pylist(), max(1, (1 << 20) // max(1, len(sent_letters.value)))):
                    held = []
                    for pair in neighbours(some, sent_letters.value, known):
                        held.append(pair)
                        if len(held) == 10_000:
                            yield _pairs(held)
                            held = []
                    yield _pairs(held)

        out = dealt.mapInArrow(run, "word string, candidate string")
        if shards == 1:
            return out
        out = cut(out)  # this shard's hashes are let go before the next one's come
        sent.unpersist()
        return out

    pairs = reduce(DataFrame.unionAll, [found(s) for s in range(shards)])
    known = words.select(F.col("word").alias("candidate"), F.col("n").alias("near_n"))
    return pairs.join(known, "candidate").select("word", F.col("candidate").alias("near"), "near_n")


def _pairs(held: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in held], pa.string()) for i in (0, 1)], ["word", "candidate"])


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of the path that starts at each word of (word, form), form not null.

    Paths double each round; counts rise fivefold along them, so that a few rounds suffice for any corpus.
    """
    out = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        on = out.select(F.col("word").alias("root"), F.col("root").alias("further"))
        out = cut(out.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("went_on")))
        if out.where("went_on").isEmpty():
            return out.select("word", "root")
        out = out.select("word", "root")


def group(words: DataFrame, times: int = 5) -> DataFrame:
    """word, form, root, n, n_near and form_n of each word of (word, n): a word's form is its near word of the largest n, if that is `times` its own."""
    words = cut(words.select("word", "n"))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best")
    pairs = near(words).groupBy("word").agg(F.count("*").alias("n_near"), best)
    told = words.join(pairs, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), (-F.col("best.less")).alias("form_n"), F.col("best.form").alias("form"))
    much = F.col("form_n") >= times * F.col("n")
    told = cut(told.select("word", "n", "n_near", F.when(much, F.col("form")).alias("form"), F.when(much, F.col("form_n")).alias("form_n")))
    return told.join(roots(told.where("form is not null")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def regroup(docs: DataFrame, least_length: int = 6, least_count: int = 5, times: int = 5) -> DataFrame:
    """The words of (doc_id, text) with their forms and roots."""
    return group(vocabulary(docs, least_length, least_count), times)
