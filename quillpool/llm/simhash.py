"""SimHash near-duplicates, linked through shards of BK-trees.

Fingerprints are 64-bit SimHashes of word shingles. Only different fingerprints are linked: each is a node, however many
documents share it. Two fingerprints within `radius` bits agree in all but `radius` of the blocks into which the 64 bits
are cut, so each fingerprint goes to one shard for each way of choosing the agreeing blocks, and no link is lost. A
shard's fingerprints form a BK-tree, children keyed by integer Hamming distance to the parent; a search follows only
edges within the radius of its distance. All trees of a task are built and searched together, level by level, as arrays.
Shards of over `shard_rows` fingerprints are cut again by their remaining bits, so none grows with a group of copies.
A shard returns a spanning forest of its links, and components are joined by large-star and small-star rounds.

Defined results: a null or blank text has fingerprint zero and is linked like any other; repeated rows are returned
each; null doc_ids never name a component unless all of it is null; further columns are ignored by `near_duplicates` and
passed through by `keep_one`; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .components import components
from .names import free_names, own

SEED = 42


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in parts of a few texts, so that a worker holds no more than these as Python objects."""
    for b in batches:
        for at in range(0, max(b.num_rows, 1), rows):
            yield b.slice(at, rows)


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of each run of `words` words, in order; of the whole sequence where that is shorter."""
    from xxhash import xxh64_intdigest as h

    parts = text.lower().split()  # of bytes: A-Z only, and splits at space and tab to carriage return only
    if not parts:
        return np.zeros(0, np.uint64)
    line = b" ".join(parts)
    if len(parts) <= words:
        return np.array([h(line, SEED)], np.uint64)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[: len(parts) - words + 1].tolist()
    ends = (ends - 1)[words - 1 :].tolist()
    return np.fromiter((h(line[s:e], SEED) for s, e in zip(starts, ends)), np.uint64, len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """Bit set where over half of the hashes set it; signed, as a Spark long."""
    n, ones = len(hashes), np.zeros(64, np.int64)
    if n == 0:
        return 0
    for at in range(0, n, 65_536):
        part = hashes[at : at + 65_536].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = b.column(1).cast(pa.large_binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(shingle_hashes(t or b"", words)) for t in texts], pa.int64())], ["doc_id", "fp"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def block_masks(bits: list[int], radius: int, agree: int) -> list[int]:
    """Masks of every choice of `agree` blocks out of radius + agree into which the bits are cut."""
    blocks = [sum(1 << i for i in part.tolist()) for part in np.array_split(np.array(bits), radius + agree)]
    return [sum(chosen) for chosen in combinations(blocks, agree)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


class Forest:
    """BK-trees of the nodes of each group: nodes, roots, and children in order of (parent, distance)."""

    def __init__(self, fps: np.ndarray, group: np.ndarray):
        self.fps = fps
        left = np.argsort(group, kind="stable")
        key = group[left].astype(np.int64)
        self.root = np.empty(len(fps), np.int64)
        parents, children = [], []
        first = True
        while len(left):
            new = np.ones(len(left), bool)
            new[1:] = key[1:] != key[:-1]
            head = left[new]
            of = np.cumsum(new) - 1
            if first:
                self.root[left] = head[of]
            else:
                parents.append(key[new])
                children.append(head)
            first = False
            rest = ~new
            top = head[of[rest]]
            left = left[rest]
            d = np.bitwise_count(fps[left] ^ fps[top]).astype(np.int64)
            key = top * 65 + d  # the subtree below `top` at distance d
            order = np.argsort(key, kind="stable")
            left, key = left[order], key[order]
        keys = np.concatenate(parents) if parents else np.zeros(0, np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.nodes = (np.concatenate(children) if children else np.zeros(0, np.int64))[order]

    def links(self, radius: int, at_once: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (a, b), b < a, within the radius: every node searched for in its own tree."""
        for start in range(0, len(self.fps), at_once):
            q = np.arange(start, min(start + at_once, len(self.fps)))
            node = self.root[q]
            while len(q):
                d = np.bitwise_count(self.fps[q] ^ self.fps[node]).astype(np.int64)
                hit = (d <= radius) & (node < q)
                if hit.any():
                    yield q[hit], node[hit]
                low = np.searchsorted(self.keys, node * 65 + np.maximum(d - radius, 0), "left")
                high = np.searchsorted(self.keys, node * 65 + np.minimum(d + radius, 64), "right")
                n = high - low
                q = np.repeat(q, n)
                node = self.nodes[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(len(q))]


def spanning(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least node of each node's component."""
    label = np.arange(n)
    for a, b in links:
        while True:
            la, lb = label[a], label[b]
            if np.array_equal(la, lb):
                break
            np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
            while not np.array_equal(nxt := label[label], label):
                label = nxt
    return label


def tree_links(keyed: DataFrame, radius: int) -> DataFrame:
    """(src, dst) forests of the links inside each shard of (shard, part, fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def linked(shard: np.ndarray, part: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            new = np.ones(len(fp), bool)
            new[1:] = (shard[1:] != shard[:-1]) | (part[1:] != part[:-1])
            group = np.cumsum(new) - 1
            many = np.bincount(group)[group] > 1
            fp, group = fp[many], group[many]
            root = spanning(len(fp), Forest(fp.view(np.uint64), group).links(radius))
            moved = root != np.arange(len(fp))
            return pa.RecordBatch.from_arrays([pa.array(fp[moved]), pa.array(fp[root[moved]])], ["src", "dst"])

        for b in batches:
            held.append(tuple(b.column(i).to_numpy() for i in range(3)))
            if sum(len(x[2]) for x in held) < 100_000:
                continue
            shard, part, fp = (np.concatenate(x) for x in zip(*held))
            last = np.flatnonzero((shard != shard[-1]) | (part != part[-1]))
            end = last[-1] + 1 if len(last) else 0  # the last shard may go on
            held = [(shard[end:], part[end:], fp[end:])]
            if end:
                yield linked(shard[:end], part[:end], fp[:end])
        if held:
            yield linked(*(np.concatenate(x) for x in zip(*held)))

    return keyed.select("shard", "part", "fp").mapInArrow(run, "src long, dst long")


def links(nodes: DataFrame, radius: int = 2, agree: int = 2, shard_rows: int = 50_000) -> DataFrame:
    """(src, dst): edges whose components are those of all pairs of different fingerprints within the radius."""
    masks = block_masks(list(range(64)), radius, agree)

    def cut_by(rows: DataFrame, base: list, at: int) -> DataFrame:
        shards = [F.struct(F.lit(at + i).alias("shard"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")).alias("part")) for i, m in enumerate(base)]
        return rows.select("fp", F.explode(F.array(*shards)).alias("s")).select("s.shard", "s.part", "fp")

    keyed = cut_by(nodes.select("fp"), masks, 0)
    sizes = cut(keyed.groupBy("shard", "part").count().where(F.col("count") > shard_rows))
    if not sizes.isEmpty():
        large = keyed.join(sizes, ["shard", "part"], "left_semi")
        finer = []
        for i, m in enumerate(masks):
            rest = [b for b in range(64) if not m >> b & 1]
            finer.append(cut_by(large.where(F.col("shard") == i), [m | s for s in block_masks(rest, radius, agree)], len(masks) * (i + 1)))
        keyed = keyed.join(sizes, ["shard", "part"], "left_anti")
        for f in finer:
            keyed = keyed.unionByName(f)
    n = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tree_links(keyed.repartition(n, "shard", "part").sortWithinPartitions("shard", "part", "fp"), radius)


def classes(fps: DataFrame, radius: int = 2) -> DataFrame:
    """(fp, component_id): the least doc_id that the fingerprint's documents reach. fps: (doc_id, fp)."""
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = components(links(nodes, radius))
    rooted = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    least = rooted.groupBy("label").agg(F.min("least").alias("component_id"))
    return rooted.join(least, "label").select("fp", "component_id")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row."""
    fps = cut(fingerprints(docs, words))
    return fps.join(classes(fps, radius), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# --- near copies of a given similarity


PERMUTATIONS, BAND = 128, 4  # at a similarity of 0.8 one pair in 20 million shares no band


def sketch(hashes: np.ndarray, multipliers: np.ndarray) -> bytes:
    """The least of the shingles' hashes under each multiplier (upper 32 bits); the share of equal ones estimates Jaccard."""
    least = np.full(len(multipliers), 0xFFFFFFFF, np.uint64)
    for at in range(0, len(hashes), 1024):
        part = (hashes[at : at + 1024, None] * multipliers) >> np.uint64(32)
        np.minimum(least, part.min(axis=0), out=least)
    return least.astype("<u4").tobytes()


def sketches(rows: DataFrame, words: int, width: int = 4) -> DataFrame:
    """(text_key, fp, sketch, bands array<long>) from (text_key, text); the low `width` bytes of each least hash are kept.

    Rows of a key that the task has just seen are left out: callers take one row of each key anyway.
    """
    seed = np.random.default_rng(SEED).integers(0, 1 << 63, PERMUTATIONS, np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest as h

        seen: set = set()
        for b in slices(batches):
            out, new = [], []
            for i, (key, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()).to_pylist())):
                if key in seen:
                    continue
                if len(seen) >= 100_000:
                    seen.clear()
                seen.add(key), new.append(i)
                hashes = shingle_hashes(text or b"", words)
                s = sketch(hashes, seed)
                step = 4 * BAND
                bands = np.array([h(s[i : i + step], i) for i in range(0, len(s), step)], np.uint64).view(np.int64)
                low = np.frombuffer(s, np.uint8).reshape(-1, 4)[:, :width].tobytes()
                out.append((fingerprint(hashes), low, bands))
            fp, s, bands = zip(*out) if out else ((), (), ())
            keys = b.column(0).take(pa.array(new, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(fp, pa.int64()), pa.array(s, pa.binary()), pa.array(list(bands), pa.list_(pa.int64()))], ["text_key", "fp", "sketch", "bands"])

    return rows.mapInArrow(run, f"text_key {rows.schema['text_key'].dataType.simpleString()}, fp long, sketch binary, bands array<long>")


def _shares(pairs: DataFrame, kind: str, share) -> DataFrame:
    """(src, dst, share): what share(a, b) gives for the two binary values of each pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = ([np.frombuffer(x, kind) for x in batch.column(i).to_pylist()] for i in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([share(x, y) for x, y in zip(a, b)], pa.float64())], ["src", "dst", "share"])

    return pairs.select("src", "dst", "a", "b").mapInArrow(run, "src long, dst long, share double")


def _jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of sorted arrays without repeats."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return both / (len(a) + len(b) - both)


def _with_values(pairs: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """The pairs with the values of both ends, as a and b."""
    side = lambda end, out: values.select(F.col("text_key").alias(end), F.col(name).alias(out))
    return pairs.join(side("src", "a"), "src").join(side("dst", "b"), "dst")


def shingle_sets(rows: DataFrame, words: int) -> DataFrame:
    """(text_key, shingles binary): the different shingles' hashes, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [np.unique(shingle_hashes(t or b"", words)).tobytes() for t in b.column(1).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], ["text_key", "shingles"])

    return rows.mapInArrow(run, "text_key long, shingles binary")


def _estimated(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, share): the share of equal sketch bytes, less what different hashes have in common by chance."""
    pairs = pairs.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, PERMUTATIONS) for i in (2, 3))
            share = ((a == b).mean(axis=1) - 1 / 256) / (1 - 1 / 256)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(share)], ["src", "dst", "share"])

    return _with_values(pairs, nodes, "sketch").select("src", "dst", "a", "b").mapInArrow(run, "src long, dst long, share double")


def _label(rows: DataFrame, labels: DataFrame, key: str, name: str) -> DataFrame:
    """rows with the label of their `key`; a text that nothing links is its own label."""
    known = labels.select(F.col("text_key").alias(key), F.col("label").alias("__label"))
    return rows.join(known, key, "left").withColumn(name, F.coalesce("__label", key)).drop("__label")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends have different labels."""
    return _label(_label(pairs, labels, "src", "__a"), labels, "dst", "__b").where("__a <> __b").drop("__a", "__b")


def _joined(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(text_key, label) of all texts that have a link: the least text key that each reaches, with the links so far."""
    if labels is not None:
        edges = edges.select("src", "dst").unionByName(labels.select(F.col("text_key").alias("src"), F.col("label").alias("dst")))
    return cut(components(edges).withColumnRenamed("node", "text_key"))


def _unlinked(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(value, text_key, label) of the values whose texts are of several groups."""
    rows = _label(rows.select("value", "text_key"), labels, "text_key", "label")
    found = rows.groupBy("value").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("value")
    return cut(rows.join(found, "value", "left_semi"))


def families(rows: DataFrame, block: int) -> DataFrame:
    """rows (value, text_key, label) with values put together where that leaves fewer rows to send to `compared`.

    Values that share texts form a family. It is compared as one where its texts, once for each block, are fewer than
    those of its values, once for each of theirs; else each of its values is compared on its own.
    """
    blocks = lambda n: F.ceil(F.col(n) / block)
    first = rows.groupBy("value").agg(F.min("text_key").alias("dst"), F.count("*").alias("n"))
    of = cut(components(rows.join(first, "value").select(F.col("text_key").alias("src"), "dst")).select(F.col("node").alias("text_key"), F.col("label").alias("family")))
    apart = first.join(of, F.col("dst") == F.col("text_key")).groupBy("family").agg(F.sum(F.col("n") * blocks("n")).alias("apart"))
    chosen = of.groupBy("family").agg(F.count("*").alias("n")).join(apart, "family").where(F.col("n") * blocks("n") <= F.col("apart")).select("family", F.lit(True).alias("whole"))
    chosen = cut(chosen)  # a plain shuffle on both sides, so that adaptive execution can split a hot family
    marked = rows.join(of, "text_key").join(chosen, "family", "left")
    return marked.select(F.when(F.col("whole"), F.col("family")).otherwise(F.col("value")).alias("value"), "text_key", "label").distinct()


def group_links(keys: np.ndarray, label: np.ndarray, block: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that join the texts as all similar pairs of different labels do; of two blocks, pairs across them only.

    The texts whose shingles are the most frequent come first: what is nearest to the others soon leaves little to compare.
    """
    label = np.unique(label, return_inverse=True)[1]
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    end = np.cumsum(size)
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner = np.repeat(np.arange(len(sets)), size)
    often = np.bincount(ids)
    order = np.argsort(-np.bincount(owner, often[ids], len(sets)) / np.maximum(size, 1), kind="stable")
    across = block.min() < block.max()
    # each pair has a text of the first block, or one that is not of the largest group
    order = order[block[order] == block.min()] if across else order[label[order] != np.bincount(label).argmax()]
    left, mark, out = np.ones(len(sets), bool), np.zeros(len(often), bool), []
    for p in order.tolist():
        left[p] = False
        other = left & (label != label[p])
        if across:
            other &= block != block[p]
        if not other.any():
            continue
        mine = ids[end[p] - size[p] : end[p]]
        mark[mine] = True
        both = np.bincount(owner, mark[ids], len(sets))
        mark[mine] = False
        either = size + size[p] - both
        near = np.flatnonzero(other & (np.where(either > 0, both / np.maximum(either, 1), 1.0) >= similarity))
        joined, first = np.unique(label[near], return_index=True)
        out += [(int(keys[p]), int(keys[q])) for q in near[first]]
        label[np.isin(label, joined)] = label[p]
    return out


def compared(rows: DataFrame, sets: DataFrame, similarity: float, block: int = 500) -> DataFrame:
    """(src, dst): links that join all similar pairs of texts of one value and different labels. rows: (value, text_key, label).

    Values of over `block` texts are cut into blocks, and a task has two blocks at a time. Texts of a value's largest
    group are compared with the others only.
    """
    sizes = rows.groupBy("value", "label").count().groupBy("value").agg(F.max(F.struct("count", "label")).alias("top"), F.sum("count").alias("n"))
    few = F.col("n") <= block
    others = F.when(few, 1).otherwise(F.ceil((F.col("n") - F.col("top.count")) / block)).cast("int")
    tops = F.when(few, 0).otherwise(F.ceil(F.col("top.count") / block)).cast("int")
    placed = rows.join(sizes, "value").select("value", "text_key", "label", ((F.col("label") == F.col("top.label")) & ~few).alias("is_top"), others.alias("others"), tops.alias("tops"))
    salt = F.xxhash64("text_key", "value")
    placed = placed.withColumn("block", F.when(F.col("is_top"), F.col("others") + F.pmod(salt, F.greatest("tops", F.lit(1)))).otherwise(F.pmod(salt, F.col("others"))).cast("int"))
    with_ = F.explode(F.sequence(F.lit(0), F.when(F.col("is_top"), F.col("others")).otherwise(F.col("others") + F.col("tops")) - 1))
    placed = placed.select("value", "text_key", "label", "block", with_.alias("with")).select("value", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"), "block", "text_key", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def linked(cols: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            value, lo, hi, at, keys, label, sets_ = cols
            new = np.flatnonzero((value[1:] != value[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
            out = []
            for s, e in zip([0, *new.tolist()], [*new.tolist(), len(value)]):
                if e - s > 1:
                    out += group_links(keys[s:e], label[s:e], at[s:e], [np.frombuffer(x, "<u8") for x in sets_[s:e]], similarity)
            src, dst = zip(*out) if out else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

        for b in batches:
            values = np.empty(b.num_rows, object)
            values[:] = b.column(6).to_pylist()
            held.append((*(b.column(i).to_numpy() for i in range(6)), values))
            cols = tuple(np.concatenate(x) for x in zip(*held))
            last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]) | (cols[2] != cols[2][-1]))
            end = last[-1] + 1 if len(last) else 0  # the last group may go on
            held = [tuple(c[end:] for c in cols)]
            if end:
                yield linked(tuple(c[:end] for c in cols))
        if held:
            yield linked(held[0])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.join(sets, "text_key").select("value", "lo", "hi", "block", "text_key", "label", "shingles").repartition(n, "value", "lo", "hi").sortWithinPartitions("value", "lo", "hi")
    return dealt.mapInArrow(run, "src long, dst long")


def digest(text: Column) -> Column:
    """The 128 bits by which texts are told apart; null is the empty text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def marked(rows: DataFrame, keys: DataFrame, column: str, name: str = "marked") -> DataFrame:
    """rows with a column that is true for all whose `column`, a digest, is in keys, and for a few others.

    Of each digest 24 bits are looked up in a bitmap of at most 2**18 words, which is sent to every task: so what cannot
    match is kept out of a shuffle. With many millions of keys ever more rows are marked; that is all that changes.
    """
    at, word, bits = free_names(rows, 3)
    prefix = F.conv(F.substring(F.hex(column), 1, 6), 16, 10).cast("int")
    single = lambda p: F.call_function("shiftleft", F.lit(1).cast("long"), p.bitwiseAND(63))
    bitmap = keys.select(prefix.alias("p")).groupBy(F.shiftright("p", 6).alias(word)).agg(F.bit_or(single(F.col("p"))).alias(bits))
    found = rows.withColumn(at, prefix).join(F.broadcast(bitmap), F.shiftright(at, 6) == F.col(word), "left")
    hit = F.coalesce(F.col(bits).bitwiseAND(single(F.col(at))) != 0, F.lit(False))
    return found.withColumn(name, hit).drop(at, word, bits)


def near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, block: int = 1000) -> DataFrame:
    """(digest, label): the group of each different text. Texts are linked if their shingles' Jaccard similarity is `similarity`.

    A 64-bit SimHash tells so much apart only for almost equal texts: at 0.8, ten bits differ. So candidates are what the
    BK-trees link and what shares a band of min-wise hashes. Each text of a band value is first compared with two of it, by
    sketches of 128 hashes, a byte each; those more than 3.5 standard errors above the limit are linked. Then all texts of
    the values that still have several groups are compared with each other, by their shingles, which are read once.
    """
    texts = docs.select(digest(F.col("text")).alias("digest"), F.coalesce("text", F.lit("")).alias("text"))
    found = sketches(texts.withColumnRenamed("digest", "text_key"), words, width=1).withColumnRenamed("text_key", "digest")
    nodes = cut(found.dropDuplicates(["digest"]).withColumn("text_key", F.monotonically_increasing_id()))  # fixed by the checkpoint
    # each band, and each fingerprint, has two texts with which its others are compared: not the same ones in each, by
    # the bits in which they differ from its value
    values = F.concat("bands", F.array(F.xxhash64("fp", F.lit(-1))))
    banded = nodes.select("text_key", F.explode(values).alias("value"))
    mixed = F.col("text_key").bitwiseXOR(F.col("value"))
    ends = cut(banded.groupBy("value").agg(F.min(mixed).alias("low"), F.max(mixed).alias("high")).where("low < high"))
    shared = cut(banded.join(ends, "value"))
    other = lambda end: F.col(end).bitwiseXOR(F.col("value"))
    stars = shared.select(F.col("text_key").alias("src"), F.explode(F.array(other("low"), other("high"))).alias("dst"))
    error = (similarity * (1 - similarity) / PERMUTATIONS) ** 0.5
    labels = _joined(_estimated(stars, nodes).where(F.col("share") >= similarity + 3.5 * error))

    fps = nodes.groupBy("fp").agg(F.min("text_key").alias("k"))
    of = lambda end, name: fps.select(F.col("fp").alias(end), F.col("k").alias(name))
    trees = links(fps.select("fp"), radius=2).join(of("src", "a"), "src").join(of("dst", "b"), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    trees = cut(_apart(trees, labels))  # these need not share a value
    rest = _unlinked(shared, labels)
    ends = [rest.select("text_key"), trees.select(F.col("src").alias("text_key")), trees.select(F.col("dst").alias("text_key"))]
    wanted = cut(ends[0].unionByName(ends[1]).unionByName(ends[2]).distinct().join(nodes.select("digest", "text_key"), "text_key"))
    sets = marked(texts, wanted.select("digest"), "digest").where("marked").drop("marked").join(wanted, "digest").dropDuplicates(["text_key"]).select("text_key", "text")
    sets = cut(shingle_sets(sets, words))
    near = _shares(_with_values(trees, sets, "shingles"), "<u8", _jaccard).where(F.col("share") >= similarity).select("src", "dst")
    labels = _joined(near.unionByName(compared(families(rest, block), sets, similarity, block)), labels)
    return nodes.select("digest", "text_key").join(labels, "text_key", "left").select("digest", F.coalesce("label", "text_key").alias("label"))


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each group of near copies: that of the least doc_id (nulls last), then of the least digest.

    Only rows of groups that have several are shuffled, and those that `marked` cannot tell from them.
    """
    groups = cut(near_copies(docs, words, similarity))
    rows = docs.select("doc_id", digest(F.col("text")).alias("digest")).groupBy("digest", "doc_id").agg(F.count("*").alias("n"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest", "n")).alias("x")
    each = cut(rows.groupBy("digest").agg(least, F.sum("n").alias("rows")).join(groups, "digest"))
    chosen = each.select("x.*", "label", "rows").groupBy("label").agg(least, F.sum("rows").alias("rows")).where("rows > 1").select("label", "x")
    # of each digest in such a group: whether it stays, with which doc_id, and whether that comes more than once
    fate = cut(each.select("digest", "label").join(chosen, "label").select("digest", (F.col("digest") == F.col("x.digest")).alias("stays"), F.col("x.doc_id").alias("id"), (F.col("x.n") > 1).alias("repeats")))
    of, key, stays, id_, repeats, hit = free_names(docs, 6)
    renamed = {"digest": key, "stays": stays, "id": id_, "repeats": repeats}
    told = marked(docs.withColumn(of, digest(F.col("text"))), fate.select(F.col("digest").alias(of)), of, hit)
    judged = told.where(F.col(hit)).join(fate.withColumnsRenamed(renamed), F.col(of) == F.col(key), "left")
    alone = told.where(~F.col(hit)).select(*own(docs))
    kept = judged.where(F.col(key).isNull() | (F.col(stays) & F.col("doc_id").eqNullSafe(F.col(id_))))
    once = kept.where(~F.coalesce(F.col(repeats), F.lit(False))).select(*own(docs))
    again = kept.where(F.col(repeats)).dropDuplicates([of]).select(*own(docs))  # equal ids and texts: any of these rows
    return alone.unionByName(once).unionByName(again)
