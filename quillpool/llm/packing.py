"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become token ids (their end marked by `end_id`) and pieces of at most `length` tokens; whole pieces are
sequences as they are. The others are dealt evenly into shards of about `shard_rows` pieces, the size of one search,
however many shards there are. `islands` searches work on each shard from populations of their own. A solution is
a grouping of pieces into sequences. Crossover takes well-filled sequences of one parent whole, dissolves those of the
other parent that hold one of their pieces, and sequences that are not full. Displaced pieces first replace one or two
smaller ones where that fills a sequence better (Falkenauer's replacement), then each goes where it fits best, largest
first. Populations live on from one epoch to the next; after each epoch an island's best solution also goes to the next
island of its shard, in place of the worst there; at the end the best of a shard is its packing. A search ends early where
it meets the lower bound of Martello and Toth, which no packing of its pieces can beat.

Defined results: a null or empty text is the end id alone; repeated rows are packed each; further columns are ignored;
an empty table gives an empty table.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .tokens import batches_of, encoder

PIECE = "piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, drops_space: bool = False, end_id: int = 0, length: int = 2048) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the first piece takes what is left over by full ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, drops_space).batch
        for b in batches:
            row, piece, start, size, crc = [], [], [], [], []
            for at, texts in batches_of(b.column(1)):
                ids, begins = encode(texts, end_id)
                data, begins = memoryview(ids).cast("B"), begins.tolist()
                for r, (low, high) in enumerate(zip(begins, begins[1:]), at):
                    n = high - low
                    first = n % length or length
                    cuts = [0, *range(first, n + 1, length)]
                    for k, (s, e) in enumerate(zip(cuts, cuts[1:])):
                        row.append(r), piece.append(k), start.append(s), size.append(e - s), crc.append(crc32(data[4 * (low + s) : 4 * (low + e)]))
            cols = [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, size, crc)]]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {PIECE}")


class Sequences:
    """Sequences by free room; a bit for each room that one has, so that the best fit is a bit operation."""

    def __init__(self, length: int):
        self.length, self.by_room, self.bits = length, [[] for _ in range(length + 1)], 0
        self.members: list[list[int]] = []
        self.used: list[int] = []

    def add(self, members: list[int], used: int) -> None:
        room = self.length - used
        self.by_room[room].append(len(self.members))
        self.bits |= 1 << room
        self.members.append(members)
        self.used.append(used)

    def fit(self, item: int, size: int) -> None:
        above = self.bits >> size
        if not above:
            self.add([item], size)
            return
        room = size + (above & -above).bit_length() - 1
        held = self.by_room[room]
        seq = held.pop()
        if not held:
            self.bits &= ~(1 << room)
        self.members[seq].append(item)
        self.used[seq] += size
        self.by_room[room - size].append(seq)
        self.bits |= 1 << (room - size)


class Packing:
    """A solution: the pieces of each sequence, the tokens that they use, and how good that is."""

    def __init__(self, members: list[list[int]], used: list[int], length: int):
        self.members, self.used = members, np.array(used, np.int64)
        # fewer sequences first; then fuller full ones, which leaves the room together
        self.value = (-len(members), float(((self.used / length) ** 2).sum()))
        self.flat = np.fromiter(chain.from_iterable(members), np.int64)
        self.of = np.repeat(np.arange(len(members)), np.fromiter(map(len, members), np.int64, len(members)))


def best_fit(sizes: np.ndarray, order: np.ndarray, length: int, start: list[tuple[list[int], int]] = ()) -> Packing:
    """Puts the pieces of `order` in turn into the fullest sequence with room, beside the sequences of `start`."""
    out = Sequences(length)
    for members, used in start:
        out.add(members, used)
    for item, size in zip(order.tolist(), sizes[order].tolist()):
        out.fit(item, size)
    return Packing(out.members, out.used, length)


def least_sequences(sizes: np.ndarray, length: int) -> int:
    """Martello and Toth's bound L2: no packing has fewer sequences."""
    if not len(sizes):
        return 0
    s = np.sort(sizes)
    total = np.concatenate([[0], np.cumsum(s)])
    half = np.searchsorted(s, length // 2, "right")  # from here on two do not fit together
    low = np.unique(np.concatenate([[0], s[:half]]))  # pieces below this are left out
    first, alone = np.searchsorted(s, low, "left"), np.searchsorted(s, length - low, "right")
    alone = np.maximum(alone, half)
    room = (alone - half) * length - (total[alone] - total[half])
    more = -(-np.maximum(total[half] - total[np.minimum(first, half)] - room, 0) // length)
    return int((len(s) - half + more).max())


def replaced(kept: list[tuple[list[int], int]], loose: list[int], sizes: np.ndarray, length: int) -> tuple[list[tuple[list[int], int]], list[int]]:
    """Sequences in which a loose piece has taken the place of one or two smaller ones, and what is loose then.

    In each sequence with room the exchange that fills it most is made; its tokens rise, the loose pieces become smaller.
    """
    size = sizes.tolist()
    order = sorted((size[i], i) for i in loose)
    out = []
    for members, used in kept:
        room = length - used
        if room and order:
            best, swap = 0, None
            single = [((i,), size[i]) for i in members]
            double = [((i, j), size[i] + size[j]) for k, i in enumerate(members) for j in members[k + 1 :]] if len(members) <= 12 else []
            for old, n in single + double:
                at = bisect_right(order, (n + room, len(size))) - 1
                if at >= 0 and order[at][0] - n > best:
                    best, swap = order[at][0] - n, (old, at)
                    if best == room:
                        break
            if swap:
                old, at = swap
                new = order.pop(at)[1]
                for i in old:
                    insort(order, (size[i], i))
                members, used = [i for i in members if i not in old] + [new], used + best
        out.append((members, used))
    return out, [i for _, i in order]


def crossover(a: Packing, b: Packing, sizes: np.ndarray, length: int, rng: np.random.Generator, share: float = 0.5) -> Packing:
    good = np.argsort(-b.used, kind="stable")[: max(1, int(len(b.members) * share))]
    chosen = good[rng.random(len(good)) < 0.7]
    injected = np.zeros(len(b.members), bool)
    injected[chosen] = True
    taken = np.zeros(len(sizes), bool)
    taken[b.flat[injected[b.of]]] = True
    # a's sequences stay whole if they hold no piece that was injected and are among its fuller ones
    free = np.bincount(a.of, taken[a.flat], len(a.members)) == 0
    whole = free & ((a.used >= 0.98 * length) | (rng.random(len(a.members)) < 0.5))
    loose = a.flat[~whole[a.of] & ~taken[a.flat]]
    start = [(list(b.members[i]), int(b.used[i])) for i in chosen.tolist()] + [(list(a.members[i]), int(a.used[i])) for i in np.flatnonzero(whole).tolist()]
    start, left = replaced(start, loose.tolist(), sizes, length)
    loose = np.array(left, np.int64)
    rank = sizes[loose] + rng.random(len(loose)) * (64 * rng.random())  # largest first, with some play
    return best_fit(sizes, loose[np.argsort(-rank, kind="stable")], length, start)


def evolve(sizes: np.ndarray, length: int, population: list[Packing], generations: int, rng: np.random.Generator) -> list[Packing]:
    """Steady state, best first: each child replaces the worst if it is better. Ends when nothing can be saved."""
    least = least_sequences(sizes, length)
    ranked = sorted(population, key=lambda p: p.value, reverse=True)
    for _ in range(generations):
        if len(ranked[0].members) <= least or len(ranked) < 2:
            break
        i, j = rng.choice(len(ranked), 2, replace=False)
        child = crossover(ranked[i], ranked[j], sizes, length, rng)
        if child.value > ranked[-1].value:
            ranked[-1] = child
            ranked.sort(key=lambda p: p.value, reverse=True)
    return ranked


def founders(sizes: np.ndarray, length: int, count: int, rng: np.random.Generator) -> list[Packing]:
    """Best fit by decreasing size, with more play from one founder to the next; one alone where it cannot be beaten."""
    out = []
    for k in range(count):
        out.append(best_fit(sizes, np.argsort(-(sizes + rng.random(len(sizes)) * 40 * k), kind="stable"), length))
        if len(out[-1].members) <= least_sequences(sizes, length):
            break
    return out


def labels_of(packing: Packing) -> np.ndarray:
    out = np.empty(len(packing.flat), np.int64)
    out[packing.flat] = packing.of
    return out


def packing_of(labels: np.ndarray, sizes: np.ndarray, length: int) -> Packing:
    order = np.argsort(labels, kind="stable")
    first = np.flatnonzero(np.diff(labels[order].astype(np.int64), prepend=-1)) if len(order) else order
    flat, bounds = order.tolist(), [*first.tolist(), len(order)]
    members = [flat[s:e] for s, e in zip(bounds, bounds[1:])]
    return Packing(members, np.add.reduceat(sizes[order], first).tolist() if len(first) else [], length)


def pack(cut_pieces: DataFrame, length: int = 2048, shard_rows: int = 8192, islands: int = 2, epochs: int = 3, population: int = 4, generations: int = 10) -> DataFrame:
    """The pieces with sequence_id and offset."""
    rows = cut(cut_pieces.withColumn("uid", F.monotonically_increasing_id()))  # fixed by the checkpoint
    part = rows.where(F.col("length") < length)
    shards = max(1, -(-part.count() // shard_rows))
    # an even deal, whatever the ids are
    items = part.select(F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int").alias("shard"), "uid", F.col("length").cast("int").alias("size"))
    # solutions: the number of a piece's sequence in each; those that another island sent are guests
    none = F.lit(None).cast("array<int>")
    tasks = items.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))).withColumn("solutions", none).withColumn("guest", F.lit(False)).withColumn("sequences", F.lit(0).cast("long"))
    tasks = tasks.select("shard", "island", "uid", "size", "solutions", "guest", "sequences")
    kinds = "shard int, island int, uid long, size int, solutions array<int>, guest boolean, sequences long"

    def search(epoch: int):
        def run(key, table):
            shard, island = key[0].as_py(), key[1].as_py()
            rng = np.random.default_rng([shard, island, epoch])
            own = table.filter(pc.invert(table["guest"])).sort_by("uid")
            guest = table.filter(table["guest"]).sort_by("uid")
            sizes = own["size"].to_numpy().astype(np.int64)
            held = [packing_of(labels, sizes, length) for t in (own, guest) if t.num_rows and epoch for labels in _matrix(t["solutions"]).T]
            if not held:
                held = founders(sizes, length, population, rng)
            if len(held) > population:  # the guest is there in place of the worst of the others
                held.remove(min(held[:-1], key=lambda p: p.value))
            held = evolve(sizes, length, held, generations, rng)
            last = epoch + 1 == epochs
            homes = [(island, False, held[:1] if last else held)]
            if not last and islands > 1:
                homes.append(((island + 1) % islands, True, held[:1]))
            out = []
            for to, is_guest, solutions in homes:
                labels = np.stack([labels_of(p) for p in solutions], 1).astype(np.int32)
                array = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * labels.shape[1], pa.int32()), pa.array(labels.reshape(-1)))
                n = len(sizes)
                out.append(pa.table([own["shard"], pa.array(np.full(n, to, np.int32)), own["uid"], own["size"], array, pa.array(np.full(n, is_guest)), pa.array(np.full(n, len(held[0].members)))], names=own.schema.names))
            return pa.concat_tables(out)

        return run

    for epoch in range(epochs):
        tasks = tasks.groupBy("shard", "island").applyInArrow(search(epoch), kinds)
    tasks = cut(tasks)
    best = tasks.groupBy("shard").agg(F.min(F.struct("sequences", "island")).alias("b")).select("shard", "b.island")
    found = tasks.join(best, ["shard", "island"], "left_semi").select("uid", (F.col("shard") * F.lit(1 << 32).cast("long") + F.col("solutions")[0]).alias("sequence_id"))
    placed = rows.join(found, "uid", "left")
    inside = Window.partitionBy("sequence_id").orderBy("uid").rowsBetween(Window.unboundedPreceding, -1)
    partly = placed.where("sequence_id is not null").withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long"))
    # numbers below zero are the sequences that one piece fills
    whole = rows.where(F.col("length") >= length).select("*", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return partly.select(*whole.columns).unionByName(whole).drop("uid")


def _matrix(solutions: pa.ChunkedArray) -> np.ndarray:
    """A row for each piece, a column for each solution."""
    rows = len(solutions)
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in solutions.chunks]).reshape(rows, -1)
