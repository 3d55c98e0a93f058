"""Exact removal of repeated passages: every byte of a `length`-byte string that an earlier document also has.

Strings are judged at anchors: of the k-byte words in a string the one with the least hash, so that equal strings have
equal anchors and each text keeps about one in fourteen positions. Four steps, all on arrays of bytes:

1. each part of the documents (some MB of text) sends its anchors' hashes to buckets, and gets back those that other
   parts have too; anchors that occur in one document only go no further. Anchors of over `hot_windows` windows are marked;
2. for the others it cuts windows, all bytes that strings at the anchor can have. Equal windows of a part are sent once,
   for their least document: in the part's other documents that window is repeated anyway;
3. a bucket sorts its windows by what follows the anchor (a suffix array of the anchors) and extends them backwards,
   breadth first, by the byte before them (a Burrows-Wheeler transform: a stable partition of each interval by that byte
   gives the next order). The common prefixes that sorting gave, cut at `length` less the steps taken back, split an
   interval into the groups that share a whole string; the least document of a group keeps it. Intervals of a single
   document are dropped, and the extension stops at the anchor's reach;
4. each part turns the answers into spans and hashes what is left.

A short phrase in every document gives windows that all differ, and all have one anchor. So at marked anchors the strings
themselves are sent, as 128-bit hashes, each to a bucket of its own hash: only a whole repeated string meets itself there,
once from each part. So an anchor brings no more than `hot_windows` windows into a bucket, or those of one part.

The number of parts follows the bytes of the input. Up to `fan` of them, each part writes a row for each bucket; beyond,
it writes one for each group of buckets, and a relay for each group of buckets and of parts passes them on, so that a
part's rows grow with the root of the number of parts. Texts are shuffled once.

The method derives common prefixes by backward extension alone; here sorting neighbours gives those of the anchors'
suffixes, of at most `length` bytes, and the extension decides from there.

Defined results: a null or empty text has no bytes and nothing removed; equal doc_ids are not earlier than one another;
a null doc_id is later than all others; further columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K = 24  # bytes of an anchor
NO_ID = np.iinfo(np.int64).max


class Part:
    """The documents of a part, by id, as one array of bytes."""

    def __init__(self, table: pa.Table):
        table = table.select(["doc_id", "text"]).sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.doc_id = table["doc_id"]
        self.ids = table["doc_id"].fill_null(NO_ID).to_numpy()
        text = table["text"].cast(pa.large_binary()).fill_null(b"").combine_chunks()
        text = text.chunk(0) if isinstance(text, pa.ChunkedArray) else text
        _, offsets, data = text.buffers()
        offsets = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
        self.bytes = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0]

    def doc(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, at, "right") - 1

    def anchors(self, length: int, step: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of the anchors of all strings inside documents."""
        n, window = len(self.bytes), length - K + 1
        starts, ends = self.offsets[:-1], self.offsets[1:]
        whole = np.ones(n, bool)  # a string starts here
        for back in range(1, length):
            at = ends - back
            whole[at[at >= starts]] = False
        positions, hashes = [], []
        for a in range(0, n, step):
            b = min(a + step, n)
            low = max(0, a - window + 1)
            h = word_hashes(self.bytes[low : b + window + K])
            least = slide(h, window, np.minimum)
            least[~whole[low : low + len(least)]] = 0
            # a word is an anchor if a string holds it that has no lesser one
            room = np.zeros(window - 1, np.uint64)
            most = slide(np.concatenate([room, least, room]), window, np.maximum)[: len(h)]
            hit = np.flatnonzero((h[: len(most)] == most) & (most > 0))
            hit = hit[(hit >= a - low) & (hit < b - low)]
            positions.append(hit + low), hashes.append(h[hit])
        if not positions:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return np.concatenate(positions), np.concatenate(hashes)

    def windows(self, at: np.ndarray, length: int) -> np.ndarray:
        """For each anchor its window, zeros outside the document, then the bytes that it has on the left and right."""
        reach = length - K
        doc = self.doc(at)
        left = np.minimum(reach, at - self.offsets[doc])
        right = np.minimum(reach, self.offsets[doc + 1] - at - K)
        out = np.empty((len(at), K + 2 * reach + 2), np.uint8)
        span = np.arange(-reach, K + reach)
        padded = np.concatenate([np.zeros(reach, np.uint8), self.bytes, np.zeros(reach + K, np.uint8)])
        for s in range(0, len(at), 100_000):
            e = s + 100_000
            w = padded[at[s:e, None] + (span + reach)]
            w[(span < -left[s:e, None]) | (span >= K + right[s:e, None])] = 0
            out[s:e, :-2] = w
        out[:, -2], out[:, -1] = left, right
        return out


def word_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each K-byte word."""
    if len(data) < K:
        return np.zeros(0, np.uint64)
    m = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]
    h = (data.astype(np.uint64) + np.uint64(1)) * m[0]
    for k in (1, 2, 4):
        h = (h[:-k] * m[k % 3 + 1]) + h[k:]
        h ^= h >> np.uint64(29)
    eight = h
    h = eight[:-8] * m[1] + eight[8:]
    h = h[:-8] * m[2] + eight[16:]
    h ^= h >> np.uint64(31)
    h *= m[4]
    h ^= h >> np.uint64(33)
    return h | np.uint64(1)


def slide(x: np.ndarray, window: int, pick) -> np.ndarray:
    """pick over each run of `window` values."""
    if len(x) < window:
        return np.zeros(0, x.dtype)
    done = 1
    y = x
    while 2 * done <= window:
        y = pick(y[:-done], y[done:])
        done *= 2
    return pick(y[: len(y) - (window - done)], y[window - done :]) if done < window else y.copy()


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _low(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _rows(*columns: tuple) -> pa.Table:
    return pa.table({name: pa.array(values, kind) for name, kind, values in columns})


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value: their sizes in bytes, then they, byte by byte of their items."""
    import zstandard

    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes() for a in map(np.ravel, arrays)]
    return np.array([len(r) for r in planes], "<i8").tobytes() + zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpack(value: bytes, *kinds: str) -> list[np.ndarray]:
    import zstandard

    sizes = np.frombuffer(value[: 8 * len(kinds)], "<i8")
    raw = zstandard.ZstdDecompressor().decompress(value[8 * len(kinds) :], max_output_size=int(sizes.sum()) or 1)
    out = []
    for s, e, k in zip(sizes, np.cumsum(sizes), map(np.dtype, kinds)):
        planes = np.frombuffer(raw[e - s : e], np.uint8).reshape(k.itemsize, -1)
        out.append(np.ascontiguousarray(planes.T).view(k).reshape(-1))
    return out


def _steps(x: np.ndarray) -> np.ndarray:
    """Differences, which compress where values rise slowly; np.cumsum undoes them."""
    return np.diff(x, prepend=x.dtype.type(0))


# a message's columns after its destination and its source; bytes come as rows of a matrix
HASHES = ("<u4", "<u4")
MARKS = ("<u4", "u1")
WINDOWS = ("u1", "<i8", "<u4")
STRINGS = ("<u8", "<u8", "<i8", "<u4")
ANSWERS = ("<u4", "<u4")
ROWS = "to int, group int, data binary"


@dataclass(frozen=True)
class Plan:
    """Parts and buckets; windows have the first `buckets` numbers, strings the next."""

    length: int
    parts: int
    fan: int
    hot_windows: int

    @property
    def relayed(self) -> bool:
        return self.parts > self.fan

    @property
    def step(self) -> int:
        return max(2, isqrt(self.parts)) if self.relayed else 1

    @property
    def buckets(self) -> int:
        return -(-self.parts // self.step) * self.step


def _encoded(*columns: np.ndarray) -> bytes:
    return _pack(*[c if c.dtype == np.uint8 else _steps(c) for c in columns])


def _decoded(datas, kinds: tuple[str, ...]) -> list[np.ndarray]:
    """The columns of all messages, one after the other: destination, source, and `kinds`."""
    found = [_unpack(d.as_py(), "<u4", "<u4", *kinds) for d in datas]
    columns = []
    for i, kind in enumerate(("<u4", "<u4", *kinds)):
        if kind == "u1":
            columns.append(np.concatenate([f[i].reshape(len(f[0]), -1) for f in found]))
        else:
            columns.append(np.concatenate([np.cumsum(f[i], dtype=kind) for f in found]))
    return columns


def _sent(to: np.ndarray, group: int, *columns: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Rows (to, group, data): the messages for each `to`."""
    order = np.argsort(to, kind="stable")
    edges = np.flatnonzero(np.diff(to[order].astype(np.int64), prepend=-1, append=-1)) if len(to) else []
    return [(int(to[order[s]]), group, _encoded(*[c[order[s:e]] for c in columns])) for s, e in zip(edges, edges[1:])]


def _messages(plan: Plan, dst: np.ndarray, src: int, *columns: np.ndarray) -> list[tuple[int, int, bytes]]:
    dst = dst.astype(np.uint32)
    return _sent(dst // np.uint32(plan.step), src // plan.step, dst, np.full(len(dst), src, np.uint32), *columns)


def _table(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    to, group, data = zip(*rows) if rows else ((), (), ())
    return _rows(("to", pa.int32(), to), ("group", pa.int32(), group), ("data", pa.binary(), data))


def _delivered(plan: Plan, rows: DataFrame, kinds: tuple[str, ...], others: tuple[str, ...] = ()) -> DataFrame:
    """Rows by their messages' own destination. others: what messages to string buckets have."""
    if not plan.relayed:
        return rows

    def run(key, table):
        to = key[0].as_py()
        if to < 0:
            return table.select(["to", "group", "data"])
        columns = _decoded(table["data"], others if others and to * plan.step >= plan.buckets else kinds)
        return _table(_sent(columns[0], key[1].as_py(), *columns))

    return rows.groupBy("to", "group").applyInArrow(run, ROWS)


def send_hashes(plan: Plan):
    def run(key, table):
        docs = Part(table)
        at, h = docs.anchors(plan.length)
        h, of, n = np.unique((_bucket(h, plan.buckets).astype(np.uint64) << np.uint64(32)) | _low(h), return_inverse=True, return_counts=True)
        often = np.flatnonzero((n > min(64, plan.hot_windows))[of])  # of these different windows are counted, of others all
        if len(often):
            kinds = np.unique(np.stack([of[often], _same(docs.windows(at[often], plan.length))], 1), axis=0)[:, 0]
            n[of[often]] = 0
            np.add.at(n, kinds, 1)
        return _table(_messages(plan, h >> np.uint64(32), key[0].as_py(), _low(h), n.astype(np.uint32)))

    return run


def shared_hashes(plan: Plan):
    """What each part of a bucket shares with another one, and whether it has many windows."""

    def run(key, table):
        _, part, low, n = _decoded(table["data"], HASHES)
        if not len(low):
            return _table([])
        order = np.argsort(low, kind="stable")
        edge = np.flatnonzero(np.diff(low[order].astype(np.int64), prepend=-1))
        parts = np.diff(np.append(edge, len(low)))
        hot = np.add.reduceat(n[order].astype(np.int64), edge) > plan.hot_windows
        some = np.repeat(parts > 1, parts)
        hot, order = np.repeat(hot, parts)[some], order[some]
        return _table(_messages(plan, part[order], key[0].as_py(), low[order], hot.astype(np.uint8)[:, None]))

    return run


def _same(windows: np.ndarray) -> np.ndarray:
    """A group number for each row: equal rows, compared in full, have equal ones."""
    wide = np.zeros((len(windows), -(-windows.shape[1] // 8) * 8), np.uint8)
    wide[:, : windows.shape[1]] = windows
    h = np.zeros(len(windows), np.uint64)
    for c in range(0, wide.shape[1], 8):
        h = (h ^ np.ascontiguousarray(wide[:, c : c + 8]).view(np.uint64)[:, 0]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    _, first, group = np.unique(h, return_index=True, return_inverse=True)
    group = group.astype(np.int64)
    odd = np.flatnonzero((windows != windows[first[group]]).any(axis=1)) if len(windows) else np.zeros(0, int)
    if len(odd):  # equal hashes of different windows
        _, again = np.unique(windows[odd], axis=0, return_inverse=True)
        group[odd] = len(first) + again.reshape(-1)
    return group


def string_starts(docs: Part, at: np.ndarray, length: int) -> np.ndarray:
    """Where strings begin that hold one of the anchors and lie in its document."""
    doc = docs.doc(at)
    low, high = docs.offsets[doc], docs.offsets[doc + 1] - length
    found = [s[(s >= low) & (s <= high)] for s in (at - back for back in range(length - K + 1))]
    return np.unique(np.concatenate(found))


def string_hashes(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Two 64-bit hashes of each string, as columns."""
    out = np.empty((len(starts), 2), np.uint64)
    for s in range(0, len(starts), 100_000):
        at = starts[s : s + 100_000]
        wide = np.zeros((len(at), -(-length // 8) * 8), np.uint8)
        wide[:, :length] = data[at[:, None] + np.arange(length)]
        words = wide.view(np.uint64)
        for k, (m, r) in enumerate(((0x9E3779B97F4A7C15, 32), (0xC2B2AE3D27D4EB4F, 29))):
            h = np.full(len(at), length + k, np.uint64)
            for c in range(words.shape[1]):
                h = (h ^ words[:, c]) * np.uint64(m)
                h ^= h >> np.uint64(r)
            h *= np.uint64(0xFF51AFD7ED558CCD)
            out[s : s + len(at), k] = h ^ (h >> np.uint64(33))
    return out


def _heads(group: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each group the member with the least document, in order, and each member's place among these."""
    order = np.lexsort((doc, group))
    head = np.sort(order[np.flatnonzero(np.diff(group[order], prepend=-1))]) if len(group) else order
    rank = np.zeros(group.max() + 1 if len(group) else 0, np.int64)
    rank[group[head]] = np.arange(len(head))
    return head, rank[group]


def send_windows(plan: Plan):
    """Windows and strings for buckets, and for the part itself (to < 0) its anchors by window and its strings."""
    length = plan.length

    def run(key, table, marks):
        part = key[0].as_py()
        docs = Part(table)
        at, h = docs.anchors(length)
        bucket = _bucket(h, plan.buckets)
        code = (bucket.astype(np.uint64) << np.uint64(32)) | _low(h)
        marked, hot = np.zeros(len(code), bool), np.zeros(len(code), bool)
        if marks.num_rows and len(code):
            _, src, low, many = _decoded(marks["data"], MARKS)
            wanted = (src.astype(np.uint64) << np.uint64(32)) | low
            order = np.argsort(wanted)
            wanted, many = wanted[order], many[order, 0].astype(bool)
            near = np.minimum(np.searchsorted(wanted, code), len(wanted) - 1)
            marked = wanted[near] == code
            hot = marked & many[near]
        # or in two documents of this part
        doc = docs.doc(at)
        order = np.argsort(h, kind="stable")
        edge = np.flatnonzero(np.diff(h[order], prepend=h[order[:1]] ^ np.uint64(2))) if len(h) else np.zeros(0, int)
        if len(edge):
            low, high = np.minimum.reduceat(doc[order], edge), np.maximum.reduceat(doc[order], edge)
            marked[order] |= np.repeat(low != high, np.diff(np.append(edge, len(h))))
        marked &= ~hot
        starts = string_starts(docs, at[hot], length) if hot.any() else np.zeros(0, np.int64)
        at, bucket, doc = at[marked], bucket[marked], doc[marked]
        if not len(at) and not len(starts):
            return _table([])
        windows = docs.windows(at, length)
        head, rank = _heads(_same(windows), doc)
        ids = docs.ids[doc[head]]
        rows = _messages(plan, bucket[head], part, windows[head], ids, np.arange(len(head), dtype=np.uint32))
        hashes = string_hashes(docs.bytes, starts, length)
        _, group = np.unique(hashes, axis=0, return_inverse=True) if len(starts) else (None, starts)
        owner = docs.doc(starts)
        first, place = _heads(group.reshape(-1), owner)
        least = docs.ids[owner[first]]
        refs = (len(head) + np.arange(len(first))).astype(np.uint32)
        rows += _messages(plan, plan.buckets + _bucket(hashes[first, 0], plan.buckets), part, hashes[first, 0], hashes[first, 1], least, refs)
        rows.append((-1 - part, 0, _encoded(at.astype(np.uint32), rank.astype(np.uint32), ids, starts.astype(np.uint32), place.astype(np.uint32), least)))
        return _table(rows)

    return run


def repeated(windows: np.ndarray, ids: np.ndarray, length: int) -> np.ndarray:
    """For each window a mask: bit j is set if a lesser document has the string that starts j bytes before the anchor."""
    n, reach = len(windows), length - K
    left, right = windows[:, -2].astype(np.int64), windows[:, -1].astype(np.int64)
    ahead = windows[:, reach : reach + length]  # from the anchor on
    wide = np.zeros((n, -(-length // 8) * 8), np.uint8)
    wide[:, :length] = ahead
    words = np.ascontiguousarray(wide).view(">u8").astype(np.uint64)
    order = np.lexsort((right, *[words[:, i] for i in reversed(range(words.shape[1]))]))
    # common prefixes of neighbours in that order, as far as both documents go
    common = np.zeros(n, np.int64)
    for s in range(1, n, 100_000):
        a, b = order[s - 1 : s + 99_999], order[s : s + 100_000]
        a = a[: len(b)]
        differ = ahead[a] != ahead[b]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
        common[s : s + len(b)] = np.minimum(first, K + np.minimum(right[a], right[b]))
    mask = np.zeros(n, np.uint32)
    rank = np.arange(n)  # places in the suffix order that are still extended, by interval, then by suffix
    interval = np.cumsum(common < K)
    for back in range(reach + 1):
        if back:
            inside = left[order[rank]] >= back
            rank, interval = rank[inside], interval[inside]
            key = interval * 256 + windows[order[rank], reach - back]  # the byte before: the transform's column
            step = np.argsort(key, kind="stable")
            rank, key = rank[step], key[step]
            interval = np.cumsum(np.diff(key, prepend=-1) != 0)
        # intervals of one document have nothing to give
        if not len(rank):
            break
        edge = np.flatnonzero(np.diff(interval, prepend=-1))
        doc = ids[order[rank]]
        several = np.repeat(np.minimum.reduceat(doc, edge) != np.maximum.reduceat(doc, edge), np.diff(np.append(edge, len(rank))))
        rank, interval, doc = rank[several], interval[several], doc[several]
        if not len(rank):
            break
        split = np.cumsum(common < length - back)[rank]  # suffixes that share what the string still needs
        edge = np.flatnonzero((np.diff(interval, prepend=-1) != 0) | (np.diff(split, prepend=-1) != 0))
        least = np.repeat(np.minimum.reduceat(doc, edge), np.diff(np.append(edge, len(rank))))
        mask[order[rank[doc > least]]] |= np.uint32(1 << back)
    return mask


def judge(plan: Plan):
    def run(key, table):
        to = key[0].as_py()
        if to < 0:  # a part's own rows pass through
            return table.select(["to", "group", "data"])
        if to >= plan.buckets:
            _, part, one, two, ids, ref = _decoded(table["data"], STRINGS)
            order = np.lexsort((two, one))
            new = np.ones(len(order), bool)
            new[1:] = (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]])
            edge = np.flatnonzero(new)
            mask = np.zeros(len(order), np.uint32)
            mask[order] = ids[order] > np.repeat(np.minimum.reduceat(ids[order], edge), np.diff(np.append(edge, len(order))))
        else:
            _, part, windows, ids, ref = _decoded(table["data"], WINDOWS)
            mask = repeated(windows, ids, plan.length)
        some = mask > 0
        return _table(_messages(plan, part[some], to, ref[some], mask[some]))

    return run


def spans_of(docs: Part, answers: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in the part's bytes, of the maximal removed runs."""
    own = [d for to, d in zip(answers["to"].to_pylist(), answers["data"]) if to < 0]
    found = [d for to, d in zip(answers["to"].to_pylist(), answers["data"]) if to >= 0]
    if not own:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kinds = ("<u4", "<u4", "<i8", "<u4", "<u4", "<i8")
    at, group, ids, string, of, least = (np.cumsum(c, dtype=k) for c, k in zip(_unpack(own[0].as_py(), *kinds), kinds))
    mask = np.zeros(len(ids) + len(least), np.uint32)
    if found:
        _, _, ref, m = _decoded(found, ANSWERS)
        mask[ref] = m
    at, string, reach = at.astype(np.int64), string.astype(np.int64), length - K
    doc = docs.doc(at)
    mine = mask[group]
    later = docs.ids[doc] > ids[group]  # the part has this window in a lesser document
    start = np.zeros(len(docs.bytes), bool)
    for back in range(reach + 1):
        s = at - back
        whole = (s >= docs.offsets[doc]) & (s + length <= docs.offsets[doc + 1])
        start[s[whole & (later | (mine >> np.uint32(back) & np.uint32(1)).astype(bool))]] = True
    start[string[(docs.ids[docs.doc(string)] > least[of]) | (mask[len(ids) + of.astype(np.int64)] > 0)]] = True
    s = np.flatnonzero(start)
    if not len(s):
        return s, s
    owner = docs.doc(s)
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] > s[:-1] + length) | (owner[1:] != owner[:-1])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)
    return s[new], s[last] + length


def spans_and_digests(length: int):
    def run(key, table, answers):
        docs = Part(table)
        starts, ends = spans_of(docs, answers, length)
        n = len(docs.ids)
        owner = docs.doc(starts)
        removed = np.bincount(owner, ends - starts, n).astype(np.int64)
        runs = np.bincount(owner, minlength=n)
        first = np.searchsorted(starts, docs.offsets[:-1])
        data, digests = docs.bytes.tobytes(), []
        view = memoryview(data)
        for i, (a, b) in enumerate(zip(docs.offsets[:-1].tolist(), docs.offsets[1:].tolist())):
            left = sha256()
            for k in range(first[i], first[i] + runs[i]):
                left.update(view[a : starts[k]])
                a = int(ends[k])
            left.update(view[a:b])
            digests.append(left.hexdigest())
        sizes = np.diff(docs.offsets)
        return pa.table({"doc_id": docs.doc_id, "n_bytes": pa.array(sizes), "n_removed": pa.array(removed), "n_spans": pa.array(runs.astype(np.int64)), "kept_sha256": pa.array(digests, pa.string())})

    return run


def sized(total: int, fan: int) -> int:
    """Bytes of a part: 12 MB while that makes no more than `fan` parts, then up to 48 MB."""
    return min(48 << 20, max(12 << 20, -(-total // fan)))


def dedupe(docs: DataFrame, length: int = 50, part_bytes: int | None = None, finish=spans_and_digests, schema: str = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", fan: int = 4096, hot_windows: int = 50_000) -> DataFrame:
    """What `finish` makes of each part and its answers; by default one row of digests for each document."""
    if not K < length <= K + 31:
        raise ValueError(f"length must be {K + 1} to {K + 31}")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    plan = Plan(length, -(-total // (part_bytes or sized(total, fan))) + 1, fan, hot_windows)
    texts = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(plan.parts)).cast("int")).repartition(plan.parts, "part")
    by_part = texts.groupBy("part")
    hashes = _delivered(plan, by_part.applyInArrow(send_hashes(plan), ROWS), HASHES)
    marks = _delivered(plan, hashes.groupBy("to").applyInArrow(shared_hashes(plan), ROWS), MARKS)
    windows = by_part.cogroup(marks.groupBy("to")).applyInArrow(send_windows(plan), ROWS)
    windows = _delivered(plan, windows, WINDOWS, STRINGS)
    answers = _delivered(plan, windows.groupBy("to").applyInArrow(judge(plan), ROWS), ANSWERS)
    answers = answers.withColumn("part", F.when(F.col("to") < 0, -1 - F.col("to")).otherwise(F.col("to")))
    return by_part.cogroup(answers.groupBy("part")).applyInArrow(finish(length), schema)


def _cleaned(length: int):
    def run(key, table, answers):
        docs = Part(table)
        starts, ends = spans_of(docs, answers, length)
        gone = np.zeros(len(docs.bytes) + 1, np.int32)
        gone[starts] += 1
        gone[ends] -= 1
        keep = np.cumsum(gone)[:-1] == 0
        # a character of which a byte goes, goes
        first = np.flatnonzero((docs.bytes & 0xC0) != 0x80)
        keep = np.repeat(np.minimum.reduceat(keep, first), np.diff(np.append(first, len(keep)))) if len(first) else keep
        texts = [docs.bytes[a:b][keep[a:b]].tobytes().decode() for a, b in zip(docs.offsets, docs.offsets[1:])]
        return pa.table({"doc_id": docs.doc_id, "text": pa.array(texts, pa.string())})

    return run


def cleaned(docs: DataFrame, length: int = 50, part_bytes: int | None = None) -> DataFrame:
    """(doc_id, text) without the repeated strings."""
    return dedupe(docs, length, part_bytes, _cleaned, "doc_id long, text string")
