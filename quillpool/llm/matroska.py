"""Media columns: payloads in Matroska, and packet tables from parsing it.

The muxer stores 8-bit PCM in clusters of laced SimpleBlocks with cues. The parser reads any file of this kind: EBML
elements with variable-length ids and sizes (unknown sizes too), clusters, SimpleBlocks and BlockGroups with no, Xiph,
fixed-size or EBML lacing, tracks and cues. Each packet has its track, timestamp and byte range in the file.

Defined results: a null or empty text is 64 zero bytes; equal texts give equal files; repeated rows are each stored;
further columns are ignored; an empty table gives an empty table. Bytes that are not Matroska raise ValueError.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from hashlib import sha256
from typing import NamedTuple
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame

# fixed values: element ids of the public specification, with their class bits
EBML, SEGMENT, VOID = 0x1A45DFA3, 0x18538067, 0xEC
EBML_VERSION, EBML_READ, EBML_ID_LEN, EBML_SIZE_LEN, DOCTYPE, DOCTYPE_VERSION, DOCTYPE_READ = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
INFO, TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID, DEFAULT_DURATION = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0x23E383
AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, CLUSTER_TIME, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TOP = {INFO, TRACKS, CLUSTER, CUES, SEGMENT}

RATE = 8000  # samples, here bytes, a second; 8 to a tick of a millisecond
PACKET = 4096
BLOCK_PACKETS, CLUSTER_BLOCKS = 8, 16


class Packet(NamedTuple):
    track: int
    timestamp: int  # in the file's ticks
    start: int  # byte range in the file
    end: int
    lacing: int
    cluster: int


class Media(NamedTuple):
    packets: list[Packet]
    tracks: dict[int, tuple[str, int]]  # number: codec and ticks (nanoseconds) of a packet
    cues: list[tuple[int, int, int]]  # timestamp, track, the cluster's offset in the segment
    clusters: list[int]  # offsets in the segment
    scale: int


# --- writing


def vint(n: int, width: int = 0) -> bytes:
    """A size: leading zeros give the width; all ones are reserved."""
    while not width or n >= (1 << 7 * width) - 1:
        width += 1
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(kind: int, body: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def uint(kind: int, n: int) -> bytes:
    return element(kind, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _signed(n: int) -> bytes:
    """A lace size's difference: an EBML number with its middle subtracted."""
    width = 1
    while abs(n) > (1 << 7 * width - 1) - 2:
        width += 1
    return vint(n + (1 << 7 * width - 1) - 1, width)


def laced(frames: list[bytes], time: int, track: int = 1) -> bytes:
    """A SimpleBlock: no lacing for one frame, fixed for equal sizes, Xiph for short ones, else EBML."""
    sizes = [len(f) for f in frames]
    if len(frames) == 1:
        flags, head = 0x00, b""
    elif len(set(sizes)) == 1:
        flags, head = 0x04, bytes([len(frames) - 1])
    elif max(sizes) < 1024:
        flags, head = 0x02, bytes([len(frames) - 1]) + b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    else:
        flags, head = 0x06, bytes([len(frames) - 1]) + vint(sizes[0]) + b"".join(_signed(b - a) for a, b in zip(sizes, sizes[1:-1]))
    return element(SIMPLE_BLOCK, vint(track) + struct.pack(">hB", time, 0x80 | flags) + head + b"".join(frames))


def mux(payload: bytes, packet: int = PACKET) -> bytes:
    header = element(EBML, uint(EBML_VERSION, 1) + uint(EBML_READ, 1) + uint(EBML_ID_LEN, 4) + uint(EBML_SIZE_LEN, 8) + element(DOCTYPE, b"matroska") + uint(DOCTYPE_VERSION, 4) + uint(DOCTYPE_READ, 2))
    ticks = packet * 1000 // RATE
    info = element(INFO, uint(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) * 1000 / RATE)) + element(MUXING_APP, b"quillpool") + element(WRITING_APP, b"quillpool"))
    audio = element(AUDIO, element(SAMPLING, struct.pack(">d", RATE)) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + uint(FLAG_LACING, 1) + element(CODEC_ID, b"A_PCM/INT/LIT") + uint(DEFAULT_DURATION, ticks * 1_000_000) + audio))
    parts, cues, at = [info, tracks], [], len(info) + len(tracks)
    blocks = min(CLUSTER_BLOCKS, 32_767 // (ticks * BLOCK_PACKETS) + 1)  # a block's time, after its cluster's, has 16 bits
    step = packet * BLOCK_PACKETS * blocks
    for c in range(0, len(payload), step):
        time, body = c // packet * ticks, []
        for b in range(c, min(c + step, len(payload)), packet * BLOCK_PACKETS):
            end = min(b + packet * BLOCK_PACKETS, len(payload))
            body.append(laced([payload[i : min(i + packet, end)] for i in range(b, end, packet)], (b - c) // packet * ticks))
        cluster = element(CLUSTER, uint(CLUSTER_TIME, time) + b"".join(body))
        cues.append(element(CUE_POINT, uint(CUE_TIME, time) + element(CUE_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER, at))))
        parts.append(cluster)
        at += len(cluster)
    parts.append(element(CUES, b"".join(cues)))
    return header + element(SEGMENT, b"".join(parts))


# --- reading


def number(data: bytes, at: int, keep: bool = False) -> tuple[int, int, bool]:
    """The variable-length number at `at`, where it ends, and whether it is the reserved one (unknown size)."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no EBML number at {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise ValueError(f"EBML number at {at} is cut off")
    n = int.from_bytes(data[at : at + width], "big")
    bare = n & (1 << 7 * width) - 1
    return n if keep else bare, at + width, bare == (1 << 7 * width) - 1


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(id, offset, start of the body, end of the body) of the elements side by side in a range."""
    while at < end:
        kind, body, _ = number(data, at, keep=True)
        size, body, unknown = number(data, body)
        stop = end if unknown else body + size
        if unknown and kind == CLUSTER:  # lasts until the next top-level element
            stop = body
            for k, o, _, e in elements(data, body, end):
                if k in TOP:
                    break
                stop = e
        if stop > end:
            raise ValueError(f"element {kind:x} at {at} is cut off")
        yield kind, at, body, stop
        at = stop


def _uint(data: bytes, s: int, e: int) -> int:
    return int.from_bytes(data[s:e], "big")


def lace(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """Byte ranges of a block's frames."""
    if kind == 0:
        return [(at, end)]
    n, at, sizes = data[at] + 1, at + 1, []
    if kind == 1:  # Xiph
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif kind == 3:  # EBML
        for k in range(n - 1):
            width = 9 - data[at].bit_length()
            size, at, _ = number(data, at)
            sizes.append(size if k == 0 else sizes[-1] + size - (1 << 7 * width - 1) + 1)
    else:  # fixed
        if (end - at) % n:
            raise ValueError("unequal frames in fixed-size lacing")
        sizes = [(end - at) // n] * (n - 1)
    out = []
    for size in sizes:
        out.append((at, at + size))
        at += size
    if at > end or min(sizes, default=0) < 0:
        raise ValueError("lace sizes exceed the block")
    return [*out, (at, end)]


def demux(data: bytes) -> Media:
    packets, tracks, cues, clusters, scale = [], {}, [], [], 1_000_000
    seen = False
    for kind, _, body, end in elements(data, 0, len(data)):
        if kind == EBML:
            seen = any(k == DOCTYPE and data[s:e] in (b"matroska", b"webm") for k, _, s, e in elements(data, body, end))
        if kind != SEGMENT:
            continue
        if not seen:
            raise ValueError("not Matroska")
        base = body
        for top, offset, s, e in elements(data, body, end):
            if top == INFO:
                scale = next((_uint(data, a, b) for k, _, a, b in elements(data, s, e) if k == TIMESTAMP_SCALE), scale)
            elif top == TRACKS:
                for k, _, a, b in elements(data, s, e):
                    if k == TRACK_ENTRY:
                        f = {x: data[y:z] for x, _, y, z in elements(data, a, b)}
                        tracks[int.from_bytes(f[TRACK_NUMBER], "big")] = (f.get(CODEC_ID, b"").decode("ascii", "replace"), int.from_bytes(f.get(DEFAULT_DURATION, b"\0"), "big"))
            elif top == CUES:
                for k, _, a, b in elements(data, s, e):
                    point = list(elements(data, a, b)) if k == CUE_POINT else []
                    time = next((_uint(data, y, z) for x, _, y, z in point if x == CUE_TIME), 0)
                    for x, _, y, z in point:
                        if x == CUE_POSITIONS:
                            f = {i: _uint(data, u, v) for i, _, u, v in elements(data, y, z)}
                            cues.append((time, f.get(CUE_TRACK, 0), f.get(CUE_CLUSTER, 0)))
            elif top == CLUSTER:
                now = 0
                for k, _, a, b in elements(data, s, e):
                    if k == CLUSTER_TIME:
                        now = _uint(data, a, b)
                    blocks = [(a, b)] if k == SIMPLE_BLOCK else [(y, z) for x, _, y, z in elements(data, a, b) if x == BLOCK] if k == BLOCK_GROUP else []
                    for y, z in blocks:
                        track, y, _ = number(data, y)
                        time, flags = struct.unpack_from(">hB", data, y)
                        step = tracks.get(track, ("", 0))[1] // scale
                        for i, (u, v) in enumerate(lace(data, y + 3, z, flags >> 1 & 3)):
                            packets.append(Packet(track, now + time + i * step, u, v, flags >> 1 & 3, len(clusters)))
                clusters.append(offset - base)
    return Media(packets, tracks, cues, clusters, scale)


def payload_of(data: bytes, media: Media, track: int = 1) -> bytes:
    return b"".join(data[p.start : p.end] for p in media.packets if p.track == track)


def seek(media: Media, time: int, track: int = 1) -> list[Packet]:
    """The packets from the cued cluster at or before `time`."""
    offset = max((c for t, k, c in media.cues if k == track and t <= time), default=0)
    first = media.clusters.index(offset) if offset in media.clusters else 0
    return [p for p in media.packets if p.cluster >= first and p.track == track]


def feature(media: Media) -> str:
    """Counts of the packet table, and a checksum of it."""
    table = b"".join(struct.pack("<qqqqb", p.track, p.timestamp, p.start, p.end, p.lacing) for p in media.packets)
    last = max((p.timestamp for p in media.packets), default=0)
    cued = sum(c in set(media.clusters) for _, _, c in media.cues)
    return f"tracks={len(media.tracks)};clusters={len(media.clusters)};cues={cued};packets={len(media.packets)};last={last};table={crc32(table):08x}"


# --- columns


def padded(text: str | None) -> tuple[bytes, int]:
    data = (text or "").encode()
    return data + bytes(-len(data) % 64 if data else 64), len(data)


def media_column(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media binary) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                made = [padded(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for _, n in made], pa.int64()), pa.array([mux(p) for p, _ in made], pa.binary())], ["doc_id", "n_bytes", "media"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def packet_table(media: DataFrame) -> DataFrame:
    """(doc_id, packet, track, timestamp, start, end, lacing) from (doc_id, media)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, data in enumerate(b.column(1)):
                found = demux(data.as_py()).packets if data.is_valid else []
                if found:
                    cols = [pa.array([x[k] for x in found], pa.int64()) for k in range(5)]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i] * len(found))), pa.array(range(len(found)), pa.int64()), *cols], ["doc_id", "packet", "track", "timestamp", "start", "end", "lacing"])

    rows = media.select("doc_id", "media")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, packet long, track long, timestamp long, start long, end long, lacing long")


def read_back(media: DataFrame) -> DataFrame:
    """Digests of each row of (doc_id, n_bytes, media): the payload and the features come from the parsed bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for data in b.column(2):
                data = data.as_py()
                found = demux(data)
                payload = payload_of(data, found)
                out.append((len(payload), sha256(payload).hexdigest(), crc32(payload[-64:]), len(data), sha256(data).hexdigest(), feature(found)))
            cols = [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    rows = media.select("doc_id", "n_bytes", "media")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
