"""Token-id files: independent zstandard frames, one for each document, with a trailing seek table.

A file is a run of zstandard frames followed by two skippable frames. The first holds the document ids, one JSON list.
The second is the seek table of the public seekable format: for each frame its compressed size, its size and the low 32
bits of the XXH64 of its content, all little-endian unsigned 32-bit, then the number of frames, a descriptor byte and
the magic number. A reader takes the table from the end, then decompresses only the frames it wants, and checks each.
Contents are little-endian unsigned 16-bit ids where the vocabulary allows it, else 32-bit, as the file's width byte says.

Files are written under the shared folder. Each attempt writes its own file, so retried and speculative tasks never
touch a file that others may read; only attempts that committed are in the manifest. The number of files follows the
bytes and rows of the input, so that a file's size is bounded.

Defined results: a null or empty text is the end id alone; repeated ids are written each, side by side, by the MD5 of
their texts, so that places never depend on the order of the input; null ids come first; further columns are ignored; an
empty table gives an empty table and no files.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, shared_dir
from .tokens import batches_of, encoder

# fixed values of the seekable format
SKIPPABLE, INDEX = 0x184D2A5E, 0x184D2A50
SEEKABLE = 0x8F92EAB1
CHECKSUMS = 0x80


def low64(data: bytes) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(data) & 0xFFFFFFFF


class Writer:
    """Appends documents to an open binary file."""

    def __init__(self, out, width: int, level: int = 1):
        import zstandard

        self.out, self.width, self.compress = out, width, zstandard.ZstdCompressor(level=level).compress
        self.ids: list = []
        self.entries = bytearray()

    def add(self, doc_id, ids: np.ndarray) -> None:
        data = ids.astype("<u2" if self.width == 2 else "<u4").tobytes()
        frame = self.compress(data)
        self.out.write(frame)
        self.ids.append(doc_id)
        self.entries += struct.pack("<III", len(frame), len(data), low64(data))

    def close(self) -> None:
        index = bytes([self.width]) + json.dumps(self.ids).encode()
        self.out.write(struct.pack("<II", INDEX, len(index)) + index)
        table = bytes(self.entries) + struct.pack("<IBI", len(self.ids), CHECKSUMS, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


class Reader:
    """Reads chosen documents of a seekable file object."""

    def __init__(self, source, size: int):
        import zstandard

        self.source, self.decompress = source, zstandard.ZstdDecompressor().decompress
        source.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE or flags != CHECKSUMS:
            raise ValueError("no seek table")
        at = size - 9 - 12 * n
        source.seek(at - 8)
        kind, length = struct.unpack("<II", source.read(8))
        if kind != SKIPPABLE or length != 12 * n + 9:
            raise ValueError("damaged seek table")
        self.entries = np.frombuffer(source.read(12 * n), "<u4").reshape(n, 3)
        ends = np.cumsum(self.entries[:, 0], dtype=np.int64)
        self.starts = ends - self.entries[:, 0]
        source.seek(int(ends[-1]) if n else 0)
        kind, length = struct.unpack("<II", source.read(8))
        if kind != INDEX:
            raise ValueError("no index")
        index = source.read(length)
        self.width, self.ids = index[0], json.loads(index[1:])

    def document(self, k: int) -> bytes:
        """The k-th document's ids, as little-endian unsigned 32-bit."""
        packed, size, check = (int(x) for x in self.entries[k])
        self.source.seek(int(self.starts[k]))
        data = self.decompress(self.source.read(packed), max_output_size=size) if size else b""
        if len(data) != size or low64(data) != check:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(data, "<u2").astype("<u4").tobytes() if self.width == 2 else data


def write(docs: DataFrame, folder: str, path: str, end_id: int, drops_space: bool = True, partitions: int | None = None) -> DataFrame:
    """Writes the files and returns their manifest: (part, file, n_docs, n_tokens), parts in order of doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        encoding = encoder(path, drops_space)
        at = TaskContext.get()
        writer = out = None
        docs_, tokens = 0, 0
        for b in batches:
            doc_ids = b.column(0).to_pylist()
            for first, texts in batches_of(b.column(1)):
                if writer is None:
                    store, base = fs.FileSystem.from_uri(folder)
                    store.create_dir(base, recursive=True)
                    name = f"part-{at.partitionId():06d}-{at.taskAttemptId()}.tokens"
                    out = store.open_output_stream(f"{base}/{name}")
                    width = 2 if max(encoding.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
                    writer = Writer(out, width)
                ids, begins = encoding.batch(texts, end_id)
                for doc_id, s, e in zip(doc_ids[first:], begins.tolist(), begins[1:].tolist()):
                    writer.add(doc_id, ids[s:e])
                docs_, tokens = docs_ + len(texts), tokens + len(ids)
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([at.partitionId()], pa.int32()), pa.array([name]), pa.array([docs_]), pa.array([tokens])], ["part", "file", "n_docs", "n_tokens"])

    rows = docs.select("doc_id", "text")
    n = partitions or file_count(rows)
    order = [F.col("doc_id").asc_nulls_first(), F.unhex(F.md5(F.coalesce("text", F.lit("")))).asc()]
    ordered = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return cut(ordered.mapInArrow(run, "part int, file string, n_docs long, n_tokens long"))


def file_count(rows: DataFrame, file_rows: int = 1_000_000) -> int:
    """Files of about 16 MB of text, of up to 256 MB where that makes more than 20,000, and of about `file_rows` documents."""
    size, n = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    file_bytes = min(256 << 20, max(16 << 20, size // 20_000))
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return max(-(-size // file_bytes), -(-n // file_rows), min(cores, size >> 20), 1)


def read(manifest: DataFrame, folder: str, id_type: str = "bigint", wanted: list | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files; only documents of `wanted`, if given, are decompressed."""
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each file
    files = manifest.select("file", F.coalesce(before, F.lit(0)).cast("long").alias("before"))
    only = None if wanted is None else set(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        for b in batches:
            for name, start in zip(*(c.to_pylist() for c in b.columns)):
                info = store.get_file_info(f"{base}/{name}")
                with store.open_input_file(info.path) as source:
                    r = Reader(source, info.size)
                    sizes = r.entries[:, 1].astype(np.int64) // r.width
                    starts = start + np.cumsum(sizes) - sizes
                    keep = [k for k, d in enumerate(r.ids) if only is None or d in only]
                    crcs = [crc32(r.document(k)) for k in keep]
                    yield pa.RecordBatch.from_arrays([pa.array([r.ids[k] for k in keep], kind), pa.array(starts[keep]), pa.array(sizes[keep]), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    kind = pa.string() if id_type == "string" else pa.int64()
    n = max(1, manifest.count())
    return files.repartition(n).mapInArrow(run, f"doc_id {'string' if id_type == 'string' else 'long'}, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    folder = f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    manifest = write(docs, folder, path, end_id)
    return read(manifest, folder, "string" if docs.schema["doc_id"].dataType.simpleString() == "string" else "bigint")
