"""Token ids in files of shuffled planes.

A file holds the ids of its documents one after the other, cut into blocks of `BLOCK` ids. Each block is transposed: plane k
holds byte k (or bit k) of every id, so what varies little stands together, and each plane is compressed by itself with
zstandard. Planes that are zero in the whole block are not stored. Layout, all numbers little-endian:

    magic | planes of block 0 | planes of block 1 | ... | index, zstandard | length of the index as 8 bytes | magic

The index lists the blocks (place in the file, ids, length of each plane) and the documents (id, whether it is null, ids), so any
run of ids is read by decoding the blocks it touches.

Documents are sorted by id over all files by a range shuffle of their texts; each task tokenises, in order, what it
got and writes one file under another name, then renames it, so a task that runs twice leaves one file. Files go through
Arrow's file systems: the shared folder may be a mount or a store Arrow knows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfarer.llm import words as W
from wayfarer.llm.base import stage
from wayfarer.llm.packing import WordEncoder
from wayfarer.session import shuffle_width, staged_path

BLOCK = 1 << 16  #: ids of a block
FILE_BYTES = 64 << 20  #: text that goes to one file
FILE_ROWS = 500_000  #: documents that go to one file
READ = 1 << 20  #: ids a reading task holds beside one document's
MAGIC = b"IDPLANE1"
LEVEL = 3


def split_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of a block, lowest first, up to the highest that is not all zero."""
    ids = np.ascontiguousarray(ids, "<u4")
    bits = int(ids.max(initial=0)).bit_length()
    if kind == "byte":
        return [p.tobytes() for p in ids.view(np.uint8).reshape(-1, 4).T[: -(-bits // 8)]]
    if kind != "bit":
        raise ValueError(f"planes are of kind byte or bit, not {kind}")
    return [np.packbits((ids >> np.uint32(k)).astype(np.uint8) & 1, bitorder="little").tobytes() for k in range(bits)]


def join_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    """The ids of a block from its planes."""
    if kind == "byte":
        out = np.zeros((n, 4), np.uint8)
        for k, plane in enumerate(planes):
            out[:, k] = np.frombuffer(plane, np.uint8)
        return out.reshape(-1).view("<u4")
    ids = np.zeros(n, "<u4")
    for k, plane in enumerate(planes):
        ids |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n, bitorder="little").astype("<u4") << np.uint32(k)
    return ids


class PlaneWriter:
    """Writes one file to `sink`: `add` documents in turn, then `close`."""

    def __init__(self, sink, kind: str = "byte", block: int = BLOCK) -> None:
        self.sink, self.kind, self.block = sink, kind, block
        self.zip = zstandard.ZstdCompressor(level=LEVEL)
        self.waiting, self.held, self.at = [], 0, len(MAGIC)
        self.blocks: list[tuple[int, int, list[int]]] = []
        self.docs, self.lengths = [], []
        sink.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.lengths.append(len(ids))
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.block:
            flat = np.concatenate(self.waiting)
            whole = len(flat) - len(flat) % self.block
            for k in range(0, whole, self.block):
                self._put(flat[k : k + self.block])
            self.waiting, self.held = [flat[whole:].copy()], len(flat) - whole

    def _put(self, ids: np.ndarray) -> None:
        packed = [self.zip.compress(p) for p in split_planes(ids, self.kind)]
        self.blocks.append((self.at, len(ids), [len(p) for p in packed]))
        for p in packed:
            self.sink.write(p)
            self.at += len(p)

    def close(self) -> None:
        if self.held:
            self._put(np.concatenate(self.waiting))
        width = max((len(b[2]) for b in self.blocks), default=0)
        head = np.array([len(self.blocks), len(self.docs), width, self.block, self.kind == "bit"], "<i8")
        table = np.array([[at, n, *sizes, *[0] * (width - len(sizes))] for at, n, sizes in self.blocks], "<i8")
        null = np.array([d is None for d in self.docs], np.uint8)
        docs = np.array([0 if d is None else d for d in self.docs], "<i8")
        index = self.zip.compress(b"".join(x.tobytes() for x in (head, table, docs, np.array(self.lengths, "<i8"), null)))
        self.sink.write(index + len(index).to_bytes(8, "little") + MAGIC)
        self.at += len(index) + 8 + len(MAGIC)


class PlaneReader:
    """Reads a file through `source` (seekable): `docs` and `lengths` of its documents, and any run of ids."""

    def __init__(self, source, size: int) -> None:
        self.source = source
        self.unzip = zstandard.ZstdDecompressor()
        source.seek(size - 8 - len(MAGIC))
        tail = source.read(8 + len(MAGIC))
        if tail[8:] != MAGIC:
            raise ValueError("not a file of id planes, or cut short")
        length = int.from_bytes(tail[:8], "little")
        source.seek(size - 8 - len(MAGIC) - length)
        raw = self.unzip.decompress(source.read(length))
        blocks, docs, width, self.block, bit = np.frombuffer(raw, "<i8", 5).tolist()
        self.kind = "bit" if bit else "byte"
        at = 40
        self.table = np.frombuffer(raw, "<i8", blocks * (2 + width), at).reshape(blocks, -1) if blocks else np.zeros((0, 2), np.int64)
        at += blocks * (2 + width) * 8
        self.docs, self.lengths = np.frombuffer(raw, "<i8", docs, at), np.frombuffer(raw, "<i8", docs, at + 8 * docs)
        self.null = np.frombuffer(raw, np.uint8, docs, at + 16 * docs).astype(bool)
        self._last: tuple[int, np.ndarray] = (-1, np.zeros(0, "<u4"))

    def ids_of_block(self, k: int) -> np.ndarray:
        if self._last[0] != k:
            at, n, *sizes = self.table[k].tolist()
            self.source.seek(at)
            planes = [self.unzip.decompress(self.source.read(size)) for size in sizes if size]
            self._last = (k, join_planes(planes, n, self.kind))
        return self._last[1]

    def read(self, start: int, n: int) -> np.ndarray:
        """`n` ids from place `start` of the file, decoding only the blocks they lie in."""
        out = np.empty(n, "<u4")
        done = 0
        while done < n:
            k, inside = divmod(start + done, self.block)
            some = self.ids_of_block(k)[inside : inside + n - done]
            out[done : done + len(some)] = some
            done += len(some)
        return out


def _files(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def write(docs: DataFrame, tokenizer_path: str, end_id: int = 1, kind: str = "byte", folder: str | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the ids of `docs` (doc_id, text) to files under `folder` (one that `session.drop_staged` removes unless named);
    returns the manifest: part, path, size, n_docs, n_ids, a row per file, in id order.

    Ascending doc_id, rows without one first; rows that share an id in the order of their texts' hashes. Null and empty
    texts are the end id alone; repeated rows are written each. Other columns are ignored. An empty table gives no file.
    """
    spark = docs.sparkSession
    folder = folder or staged_path(spark, "planes")
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    parts = max(1, -(-(size["bytes"] or 0) // file_bytes), -(-size["n"] // FILE_ROWS))
    parts = max(parts, min(shuffle_width(spark), -(-(size["bytes"] or 0) // (1 << 20))))
    # the last column parts equal rows, so copies of one row don't all go to one task
    order = [F.asc_nulls_first("doc_id"), F.asc_nulls_first("hash__"), F.asc("row__")]
    cut = rows.withColumns({"hash__": F.xxhash64("text"), "row__": F.monotonically_increasing_id()}).repartitionByRange(int(parts), *order).sortWithinPartitions(*order)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of(tokenizer_path)
        part = TaskContext.get().partitionId()
        store, base = _files(folder)
        store.create_dir(base, recursive=True)
        own, path = f"{base}/.{part:06d}-{uuid.uuid4().hex}", f"{base}/{part:06d}.planes"
        writer = None
        try:
            with store.open_output_stream(own) as sink:
                writer = PlaneWriter(sink, kind)
                for batch in batches:
                    for some in W.slices(batch, "text", 512 << 10):
                        ids, offsets = encoder.encode(some.column("text"))
                        for doc, a, b in zip(some.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                            writer.add(doc, np.append(ids[a:b], np.uint32(end_id)))
                writer.close()
            if writer.docs:
                store.move(own, path)
        finally:
            if store.get_file_info(own).type != pafs.FileType.NotFound:
                store.delete_file(own)
        if writer.docs:
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([f"{folder}/{part:06d}.planes"]), *[pa.array([v], pa.int64()) for v in (writer.at, len(writer.docs), sum(writer.lengths))]],
                ["part", "path", "size", "n_docs", "n_ids"])

    return stage(cut.select("doc_id", "text").mapInArrow(put, "part int, path string, size long, n_docs long, n_ids long"), "manifest")


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the files of `manifest`: `start` counts the ids of all documents
    before it, `ids` are little-endian unsigned 32-bit. A task reads one file, block by block."""
    files, total = [], 0
    for row in manifest.orderBy("part").collect():  # a row per file
        files.append((row["path"], row["size"], total))
        total += row["n_ids"]
    sent = spark.sparkContext.broadcast(files)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column("id").to_pylist():
                uri, size, base = sent.value[number]
                store, path = _files(uri)
                with store.open_input_file(path) as source:
                    reader = PlaneReader(source, size)
                    starts = np.concatenate(([0], np.cumsum(reader.lengths)))
                    first = 0
                    while first < len(reader.docs):  # as many documents as hold READ ids, one at least
                        stop = max(first + 1, int(np.searchsorted(starts, starts[first] + READ, side="right")) - 1)
                        flat = reader.read(int(starts[first]), int(starts[stop] - starts[first]))
                        bounds = (starts[first : stop + 1] - starts[first]) * 4
                        raw = flat.tobytes()
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(reader.docs[first:stop], mask=reader.null[first:stop]), pa.array(base + starts[first:stop]), pa.array(reader.lengths[first:stop]),
                             pa.array([raw[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())], pa.binary())], ["doc_id", "start", "n_tokens", "ids"])
                        first = stop

    return spark.range(0, len(files), 1, max(1, len(files))).mapInArrow(take, "doc_id long, start long, n_tokens long, ids binary")
