"""Token ids in binary files of bit planes.

A file holds the ids of consecutive documents. Ids are taken in blocks of fixed size; a block is transposed into planes,
one for each bit (or byte) of an id, and each plane is compressed by itself: the high planes of most blocks are all but
constant. An index of chunks follows the blocks, so that any block can be read without those before it:

    magic, planes | blocks | documents: ids and numbers of ids | index: offset and sizes of each block's planes | footer

Files are written to the shared folder under a name of their task and moved into place, so a task that runs again, or
twice at once, leaves the same file.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .encoding import encoder

MAGIC, BLOCK = b"VWPLANE1", 1 << 14
#: Ids in a file, about; the number of files follows from the ids of the whole corpus.
FILE_IDS = 1 << 22
MANIFEST = pa.schema([("shard", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())])


def to_planes(ids: np.ndarray, bits: int, unit: str) -> np.ndarray:
    """The planes of a block as rows of bytes, the lowest first."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if unit == "byte":
        return np.ascontiguousarray(raw[:, : (bits + 7) // 8].T)
    return np.packbits(np.unpackbits(raw[:, : (bits + 7) // 8], axis=1, count=bits, bitorder="little").T, axis=1, bitorder="little")


def from_planes(planes: list[bytes], n: int, unit: str) -> np.ndarray:
    rows = np.frombuffer(b"".join(planes), np.uint8).reshape(len(planes), -1)
    raw = np.zeros((n, 4), np.uint8)
    if unit == "byte":
        raw[:, : len(planes)] = rows[:, :n].T
    else:
        cells = np.packbits(np.unpackbits(rows, axis=1, count=n, bitorder="little").T, axis=1, bitorder="little")
        raw[:, : cells.shape[1]] = cells
    return raw.view("<u4").ravel()


def write_file(out, docs: Iterable[tuple[int | None, bytes]], bits: int, unit: str = "bit", block: int = BLOCK, width: int = 4) -> tuple[int, int]:
    """Writes (doc_id, ids as bytes, `width` each) in order; gives the numbers of documents and ids. Holds a block and the index in memory."""
    pack, index, held, size, n_ids = zstandard.ZstdCompressor(level=1).compress, [], [], 0, 0
    out.write(MAGIC)
    at, names, lengths = len(MAGIC), [], []

    def flush(ids: np.ndarray) -> None:
        nonlocal at
        planes = [pack(p.tobytes()) for p in to_planes(ids, bits, unit)]
        for p in planes:
            out.write(p)
        index.append((at, len(ids), *map(len, planes)))
        at += sum(map(len, planes))

    for doc, ids in docs:
        names.append(doc)
        lengths.append(len(ids) // width)
        held.append(ids)
        size += len(ids)
        n_ids += len(ids) // width
        if size >= width * block:
            flat = np.frombuffer(b"".join(held), f"<u{width}")
            whole = len(flat) // block * block
            for i in range(0, whole, block):
                flush(flat[i : i + block])
            held, size = [flat[whole:].tobytes()], width * (len(flat) - whole)
    if size:
        flush(np.frombuffer(b"".join(held), f"<u{width}"))
    docs_at = at
    table = pack(np.array([0 if d is None else d for d in names], "<i8").tobytes() + np.array(lengths, "<i8").tobytes() + bytes(d is None for d in names))
    index_bytes = pack(np.array(index, "<i8").tobytes())
    foot = json.dumps({"bits": bits, "unit": unit, "block": block, "docs": len(names), "ids": n_ids, "blocks": len(index), "planes": len(index[0]) - 2 if index else 0, "docs_at": docs_at, "index_at": docs_at + len(table)}).encode()
    out.write(table + index_bytes + foot + struct.pack("<I", len(foot)) + MAGIC)
    return len(names), n_ids


class Reader:
    """A file's documents, one block in memory at a time, or the ids from any place on."""

    def __init__(self, source):
        self.source, size = source, source.size()
        tail = self._at(size - 12, 12)
        if tail[4:] != MAGIC or self._at(0, 8) != MAGIC:
            raise ValueError("not a file of bit planes")
        n = struct.unpack("<I", tail[:4])[0]
        self.foot = foot = json.loads(self._at(size - 12 - n, n))
        unpack = zstandard.ZstdDecompressor().decompress
        table = unpack(self._at(foot["docs_at"], foot["index_at"] - foot["docs_at"]))
        d = foot["docs"]
        none = table[16 * d :]
        self.doc_ids = [None if none[i] else x for i, x in enumerate(np.frombuffer(table, "<i8", d).tolist())]
        self.lengths = np.frombuffer(table, "<i8", d, 8 * d)
        self.index = np.frombuffer(unpack(self._at(foot["index_at"], size - 12 - n - foot["index_at"])), "<i8").reshape(foot["blocks"], -1)

    def _at(self, place: int, n: int) -> bytes:
        self.source.seek(place)
        return self.source.read(n)

    def block(self, i: int) -> np.ndarray:
        at, n, *sizes = self.index[i].tolist()
        raw, planes, unpack = self._at(at, sum(sizes)), [], zstandard.ZstdDecompressor().decompress
        for s in sizes:
            planes.append(unpack(raw[:s]))
            raw = raw[s:]
        return from_planes(planes, n, self.foot["unit"])

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids from `start` on: only the blocks that hold them are read."""
        size = self.foot["block"]
        parts = [self.block(i) for i in range(start // size, min(self.foot["blocks"], (start + n - 1) // size + 1))] if n else []
        return np.concatenate(parts)[start % size : start % size + n] if parts else np.zeros(0, "<u4")

    def documents(self) -> Iterator[tuple[int | None, bytes]]:
        held, blocks = b"", iter(range(self.foot["blocks"]))
        for doc, n in zip(self.doc_ids, (4 * self.lengths).tolist()):
            parts, size = [held], len(held)
            while size < n:
                parts.append(self.block(next(blocks)).tobytes())
                size += len(parts[-1])
            held = b"".join(parts) if len(parts) > 1 else held
            yield doc, held[:n]
            held = held[n:]


def narrow(ids: bytes, bits: int) -> bytes:
    """Ids of four bytes each as ids of width_of(bits)."""
    wide = np.frombuffer(ids, "<u4")
    if wide.max(initial=0) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    return wide.astype("<u2").tobytes() if width_of(bits) == 2 else ids


def resized(ids: bytes, width: int, bits: int) -> bytes:
    """Ids of `width` bytes each as ids of width_of(bits)."""
    if width == 4:
        return narrow(ids, bits)
    return ids if width_of(bits) == 2 else np.frombuffer(ids, "<u2").astype("<u4").tobytes()


def width_of(bits: int) -> int:
    """Bytes that hold an id on its way to the files."""
    return 2 if bits <= 16 else 4


def encode(df: DataFrame, tokenizer: str, end_id: int, bits: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (little-endian, width_of(bits) bytes each, the end id last), n_tokens, task and nth of every text; null texts are empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("n_tokens", pa.int64()), ("task", pa.int32()), ("nth", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task, nth, width = encoder(tokenizer, end_id), TaskContext.get().partitionId(), 0, width_of(bits)
        if (max(own.size - 1, end_id)) >> bits:
            raise ValueError(f"an id needs more than {bits} bits")
        for b in common.slices(batches):
            ids = own.batch(b.column(1).to_pylist())
            if own.width != width:
                ids = pa.array([resized(x, own.width, bits) for x in ids.to_pylist()], pa.binary())
            n = pc.divide(pc.cast(pc.binary_length(ids), pa.int64()), width)
            yield pa.RecordBatch.from_arrays([b.column(0), ids, n, pa.array(np.full(len(b), task, np.int32)), pa.array(np.arange(nth, nth + len(b)))], schema=schema)
            nth += len(b)

    given = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return given.mapInArrow(run, "doc_id long, ids binary, n_tokens long, task int, nth long")


def write_files(encoded: DataFrame, folder: str, bits: int, unit: str = "bit", file_ids: int = FILE_IDS) -> DataFrame:
    """Writes a written table of encode() in ascending doc_id order (nulls first, ties by task and place), and gives the manifest, a row a file."""
    total = encoded.agg(F.sum("n_tokens")).first()[0] or 0
    ordered = encoded.repartitionByRange(max(1, -(-total // file_ids)), "doc_id", "task", "nth").sortWithinPartitions("doc_id", "task", "nth")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        path, own = f"{base}/shard-{shard:06d}.vwp", f"{base}/.{shard:06d}-{uuid.uuid4().hex}"

        def docs() -> Iterator[tuple[int | None, bytes]]:
            for b in batches:
                for d, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    yield d, i

        with store.open_output_stream(own) as out:
            n_docs, n_ids = write_file(out, docs(), bits, unit, width=width_of(bits))
        size = store.get_file_info(own).size
        if n_docs:
            store.move(own, path)
            yield common.arrow_rows(MANIFEST, [(shard, f"{folder}/shard-{shard:06d}.vwp", n_docs, n_ids, size)])
        else:
            store.delete_file(own)

    return common.written(ordered.select("doc_id", "ids").mapInArrow(run, "shard long, path string, n_docs long, n_ids long, n_bytes long"), "manifest")


def read_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files; start counts the ids of all documents before it."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    placed = manifest.select("shard", "path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                store, name = fs.FileSystem.from_uri(path)
                rows = []
                with store.open_input_file(name) as source:
                    for doc, ids in Reader(source).documents():
                        rows.append((doc, start, len(ids) // 4, zlib.crc32(ids)))
                        start += len(ids) // 4
                        if len(rows) >= 4096:
                            yield common.arrow_rows(schema, rows)
                            rows = []
                yield common.arrow_rows(schema, rows)

    files = max(1, manifest.count())
    return placed.repartitionByRange(files, "shard").select("path", "base").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(df: DataFrame, tokenizer: str, end_id: int, bits: int = 16, unit: str = "bit", folder: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes df, writes the files and gives their manifest. `bits` must hold every id. Repeated rows are kept; an empty table has no file."""
    spark = df.sparkSession
    encoded = common.written(encode(df, tokenizer, end_id, bits, doc_id, text), "encoded")
    return write_files(encoded, folder or common.shared_path(spark, "tokens"), bits, unit)
