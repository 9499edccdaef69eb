"""Token-id files of fixed-width bit packing, with block offsets for random access.

Layout (little-endian): MAGIC, then blocks of BLOCK ids packed in `bits` bits each (the least number
that holds the vocabulary; the last block may be short), then the footer

    doc_id int64[n_docs], doc_start uint64[n_docs + 1], block_offset uint64[n_blocks + 1],

then version, bits, BLOCK uint32, n_docs, n_nulls, n_ids, n_blocks uint64, and MAGIC again. The first n_nulls
documents have no id (their doc_id is 0). A reader takes the
tail, the footer, and then any block on its own; numpy unpacks a block without a loop over ids.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import Scratch, prepared, trimmed

MAGIC = b"GLTOKENS"
VERSION = 2
#: Ids in a block; a multiple of 8, so that every block ends on a byte.
BLOCK = 1 << 16
_TAIL = struct.Struct("<IIIQQQQ8s")


def width(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    low = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(low.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    low = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (low.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


class Writer:
    """Holds one block of ids and the footer."""

    def __init__(self, out, bits: int):
        self.out, self.bits, self.wait, self.n_wait = out, bits, [], 0
        self.doc_ids, self.starts, self.blocks, self.n, self.nulls = [], [0], [], 0, 0
        self.at = out.write(MAGIC) or len(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        """Documents without an id come first."""
        self.nulls += doc_id is None
        self.doc_ids.append(doc_id or 0)
        self.n += len(ids)
        self.starts.append(self.n)
        self.wait.append(ids)
        self.n_wait += len(ids)
        if self.n_wait >= BLOCK:
            ids = np.concatenate(self.wait)
            whole = len(ids) // BLOCK * BLOCK
            for k in range(0, whole, BLOCK):
                self._block(ids[k : k + BLOCK])
            self.wait, self.n_wait = [ids[whole:]], len(ids) - whole

    def _block(self, ids: np.ndarray) -> None:
        data = pack_bits(ids, self.bits)
        self.blocks.append(self.at)
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        if self.n_wait:
            self._block(np.concatenate(self.wait))
        for values, kind in ((self.doc_ids, "<i8"), (self.starts, "<u8"), ([*self.blocks, self.at], "<u8")):
            self.out.write(np.array(values, kind).tobytes())
        self.out.write(_TAIL.pack(VERSION, self.bits, BLOCK, len(self.doc_ids), self.nulls, self.n, len(self.blocks), MAGIC))


class Reader:
    """Random access to a file that has size() and read_at(n, offset)."""

    def __init__(self, file):
        self.file = file
        end = file.size()
        version, self.bits, self.block, self.n_docs, self.n_nulls, self.n, n_blocks, magic = _TAIL.unpack(file.read_at(_TAIL.size, end - _TAIL.size))
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token-id file of this version")
        size = 8 * (2 * self.n_docs + n_blocks + 2)
        footer = file.read_at(size, end - _TAIL.size - size)
        self.doc_ids = np.frombuffer(footer, "<i8", self.n_docs)
        self.starts = np.frombuffer(footer, "<u8", self.n_docs + 1, 8 * self.n_docs).astype(np.int64)
        self.blocks = np.frombuffer(footer, "<u8", n_blocks + 1, 8 * (2 * self.n_docs + 1)).astype(np.int64)
        self._held: tuple[int, np.ndarray] = (-1, np.zeros(0, np.uint32))

    def _ids_of(self, k: int) -> np.ndarray:
        if self._held[0] != k:
            data = self.file.read_at(int(self.blocks[k + 1] - self.blocks[k]), int(self.blocks[k]))
            self._held = (k, unpack_bits(data, self.bits, min(self.block, self.n - k * self.block)))
        return self._held[1]

    def chunks(self, start: int, end: int) -> Iterator[np.ndarray]:
        """The ids from start to end, a block at most at a time."""
        while start < end:
            k = start // self.block
            stop = min(end, (k + 1) * self.block)
            yield self._ids_of(k)[start - k * self.block : stop - k * self.block]
            start = stop

    def document(self, k: int) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint32), *self.chunks(int(self.starts[k]), int(self.starts[k + 1]))])


def _write(path: str, end_id: int, folder: str) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, number = tokens.encoder(path), TaskContext.get().partitionId()
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        final, part = f"{root}/ids-{number:06d}.bin", f"{root}/_part-{uuid.uuid4().hex}"
        end = np.array([end_id], np.uint32)
        with store.open_output_stream(part) as out:
            writer = Writer(out, width(coder.size))
            for batch in batches:
                for i, encoded in tokens.encoded(batch.column(1), coder):
                    for k, ids in enumerate(encoded):
                        writer.add(batch.column(0)[i + k].as_py(), np.concatenate([ids, end]))
            writer.close()
        store.move(part, final)
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([writer.n], pa.int64())], ["file", "n_ids"])

    return run


def _read(folder: str) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for number, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_file(f"{root}/ids-{number:06d}.bin") as file:
                    reader = Reader(file)
                    for first in range(0, reader.n_docs, 10_000):
                        crc = []
                        rows = range(first, min(reader.n_docs, first + 10_000))
                        for k in rows:
                            value = 0
                            for ids in reader.chunks(int(reader.starts[k]), int(reader.starts[k + 1])):
                                value = zlib.crc32(ids.astype("<u4").tobytes(), value)
                            crc.append(value)
                        starts = reader.starts[rows.start : rows.stop + 1]
                        nulls = np.arange(rows.start, rows.stop) < reader.n_nulls
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(reader.doc_ids[rows.start : rows.stop], mask=nulls), pa.array(starts[:-1] + base), pa.array(np.diff(starts)), pa.array(crc, pa.int64())],
                            ["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    return run


def write_ids(docs: DataFrame, folder: str, path: str, end_id: int, files: int, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[int, int]]:
    """Writes one file per range of ascending ids and returns (file, ids of all files before it).

    A task writes under a name of its own and renames, so a repeated task leaves the same one file. Only
    one number per file comes to the driver. Rows with a null id come before all others; null and empty texts are the
    end id alone; equal ids are ordered by text. An empty table gives no files.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(files, F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    written = Scratch(docs.sparkSession, "bitpack").save(rows.mapInArrow(trimmed(_write(path, end_id, folder)), "file int, n_ids long"), "written")
    out, before = [], 0
    for row in sorted(written.collect()):
        out.append((row.file, before))
        before += row.n_ids
    return out


def read_ids(spark, folder: str, files: list[tuple[int, int]]) -> DataFrame:
    """One row per document of those files: doc_id, start, n_tokens, ids_crc32, each file read by its own task."""
    listed = spark.createDataFrame([(k, *x) for k, x in enumerate(files)], "k long, file int, before long")
    prepared(spark)
    n = max(1, len(files))
    listed = spark.range(0, n, 1, n).join(F.broadcast(listed), F.col("id") == F.col("k")).select("file", "before")  # a row a partition
    return listed.mapInArrow(trimmed(_read(folder)), "doc_id long, start long, n_tokens long, ids_crc32 long")
