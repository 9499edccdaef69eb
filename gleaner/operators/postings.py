"""Coded posting blocks: gaps, frequencies and lengths as varints, a block for each term and range of passages.

A block's row says how many postings it has and from which passage to which, so that a reader can pass over blocks, and Parquet
over row groups, since rows are sorted by term and block. A common term is many blocks, dealt out by both; terms in more
passages than the cap keep their document frequency elsewhere but have no blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.config import DEFAULT, RetrievalConfig
from gleaner.operators import lexical as L
from gleaner.ship import ship

#: Passage ids of a block span this many numbers.
SPAN = 1 << 32
BLOCK = "term string, block long, n long, first_id long, last_id long, data binary"
_NAMES = [c.split()[0] for c in BLOCK.split(", ")]


def sizes(values: np.ndarray) -> np.ndarray:
    """Bytes of each number's varint."""
    size = np.ones(len(values), np.int64)
    for k in range(1, 10):
        size += values.astype(np.uint64) >= np.uint64(1 << (7 * k))
    return size


def encoded(values: np.ndarray) -> np.ndarray:
    """The varints of non-negative numbers one after another: seven bits a byte, low ones first, the top bit on all bytes but the last."""
    values = values.astype(np.uint64)
    size = sizes(values)
    at = np.repeat(np.cumsum(size) - size, size)
    place = np.arange(len(at)) - at
    out = (np.repeat(values, size) >> (np.uint64(7) * place.astype(np.uint64))) & np.uint64(127)
    last = place == np.repeat(size, size) - 1
    return np.where(last, out, out | np.uint64(128)).astype(np.uint8)


def decoded(data: np.ndarray) -> np.ndarray:
    """The numbers of varints, all at once: each byte is shifted by its place after the last byte of the number before."""
    last = data < 128
    number = np.cumsum(last) - last
    begin = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1]) if last.any() else np.zeros(0, np.int64)
    place = np.arange(len(data)) - begin[number]
    out = np.zeros(int(last.sum()), np.uint64)
    np.bitwise_or.at(out, number, (data & 127).astype(np.uint64) << (np.uint64(7) * place.astype(np.uint64)))
    return out.astype(np.int64)


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (term, block, passage_id, tf, doclen) sorted by all of them in this order."""
    held: list[pa.RecordBatch] = []

    def blocks(rows: pa.RecordBatch, edges: list[int]) -> pa.RecordBatch:
        ids, tf, size, block = (rows.column(c).to_numpy() for c in ("passage_id", "tf", "doclen", "block"))
        begin, end = np.array(edges[:-1]), np.array(edges[1:])
        ids, tf, size, block = (x[: end[-1]] for x in (ids, tf, size, block))
        gaps = np.diff(ids, prepend=0)
        gaps[begin] = ids[begin] - block[begin] * SPAN
        values = np.stack([gaps, tf, size], 1).ravel()
        to = np.concatenate([[0], np.cumsum(sizes(values))[3 * end - 1]]).astype(np.int32)
        data = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(to), pa.py_buffer(encoded(values))])
        columns = [rows.column("term").take(pa.array(begin)), *(pa.array(x) for x in (block[begin], end - begin, ids[begin], ids[end - 1])), data]
        return pa.RecordBatch.from_arrays(columns, _NAMES)

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows = joined()
        block, term = rows.column("block").to_numpy(), rows.column("term").dictionary_encode().indices.to_numpy()
        edges = [0, *(np.flatnonzero((block[1:] != block[:-1]) | (term[1:] != term[:-1])) + 1).tolist()]
        if len(edges) > 1:  # the last block may go on in the next batch
            yield blocks(rows, edges)
            held[:] = [rows.slice(edges[-1])]
    if held:
        rows = joined()
        yield blocks(rows, [0, rows.num_rows])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks as rows again: all columns but the block's own are repeated for each posting."""
    for batch in batches:
        if not batch.num_rows:
            continue
        n, block = batch.column("n").to_numpy(), batch.column("block").to_numpy()
        values = decoded(np.frombuffer(b"".join(batch.column("data").to_pylist()), np.uint8)).reshape(-1, 3)
        total = np.cumsum(values[:, 0])
        first = np.cumsum(n) - n
        ids = total - np.repeat(total[first] - values[first, 0], n) + np.repeat(block * SPAN, n)
        row = pa.array(np.repeat(np.arange(len(n)), n))
        kept = [c for c in batch.schema.names if c not in _NAMES[1:]]
        columns = [*(batch.column(c).take(row) for c in kept), *(pa.array(c) for c in (ids, values[:, 1], values[:, 2]))]
        yield pa.RecordBatch.from_arrays(columns, [*kept, "passage_id", "tf", "doclen"])


def capped(index: L.Index, config: RetrievalConfig = DEFAULT) -> DataFrame:
    """The document frequencies (term, df) of terms that have postings."""
    return index.dfs.crossJoin(F.broadcast(index.stats.select("n"))).where(F.col("df") <= L.df_cap(F.col("n"), config)).select("term", "df")


def write_blocks(index: L.Index, folder: str, config: RetrievalConfig = DEFAULT) -> DataFrame:
    """Writes the blocks of all terms under the cap, sorted by term and block within each file, and opens them."""
    spark = ship(index.tf.sparkSession)
    # Terms over the cap are few whatever the vocabulary: each fills its share of all postings.
    over = index.dfs.crossJoin(F.broadcast(index.stats.select("n"))).where(F.col("df") > L.df_cap(F.col("n"), config)).select("term")
    rows = index.tf.join(L.small(over), "term", "left_anti").select("term", F.floor(F.col("passage_id") / SPAN).alias("block"), "passage_id", "tf", "doclen")
    rows = rows.repartition("term", "block").sortWithinPartitions("term", "block", "passage_id")
    rows.mapInArrow(_write, BLOCK).write.parquet(folder)
    return spark.read.parquet(folder)


def read_blocks(blocks: DataFrame) -> DataFrame:
    """(term, ..., passage_id, tf, doclen): a row for each posting, with the columns that were joined to the blocks."""
    kept = [f"{name} {kind}" for name, kind in blocks.dtypes if name not in _NAMES[1:]]
    return blocks.mapInArrow(_read, ", ".join([*kept, "passage_id long, tf long, doclen long"]))


def bm25(weighted: DataFrame, blocks: DataFrame, index: L.Index, config: RetrievalConfig = DEFAULT) -> DataFrame:
    """(question_id, passage_id, lexical) from blocks alone: only the blocks of weighted terms (question_id, term, weight) are decoded."""
    asked = index.dfs.join(L.small(weighted), "term")
    hits = read_blocks(blocks.join(L.small(asked), "term")).crossJoin(F.broadcast(index.stats))
    part = L.bm25_part(F.col("weight"), L.idf(F.col("n"), F.col("df")), F.col("tf"), F.col("doclen"), F.col("avgdl"), config)
    return hits.select("question_id", "passage_id", part.alias("part")).groupBy("question_id", "passage_id").agg(F.sum("part").alias("lexical"))
