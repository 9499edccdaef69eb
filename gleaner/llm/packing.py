"""Vector bin packing of token pieces: the dot-product heuristic under several limits at once.

Every sequence is a bin with three capacities: tokens, segments (pieces) and loss-bearing tokens.
Whole sequences' worth of a document that keep all limits become sequences of their own, of a piece that bears no loss and
one that does. The rest waits in a window of WINDOW pieces; a sequence takes, again and again, the piece that fits and whose demand has the
greatest dot product with the sequence's remaining capacity (both in shares of the limits). If none
fits, the waiting piece of which most fits is cut: a sequence that has reached its limit of loss-bearing
tokens is filled with the beginnings of others, which bear none. Each input partition packs its own rows and
needs no shuffle; at most its last few sequences are padded.

A table of plain documents has no loss mask, so `pack` gives them one as in instruction data: the first
prompt_share of a document's tokens is its prompt, the rest bears loss.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import prepared, trimmed

#: Pieces that wait for a sequence in each partition.
WINDOW = 1024


@dataclass(frozen=True)
class Limits:
    tokens: int = 1024
    segments: int = 64
    loss_tokens: int = 1024


class Packer:
    """Packs items (key, n_tokens, n_loss) and gives placements (key, start, length, sequence, offset).

    Loss-bearing tokens are the last n_loss of an item, as in an instruction and its answer. Items may be
    cut anywhere. Items of no tokens get no placement.
    """

    def __init__(self, limits: Limits):
        self.limits, self.next = limits, 0
        self.key: list[int] = []
        self.span: list[tuple[int, int, int]] = []  # start, end, first loss-bearing token

    def _loss(self, start: int, end: int, loss_from: int) -> int:
        return max(0, end - max(start, loss_from))

    def _fitting(self, start: int, end: int, loss_from: int, room: int, loss_room: int) -> int:
        """The greatest end at which a piece from start has room."""
        return max(start, min(end, start + room, max(start, loss_from) + loss_room))

    def add(self, key: int, n_tokens: int, n_loss: int) -> Iterator[tuple[int, int, int, int, int]]:
        loss_from, most = n_tokens - n_loss, self.limits
        p, q = 0, loss_from  # what is left is p to loss_from and q to n_tokens
        while (left := loss_from - p + n_tokens - q) >= most.tokens:
            # A sequence of its own takes the item's two kinds of tokens in the shares that they have, so that neither is short at the end.
            first = min(loss_from - p, most.tokens - (n_tokens - q) * most.tokens // left)
            rest = most.tokens - first
            if rest > most.loss_tokens or (first and rest and most.segments < 2):
                break
            if first:
                yield key, p, first, self.next, 0
            if rest:
                yield key, q, rest, self.next, first
            p, q, self.next = p + first, q + rest, self.next + 1
        for start, stop in [(p, n_tokens)] if q == loss_from else [(p, loss_from), (q, n_tokens)]:
            while start < stop:
                end = self._fitting(start, stop, loss_from, most.tokens, most.loss_tokens)
                self.key.append(key)
                self.span.append((start, end, loss_from))
                start = end
        if len(self.key) >= WINDOW:
            yield from self.drain(WINDOW // 2)

    def drain(self, leave: int = 0) -> Iterator[tuple[int, int, int, int, int]]:
        """Packs until at most `leave` pieces wait."""
        most = self.limits
        scale = np.array([most.tokens, most.segments, most.loss_tokens], float)
        keys, spans = self.key, list(self.span)
        need = np.array([[b - a, 1, self._loss(a, b, c)] for a, b, c in spans], float).reshape(-1, 3)
        order = np.argsort(-need[:, 0], kind="stable")
        need, index = need[order], order.tolist()
        ends = np.array(spans, float).reshape(-1, 3)[order]  # start, end, first loss-bearing token
        share, waiting = need / scale**2, np.ones(len(index), bool)
        left = len(index)
        while left > leave:
            room, offset = scale.copy(), 0
            while left:
                fits = waiting & (need <= room).all(axis=1)
                if fits.any():
                    k = int(np.argmax(np.where(fits, share @ room, -1.0)))
                    cut = None
                else:
                    if room.min() < 1 and (room[0] < 1 or room[1] < 1):
                        break
                    reach = np.minimum(ends[:, 0] + room[0], np.maximum(ends[:, 0], ends[:, 2]) + room[2])
                    k = int(np.argmax(np.where(waiting, np.minimum(reach, ends[:, 1]) - ends[:, 0], -1.0)))
                    a, b, c = spans[index[k]]
                    cut = self._fitting(a, b, c, int(room[0]), int(room[2]))
                    if cut == a:
                        break
                a, b, c = spans[index[k]]
                end = b if cut is None else cut
                yield keys[index[k]], a, end - a, self.next, offset
                offset += end - a
                room -= [end - a, 1, self._loss(a, end, c)]
                if cut is None:
                    waiting[k] = False
                    left -= 1
                else:
                    spans[index[k]] = (cut, b, c)
                    ends[k, 0] = cut
                    need[k] = [b - cut, 1, self._loss(cut, b, c)]
                    share[k] = need[k] / scale**2
            self.next += 1
        kept = sorted(index[k] for k in np.flatnonzero(waiting).tolist())
        self.key, self.span = [keys[k] for k in kept], [spans[k] for k in kept]


def place(sizes: list[tuple[int, int]], limits: Limits) -> list[tuple[int, int, int, int, int]]:
    """Placements of items given as (n_tokens, n_loss): (item, start, length, sequence, offset)."""
    packer = Packer(limits)
    out = [x for k, (n, loss) in enumerate(sizes) for x in packer.add(k, n, loss)]
    return out + list(packer.drain())


#: For plain documents: at least a quarter of each is prompt, so what bears loss is at most 768 of 1024 tokens on average and the limit of 960 is
#: kept by mixing, without padding; a piece has at least one token, so that the limit of segments never forces padding either.
DOCUMENT_LIMITS = Limits(1024, 1024, 960)
DOCUMENT_PROMPT = 0.25


def loss_tokens(n_tokens: int, prompt_share: float) -> int:
    """Of a document's tokens those that bear loss: all after its prompt, which is rounded up."""
    return n_tokens - math.ceil(n_tokens * prompt_share)


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack(path: str, end_id: int, limits: Limits, prompt_share: float, with_ids: bool) -> callable:
    names = [x.split()[0] for x in SCHEMA.split(", ")] + ["ids"] * with_ids

    def batch_of(found: list[tuple], docs: dict, base: int) -> pa.RecordBatch:
        rows = []
        for key, start, length, sequence, offset in found:
            doc_id, ids = docs[key]
            piece = ids[start : start + length].astype("<u4")
            rows.append((doc_id, start, length, zlib.crc32(piece.tobytes()), len(ids), base + sequence, offset, piece))
        columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(7)]
        if with_ids:
            columns.append(pa.array([r[7] for r in rows], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, packer = tokens.encoder(path), Packer(limits)
        base = TaskContext.get().partitionId() << 36
        docs: dict[int, tuple] = {}
        number, found = 0, []
        end = np.array([end_id], np.uint32)
        for batch in batches:
            for i, encoded in tokens.encoded(batch.column(1), coder):
                for k, ids in enumerate(encoded):
                    docs[number] = (batch.column(0)[i + k].as_py(), np.concatenate([ids, end]))
                    found += packer.add(number, len(ids) + 1, loss_tokens(len(ids) + 1, prompt_share))
                    number += 1
                if len(found) >= 4096:
                    yield batch_of(found, docs, base)
                    found, waiting = [], set(packer.key)
                    docs = {k: v for k, v in docs.items() if k in waiting}
        found += packer.drain()
        yield batch_of(found, docs, base)

    return run


def pack(docs: DataFrame, path: str, end_id: int = 0, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", prompt_share: float = 0.0, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if asked for).

    A document's ids are its text's and end_id after them; all but the first prompt_share of them bear loss. Null and empty texts are
    the end id alone; a null id stays null. Equal rows are packed one by one. An empty table gives no
    rows. Other columns are not read, whatever their names. sequence_id holds the partition in its
    upper bits; a recomputed partition reads the same rows in the same order and gives the same result.
    """
    prepared(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(trimmed(_pack(path, end_id, limits, prompt_share, with_ids)), SCHEMA + (", ids array<int>" if with_ids else ""))
