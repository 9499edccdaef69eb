"""Exact metric range join on cosine: pivots, triangle inequality, independent cells.

Equal (label, vector) rows collapse to one class with a count; a class is named by its smallest id and a
hash of its vector, so an id that comes with several vectors is several classes. On unit vectors cos >= c
is the same as a Euclidean distance of at most r = sqrt(2 - 2c). Large labels get pivots; every vector
has its nearest pivot's cell i as its home. If x and y are within r and y's home is cell j, then

    d(x, p_j) <= d(x, p_i) + 2 r      and      d(x, p_j) <= radius_j + r      (triangle inequality)
    d(x, p_j)^2 - d(x, p_i)^2 <= 2 r d(p_i, p_j)                              (the plane between p_i and p_j)

so x visits, as a guest, the cells j < i where all three hold: a pair of different homes meets once, in the
lower cell, and a pair of one home meets there. Every vector is sent once to its home and once to each
cell that it visits; cells too large for a task are cut into blocks. A block keeps one chunk of its
home vectors, streams the others past it in pieces, counts links on both sides and gives a star for each
part that new links join; no pair is emitted. Pivots are a bounded hash sample and the vectors of a cell are
counted before they move; both steer the work and don't change the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_counted, trimmed
from .components import components

#: A label with more vectors than this gets pivots, about one for so many vectors.
CELL = 4096
#: Pivots of all labels together, at most about this many.
MOST_PIVOTS = 4096
#: Bytes of the vectors that a block holds as doubles, and their most rows.
BLOCK_BYTES = 8 << 20
BLOCK = 4096
#: Vectors that stream past one block.
STREAM = 1 << 16
#: Vectors compared with a block at once.
PIECE = 1024
_SLACK = 1e-9


def _matrix(column: pa.Array, rows: np.ndarray, dim: int) -> np.ndarray:
    flat = column.values.to_numpy(zero_copy_only=False)
    at = column.offsets.to_numpy()[rows]
    return flat[at[:, None] + np.arange(dim)].astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ pivots.T)))


def _by_part(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
    """((label, dimensions), rows) of a batch whose columns 0 and 1 are label and dim."""
    both = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)
    parts, inverse = np.unique(both, axis=0, return_inverse=True)
    for k, part in enumerate(parts.tolist()):
        yield tuple(part), np.flatnonzero(inverse.ravel() == k)


class _Cells:
    """The pivots of every (label, dim) and what is known of their cells; without pivots there is one cell."""

    def __init__(self, pivots: dict, r: float):
        self.pivots, self.r = pivots, r
        self.radius: dict[tuple, np.ndarray] = {}
        self.homes: dict[tuple, np.ndarray] = {}
        self.guests: dict[tuple, np.ndarray] = {}
        self.apart = {k: _distances(p, p) for k, p in pivots.items()}
        self.block, self.stream = BLOCK, STREAM  # the driver's values go to the workers

    def chunk(self, dim: int) -> int:
        """Home vectors of a block."""
        return max(1, min(self.block, BLOCK_BYTES // (8 * dim)))

    def places(self, part: tuple, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(home cell, distance from its pivot, row, visited cell) for unit vectors x."""
        none = np.zeros(0, np.int64)
        if (p := self.pivots.get(part)) is None:
            return np.zeros(len(x), np.int64), np.zeros(len(x)), none, none
        d = _distances(x, p)
        home = d.argmin(axis=1)
        near = d[np.arange(len(x)), home]
        if part not in self.radius:
            return home, near, none, none
        ok = (d <= near[:, None] + 2 * self.r + _SLACK) & (d <= self.radius[part] + self.r + _SLACK)
        ok &= d**2 - near[:, None] ** 2 <= 2 * self.r * self.apart[part][home] + _SLACK
        ok &= np.arange(len(p)) < home[:, None]
        return home, near, *np.nonzero(ok)


def _profile(cells: _Cells) -> callable:
    """Of each cell the number of home vectors, of guests (once radii are known), and its radius."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for part, rows in _by_part(batch):
                home, near, _, to = cells.places(part, _unit(_matrix(batch.column(2), rows, part[1])))
                far = np.zeros(max(home.max(), to.max() if len(to) else 0) + 1)
                np.maximum.at(far, home, near)
                own, guests = np.bincount(home, minlength=len(far)), np.bincount(to, minlength=len(far))
                out += [(*part, k, int(own[k]), int(guests[k]), float(far[k])) for k in np.flatnonzero(own + guests).tolist()]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64()]
            names = ["label", "dim", "cell", "own", "guests", "far"]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kinds[k]) for k in range(6)], names)

    return run


def _sent(cells: _Cells) -> callable:
    """Rows of blocks: (label, dim, cell, hc, sc, side, id, h, copies, v).

    side 0: a chunk hc of home vectors, in every block (hc, sc) of that chunk; side 1: guests, and home vectors of
    later chunks, each in one sc for every chunk that it must meet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = (batch.column("h").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
            at, cell, hc, sc, side = [], [], [], [], []

            def put(rows, c, h, s, which):
                for out, x in zip((at, cell, hc, sc, side), (rows, c, h, s, np.full(len(rows), which)), strict=True):
                    out.append(x)

            for part, rows in _by_part(batch):
                home, _, guest, to = cells.places(part, _unit(_matrix(batch.column(2), rows, part[1])))
                size = cells.chunk(part[1])
                chunks = -(-cells.homes[part] // size)  # of each cell's home vectors
                streams = -(-(cells.guests[part] + np.maximum(cells.homes[part] - size, 0)) // cells.stream)
                streams = np.maximum(streams, 1)
                own = (key[rows] % np.maximum(chunks[home], 1).astype(np.uint64)).astype(np.int64)
                turn = (key[rows] >> np.uint64(16)).astype(np.int64)
                for s in range(int(streams[home].max())):  # a home vector goes to all streams of its chunk
                    there = np.flatnonzero(streams[home] > s)
                    put(rows[there], home[there], own[there], np.full(len(there), s), 0)
                for h in range(int(chunks[home].max()) - 1):  # and past the chunks before its own
                    there = np.flatnonzero(own > h)
                    put(rows[there], home[there], np.full(len(there), h), turn[there] % streams[home[there]], 1)
                if len(to):
                    for h in range(int(chunks[to].max())):
                        there = np.flatnonzero(chunks[to] > h)
                        g, t = guest[there], to[there]
                        put(rows[g], t, np.full(len(t), h), turn[g] % streams[t], 1)
            at, cell, hc, sc, side = (np.concatenate(x) for x in (at, cell, hc, sc, side))
            names = ["label", "dim", "cell", "hc", "sc", "side", "id", "h", "copies", "v"]
            for k in range(0, len(at), 10_000):
                part = batch.take(pa.array(at[k : k + 10_000]))
                new = [pa.array(x[k : k + 10_000].astype(np.int32)) for x in (cell, hc, sc, side)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *new, *(part.column(x) for x in ("id", "h", "copies", "v"))], names)

    return run


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its part) for the nodes of the links (a, b) that aren't least."""
    nodes, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = where[: len(a)], where[len(a) :]
    low = np.arange(len(nodes))
    while True:
        before = low.copy()
        m = np.minimum(low[i], low[j])
        np.minimum.at(low, i, m)
        np.minimum.at(low, j, m)
        low = low[low]
        if np.array_equal(low, before):
            break
    keep = low != np.arange(len(nodes))
    return nodes[keep], nodes[low[keep]]


class _Block:
    """A chunk of home vectors, with their links so far, past which other vectors stream."""

    def __init__(self, threshold: float, piece: int, first: bool):
        self.threshold, self.piece, self.first = threshold, piece, first
        self.held: list[tuple] = []  # (ids, hashes, copies, vectors)
        self.x = None

    def add(self, side: int, ids, hashes, copies, vectors) -> list[tuple]:
        if side == 0:
            self.held.append((ids, hashes, copies, vectors))
            return []
        out = self.open()
        for k in range(0, len(ids), self.piece):
            part = slice(k, k + self.piece)
            out += self.meet(ids[part], hashes[part], copies[part], _unit(vectors[part]))
        return out

    def open(self) -> list[tuple]:
        """Ends the home side; its own links count in the chunk's first stream only."""
        if self.x is not None or not self.held:
            return []
        self.ids, self.hashes, self.copies = (np.concatenate([h[k] for h in self.held]) for k in range(3))
        self.x = _unit(np.concatenate([h[3] for h in self.held]))
        self.held, n = [], len(self.ids)
        self.part, self.links = np.arange(n), np.zeros(n, np.int64)
        out = []
        for k in range(0, n if self.first else 0, self.piece):
            linked = self.x @ self.x[k : k + self.piece].T >= self.threshold
            width = np.arange(linked.shape[1])
            linked[k + width, width] = False
            self.links[k : k + self.piece] += linked.T @ self.copies
            i, j = np.nonzero(linked)
            out += self._joined(i, k + j)
        return out

    def _joined(self, i: np.ndarray, j: np.ndarray) -> list[tuple]:
        """Star rows of parts that the links (i, j) join; j from the number of home vectors on are others, see meet."""
        if not len(i):
            return []
        n = len(self.ids)
        b = np.where(j < n, self.part[np.minimum(j, n - 1)], j)
        a = self.part[i]
        pairs = np.unique(np.stack([a, b], 1)[a != b], axis=0)
        if not len(pairs):
            return []
        node, low = stars(pairs[:, 0], pairs[:, 1])
        to = np.arange(n)
        own = node < n
        to[node[own]] = low[own]
        self.part = to[self.part]
        return list(zip(node.tolist(), low.tolist(), strict=True))

    def meet(self, ids, hashes, copies, y) -> list[tuple]:
        if self.x is None:
            return []
        linked = self.x @ y.T >= self.threshold
        i, j = np.nonzero(linked)
        if not len(i):
            return []
        self.links += linked @ copies
        theirs = linked.T @ self.copies
        n = len(self.ids)
        name = lambda k: (int(self.ids[k]), int(self.hashes[k])) if k < n else (int(ids[k - n]), int(hashes[k - n]))
        out = [(*name(a), 0, *name(b)) for a, b in self._joined(i, n + j)]
        return out + [(int(ids[k]), int(hashes[k]), int(theirs[k]), None, None) for k in np.flatnonzero(theirs).tolist()]

    def named(self, found: list[tuple]) -> list[tuple]:
        return [x if len(x) == 5 else (int(self.ids[x[0]]), int(self.hashes[x[0]]), 0, int(self.ids[x[1]]), int(self.hashes[x[1]])) for x in found]

    def close(self) -> list[tuple]:
        out = self.open()
        if self.x is None:
            return []
        out = self.named(out)
        return out + [(int(self.ids[k]), int(self.hashes[k]), int(self.links[k]), None, None) for k in np.flatnonzero(self.links).tolist()]


MET = "id long, h long, n long, low long, low_h long"


def _compare(threshold: float, piece: int) -> callable:
    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(5)], [x.split()[0] for x in MET.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by block and side."""
        now, block = None, None
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(6)], 1)
            turn = np.concatenate([[0], np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1, [len(keys)]])
            found = []
            for a, b in zip(turn[:-1].tolist(), turn[1:].tolist(), strict=True):
                if a == b:
                    continue
                *key, side = keys[a].tolist()
                if key != now:
                    if block:
                        found += block.close()
                    now, block = key, _Block(threshold, piece, key[4] == 0)
                part = batch.slice(a, b - a)
                vectors = _matrix(part.column(9), np.arange(b - a), key[1])
                got = block.add(side, *(part.column(k).to_numpy() for k in (6, 7, 8)), vectors)
                found += block.named(got)
            if found:
                yield batch_of(found)
        yield batch_of(block.close() if block else [])

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null
    label or id, link with nothing (0 links, their own component; null for a null id). Vectors of
    different length never link. Equal vectors link with each other. Repeated rows count as vectors of
    their own, and rows of one id with different vectors each have their own links. An empty table gives no
    rows; other columns are not read. threshold must be above -1.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "metric")
    r = float(np.sqrt(max(0.0, 2.0 - 2.0 * threshold)))
    kind = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast(kind).alias("v"))
    bad = F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & ~bad & F.exists("v", lambda e: e != 0)
    good = F.coalesce(good, F.lit(False))
    names = lambda: [F.xxhash64(F.lit(k), "label", "v").alias(f"k{k}") for k in (1, 2)]
    classes = rows.where(good).groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    classes = scratch.save(classes.select("label", F.size("v").alias("dim"), "v", "id", F.xxhash64(F.lit(1), "label", "v").alias("h"), "copies", *names()), "classes")
    sizes = classes.groupBy("label", "dim").count().where(F.col("count") > CELL)
    total = sizes.agg(F.sum("count")).first()[0] or 0
    pivots: dict = {}
    if total:
        rate = min(1.0 / CELL, MOST_PIVOTS / total)
        # A cell for each started CELL vectors: a label just beyond CELL gets at least a few candidates.
        share = F.pmod(F.xxhash64("id", "h", F.lit("pivot")), F.lit(1 << 40)) < int(min(1.0, 2 * rate) * (1 << 40))
        found = classes.where(share).join(F.broadcast(sizes), ["label", "dim"], "left_semi").select("label", "dim", "id", "h", "v")
        for row in sorted(found.limit(4 * MOST_PIVOTS).collect(), key=lambda x: (x.id, x.h)):
            pivots.setdefault((row.label, row.dim), []).append(row.v)
        pivots = {k: _unit(np.array(v, np.float64)) for k, v in pivots.items()}
    cells = _Cells(pivots, r)
    plain = classes.select("label", "dim", "v", "id", "h", "copies")
    for last in (False, True) if pivots else (True,):
        profile = plain.mapInArrow(trimmed(_profile(cells)), "label long, dim int, cell int, own long, guests long, far double")
        profile = profile.groupBy("label", "dim", "cell").agg(F.sum("own").alias("own"), F.sum("guests").alias("guests"), F.max("far").alias("far"))
        found = profile.collect()  # a row for each cell
        for part in {(x.label, x.dim) for x in found}:
            n = len(pivots[part]) if part in pivots else 1
            own, guests, far = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -9.0)
            for x in found:
                if (x.label, x.dim) == part:
                    own[x.cell], guests[x.cell], far[x.cell] = x.own, x.guests, x.far if x.own else -9.0
            if last:
                cells.homes[part], cells.guests[part] = own, guests
            else:
                cells.radius[part] = far
    block = ["label", "dim", "cell", "hc", "sc"]
    kinds = "label long, dim int, cell int, hc int, sc int, side int, id long, h long, copies long"
    blocks = plain.mapInArrow(trimmed(_sent(cells)), f"{kinds}, v {kind}").repartition(*block).sortWithinPartitions(*block, "side")
    met = scratch.save(blocks.mapInArrow(trimmed(_compare(threshold, PIECE)), MET), "met")
    counts = met.where("low is null").groupBy("id", "h").agg(F.sum("n").alias("n"))
    links = met.where("low is not null").select(F.struct("id", "h").alias("a"), F.struct(F.col("low").alias("id"), F.col("low_h").alias("h")).alias("b"))
    parts = components(links, scratch).select("node.*", F.col("component.id").alias("root"))
    known = classes.select("id", "h", "k1", "k2", "copies").join(counts, ["id", "h"], "left").join(parts, ["id", "h"], "left")
    known = known.select("k1", "k2", "copies", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("root", "id").alias("root"))
    known = scratch.save(known, "known")
    # Equal vectors are told by 128 bits here, so that no vector moves again.
    out = join_counted(rows.where(good).select("vec_id", *names()), known, ["k1", "k2"], "copies").select("vec_id", "n_links", "root")
    out = out.unionByName(rows.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("root")))
    scratch.drop("classes", "met", "edges")
    return out.select(
        "vec_id",
        F.col("n_links").cast("long").alias("n_links"),
        F.col("root").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.col("root"), F.lit(False)).alias("kept"),
    )
