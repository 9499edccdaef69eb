"""MinHash near-duplicates: universal hash minima, banding, signature verification, star components.

1. Each text becomes its set of distinct word shingles (64-bit hashes), PERMUTATIONS universal hash
   minima and BANDS band keys. Equal sets collapse to one class, whose identity is its smallest id with the
   set's hash, so an id that comes with several texts is several classes.
2. Band buckets with at least two classes are found by partial aggregates. Buckets with the same
   members in several bands count once.
3. First round: every class takes part in its largest bucket only. The bucket's members are cut into
   chunks; each chunk is compared with itself and with the first chunk, so a group of m near copies costs
   m times a chunk, not m times m. Signatures must agree in at least ESTIMATE_FLOOR of the minima (over five
   standard deviations below 0.75); pairs that are not yet connected inside the block are confirmed on their
   full sets. Only links that join two parts of a block leave it.
4. Second round, over all buckets: those whose members are in one component by now are done. In the others,
   members outside the bucket's greatest component are compared with all of its members of other components,
   chunk against chunk: a pair in the first band that it shares, or once for all buckets of the same
   greatest component. Every pair that shares a band has then been compared or lies in one component, so
   no link between different components is lost.
5. The components of both rounds' links, by large-star and small-star, are given back to all documents.

A pair at exactly 0.75 shares no band of 4 minima out of 32 with probability (1 - 0.75**4)**32 =
5e-6; above it the chance falls fast. No bucket is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import grams
from .common import Scratch, join_counted, rows_matching, small, trimmed
from .components import components

WIDTH = 5
PERMUTATIONS = 128
BANDS = 32
ESTIMATE_FLOOR = 0.55
#: Documents of a chunk in the first and in the second round, and bytes of their full sets, at most about (a single larger document is a chunk of its own).
CHUNK = 128
WIDE = 256
CHUNK_BYTES = 16 << 20
#: How many more pairs one comparison for a component may have than those of its buckets one by one.
MERGE = 4

_A = grams.stream(3, PERMUTATIONS) | np.uint64(1)
_B = grams.stream(4, PERMUTATIONS)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """PERMUTATIONS minima of a*x+b modulo 2**64 for each set, which isn't empty."""
    out = np.empty((len(sets), PERMUTATIONS), np.uint64)
    i = 0
    while i < len(sets):
        j, n = i, 0
        while j < len(sets) and (j == i or n + len(sets[j]) <= 8192):
            n += len(sets[j])
            j += 1
        x = np.concatenate(sets[i:j])
        at = np.cumsum([0, *(len(s) for s in sets[i : j - 1])])
        buffer = np.empty_like(x)
        for p in range(PERMUTATIONS):
            np.multiply(x, _A[p], out=buffer)
            np.add(buffer, _B[p], out=buffer)
            out[i:j, p] = np.minimum.reduceat(buffer, at)
        i = j
    return out


def band_keys(minimum: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band; the band's number is part of it."""
    per = PERMUTATIONS // BANDS
    keys = np.zeros((len(minimum), BANDS), np.uint64)
    for k in range(per):
        keys = grams.mix(keys * np.uint64(31) + minimum[:, k::per][:, :BANDS])
    return grams.mix(keys + grams.stream(6, BANDS)[None, :])


def _sets(column: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    for i, data, offsets in grams.slices(column):
        yield i, grams.shingles(*grams.words(data, offsets, lower=True), WIDTH)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, sets in _sets(batch.column(1)):
            full = [k for k, s in enumerate(sets) if len(s)]
            keys = band_keys(minima([sets[k] for k in full])) if full else np.zeros((0, BANDS), np.uint64)
            one, two = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
            for k in full:
                one[k] = grams.mix(sets[k]).sum(dtype=np.uint64)
                two[k] = grams.mix(sets[k] ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
            at = np.zeros(len(sets) + 1, np.int32)
            at[np.array(full, np.int64) + 1] = BANDS
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(i, len(sets)),
                    batch.column(2).slice(i, len(sets)),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(one.view(np.int64)),
                    pa.array(two.view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.cumsum(at, dtype=np.int32)), pa.array(keys.ravel().view(np.int64))),
                ],
                ["doc_id", "text_hash", "n_shingles", "set1", "set2", "bands"],
            )


SETS = "doc_id long, set1 long, bands binary, signature binary, full_set binary"


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every text that has words: its band keys, the low bytes of its minima and its whole set."""
    for batch in batches:
        for i, sets in _sets(batch.column(1)):
            full = [k for k, s in enumerate(sets) if len(s)]
            if not full:
                continue
            sets = [sets[k] for k in full]
            low = minima(sets)
            one = [int(grams.mix(s).sum(dtype=np.uint64).view(np.int64)) for s in sets]
            columns = [
                batch.column(0).take(pa.array([i + k for k in full])),
                pa.array(one, pa.int64()),
                pa.array([x.tobytes() for x in band_keys(low)], pa.binary()),
                pa.array([x.tobytes() for x in low.astype(np.uint8)], pa.binary()),
                pa.array([s.tobytes() for s in sets], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SETS.split(", ")])


class _Parts:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x


class _Block:
    """Rows of one block: (node, component, bands, signature, full set) on either side."""

    def __init__(self):
        self.sides: tuple[list, list] = ([], [])

    def links(self, first: bool, band: int) -> list[tuple[tuple, tuple]]:
        """Links that join two parts.

        First round: pairs of side 0 with side 1 and inside side 1. Second round: pairs of different
        components that share no earlier band, of side 0 with side 1, or inside side 1 if side 0 is empty;
        a pair with both ends on both sides is taken once.
        """
        members = [*self.sides[0], *self.sides[1]]
        split, n = len(self.sides[0]), len(members)
        if not n or split == n:
            return []
        sets = [np.frombuffer(m[4], np.uint64) for m in members]
        sizes = np.array([len(s) for s in sets])
        low = np.frombuffer(b"".join(m[3] for m in members), np.uint8).reshape(n, -1)
        keys = np.frombuffer(b"".join(m[2] for m in members), np.uint64).reshape(n, -1)[:, : 0 if first else band]
        seen: dict[tuple, int] = {}
        group = np.array([seen.setdefault(m[1], len(seen)) for m in members])
        nodes = {m[0] for m in self.sides[0]} if not first else set()
        both = np.array([m[0] in nodes for m in members[split:]], bool)  # second round: of side 1, also on side 0
        parts, links = _Parts(len(seen)), []
        rows, cols, scores = [], [], []
        for i in range(n if first or not split else split):
            rest = slice(max(split, i + 1), n)
            fit = (4 * np.minimum(sizes[rest], sizes[i]) >= 3 * np.maximum(sizes[rest], sizes[i])) & (group[rest] != group[i])
            if not first:
                fit &= ~(keys[rest] == keys[i]).any(axis=1)
                if both.any():
                    fit &= ~both | np.array([members[i][0] < m[0] for m in members[split:]], bool)
            to = np.flatnonzero(fit) + rest.start
            if len(to):
                same = (low[to] == low[i]).mean(axis=1)
                ok = same >= ESTIMATE_FLOOR
                rows += [i] * int(ok.sum())
                cols += to[ok].tolist()
                scores += same[ok].tolist()
        for k in np.argsort(-np.array(scores), kind="stable").tolist():
            i, j = rows[k], cols[k]
            x, y = parts.find(group[i]), parts.find(group[j])
            if x == y:
                continue
            common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                parts.up[y] = x
                links.append((members[i][0], members[j][0]))
        return links


BLOCK = ["band", "key", "one", "two"]
LINKS = "a struct<id: long, h: long>, b struct<id: long, h: long>"


def _links(first: bool) -> callable:
    def out(block: _Block, key: tuple) -> pa.RecordBatch:
        found = block.links(first, key[0])
        node = pa.struct([("id", pa.int64()), ("h", pa.int64())])
        return pa.RecordBatch.from_arrays([pa.array([{"id": x[k][0], "h": x[k][1]} for x in found], node) for k in (0, 1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by block, which holds at most two chunks."""
        now, block = None, _Block()
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(9)]
            for k, key in enumerate(zip(*columns[:4], strict=True)):
                if key != now:
                    if now:
                        yield out(block, now)
                    now, block = key, _Block()
                node, component = (columns[5][k], columns[6][k]), (columns[7][k], columns[8][k])
                block.sides[columns[4][k]].append((node, component, *(batch.column(x)[k].as_py() for x in (9, 10, 11))))
        if now:
            yield out(block, now)

    return run


def _chunks(n, size, most: int):
    """Number of chunks of `most` members for n members whose sets hold `size` shingles together."""
    return F.greatest(F.ceil(n / most), F.ceil(size * 8 / CHUNK_BYTES)).cast("int")


def _compared(docs: DataFrame, blocks: DataFrame, first: bool, repeated: bool, scratch: Scratch, name: str) -> DataFrame:
    """Links of blocks: rows (block, side, id, h, cid, ch), each member as often as blocks need it."""
    blocks = scratch.save(blocks.select(*BLOCK, "side", "id", "h", "cid", "ch"), f"{name}-blocks")
    wanted = small(blocks.select(F.col("id").alias("doc_id")).distinct())
    sets = docs.join(wanted, "doc_id", "left_semi").mapInArrow(trimmed(_full_sets), SETS)
    if repeated:
        sets = sets.dropDuplicates(["doc_id", "set1"])
    sets = sets.withColumnsRenamed({"doc_id": "id", "set1": "h"})
    rows = sets.join(small(blocks, 200_000), ["id", "h"]).select(*BLOCK, "side", "id", "h", "cid", "ch", "bands", "signature", "full_set")
    rows = rows.repartition(*BLOCK).sortWithinPartitions(*BLOCK)
    links = scratch.save(rows.mapInArrow(trimmed(_links(first)), LINKS), name)
    scratch.drop(f"{name}-blocks")
    return links


def _numbers(n):
    return F.explode(F.sequence(F.lit(0), n - 1))


FEATURES = "doc_id long, text_hash long, n_shingles long, set1 long, set2 long, bands array<long>"
#: Two sets are equal if these are.
SAME = ["n_shingles", "set1", "set2"]


def _crossed(rows: DataFrame, group: list, strange: Column, odds: Column, alls: Column) -> DataFrame:
    """Blocks of the strange members of a group against all of its rows; a group of one chunk is one block, in which each stands once."""
    chunk = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "id", "h"), n).cast("int")
    nodes = ["id", "h", "cid", "ch"]
    rows = rows.withColumns({"odds": odds, "alls": alls})
    one = rows.where(strange & (F.col("alls") > 1)).select(*group, chunk("odds", 2).alias("one"), _numbers(F.col("alls")).alias("two"), *nodes, F.lit(0).alias("side"))
    every = rows.select(*group, _numbers(F.col("odds")).alias("one"), chunk("alls", 3).alias("two"), *nodes, F.lit(1).alias("side"))
    return one.unionByName(every)


def _second_round(docs: DataFrame, rows: DataFrame, repeated: bool, scratch: Scratch) -> DataFrame:
    """Links between different components of one bucket. rows: band, key, id, h, n_shingles, and the component cid, ch.

    The odd members of a bucket are those outside its greatest component. Where many buckets have the same
    greatest component, its members and all of their odd ones are compared once, unless that is over
    MERGE times as many pairs as the buckets have one by one; then their odd ones are compared in each bucket.
    """
    kinds = rows.groupBy("band", "key", "cid", "ch").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("size"))
    top = kinds.groupBy("band", "key").agg(
        F.max(F.struct("n", "size", "cid", "ch")).alias("top"), F.count("*").alias("kinds"), F.sum("n").alias("n"), F.sum("size").alias("size")
    )
    top = top.where("kinds > 1").select(
        "band", "key", "n", "size", F.col("top.cid").alias("tid"), F.col("top.ch").alias("th"),
        (F.col("n") - F.col("top.n")).alias("odd_n"), (F.col("size") - F.col("top.size")).alias("odd_size"),
    )
    top = scratch.save(top, "top")
    rows = rows.join(small(top), ["band", "key"]).withColumn("odd", (F.col("cid") != F.col("tid")) | (F.col("ch") != F.col("th")))
    rows = scratch.save(rows, "open")
    group = ["tid", "th"]
    once = rows.groupBy(*group, "odd", "id", "h", "n_shingles", "cid", "ch").count().drop("count")
    costs = once.groupBy(*group).agg(
        F.count("*").alias("g_n"), F.sum("n_shingles").alias("g_size"), F.count_if("odd").alias("g_odd_n"), F.sum(F.when(F.col("odd"), F.col("n_shingles"))).alias("g_odd_size")
    )
    costs = costs.join(top.groupBy(*group).agg(F.sum(F.col("odd_n") * F.col("n")).alias("pairs")), group)
    merged = F.col("g_odd_n") * (F.col("g_n") - F.col("g_odd_n")) <= F.col("pairs") * MERGE
    costs = scratch.save(costs.withColumn("merged", merged), "costs")
    whole = once.join(small(costs.where("merged")), group).withColumns({"band": F.lit(0), "key": F.xxhash64(*group)})
    bucket = ["band", "key"]
    blocks = _crossed(whole, bucket, F.col("odd"), _chunks(F.col("g_odd_n"), F.col("g_odd_size"), WIDE), _chunks(F.col("g_n"), F.col("g_size"), WIDE))
    rows = rows.join(small(costs.select(*group, "merged")), group)
    part = lambda all_, odd: F.when(F.col("merged"), F.col(odd)).otherwise(F.col(all_))
    own = rows.where("not merged or odd and odd_n > 1")
    own = _crossed(own, bucket, F.col("odd"), _chunks(F.col("odd_n"), F.col("odd_size"), WIDE), _chunks(part("n", "odd_n"), part("size", "odd_size"), WIDE))
    links = _compared(docs, blocks.unionByName(own), False, repeated, scratch, "more-links")
    scratch.drop("top", "open", "costs")
    return links


def _grouped(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, bool]:
    """(features of every row, classes with the root they belong to and whether they are it, whether rows repeat)."""
    features = scratch.save(
        docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(trimmed(_features), FEATURES), "features"
    )
    classes = features.where("n_shingles > 0").groupBy("doc_id", *SAME).agg(F.count("*").alias("n"))
    classes = classes.groupBy(*SAME).agg(F.min("doc_id").alias("rep"), F.sum("n").alias("copies"), F.max("n").alias("most"))
    classes = scratch.save(classes, "classes")
    repeated = (classes.agg(F.max("most")).first()[0] or 0) > 1
    reps = classes.where("rep is not null").select(F.col("rep").alias("doc_id"), *SAME)
    reps = features.join(reps, ["doc_id", *SAME])
    if repeated:  # repeated rows would cancel in the buckets' xors
        reps = reps.dropDuplicates(["doc_id", *SAME])
    bands = reps.select(F.col("doc_id").alias("id"), F.col("set1").alias("h"), "n_shingles", F.posexplode("bands").alias("band", "key"))
    buckets = bands.groupBy("band", "key").agg(
        F.count("*").alias("n"),
        F.min("id").alias("least"),
        F.bit_xor(F.xxhash64("id", "h")).alias("x1"),
        F.bit_xor(F.xxhash64(F.lit(1), "id", "h")).alias("x2"),
    )
    buckets = buckets.where("n > 1").groupBy("n", "least", "x1", "x2").agg(F.min(F.struct("band", "key")).alias("b"))
    buckets = scratch.save(buckets.select("b.*", "n"), "buckets")
    members = scratch.save(bands.join(small(buckets), ["band", "key"]), "members")
    scratch.drop("buckets")
    # First round.
    own = members.groupBy("id", "h", "n_shingles").agg(F.max(F.struct("n", "band", "key")).alias("b"))
    own = scratch.save(own.select("id", "h", "n_shingles", "b.band", "b.key"), "own")
    sizes = own.groupBy("band", "key").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("size")).where("n > 1")
    rows = own.join(small(sizes.select("band", "key", _chunks(F.col("n"), F.col("size"), CHUNK).alias("chunks"))), ["band", "key"])
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("id", "h"), "chunks").cast("int"))
    nodes = ["id", "h", F.col("id").alias("cid"), F.col("h").alias("ch")]
    side = F.lit(1).alias("side")
    zero = rows.where("chunk = 0").select("band", "key", F.lit(0).alias("one"), _numbers(F.col("chunks")).alias("two"), *nodes)
    zero = zero.withColumn("side", F.when(F.col("two") == 0, 1).otherwise(0))
    blocks = zero.unionByName(rows.where("chunk > 0").select("band", "key", F.lit(0).alias("one"), F.col("chunk").alias("two"), *nodes, side))
    links = _compared(docs, blocks, True, repeated, scratch, "links")
    joined = scratch.save(components(links, scratch), "joined")
    # Second round.
    found = joined.select("node.id", "node.h", F.col("component.id").alias("cid"), F.col("component.h").alias("ch"))
    rows = members.join(small(found), ["id", "h"], "left")
    rows = rows.select("band", "key", "id", "h", "n_shingles", F.coalesce("cid", "id").alias("cid"), F.coalesce("ch", "h").alias("ch"))
    more = _second_round(docs, rows, repeated, scratch)
    if not more.isEmpty():
        edges = joined.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)
        joined = components(edges, scratch)
    found = joined.select(F.col("node.id").alias("rep"), F.col("node.h").alias("set1"), F.col("component.id").alias("root"))
    roots = classes.join(found, ["rep", "set1"], "left")
    roots = roots.select(*SAME, "rep", "copies", F.coalesce("root", "rep").alias("root"), F.col("root").isNull().alias("first"))
    roots = scratch.save(roots, "roots")
    scratch.drop("members", "own", "links", "joined", "more-links", "classes", "edges")
    return features, roots, repeated


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Null and word-less texts have an empty set, n_shingles 0, and link with nothing. A null id keeps
    its row, with a null component and kept = false. Repeated rows come out as often as they went in; rows of
    one id with different texts link and get components each by its own text. An empty table gives no
    rows; other columns are not read, whatever their names. kept is doc_id = component_id, so ties go to
    the smallest id.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    features, roots, _ = _grouped(_prepared(docs, id_col, text_col), scratch)
    rows = features.select("doc_id", *SAME)
    out = join_counted(rows.where("n_shingles > 0"), roots, SAME, "copies", "left").select("doc_id", "n_shingles", "root")
    out = out.unionByName(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("root")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return out.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"),
    )


def _prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with their columns, but of each group only one: the smallest id, and of its texts one.

    Rows without words and rows with a null id all stay. Of equal rows one stays. Columns may have any names.
    """
    features, roots, repeated = _grouped(_prepared(docs, id_col, text_col), Scratch(docs.sparkSession, "minhash"))
    rows = features.where("n_shingles > 0 and doc_id is not null").select("doc_id", "text_hash", *SAME)
    rows = join_counted(rows, roots.select(*SAME, "rep", "copies", "first"), SAME, "copies")
    kept = rows.where("first and doc_id = rep").groupBy("doc_id", *SAME).agg(F.min("text_hash").alias("text_hash"))
    kept = Scratch(docs.sparkSession, "kept").save(kept.select("doc_id", "text_hash"), "rows")
    gone = rows.select("doc_id", "text_hash").join(small(kept), ["doc_id", "text_hash"], "left_anti")
    out = rows_matching(docs, gone, "left_anti", id_col, text_col)
    if not repeated:
        return out
    names = [f"c{k}" for k in range(len(docs.columns))]
    its_id, its_text = (names[docs.columns.index(c)] for c in (id_col, text_col))
    out = out.toDF(*names)
    one = (F.coalesce(F.col(its_text).cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")) & F.col(its_id).isNotNull()
    return out.where(one).dropDuplicates([its_id, its_text]).unionByName(out.where(~one)).toDF(*docs.columns)
