"""Mixes sources to target weights: fixed-length blocks, multinomial counts per shard, pseudorandom permutations.

Each source's documents, in a fixed pseudorandom order, are one sequence of words, cut into blocks of the same length.
The mix takes a source's blocks in passes; in each pass another keyed permutation of block numbers says which block
a slot takes. The output is shards of as many slots each. A shard's counts of slots by source are a multinomial
draw under the condition that all shards together have each source's planned number: the shards' tree is
split from its root, each split being a hypergeometric draw that is seeded by the node alone. A shard replays the
splits on its own path, which gives its counts and how many slots of each source lie before it; no shard waits for
another, and a recomputed one is the same. Slots then meet the documents' pieces by block number.

The last slot of a source is cut where its target is reached, so a source's words are its target, rounded.

Offsets of documents in their source are sums over about sqrt(n) pseudorandom groups of it, and sums within a group, so no task
sees more than about sqrt(n) rows of a source, however common.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import grams
from .common import Scratch, prepared, trimmed

#: Words of a block, and slots of an output shard.
BLOCK_WORDS = 128
SHARD_SLOTS = 4096
#: How often a source's words may be taken at most.
MOST_REPEATS = 3
#: Sources, at most: their plan is made on the driver and sent to all tasks.
MOST_SOURCES = 20_000
SEED = 20_240

_SPACE = " \t\n\r\x0b\f"


@dataclass(frozen=True)
class Source:
    name: str | None
    size: int
    target: Fraction
    block: int = BLOCK_WORDS

    @property
    def words(self) -> int:
        """Words to take."""
        return min(MOST_REPEATS * self.size, int(self.target + Fraction(1, 2)))

    @property
    def full(self) -> int:
        return self.size // self.block

    @property
    def blocks(self) -> int:
        return -(-self.size // self.block)

    @property
    def slots(self) -> int:
        passes, rest = divmod(self.words, self.size) if self.size else (0, 0)
        return passes * self.blocks + -(-rest // self.block)

    @property
    def last(self) -> int:
        """Words of the last slot if it is cut, else the block's length."""
        rest = self.words % self.size if self.size else 0
        return rest % self.block or self.block


def targets(sizes: list[int], weights: list[int], most: int = MOST_REPEATS) -> list[Fraction]:
    """Shares of the sum of sizes by weight; none above most times its size, the excess being shared again by weight."""
    left, weight = Fraction(sum(sizes)), sum(weights)
    out = [Fraction(0)] * len(sizes)
    # The source that is fullest for its weight is decided last: once one isn't full, none after it is.
    for k in sorted(range(len(sizes)), key=lambda k: Fraction(sizes[k], weights[k])):
        out[k] = min(Fraction(most * sizes[k]), left * weights[k] / weight)
        left -= out[k]
        weight -= weights[k]
    return out


def plan(sizes: dict[str | None, int], block: int = BLOCK_WORDS) -> list[Source]:
    """Sources by code point, null last, with weights 1, 2, 3, 1, ... and targets."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = targets([sizes[s] for s in names], [k % 3 + 1 for k in range(len(names))])
    return [Source(s, sizes[s], t, block) for s, t in zip(names, goal, strict=True)]


def _draw(random: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """Hypergeometric; beyond the library's bound its normal approximation within the possible range."""
    if max(good, bad) < 10**9:
        return int(random.hypergeometric(good, bad, sample)) if good and sample else 0
    share = good / (good + bad)
    spread = (sample * share * (1 - share) * (good + bad - sample) / (good + bad - 1)) ** 0.5
    return int(min(good, sample, max(0, sample - bad, round(random.normal(sample * share, spread)))))


def shard_counts(slots: list[int], shard: int, shards: int, seed: int = SEED) -> tuple[list[int], list[int]]:
    """Of each source the shard's number of slots, and how many of its slots lie in the shards before."""
    total = sum(slots)
    edge = lambda k: total * k // shards
    first, last, counts, before = 0, shards, list(slots), [0] * len(slots)
    while last - first > 1:
        middle = (first + last) // 2
        random = np.random.default_rng([seed, first, last])
        room, rest, left = edge(middle) - edge(first), sum(counts), []
        for n in counts:
            left.append(_draw(random, n, rest - n, room))
            room, rest = room - left[-1], rest - n
        if shard < middle:
            last, counts = middle, left
        else:
            first, before = middle, [a + b for a, b in zip(before, left, strict=True)]
            counts = [a - b for a, b in zip(counts, left, strict=True)]
    return counts, before


def permuted(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """index, of numbers below size, under a keyed permutation: a Feistel network, repeated until it lands below size."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    low, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = grams.stream(key, 4)
    at = index.astype(np.uint64)
    todo = np.arange(len(at))
    while len(todo):
        left, right = at[todo] >> shift, at[todo] & low
        for k in keys:
            left, right = right, left ^ (grams.mix(right + k) & low)
        at[todo] = left << shift | right
        todo = todo[at[todo] >= size]
    return at.astype(np.int64)


def shard_slots(sources: list[Source], shard: int, shards: int, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """(position, source number, block, length) of a shard's slots."""
    counts, before = shard_counts([s.slots for s in sources], shard, shards, seed)
    which, block, length = [], [], []
    for k, s in enumerate(sources):
        if not counts[k]:
            continue
        number = np.arange(before[k], before[k] + counts[k])
        turn, place = number // s.blocks, number % s.blocks
        found = np.full(len(number), s.full)  # the shorter last block ends each pass
        for t in np.unique(turn).tolist():
            inner = (turn == t) & (place < s.full)
            found[inner] = permuted(place[inner], s.full, seed + 1_000 * k + t) if s.full else 0
        size = np.minimum(s.block, s.size - found * s.block)
        which.append(np.full(len(number), k))
        block.append(found)
        length.append(np.where(number == s.slots - 1, np.minimum(size, s.last), size))
    none = np.zeros(0, np.int64)
    order = np.random.default_rng([seed, shard]).permutation(sum(counts))
    return order, *(np.concatenate(x) if x else none for x in (which, block, length))


def _slots(sources: list[Source], shards: int, seed: int) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                columns = [pa.array(c, pa.int64()) for c in shard_slots(sources, shard, shards, seed)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), shard)), *columns], ["shard", "slot", "src", "block", "length"])

    return run


def _word_starts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    begin = grams._IS_WORD[data]
    first = np.zeros(len(data) + 1, bool)
    first[at] = True
    begin[1:] &= ~begin[:-1] | first[1:-1]
    return begin


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 36
    for batch in batches:
        sizes = np.zeros(batch.num_rows, np.int64)
        for first, data, at in grams.slices(batch.column("text"), 1 << 20):
            total = np.concatenate([[0], np.cumsum(_word_starts(data, at))])
            sizes[first : first + len(at) - 1] = np.diff(total[at])
        numbers = pa.array(np.arange(row, row + batch.num_rows))
        row += batch.num_rows
        yield pa.RecordBatch.from_arrays([numbers, pa.array(sizes), *batch.columns], ["row", "size", *batch.schema.names])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to (row, starts, lengths, text) rows the texts of the pieces: words from each start on, with what lies between them."""
    for batch in batches:
        out = []
        for starts, lengths, text in zip(*(batch.column(k).to_pylist() for k in ("starts", "lengths")), batch.column("text"), strict=True):
            data = np.frombuffer(text.as_buffer() or b"", np.uint8)
            inside = np.concatenate([grams._IS_WORD[data], [False]])
            begin = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
            end = np.flatnonzero(inside & ~np.concatenate([inside[1:], [False]])) + 1
            data = data.tobytes()
            out.append([data[begin[a] : end[a + n - 1]].decode() for a, n in zip(starts, lengths, strict=True)])
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.list_(pa.string()))], ["row", "texts"])


@dataclass
class Mix:
    rows: DataFrame  # row (a number), doc_id, source, src (the source's number in sources), size
    sources: list[Source]
    pieces: DataFrame  # shard, slot, source, block, offset (in the slot), row, doc_id, start, n_words (and text, if asked for)


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", block: int = BLOCK_WORDS, seed: int = SEED, texts: bool = False) -> Mix:
    """The mix of all docs: its rows, its sources with targets, and the pieces of which its slots consist.

    A document's size is its number of words [^\\x20\\x09-\\x0D]+. A piece is n_words of a document from its word number `start`
    on, at word `offset` of a slot of a shard; slots are blocks of `block` words, but for a source's last block and last
    slot. Sources weigh 1, 2, 3, 1, ... by code point, null last, and share the words of all; none is taken more
    than MOST_REPEATS times.

    Null, empty and blank texts have size 0 and no pieces; null is a source like others, null ids stay null and repeated rows are
    documents of their own. Other columns are not read, whatever their names. An empty table gives empty tables.
    More than MOST_SOURCES sources are an error. The result depends on the rows, not on their order or partitions.
    """
    spark = prepared(docs.sparkSession)
    scratch = Scratch(spark, "mixing")
    text = F.col(text_col).cast("string")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(F.col(id_col).cast("long"), text).alias("key"), text.alias("text"))
    counted = own.mapInArrow(trimmed(_count), "row long, size long, doc_id long, source string, key long, text string")
    rows = scratch.save(counted if texts else counted.drop("text"), "rows")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    found = sizes.limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"a mix has at most {MOST_SOURCES} sources")
    sources = plan({r.source: r.size for r in found}, block)
    names = spark.createDataFrame([(k, s.name) for k, s in enumerate(sources)], "src long, its_source string")
    rows = rows.join(F.broadcast(names), F.col("source").eqNullSafe(F.col("its_source"))).drop("its_source")
    placed = _placed(rows.where("size > 0").select("row", "doc_id", "source", "src", "size", "key"), isqrt(sum(r.n for r in found)) + 1)
    parts = _parts(placed, block)
    if texts:
        cut = parts.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "n_words"))).alias("p"))
        cut = cut.join(rows.select("row", "text"), "row").select("row", F.col("p.start").alias("starts"), F.col("p.n_words").alias("lengths"), "text")
        cut = cut.mapInArrow(trimmed(_cut), "row long, texts array<string>")
        cut = cut.select("row", F.posexplode("texts").alias("k", "text"))
        parts = parts.withColumn("k", F.col("block") - F.floor(F.col("at") / block)).join(cut, ["row", "k"]).drop("k")
    slots = _all_slots(spark, sources, seed)
    length = F.least("n_words", F.col("length") - F.col("offset"))
    # Slots come from a short range of shards, so Spark takes them for a small table and would broadcast them.
    pieces = slots.hint("shuffle_merge").join(parts, ["src", "block"]).where("offset < length").withColumn("kept", length)
    if texts:  # the last slot of a source is cut within a piece
        short = F.expr(r"regexp_extract(text, concat('^[^ \t-\r]+(?:[ \t-\r]+[^ \t-\r]+){', kept - 1, '}'), 0)")
        pieces = pieces.withColumn("text", F.when(F.col("kept") < F.col("n_words"), short).otherwise(F.col("text")))
    pieces = pieces.select("shard", "slot", "source", "block", "offset", "row", "doc_id", "start", F.col("kept").alias("n_words"), *["text"] * texts)
    return Mix(rows.select("row", "doc_id", "source", "src", "size"), sources, pieces)


def _placed(rows: DataFrame, groups: int) -> DataFrame:
    """rows with `at`, the words of their source before them, in the order of group (a share of the key) and key."""
    rows = rows.withColumn("part", F.pmod("key", F.lit(groups)))
    before = Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("src", "part").agg(F.sum("size").alias("s")).select("src", "part", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy("src", "part").orderBy("key", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    return rows.join(base, ["src", "part"]).withColumn("at", F.col("base") + F.col("inner")).drop("base", "inner", "part", "key")


def _parts(placed: DataFrame, block: int) -> DataFrame:
    """A row for each block that a document has words in: block, offset (of the first of them in the block), start, n_words."""
    over = F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))
    begin, end = F.greatest("at", F.col("block") * block), F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block)
    rows = placed.select("*", F.explode(over).alias("block"))
    return rows.select("src", "block", "row", "doc_id", "source", "at", (begin - F.col("block") * block).alias("offset"), (begin - F.col("at")).alias("start"), (end - begin).alias("n_words"))


def _all_slots(spark: SparkSession, sources: list[Source], seed: int) -> DataFrame:
    shards = max(1, -(-sum(s.slots for s in sources) // SHARD_SLOTS))
    numbers = spark.range(0, shards, 1, min(shards, 4 * spark.sparkContext.defaultParallelism))
    return numbers.mapInArrow(_slots(sources, shards, seed), "shard long, slot long, src long, block long, length long")


def taken(mixed: Mix) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken (words in the mix, repeats counted)."""
    spark = mixed.rows.sparkSession
    none = F.lit(0).cast("long")
    used = mixed.pieces.select("row", "n_words", none.alias("size"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("src"))
    rows = mixed.rows.select("row", none.alias("n_words"), "size", "doc_id", "src").unionByName(used)
    rows = rows.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("src").alias("src"), F.max("size").alias("size"), F.sum("n_words").alias("taken"))
    its = [(k, s.name, s.size, float(s.target)) for k, s in enumerate(mixed.sources)]
    its = spark.createDataFrame(its, "src long, source string, source_size long, target double")
    return rows.join(F.broadcast(its), "src").select("doc_id", "source", "size", "source_size", "target", "taken")
