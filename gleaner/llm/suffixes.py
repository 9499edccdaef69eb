"""Repeated byte strings by bucket-pointer refinement of a sparse suffix array.

A suffix starts at every byte; those whose next LENGTH bytes also start elsewhere are looked for.

Buckets and pointers. A bucket identifier of 2L bytes at p is made of the identifiers of L bytes at p and at
the later offset p + L, so each level reuses the last one's, from single bytes to Q-grams (the first buckets) and
2Q-grams. Any longer string is named by the identifiers that its first bytes and its later offsets point to; no
bytes are compared or hashed anew. Identifiers of Q-grams aren't stored for every byte, which would be eight times
the text: the doubling is repeated where a round needs some.

Neighbouring suffixes share one pointer: of the Q-grams inside a suffix's LENGTH bytes the one with the
smallest identifier (leftmost on ties), its anchor. The anchor depends on those bytes alone, so equal
strings have equal anchors at equal distances; about 2 in LENGTH - Q bytes are anchors, and only these leave
the text.

Refinement. A bucket holds runs of suffixes with the same anchor Q-gram. It is sorted by the identifiers at the
offsets around the anchor. A bucket with one member is finished: its suffixes are unique. Members that agree
in all bytes that their suffixes cover are finished too: the run repeats as a whole. The others stay open and keep
their bucket, which the next round refines: an open run's bucket is split into those of steps of STEP suffixes by
the identifiers at the first and the last offset of the bytes common to a step's suffixes (finished if all
that it covers agrees), and an open step's bucket, so refined, into those of single suffixes by the identifier at p;
the identifier at p + LENGTH - 2Q decides the rest. So a round reuses the updates of all rounds before it, and
members that were parted once never meet again. Each round takes only what the last one left open, and of equal
members one as the others' partner, so a group of m copies is m rows, once. Identifiers are hashes
instead of ranks, since ranks of all corpora would need a global sort in every round; two strings count as
equal by two 64-bit identifiers. No step is capped or sampled.

Rows are told apart by their place in a copy of the texts in the shared folder, never by their id. What a round
finds goes back to the texts in one folder for each file of them, so that texts are never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import grams
from .common import Scratch, trimmed

LENGTH = 200
Q = 64
STEP = 12
#: Suffixes that can share an anchor: distances 0 to SPREAD - 1.
SPREAD = LENGTH - Q + 1
#: A key is hot if one in SAMPLED rows holds it at least HOT_SAMPLE times and in more than one of HOT_KEYS rows.
SAMPLED = 64
HOT_SAMPLE = 64
HOT_KEYS = 2048
#: Partitions that a hot bucket is dealt over.
SALTS = 256
#: Bits of a row's number inside its file; the bits above are the file's number.
_ROW_BITS = 33
_POSITION = np.uint64((1 << 24) - 1)


def _doubled(ids: np.ndarray, size: int) -> np.ndarray:
    """Identifiers of 2 * size bytes from those of size bytes."""
    out = ids[: max(0, len(ids) - size)] * np.uint64(0x9E3779B97F4A7C15) + ids[size:]
    return out ^ (out >> np.uint64(29))


def _identifiers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Identifiers of Q and of 2Q bytes at every position that has them, from 1-grams by doubling."""
    now, size = grams.stream(31, 256)[data], 1
    while size < Q:
        now = _doubled(now, size)
        size *= 2
    return now * np.uint64(0xBF58476D1CE4E5B9), _doubled(now, Q)


def _anchors(ids: np.ndarray) -> np.ndarray:
    """For every suffix with LENGTH bytes the position of its anchor."""
    low = (ids & ~_POSITION) | np.arange(len(ids), dtype=np.uint64)
    size = 1
    while 2 * size <= SPREAD:
        low = np.minimum(low[: len(low) - size], low[size:])
        size *= 2
    if rest := SPREAD - size:
        low = np.minimum(low[: len(low) - rest], low[rest:])
    return (low & _POSITION).astype(np.int64)


def _runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first suffix, last suffix, anchor, identifier) of each run of suffixes with one anchor."""
    first, last, anchor, gram = [], [], [], []
    # Windows of the text overlap by LENGTH - 1 bytes, so that every suffix is in one window.
    for begin in range(0, max(1, len(data) - LENGTH + 1), grams.SLICE_BYTES):
        part = data[begin : begin + grams.SLICE_BYTES + LENGTH - 1]
        if len(part) < LENGTH:
            break
        ids, _ = _identifiers(part)
        at = _anchors(ids)
        turn = np.flatnonzero(np.diff(at)) + 1
        a = np.concatenate([[0], turn])
        first.append(a + begin)
        last.append(np.append(turn, len(at)) - 1 + begin)
        anchor.append(at[a] + begin)
        gram.append(ids[at[a]])
    if not first:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    first, last, anchor, gram = (np.concatenate(x) for x in (first, last, anchor, gram))
    # A window's end may split a run: both parts have one anchor and are one run again.
    new = np.append(True, anchor[1:] != anchor[:-1])
    return first[new], last[np.append(new[1:], True)], anchor[new], gram[new]


def _windows(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(which of the places, 2Q identifiers, where they begin) for the windows of the text that hold places."""
    window = at // grams.SLICE_BYTES
    for w in np.unique(window).tolist():
        begin = w * grams.SLICE_BYTES
        yield np.flatnonzero(window == w), _identifiers(data[begin : begin + grams.SLICE_BYTES + 6 * Q])[1], begin


def _name(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Names of the bytes i to j + 2Q, 2Q to 6Q of them, from the identifiers at the first and at two later offsets."""
    x = ids[i] * np.uint64(0x94D049BB133111EB) + ids[np.minimum(i + 2 * Q, j)]
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) + ids[j]
    return grams.mix(x + (j - i).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _names(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Names of data[a:b]."""
    out = np.empty(len(a), np.uint64)
    for which, ids, begin in _windows(data, a):
        out[which] = _name(ids, a[which] - begin, b[which] - 2 * Q - begin)
    return out.view(np.int64)


def _refined(bucket: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The buckets that members of a bucket get by an identifier at another offset."""
    return grams.mix(bucket * np.uint64(0xD6E8FEB86659FD93) + by)


class _Rows:
    """Gathers columns of several documents into one batch."""

    def __init__(self, schema: str):
        self.names, self.parts, self.n = [x.split()[0] for x in schema.split(", ")], [], 0

    def add(self, *columns: np.ndarray) -> None:
        self.parts.append(columns)
        self.n += len(columns[0])

    def taken(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        if self.n >= least:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[k] for p in self.parts])) for k in range(len(self.names))], self.names)
            self.parts, self.n = [], 0


class _Lists:
    """What a folder holds for each row, in the order of `value`; the folder has one part for each file of texts."""

    def __init__(self, folder: str, *more: str):
        self.folder, self.part, self.names = folder, None, ["doc", "value", *more]

    def of(self, doc: int) -> list[np.ndarray]:
        if doc >> _ROW_BITS != self.part:
            self.part = doc >> _ROW_BITS
            self._load()
        a, b = np.searchsorted(self.columns[0], [doc, doc + 1])
        return [x[a:b] for x in self.columns[1:]]

    def _load(self) -> None:
        store, root = pafs.FileSystem.from_uri(self.folder)
        found = store.get_file_info(pafs.FileSelector(f"{root}/part={self.part}", allow_not_found=True))
        parts = [[np.zeros(0, np.int64)] for _ in self.names]
        for info in found:
            if info.path.endswith(".parquet"):
                table = pq.read_table(info.path, filesystem=store, columns=self.names, partitioning=None)
                for k, name in enumerate(self.names):
                    parts[k].append(table.column(name).to_numpy())
        columns = [np.concatenate(x) for x in parts]
        order = np.lexsort((columns[1], columns[0]))
        self.columns = [x[order] for x in columns]


# A place packs a run into one long. Of a run of one anchor: anchor, distances back and ahead (8 bits
# each) from the anchor to the run's first and last suffix, and whether the run is known to repeat. Of a step:
# first suffix, further suffixes (4 bits), known. Of a suffix: its position and known.
ROWS = "doc long, place long, bucket long, full long"


def _run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """bucket: the anchor's Q-gram; full: the bytes that the run covers."""
    rows = _Rows(ROWS)
    for batch in batches:
        for i, data, offsets in grams.slices(batch.column(1)):
            for k in range(len(offsets) - 1):
                own = data[offsets[k] : offsets[k + 1]]
                if len(own) < LENGTH:
                    continue
                first, last, anchor, gram = _runs(own)
                # Equal covered bytes are equal runs only if the anchor stands at the same place in them.
                where = (anchor - first).astype(np.uint64) << np.uint64(8) | (last - first).astype(np.uint64)
                full = _names(own, first, last + LENGTH) ^ grams.mix(where).view(np.int64)
                place = anchor << 17 | (anchor - first) << 9 | (anchor - last) << 1
                rows.add(np.full(len(first), batch.column(0)[i + k].as_py()), place, gram.view(np.int64), full)
            yield from rows.taken(50_000)
    yield from rows.taken()


def _steps(runs: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """(run, place, step, common bytes from a to b, covered bytes from c to d) of the steps of runs in a text of n bytes."""
    at, back, ahead, known = runs >> 17, runs >> 9 & 255, runs >> 1 & 255, runs & 1
    low = ahead // STEP
    size = back // STEP + 1 - low
    run = np.repeat(np.arange(len(runs)), size)
    at, back, ahead, known, low = (x[run] for x in (at, back, ahead, known, low))
    step = low + np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
    near, far = step * STEP, np.minimum(step * STEP + STEP, SPREAD) - 1
    first, last = at - np.minimum(far, back), at - np.maximum(near, ahead)
    whole = (at >= far) & (at - near + LENGTH <= n)
    return run, first << 5 | last - first << 1 | known, step, at - near, at - far + LENGTH, np.where(whole, at - far, first), np.where(whole, at - near, last) + LENGTH


def _step_rows(folder: str) -> callable:
    """bucket: that of the step's run, refined by the bytes common to the step's suffixes; full: those that it covers.

    folder: open runs with their buckets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, open_runs = _Rows(ROWS), _Lists(folder, "bucket")
        for batch in batches:
            for k, doc in enumerate(batch.column(0).to_pylist()):
                runs, held = open_runs.of(doc)
                if not len(runs):
                    continue
                data = np.frombuffer(batch.column(1)[k].as_py().encode(), np.uint8)
                own, place, step, a, b, c, d = _steps(runs, len(data))
                # A step's number is part of the bucket; where its covered bytes begin and end in it, part of their name.
                bucket = _refined(held.view(np.uint64)[own], step.astype(np.uint64))
                full = grams.mix(((a - c) << 8 | d - c).astype(np.uint64))
                for which, ids, begin in _windows(data, c):
                    first, last = a[which] - begin, b[which] - 2 * Q - begin
                    bucket[which] = _refined(_refined(bucket[which], ids[first]), ids[last])
                    full[which] ^= _name(ids, c[which] - begin, d[which] - 2 * Q - begin)
                rows.add(np.full(len(place), doc), place, bucket.view(np.int64), full.view(np.int64))
                yield from rows.taken(50_000)
        yield from rows.taken()

    return run


def _suffix_rows(folder: str) -> callable:
    """bucket: that of the suffix's step, refined by the suffix's first bytes; full: the identifier at its last offset.

    folder: open steps with their buckets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, open_steps = _Rows(ROWS), _Lists(folder, "bucket")
        for batch in batches:
            for k, doc in enumerate(batch.column(0).to_pylist()):
                steps, held = open_steps.of(doc)
                if not len(steps):
                    continue
                data = np.frombuffer(batch.column(1)[k].as_py().encode(), np.uint8)
                size = (steps >> 1 & 15) + 1
                own = np.repeat(np.arange(len(steps)), size)
                at = (steps >> 5)[own] + np.arange(len(own)) - (np.cumsum(size) - size)[own]
                bucket, full = held.view(np.uint64)[own], np.empty(len(at), np.uint64)
                for which, ids, begin in _windows(data, at):
                    bucket[which] = _refined(bucket[which], ids[at[which] - begin])
                    full[which] = ids[at[which] - begin + LENGTH - 2 * Q]
                rows.add(np.full(len(at), doc), at << 1 | (steps & 1)[own], bucket.view(np.int64), grams.mix(full).view(np.int64))
                yield from rows.taken(50_000)
        yield from rows.taken()

    return run


class _Spans(_Lists):
    """The bytes of each row that repeat; the folder holds first suffix << 32 | last suffix."""

    def pieces(self, doc: int) -> list[tuple[int, int]]:
        """(first byte, end) in order, apart from each other."""
        (spans,) = self.of(doc)
        if not len(spans):
            return []
        first, end = spans >> 32, np.maximum.accumulate((spans & 0xFFFFFFFF) + LENGTH)
        apart = np.flatnonzero(np.append(True, first[1:] > end[:-1]))
        return list(zip(first[apart].tolist(), end[np.append(apart[1:], len(end)) - 1].tolist(), strict=True))


def _digests(folder: str) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Spans(folder)
        for batch in batches:
            rows = []
            for k, doc in enumerate(batch.column(0).to_pylist()):
                raw = (batch.column(2)[k].as_py() or "").encode()
                spans, kept, at = found.pieces(doc), hashlib.sha256(), 0
                for a, b in spans:
                    kept.update(raw[at:a])
                    at = b
                kept.update(raw[at:])
                rows.append((batch.column(1)[k].as_py(), len(raw), sum(b - a for a, b in spans), len(spans), kept.hexdigest()))
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            kinds = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds[c]) for c in range(5)], names)

    return run


def _cleaned(folder: str, at: int) -> callable:
    """Columns: the row's place, then those of the documents, of which the text is number `at`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Spans(folder)
        for batch in batches:
            texts = [_without(x, found.pieces(doc)) for x, doc in zip(batch.column(at + 1).to_pylist(), batch.column(0).to_pylist(), strict=True)]
            columns = [pa.array(texts, pa.string()) if k == at + 1 else batch.column(k) for k in range(1, batch.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[1:])

    return run


def _without(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    if not spans:
        return text
    raw, out, at = text.encode(), [], 0
    for a, b in spans:
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while a < b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        out.append(raw[at:a])
        at = max(at, b)
    return b"".join([*out, raw[at:]]).decode()


def _resolved(rows: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(doc, place, bucket, many, goes_on) of the rows that aren't alone in their bucket; bucket: of those that go on.

    many: another row has the same bucket and full. goes_on: the bucket also has other rows, and this row has no
    equal or is their partner. Buckets are dealt by hash, each sorted by full in one pass. Hot buckets are dealt
    by full as well, and rows of a hot (bucket, full), which are many, stay where they are; a sample of at least
    two of their rows says which are hot (at most HOT_KEYS of either kind), and doesn't change the result.
    """
    key = ["bucket", "full"]
    sample = rows.where(F.pmod(F.xxhash64("doc", "place", F.lit(7)), F.lit(SAMPLED)) == 0)
    least = max(HOT_SAMPLE, sample.count() // HOT_KEYS)
    often = lambda by: sample.groupBy(*by).count().where(F.col("count") >= least).select(*by).collect()
    equal, row = F.xxhash64("bucket", "full"), F.xxhash64("doc", "place")
    hot = [r.bucket for r in often(["bucket"])]
    whole, rest = None, rows.withColumn("hot_mixed", F.lit(None).cast("boolean"))
    if hot:
        hot_rows = rows.where(F.col("bucket").isin(hot))
        mixed = hot_rows.groupBy("bucket").agg((F.min("full") != F.max("full")).alias("mixed")).where("mixed").collect()
        mixed = F.col("bucket").isin([r.bucket for r in mixed])
        names = [r.name for r in sample.groupBy(equal.alias("name")).count().where(F.col("count") >= least).collect()]
        same = F.col("bucket").isin(hot) & equal.isin(names)
        partners = [r.p for r in hot_rows.where(same).groupBy(*key).agg(F.min(row).alias("p"), F.count("*").alias("n")).where("n > 1").collect()]
        whole = hot_rows.where(same).select("doc", "place", "bucket", F.lit(True).alias("many"), (mixed & row.isin(partners)).alias("goes_on"))
        rest = rows.where(~same).withColumn("hot_mixed", F.when(F.col("bucket").isin(hot), mixed))
    salt = F.when(F.col("hot_mixed").isNotNull(), F.pmod("full", F.lit(SALTS))).otherwise(0).cast("int")
    rest = rest.withColumn("salt", salt).repartition("bucket", "salt")
    own, same = Window.partitionBy("bucket", "salt"), Window.partitionBy("bucket", "salt", "full")
    rest = rest.select(
        "doc", "place", "bucket", "hot_mixed",
        F.row_number().over(same.orderBy("doc", "place")).alias("number"), F.count("*").over(same).alias("n"),
        F.count("*").over(own).alias("members"), (F.min("full").over(own) != F.max("full").over(own)).alias("mixed"),
    )
    rest = rest.where((F.col("members") > 1) | F.col("hot_mixed").isNotNull())
    rest = rest.select("doc", "place", "bucket", (F.col("n") > 1).alias("many"), (F.coalesce("hot_mixed", "mixed") & (F.col("number") == 1)).alias("goes_on"))
    found = (rest if whole is None else rest.unionByName(whole)).where("many or goes_on")
    return scratch.save(found.withColumn("bucket", F.when(F.col("goes_on"), F.col("bucket"))), name)


def _delivered(rows: DataFrame, scratch: Scratch, name: str) -> str:
    """Writes rows (doc, value, and their bucket if they have one) into a folder with one part for each file of texts, and gives the folder."""
    where = scratch.path(name)
    part = F.shiftright("doc", _ROW_BITS).cast("int").alias("part")
    rows.select("*", part).repartition("part").write.partitionBy("part").parquet(where)
    return where


def _repeats(texts: DataFrame, scratch: Scratch) -> str:
    """The folder of spans (first suffix << 32 | last suffix) that repeat. texts: doc and text, as saved."""
    p = F.col("place")
    bits = lambda shift: F.shiftright(p, shift).bitwiseAND(255)
    span = lambda a, b: (F.shiftleft(a, 32) + b).alias("value")
    known = p.bitwiseAND(1) == 1
    more = F.when(F.col("many"), p.bitwiseOR(F.lit(1))).otherwise(p).alias("value")
    runs = scratch.save(texts.mapInArrow(trimmed(_run_rows), ROWS), "rows")
    found = _resolved(runs, scratch, "first")
    anchor = F.shiftright(p, 17)
    spans = found.where("many").select("doc", span(anchor - bits(9), anchor - bits(1)))
    folder = _delivered(found.where("goes_on").select("doc", more, "bucket"), scratch, "open-runs")
    steps = scratch.save(texts.mapInArrow(trimmed(_step_rows(folder)), ROWS), "rows")
    found = _resolved(steps, scratch, "second")
    first = F.shiftright(p, 5)
    spans = spans.unionByName(found.where(F.col("many") & ~known).select("doc", span(first, first + F.shiftright(p, 1).bitwiseAND(15))))
    folder = _delivered(found.where("goes_on").select("doc", more, "bucket"), scratch, "open-steps")
    last = scratch.save(texts.mapInArrow(trimmed(_suffix_rows(folder)), ROWS), "rows")
    found = _resolved(last, scratch, "third")
    spans = spans.unionByName(found.where(F.col("many") & ~known).select("doc", span(F.shiftright(p, 1), F.shiftright(p, 1))))
    folder = _delivered(spans, scratch, "spans")
    scratch.drop("rows", "first", "second", "third")
    return folder


def _saved(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The documents' columns as c0, c1, ... behind `doc`, the file and row that they are saved in."""
    numbered = docs.toDF(*(f"c{k}" for k in range(len(docs.columns)))).select(F.monotonically_increasing_id().alias("doc"), "*")
    return scratch.save(numbered, "texts")


def _searched(saved: DataFrame, text_at: int) -> DataFrame:
    return saved.select("doc", F.coalesce(F.col(f"c{text_at}").cast("string"), F.lit("")).alias("text"))


def removal_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, on UTF-8 bytes.

    Null counts as the empty text; texts under LENGTH bytes lose nothing. Rows are documents of their own,
    whatever their ids, null ones too: equal rows repeat each other. An empty table gives no rows. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "suffixes")
    saved = _saved(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), scratch)
    folder = _repeats(_searched(saved, 1), scratch)
    return saved.mapInArrow(trimmed(_digests(folder)), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with their columns, the text without the repeated bytes; a character that is only partly covered stays.

    Rows stay even if nothing of their text does. Nulls, short texts and ids as in removal_report; columns may
    have any names.
    """
    scratch = Scratch(docs.sparkSession, "suffixes")
    saved = _saved(docs, scratch)
    at = docs.columns.index(text_col)
    folder = _repeats(_searched(saved, at), scratch)
    return saved.mapInArrow(trimmed(_cleaned(folder, at)), saved.drop("doc").schema).toDF(*docs.columns)
