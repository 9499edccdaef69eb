"""Mixing, rolling windows and periodic runs against plain programs, and on awkward tables."""

from __future__ import annotations

import collections
import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import mixing, periodic, queries, rolling
from tests.llm.test_operators import DOC, awkward
from tests.oracle import same

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words_of(text):
    return WORD.findall((text or "").encode())


# --- periodic runs ---


def brute_runs(w, least=24, periods=3):
    """All runs, period by period: stretches in which words q apart are equal, unless a smaller period explains them."""
    n, out = len(w), []
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            a = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            size = i - a + q
            if i > a and size >= max(least, periods * q):
                s = w[a : a + size]
                if not any(s[p:] == s[: size - p] for p in range(1, q)):
                    out.append((a, size, q))
            i += i == a
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    w = words_of(text)
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    drop = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *four, sha(b"".join(b"%d,%d,%d\n" % r for r in runs)), sha(b" ".join(x for k, x in enumerate(w) if k not in drop)))


def test_runs_of_all_small_words():
    """All runs of two periods, over two letters up to length 10 and random ones beyond."""
    for n in range(1, 11):
        for bits in range(1 << n):
            w = [bits >> k & 1 for k in range(n)]
            assert [r[1:] for r in periodic.stretch_runs([np.array(w)], 2, 2)] == brute_runs(w, 2, 2)
    random = np.random.default_rng(1)
    some = [random.integers(0, int(random.integers(1, 5)), int(random.integers(1, 90))) for _ in range(150)]
    want = [(k, *r) for k, w in enumerate(some) for r in brute_runs(w.tolist(), 2, 2)]
    assert periodic.stretch_runs(some, 2, 2) == want


def test_runs_in_texts(monkeypatch):
    monkeypatch.setattr(periodic, "TOGETHER", 300)
    random, texts = np.random.default_rng(2), []
    for k in range(300):
        plain = lambda n: [b"p%d" % x for x in random.integers(0, 10**6, n)]
        text = plain(int(random.integers(0, 60)))
        for _ in range(int(random.integers(0, 4))):
            q = int(random.integers(1, 20))
            root = [b"%d" % x for x in random.integers(0, 1 + k % 4, q)]
            length = int(random.integers(10, 120))
            text += (root * (length // q + 1))[:length] + plain(int(random.integers(0, 5)))
        texts.append(text)
    want = [brute_runs(t) for t in texts]
    assert periodic.text_runs(texts) == want and sum(map(len, want)) > 200


def test_op13_equals_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, queries.op13_runs(spark, sf).collect()))
    assert got == sorted(brute_row(*r) for r in rows) and sum(r[1] for r in got) > 10


def test_collapse_on_awkward_rows(spark):
    frame, rows = awkward(spark)
    more = [(20, "a b " * 40 + "end"), (20, "a b " * 40 + "end"), (21, "x " * 2_000), (22, "\x00   " * 30)]
    frame = frame.unionByName(spark.createDataFrame([(k, t, 1.5, "x", 7, "y") for k, t in more], frame.schema))
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.collapse(frame).collect()), key=str)
    want = []
    for k, t in rows + more:
        w = words_of(t)
        runs = brute_runs(w) if k not in (6, 7) else []  # random words
        drop = {i for s, n, q in runs for i in range(s + q, s + n)}
        want.append((k, len(w), runs, b" ".join(x for i, x in enumerate(w) if i not in drop).decode()))
    assert got == sorted(want, key=str)
    assert periodic.collapse(frame.limit(0)).count() == 0


# --- mixing ---


def brute_targets(sizes, weights, most=3):
    """Shares by weight; sources over their limit are set to it, the rest share what is left, until none is over."""
    fixed = {}
    while True:
        left = Fraction(sum(sizes)) - sum(fixed.values())
        weight = sum(w for k, w in enumerate(weights) if k not in fixed)
        share = {k: left * w / weight for k, w in enumerate(weights) if k not in fixed}
        over = {k: Fraction(most * sizes[k]) for k in share if share[k] > most * sizes[k]}
        if not over:
            return [fixed.get(k, share.get(k)) for k in range(len(sizes))]
        fixed |= over


def test_targets():
    random = np.random.default_rng(0)
    for _ in range(200):
        sizes = (random.integers(0, 5, 8) ** 6).tolist()
        weights = [k % 3 + 1 for k in range(8)]
        assert mixing.targets(sizes, weights) == brute_targets(sizes, weights) or not sum(sizes)
    names = [s.name for s in mixing.plan({None: 1, "b": 2, "\U0001f600": 3, "＀": 4, "": 5})]
    assert names == ["", "b", "＀", "\U0001f600", None]


def test_permutations_and_counts():
    for n in (1, 2, 3, 100, 1025):
        assert sorted(mixing.permuted(np.arange(n), n, 5).tolist()) == list(range(n))
    assert (mixing.permuted(np.arange(100), 100, 5) != mixing.permuted(np.arange(100), 100, 6)).any()
    slots, shards = [5000, 0, 1, 70_000, 900], 37
    cells = [mixing.shard_counts(slots, k, shards) for k in range(shards)]
    counts = np.array([c for c, _ in cells])
    assert counts.sum(axis=0).tolist() == slots and counts.min() >= 0
    assert [b for _, b in cells] == (np.cumsum(counts, axis=0) - counts).tolist()
    assert set(counts.sum(axis=1).tolist()) <= {sum(slots) // shards, sum(slots) // shards + 1}
    # Spread like multinomial draws: variance of n p (1 - p), here about 90 for the first source.
    assert 40 < counts[:, 0].var() < 200
    big = [3 * 10**9, 5 * 10**9, 10**9]  # beyond the library's bound
    parts = np.array([mixing.shard_counts(big, k, 3)[0] for k in range(3)])
    assert parts.sum(axis=0).tolist() == big


def check_mix(rows, mixed, block):
    """Every rule of the mix, from its pieces; rows are (doc_id, source, text)."""
    got, pieces = mixed.rows.collect(), mixed.pieces.collect()
    assert sorted(((r.doc_id, r.source, r["size"]) for r in got), key=str) == sorted(((k, s, len(words_of(t))) for k, s, t in rows), key=str)
    size = collections.Counter()
    for r in got:
        size[r.source] += r["size"]
    names = sorted(size, key=lambda s: (s is None, s or ""))
    goal = dict(zip(names, brute_targets([size[s] for s in names], [k % 3 + 1 for k in range(len(names))]) if sum(size.values()) else [0] * len(names), strict=True))
    used, per_row, slots = collections.Counter(), collections.Counter(), collections.defaultdict(list)
    for p in pieces:
        used[p.source] += p.n_words
        per_row[p.row] += p.n_words
        slots[p.shard, p.slot].append((p.offset, p.n_words, p.source, p.block, p.doc_id, p.start, getattr(p, "text", None)))
    assert all(abs(used[s] - goal[s]) <= Fraction(1, 2) for s in names)
    its = {r.row: r for r in got}
    assert all(n <= 3 * its[k]["size"] for k, n in per_row.items())
    for s in slots.values():  # one block, without gaps
        s.sort(key=str)
        s.sort(key=lambda x: x[0])
        assert len({x[2:4] for x in s}) == 1 and [x[0] for x in s] == np.cumsum([0, *(x[1] for x in s)])[:-1].tolist() and sum(x[1] for x in s) <= block
    takes = collections.Counter((s[0][2], s[0][3]) for s in slots.values())
    assert max(takes.values(), default=0) <= 3
    return slots


def test_mix_of_small_tables(spark):
    random = np.random.default_rng(3)
    rows = []
    for k in range(300):
        source = [None, "a", "b", "c", "tiny"][int(random.choice(5, p=[0.1, 0.6, 0.2, 0.09, 0.01]))]
        rows.append((k, source, "  ".join(f"w{x}" for x in random.integers(0, 99, int(random.integers(0, 50))))))
    rows += [(1, "a", None), (1, "a", ""), (None, "a", "x y z"), (None, None, "x y z"), (5, "a", "long " * 5000), (5, "a", "long " * 5000), (6, "empty", None)]
    frame = spark.createDataFrame([(*r, 1, "q", 2.0) for r in rows], "doc_id long, source string, text string, size long, src string, row double")
    mixed = mixing.mix(frame, block=16, texts=True)
    slots = check_mix(rows, mixed, 16)
    texts = collections.defaultdict(set)
    for k, _, t in rows:
        texts[k].add(tuple(words_of(t)))
    for s in slots.values():
        for _, n, _, _, k, start, text in s:
            assert tuple(words_of(text)) in {w[start : start + n] for w in texts[k]} and len(words_of(text)) == n
    again = mixing.mix(frame.orderBy(F.rand(1)).repartition(7), block=16, texts=True)
    key = lambda m: sorted(map(str, m.pieces.drop("row").collect()))
    assert key(again) == key(mixed)
    none = mixing.mix(frame.limit(0))
    assert none.pieces.count() == 0 and mixing.taken(none).count() == 0
    blank = mixing.mix(frame.where("doc_id = 6 and source = 'empty'"))
    assert [tuple(r) for r in mixing.taken(blank).collect()] == [(6, "empty", 0, 0, 0.0, 0)]


def test_op11_equals_plain_program(spark, sf):
    """Words taken of each document, from the slots of all shards and the documents laid end to end in their order."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    keyed = docs.select("doc_id", "source", "text", F.xxhash64("doc_id", "text").alias("key")).collect()
    n = {r.doc_id: len(words_of(r.text)) for r in keyed}
    sizes = collections.Counter()
    for r in keyed:
        sizes[r.source] += n[r.doc_id]
    sources = mixing.plan(dict(sizes))
    shards = -(-sum(s.slots for s in sources) // mixing.SHARD_SLOTS)
    takes = collections.defaultdict(list)
    for k in range(shards):
        for _, src, block, length in zip(*mixing.shard_slots(sources, k, shards), strict=True):
            takes[sources[src].name].append((int(block) * mixing.BLOCK_WORDS, int(length)))
    groups = int(len(keyed) ** 0.5) + 1
    want, before = {}, collections.Counter()
    for r in sorted(keyed, key=lambda r: (r.key % groups, r.key)):
        at = before[r.source]
        before[r.source] += n[r.doc_id]
        end = before[r.source]
        want[r.doc_id] = sum(max(0, min(end, b + m) - max(at, b)) for b, m in takes[r.source])
    got = queries.op11_mixing(spark, sf).collect()
    goal = {s.name: float(s.target) for s in sources}
    where = {r.doc_id: r.source for r in keyed}
    assert {r.doc_id: (r["size"], r.source_size, r.target, r.taken) for r in got} == {k: (n[k], sizes[where[k]], goal[where[k]], want[k]) for k in n}


def test_too_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_SOURCES", 5)
    with pytest.raises(ValueError):
        mixing.mix(spark.range(6).selectExpr("id as doc_id", "cast(id as string) as source", "'a b' as text"))


# --- rolling windows ---


def test_op12_equals_sql(spark, sf):
    assert same(spark, sf, queries.op12_rolling, queries.OP12_SQL) == 400


def test_coarse_buckets(spark):
    values = sorted({0, *range(300), *(1 << k for k in range(40)), *((1 << k) - 1 for k in range(1, 40))})
    got = [r.b for r in spark.createDataFrame([(v,) for v in values], "v long").select("v", rolling.coarse(F.col("v")).alias("b")).orderBy("v").collect()]
    assert got == sorted(got) and got[:8] == list(range(8)) and max(got) < 160
    assert got[8:10] == [8, 8] and got[16:20] == [12, 12, 12, 12]


def brute_features(rows, widths):
    out = []
    for r in rows:
        for w in widths:
            inside = [x for x in rows if r[2] is not None and x[2] is not None and x[1] == r[1] and r[2] - w <= x[2] < r[2]]
            lengths = sorted(x[4] for x in inside if x[4] is not None)
            m = len(lengths)
            rank = lambda a, b: lengths[-(-a * m // b) - 1] if m else None  # noqa: B023, E731
            out.append((*r, w, len(inside), sum(lengths), len({x[3] for x in inside} - {None}), m, rank(1, 2), rank(99, 100)))
    return sorted(out, key=str)


def test_features_equal_brute_force(spark):
    random, rows = np.random.default_rng(8), []
    for k in range(700):
        source = [None, "", "a", "b"][int(random.choice(4, p=[0.1, 0.1, 0.5, 0.3]))]
        time = int(random.integers(-300, 2500)) // int(random.choice([1, 50])) * 1
        length = None if random.random() < 0.1 else int(random.choice([0, 1, 5, 1000, 1001, 1003, 10**6, 10**6 + 7])) + int(random.integers(0, 3))
        rows.append((k, source, time, [None, "en", "de", ""][int(random.integers(4))], length))
    rows += [(1, "a", None, "en", 5)] * 2 + [(2, "a", 700, "xx", 77)] * 400 + [(3, "lone", 5, None, None), (3, "lone", 6, None, None)]
    schema = "series long, time string, width long, label string, n long"  # clashing names
    frame = spark.createDataFrame([(k, s, t, g, n) for k, s, t, g, n in rows], schema.replace("width", "width_"))
    frame = frame.withColumnRenamed("width_", "width")
    for widths in ((60, 300), (300,), (1, 1000)):
        got = rolling.features(frame, widths, queries.OP12_RANKS, "time", "width", "n", "label")
        assert sorted(map(tuple, got.collect()), key=str) == brute_features(rows, widths)
    assert rolling.features(frame.limit(0), (60,), queries.OP12_RANKS, "time", "width", "n", "label").count() == 0


def test_many_labels(spark, monkeypatch):
    monkeypatch.setattr(rolling, "LABEL_COLUMNS", 7)
    rows = [(k, "s", k // 3, f"l{k % 50}", k) for k in range(400)]
    frame = spark.createDataFrame(rows, "id long, s string, t long, l string, v long")
    got = rolling.features(frame, (30, 100), queries.OP12_RANKS, "s", "t", "v", "l")
    assert sorted(map(tuple, got.collect()), key=str) == brute_features(rows, (30, 100))


def test_extra_columns_in_tables(spark, tmp_path):
    """The queries read documents with nulls in any column, repeated rows and extra columns."""
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "a b", "en", "s", 3), (2, "", "en", "s", 0), (3, "w " * 50, None, "s", 100)]
    frame = spark.createDataFrame(rows, DOC)
    for name in ("size", "row", "series", "time", "bucket", "span", "taken", "window_s", "runs"):
        frame = frame.withColumn(name, F.lit("z"))
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op11_mixing(spark, str(tmp_path)).count() == 5
    assert queries.op12_rolling(spark, str(tmp_path)).count() == 10
    assert sorted(r.n_runs for r in queries.op13_runs(spark, str(tmp_path)).collect()) == [0, 0, 0, 0, 1]
