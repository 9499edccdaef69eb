"""The training-data operators against brute force, round trips and held-out labels, and on awkward tables."""

from __future__ import annotations

import collections
import hashlib
import time
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gleaner.llm import bitpack, chat, decontaminate, grams, importance, metric, minhash, packing, queries, suffixes, tokens, toxicity, urlfilter
from gleaner.llm.common import Scratch, join_counted, table
from gleaner.llm.components import components
from tests.oracle import same

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{k}" for k in range(400)]


def documents(spark, rows):
    return spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], DOC)


def awkward(spark):
    """Nulls, empty, very short and very long texts, repeated rows; extra columns with clashing names."""
    random = np.random.default_rng(3)
    long = " ".join(random.choice(WORDS, 30_000))
    rows = [(1, None), (2, ""), (3, "   \n"), (4, "one two"), (5, "one two"), (6, long), (7, long + " tail"), (8, "Ünïcode ß " * 60), (9, "a" * 5000), (None, "one two three four five six"), (6, long)]
    frame = spark.createDataFrame([(k, t, 1.5, "x", 7, "y") for k, t in rows], "doc_id long, text string, component_id double, kept string, n long, place string")
    return frame, rows


# --- shared parts ---


def test_words_and_shingles():
    texts = ["Ab c\x0bd", "", "x  y", "a b c d e a b c d e a"]
    column = pa.array(texts)
    for _, data, offsets in grams.slices(column):
        h, at = grams.words(data, offsets, lower=True)
        assert np.diff(at).tolist() == [3, 0, 2, 11]
        sets = grams.shingles(h, at, 5)
    assert [len(s) for s in sets] == [1, 0, 1, 5]
    h1, _ = grams.words(np.frombuffer(b"Word wORD", np.uint8), np.array([0, 9]), lower=True)
    assert h1[0] == h1[1]


def test_components(spark):
    random = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in random.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5), (7, None)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if b is not None:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {k: find(k) for k in up if find(k) != k}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0
    hub = spark.range(1, 2000).selectExpr("id * 3 as a", "0L as b").union(spark.createDataFrame([(0, -5)], "a long, b long"))  # beyond HOT
    assert {r.component for r in components(hub, Scratch(spark, "t")).collect()} == {-5}


def test_join_counted(spark):
    rows = spark.range(3000).selectExpr("id", "if(id < 2000, 1L, id) as k")
    side = rows.where("id % 5 > 0 or k = 1").groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("v"))
    for how in ("inner", "left"):
        got = join_counted(rows, side, ["k"], "n", how).select("id", "k", "v")
        want = rows.join(side, ["k"], how).select("id", "k", "v")
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


# --- near-duplicates ---


def shingle_set(text):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)])


def brute_components(rows):
    sets = {k: shingle_set(t) for k, t in rows if k is not None}
    up = {k: k for k in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {k: (len(sets[k]), find(k)) for k in sets}


def near_copies(n=150):
    random = np.random.default_rng(5)
    rows = []
    for family in range(10):
        base = random.choice(WORDS, int(random.integers(6, 300))).tolist()
        for _ in range(n // 10):
            words = list(base)
            for _ in range(int(random.integers(0, 6))):
                words[int(random.integers(len(words)))] = f"n{random.integers(10**6)}"
            rows.append(" ".join(words))
    random.shuffle(rows)
    return [(k * 3 + 1, t) for k, t in enumerate(rows)]


def test_minhash_equals_brute_force(spark, monkeypatch):
    rows = near_copies()
    monkeypatch.setattr(minhash, "CHUNK", 8)  # buckets of several chunks
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(documents(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_minhash_repeated_rows(spark):
    rows = []
    for k in range(0, 90, 3):  # b and c are near a, but not near each other
        a = [f"t{k}.{i}" for i in range(100)]
        rows += [(k, " ".join(a)), (k + 1, " ".join(["x"] * 9 + a[9:])), (k + 2, " ".join(a[:-9] + ["y"] * 9))]
    got = minhash.near_duplicates(documents(spark, rows + rows)).collect()
    assert len(got) == 2 * len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows)


def brute_rows(rows):
    """The least id that each row reaches, every row being a node of its own."""
    sets = [shingle_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), k), k)
    return sorted((k, len(sets[i]), least[find(i)]) for i, (k, _) in enumerate(rows))


def test_minhash_one_id_with_several_texts(spark):
    a, c = (" ".join(f"{x}{i}" for i in range(50)) for x in "ac")
    rows = [(1, a), (1, c), (2, a + " x"), (3, c + " x"), (9, c + " y"), (9, a + " y"), (9, a + " y")]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(documents(spark, rows)).collect())
    assert got == brute_rows(rows) and (3, 47, 1) in got
    rows = [(5, a), (5, c), (2, a + " x"), (3, c + " x")]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(documents(spark, rows)).collect())
    assert got == brute_rows(rows)


def test_minhash_second_round(spark, monkeypatch):
    """Chains whose neighbours are near and whose ends aren't, in shared buckets of several chunks."""
    rows = []
    for family in range(6):
        words = [f"f{family}.{i}" for i in range(120)]
        for step in range(24):
            rows.append((len(rows) * 7 % 1009, " ".join([f"s{family}.{step}.{i}" if i < step * 5 and i % 2 else w for i, w in enumerate(words)])))
    monkeypatch.setattr(minhash, "CHUNK", 3)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(documents(spark, rows)).collect())
    assert got == brute_rows(rows)
    monkeypatch.setattr(minhash, "CHUNK_BYTES", 2000)  # chunks by bytes
    monkeypatch.setattr(minhash, "CHUNK", 256)
    assert got == sorted((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(documents(spark, rows)).collect())


def test_minhash_awkward(spark):
    frame, rows = awkward(spark)
    got = minhash.near_duplicates(frame).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0 and by[2].component_id == 2 and by[2].kept
    assert by[5].component_id == 4 and not by[5].kept and by[7].component_id == 6
    assert by[None].component_id is None and not by[None].kept
    assert minhash.near_duplicates(frame.limit(0)).count() == 0


# --- vectors ---


def brute_links(rows, least):
    good = [(k, np.array(v, float), y) for k, v, y in rows if k is not None and y is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    up = {k: k for k, _, _ in rows}
    n = collections.Counter()

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x, p) in enumerate(good):
        for b, y, q in good[i + 1 :]:
            if p == q and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least:
                n[a] += 1
                n[b] += 1
                s, t = sorted((find(a), find(b)))
                up[t] = s
    return {k: (n[k], find(k)) for k in up}


def test_metric_equals_brute_force(spark, monkeypatch):
    random = np.random.default_rng(2)
    centres = random.normal(size=(12, 16))
    rows = [(k, (centres[k % 12] + random.normal(size=16) * random.choice([0.0, 0.2, 0.5])).tolist(), int(k % 3)) for k in range(360)]
    rows += [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] * 16, 1), (503, rows[0][1], None), (504, rows[0][1][:8], 0), (505, [None] * 16, 1), (506, [], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("cell", F.lit("x"))
    for cell, block, stream, piece in ((10_000, 1024, 1 << 16, 1024), (20, 7, 11, 5), (15, 1024, 30, 3), (10_000, 16, 1 << 16, 1024)):
        for name, value in zip(("CELL", "BLOCK", "STREAM", "PIECE"), (cell, block, stream, piece), strict=True):
            monkeypatch.setattr(metric, name, value)
        got = {r.vec_id: (r.n_links, r.component_id) for r in metric.near_vectors(frame, 0.93).collect()}
        assert got == brute_links(rows, 0.93)
    assert metric.near_vectors(frame.limit(0)).count() == 0


def test_metric_one_id_with_several_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0]), (3, [0.01, 1.0]), (7, [-1.0, 0.0])]
    frame = spark.createDataFrame([(k, v, 0) for k, v in rows], "vec_id long, embedding array<float>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in metric.near_vectors(frame, 0.93).collect())
    assert got == [(1, 1, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 2, 1, False), (3, 2, 1, False), (7, 0, 7, True)]


# --- repeated byte strings ---


def brute_removal(rows):
    count = collections.Counter()
    raws = [(k, (t or "").encode()) for k, t in rows]
    for _, raw in raws:
        for i in range(len(raw) - 199):
            count[raw[i : i + 200]] += 1
    out = {}
    for k, raw in raws:
        mask = np.zeros(len(raw), bool)
        for i in range(len(raw) - 199):
            if count[raw[i : i + 200]] > 1:
                mask[i : i + 200] = True
        kept = bytes(np.frombuffer(raw, np.uint8)[~mask])
        out[k] = (len(raw), int(mask.sum()), int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def repeated_rows():
    random = np.random.default_rng(8)
    text = lambda n: " ".join(random.choice(WORDS, n))
    shared, rows = [text(60) for _ in range(4)], []
    for k in range(60):
        parts = [text(int(random.integers(0, 80)))]
        for _ in range(int(random.integers(0, 3))):
            s = shared[int(random.integers(4))]
            a = int(random.integers(0, 40))
            parts += [s[a : a + int(random.integers(180, 330))], text(int(random.integers(0, 9)))]
        rows.append((k, " ".join(parts)))
    exact = text(36)[:200]
    rows += [(100, "é" * 300), (101, "abc " * 120), (102, None), (103, ""), (104, exact), (105, "x" + exact), (106, exact[1:] + "y"), (107, rows[0][1]), (108, rows[0][1] + "!")]
    return rows


def test_suffixes_equal_brute_force(spark, monkeypatch):
    rows = repeated_rows()
    want = brute_removal(rows)
    assert sum(v[1] > 0 for v in want.values()) > 20
    for hot, sampled in ((suffixes.HOT_SAMPLE, suffixes.SAMPLED), (2, 1), (4, 2)):  # without and with hot keys
        monkeypatch.setattr(suffixes, "HOT_SAMPLE", hot)
        monkeypatch.setattr(suffixes, "SAMPLED", sampled)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.removal_report(documents(spark, rows)).collect()}
        assert got == want


def test_suffixes_one_id_with_several_texts(spark):
    random = np.random.default_rng(12)
    y, z = ("".join(random.choice(list("abcdefgh "), 900)) for _ in range(2))
    rows = [(1, y), (1, z), (2, y[:300])]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in suffixes.removal_report(documents(spark, rows)).collect())
    assert got == [(1, 900, 0), (1, 900, 300), (2, 300, 300)]


def test_names_of_windows(monkeypatch):
    data = np.random.default_rng(3).integers(0, 3, 5000).astype(np.uint8)
    a = np.arange(0, 4600, 7)
    b = a + 128 + a % 250
    whole = suffixes._names(data, a, b)
    monkeypatch.setattr(grams, "SLICE_BYTES", 500)
    assert (suffixes._names(data, a, b) == whole).all() and len(np.unique(whole)) == len(a)
    twice = np.concatenate([data, data])
    assert (suffixes._names(twice, a, b) == suffixes._names(twice, a + 5000, b + 5000)).all()


def test_rounds_refine_the_buckets_before(tmp_path):
    """Steps and suffixes of equal bytes share a bucket exactly if their runs did."""
    text = " ".join(np.random.default_rng(4).choice(WORDS, 90))
    first, last, anchor, gram = suffixes._runs(np.frombuffer(text.encode(), np.uint8))
    place = anchor << 17 | (anchor - first) << 9 | (anchor - last) << 1

    def delivered(name, values, buckets):
        (tmp_path / name / "part=0").mkdir(parents=True)
        columns = {"doc": np.repeat(np.arange(3), len(values)), "value": np.tile(values, 3), "bucket": np.concatenate(buckets)}
        pq.write_table(pa.table(columns), tmp_path / name / "part=0" / "a.parquet")
        return (tmp_path / name).as_uri()

    texts = pa.RecordBatch.from_arrays([pa.array([0, 1, 2]), pa.array([text] * 3)], ["doc", "text"])
    gram = gram.view(np.int64)
    rows = pa.Table.from_batches(suffixes._step_rows(delivered("runs", place, [gram, gram, gram + 1]))(iter([texts]))).to_pandas()
    steps = [rows[rows.doc == k].reset_index(drop=True) for k in range(3)]
    assert steps[0].place.equals(steps[1].place) and steps[0].bucket.equals(steps[1].bucket) and steps[0].full.equals(steps[1].full)
    assert (steps[0].bucket != steps[2].bucket).all() and steps[0].full.equals(steps[2].full)
    where = delivered("steps", steps[0].place.to_numpy(), [x.bucket.to_numpy() for x in steps])
    rows = pa.Table.from_batches(suffixes._suffix_rows(where)(iter([texts]))).to_pandas()
    single = [rows[rows.doc == k].reset_index(drop=True) for k in range(3)]
    assert sorted(single[0].place // 2) == list(range(len(text) - 199))
    assert single[0].bucket.equals(single[1].bucket) and (single[0].bucket != single[2].bucket).all()
    assert single[0].bucket.is_unique and single[0].full.equals(single[2].full)


def test_windows_of_long_texts(monkeypatch):
    monkeypatch.setattr(grams, "SLICE_BYTES", 500)
    data = np.frombuffer(" ".join(np.random.default_rng(1).choice(WORDS, 900)).encode(), np.uint8)
    first, last, anchor, _ = suffixes._runs(data)
    assert np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last, strict=True)]).tolist() == list(range(len(data) - 199))
    assert ((anchor >= last) & (anchor + suffixes.Q <= first + 200)).all()


def test_windows_do_not_split_runs(spark, monkeypatch):
    data = np.random.default_rng(6).integers(97, 123, grams.SLICE_BYTES + 60_000).astype(np.uint8)
    rows = [(1, data.tobytes().decode()), (2, data[grams.SLICE_BYTES - 900 : grams.SLICE_BYTES - 500].tobytes().decode())]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.removal_report(documents(spark, rows)).collect()}
    assert got == brute_removal(rows)
    data = data[:9000]
    whole = suffixes._runs(data)
    monkeypatch.setattr(grams, "SLICE_BYTES", 500)
    assert all((a == b).all() for a, b in zip(suffixes._runs(data), whole, strict=True))


def test_remove_repeats_keeps_columns_and_characters(spark):
    frame = documents(spark, [(1, "ä" * 150 + "1"), (2, "xx" + "ä" * 150), (3, None), (None, "ä" * 150)])
    got = {r.doc_id: r for r in suffixes.remove_repeats(frame).collect()}
    assert frame.columns == suffixes.remove_repeats(frame).columns
    assert got[1].text == "1" and got[2].text == "xx" and got[3].text is None and got[None].text == ""
    assert suffixes.remove_repeats(frame.limit(0)).count() == 0


def test_suffixes_awkward(spark):
    frame, rows = awkward(spark)
    got = collections.Counter(r.doc_id for r in suffixes.removal_report(frame).collect())
    assert got == collections.Counter(k for k, _ in rows)


def test_suffixes_without_ids(spark):
    """Rows without an id are documents like others: they lose what repeats, and make others lose it."""
    rows = repeated_rows()
    text = next(t for _, t in rows if t and len(t.encode()) > 500)
    rows = [*rows, (None, text), (None, None), (None, "short")]
    keyed = [(k if k is not None else 10**6 + i, t) for i, (k, t) in enumerate(rows)]
    want = sorted((v[1:] if isinstance(v, tuple) and len(v) > 4 else v for v in map(tuple, suffixes.removal_report(documents(spark, keyed)).collect())), key=str)
    got = sorted((tuple(r)[1:] for r in suffixes.removal_report(documents(spark, rows)).collect()), key=str)
    assert got == want and any(x[1] for x in got)


# --- tokens, packing, files ---

TEXTS = [
    "", "  a  b\n\n c 's it's 12 3.4  ", "ŁódźÄÖ ß ﬁ <|endoftext|> x", "İı Σς", "a b\x85c", "Ⅷ ½ ²", "dog's 's  're'veer'll ''s x'd2't'S'r", "a\n\n b \t\n", "  ", "漢字 and", "🙂 ok", "x" * 3000,
    "\ta 'll'\n'", "it''s 're", "1a2b 33", "don't! (yes) - no--- \"q\"", "A's B'S",
]


@pytest.mark.parametrize("name,kind", [("byte_bpe_50k.json", "bytes"), ("word_bpe_49k.json", "words")])
def test_encoder_equals_library(name, kind, monkeypatch):
    from tokenizers import Tokenizer

    path = queries.vocabulary(name)
    coder, library = tokens.Encoder(path), Tokenizer.from_file(path)
    assert coder.kind == kind
    random = np.random.default_rng(4)
    texts = TEXTS + ["a <|endoftext|> b", "<|startoftext|>", "x <|EndOfText|>", "<|", "a <|endof text|>", "<|endoftext|><|endoftext|> ok"]
    texts += ["".join(random.choice(list("ab 's't12.,!\n\té'reßÜl-<|>"), 60)) for _ in range(300)]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in coder.encode(texts)] == want
    coder.check[:] += np.uint64(1)  # every known word now looks like a collision
    assert [x.tolist() for x in coder.encode(texts)] == want
    monkeypatch.setattr(tokens, "CACHE", 5)
    assert [coder.encode([t])[0].tolist() for t in texts] == want
    coder.kind = None  # an unknown file
    assert [x.tolist() for x in coder.encode(texts[:20])] == want[:20]


def test_kinds_of_files():
    import json

    with open(queries.vocabulary("byte_bpe_50k.json"), encoding="utf-8") as file:
        parts = json.load(file)
    assert tokens.kind_of(parts) == "bytes"
    for key, value in (("normalizer", {"type": "NFKC"}), ("pre_tokenizer", {"type": "Whitespace"}), ("truncation", {"max_length": 5}), ("model", {"type": "WordPiece"})):
        assert tokens.kind_of(parts | {key: value}) is None


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(spark):
    coder = tokens.Encoder(queries.vocabulary("byte_bpe_50k.json"))
    frame, rows = awkward(spark)
    want = {k: coder.encode([t or ""])[0].tolist() + [0] for k, t in rows}
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in packing.pack(frame, queries.vocabulary("byte_bpe_50k.json")).collect():
        assert r.doc_tokens == len(want[r.doc_id]) and r.ids_crc32 == crc(want[r.doc_id][r.start : r.start + r.length])
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for k, ids in want.items():
        copies = sum(x == k for x, _ in rows)
        assert sum(n for _, n in pieces[k]) == copies * len(ids)
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 1024
    assert packing.pack(frame.limit(0), queries.vocabulary("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("limits", [packing.Limits(100, 4, 60), packing.Limits(64, 64, 64), packing.Limits(50, 2, 50)])
def test_place_keeps_all_limits(limits):
    random = np.random.default_rng(9)
    sizes = [(int(n), int(random.integers(0, n + 1))) for n in random.integers(1, 260, 300)] + [(0, 0)]
    placed, held, seen = packing.place(sizes, limits), collections.defaultdict(lambda: [0, 0, 0]), collections.defaultdict(int)
    for item, start, length, sequence, offset in sorted(placed, key=lambda x: (x[3], x[4])):
        n, loss = sizes[item]
        assert length > 0 and offset == held[sequence][0]
        held[sequence][0] += length
        held[sequence][1] += 1
        held[sequence][2] += max(0, start + length - max(start, n - loss))
    for item, start, length, _, _ in sorted(placed):
        assert start == seen[item]
        seen[item] += length
    assert all(seen[k] == n for k, (n, _) in enumerate(sizes))
    assert all(t <= limits.tokens and s <= limits.segments and x <= limits.loss_tokens for t, s, x in held.values())


def test_packing_pads_little():
    sizes = [(int(n), int(n)) for n in np.random.default_rng(1).lognormal(5.5, 1.0, 2000) + 1]
    used = len({p[3] for p in packing.place(sizes, packing.Limits())})
    assert sum(n for n, _ in sizes) >= 0.99 * 1024 * used


def test_packing_under_three_limits():
    limits = packing.DOCUMENT_LIMITS
    sizes = [(int(n), packing.loss_tokens(int(n), packing.DOCUMENT_PROMPT)) for n in np.random.default_rng(1).lognormal(5.5, 1.6, 4000) + 1]
    placed, held = packing.place(sizes, limits), collections.defaultdict(lambda: [0, 0, 0])
    for item, start, length, sequence, _ in placed:
        n, loss = sizes[item]
        held[sequence] = [a + b for a, b in zip(held[sequence], (length, 1, max(0, start + length - max(start, n - loss))), strict=True)]
    most = np.array(list(held.values())).max(axis=0)
    assert [most[0], most[2]] == [limits.tokens, limits.loss_tokens] and most[1] <= limits.segments  # tokens and loss bind somewhere
    assert sum(n for n, _ in sizes) == sum(x[2] for x in placed) >= 0.99 * 1024 * len(held)


@pytest.mark.parametrize("sizes", [[3] * 20_000, [1] * 5_000, [100] * 3_000, [1023] * 300, [1, 1, 2, 3, 5000] * 500, [1025, 3] * 400, [2] * 700])
def test_documents_of_any_sizes_are_padded_little(sizes):
    """All but the last few sequences of a partition are full, whatever the sizes."""
    limits = packing.DOCUMENT_LIMITS
    placed = packing.place([(n, packing.loss_tokens(n, packing.DOCUMENT_PROMPT)) for n in sizes], limits)
    held = collections.Counter()
    for _, _, length, sequence, _ in placed:
        held[sequence] += length
    assert sum(held.values()) == sum(sizes)
    short = [n for n in held.values() if n < limits.tokens]
    assert len(short) <= 2 or sum(sizes) >= 0.99 * limits.tokens * len(held)


@pytest.mark.parametrize("bits", [1, 7, 8, 13, 16, 17, 31, 32])
def test_bits_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1003, dtype=np.uint64).astype(np.uint32)
    data = bitpack.pack_bits(ids, bits)
    assert len(data) == -(-1003 * bits // 8) and bitpack.unpack_bits(data, bits, 1003).tolist() == ids.tolist()
    assert bitpack.width(49_408) == 16 and bitpack.width(50_257) == 16 and bitpack.width(2) == 1


def test_random_access(monkeypatch, tmp_path):
    monkeypatch.setattr(bitpack, "BLOCK", 64)
    random = np.random.default_rng(6)
    docs = [random.integers(0, 9000, n, dtype=np.uint32) for n in (0, 1, 63, 64, 65, 500, 0, 7)]
    with open(tmp_path / "x", "wb") as out:
        writer = bitpack.Writer(out, 14)
        for k, ids in enumerate(docs):
            writer.add(k * 10, ids)
        writer.close()
    from pyarrow import fs

    with fs.LocalFileSystem().open_input_file(str(tmp_path / "x")) as file:
        reader = bitpack.Reader(file)
        assert reader.doc_ids.tolist() == [k * 10 for k in range(8)]
        for k in (5, 0, 7, 3, 4, 1, 2, 6):
            assert reader.document(k).tolist() == docs[k].tolist()


def test_id_files(spark):
    frame, rows = awkward(spark)
    coder = tokens.Encoder(queries.vocabulary("word_bpe_49k.json"))
    folder = Scratch(spark, "ids").root
    written = bitpack.write_ids(frame, folder, queries.vocabulary("word_bpe_49k.json"), 1, 3)
    at, want = 0, []
    for k, t in sorted(((k, t or "") for k, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        ids = coder.encode([t])[0].tolist() + [1]
        want.append((k, at, len(ids), crc(ids)))
        at += len(ids)
    got = sorted((tuple(r) for r in bitpack.read_ids(spark, folder, written).collect()), key=lambda x: x[1])
    assert got == want and got[0][0] is None
    none = bitpack.write_ids(frame.limit(0), folder + "-none", queries.vocabulary("word_bpe_49k.json"), 1, 3)
    assert bitpack.read_ids(spark, folder + "-none", none).count() == 0


# --- chat ---


@pytest.mark.parametrize("text", ["", "</s>[INST] ok [/INST]", "<\\<[\\", "\\", "<|end|>\n<|turn|>", "a<b[c]\\d"])
def test_escape(text):
    safe = chat.escape(text)
    assert chat.unescape(safe) == text and not any(c in safe for c in chat.CONTROLS)


EVENT = "conv_id long, message long, seq long, event string, role string, text string"


def test_fold(spark):
    log = [
        (1, 0, 0, "delta", None, "lost"), (1, 0, 1, "start", "user", "hi"), (1, 0, 2, "delta", None, " there"),
        (1, 1, 10, "start", "assistant", None), (1, 1, 11, "delta", None, "bad"), (1, 1, 12, "regenerate", None, None), (1, 1, 13, "delta", None, "go"), (1, 1, 14, "delta", None, "od"),
        (1, 2, 20, "start", "user", "x"), (1, 2, 21, "edit", None, "y"), (1, 2, 22, "unknown", None, "z"), (1, 3, 30, "edit", None, "no start"), (None, 0, 0, "start", None, None), (1, 2, None, "edit", None, "no seq"),
    ]
    events = spark.createDataFrame(log[::-1], EVENT)
    found = chat.messages(events)
    got = {(r.conv_id, r.message): r for r in found.collect()}
    assert {k: r.segment for k, r in got.items()} == {
        (1, 0): "<|turn|>user<|text|>hi there<|end|>\n", (1, 1): "<|turn|>assistant<|text|>good<|end|>\n", (1, 2): "<|turn|>user<|text|>y<|end|>\n", (None, 0): "<|turn|><|text|><|end|>\n",
    }
    assert got[1, 1].segment[got[1, 1].loss_from : got[1, 1].loss_to] == "good"
    report = {r.conv_id: r for r in chat.report(found).collect()}
    assert report[1].n_turns == 3 and report[1].loss_chars == 4 and report[1].loss_sha256 == hashlib.sha256(b"good").hexdigest()
    assert report[1].turns_sha256 == hashlib.sha256(b"user\nhi there\nassistant\ngood\nuser\ny\n").hexdigest()
    assert chat.report(chat.messages(events.limit(0))).count() == 0


def plain_fold(log):
    """Every conversation's messages in order, event by event."""
    out = {}
    for conv in {e[0] for e in log}:
        alive = {}
        for _, message, seq, event, role, text in sorted({e for e in log if e[0] == conv}, key=lambda e: (e[2], e[3], e[5] or "")):
            if event == "start" and message not in alive:
                alive[message] = [seq, role or "", text or ""]
            elif message in alive and event == "delta":
                alive[message][2] += text or ""
            elif message in alive and event == "edit":
                alive[message][2] = text or ""
            elif message in alive and event == "regenerate":
                alive = {k: v for k, v in alive.items() if v[0] <= alive[message][0]}
                alive[message][2] = ""
        out[conv] = [(v[1], v[2]) for v in sorted(alive.values())]
    return out


def test_fold_of_random_logs(spark):
    """Edits of earlier messages, regenerations that take back later ones, any order of delivery, repeats, clashing columns."""
    random = np.random.default_rng(17)
    log = []
    for conv in range(30):
        live, seq = [], 0
        for message in range(12):
            seq += int(random.integers(1, 5))
            log.append((conv, message, seq, "start", str(random.choice(["user", "assistant"])), f"<{message}>"))
            live.append(message)
            for _ in range(int(random.integers(0, 6))):
                seq += 1
                to = int(random.choice(live))
                kind = str(random.choice(["delta", "delta", "edit", "regenerate"], p=[0.4, 0.3, 0.2, 0.1]))
                log.append((conv, to, seq, kind, None, f"{kind}{seq}[x" * (300 if seq % 7 == 0 else 1)))
                if kind == "regenerate":
                    live = live[: live.index(to) + 1]
    want = plain_fold(log)
    twice = log + log[::3]
    events = spark.createDataFrame([twice[k] for k in random.permutation(len(twice))], EVENT).withColumns({"place": F.lit("x"), "segment": F.lit(1), "placed": F.lit(None)})
    found = collections.defaultdict(list)
    for r in chat.messages(events).collect():
        found[r.conv_id].append((r.place, r.segment))
    got = {k: [tuple(map(chat.unescape, chat._SEGMENT.fullmatch(s).groups())) for _, s in sorted(v)] for k, v in found.items()}
    assert got == want


def test_repeated_turns(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a" * 2000), (1, 0, "user", "a" * 2000), (1, 0, "assistant", "b" * 1500), (1, None, None, None)], "conv_id long, turn long, role string, text string")
    got = chat.report(chat.messages(chat.log_of(turns))).first()
    want = "\n\n" + "assistant\n" + "b" * 1500 + "\n" + ("user\n" + "a" * 2000 + "\n") * 2
    assert got.n_turns == 4 and got.turns_sha256 == hashlib.sha256(want.encode()).hexdigest()


# --- toxicity and quality ---


def test_toxicity_on_held_out_labels(spark):
    where = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in queries.op2_toxicity(spark, where).collect()}
    truth = {r.doc_id: r.toxic for r in table(spark, where, "labels").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    assert all(got[k].held_out for k in truth) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    hit = sum(got[k].predicted for k, y in truth.items() if y)
    wrong = sum(got[k].predicted for k, y in truth.items() if not y)
    assert hit >= 0.9 * sum(truth.values()) and wrong <= 0.02 * len(truth)


def test_toxicity_with_a_text_beyond_the_sample(spark, monkeypatch):
    """A labelled text that is longer than the whole sample is passed over, the others are learned."""
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 60_000)
    random = np.random.default_rng(1)
    rows = [(k, " ".join(["vile" if k % 4 == 0 else "kind", *random.choice(WORDS, 15)])) for k in range(400)]
    rows = [(k, t + " pad" * 40_000 if k in (1, 5, 9) else t) for k, t in rows]
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(400)], "doc_id long, quality int, toxic int")
    got = toxicity.score(documents(spark, rows), labels).collect()
    wrong = [r.doc_id for r in got if r.predicted != (r.doc_id % 4 == 0) and r.doc_id not in (1, 5, 9)]
    assert len(got) == 400 and len(wrong) <= 4


def test_toxicity_misspelling_and_awkward(spark):
    random = np.random.default_rng(0)
    texts = [" ".join(random.choice(WORDS, 40)) for _ in range(400)]
    labels = [int(k % 4 == 0) for k in range(400)]
    texts = [t + " horribleword here" * y for t, y in zip(texts, labels, strict=True)]
    scorer = toxicity.Scorer(toxicity.train(texts, labels))
    s = scorer.scores([" ".join(WORDS[:40]) + x for x in (" horriblewurd here", "")] + [""])
    assert s[0] > 0.4 > 0.3 > s[1] and 0 <= s[2] <= 1
    frame, rows = awkward(spark)
    none = spark.createDataFrame([(None, 1, 1), (1, None, 1), (2, 7, None)], "doc_id long, toxic int, quality int")
    assert len({r.score for r in toxicity.score(frame, none).collect()}) == 1
    assert toxicity.score(frame.limit(0), none).count() == 0


def test_importance_on_labels(spark):
    where = "/root/testdata/sf0.1"
    kept = {r.doc_id for r in queries.op1_importance(spark, where).collect()}
    truth = {r.doc_id: r.quality for r in table(spark, where, "labels").collect()}
    good = [k for k, q in truth.items() if q == 1]
    bad = [k for k, q in truth.items() if q == 0]
    assert sum(k in kept for k in good) >= 0.99 * len(good) and sum(k in kept for k in bad) <= 0.1 * len(bad)


def test_importance_weights_equal_plain_python(monkeypatch):
    monkeypatch.setattr(importance, "BUCKETS", 1 << 22)  # so that no two n-grams of this test share one
    random = np.random.default_rng(7)
    texts = [" ".join(random.choice(WORDS[: 8 if k % 3 else 25], 50)) for k in range(300)]
    y = [1 if k % 2 == 0 and k % 3 else -1 for k in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(300), pa.int64()), pa.array(texts), pa.array(y, pa.int32()), pa.array([0] * 300, pa.int64())], ["doc_id", "text", "y", "text_hash"])
    counted = next(importance._count(iter([batch])))
    held = importance.checks(batch.column(0))
    raw, target, bags = collections.Counter(), collections.Counter(), []
    for k, t in enumerate(texts):
        w = t.split()
        bags.append(collections.Counter(w) + collections.Counter(zip(w, w[1:], strict=False)))
        raw += bags[k]
        if y[k] == 1 and not held[k]:
            target += bags[k]
    assert counted.num_rows == len(raw) and sorted(counted.column(1).to_pylist()) == sorted(raw.values())
    models = np.zeros((2, importance.BUCKETS))
    for k in (1, 2):
        models[k - 1, counted.column(0).to_numpy()] = counted.column(k).to_numpy()
    n_raw, n_target = sum(raw.values()), sum(target.values())
    want = [importance.EFFECTIVE * sum(c * np.log((target[g] / n_target / ((raw[g] + 1) / (n_raw + importance.BUCKETS)) + 1) / 2) for g, c in bag.items()) / sum(bag.values()) for bag in bags]

    class Sent:
        value = importance.ratios(*models)

    got = np.concatenate([b.column("log_weight").to_numpy() for b in importance._weigh(Sent)(iter([batch]))])
    assert np.abs(got - want).max() < 1e-9


def test_importance_parts_good_from_bad(spark):
    random = np.random.default_rng(7)
    rows = [(k, " ".join(random.choice(WORDS[: 30 if k % 3 else 400], 50))) for k in range(300)]
    labels = [(k, int(k % 3 > 0), 0) for k in range(0, 300, 2)]
    kept = {r.doc_id for r in importance.resample(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert all(k in kept for k in range(300) if k % 3) and sum(k in kept for k in range(0, 300, 3)) < 10


def test_one_labelled_id_with_many_rows(spark):
    random = np.random.default_rng(9)
    text = lambda: " ".join(random.choice(WORDS, 30))
    rows = [(0, text()) for _ in range(50)] + [(k, text() + " vile" * (k % 2)) for k in range(60)]
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(60)], "doc_id long, quality int, toxic int")
    seen = []
    real = toxicity.train
    toxicity.train = lambda texts, labels: seen.append(len(texts)) or real(texts, labels)
    try:
        assert toxicity.score(documents(spark, rows), labels).count() == len(rows)
    finally:
        toxicity.train = real
    assert seen[0] == sum(zlib.crc32(str(k).encode()) % 4 != 2 for k in range(60))
    assert importance.resample(documents(spark, rows), labels).count() <= len(rows)


def test_kth_and_awkward(spark):
    rows = [(k, r) for k, r in enumerate([5, 9, 9, 9, -3, 70_000, 70_001, -200_000])]
    frame = spark.createDataFrame(rows, "doc_id long, rank long")
    order = sorted(rows, key=lambda x: (-x[1], x[0]))
    for k in range(1, 9):
        rank, last = importance.kth(frame, k)
        assert sorted(r for r in rows if r[1] > rank or r[1] == rank and (last is None or r[0] <= last)) == sorted(order[:k])
    docs, given = awkward(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert importance.resample(docs, none).count() == len(given)
    some = spark.createDataFrame([(k, k % 2, 0) for k in range(10)], "doc_id long, quality int, toxic int")
    assert importance.resample(docs, some).count() <= len(given)
    assert importance.resample(docs.limit(0), some).count() == 0


# --- lists and leaks ---


def test_url_lists(spark):
    entries = [("l", "host", "bad.org", 1, "add", 10), ("l", "host", "bad.org", 2, "remove", 20), ("l", "host", "bad.org", 3, "add", 500), ("u", "url", "ok.org/en", 4, "add", 0), ("l", "host", None, 5, "add", 0), ("m", "host", "org", 6, "add", 900)]
    captures = [
        (1, "http://a.bad.org/x", 9), (2, "http://a.bad.org/x", 10), (3, "https://u:p@BAD.org:80?q", 19), (4, "http://bad.org", 20), (5, "http://bad.org", 800), (6, "http://notbad.org/", 800), (7, "http://ok.org/en/page", 5),
        (8, "http://ok.org/english", 5), (9, None, 5), (10, "", 5), (11, "http://bad.org", None), (12, "nonsense", 5), (13, "http://ok.org/en#x", 950), (14, "http://1.2.3.4/", 950), (1, "http://a.bad.org/x", 9),
    ]
    e = spark.createDataFrame(entries, "list_name string, kind string, pattern string, entry_id long, action string, day int")
    c = spark.createDataFrame(captures, "capture_id long, url string, day int")
    got = {r.capture_id: r.entry_id for r in urlfilter.verdicts(c, urlfilter.intervals(e)).collect()}
    assert got == {1: None, 2: 1, 3: 1, 4: None, 5: 3, 6: None, 7: 4, 8: None, 9: None, 10: None, 11: None, 12: None, 13: 4, 14: None}
    assert urlfilter.verdicts(c.limit(0), urlfilter.intervals(e)).count() == 0
    assert urlfilter.verdicts(c, urlfilter.intervals(e.limit(0))).where("blocked").count() == 0


def test_url_lists_of_any_days(spark):
    """Outlying days, long and very long intervals, long histories, clashing names, against a plain loop."""
    random = np.random.default_rng(11)
    far = [-2_000_000_000, -5000, 0, 1, 63, 64, 255, 256, 257, 5000, 2_000_000_000]
    entries, n = [], 0
    for pattern in ("a.org", "b.a.org", "c.org", "d.net"):
        days = sorted(random.choice(far + random.integers(0, 4000, 30).tolist(), 12, replace=False).tolist())
        for k, day in enumerate(days):
            entries.append(("l", "host", pattern, n, "remove" if k % 2 else "add", int(day)))
            n += 1
    captures = [(k, f"http://{h}/x", int(d)) for k, (h, d) in enumerate((h, d) for h in ("a.org", "z.b.a.org", "c.org", "d.net", "e.net") for d in far + random.integers(0, 4000, 40).tolist())]
    captures.append((10_000, "http://c.org/" + "p/" * 400 + "x" * 20_000, 100))
    e = spark.createDataFrame(entries, "list_name string, kind string, pattern string, entry_id long, action string, day int").withColumn("bucket", F.lit("x"))
    c = spark.createDataFrame(captures, "capture_id long, url string, day int").withColumns({"host": F.lit(1), "width": F.lit("y"), "pattern": F.lit(None)})
    want = {}
    for k, url, day in captures:
        host, best = url.split("/")[2], None
        for name in {x[2] for x in entries}:
            last = [x for x in entries if x[2] == name and x[5] <= day][-1:]
            if (host == name or host.endswith("." + name)) and last and last[0][4] == "add" and (best is None or len(name) > len(best[2])):
                best = last[0]
        want[k] = best and best[3]
    got = {r.capture_id: r.entry_id for r in urlfilter.verdicts(c, urlfilter.intervals(e)).collect()}
    assert got == want and sum(v is not None for v in want.values()) > 50


def test_url_lists_of_very_long_urls(spark):
    """Prefixes are cut at listed depths only, so a URL of 12,000 slashes costs what its length costs."""
    entries = [("u", "url", "ok.org/a/b", 1, "add", 0), ("u", "url", "ok.org", 2, "add", 0), ("l", "host", "org", 3, "add", 0), ("u", "url", "ok.org/a/b/c/d", 4, "add", 0)]
    e = spark.createDataFrame(entries, "list_name string, kind string, pattern string, entry_id long, action string, day int")
    long = "http://ok.org/a/b" + "/x" * 12_000
    captures = [(1, long, 5), (2, "http://ok.org/a/bc" + "/" * 30_000, 5), (3, "http://" + "z." * 5_000 + "org/", 5), (4, "http://10.0.0.1/ok.org", 5), (5, long + "?q", 5)]
    c = spark.createDataFrame(captures * 3, "capture_id long, url string, day int")
    began = time.time()
    got = urlfilter.verdicts(c, urlfilter.intervals(e)).collect()
    assert len(got) == 5 and {r.capture_id: r.entry_id for r in got} == {1: 1, 2: 2, 3: 3, 4: None, 5: 1}
    assert {r.capture_id: r.url for r in got} == {k: u for k, u, _ in captures} and time.time() - began < 30


def test_leaks_of_one_id_with_several_texts(spark):
    one = "Find the greatest sum that two trains carry over the old bridge near the small town"
    two = "Which of all rivers in the northern part of the land runs longest before it meets the sea"
    bench = spark.createDataFrame([(1, one), (1, two), (1, two), (2, None), (None, one)], "item_id long, text string")
    rows = [(1, "so " + one), (2, "so " + two + " and"), (3, "nothing of the kind is here at all, whatever one looks for in it")]
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(documents(spark, rows), bench).collect()} == {(1, 1), (2, 1)}


def test_leaks_with_equal_new_values(spark):
    """Different values may become the same one; one value mustn't become two."""
    item = "A farmer sells 12 hens to a man and 15 ducks to a woman before buying 7 goats for the old barn behind the hill"
    put = lambda *v: item.replace("12", v[0]).replace("15", v[1]).replace(" 7 ", f" {v[2]} ")
    rows = [(1, put("5", "5", "8")), (2, put("5", "5", "5")), (3, put("5", "6", "8"))]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.leaks(documents(spark, rows), bench).collect()} == {1, 2, 3}


def test_leaks(spark):
    item = "A train leaves the old station at 12 km per hour and Anna waits 12 minutes for the next Anna train"
    other = "Completely different words stand in this second question about rivers and mountains today"
    changed = item.replace("12", "15").replace("Anna", "Berta")
    broken = item.replace("12 km", "15 km")
    filler = "some filler words that stand in front of it, "
    rows = [(1, filler + item + " and more"), (2, changed), (3, broken), (4, filler), (5, None), (6, ""), (7, "x " * 5000 + other.upper()), (None, item), (8, item), (8, item), (9, item[:40])]
    bench = spark.createDataFrame([(1, item, 1), (2, other, 1), (3, None, 1), (4, "", 1), (5, "tiny", 1)], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(documents(spark, rows), bench).collect()}
    assert set(got) == {(1, 1), (2, 1), (7, 2), (8, 1)}
    assert got[1, 1].changed_slots == 0 and got[2, 1].changed_slots >= 2
    assert decontaminate.leaks(documents(spark, []), bench).count() == 0
    assert decontaminate.leaks(documents(spark, rows), bench.limit(0)).count() == 0


def reparameterised(random, n):
    """(item, the same question with other values, one with inconsistent values) n times, with repeated numbers and names."""
    firsts, lasts = "Anna Berta Carla Doris Emil Fritz Gerda Hanno Ilse Jonas".split(), "Smith Brown Miller Jones Adams Weber".split()
    number = lambda: str(random.choice([f"{random.integers(2, 99)}", f"{random.integers(1, 9)},{random.integers(100, 999)}", f"{random.integers(1, 50)}.{random.integers(1, 9)}"]))
    names = [" ".join(x) for x in (*((f,) for f in firsts), *((f, s) for f in firsts for s in lasts))]
    for _ in range(n):
        words = [f"q{random.integers(10**5)}" for _ in range(int(random.integers(14, 30)))]
        at = sorted(random.choice(len(words), int(random.integers(2, 5)), replace=False).tolist())
        kinds = [int(random.integers(3)) for _ in at]  # 0, 1: a number or name that may occur again; 2: km after a number
        slots = [k if random.random() < 0.3 else 10 + i for i, k in enumerate(kinds)]

        def filled(values, words=words, at=at, kinds=kinds, slots=slots):
            out = list(words)
            for i, k, slot in zip(at, kinds, slots, strict=True):
                v = values[slot, k % 2]
                out[i] = f"{v} km" if k == 2 else v
            return " ".join(out) + "."

        keys = {(s, k % 2) for s, k in zip(slots, kinds, strict=True)}
        one, two = ({}, {})
        for key in sorted(keys):
            make = number if key[1] == 0 else lambda: str(names[random.integers(len(names))])
            for values in (one, two):
                values[key] = make()
                while values[key] in [v for k, v in values.items() if k != key]:
                    values[key] = make()
        yield filled(one), filled(two)


def test_leaks_of_reparameterised_items(spark):
    """Recall over generated questions with other numbers (of any form), units and names (of any length)."""
    random = np.random.default_rng(21)
    pairs = list(reparameterised(random, 300))
    filler = lambda: " ".join(f"z{random.integers(10**6)}" for _ in range(25))
    rows = [(k, f"{filler()} {other} {filler()}") for k, (_, other) in enumerate(pairs)] + [(1000 + k, f"{filler()}. {item}") for k, (item, _) in enumerate(pairs)]
    rows += [(5000 + k, filler() + " 12 km with Anna Smith and 1,200 more " + filler()) for k in range(200)]
    bench = spark.createDataFrame([(k, item) for k, (item, _) in enumerate(pairs)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(documents(spark, rows), bench).collect()}
    assert all(a % 1000 == b and a < 5000 for a, b in got)
    assert sum(a >= 1000 for a, _ in got) == 300
    assert sum(a < 1000 for a, _ in got) >= 0.95 * 300


def test_value_tokens(spark):
    text = "The price of 1,200.50 km, John Smith Brown paid. Anna's 3rd try: NASA and McDonald. 1,2,3 x"
    got = spark.range(1).select(decontaminate.value_tokens(F.lit(text)).alias("v")).first().v
    assert got == ["the", "price", "of", "1\x03200\x0250", "km", "\x01mjohn\x01msmith\x01mbrown", "paid", "\x01manna", "s", "3", "rd", "try", "nasa", "and", "\x01mmcdonald", "1\x032\x033", "x"]


def test_leaks_with_clashing_columns(spark):
    item = "Find the greatest sum that two trains carry over the old bridge near the small town"
    docs = spark.createDataFrame([(1, item, "x", 7, None)], "doc_id long, text string, item_id string, at int, width int")
    bench = spark.createDataFrame([(1, item, 5, "y")], "item_id long, text string, doc_id int, h string")
    assert decontaminate.leaks(docs, bench).count() == 1


def test_leaks_of_items_with_many_numbers(spark):
    item = "Find the mean of the numbers 3, 7, 8, 12, 15, 18, 21, 24."
    other = "Find the mean of the numbers 4, 9, 2, 11, 16, 19, 22, 25."
    rows = [(1, item), (2, "so, " + item + " and more"), (3, other), (4, "Find the mean of the numbers 3, 7 and then stop reading here"), (5, "1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15")]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.leaks(documents(spark, rows), bench).collect()}
    assert set(got) == {1, 2, 3} and got[1].changed_slots == 0 and got[3].changed_slots == 8


def test_leaks_with_conflicts_outside_the_copy(spark):
    item = "Every morning 12 buses leave the depot and each of them carries many people to the city, where 12 shops open and 30 clerks wait for them"
    part = item[: item.index(", where")]
    rows = [(1, part + " until 15 trams come and 12 drivers rest"), (2, item.replace("12 shops", "15 shops")), (3, part.replace("12", "40") + " until 15 trams come")]
    rows += [(4, item.replace("12 buses leave the depot and", "15 buses leave a depot but").replace("the city, where 12 shops", "a city, where 12 shops"))]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.leaks(documents(spark, rows), bench).collect()} == {1, 2, 3}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, sf, name):
    assert same(spark, sf, queries.queries()[name], queries.oracle_sql()[name])
