"""The archive source, raw matrices, the batched encoder and two-part questions."""

from __future__ import annotations

import json
from math import erf

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.functions import models as M
from gleaner.functions import text as T
from gleaner.sources import formats as S


@pytest.mark.parametrize("size", [97, 200, 100_000])
def test_archive_ranges(spark, tmp_path, size):
    """Every entry is read once, wherever the ranges cut: redirects and other types are skipped, broken UTF-8 is replaced."""
    random = np.random.default_rng(0)
    want, lines = [], []
    for k in range(60):
        entry = {"path": f"p{k}", "title": f"T{k}", "mimetype": ["text/html", "text/html; charset=utf-8", "image/png"][k % 3], "redirect": k % 7 == 0, "html": "x" * int(random.integers(0, 120))}
        lines.append(json.dumps(entry).encode())
        if k % 3 < 2 and k % 7:
            want.append((f"p{k}", f"T{k}", entry["html"]))
    lines.insert(30, b'{"path": "bad", "title": "\xff", "mimetype": "text/html", "html": "\xc3"}')
    lines.insert(40, b"")
    want.append(("bad", "�", "�"))
    (tmp_path / "one.jsonl").write_bytes(b"\n".join(lines[:50]))
    (tmp_path / "two.jsonl").write_bytes(b"\n".join(lines[50:]) + b"\n")
    (tmp_path / "empty.jsonl").write_bytes(b"")
    S.register_archive(spark)
    rows = spark.read.format("page_archive").option("rangeBytes", size).load(str(tmp_path))
    assert sorted(map(tuple, rows.collect())) == sorted(want)
    if size == 200:
        assert rows.rdd.getNumPartitions() > 20
    images = spark.read.format("page_archive").option("type", "image/").load(str(tmp_path))
    assert {r.path for r in images.collect()} == {f"p{k}" for k in range(60) if k % 3 == 2 and k % 7}


def test_matrices_are_numbered_over_files(spark, tmp_path):
    x = np.arange(30, dtype="<f4").reshape(10, 3)
    (tmp_path / "a.f32").write_bytes(x[:4].tobytes() + b"123")
    (tmp_path / "b.f32").write_bytes(x[4:].tobytes())
    got = [(r.row, r.v) for r in S.read_matrix(spark, str(tmp_path), 3).orderBy("row").collect()]
    assert got == list(enumerate(x.tolist()))
    assert [r.row for r in S.read_matrix(spark, str(tmp_path), 3, most=6).orderBy("row").collect()] == list(range(6))


def weights(d=8, heads=2, layers=2, vocabulary=30, positions=40):
    rng, w = np.random.default_rng(0), {}
    for name, shape in {"word": (vocabulary, d), "position": (positions, d), "token_type": (2, d)}.items():
        w[f"embeddings.{name}_embeddings.weight"] = rng.normal(size=shape)
    sizes = {**{f"attention.{n}": (d, d) for n in ("self.query", "self.key", "self.value", "output.dense")}, "intermediate.dense": (2 * d, d), "output.dense": (d, 2 * d)}
    norms = ["embeddings.LayerNorm"]
    for k in range(layers):
        for n, s in sizes.items():
            w[f"encoder.layer.{k}.{n}.weight"], w[f"encoder.layer.{k}.{n}.bias"] = rng.normal(size=s), rng.normal(size=s[0])
        norms += [f"encoder.layer.{k}.attention.output.LayerNorm", f"encoder.layer.{k}.output.LayerNorm"]
    for n in norms:
        w[f"{n}.weight"], w[f"{n}.bias"] = rng.normal(size=d), rng.normal(size=d)
    return w


def test_encoder_equals_single_sequences(spark):
    """Padded groups of similar length give what each sequence gives alone, pooled over all its positions."""
    w, random = weights(), np.random.default_rng(1)
    lists = [random.integers(0, 30, int(random.integers(1, 40))).tolist() for _ in range(120)] + [[], None]
    rows = spark.createDataFrame(list(enumerate(lists)), "passage_id long, ids array<int>").repartition(3)
    got = {r.passage_id: r.v for r in M.encode(rows, w, 2, 2, most=100).collect()}
    for k, ids in enumerate(lists):
        if not ids:
            assert got[k] is None
            continue
        want = M.transformer(np.array(ids), np.zeros(len(ids), int), w, 2, 2).mean(axis=0)
        assert np.allclose(got[k], want / (np.linalg.norm(want) + 1e-9), atol=1e-9)


def test_tiny_model_by_hand():
    """One layer, one head, two dimensions, computed step by step with plain numbers."""
    eye = [[1.0, 0.0], [0.0, 1.0]]
    w = {"embeddings.word_embeddings.weight": np.array([[1.0, 3.0], [2.0, 0.0]]), "embeddings.position_embeddings.weight": np.zeros((2, 2)), "embeddings.token_type_embeddings.weight": np.zeros((2, 2))}
    for n in ("attention.self.query", "attention.self.key", "attention.self.value", "attention.output.dense", "intermediate.dense", "output.dense"):
        w[f"encoder.layer.0.{n}.weight"], w[f"encoder.layer.0.{n}.bias"] = np.array(eye), np.zeros(2)
    for n in ("embeddings.LayerNorm", "encoder.layer.0.attention.output.LayerNorm", "encoder.layer.0.output.LayerNorm"):
        w[f"{n}.weight"], w[f"{n}.bias"] = np.ones(2), np.zeros(2)
    unit = lambda a, b: (lambda m: [(a - m) / (((a - m) ** 2 + (b - m) ** 2) / 2 + 1e-12) ** 0.5, (b - m) / (((a - m) ** 2 + (b - m) ** 2) / 2 + 1e-12) ** 0.5])((a + b) / 2)
    x = [unit(1.0, 3.0), unit(2.0, 0.0)]  # (-1, 1) and (1, -1)
    out = []
    for q in x:
        score = [np.exp((q[0] * k[0] + q[1] * k[1]) / 2**0.5) for k in x]
        mixed = [sum(s * v[c] for s, v in zip(score, x)) / sum(score) for c in range(2)]
        h = unit(q[0] + mixed[0], q[1] + mixed[1])
        gelu = [0.5 * v * (1 + erf(v / 2**0.5)) for v in h]
        out.append(unit(h[0] + gelu[0], h[1] + gelu[1]))
    got = M.transformer_batch(np.array([[0, 1]]), np.zeros((1, 2), int), np.ones((1, 2), bool), w, 1, 1)
    assert np.allclose(got[0], out, atol=1e-9)


def test_length_groups():
    sizes = np.array([5, 1, 9, 3, 3, 40, 2])
    groups = M.length_groups(sizes, 12)
    assert sorted(np.concatenate(groups).tolist()) == list(range(7))
    assert all(len(g) == 1 or len(g) * sizes[g].max() <= 12 for g in groups)


@pytest.mark.parametrize("text,want", [("what is it? and who rules there?", "who rules there?"), ("one?", None), ("one? , And two two", "two two"), ("no mark", None), ("a? b? c d e f", "b? c d e f"), ("a?\n\nsand castles", "sand castles")])
def test_second_question(spark, text, want):
    assert spark.createDataFrame([(text,)], "a string").select(T.second_question(F.col("a")).alias("b")).first().b == want
