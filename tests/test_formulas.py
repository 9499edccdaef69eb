"""Entities, half precision, moments and projections against other programs."""

from __future__ import annotations

import html
from html.entities import html5

import numpy as np
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.functions import vectors as V
from gleaner.operators import pca


def test_all_entities(spark):
    """Every named character, with and without its semicolon, and numbers of all kinds, as Python's own function replaces them."""
    cases = [f"a&{n}b" for n in html5] + [f"&{n}" for n in html5] + [f"x &{n.rstrip(';')} y" for n in html5]
    cases += [f"&#{k};" for k in [*range(300), 0xD800, 0xDFFF, 0xFDD0, 0xFFFE, 0x1FFFF, 0x10FFFF, 0x110000, 10**12, 8364]] + [f"&#x{k:x}" for k in [*range(300), 0x1F600, 0xFFFFFFFF, 0x110000]]
    cases += ["&", "&&", "& b", "&;", "&#;", "&#x;", "&#xg", "&notit;", "&notin;", "&ampamp;", "&amp;lt;", "a&b;c", "", "&" + "x" * 50 + ";", "&#0000000000000065;", "&#X41", "&eacute;&#8212;&#x27;"]
    got = spark.createDataFrame([(c,) for c in cases], "a string").select("a", T.unescaped(F.col("a")).alias("b")).collect()
    assert [(r.a, r.b) for r in got if r.b != html.unescape(r.a)] == [] and len(got) == len(cases)
    assert spark.createDataFrame([(None,)], "a string").select(T.unescaped(F.col("a")).alias("b")).first().b is None


def test_half_precision(spark):
    random = np.random.default_rng(0)
    x = np.concatenate([2.0 ** np.arange(-26, 17), random.random(2000) * 2.0 ** random.integers(-26, 17, 2000), [65504, 65519.9, 65520, 1 + 2**-11, 1 + 3 * 2**-11, 0.1, 1e-8]])
    got = [r.h for r in spark.createDataFrame([(float(v),) for v in x], "x double").select(V.half(F.col("x")).alias("h")).collect()]
    with np.errstate(over="ignore"):
        assert got == x.astype(np.float16).astype(float).tolist()


def test_moments_and_projection(spark):
    """All covariances over several partitions, and projections up to each axis's sign."""
    random = np.random.default_rng(5)
    x = (random.normal(size=(600, 12)) @ random.normal(size=(12, 12)) + 1000).astype(np.float32).astype(float)
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "passage_id long, v array<double>").repartition(5)
    cov = np.zeros((12, 12))
    for r in pca.covariances(rows).collect():
        cov[r.i, r.j] = r.covariance
        assert abs(r.mean - x[:, r.i].mean()) < 1e-9
    assert np.allclose(cov, np.cov(x.T, bias=True), atol=1e-8)
    model = pca.fit(rows, 4)
    _, _, axes = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    want = (x - x.mean(axis=0)) @ axes[:4].T
    want /= np.linalg.norm(want, axis=1, keepdims=True) + 1e-9
    got = np.array([r.v for r in pca.project(rows, model).orderBy("passage_id").collect()])
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-6)
    s = np.linalg.svd(x - x.mean(axis=0), compute_uv=False) ** 2
    assert abs(model.kept - s[:4].sum() / s.sum()) < 1e-9
    assert pca.covariances(rows.limit(0)).count() == 0
