"""The corpus pipeline, stage by stage, against brute force on a small table with planted cases."""

from __future__ import annotations

import numpy as np

import corpus_pipeline as P
from tests.llm.test_operators import brute_components, documents

WHERE = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{WHERE}/documents.parquet")
    columns = docs.columns
    bench = {r.text for r in spark.read.parquet(f"{WHERE}/benchmark.parquet").collect()}
    for name, stage in P.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stage(spark, docs, WHERE).cache()
        after = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == columns and set(after) <= set(before)
        if name == "near_duplicates":
            assert set(after) == {k for k, (_, c) in brute_components(list(before.items())).items() if c == k}
        if name == "benchmark_leaks":
            assert all(k not in after for k, t in before.items() if any(b in t for b in bench))
            assert len(after) >= len(before) - 60
        if name == "repeated_passages":
            assert set(after) == set(before) and sum(map(len, after.values())) < sum(map(len, before.values()))
    pieces = P.STAGES[-1][1](spark, docs, WHERE).collect()
    assert {p.doc_id for p in pieces} == set(after)


def test_planted(spark):
    random = np.random.default_rng(0)
    text = lambda n: " ".join(f"w{k}" for k in random.integers(0, 5000, n))
    passage = text(80)
    rows = [(1, text(90)), (2, None), (3, text(50) + " " + passage), (4, passage + " " + text(50)), (5, text(90))]
    rows += [(6, rows[0][1]), (7, rows[0][1] + " extra")]
    docs = documents(spark, rows)
    near = {r.doc_id for r in P.near_duplicates(spark, docs, WHERE).collect()}
    assert near == {1, 2, 3, 4, 5}
    cut = {r.doc_id: r for r in P.repeated_passages(spark, docs.where("doc_id in (3, 4, 5)"), WHERE).collect()}
    assert len(cut[3].text) < len(rows[2][1]) - 300 and cut[5].text == rows[4][1] and cut[3].n_chars == len(cut[3].text)


def test_run(spark):
    assert P.run(spark, "/root/testdata/sf0.001").count() > 0


def test_stages_on_awkward_tables(spark):
    """Nulls in any column, empty and long texts, repeated rows and ids, clashing extra columns, empty tables."""
    from pyspark.sql import functions as F

    from tests.llm.test_operators import DOC

    random = np.random.default_rng(4)
    text = lambda n: " ".join(f"w{k}" for k in random.integers(0, 5000, n))
    a, c = text(60), text(60)
    item = next(r.text for r in spark.read.parquet(f"{WHERE}/benchmark.parquet").collect())
    rows = [(1, a), (1, a), (1, c), (2, a + " x"), (None, a), (None, None), (None, item), (3, None), (4, ""), (4, ""), (5, " \n"), (6, text(20_000)), (7, c + " y"), (8, item), (9, "short one")]
    frame = spark.createDataFrame([(k, t, None, None, None) for k, t in rows], DOC)
    for name in ("text_hash", "c0", "th", "rep", "item_id", "part", "y"):
        frame = frame.withColumn(name, F.lit("z"))
    docs = {name: stage(spark, frame, WHERE) for name, stage in P.STAGES[:-1]}
    assert all(d.columns == frame.columns for d in docs.values())
    # Order by what a row says, for nulls.
    got = {name: sorted(((r.doc_id, r.text) for r in d.collect()), key=str) for name, d in docs.items()}
    assert set(got["quality"]) <= set(rows)
    assert got["near_duplicates"] == sorted(rows[1:3] + rows[4:12] + rows[13:], key=str)
    assert got["benchmark_leaks"] == sorted([x for x in rows if x[1] != item], key=str)
    assert [k for k, _ in got["repeated_passages"]] and len(got["repeated_passages"]) == len(rows)
    assert P.STAGES[-1][1](spark, frame, WHERE).where("doc_id is null").count() >= 3
    for _, stage in P.STAGES:
        assert stage(spark, frame.limit(0), WHERE).count() == 0
