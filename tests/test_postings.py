"""Posting codec and word pieces against plain programs and the tokenizers library."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from gleaner.config import RetrievalConfig
from gleaner.operators import lexical as L
from gleaner.operators import postings as P
from gleaner.operators import wordpiece as W
from gleaner.plans import registry


def plain_varints(values):
    out = bytearray()
    for v in values:
        while v >= 128:
            out.append(v % 128 + 128)
            v //= 128
        out.append(v)
    return bytes(out)


def test_varints():
    random = np.random.default_rng(0)
    values = np.concatenate([np.arange(300), [(1 << k) + d for k in range(7, 62) for d in (-1, 0, 1)], (random.random(2000) * 2.0 ** random.integers(1, 60, 2000)).astype(np.int64)])
    data = P.encoded(values)
    assert data.tobytes() == plain_varints(values.tolist())
    assert P.decoded(data).tolist() == values.tolist()
    assert len(P.encoded(values[:0])) == 0 and len(P.decoded(np.zeros(0, np.uint8))) == 0


def small_index(spark):
    random = np.random.default_rng(1)
    rows = [(int(p), f"t{t}", int(random.integers(1, 400)), 500 + int(p) % 7) for t in range(40) for p in random.choice(5_000, int(random.integers(1, 900)), replace=False) * (1 << 20)]
    tf = spark.createDataFrame(rows, "passage_id long, term string, tf long, doclen long")
    lengths = tf.groupBy("passage_id").agg(F.max("doclen").alias("doclen"))
    stats = lengths.agg(F.count("*").alias("n"), F.avg("doclen").alias("avgdl"))
    return rows, L.Index(tf, lengths, L.document_frequencies(tf), stats)


def test_blocks_give_all_postings_back(spark, tmp_path):
    """Blocks of several sizes, terms over the cap left out, and BM25 equal to that of the plain relation."""
    rows, index = small_index(spark)
    config = RetrievalConfig(df_cap_floor=300, df_cap_share=0.05)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")  # blocks go on over batches
    try:
        blocks = P.write_blocks(index, f"file://{tmp_path}/blocks", config)
        got = sorted(map(tuple, P.read_blocks(blocks).select("passage_id", "term", "tf", "doclen").collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    df = {}
    for _, t, _, _ in rows:
        df[t] = df.get(t, 0) + 1
    kept = {t for t, n in df.items() if n <= 300}
    assert 5 < len(kept) < 40
    assert got == sorted(r for r in rows if r[1] in kept)
    assert blocks.groupBy("term").count().agg(F.max("count")).first()[0] > 1  # several blocks of one term
    ends = blocks.select("term", "block", "first_id", "last_id").collect()
    assert all(b.block * P.SPAN <= b.first_id <= b.last_id < (b.block + 1) * P.SPAN for b in ends)
    asked = spark.createDataFrame([(q, t, 1.0) for q, t in [(1, "t0"), (1, "t1"), (2, "t2"), (2, "none"), (3, "t3"), (3, "t4")] if t in kept or t == "none"], "question_id long, term string, weight double")
    one = {(r.question_id, r.passage_id): round(r.lexical, 9) for r in P.bm25(asked, blocks, index).collect()}
    two = {(r.question_id, r.passage_id): round(r.lexical, 9) for r in L.bm25(asked, index).collect()}
    assert one == two and one


def test_pieces_equal_the_library(spark):
    from tokenizers import models

    import public_tokenizers

    pieces = W.vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    library = models.WordPiece({p: k for k, p in enumerate(pieces)}, unk_token=W.UNKNOWN, max_input_chars_per_word=W.LONGEST)
    random = np.random.default_rng(2)
    letters = list("abcdefghijklmnopqrstuvwxyz0123456789'é漢🙂")
    words = ["unaffable", "internationalization", "漢", "🙂", "a" * 100, "a" * 101, "\x7f"] + ["".join(random.choice(letters, int(random.integers(1, 25)))) for _ in range(2000)]
    got = {r.term: r.pieces for r in W.term_pieces(spark.createDataFrame([(w,) for w in words], "term string"), pieces).collect()}
    assert got == {w: [t.value for t in library.tokenize(w)] for w in words}


def test_piece_frequencies(spark):
    index = L.Index.of(spark.createDataFrame([(1, "aab", 2), (1, "b", 1), (2, "zzz", 3)], "passage_id long, term string, tf long"))
    cut = W.term_pieces(index.dfs, ["a", "##a", "##b", "b", W.UNKNOWN])
    got = {tuple(r) for r in W.piece_frequencies(index, cut).collect()}
    assert got == {(1, "a", 2), (1, "##a", 2), (1, "##b", 2), (1, "b", 1), (2, W.UNKNOWN, 3)}


def test_pieces_are_counted_where_terms_are_read(spark, tmp_path, monkeypatch):
    """The index over pieces shuffles no postings, and its scores no pairs; it equals that of the join, however the terms are cut into chunks."""
    random = np.random.default_rng(4)
    text = [" ".join("".join(random.choice(list("abcz"), int(random.integers(1, 6)))) for _ in range(int(random.integers(1, 40)))) for _ in range(300)]
    rows = spark.createDataFrame([(p, t) for p, t in enumerate(text)] + [(0, "abc c"), (301, "z" * 101), (302, ""), (None, "ab")], "passage_id long, text string").repartition(3)
    index, pieces = L.Index.build(rows, f"file://{tmp_path}/index"), ["a", "##a", "##b", "b", "ab", "##c", "c", "##abc"]
    cut = W.term_pieces(index.dfs, [*pieces, W.UNKNOWN])
    tf = W.piece_frequencies(index, cut)
    key = lambda df: sorted(map(str, (tuple(r[c] for c in ("passage_id", "term", "tf", "doclen")) for r in df.collect())))
    want = key(tf.join(tf.groupBy(F.col("passage_id").alias("p")).agg(F.sum("tf").alias("doclen")), F.col("passage_id").eqNullSafe(F.col("p"))))
    plans, writer = [], type(rows.write)
    real = writer.parquet
    monkeypatch.setattr(writer, "parquet", lambda self, *a, **k: plans.append(self._df._jdf.queryExecution().executedPlan().toString()) or real(self, *a, **k))
    found = W.piece_index(index, pieces, f"file://{tmp_path}/pieces")
    assert len(plans) == 3 and not any("hashpartitioning(passage_id" in p for p in plans)
    assert key(found.tf) == want and any(W.UNKNOWN in r for r in want)
    assert "Exchange" not in found.tf._jdf.queryExecution().executedPlan().toString()
    assert found.dfs.count() == tf.select("term").distinct().count() and found.stats.first().n == found.lengths.count() == 302
    monkeypatch.setattr(W, "CHUNK", 3)
    monkeypatch.setattr(W, "KEPT", 50)  # kept terms are forgotten and cut again
    batch = [b for b in index.bags.select("passage_id", "terms").toArrow().to_batches() if b.num_rows]
    parts = [b for b in W._counted(type("Shared", (), {"value": pieces}))(iter(batch))]
    assert len(parts) > 100 and sum(b.num_rows for b in parts) == 302
    assert sorted(str((r["passage_id"], t["term"], t["tf"], r["doclen"])) for b in parts for r in b.to_pylist() for t in r["terms"]) == want
    plain = L.Index(index.tf, index.lengths, index.dfs, index.stats)
    assert key(W.piece_index(plain, pieces, f"file://{tmp_path}/plain").tf) == want


def test_piece_queries_shuffle_no_postings(spark, sf, monkeypatch, tmp_path):
    tables = tmp_path / "tables"
    tables.symlink_to(sf)
    plans, writer = [], type(spark.range(1).write)
    real = writer.parquet
    monkeypatch.setattr(writer, "parquet", lambda self, *a, **k: plans.append(self._df._jdf.queryExecution().executedPlan().toString()) or real(self, *a, **k))
    for name in ("tf_pieces", "bm25_pieces"):
        plans.append(registry.queries()[name](spark, str(tables))._jdf.queryExecution().executedPlan().toString())
    shuffled = [line for p in plans for line in p.splitlines() if "Exchange hashpartitioning" in line]
    assert shuffled and not any("passage_id" in line for line in shuffled)


def test_writing_blocks_shuffles_once(spark, monkeypatch, tmp_path):
    """Only the few terms over the cap are looked up, by broadcast; before, beyond 200,000 terms, all postings met theirs in a shuffle of its own."""
    monkeypatch.setattr(L, "small", lambda df, rows=200_000: F.broadcast(df) if df.limit(21).count() <= 20 else df)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows, index = small_index(spark)
        index = L.Index.save(index.tf, f"file://{tmp_path}/index")
        joined = []
        real = type(index.tf).join
        monkeypatch.setattr(type(index.tf), "join", lambda self, other, *a, **k: joined.append((other.count(), a[-1])) or real(self, other, *a, **k))
        blocks = P.write_blocks(index, f"file://{tmp_path}/blocks", RetrievalConfig(df_cap_floor=850))
        assert joined == [(sum(r.df > 850 for r in index.dfs.collect()), "left_anti")]
        assert sum(r.n for r in blocks.collect()) == sum(r.df for r in index.dfs.where("df <= 850").collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
