"""The index that is counted where passages are read, and scores that are summed there."""

from __future__ import annotations

import uuid

import pyarrow as pa
import pytest
from gleaner.functions import text as T
from gleaner.operators import lexical as L
from gleaner.operators import plaintext as X
from gleaner.operators import retrieve as R
from gleaner.operators import scoring as S
from gleaner.plans import registry
from gleaner.plans.binding import index
from pyspark.sql import functions as F


def test_passages_of_one_id_are_merged(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a b a"), (1, "a c"), (2, "..."), (3, ""), (4, None)], "passage_id long, text string")
    index = L.Index.build(rows, f"file://{tmp_path}/index")
    assert sorted(map(tuple, index.tf.select("passage_id", "term", "tf", "doclen").collect())) == [(1, "a", 3, 5), (1, "b", 1, 5), (1, "c", 1, 5), (2, ".", 3, 3)]
    assert sorted(map(tuple, index.lengths.collect())) == [(1, 5), (2, 3)] and tuple(index.stats.first()) == (2, 4.0)


def test_only_the_best_leave_a_task(spark, tmp_path):
    words = "north south east west river hill lake stone".split()
    text = [" ".join(words[(p * k) % 8] for k in range(1, 3 + p % 11)) for p in range(3000)]
    rows = spark.createDataFrame(list(enumerate(text)), "passage_id long, text string").repartition(3)
    index = L.Index.build(rows, f"file://{tmp_path}/index")
    asked = spark.createDataFrame([(q, w, 1.0 if (q + k) % 3 else 0.5) for q in range(5) for k, w in enumerate(words[q:])], "question_id long, term string, weight double")
    want = R.top_k(L.bm25(asked, index).withColumn("score", F.round("lexical", 9)), 6)
    key = lambda df: sorted((r.question_id, r.rank, r.passage_id, round(r.lexical, 9)) for r in df.collect())
    assert key(S.bm25_top(asked, index, 6)) == key(want)
    found = S._pairs(asked, index, 6, None, S.DEFAULT)
    assert found.count() <= 5 * 6 * found.rdd.getNumPartitions() < L.bm25(asked, index).count()
    every = S.bm25(asked, index, rows.where("passage_id < 50").select("passage_id"))
    assert every.count() == L.bm25(asked, index).where("passage_id < 50").count()
    assert S.bm25_top(asked.limit(0), index, 6).count() == 0


def test_best_by_blocks(spark, tmp_path):
    """Postings of a passage come from the blocks of several terms; only the best of each task leave it."""
    from gleaner.operators import postings as P

    rows = spark.createDataFrame([(p, " ".join(w for k, w in enumerate(("ab", "cd", "ef", "gh")) if p % (k + 2))) for p in range(400)], "passage_id long, text string")
    index = L.Index.build(rows, f"file://{tmp_path}/index")
    blocks = P.write_blocks(index, f"file://{tmp_path}/blocks")
    asked = spark.createDataFrame([(q, w, 1.0) for q in range(3) for w in ("ab", "cd", "ef", "gh")[q:]], "question_id long, term string, weight double")
    want = R.top_k(P.bm25(asked, blocks, index).withColumn("score", F.round("lexical", 9)), 5)
    key = lambda df: sorted((r.question_id, r.rank, r.passage_id, round(r.lexical, 9)) for r in df.collect())
    assert key(S.bm25_top_of_blocks(asked, blocks, index, 5)) == key(want)


@pytest.mark.parametrize("name, of", [("alternates", "documents"), ("home_answers", "passages")])
def test_passages_are_scored_once(spark, sf, tmp_path, monkeypatch, name, of):
    """A chain's hits are scored in one pass over the index, however many steps read them."""
    marks, real = str(tmp_path), S._scored

    def marked(*given):
        def run(batches, scored=real(*given)):
            open(f"{marks}/{uuid.uuid4().hex}.mark", "w").close()
            return scored(batches)

        return run

    monkeypatch.setattr(S, "_scored", marked)
    tables = tmp_path / "tables"
    tables.symlink_to(sf)
    assert registry.queries()[name](spark, str(tables)).count() == 40
    assert len(list(tmp_path.glob("*.mark"))) <= index(spark, str(tables), of).tf.rdd.getNumPartitions()


def test_plain_texts_have_the_same_tokens(spark):
    """Every plain character, within a word, alone and beside a point, and rows at the edges of chunks: as the expression cuts them."""
    codes = [k for low, high in X.PLAIN for k in range(low, high + 1)]
    texts = [f"Ab{chr(k)}cD {chr(k)} {chr(k)}.{chr(k)}{chr(k)}" for k in codes] + ["", " ", "x", "À la 漢字b c­d\x00e", "end\n"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = rows.select("text", X.is_plain(F.col("text")).alias("plain"), T.tokens(F.col("text")).alias("t")).collect()
    assert all(r.plain for r in got)
    size, found = X.tokens(pa.array([r.text for r in got]))
    found, ends = found.to_pylist(), size.cumsum()
    assert [found[e - n : e] for n, e in zip(size, ends)] == [r.t for r in got]
    assert not any(r[0] for r in spark.createDataFrame([("İ",), ("ΑΣ",), ("e\u0301",), ("a😀",)], "t string").select(X.is_plain(F.col("t"))).collect())
    assert [b - a for a, b in X.chunks(pa.array(["a" * X.CHUNK, "b", "c" * X.CHUNK * 2, "d"]))] == [1, 1, 1, 1]
