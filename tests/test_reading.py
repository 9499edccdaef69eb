"""Byte offsets, spans and readings on small cases."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators import answers as A
from gleaner.operators import plaintext as X
from gleaner.operators import reading as N
from gleaner.plans import registry

TEXTS = ["", "Ab cd.", "é́x 漢字 a­b", "\x01a\x01\x02b  c", "  ́ x", "naïve—Ünï, (ß)\r\n\tİx", "a\x00b", "don't stop", "﻿word​ end", "x" * 300, "À la carte 12,5 €"]


@pytest.mark.parametrize("text", TEXTS)
def test_spans_are_where_their_tokens_stand(spark, text):
    rows = spark.createDataFrame([(1, text)], "id long, text string")
    got = N.token_spans(rows, ["id"]).orderBy("place").collect()
    raw = text.replace("\x01", "\x02").encode()
    assert [r.token for r in got] == rows.select(T.tokens(F.col("text")).alias("t")).first().t
    assert all(raw[r.from_byte : r.to_byte].decode() == r.source for r in got)
    assert all(a.to_byte <= b.from_byte for a, b in zip(got, got[1:]))
    assert [r.place for r in got] == list(range(len(got)))


def test_offsets_of_marks_and_ideographs(spark):
    rows = spark.createDataFrame([(1, "éa 漢b.")], "id long, text string")
    got = [(r.token, r.from_byte, r.to_byte) for r in N.token_spans(rows, ["id"]).orderBy("place").collect()]
    assert got == [("ea", 0, 4), ("漢", 5, 8), ("b", 8, 9), (".", 9, 10)]


def test_spans_equal_all_pairs(spark):
    """Best spans of random logits against a plain double loop; ties go to the first start, then the first end."""
    random, rows = np.random.default_rng(3), []
    for k in range(60):
        n = int(random.integers(1, 60))
        words = [f"w{int(x)}" for x in random.integers(0, 6, n)]
        rows.append((k, 1, " ".join(["w0", "w1"][: k % 3]), " ".join(words)))
    frame = spark.createDataFrame(rows, "question_id long, passage_id long, question string, context string")
    logit = lambda a, m: F.pmod(F.col("place") * a + F.col("question_id"), F.lit(m)) / 4.0
    found = N.read(frame, lambda t: t.withColumns({"start": logit(5, 7), "end": logit(3, 5), "null_score": F.lit(1.0)}))
    got = {r.question_id: (r.i, r.j, r.span_score, r.answer) for r in found.collect()}
    want = {}
    for k, _, question, context in rows:
        words, asked = context.split(), question.split()
        spans = [(-(((i * 5 + k) % 7) / 4 + ((j * 3 + k) % 5) / 4), i, j) for i in range(len(words)) for j in range(i, min(len(words), i + A.SPAN)) if set(words[i : j + 1]) - set(asked)]
        if spans:
            score, i, j = min(spans)
            want[k] = (i, j, -score, " ".join(words[i : j + 1]))
    assert got == want and len(want) > 40


def test_told(spark):
    cases = [("it", "Mercury (element)", "Mercury"), ("The city.", "Paris", "Paris"), ("Giraffe: tall", "Giraffe", "tall"), ("Giraffe:", "Giraffe", None), ("they ", "Otters (animals)", "Otters"), ("an apple", "Apple", "an apple")]
    rows = spark.createDataFrame(cases, "a string, t string, want string")
    assert all(r.got == r.want for r in rows.select("want", N.told(F.col("a"), F.col("t")).alias("got")).collect())


def test_long_answers_are_clipped_at_characters(spark):
    frame = spark.createDataFrame([(1, 1, "q", "é" * 400 + " .,; b")], "question_id long, passage_id long, question string, context string")
    one = F.when(F.col("place") == 0, 1.0).otherwise(0.0)
    found = N.read(frame, lambda t: t.withColumns({"start": one, "end": one, "null_score": F.lit(0.0)})).first()
    assert found.answer == "é" * 250 and (found.from_byte, found.to_byte) == (0, 800)


def test_tokens_are_numbered_where_the_text_is_read(spark):
    """Neither numbering a text's tokens nor cutting them to a reader's input shuffles them; words of which nothing stays don't count."""
    text = "́ " * 900 + "a b " * 500
    rows = spark.createDataFrame([(1, 1, "q", text)], "question_id long, passage_id long, question string, context string")
    found = N.token_spans(rows, ["question_id", "passage_id"], "context")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    seen = []
    N.read(rows, lambda t: seen.append(t) or t.withColumns({c: F.lit(0.0) for c in ("start", "end", "null_score")}))
    assert "Exchange" not in seen[0]._jdf.queryExecution().executedPlan().toString()
    got = seen[0].orderBy("place").collect()
    assert [r.token for r in got] == ["a", "b"] * 190 and [r.place for r in got] == list(range(380)) and {r.n_tokens for r in got} == {380}
    assert found.count() == 1000 and got[0].from_byte == 900 * 3


def test_digests_are_made_where_texts_are_read(spark, sf):
    """No token of the registered query is shuffled; rows of one id, or without one, are still one digest."""
    plan = registry.queries()["token_spans"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "collect_list" not in plan
    rows = [(k, text) for k, text in enumerate(TEXTS)] + [(100, None), (101, "ab c"), (101, "d ef"), (None, "x y"), (None, "é z"), (102, "漢字 " * 3000)]
    frame = spark.createDataFrame(rows, "id long, text string").repartition(3)
    want = {}
    for r in N.token_spans(frame, ["id"]).collect():
        want.setdefault(r.id, []).append((r.place, f"{r.token}:{r.from_byte}-{r.to_byte}", r.to_byte))
    want = {k: (len(v), max(x[2] for x in v), hashlib.md5(" ".join(x[1] for x in sorted(v)).encode()).hexdigest()) for k, v in want.items()}
    got = N.span_digests(frame, "id").collect()
    assert len(got) == len(want) and {r.id: (r.n, r.last_byte, r.digest) for r in got} == want and {101, 102, None} <= set(want)


def test_plain_texts_have_the_same_pieces(spark):
    """Every plain character within a word, alone, at its end and beside a point, cut as the expression cuts it; so are rows at the edges of chunks."""
    codes = [k for low, high in X.PLAIN for k in range(low, high + 1) if k != 1]
    texts = [f"Ab{chr(k)}cD{chr(k)} {chr(k)} {chr(k)}.{chr(k)}{chr(k)}e" for k in codes] + ["", " ", "x", "À la 漢字b c­d\x00e ", "end\n", "­", "ab cd " * 9]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    rows = rows.withColumn("pieces", T.token_pieces(F.col("text"))).withColumn("words", F.transform(F.filter("pieces", lambda p, n: n % 2 == 1), T.normalised))
    want = {r.text: (r.pieces, r.words) for r in rows.collect()}
    pieces, words = X.pieces(pa.array(texts))
    assert [want[t] for t in texts] == list(zip(pieces.to_pylist(), words.to_pylist()))
