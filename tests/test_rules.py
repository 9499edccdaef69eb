"""Small cases that isolate single rules."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.config import RetrievalConfig
from gleaner.functions import composing as K
from gleaner.functions import models as M
from gleaner.functions import routing as G
from gleaner.functions import text as T
from gleaner.functions import vectors as V
from gleaner.operators import answers as A
from gleaner.operators import corpus as C
from gleaner.operators import lexical as L
from gleaner.operators import pca
from gleaner.operators import retrieve as R
from gleaner.sources import formats as S


def value(spark, column, **given):
    names = list(given)
    rows = spark.createDataFrame([tuple(given[n] for n in names)], ", ".join(f"{n} {'double' if isinstance(given[n], float) else 'int' if isinstance(given[n], int) else 'array<string>' if isinstance(given[n], list) and (not given[n] or isinstance(given[n][0], str)) else 'array<double>' if isinstance(given[n], list) else 'string'}" for n in names))
    return rows.select(column.alias("x")).first().x


def test_clean_unescapes_after_stripping(spark):
    assert value(spark, T.cleaned_fragment(F.col("a")), a="a &lt;b&gt; c") == "a <b> c"
    assert value(spark, T.cleaned_fragment(F.col("a")), a="X ( ; ) Y") == "X Y"
    assert value(spark, T.cleaned_fragment(F.col("a")), a='x<sup class="reference">1</sup> y[edit]') == "x y"


def test_paragraph_branches(spark):
    html = '<div class="x mw-parser-output y"><p>a long enough paragraph here</p><table><p>inside a table, not seen</p></table><div class="zim-footer"><p>footer text that is cut off</p></div>'
    assert value(spark, T.html_paragraphs(F.col("a")), a=html) == ["a long enough paragraph here"]


@pytest.mark.parametrize("sizes,want", [([30, 20, 70], [122]), ([70, 20], [70, 20]), ([], [])])
def test_merge_forward(spark, sizes, want):
    got = value(spark, T.merged_forward(F.col("a")), a=["x" * n for n in sizes])
    assert [len(x) for x in got] == want


def test_one_long_sentence_stays_whole(spark):
    assert value(spark, T.packed_sentences(F.col("a")), a="x" * 900) == ["x" * 900]


def test_sentences(spark):
    assert value(spark, T.sentences(F.col("a")), a="He met Ann. The end.") == ["He met Ann. The end."]
    assert value(spark, T.sentences(F.col("a")), a="It was 12. The end.") == ["It was 12.", "The end."]


def test_parts(spark):
    rows = spark.range(10).withColumnRenamed("id", "row")
    got = [r.part for r in C.parts(rows, 4, 10).orderBy("row").collect()]
    assert [got.count(k) for k in range(4)] == [3, 3, 3, 1]


def test_quantise(spark):
    v = F.col("a")
    assert value(spark, V.scale_of(v), a=[0.0, 0.0]) == 1e-8
    assert value(spark, V.quantised(v, V.scale_of(v)), a=[127.0, 2.5, -2.5]) == [127, 2, -2]
    x = np.random.default_rng(0).normal(size=64).tolist()
    got = np.array(value(spark, V.int4_groups(v), a=x))
    for k in (0, 32):
        assert np.abs(got[k : k + 32] - x[k : k + 32]).max() <= np.abs(x[k : k + 32]).max() / 7 / 2 + 1e-6


def test_idf(spark):
    assert round(value(spark, L.idf(F.col("n"), F.col("d")), n=3, d=1), 4) == 0.9808
    assert value(spark, L.idf(F.col("n"), F.col("d")), n=3, d=3) > 0


@pytest.mark.parametrize("a,b,want", [("king", "kingdom", True), ("king", "kingdoms", False), ("cat", "cats", False), ("#king", "#kingdom", False), ("x", "x", True)])
def test_related(spark, a, b, want):
    assert value(spark, T.related(F.col("a"), F.col("b")), a=a, b=b) is want


def test_fusion_and_diversity(spark):
    dense = spark.createDataFrame([(1, k, 0.5, 7) for k in range(64)], "question_id long, passage_id long, dense double, article_id long")
    lexical = spark.createDataFrame([], "question_id long, passage_id long, lexical double")
    rows = R.fused(dense, lexical)
    assert rows.select("score").distinct().first()[0] == pytest.approx(0.3)
    assert [r.passage_id for r in R.diversified(rows).orderBy("rank").collect()] == [0, 1]


def _pair(spark, question, text):
    return spark.createDataFrame([(1, 2, question, text)], "question_id long, passage_id long, question string, text string")


def test_coverage_of_stop_words_is_one(spark):
    df = spark.createDataFrame([("x", 1)], "term string, df long")
    n = spark.createDataFrame([(3,)], "n long")
    assert R.coverage(_pair(spark, "what is the?", "x"), df, n).first().coverage == 1.0


def test_phrase(spark):
    assert R.phrase_match(_pair(spark, "what is the?", "the")).first().phrase == 0
    assert R.phrase_match(_pair(spark, "what is the longest river in the world?", "the river in the world")).first().phrase == pytest.approx(4 / 5)


def test_echo_spans_do_not_count(spark):
    rows = spark.createDataFrame([(1, 0, 1.0, 1.0, True), (1, 1, 1.0, 1.0, True)], "question_id long, pos int, start double, end double, echo boolean")
    assert A.best_spans(rows).count() == 0


def test_confidence(spark):
    assert value(spark, A.confidence(F.col("m"), F.col("d"), F.col("c")), m=0.0, d=0.45, c=1.0) == pytest.approx(0.65)


@pytest.mark.parametrize("answer,title,want", [("the Giraffes", "Giraffe", True), ("Mercury", "Mercury (element)", True), ("Ox", "Ox", False)])
def test_is_title(spark, answer, title, want):
    assert value(spark, A.is_title(F.col("a"), F.col("t")), a=answer, t=title) is want


def test_vote(spark):
    rows = spark.createDataFrame([(1, 1, "alpha", 4.0, 5.0), (1, 2, "beta beta", 3.0, 3.0), (1, 3, "the beta beta", 2.0, 2.0), (1, 4, "alpha", -2.0, 0.0)], "question_id long, rank int, answer string, margin double, sc double")
    got = {r["rank"]: (r.total, r.won) for r in A.voted(rows).collect()}
    assert got == {1: (5.0, True), 2: (4.0, False), 3: (3.5, False), 4: (2.0, False)}


def test_accept(spark):
    gate = lambda titled: A.accepted(F.col("a"), F.col("c"), F.col("m"), F.lit(titled))
    assert value(spark, gate(True), a="x", c=0.5, m=-5.0) is True
    assert value(spark, gate(False), a="x", c=0.5, m=-5.0) is False


def test_assembled(spark):
    context = lambda **k: A.context_of(A.assembled(F.col("a"), **k))
    assert value(spark, context(), a=["one two", "ONE", "three"]) == "one two three"
    assert value(spark, context(capacity=10), a=["one two", "longer text", "x"]) == "one two"
    parts = value(spark, A.assembled(F.col("a")), a=["é b", "ONE", "é B", *(f"t{k}" for k in range(9))])
    assert [(s.place, s.text, s.from_byte, s.to_byte) for s in parts] == [(0, "é b", 0, 4), (1, "ONE", 5, 8), *((k + 3, f"t{k}", 9 + 3 * k, 11 + 3 * k) for k in range(4))]
    cut = lambda byte: A.segment_of(A.assembled(F.col("a")), F.lit(byte)).text
    assert [value(spark, cut(b), a=["ab", "cd"]) for b in (0, 1, 2, 3, 4)] == ["ab", "ab", "ab", "cd", "cd"]


@pytest.mark.parametrize("text,want", [("2024-01-01", True), ("twice the size", False), ("what is 15% of 200", True), ("3 + 4", True)])
def test_arithmetic(spark, text, want):
    assert value(spark, G.is_arithmetic(F.col("a")), a=text) is want


def test_needs_context(spark):
    assert value(spark, G.needs_context(F.col("a")), a="capital?") is True
    assert value(spark, G.needs_context(F.col("a")), a="What's the population of Tokyo?") is False


def test_grounded(spark):
    words = "alpha bravo charlie delta echoes foxtrot golfer hotel india juliet".split()
    ground = K.grounded(F.col("a"), F.col("r"), F.lit(0.9), F.lit(False))
    assert value(spark, ground, a=" ".join(words), r=" ".join(words[:7])) is True
    assert value(spark, ground, a=" ".join(words), r=" ".join(words[:6])) is False
    assert value(spark, ground, a="x" * 101, r="") is True


def test_facts(spark):
    lines = ["Leo is the minister of finance.", "The minister is Leo", "Leo is the minister of finance.", "another line"]
    facts = K.facts_of(F.transform("a", lambda t: F.struct(F.lit("T").alias("title"), t.alias("text"))), 6)
    assert [(f.title, f.text) for f in value(spark, facts, a=lines)] == [("T", lines[0]), ("T", lines[3])]


def test_grade_and_bucket(spark):
    assert value(spark, K.graded(F.col("r"), F.col("a")), r="anything", a=["!short"]) is True
    assert value(spark, K.graded(F.col("r"), F.col("a")), r="w " * 41, a=["!short"]) is False
    assert value(spark, K.bucket(F.col("c")), c=0.6) == "probably"


def test_dedupe(spark):
    assert value(spark, K.deduplicated(F.col("a")), a="- A sentence here. Short. A sentence here! Short.") == "- A sentence here. Short. Short."


def test_interleave(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "question_id long, passage_id long, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "question_id long, passage_id long, rank int")
    assert [r.passage_id for r in R.interleaved(a, b).orderBy("rank").collect()] == [10, 11, 12]


def test_pca(spark):
    x = np.random.default_rng(1).normal(size=(200, 6)) @ np.diag([5, 3, 1, 0.1, 0.1, 0.1]) + 4
    rows = spark.createDataFrame([(k, [float(y) for y in v]) for k, v in enumerate(x)], "passage_id long, v array<double>")
    model = pca.fit(rows, 3)
    assert np.allclose(model.mean, x.mean(0)) and model.kept > 0.95
    got = np.array([r.v for r in pca.project(rows, model).orderBy("passage_id").collect()])
    y = (x - x.mean(0)) @ model.axes
    assert np.allclose(got, y / np.linalg.norm(y, axis=1, keepdims=True), atol=1e-6)


def test_transformer_shape():
    rng, w, d = np.random.default_rng(0), {}, 8
    for name, shape in {"embeddings.word_embeddings": (20, d), "embeddings.position_embeddings": (10, d), "embeddings.token_type_embeddings": (2, d)}.items():
        w[f"{name}.weight"] = rng.normal(size=shape)
    names = ["attention.self.query", "attention.self.key", "attention.self.value", "attention.output.dense"]
    sizes = {**{n: (d, d) for n in names}, "intermediate.dense": (2 * d, d), "output.dense": (d, 2 * d)}
    for n, s in sizes.items():
        w[f"encoder.layer.0.{n}.weight"], w[f"encoder.layer.0.{n}.bias"] = rng.normal(size=s), np.zeros(s[0])
    for n in ("embeddings.LayerNorm", "encoder.layer.0.attention.output.LayerNorm", "encoder.layer.0.output.LayerNorm"):
        w[f"{n}.weight"], w[f"{n}.bias"] = np.ones(d), np.zeros(d)
    out = M.transformer(np.array([1, 2, 3]), np.zeros(3, int), w, 1, 2)
    assert out.shape == (3, d) and np.allclose(out.mean(1), 0, atol=1e-9)


def test_files(spark, tmp_path):
    (tmp_path / "v.txt").write_text("a\nb\n##c\n")
    assert [tuple(r) for r in S.read_vocabulary(spark, str(tmp_path / "v.txt")).orderBy("id").collect()] == [(0, "a"), (1, "b"), (2, "##c")]
    x = np.arange(6, dtype="<f4")
    head = json.dumps({"x": {"dtype": "F32", "shape": [2, 3], "data_offsets": [0, 24]}}).encode()
    (tmp_path / "m.safetensors").write_bytes(len(head).to_bytes(8, "little") + head + x.tobytes())
    assert S.read_safetensors(spark, str(tmp_path / "m.safetensors"))["x"].tolist() == x.reshape(2, 3).tolist()
    (tmp_path / "m.f32").write_bytes(x.tobytes() + b"12")
    assert [r.v for r in S.read_matrix(spark, str(tmp_path / "m.f32"), 2).orderBy("row").collect()] == [[0, 1], [2, 3], [4, 5]]
    (tmp_path / "p.json").write_text(json.dumps([{"text": "t", "title": "x", "url": "u", "source": "s"}]))
    assert S.read_json_passages(spark, str(tmp_path / "p.json")).first().text == "t"


def test_archive(spark, tmp_path):
    entries = [{"path": "a", "title": "A", "mimetype": "text/html", "html": "<p>x</p>"}, {"path": "b", "redirect": True, "mimetype": "text/html"}, {"path": "c", "mimetype": "image/png"}]
    (tmp_path / "one.jsonl").write_text("\n".join(json.dumps(e) for e in entries))
    S.register_archive(spark)
    assert [r.path for r in spark.read.format("page_archive").load(str(tmp_path)).collect()] == ["a"]


def test_history(spark):
    turns = json.dumps([{"role": "x", "text": "a"}, {"role": "assistant", "text": ""}, {"role": "assistant", "text": "b"}])
    assert [tuple(t) for t in value(spark, S.history(F.col("a")), a=turns)] == [("user", "a"), ("assistant", "b")]


def test_stream(spark, tmp_path):
    from gleaner.streaming.serve import serve

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "q.json").write_text('{"question_id": 1, "text": "red fox"}\n{"question_id": 2, "text": "zzz"}')
    p = spark.createDataFrame([(10, "a red fox runs"), (11, "blue sea")], "passage_id long, text string")
    query = serve(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), L.term_frequencies(p))
    query.awaitTermination(120)
    got = {r.question_id: json.loads(r.body) for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert [h["passage_id"] for h in got[1]["hits"]] == [10] and "hits" not in got[2]


def test_config():
    assert RetrievalConfig(prerank=99).prerank_clamped == 32


def test_cascade_of_replies(spark):
    held, lost = "The king lives at Coastburgh Castle.", "He lives somewhere."
    rows = [
        (1, 0.9, True, held, lost, lost), (2, 0.9, True, lost, held, lost), (3, 0.9, True, lost, lost, held), (4, 0.9, True, lost, lost, lost),
        (5, 0.9, False, lost, lost, held), (6, 0.55, True, lost, lost, held), (7, 0.55, False, lost, held, held), (8, 0.2, True, lost, held, held),
    ]
    frame = spark.createDataFrame(rows, "id int, confidence double, wide boolean, a string, b string, c string")
    out = K.cascade(F.lit("Coastburgh Castle"), F.lit("King"), F.col("confidence"), F.col("wide"), F.col("a"), F.col("b"), F.col("c"))
    got = {r.id: (r.o.used, r.o.reply) for r in frame.select("id", out.alias("o")).collect()}
    told = "Coastburgh Castle (Wikipedia, King)"
    assert got == {1: ("first", held), 2: ("second", held), 3: ("focused", held), 4: ("told", told), 5: ("ungrounded", lost), 6: ("ungrounded", lost), 7: ("first", lost), 8: ("first", lost)}


def test_types_of_pairs(spark):
    rows = spark.createDataFrame([(["a"], ["b", "c"]), ([], []), (["q"] * 70, ["c"] * 400)], "q array<string>, c array<string>")
    got = [(r.p, r.y) for r in rows.select(T.encoded_pair(F.col("q"), F.col("c")).alias("p"), T.pair_types(F.col("q"), F.col("c")).alias("y")).collect()]
    assert [len(p) for p, _ in got] == [len(y) for _, y in got] == [6, 3, 384]
    assert got[0][1] == [0, 0, 0, 1, 1, 1] and got[1][1] == [0, 0, 1] and sum(got[2][1]) == 384 - 64


def test_span_of_equal_sums_is_the_first(spark):
    """3.3 + 4.4 and 0.1 + 7.6 are equal, though not as sums of doubles."""
    rows = spark.createDataFrame([(1, 0, 0.1, 7.6, False), (1, 30, 3.3, 4.4, False)], "question_id long, pos int, start double, end double, echo boolean")
    found = A.best_spans(rows).collect()
    assert 3.3 + 4.4 != 0.1 + 7.6 and [(r.i, r.j) for r in found] == [(0, 0)]


def test_related_terms_of_few_characters(spark, tmp_path):
    """Three characters may have more than four bytes."""
    from gleaner.plans import lexical as X

    spark.createDataFrame([(0, "мир мира")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted((r.a, r.b) for r in X.related_terms(spark, str(tmp_path)).collect()) == [("мир", "мира")]
