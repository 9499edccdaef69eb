"""The home index's answer, read from one context of several passages, and the routes between it and the encyclopedia's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.config import DEFAULT
from gleaner.functions import routing as G
from gleaner.operators import answers as A
from gleaner.operators import lexical as L
from gleaner.operators import reading as N
from gleaner.operators import retrieve as R
from gleaner.operators import scoring as S

from .answering import _CHAIN, _CONF, _PUNCT, _TITLED
from .binding import STRIDE, TF, articles, index, passages, questions, saved, sql_question_terms, sql_related
from .dense import coverage_ctes
from .lexical import BM25
from .reading import answers, candidates, read_ctes, standin
from .registry import query
from .routing import _ARITH, _ENT, _HAS, _MODE, _NORM, _PH, _TIER, _entities, _titles, _with_entity


def _make_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = index(spark, sf_dir)
    return S.bm25_top(L.with_fuzzy(L.question_terms(questions(spark, sf_dir)), found.dfs), found, DEFAULT.top).select("question_id", "passage_id", "rank")


def _make_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(question_id, top_title, segments, context): up to six of the eight best passages, which are scored once and saved, as one context."""
    top = saved(spark, sf_dir, "home-top", _make_top)
    rows = passages(spark, sf_dir).join(L.small(top), "passage_id").join(articles(spark, sf_dir).select("article_id", "title"), "article_id")
    rows = rows.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("rank", "passage_id", "title", "text"))).alias("h"))
    rows = rows.select("question_id", "h", A.assembled(F.transform("h", lambda x: x.text)).alias("segments"))
    its = lambda s, c: F.get("h", s.place)[c].alias(c)
    rows = rows.withColumn("segments", F.transform("segments", lambda s: F.struct(s.place, s.text, s.from_byte, s.to_byte, its(s, "passage_id"), its(s, "title"))))
    return rows.select("question_id", F.col("h")[0]["title"].alias("top_title"), "segments", A.context_of(F.col("segments")).alias("context"))


def _make_home(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contexts with question and coverage."""
    found, items, rows = index(spark, sf_dir), questions(spark, sf_dir), saved(spark, sf_dir, "home-contexts", _make_contexts)
    pairs = rows.select("question_id", F.lit(0).cast("long").alias("passage_id"), F.col("context").alias("text")).join(items.withColumnRenamed("text", "question"), "question_id")
    covered = R.coverage(pairs, found.dfs, found.stats.select("n")).select("question_id", "question", "coverage")
    return rows.join(covered, "question_id")


def home(spark: SparkSession, sf_dir: str) -> DataFrame:
    return saved(spark, sf_dir, "home", _make_home)


def _make_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = home(spark, sf_dir).withColumn("passage_id", F.lit(0).cast("long"))
    found = N.read(rows.select("question_id", "passage_id", "question", "context"), standin)
    rows = found.select("question_id", "span_score", "null_score", "from_byte", "to_byte").join(rows.drop("passage_id"), "question_id")
    rows = rows.withColumn("segment", A.segment_of(F.col("segments"), F.col("from_byte")))
    # A span that goes on into the next passage ends with its own.
    end = F.least("to_byte", F.col("segment.to_byte"))
    raw = F.substring(F.encode("context", "utf-8"), (F.col("from_byte") + 1).cast("int"), F.greatest(F.lit(0), end - F.col("from_byte")).cast("int"))
    rows = rows.withColumn("answer", A.clipped(F.decode(raw, "utf-8"))).withColumn("margin", F.round(F.col("span_score") - F.col("null_score"), 6))
    confidence = A.damped(A.confidence(F.col("margin"), F.lit(0.0), F.col("coverage")), F.col("answer"), F.col("segment.text"))
    return rows.select("question_id", "question", "top_title", F.col("segment.passage_id").alias("passage_id"), F.col("segment.title").alias("title"), "answer", F.col("segment.text").alias("sentence"), "margin", F.round(confidence, 6).alias("confidence"))


def home_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(question_id, question, top_title, passage_id, title, answer, sentence, margin, confidence) of the home index."""
    return saved(spark, sf_dir, "home-answers", _make_answers)


_FUZZY = f"""q AS ({sql_question_terms()}), w AS (SELECT question_id, term, 1.0 AS weight FROM q
  UNION ALL SELECT q.question_id, d.term, 0.5 FROM q JOIN dfs d ON substr(q.term, 1, 4) = substr(d.term, 1, 4) AND strlen(q.term) >= 4 AND q.term <> d.term AND {sql_related("q.term", "d.term")}), {BM25}"""
_ELEMENT = "STRUCT(place BIGINT, text VARCHAR, a BIGINT, z BIGINT, passage_id BIGINT, title VARCHAR)[]"
_ASSEMBLY = f"""WITH {TF}, {_FUZZY}, hits AS (SELECT question_id, passage_id, row_number() OVER (PARTITION BY question_id ORDER BY round(lexical, 9) DESC, passage_id) AS rank FROM scored QUALIFY rank <= 8),
h AS (SELECT question_id, rank, passage_id, p.text, array_to_string(regexp_split_to_array(d.text, '\\s+')[1:3], ' ') AS title FROM hits JOIN passages p USING (passage_id) JOIN documents d ON d.doc_id = passage_id // {STRIDE}),
f AS (SELECT question_id, max(CASE WHEN rank = 1 THEN title END) AS top_title, list_reduce(list_prepend({{'out': []::{_ELEMENT}, 'stop': false}}, list({{'out': [{{'place': rank - 1, 'text': text, 'a': 0, 'z': strlen(text), 'passage_id': passage_id, 'title': title}}]::{_ELEMENT}, 'stop': false}} ORDER BY rank)),
  lambda s, x: {{'out': CASE WHEN NOT s.stop AND len(s.out) < 6 AND coalesce(s.out[-1].z, 0) + strlen(x.out[1].text) + 2 < 8192
      AND len(list_filter(s.out, lambda o: contains(lower(o.text), lower(x.out[1].text)) OR contains(lower(x.out[1].text), lower(o.text)))) = 0
    THEN list_append(s.out, {{'place': x.out[1].place, 'text': x.out[1].text, 'a': CASE WHEN coalesce(s.out[-1].z, 0) > 0 THEN s.out[-1].z + 1 ELSE 0 END, 'z': CASE WHEN coalesce(s.out[-1].z, 0) > 0 THEN s.out[-1].z + 1 ELSE 0 END + strlen(x.out[1].text),
      'passage_id': x.out[1].passage_id, 'title': x.out[1].title}}) ELSE s.out END,
    'stop': s.stop OR (coalesce(s.out[-1].z, 0) + strlen(x.out[1].text) + 2 >= 8192 AND len(list_filter(s.out, lambda o: contains(lower(o.text), lower(x.out[1].text)) OR contains(lower(x.out[1].text), lower(o.text)))) = 0)}}).out AS segments FROM h GROUP BY question_id),
ctx AS MATERIALIZED (SELECT question_id, 0::BIGINT AS passage_id, top_title, segments, array_to_string(list_transform(segments, lambda s: s.text), ' ') AS text, b.text AS question FROM f JOIN benchmark b ON b.item_id = question_id)"""
# The answer in SQL: the span's pieces that begin before its segment's end, cut there.
_HOME = f"""{_ASSEMBLY}, {coverage_ctes(False, "", "ctx")}, {read_ctes("h_", "ctx", "text")},
pb AS (SELECT question_id, n, source, sum(strlen(source)) OVER (PARTITION BY question_id ORDER BY n) AS upto FROM h_pc),
sb AS (SELECT s.question_id, s.span_score, s.size, s.n2, p.upto - strlen(p.source) AS a, s.n1 FROM h_sp s JOIN pb p ON p.question_id = s.question_id AND p.n = s.n1),
sg AS (SELECT sb.*, c.top_title, c.question, coalesce(list_filter(c.segments, lambda s: sb.a >= s.a AND sb.a < s.z)[1], c.segments[1]) AS seg FROM sb JOIN ctx c USING (question_id)),
an AS (SELECT sg.question_id, any_value(sg.seg) AS seg, any_value(sg.top_title) AS top_title, any_value(sg.question) AS question, any_value(sg.span_score) AS span_score, any_value(sg.size) AS size,
  string_agg(CASE WHEN p.upto <= sg.seg.z THEN p.source ELSE '' END, '' ORDER BY p.n) AS raw FROM sg JOIN pb p ON p.question_id = sg.question_id AND p.n BETWEEN sg.n1 AND sg.n2 GROUP BY sg.question_id),
rd AS (SELECT an.*, r.span, round(an.span_score - r.null_score, 6) AS margin, 0.0 AS dense, coalesce(cov.coverage, 1.0) AS coverage,
  regexp_replace(raw, '[ .,;]+$', '') AS answer FROM an JOIN h_read r USING (question_id) LEFT JOIN cov USING (question_id)),
home AS (SELECT question_id, question, top_title, seg.passage_id AS passage_id, seg.title AS title, answer, seg.text AS sentence, margin,
  round(CASE WHEN strlen(answer) > 0.6 * strlen(seg.text) OR strlen(answer) > 140 THEN 0.6 ELSE 1 END * ({_CONF}), 6) AS confidence FROM rd)"""


@query("context_assembly", f"{_ASSEMBLY} SELECT question_id, len(segments) AS n, segments[-1].z::BIGINT AS bytes, md5(text) AS digest, array_to_string(list_transform(segments, lambda s: s.place || ':' || s.a || '-' || s.z), ' ') AS bounds FROM ctx")
def context_assembly(spark, sf_dir):
    """The reader's context of the eight best passages, with each one's bytes."""
    rows = home(spark, sf_dir)
    text = lambda c: c.cast("string")
    bounds = F.array_join(F.transform("segments", lambda s: F.concat(text(s.place), F.lit(":"), text(s.from_byte), F.lit("-"), text(s.to_byte))), " ")
    return rows.select("question_id", F.size("segments").cast("long").alias("n"), F.octet_length("context").cast("long").alias("bytes"), F.md5("context").alias("digest"), bounds.alias("bounds"))


@query("home_answers", f"{_HOME} SELECT question_id, passage_id, title, answer, md5(sentence) AS sentence, round(margin, 4) AS margin, round(confidence, 4) AS confidence FROM home")
def home_answers_(spark, sf_dir):
    """One reading of the whole context: the answer ends with its passage."""
    rows = home_answers(spark, sf_dir)
    return rows.select("question_id", "passage_id", "title", "answer", F.md5("sentence").alias("sentence"), F.round("margin", 4).alias("margin"), F.round("confidence", 4).alias("confidence"))


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(question_id, wide, accepted): the encyclopedia's answer and whether it passes the gate."""
    rows = answers(spark, sf_dir).join(candidates(spark, sf_dir).select("question_id", "rank", "coverage", "dense"), ["question_id", "rank"])
    confidence = A.confidence(F.col("margin"), F.col("dense"), F.col("coverage"))
    good = A.accepted(F.col("answer"), confidence, F.col("margin"), A.is_title(F.col("answer"), F.col("title")))
    return rows.select("question_id", F.col("answer").alias("wide"), good.alias("accepted"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark text with its home answer, the encyclopedia's, and entity."""
    rows = home_answers(spark, sf_dir).join(_wide(spark, sf_dir), "question_id", "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))
    messages = questions(spark, sf_dir).withColumnRenamed("question_id", "id")
    entity = _with_entity(messages, _entities(spark, sf_dir), _titles(spark, sf_dir)).select(F.col("id").alias("question_id"), "entity")
    return rows.join(entity, "question_id")


_GATE = f"""WITH {_CHAIN.removeprefix("WITH ")}, g0 AS (SELECT fi.question_id, fi.answer, fi.margin, ca.coverage, ca.dense, trim(regexp_replace(lower(split_part(fi.title, '(', 1)), '{_PUNCT}', '', 'g')) AS nt,
    regexp_replace(trim(regexp_replace(lower(fi.answer), '{_PUNCT}', '', 'g')), '^the ', '') AS na FROM final fi JOIN cand ca ON ca.question_id = fi.question_id AND ca.rank = fi.rank)
  SELECT question_id, answer AS wide, answer <> '' AND {_CONF} >= 0.45 AND (margin >= 0 OR ({_TITLED} AND margin >= -6)) AS accepted FROM g0"""
_ITEMS = _NORM.replace(_PH, "msg AS (SELECT item_id AS id, text FROM benchmark)")
_ROUTED = f"""WITH hm AS ({_HOME} SELECT * FROM home), wd AS ({_GATE}), he AS (WITH {_ITEMS}, {_ENT}, {_HAS} SELECT id, text, na, n, nd, entity FROM he),
a AS (SELECT hm.*, he.*, wd.wide, coalesce(accepted, false) AS accepted FROM hm JOIN he ON he.id = hm.question_id LEFT JOIN wd ON wd.question_id = hm.question_id)"""


@query("ask_route", f"{_ROUTED} SELECT question_id, entity, CASE WHEN NOT entity AND accepted THEN 'wikipedia' ELSE 'home' END AS kind, CASE WHEN NOT entity AND accepted THEN wide ELSE answer END AS answer FROM a")
def ask_route(spark, sf_dir):
    """A question without an entity gets the encyclopedia's answer if that is accepted, others the home index's."""
    wide = ~F.col("entity") & F.col("accepted")
    return _asked(spark, sf_dir).select("question_id", "entity", F.when(wide, "wikipedia").otherwise("home").alias("kind"), F.when(wide, F.col("wide")).otherwise(F.col("answer")).alias("answer"))


@query("route_answers", f"""{_ROUTED}, r AS (SELECT *, {_TIER} AS tier, {_MODE} AS mode, {_ARITH} AS arithmetic, (margin > 8 AND (confidence >= 0.6 OR strlen(answer) > 25) AND lower(answer) <> '-')
  OR (margin > 4 AND ((strlen(title) >= 6 AND contains(lower(question), lower(title)) AND lower(title) <> '-') OR (strlen(top_title) >= 6 AND contains(lower(question), lower(top_title)) AND lower(top_title) <> '-'))) AS sure FROM a)
SELECT question_id, sure, CASE WHEN tier = 1 OR (tier = 2 AND NOT entity) OR mode = 'live' THEN 'chat' WHEN arithmetic THEN 'outside' WHEN NOT entity AND NOT sure AND accepted THEN 'wide'
  WHEN entity OR (confidence >= 0.3 AND margin >= 0) THEN 'facts' ELSE 'outside' END AS route FROM r""")
def route_answers(spark, sf_dir):
    """The route of each benchmark text by the answers that both indexes give, and whether the home index is sure of its own."""
    rows, text = _asked(spark, sf_dir), F.col("question")
    sure = lambda title: G.home_sure(F.col("margin"), F.col("confidence"), F.col("answer"), F.col(title), text, "-")
    rows = rows.withColumn("sure", sure("title") | sure("top_title"))
    kind = G.route(G.smalltalk_tier(text), F.col("entity"), G.mode(text), F.lit(False), G.is_arithmetic(text), F.col("sure"), F.col("accepted"), F.col("confidence"), F.col("margin"))
    return rows.select("question_id", "sure", kind.alias("route"))
