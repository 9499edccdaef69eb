"""Queries on spans, confidence, votes, titles and acceptance, over the answer chain's candidates.

The reader's logits are a stand-in: arithmetic on positions and ids, since its model is not at hand.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators import answers as A

from .binding import PASSAGES, sql_tokens, table
from .dense import coverage_ctes
from .reading import CAND, HIT, RESOLVED, TOLD, answers, hits, read_ctes, scored, second
from .reading import candidates as _candidates
from .registry import query

# Token logits: start = (pos * 37 + item) % 101 / 10, end = (pos * 53 + item) % 97 / 10; every 7th position and its two neighbours echo.
_LOGITS = f"""t AS (SELECT item_id AS question_id, unnest(range(0, len({sql_tokens("text")}))) AS pos FROM benchmark),
tok AS (SELECT question_id, pos, ((pos * 37 + question_id) % 101) / 10.0 AS s, ((pos * 53 + question_id) % 97) / 10.0 AS e, pos % 7 <= 2 AS echo FROM t)"""


def _logits(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.posexplode(T.tokens(F.col("text"))).alias("pos", "token"))
    part = lambda a, m: F.pmod(F.col("pos") * a + F.col("question_id"), F.lit(m)) / 10.0
    return rows.select("question_id", "pos", part(37, 101).alias("start"), part(53, 97).alias("end"), (F.col("pos") % 7 <= 2).alias("echo"))


@query("span_argmax", f"""WITH {_LOGITS}, p AS (SELECT a.question_id, a.pos AS i, b.pos AS j, round(a.s + b.e, 6) AS span_score FROM tok a JOIN tok b ON a.question_id = b.question_id AND b.pos BETWEEN a.pos AND a.pos + 23
  WHERE EXISTS (SELECT 1 FROM tok c WHERE c.question_id = a.question_id AND c.pos BETWEEN a.pos AND b.pos AND NOT c.echo))
SELECT question_id, i, j, span_score FROM p QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY span_score DESC, i, j) = 1""")
def span_argmax(spark, sf_dir):
    found = A.best_spans(_logits(spark, sf_dir).withColumn("start", F.round("start", 6)))
    return found.select("question_id", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.round("span_score", 6).alias("span_score"))


@query("null_score", f"WITH {_LOGITS} SELECT question_id, round(max(CASE WHEN pos = 0 THEN s + e END), 6) AS null_score, count(*) AS n FROM tok GROUP BY ALL")
def null_score(spark, sf_dir):
    rows = _logits(spark, sf_dir)
    return rows.groupBy("question_id").agg(F.round(F.max(F.when(F.col("pos") == 0, F.col("start") + F.col("end"))), 6).alias("null_score"), F.count("*").alias("n"))


_PUNCT = r"[\x00-\x1F!-/:-@\[-`{-~]"
_CAND = CAND
_CONF = "0.5 / (1 + exp(-0.35 * margin)) + 0.2 * greatest(0, least(1, (dense - 0.25) * 2.5)) + 0.3 * coverage"
_TITLED = f"""(least(strlen(na), strlen(nt)) >= 3 AND (na = nt OR (abs(strlen(na) - strlen(nt)) <= 1 AND (starts_with(na, nt) OR starts_with(nt, na)))))"""
_FORMS = f"""n AS (SELECT *, regexp_replace(trim(regexp_replace(lower(answer), '{_PUNCT}', '', 'g')), '^the ', '') AS na, trim(regexp_replace(lower(split_part(title, '(', 1)), '{_PUNCT}', '', 'g')) AS nt,
  rtrim(regexp_replace(regexp_replace(lower(answer), '^(the|an|a) ', ''), '{_PUNCT}', '', 'g')) AS form FROM cand), k AS (SELECT *, {_TITLED} AS titled FROM n)"""


@query("confidence", f"WITH {_CAND} SELECT question_id, rank, round({_CONF}, 4) AS confidence FROM cand")
def confidence(spark, sf_dir):
    return _candidates(spark, sf_dir).select("question_id", "rank", F.round(A.confidence(F.col("margin"), F.col("dense"), F.col("coverage")), 4).alias("confidence"))


@query("confidence_damped", f"WITH {_CAND} SELECT question_id, rank, round(CASE WHEN strlen(answer) > 0.6 * strlen(passage) OR strlen(answer) > 140 THEN 0.6 ELSE 1 END * ({_CONF}), 4) AS confidence FROM cand")
def confidence_damped(spark, sf_dir):
    value = A.damped(A.confidence(F.col("margin"), F.col("dense"), F.col("coverage")), F.col("answer"), F.col("passage"))
    return _candidates(spark, sf_dir).select("question_id", "rank", F.round(value, 4).alias("confidence"))


@query("answer_clip", f"WITH {PASSAGES} SELECT passage_id, regexp_replace(text[1:(CASE WHEN strlen(text) <= 500 THEN 500 ELSE len(list_filter(list_transform(range(1, 501), lambda i: strlen(text[1:i])), lambda b: b <= 500)) END)], '[ .,;]+$', '') AS answer FROM passages")
def answer_clip(spark, sf_dir):
    from .binding import passages

    return passages(spark, sf_dir).select("passage_id", A.clipped(F.col("text")).alias("answer"))


@query("prerank_top8", f"WITH {HIT} SELECT question_id, passage_id, rank, round(score, 4) AS score, round(coverage, 4) AS coverage, round(phrase, 4) AS phrase FROM hit")
def prerank_top8(spark, sf_dir):
    """The eight best of 24 documents by their share of the question's best BM25 score, coverage and phrase, over "title: text"."""
    return hits(spark, sf_dir).select("question_id", "passage_id", "rank", *(F.round(c, 4).alias(c) for c in ("score", "coverage", "phrase")))


@query("pronoun", f"WITH {_CAND} SELECT question_id, rank, span, {RESOLVED} AS resolved FROM cand")
def pronoun(spark, sf_dir):
    """The chain's spans, of which pronouns become the article's title."""
    rows = _candidates(spark, sf_dir)
    return rows.select("question_id", "rank", "span", A.resolved(F.col("span"), F.col("title")).alias("resolved"))


@query("title_prefix", f"WITH {_CAND}, r AS (SELECT *, {RESOLVED} AS r FROM cand) SELECT question_id, rank, title, {TOLD} AS stripped, span <> {TOLD} AS changed FROM r")
def title_prefix(spark, sf_dir):
    """The chain's spans without the title that was put before the passage."""
    stripped = A.without_title_prefix(A.resolved(F.col("span"), F.col("title")), F.col("title"))
    return _candidates(spark, sf_dir).select("question_id", "rank", "title", stripped.alias("stripped"), (F.col("span") != stripped).alias("changed"))


@query("answer_title", f"WITH {_CAND}, {_FORMS} SELECT question_id, rank, answer, title, titled FROM k")
def answer_title(spark, sf_dir):
    return _candidates(spark, sf_dir).select("question_id", "rank", "answer", "title", A.is_title(F.col("answer"), F.col("title")).alias("titled"))


@query("normalise_answer", f"WITH {_CAND}, {_FORMS} SELECT question_id, rank, form FROM k")
def normalise_answer(spark, sf_dir):
    return _candidates(spark, sf_dir).select("question_id", "rank", A.voting_form(F.col("answer")).alias("form"))


_SC = f"sc AS (SELECT *, round(margin + 12 * (score - first) + 15 * (coverage - 1) + CASE WHEN titled THEN 3 ELSE 0 END, 9) AS sc FROM k)"
_VOTE = """v AS (SELECT a.*, a.sc + 0.5 * coalesce((SELECT sum(greatest(b.margin, 0)) FROM sc b WHERE b.question_id = a.question_id AND b.rank <> a.rank AND a.form <> '' AND b.form <> ''
  AND (a.form = b.form OR (least(strlen(a.form), strlen(b.form)) >= 4 AND (contains(a.form, b.form) OR contains(b.form, a.form))))), 0) AS total FROM sc a)"""


@query("candidate_score", f"WITH {_CAND}, {_FORMS}, {_SC} SELECT question_id, rank, round(sc, 4) AS sc FROM sc")
def candidate_score(spark, sf_dir):
    return scored(spark, sf_dir).select("question_id", "rank", F.round("sc", 4).alias("sc"))


@query("vote", f"WITH {_CAND}, {_FORMS}, {_SC}, {_VOTE} SELECT question_id, rank, round(total, 4) AS total, row_number() OVER (PARTITION BY question_id ORDER BY round(total, 9) DESC, rank) = 1 AS won FROM v")
def vote(spark, sf_dir):
    rows = A.voted(scored(spark, sf_dir))
    return rows.select("question_id", "rank", F.round("total", 4).alias("total"), "won")


@query("promote", f"WITH {_CAND}, {_FORMS}, {_SC}, {_VOTE}, wn AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(total, 9) DESC, rank) = 1 AS won FROM v) SELECT question_id, rank, row_number() OVER (PARTITION BY question_id ORDER BY won DESC, rank) AS place FROM wn")
def promote(spark, sf_dir):
    rows = A.promoted(A.voted(scored(spark, sf_dir)))
    return rows.select("question_id", "rank", F.col("place").cast("long").alias("place"))


@query("accept_gate", f"WITH {_CAND}, {_FORMS}, a AS (SELECT *, {_CONF} AS confidence FROM k) SELECT question_id, rank, margin FROM a WHERE answer <> '' AND confidence >= 0.45 AND (margin >= 0 OR (titled AND margin >= -6))")
def accept_gate(spark, sf_dir):
    rows = _candidates(spark, sf_dir).withColumn("confidence", A.confidence(F.col("margin"), F.col("dense"), F.col("coverage")))
    return rows.where(A.accepted(F.col("answer"), F.col("confidence"), F.col("margin"), A.is_title(F.col("answer"), F.col("title")))).select("question_id", "rank", "margin")


#: The winner of each question; sentences of candidates of questions that nobody answered convincingly; their readings; the final answers.
_FINAL = f"""w1 AS MATERIALIZED (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY round(total, 9) DESC, rank) = 1),
lost AS (SELECT question_id, doc_id AS passage_id, rank, title, passage, question, score, first FROM sc WHERE question_id IN (SELECT question_id FROM w1 WHERE margin <= 0)),
ls AS (SELECT question_id, passage_id, question, unnest(a) AS text, generate_subscripts(a, 1) - 1 AS place FROM (SELECT question_id, passage_id, question, CASE WHEN len(a) > 64 THEN a[1:63] || [array_to_string(a[64:], ' ')] ELSE a END AS a FROM (
  SELECT question_id, passage_id, question, string_split(regexp_replace(regexp_replace(passage, '([.?!]) ([A-Z0-9"(])', '\\1' || chr(1) || '\\2', 'g'), '((?:^|\\s)[A-Z]\\S{{0,2}}\\.)\x01', '\\1 ', 'g'), chr(1)) AS a FROM lost))),
lp AS (SELECT question_id, passage_id * 64 + place AS passage_id, question, text FROM ls), {coverage_ctes(True, "l_", "lp")},
lb AS (SELECT question_id, passage_id // 64 AS passage_id, text, coalesce(coverage, 1.0) AS bc FROM lp LEFT JOIN l_cov USING (question_id, passage_id)
  QUALIFY row_number() OVER (PARTITION BY question_id, passage_id // 64 ORDER BY round(coalesce(coverage, 1.0), 9) DESC, passage_id % 64) = 1),
l2 AS MATERIALIZED (SELECT lost.*, bc, title || ': ' || text AS context FROM lost JOIN lb USING (question_id, passage_id)), {read_ctes("r2_", "l2", "context")},
a2 AS (SELECT *, trim(regexp_replace(lower(split_part(title, '(', 1)), '{_PUNCT}', '', 'g')) AS nt, regexp_replace(trim(regexp_replace(lower(answer), '{_PUNCT}', '', 'g')), '^the ', '') AS na FROM (
  SELECT question_id, rank, passage_id AS doc_id, title, {RESOLVED} AS answer, round(span_score - null_score, 6) AS margin, score, first, bc FROM l2 JOIN r2_read USING (question_id, passage_id) WHERE span <> '')),
s2 AS (SELECT *, round(margin + 12 * (score - first) + 15 * (bc - 1) + CASE WHEN {_TITLED} THEN 3 ELSE 0 END, 9) AS s2 FROM a2),
b2 AS (SELECT * FROM s2 WHERE margin > 0 QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY s2 DESC, rank) = 1),
final AS (SELECT w.question_id, b.rank IS NOT NULL AS again, coalesce(b.rank, w.rank) AS rank, coalesce(b.doc_id, w.doc_id) AS doc_id, coalesce(b.title, w.title) AS title, coalesce(b.answer, w.answer) AS answer,
  coalesce(b.margin, w.margin) AS margin, coalesce(b.s2, round(w.total, 9)) AS total FROM w1 w LEFT JOIN b2 b ON b.question_id = w.question_id AND b.s2 > round(w.total, 9))"""
_CHAIN = f"WITH {_CAND}, {_FORMS}, {_SC}, {_VOTE}, {_FINAL}"


@query("reader_fallback", f"{_CHAIN} SELECT question_id, rank, doc_id, answer, round(margin, 4) AS margin, round(s2, 4) AS sc FROM s2")
def reader_fallback(spark, sf_dir):
    """Where the winner's margin isn't positive, the best sentence of each candidate's passage is read alone."""
    return second(spark, sf_dir).select("question_id", "rank", "doc_id", "answer", F.round("margin", 4).alias("margin"), F.round("sc", 4).alias("sc"))


@query("answers_end_to_end", f"{_CHAIN} SELECT question_id, rank, doc_id, title, answer, round(margin, 4) AS margin, round(total, 4) AS total, again FROM final")
def answers_end_to_end(spark, sf_dir):
    """Retrieval, pre-ranking, reading, votes and, for questions without a convincing answer, second readings: one answer for each question."""
    rows = answers(spark, sf_dir)
    return rows.select("question_id", "rank", "doc_id", "title", "answer", F.round("margin", 4).alias("margin"), F.round("total", 4).alias("total"), "again")
