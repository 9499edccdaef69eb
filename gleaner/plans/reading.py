"""The answer chain over retrieved documents, step by step, in Spark and in SQL: hits, first reading, votes, second reading.

The reader's logits are a stand-in, since its model is not at hand: numbers that follow from a token's place and the ids of question
and document. All else is the real chain: BM25, pre-ranking of 24 candidates by coverage and phrase, spans by
bytes of "title: text", echo tokens, votes, second readings of the best sentence for questions without a convincing answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.config import DEFAULT
from gleaner.functions import vectors as V
from gleaner.operators import answers as A
from gleaner.operators import lexical as L
from gleaner.operators import reading as N
from gleaner.operators import retrieve as R

from .binding import index, questions, saved, sql_pieces, sql_tokens, strings, table, title_of
from .dense import _HITS, _PHRASE, _Q, DOCS, _best, _embeddings, coverage_ctes

TITLE = "array_to_string(regexp_split_to_array(d.text, '\\s+')[1:3], ' ')"


def standin(tokens: DataFrame) -> DataFrame:
    """Logits of a token by its place and the ids of question and document; the null score by these ids and the number of tokens."""
    q, p, at = F.col("question_id"), F.col("passage_id"), F.col("place")
    part = lambda value, m: F.pmod(value, F.lit(m)) / 10.0
    return tokens.withColumns({"start": part(at * 37 + q * 11 + p * 7, 101), "end": part(at * 53 + q * 5 + p * 3, 97), "null_score": F.round(part(q * 13 + p * 29, 60) + F.pmod(q, F.lit(5)) * 4 + F.floor(F.col("n_tokens") / 40), 6)})


def _make_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _best(spark, sf_dir, DEFAULT.prerank_clamped)
    return hits.withColumn("base", F.col("lexical") / F.max("lexical").over(Window.partitionBy("question_id"))).select("question_id", "passage_id", "base")


def _make_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(question_id, passage_id, base, title, passage, question, text) of the 24 best documents, scored once and saved; titles are those of hits alone."""
    hits = saved(spark, sf_dir, "best", _make_best)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("passage_id"), F.col("text").alias("passage"))
    pairs = docs.join(L.small(hits), "passage_id").join(L.small(questions(spark, sf_dir).withColumnRenamed("text", "question")), "question_id")
    pairs = pairs.withColumn("title", title_of("passage"))
    return pairs.withColumn("text", F.concat("title", F.lit(": "), "passage"))


def _make_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(question_id, passage_id, rank, score, first, title, passage, question, coverage, phrase, dense): the eight best of 24 pre-ranked documents."""
    found = index(spark, sf_dir, "documents")
    pairs = saved(spark, sf_dir, "pairs", _make_pairs)
    rows = R.phrase_match(R.coverage(pairs, found.dfs, found.stats.select("n"), skip_short_unseen=True))
    score = R.prerank_score(F.col("base"), F.col("coverage"), F.col("phrase"))
    top = R.top_k(rows.withColumn("score", F.round(score, 9)), DEFAULT.read_top)
    top = top.withColumn("first", F.max("score").over(Window.partitionBy("question_id")))
    vectors = _embeddings(spark, sf_dir)
    q = vectors.select(F.col("vec_id").alias("question_id"), F.col("v").alias("qv"))
    d = vectors.select(F.col("vec_id").alias("passage_id"), F.col("codes").alias("dv"), "scale")
    top = top.join(q, "question_id", "left").join(d, "passage_id", "left")
    return top.select("question_id", "passage_id", F.col("rank").cast("long").alias("rank"), "score", "first", "title", "passage", "question", "coverage", "phrase", F.coalesce(V.dot(F.col("qv"), F.col("dv")) * F.col("scale"), F.lit(0.0)).alias("dense"))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return saved(spark, sf_dir, "hits", _make_hits)


def _make_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hits(spark, sf_dir)
    found = N.read(rows.withColumn("context", F.concat("title", F.lit(": "), "passage")), standin)
    found = found.select("question_id", "passage_id", F.col("answer").alias("span"), "span_score", "null_score")
    rows = rows.join(found, ["question_id", "passage_id"]).withColumn("answer", N.told(F.col("span"), F.col("title")))
    return rows.where("answer is not null").withColumn("margin", F.round(F.col("span_score") - F.col("null_score"), 6)).withColumnRenamed("passage_id", "doc_id")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits that gave an answer, with span (as read), answer (as told), span_score, null_score and margin; passage_id is doc_id here."""
    return saved(spark, sf_dir, "candidates", _make_candidates)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with titled and sc."""
    rows = candidates(spark, sf_dir).withColumn("titled", A.is_title(F.col("answer"), F.col("title")))
    sc = A.candidate_score(F.col("margin"), F.col("score"), F.col("first"), F.col("coverage"), F.col("phrase"), F.col("titled"))
    return rows.withColumn("sc", F.round(sc, 9))


def winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One candidate for each question, by votes."""
    return A.voted(scored(spark, sf_dir)).where("won").withColumn("total", F.round("total", 9))


def second(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(question_id, rank, doc_id, title, answer, margin, sc): readings of the best sentence alone, for questions whose winner's margin isn't positive."""
    lost = winners(spark, sf_dir).where("margin <= 0").select("question_id")
    rows = scored(spark, sf_dir).join(L.small(lost), "question_id", "left_semi").withColumnRenamed("doc_id", "passage_id")
    found = index(spark, sf_dir, "documents")
    best = R.best_sentences(rows.select("question_id", "passage_id", "question", F.col("passage").alias("text")), found.dfs, found.stats.select("n"), skip_short_unseen=True)
    best = best.select("question_id", "passage_id", F.col("coverage").alias("bc"), "best")
    rows = rows.select("question_id", "passage_id", "rank", "title", "question", "score", "first").join(best, ["question_id", "passage_id"])
    again = N.read(rows.withColumn("context", F.concat("title", F.lit(": "), "best")), standin)
    again = again.select("question_id", "passage_id", "answer", F.round(F.col("span_score") - F.col("null_score"), 6).alias("margin"))
    rows = rows.join(again, ["question_id", "passage_id"]).where("answer <> ''").withColumn("answer", A.resolved(F.col("answer"), F.col("title")))
    sc = A.candidate_score(F.col("margin"), F.col("score"), F.col("first"), F.col("bc"), F.lit(1.0), A.is_title(F.col("answer"), F.col("title")))
    return rows.select("question_id", "rank", F.col("passage_id").alias("doc_id"), "title", "answer", "margin", F.round(sc, 9).alias("sc"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(question_id, rank, doc_id, title, answer, margin, total, again): the winner, or the best second reading that beats it."""
    won = winners(spark, sf_dir).select("question_id", "rank", "doc_id", "title", "answer", "margin", "total")
    own = Window.partitionBy("question_id").orderBy(F.desc("sc"), "rank")
    best = second(spark, sf_dir).where("margin > 0").withColumn("n", F.row_number().over(own)).where("n = 1")
    best = best.select("question_id", F.struct("rank", "doc_id", "title", "answer", "margin", F.col("sc").alias("total")).alias("b"))
    rows = won.join(best, "question_id", "left").withColumn("again", F.coalesce(F.col("b.total") > F.col("total"), F.lit(False)))
    return rows.select("question_id", *(F.when(F.col("again"), F.col(f"b.{c}")).otherwise(F.col(c)).alias(c) for c in ("rank", "doc_id", "title", "answer", "margin", "total")), "again")


# The same in SQL. TOKEN and its pieces as in token_pieces; spans are told by pieces instead of bytes.
_CLIP = "regexp_replace(ANSWER[1:(CASE WHEN strlen(ANSWER) <= 500 THEN 500 ELSE len(list_filter(list_transform(range(1, 501), lambda i: strlen(ANSWER[1:i])), lambda b: b <= 500)) END)], '[ .,;]+$', '')"


def read_ctes(p: str, source: str, context: str) -> str:
    """CTEs that read `context` of `source` (question_id, passage_id, question, ...): {p}read (question_id, passage_id, span, span_score, null_score)."""
    return f"""{p}pc AS MATERIALIZED (SELECT question_id, passage_id, unnest(a) AS source, generate_subscripts(a, 1) - 1 AS n, asked FROM (SELECT question_id, passage_id, {sql_pieces(context)} AS a, {sql_tokens("question")}[1:62] AS asked FROM {source})),
{p}tk AS (SELECT question_id, passage_id, n, asked, list_contains(asked, token) AS echo, row_number() OVER (PARTITION BY question_id, passage_id ORDER BY n) - 1 AS pos FROM (SELECT *, strip_accents(lower(source)) AS token FROM {p}pc WHERE n % 2 = 1) WHERE token <> ''),
{p}lg AS (SELECT question_id, passage_id, n, pos, ((pos * 37 + question_id * 11 + passage_id * 7) % 101) / 10.0 AS s, ((pos * 53 + question_id * 5 + passage_id * 3) % 97) / 10.0 AS e, CASE WHEN echo THEN 0 ELSE 1 END AS own,
  sum(CASE WHEN echo THEN 0 ELSE 1 END) OVER (PARTITION BY question_id, passage_id ORDER BY pos) AS upto, count(*) OVER (PARTITION BY question_id, passage_id) AS size FROM {p}tk WHERE pos < 381 - len(asked)),
{p}sp AS (SELECT a.question_id, a.passage_id, a.size, a.n AS n1, b.n AS n2, round(a.s + b.e, 6) AS span_score FROM {p}lg a JOIN {p}lg b ON a.question_id = b.question_id AND a.passage_id = b.passage_id AND b.pos BETWEEN a.pos AND a.pos + 23
  WHERE b.upto - a.upto + a.own > 0 QUALIFY row_number() OVER (PARTITION BY a.question_id, a.passage_id ORDER BY round(a.s + b.e, 6) DESC, a.pos, b.pos) = 1),
{p}an AS (SELECT question_id, passage_id, span_score, size, string_agg(source, '' ORDER BY n) AS raw FROM {p}sp JOIN {p}pc USING (question_id, passage_id) WHERE n BETWEEN n1 AND n2 GROUP BY ALL),
{p}read AS (SELECT question_id, passage_id, {_CLIP.replace("ANSWER", "raw")} AS span, span_score, round(((question_id * 13 + passage_id * 29) % 60) / 10.0 + question_id % 5 * 4 + size // 40, 6) AS null_score FROM {p}an)"""


RESOLVED = f"CASE WHEN list_contains({strings(A.PRONOUNS)}, regexp_replace(lower(span), '[ .]+$', '')) THEN trim(split_part(title, '(', 1)) ELSE span END"
TOLD = "nullif(CASE WHEN starts_with(r, title || ':') THEN ltrim(r[(length(title) + 2):]) ELSE r END, '')"

_HITS24 = _HITS.replace("rank <= 8", f"rank <= {DEFAULT.prerank_clamped}")
HIT = f"""{_Q}, {DOCS}, {_HITS24}, pairs AS (SELECT question_id, passage_id, lexical / max(lexical) OVER (PARTITION BY question_id) AS base, b.text AS question, d.text AS passage, {TITLE} AS title, {TITLE} || ': ' || d.text AS text
  FROM hits JOIN benchmark b ON b.item_id = question_id JOIN documents d ON d.doc_id = passage_id), {coverage_ctes(True)}, {_PHRASE},
pre AS (SELECT pairs.*, coalesce(coverage, 1.0) AS coverage, coalesce(phrase, 0.0) AS phrase, round(base + 0.15 * coalesce(coverage, 1.0) + 0.3 * coalesce(phrase, 0), 9) AS score FROM pairs LEFT JOIN cov USING (question_id, passage_id) LEFT JOIN ph USING (question_id, passage_id)),
dn AS (SELECT o.vec_id AS question_id, c.vec_id AS passage_id, list_inner_product(o.v, c.codes) * c.scale AS dense FROM c, c o WHERE o.vec_id IN (SELECT item_id FROM benchmark)),
hit AS MATERIALIZED (SELECT question_id, passage_id, rank, score, max(score) OVER (PARTITION BY question_id) AS first, title, passage, question, text, coverage, phrase, coalesce(dense, 0.0) AS dense
  FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, passage_id) AS rank FROM pre) LEFT JOIN dn USING (question_id, passage_id) WHERE rank <= 8)"""
CAND = f"""{HIT}, {read_ctes("r1_", "hit", "text")},
cand AS (SELECT *, {TOLD} AS answer FROM (SELECT question_id, passage_id AS doc_id, rank, score, first, title, passage, question, coverage, phrase, dense, span, span_score, null_score, round(span_score - null_score, 6) AS margin, {RESOLVED} AS r
  FROM hit JOIN r1_read USING (question_id, passage_id)) WHERE {TOLD} IS NOT NULL)"""
