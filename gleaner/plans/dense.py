"""Queries on vectors, dense and hybrid retrieval, coverage, phrases and merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.config import DEFAULT
from gleaner.functions import text as T
from gleaner.functions import vectors as V
from gleaner.operators import dense as D
from gleaner.operators import lexical as L
from gleaner.operators import retrieve as R
from gleaner.operators import scoring as S

from .binding import index, questions, sql_question_terms, sql_related, sql_tokens, strings, table
from .lexical import BM25
from .registry import query

#: The stated query set of dense searches: every vector whose id is divisible by 20.
EVERY = 20


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    rows = rows.withColumn("scale", V.scale_of(F.col("v")))
    return rows.withColumn("codes", V.quantised(F.col("v"), F.col("scale")))


def _rows(vectors: DataFrame) -> DataFrame:
    """Quantised rows of an index: codes with their scale."""
    return vectors.select(F.col("vec_id").alias("passage_id"), "label", F.col("codes").alias("v"), "scale")


def _asked(vectors: DataFrame, codes: bool = False) -> DataFrame:
    """Query vectors as they are, or quantised like the rows."""
    if codes:
        return vectors.select(F.col("vec_id").alias("question_id"), F.col("codes").alias("v"), "scale")
    return vectors.select(F.col("vec_id").alias("question_id"), "v", F.lit(1.0).alias("scale"))


def _nearest(spark: SparkSession, sf_dir: str, k: int, codes: bool = False) -> DataFrame:
    """The k nearest rows of every query vector."""
    found = _embeddings(spark, sf_dir)
    return D.nearest(_rows(found), _asked(found.where(F.col("vec_id") % EVERY == 0), codes), k)


_Q = """e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
s AS (SELECT *, CASE WHEN list_max(list_transform(v, lambda x: abs(x))) = 0 THEN 1e-8 ELSE list_max(list_transform(v, lambda x: abs(x))) / 127.0 END AS scale FROM e),
c AS (SELECT *, list_transform(v, lambda x: greatest(-127, least(127, round_even(x / scale, 0)))) AS codes FROM s),
q AS (SELECT vec_id AS question_id, v AS qv, codes AS qc, scale AS qs FROM c WHERE vec_id % 20 = 0)"""
_RANK = "SELECT question_id, passage_id, rank, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, passage_id) AS rank FROM scored) WHERE rank <= 8"


def _ranked(scored: DataFrame) -> DataFrame:
    return _listed(R.top_k(scored.withColumn("score", F.round("score", 9)), 8))


def _listed(found: DataFrame) -> DataFrame:
    return found.select("question_id", "passage_id", F.col("rank").cast("long").alias("rank"), F.round("score", 4).alias("score"))


@query("quantize_rows", f"WITH {_Q} SELECT vec_id, round(scale, 9) AS scale, list_sum(codes)::BIGINT AS code_sum, list_sum(list_transform(codes, lambda x: x * x))::BIGINT AS code_square FROM c")
def quantize_rows(spark, sf_dir):
    add = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x)
    return _embeddings(spark, sf_dir).select("vec_id", F.round("scale", 9).alias("scale"), add(F.col("codes")).alias("code_sum"), add(F.transform("codes", lambda x: x * x)).alias("code_square"))


@query("dequantize_error", f"WITH {_Q} SELECT vec_id, round(list_max(list_transform(list_zip(v, codes), lambda p: abs(p[1] - p[2] * scale))), 7) AS worst, list_max(list_transform(list_zip(v, codes), lambda p: abs(p[1] - p[2] * scale))) <= scale / 2 + 1e-12 AS within FROM c")
def dequantize_error(spark, sf_dir):
    worst = F.array_max(F.zip_with("v", V.dequantised(F.col("codes"), F.col("scale")), lambda a, b: F.abs(a - b)))
    return _embeddings(spark, sf_dir).select("vec_id", worst.alias("w"), "scale").select("vec_id", F.round("w", 7).alias("worst"), (F.col("w") <= F.col("scale") / 2 + 1e-12).alias("within"))


_HALF = "round_even(X / pow(2, greatest(floor(log2(X)), -14) - 10), 0) * pow(2, greatest(floor(log2(X)), -14) - 10)"


@query("int4_groups", f"""WITH {_Q}, gr AS (SELECT vec_id, i, v[(32 * i + 1):(32 * i + 32)] AS part FROM e, (SELECT unnest([0, 1]) AS i)),
sc AS (SELECT *, CASE WHEN list_max(list_transform(part, lambda x: abs(x))) = 0 THEN 1e-8 ELSE list_max(list_transform(part, lambda x: abs(x))) / 7.0 END AS g FROM gr),
er AS (SELECT vec_id, list_max(list_transform(part, lambda x: abs(x - greatest(-7, least(7, round_even(x / g, 0))) * {_HALF.replace("X", "g")}))) AS worst FROM sc)
SELECT vec_id, round(max(worst), 6) AS worst FROM er GROUP BY vec_id""")
def int4_groups(spark, sf_dir):
    """The greatest error of int4 codes with half-precision scales, of groups of 32."""
    rows = _embeddings(spark, sf_dir).select("vec_id", "v", V.int4_groups(F.col("v")).alias("w"))
    return rows.select("vec_id", F.round(F.array_max(F.zip_with("v", "w", lambda a, b: F.abs(a - b))), 6).alias("worst"))


@query("dense_top8", f"WITH {_Q}, scored AS (SELECT question_id, vec_id AS passage_id, list_inner_product(qv, codes) * scale AS score FROM c, q) {_RANK}")
def dense_top8(spark, sf_dir):
    return _listed(_nearest(spark, sf_dir, 8))


@query("dense_int8_top8", f"WITH {_Q}, scored AS (SELECT question_id, vec_id AS passage_id, list_inner_product(qc, codes) * scale * qs AS score FROM c, q) {_RANK}")
def dense_int8_top8(spark, sf_dir):
    return _listed(_nearest(spark, sf_dir, 8, codes=True))


@query("article_capped", f"""WITH {_Q}, scored AS (SELECT question_id, vec_id AS passage_id, label AS article_id, round(list_inner_product(qv, codes) * scale, 9) AS score FROM c, q),
a AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, passage_id) AS r FROM scored), b AS (SELECT *, row_number() OVER (PARTITION BY question_id, article_id ORDER BY r) AS ra FROM a WHERE r <= 64)
SELECT question_id, passage_id, article_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY r) AS rank FROM b WHERE ra <= 2) WHERE rank <= 8""")
def article_capped(spark, sf_dir):
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("passage_id"), F.col("label").alias("article_id"))
    found = _nearest(spark, sf_dir, DEFAULT.candidates).drop("rank").join(labels, "passage_id")
    return R.diversified(found).select("question_id", "passage_id", "article_id", F.col("rank").cast("long").alias("rank"))


@query("pca_moments", """WITH x AS (SELECT vec_id, embedding[i]::DOUBLE AS x, i - 1 AS dim FROM embeddings, (SELECT unnest(range(1, 65)) AS i)),
c AS (SELECT a.dim AS i, b.dim AS j, covar_pop(a.x, b.x) AS covariance, avg(a.x) AS mean FROM x a JOIN x b ON a.vec_id = b.vec_id AND a.dim <= b.dim GROUP BY ALL)
SELECT i::INT AS i, j::INT AS j, round(mean, 6) + 0.0 AS mean, round(covariance, 6) + 0.0 AS covariance, round((SELECT sum(covariance) FROM c WHERE i = j), 6) AS trace FROM c""")
def pca_moments(spark, sf_dir):
    """Every mean and covariance over all rows, and the trace, from blocks' outer products."""
    from gleaner.operators.pca import covariances

    rows = covariances(table(spark, sf_dir, "embeddings").select(F.col("embedding").alias("v")), "v")
    trace = rows.where("i = j").agg(F.round(F.sum("covariance"), 6).alias("trace"))  # one row
    return rows.where("i <= j").crossJoin(F.broadcast(trace)).select("i", "j", (F.round("mean", 6) + 0.0).alias("mean"), (F.round("covariance", 6) + 0.0).alias("covariance"), "trace")  # no negative zero


@query("pca_project")
def pca_project(spark, sf_dir):
    """Rows only: the eigenvectors aren't SQL; a test compares squared components with another program. Centred, on 16 dimensions, normalised."""
    from gleaner.operators.pca import fit, project

    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("passage_id"), F.col("embedding").alias("v"))
    return project(rows, fit(rows, 16)).select("passage_id", F.round(V.norm(F.col("v")), 6).alias("length"), F.size("v").alias("dimensions"))


@query("mean_pool", """SELECT label, round(list_aggregate(list_transform(list_zip(m, m), lambda p: p[1] / (sqrt(list_inner_product(m, m)) + 1e-9)), 'max'), 5) AS largest, n FROM (
SELECT label, list(x ORDER BY i) AS m, max(n) AS n FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS x, count(*) AS n FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL) GROUP BY ALL)""")
def mean_pool(spark, sf_dir):
    """The mean of a label's vectors over all positions, divided by its length plus 1e-9."""
    rows = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = rows.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count("*").alias("n"))
    pooled = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("m"), F.max("n").alias("n"))
    return pooled.select("label", F.transform("m", lambda p: p.x).alias("m"), "n").select("label", F.round(F.array_max(V.unit(F.col("m"))), 5).alias("largest"), "n")


# A shared key for dense and lexical scores: vector i stands for document i's first line; others have no vector.
DOCS = f"""docs AS (SELECT doc_id AS passage_id, text FROM documents),
tf AS (SELECT passage_id, term, count(*) AS tf FROM (SELECT passage_id, unnest({sql_tokens("text")}) AS term FROM docs) GROUP BY ALL),
lengths AS (SELECT passage_id, sum(tf) AS doclen FROM tf GROUP BY ALL), stats AS (SELECT count(*) AS n, avg(doclen) AS avgdl FROM lengths), dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL)"""


def _weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.question_terms(questions(spark, sf_dir)).withColumn("weight", F.lit(1.0))


def _best(spark: SparkSession, sf_dir: str, most: int) -> DataFrame:
    """The best documents by BM25 for every benchmark text."""
    return S.bm25_top(_weighted(spark, sf_dir), index(spark, sf_dir, "documents"), most)


_HYBRID = f"""WITH {_Q}, {DOCS}, w AS (SELECT *, 1.0 AS weight FROM ({sql_question_terms()})), {BM25.replace("scored AS", "lex AS")},
dense AS (SELECT o.vec_id AS question_id, c.vec_id AS passage_id, c.label AS article_id, list_inner_product(o.v, c.codes) * c.scale AS dense FROM c, c o WHERE o.vec_id IN (SELECT item_id FROM benchmark)),
f AS (SELECT d.*, coalesce(lexical, 0) AS lexical FROM dense d LEFT JOIN lex USING (question_id, passage_id)),
fused AS (SELECT *, max(lexical) OVER (PARTITION BY question_id) AS top FROM f),
scored AS (SELECT question_id, passage_id, article_id, WEIGHT * dense + (1 - WEIGHT) * CASE WHEN top > 0 THEN lexical / top ELSE 0 END AS score FROM fused)"""


def _fused(spark: SparkSession, sf_dir: str, k: int, weight: float) -> DataFrame:
    """Every benchmark text with the vector of its id, against all passages that have one."""
    found = _embeddings(spark, sf_dir)
    items = questions(spark, sf_dir).select(F.col("question_id").alias("vec_id"))
    own = found.select(F.col("vec_id").alias("passage_id"))
    lexical = S.bm25(_weighted(spark, sf_dir), index(spark, sf_dir, "documents"), own)
    return D.fused_top(_rows(found), _asked(found.join(items, "vec_id", "left_semi")), lexical, k, weight)


@query("hybrid_top8", f"{_HYBRID.replace('WEIGHT', '0.6')} {_RANK}")
def hybrid_top8(spark, sf_dir):
    return _listed(_fused(spark, sf_dir, 8, DEFAULT.dense_weight))


@query("hybrid_wide_capped", f"""{_HYBRID.replace('WEIGHT', '0.75')}, a AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, passage_id) AS r FROM scored),
b AS (SELECT *, row_number() OVER (PARTITION BY question_id, article_id ORDER BY r) AS ra FROM a WHERE r <= 64)
SELECT question_id, passage_id, rank, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY r) AS rank FROM b WHERE ra <= 2) WHERE rank <= 8""")
def hybrid_wide_capped(spark, sf_dir):
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("passage_id"), F.col("label").alias("article_id"))
    found = R.diversified(_fused(spark, sf_dir, DEFAULT.candidates, DEFAULT.dense_weight_wide).drop("rank").join(labels, "passage_id"))
    return found.select("question_id", "passage_id", F.col("rank").cast("long").alias("rank"), F.round("score", 4).alias("score"))


# Coverage, phrase and pre-ranking take each benchmark text with the eight documents that BM25 retrieves for it.
_HITS = f"""w AS (SELECT *, 1.0 AS weight FROM ({sql_question_terms()})), {BM25.replace("scored AS", "lex AS")},
hits AS (SELECT question_id, passage_id, lexical, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(lexical, 9) DESC, passage_id) AS rank FROM lex) WHERE rank <= 8)"""
_PAIR = f"""{_HITS}, pairs AS (SELECT question_id, passage_id, lexical / max(lexical) OVER (PARTITION BY question_id) AS base, b.text AS question, d.text AS text
FROM hits JOIN benchmark b ON b.item_id = question_id JOIN documents d ON d.doc_id = passage_id)"""


def _text_pairs(spark: SparkSession, sf_dir: str, most: int = 8) -> DataFrame:
    """(question_id, passage_id, base, question, text) of the best documents; base is their share of the best BM25 score."""
    hits = _best(spark, sf_dir, most)
    hits = hits.withColumn("base", F.col("lexical") / F.max("lexical").over(Window.partitionBy("question_id"))).select("question_id", "passage_id", "base")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("passage_id"), "text")
    return docs.join(L.small(hits), "passage_id").join(L.small(questions(spark, sf_dir).withColumnRenamed("text", "question")), "question_id")


def _coverage_sql(skip: bool) -> str:
    return f"{DOCS}, {_PAIR}, {coverage_ctes(skip)}"


def coverage_ctes(skip: bool, p: str = "", pairs: str = "pairs") -> str:
    """CTEs up to {p}cov (question_id, passage_id, coverage) of `pairs` (question_id, passage_id, question, text)."""
    rule = "WHERE df IS NOT NULL OR strlen(term) > 3" if skip else ""
    return f"""{p}qt AS (SELECT DISTINCT question_id, passage_id, term FROM (SELECT question_id, passage_id, unnest({sql_tokens("question")}[1:128]) AS term FROM {pairs})
  WHERE NOT list_contains({strings(T.STOP_WORDS)}, term)),
{p}ht AS (SELECT DISTINCT question_id, passage_id, held FROM (SELECT question_id, passage_id, unnest({sql_tokens("text")}[1:512]) AS held FROM {pairs})),
{p}m AS (SELECT DISTINCT question_id, passage_id, term FROM {p}qt JOIN {p}ht USING (question_id, passage_id) WHERE {sql_related("term", "held")}),
{p}cov AS (SELECT question_id, passage_id, sum(CASE WHEN {p}m.term IS NOT NULL THEN idf ELSE 0 END) / sum(idf) AS coverage FROM (
  SELECT question_id, passage_id, term, ln(1 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) AS idf FROM {p}qt LEFT JOIN dfs USING (term), stats {rule}) x
  LEFT JOIN {p}m USING (question_id, passage_id, term) GROUP BY ALL)"""


_COVERAGE = "SELECT question_id, passage_id, round(coalesce(coverage, 1.0), 4) AS coverage FROM pairs LEFT JOIN cov USING (question_id, passage_id)"


def _covered(spark: SparkSession, sf_dir: str, skip: bool) -> DataFrame:
    found = index(spark, sf_dir, "documents")
    return R.coverage(_text_pairs(spark, sf_dir), found.dfs, found.stats.select("n"), skip)


@query("coverage", f"WITH {_coverage_sql(False)} {_COVERAGE}")
def coverage(spark, sf_dir):
    return _covered(spark, sf_dir, False).select("question_id", "passage_id", F.round("coverage", 4).alias("coverage"))


@query("coverage_ext", f"WITH {_coverage_sql(True)} {_COVERAGE}")
def coverage_ext(spark, sf_dir):
    return _covered(spark, sf_dir, True).select("question_id", "passage_id", F.round("coverage", 4).alias("coverage"))


_PHRASE = f"""qp AS (SELECT question_id, passage_id, list_filter(q0, lambda t, i: i > 0) AS q0, text FROM (SELECT question_id, passage_id, {sql_tokens("question")}[1:128] AS q0, text FROM pairs)),
q1 AS (SELECT *, coalesce(list_max(list_filter(list_transform(q0, lambda t, i: CASE WHEN t <> '?' THEN i END), lambda i: i IS NOT NULL)), 0) AS stop FROM qp),
q2 AS (SELECT *, q0[1:stop] AS qs FROM q1),
q3 AS (SELECT *, list_min(list_filter(list_transform(qs, lambda t, i: CASE WHEN NOT list_contains({strings(R.LEAD_WORDS)}, t) THEN i END), lambda i: i IS NOT NULL)) AS start FROM q2),
qw AS (SELECT question_id, passage_id, CASE WHEN start IS NULL OR len(qs) = 0 THEN [] ELSE qs[start:] END AS qt, {sql_tokens("text")}[1:512] AS tt FROM q3),
qa AS (SELECT question_id, passage_id, len(qt) AS n, unnest(qt) AS token, generate_subscripts(qt, 1) AS i FROM qw), ta AS (SELECT question_id, passage_id, unnest(tt) AS token, generate_subscripts(tt, 1) AS j FROM qw),
mt AS (SELECT question_id, passage_id, n, i, j - i AS d, i - row_number() OVER (PARTITION BY question_id, passage_id, j - i ORDER BY i) AS g FROM qa JOIN ta USING (question_id, passage_id, token)),
ph AS (SELECT question_id, passage_id, max(c / n) AS phrase FROM (SELECT question_id, passage_id, n, d, g, count(*) AS c FROM mt GROUP BY ALL) GROUP BY ALL)"""


@query("phrase_match", f"WITH {DOCS}, {_PAIR}, {_PHRASE} SELECT question_id, passage_id, round(coalesce(phrase, 0), 4) AS phrase FROM pairs LEFT JOIN ph USING (question_id, passage_id)")
def phrase_match(spark, sf_dir):
    return R.phrase_match(_text_pairs(spark, sf_dir)).select("question_id", "passage_id", F.round("phrase", 4).alias("phrase"))


# Messages of two questions: each benchmark text and the first eight words of the next one.
_TWO = """two AS (SELECT b.item_id, b.text || '? and ' || coalesce(array_to_string(regexp_split_to_array(n.text, '\\s+')[1:8], ' '), '') AS text FROM benchmark b LEFT JOIN benchmark n ON n.item_id = b.item_id + 1),
part2 AS (SELECT item_id, regexp_replace(regexp_extract(text, '\\?[\\s,]*(.*)', 1, 's'), '^(?i:and )', '') AS text FROM two)"""


def _ranked_ctes(p: str, source: str) -> str:
    """{p}r (question_id, passage_id, rank): the eight best documents for the texts of `source` (item_id, text)."""
    scored = BM25.replace("scored AS", f"{p}s AS").replace("FROM w ", f"FROM {p}w ")
    return f"""{p}w AS (SELECT *, 1.0 AS weight FROM ({sql_question_terms(table=source)})), {scored},
{p}r AS (SELECT question_id, passage_id, row_number() OVER (PARTITION BY question_id ORDER BY round(lexical, 9) DESC, passage_id) AS rank FROM {p}s QUALIFY rank <= 8)"""


@query("interleave_two", f"""WITH {DOCS}, {_TWO}, {_ranked_ctes("a_", "two")}, {_ranked_ctes("b_", "(SELECT * FROM part2 WHERE strlen(text) >= 6)")},
p AS (SELECT question_id, passage_id, min(place) AS place FROM (SELECT question_id, passage_id, rank * 2 AS place FROM a_r UNION ALL SELECT question_id, passage_id, rank * 2 + 1 FROM b_r) GROUP BY ALL)
SELECT question_id, passage_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY place) AS rank FROM p) WHERE rank <= 8""")
def interleave_two(spark, sf_dir):
    """A message's own eight best documents and those of its second question, by turns."""
    items, found = questions(spark, sf_dir), index(spark, sf_dir, "documents")
    after = items.select((F.col("question_id") - 1).alias("question_id"), F.array_join(F.slice(F.split("text", r"\s+"), 1, 8), " ").alias("next"))
    two = items.join(after, "question_id", "left").select("question_id", F.concat("text", F.lit("? and "), F.coalesce("next", F.lit(""))).alias("text"))
    second = two.select("question_id", T.second_question(F.col("text")).alias("text")).where("text is not null")

    def ranked(texts: DataFrame) -> DataFrame:
        return S.bm25_top(L.question_terms(texts).withColumn("weight", F.lit(1.0)), found, DEFAULT.top)

    return R.interleaved(ranked(two), ranked(second)).withColumn("rank", F.col("rank").cast("long"))


_SENT = f"""{_HITS}, sent AS (SELECT question_id, passage_id, question, unnest(s) AS text, generate_subscripts(s, 1) - 1 AS place FROM (
  SELECT question_id, passage_id, question, CASE WHEN len(s) > 64 THEN s[1:63] || [array_to_string(s[64:], ' ')] ELSE s END AS s FROM (SELECT question_id, passage_id, b.text AS question,
  string_split(regexp_replace(regexp_replace(d.text, '([.?!]) ([A-Z0-9"(])', '\\1' || chr(1) || '\\2', 'g'), '((?:^|\\s)[A-Z]\\S{{0,2}}\\.)\x01', '\\1 ', 'g'), chr(1)) AS s
  FROM hits JOIN benchmark b ON b.item_id = question_id JOIN documents d ON d.doc_id = passage_id WHERE rank = 1))),
pairs AS (SELECT question_id, passage_id * 64 + place AS passage_id, question, text FROM sent)"""


@query("best_sentence", f"""WITH {_coverage_sql(False).replace(_PAIR, _SENT)}, c AS (SELECT question_id, passage_id // 64 AS passage_id, passage_id % 64 AS place, text, round(coalesce(coverage, 1.0), 9) AS coverage FROM pairs LEFT JOIN cov USING (question_id, passage_id)),
l AS (SELECT *, lag(text) OVER w AS b, lead(text) OVER w AS a FROM c WINDOW w AS (PARTITION BY question_id, passage_id ORDER BY place))
SELECT question_id, passage_id, place::INT AS place, md5(text) AS best, md5(concat_ws(' ', b, text)) AS with_previous, md5(concat_ws(' ', text, a)) AS with_next FROM l QUALIFY row_number() OVER (PARTITION BY question_id, passage_id ORDER BY coverage DESC, place) = 1""")
def best_sentence(spark, sf_dir):
    """The reader's windows over the whole text of each benchmark text's best document."""
    found = index(spark, sf_dir, "documents")
    found = R.best_sentences(_text_pairs(spark, sf_dir, 1), found.dfs, found.stats.select("n"))
    return found.select("question_id", "passage_id", "place", F.md5("best").alias("best"), F.md5("with_previous").alias("with_previous"), F.md5("with_next").alias("with_next"))
