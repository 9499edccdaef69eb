"""Queries on page cleaning and corpus construction."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators import corpus as C

from .binding import PASSAGES, articles, passages, saved, table
from .registry import query


#: Entities that the tables' pages hold, in the SQL's order, the ampersand last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def _sql_clean(column: str) -> str:
    out = f"regexp_replace(regexp_replace(regexp_replace({column}, '<sup[^>]*class=\"[^\"]*reference[^\"]*\"[^>]*>.*?</sup>', '', 'gs'), '<span[^>]*class=\"[^\"]*mw-editsection[^\"]*\"[^>]*>.*?</span>', '', 'gs'), '<[^>]+>', '', 'g')"
    for name, char in ENTITIES:
        char = "''" if char == "'" else char
        out = f"replace({out}, '{name}', '{char}')"
    return f"replace(trim(regexp_replace(regexp_replace({out}, '\\(\\s*[;,]?\\s*\\)', '', 'g'), '\\s+', ' ', 'g')), '[edit]', '')"


_BODY = "html"
for _tag in ("script", "style", "table", "math"):
    _BODY = f"regexp_replace({_BODY}, '<{_tag}[^>]*>.*?</{_tag}>', '', 'gs')"
_PARAGRAPHS = f"""fr AS (SELECT page_id, regexp_extract_all({_BODY}, '<p(?:\\s[^>]*)?>(.*?)</p>', 1, 's') AS f FROM pages),
cl AS (SELECT page_id, list_transform(f, lambda x: {_sql_clean("x")}) AS c FROM fr),
pg AS (SELECT page_id, list_filter(c, lambda x: length(x) >= 20) AS p FROM cl)"""


@query("html_paragraphs", f"WITH {_PARAGRAPHS} SELECT page_id, unnest(p) AS text, generate_subscripts(p, 1) - 1 AS pos FROM pg")
def html_paragraphs(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(T.html_paragraphs(F.col("html"))).alias("pos", "text"))
    return rows.select("page_id", F.col("pos").cast("long").alias("pos"), "text")


@query("stub_pages", f"WITH {_PARAGRAPHS} SELECT page_id, len(p) AS paragraphs, len(p) = 0 AS stub FROM pg")
def stub_pages(spark, sf_dir):
    n = F.size(T.html_paragraphs(F.col("html")))
    return table(spark, sf_dir, "pages").select("page_id", n.cast("long").alias("paragraphs"), (n == 0).alias("stub"))


@query("article_ids", f"WITH {_PARAGRAPHS} SELECT page_id, row_number() OVER (ORDER BY page_id) - 1 AS article_id FROM pg WHERE len(p) > 0")
def article_ids(spark, sf_dir):
    """Dense ids in scan order of pages that aren't stubs, which are cleaned once and saved for the counts."""
    kept = lambda s, d: table(s, d, "pages").where(F.size(T.html_paragraphs(F.col("html"))) > 0).select("page_id")
    return C.numbered(saved(spark, sf_dir, "kept-pages", kept), "page_id", "article_id")


@query("merge_small", f"""WITH RECURSIVE {_PARAGRAPHS}, st AS (SELECT page_id, p, 0 AS i, []::VARCHAR[] AS o FROM pg
UNION ALL SELECT page_id, p, i + 1, CASE WHEN len(o) > 0 AND length(o[len(o)]) < 60 THEN o[1:(len(o) - 1)] || [o[len(o)] || ' ' || p[i + 1]] ELSE o || [p[i + 1]] END FROM st WHERE i < len(p))
SELECT page_id, len(o) AS n, md5(array_to_string(o, '|')) AS digest FROM st WHERE i = len(p)""")
def merge_small(spark, sf_dir):
    merged = table(spark, sf_dir, "pages").select("page_id", T.merged_forward(T.html_paragraphs(F.col("html"))).alias("o"))
    return merged.select("page_id", F.size("o").cast("long").alias("n"), F.md5(F.array_join("o", "|")).alias("digest"))


@query("split_long", f"""WITH RECURSIVE {PASSAGES}, mk AS (SELECT passage_id, text, string_split(regexp_replace(text, '([.!?])\\s+([A-Z0-9"''(])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS s FROM passages),
st AS (SELECT passage_id, s, 0 AS i, []::VARCHAR[] AS o, '' AS c FROM mk WHERE length(text) > 600
UNION ALL SELECT passage_id, s, i + 1, CASE WHEN c <> '' AND length(c) + 1 + length(s[i + 1]) > 600 THEN o || [c] ELSE o END,
  CASE WHEN c = '' OR length(c) + 1 + length(s[i + 1]) > 600 THEN s[i + 1] ELSE c || ' ' || s[i + 1] END FROM st WHERE i < len(s)),
fin AS (SELECT passage_id, CASE WHEN c <> '' THEN o || [c] ELSE o END AS o FROM st WHERE i = len(s) UNION ALL SELECT passage_id, [text] FROM mk WHERE length(text) <= 600)
SELECT passage_id, len(o) AS n, list_max(list_transform(o, lambda x: length(x))) AS longest FROM fin""")
def split_long(spark, sf_dir):
    rows = passages(spark, sf_dir).select("passage_id", T.packed_sentences(F.col("text")).alias("o"))
    return rows.select("passage_id", F.size("o").cast("long").alias("n"), F.array_max(F.transform("o", F.length)).cast("long").alias("longest"))


@query("page_passages", f"""WITH RECURSIVE {_PARAGRAPHS}, st AS (SELECT page_id, p, 0 AS i, []::VARCHAR[] AS o FROM pg
UNION ALL SELECT page_id, p, i + 1, CASE WHEN len(o) > 0 AND length(o[len(o)]) < 60 THEN o[1:(len(o) - 1)] || [o[len(o)] || ' ' || p[i + 1]] ELSE o || [p[i + 1]] END FROM st WHERE i < len(p)),
mg AS (SELECT page_id, unnest(o) AS text, generate_subscripts(o, 1) - 1 AS paragraph FROM st WHERE i = len(p)),
mk AS (SELECT page_id, paragraph, text, string_split(regexp_replace(text, '([.!?])\\s+([A-Z0-9"''(])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS s FROM mg),
sp AS (SELECT page_id, paragraph, s, 0 AS i, []::VARCHAR[] AS o, '' AS c FROM mk WHERE length(text) > 600
UNION ALL SELECT page_id, paragraph, s, i + 1, CASE WHEN c <> '' AND length(c) + 1 + length(s[i + 1]) > 600 THEN o || [c] ELSE o END,
  CASE WHEN c = '' OR length(c) + 1 + length(s[i + 1]) > 600 THEN s[i + 1] ELSE c || ' ' || s[i + 1] END FROM sp WHERE i < len(s)),
fin AS (SELECT page_id, paragraph, CASE WHEN c <> '' THEN o || [c] ELSE o END AS o FROM sp WHERE i = len(s) UNION ALL SELECT page_id, paragraph, [text] FROM mk WHERE length(text) <= 600)
SELECT page_id, paragraph::INT AS paragraph, (generate_subscripts(o, 1) - 1)::INT AS part, unnest(o) AS text FROM fin""")
def page_passages(spark, sf_dir):
    """The whole chain from pages to passages."""
    return C.page_passages(table(spark, sf_dir, "pages"))


@query("media_removed", "SELECT page_id, length(regexp_replace(regexp_replace(html, 'data:[a-z]+/[a-z0-9.+-]+;base64,[A-Za-z0-9+/=]+', 'data:removed', 'g'), '<style[^>]*>.*?</style>', '', 'gs')) AS n FROM pages")
def media_removed(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.length(C.without_media(F.col("html"))).cast("long").alias("n"))


@query("sentences", """SELECT doc_id, least(len(s), 64) AS n, length(s[1]) AS first_length, md5(array_to_string(CASE WHEN len(s) > 64 THEN s[1:63] || [array_to_string(s[64:], ' ')] ELSE s END, '|')) AS digest
FROM (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '([.?!]) ([A-Z0-9"(])', '\\1' || chr(1) || '\\2', 'g'),
'((?:^|\\s)[A-Z]\\S{0,2}\\.)\x01', '\\1 ', 'g'), chr(1)) AS s FROM (SELECT doc_id, replace(text, chr(10), '  ') AS text FROM documents))""")
def sentences(spark, sf_dir):
    """Sentences of whole texts; a text keeps at most 64, of which the last is the remainder."""
    text = F.replace("text", F.lit("\n"), F.lit("  "))
    found = table(spark, sf_dir, "documents").select("doc_id", T.sentences(text).alias("s"))
    return found.select("doc_id", F.size("s").cast("long").alias("n"), F.length(F.col("s")[0]).cast("long").alias("first_length"), F.md5(F.array_join("s", "|")).alias("digest"))


@query("article_shuffle_parts", f"""WITH {PASSAGES}, o AS (SELECT passage_id, article_id, row_number() OVER (ORDER BY substr(md5('20260906:' || article_id), 1, 8), article_id, passage_id) - 1 AS row FROM passages)
SELECT passage_id, row, (row // ((SELECT count(*) + 3 FROM passages) // 4))::INT AS part FROM o""")
def article_shuffle_parts(spark, sf_dir):
    rows = passages(spark, sf_dir)
    return C.parts(C.shuffled(rows), 4, rows.count()).select("passage_id", "row", "part")


@query("first_passage", f"WITH {PASSAGES} SELECT article_id, min(passage_id) AS first_passage FROM passages GROUP BY ALL")
def first_passage(spark, sf_dir):
    return C.first_passages(passages(spark, sf_dir))


@query("corpus_counts", f"WITH {PASSAGES} SELECT count(DISTINCT article_id) AS articles, count(*) AS passages, sum(length(text))::BIGINT AS chars, (SELECT count(*) FROM documents) - count(DISTINCT article_id) AS skipped FROM passages")
def corpus_counts(spark, sf_dir):
    counted = passages(spark, sf_dir).agg(F.count_distinct("article_id").alias("articles"), F.count("*").alias("passages"), F.sum(F.length("text")).alias("chars"))
    total = table(spark, sf_dir, "documents").agg(F.count("*").alias("all"))
    return counted.crossJoin(total).select("articles", "passages", "chars", (F.col("all") - F.col("articles")).alias("skipped"))


@query("embed_lines", f"WITH {PASSAGES} SELECT passage_id, md5(array_to_string(regexp_split_to_array(d.text, '\\s+')[1:3], ' ') || ': ' || p.text) AS digest FROM passages p JOIN documents d ON d.doc_id = p.article_id")
def embed_lines(spark, sf_dir):
    rows = passages(spark, sf_dir).join(articles(spark, sf_dir), "article_id")
    return rows.select("passage_id", F.md5(F.concat_ws(": ", C.sanitised(F.col("title")), "text")).alias("digest"))


@query("resume_remaining", f"WITH {PASSAGES} SELECT passage_id FROM passages WHERE article_id % 3 <> 0")
def resume_remaining(spark, sf_dir):
    """What is left after a run that had finished every third article."""
    rows = passages(spark, sf_dir)
    return C.remaining(rows, rows.where(F.col("article_id") % 3 == 0), "passage_id").select("passage_id")


@query("complete_prefix", f"""WITH {PASSAGES}, o AS (SELECT passage_id, article_id, row_number() OVER (ORDER BY substr(md5('20260906:' || article_id), 1, 8), article_id, passage_id) - 1 AS row FROM passages),
p AS (SELECT *, (row // ((SELECT count(*) + 3 FROM passages) // 4))::INT AS part FROM o), s AS (SELECT *, row - min(row) OVER (PARTITION BY part) AS in_part FROM p),
w AS (SELECT article_id, min(row) AS first FROM s GROUP BY ALL HAVING bool_and(in_part < 100 + 50 * part)), n AS (SELECT article_id, row_number() OVER (ORDER BY first) - 1 AS new_article FROM w)
SELECT passage_id, article_id, row, new_article FROM s JOIN n USING (article_id)""")
def complete_prefix(spark, sf_dir):
    """Part k has finished its first 100 + 50 k rows."""
    rows = passages(spark, sf_dir)
    done = spark.createDataFrame([(k, 100 + 50 * k) for k in range(4)], "part int, n long")
    return C.complete_prefix(C.parts(C.shuffled(rows), 4, rows.count()), done)
