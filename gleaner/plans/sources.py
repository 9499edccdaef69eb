"""Queries on sources, sinks and the stand-in models."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions import composing as K
from gleaner.functions import models as M
from gleaner.functions import routing as G
from gleaner.functions import text as T
from gleaner.functions import vectors as V
from gleaner.sources import formats as S
from gleaner.streaming.serve import stats as corpus_stats

from .binding import PASSAGES, articles, folder, passages, sql_tokens, table
from .registry import query


def _folder(spark) -> str:
    return folder(spark, "sources")


@query("index_roundtrip", f"WITH {PASSAGES} SELECT article_id, count(*) AS n, sum(length(text))::BIGINT AS chars FROM passages GROUP BY ALL")
def index_roundtrip(spark, sf_dir):
    folder = _folder(spark)
    S.write_index({"passages": passages(spark, sf_dir)}, folder)
    rows = S.open_index(spark, folder, {"passages": ["passage_id", "article_id", "text"]})["passages"]
    return rows.groupBy("article_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("tsv_roundtrip", "SELECT doc_id AS article_id, source || '/' || doc_id AS path, array_to_string(regexp_split_to_array(text, '\\s+')[1:3], ' ') AS title FROM documents")
def tsv_roundtrip(spark, sf_dir):
    folder = _folder(spark)
    S.write_tsv(articles(spark, sf_dir).select("article_id", "path", "title"), f"{folder}/articles")
    return S.read_tsv(spark, f"{folder}/articles", S.ARTICLES)


@query("tsv_passages", f"WITH {PASSAGES} SELECT article_id, md5(replace(text, chr(9), ' ')) AS digest FROM passages")
def tsv_passages(spark, sf_dir):
    folder = _folder(spark)
    S.write_tsv(passages(spark, sf_dir).select("article_id", "text"), f"{folder}/passages")
    return S.read_tsv(spark, f"{folder}/passages", S.PASSAGES).select("article_id", F.md5("text").alias("digest"))


@query("parse_tests", "SELECT 'block ' || (item_id % 3) AS block, split_part(text, ' ', 1) AS question, 2 AS n FROM benchmark")
def parse_tests(spark, sf_dir):
    """Test files made of the benchmark, one for each third: a block line, a comment, and question | accepted ; !flag lines."""
    b = table(spark, sf_dir, "benchmark").withColumn("file", F.concat(F.lit("f"), (F.col("item_id") % 3).cast("string")))
    name = F.concat(F.lit("## block "), (F.col("item_id") % 3).cast("string"))
    lines = F.array(F.concat(name, F.lit(" ")), F.lit("# comment"), F.lit(""), F.concat(F.split("text", " ")[0], F.lit(" | some answer ; !short ; ")))
    rows = b.select("file", "item_id", F.posexplode(lines).alias("k", "value")).select("file", (F.col("item_id") * 4 + F.col("k")).alias("line"), "value")
    return S.parse_tests(rows).select("block", "question", F.size("accepted").alias("n"))


@query("json_history", """SELECT conv_id, count(*) FILTER (WHERE text <> '') AS n_all, least(6, count(*) FILTER (WHERE text <> '')) AS n_kept, least(6, count(*)) - (count(*) FILTER (WHERE role <> 'assistant' AND rn <= 6)) AS assistant
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) GROUP BY ALL""")
def json_history(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("l"))
    body = F.to_json(F.transform("l", lambda x: F.struct(x.role.alias("role"), x.text.alias("text"))))
    rows = turns.select("conv_id", F.size("l").cast("long").alias("n_all"), S.history(body).alias("h"))
    return rows.select("conv_id", "n_all", F.size("h").cast("long").alias("n_kept"), F.size(F.filter("h", lambda t: t.role == "assistant")).cast("long").alias("assistant"))


@query("json_field", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_field(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("url_decode", "SELECT page_id, url, url || ' 100% %zz %4' AS broken FROM pages")
def url_decode(spark, sf_dir):
    """Encoded and decoded again, the plus sign as a space; a percent sign that begins no code stays."""
    broken = F.concat(F.url_encode("url"), F.lit("+100%+%zz+%4"))
    return table(spark, sf_dir, "pages").select("page_id", T.url_decoded(F.url_encode("url")).alias("url"), T.url_decoded(broken).alias("broken"))


@query("stats", f"WITH {PASSAGES} SELECT count(*) AS passages, count(DISTINCT article_id) AS articles, true AS ok, false AS chat FROM passages")
def stats(spark, sf_dir):
    return corpus_stats(passages(spark, sf_dir))


@query("hit_provenance", f"WITH {PASSAGES} SELECT passage_id, 'https://example.org/' || source || '/' || doc_id AS url FROM passages JOIN documents ON doc_id = article_id")
def hit_provenance(spark, sf_dir):
    return passages(spark, sf_dir).join(articles(spark, sf_dir), "article_id").select("passage_id", F.concat(F.lit("https://example.org/"), "path").alias("url"))


@query("line_tokens", f"WITH {PASSAGES} SELECT passage_id, len({sql_tokens('text')}) AS n FROM passages")
def line_tokens(spark, sf_dir):
    """The bulk line source: every line tokenised on its own."""
    return passages(spark, sf_dir).select("passage_id", F.size(T.tokens(F.col("text"))).cast("long").alias("n"))


@query("embed_standin")
def embed_standin(spark, sf_dir):
    """Rows only: a stand-in model."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", M.HashEmbedder().embed(F.col("text")).alias("v"))
    return rows.select("item_id", F.round(V.norm(F.col("v")), 4).alias("length"))


@query("read_standin")
def read_standin(spark, sf_dir):
    """Rows only: a stand-in model on each benchmark text and the document of its id."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("passage"))
    rows = table(spark, sf_dir, "benchmark").join(d, "item_id")
    return rows.select("item_id", M.OverlapReader().read(F.col("text"), F.col("passage")).alias("r")).select("item_id", "r.*")


@query("compose_standin")
def compose_standin(spark, sf_dir):
    """Rows only: a stand-in model."""
    none = F.array().cast("array<struct<role:string,text:string>>")
    prompt = K.prompt("Answer briefly.", none, F.col("text"), F.array().cast("array<string>"), G.mode(F.col("text")))
    return table(spark, sf_dir, "benchmark").select("item_id", M.EchoComposer().compose(prompt, K.token_budget(F.col("text"))).alias("reply"))
