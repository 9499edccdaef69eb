"""Corpus construction: pages to articles and passages, shuffling, partitioning, resuming, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import text as T


def page_passages(pages: DataFrame) -> DataFrame:
    """(page_id, paragraph, part, text): cleaned, merged and split paragraphs of html; pages without any give no rows."""
    merged = T.merged_forward(T.html_paragraphs(F.col("html")))
    rows = pages.select("page_id", F.posexplode(merged).alias("paragraph", "whole"))
    return rows.select("page_id", "paragraph", F.posexplode(T.packed_sentences(F.col("whole"))).alias("part", "text"))


def without_media(html: Column) -> Column:
    """Embedded base64 media and style elements removed."""
    out = F.regexp_replace(html, r"data:[a-z]+/[a-z0-9.+-]+;base64,[A-Za-z0-9+/=]+", "data:removed")
    return F.regexp_replace(out, r"(?s)<style[^>]*>.*?</style>", "")


def sanitised(title: Column) -> Column:
    return F.translate(title, "\t\n", "  ")


def shuffle_key(article: Column, seed: int = 20260906) -> Column:
    """32 bits that order articles as a shuffle with that seed would."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), article.cast("string"))), 1, 8), 16, 10).cast("long")


def shuffled(passages: DataFrame, seed: int = 20260906) -> DataFrame:
    """(row, ...): passages renumbered from 0 so that articles come in hash order and stay whole.

    A global numbering without one global sort: articles get their offset from a running sum inside
    256 hash ranges and over the ranges (one row each), passages from their article.
    """
    sizes = passages.groupBy("article_id").agg(F.count("*").alias("n")).withColumn("h", shuffle_key(F.col("article_id"), seed))
    sizes = sizes.withColumn("range", F.shiftright("h", 24))
    ranges = sizes.groupBy("range").agg(F.sum("n").alias("m"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("range", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("range").orderBy("h", "article_id").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.withColumn("own", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(ranges), "range")
    first = first.select("article_id", (F.col("base") + F.col("own")).alias("first"))
    number = F.row_number().over(Window.partitionBy("article_id").orderBy("passage_id")) - 1
    return passages.withColumn("number", number).join(first, "article_id").withColumn("row", F.col("first") + F.col("number")).drop("first", "number")


def parts(rows: DataFrame, n: int, total: int) -> DataFrame:
    """Adds part: contiguous blocks of ceil(total / n) rows."""
    return rows.withColumn("part", F.floor(F.col("row") / max(1, -(-total // n))).cast("int"))


def first_passages(passages: DataFrame) -> DataFrame:
    return passages.groupBy("article_id").agg(F.min("passage_id").alias("first_passage"))


def remaining(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumed run still has to do."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


#: Ranges of equal width into which numbering cuts its keys; a row for each is all that is put in one order.
RANGES = 1 << 16


def numbered(rows: DataFrame, key: str, name: str) -> DataFrame:
    """rows with `name`, the number of rows with a lower key (a whole number, never null, once each): counted over at most RANGES ranges, then inside them."""
    ends = rows.agg(F.min(key).alias("low"), F.max(key).alias("high")).first()
    low = ends.low or 0
    width = max(1, -(-((ends.high or 0) - low + 1) // RANGES))
    rows = rows.withColumn("range", F.floor((F.col(key) - low) / width))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy("range").agg(F.count("*").alias("m")).select("range", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("range").orderBy(key)) - 1
    return rows.withColumn("own", own).join(F.broadcast(ranges), "range").withColumn(name, F.col("base") + F.col("own")).drop("range", "own", "base")


def complete_prefix(rows: DataFrame, done: DataFrame) -> DataFrame:
    """(passage_id, article_id, row, new_article): what a partly finished run leaves whole.

    rows: passage_id, article_id, row, part; done: part, n (rows finished at the front of that part). Articles with an
    unfinished passage go. Articles are numbered anew from 0 in the order of their first row. Parts are as many as a run has workers; `start` and
    `done` have a row for each and are broadcast.
    """
    start = rows.groupBy("part").agg(F.min("row").alias("start"))
    marked = rows.join(F.broadcast(start), "part").join(F.broadcast(done), "part", "left")
    marked = marked.withColumn("finished", F.coalesce(F.col("row") - F.col("start") < F.col("n"), F.lit(False)))
    whole = marked.groupBy("article_id").agg(F.min("row").alias("first"), F.min("finished").alias("whole")).where("whole")
    anew = numbered(whole.select("article_id", "first"), "first", "new_article").select("article_id", "new_article")
    return marked.join(anew, "article_id").select("passage_id", "article_id", "row", "new_article")
