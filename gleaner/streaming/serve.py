"""Answers a stream of questions from a folder and writes JSON replies, a batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleaner.operators import lexical as L
from gleaner.operators import retrieve as R


def answer_batch(questions: DataFrame, index: L.Index, k: int = 8) -> DataFrame:
    """(question_id, body): a JSON body with the best passages of each question."""
    terms = L.question_terms(questions).withColumn("weight", F.lit(1.0))
    hits = R.top_k(L.bm25(terms, index).withColumnRenamed("lexical", "score"), k)
    found = hits.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "passage_id", F.round("score", 3).alias("score")))).alias("hits"))
    out = questions.join(found, "question_id", "left")
    return out.select("question_id", F.to_json(F.struct(F.col("text").alias("question"), "hits")).alias("body"))


def serve(spark: SparkSession, inbox: str, outbox: str, checkpoint: str, tf: DataFrame | L.Index) -> StreamingQuery:
    """Reads JSON questions (question_id, text) as files arrive; a batch that is repeated overwrites its own output.

    tf: an index, best a saved one, or term frequencies, which every batch counts anew.
    """
    index = tf if isinstance(tf, L.Index) else L.Index.of(tf)
    stream = spark.readStream.schema("question_id long, text string").json(inbox)

    def each(batch: DataFrame, number: int) -> None:
        answer_batch(batch, index).write.mode("overwrite").json(f"{outbox}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stats(passages: DataFrame, chat: bool = False) -> DataFrame:
    return passages.agg(F.count("*").alias("passages"), F.count_distinct("article_id").alias("articles")).select("passages", "articles", F.lit(True).alias("ok"), F.lit(chat).alias("chat"))
