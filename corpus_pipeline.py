"""Corpus pipeline: quality, near-duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import decontaminate, importance, minhash, packing, suffixes
from gleaner.llm.common import Scratch, rows_matching, small, table
from gleaner.llm.queries import vocabulary

#: Some stages decide by statistics of the whole corpus and by components; SQL can't express them.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows that importance resampling keeps, told apart by id and text; a null id is an id like others."""
    return rows_matching(docs, importance.resample(docs, table(spark, sf_dir, "labels")), "left_semi")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group, that with the smallest id; rows with a null id, which link with nothing, stay."""
    return minhash.without_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes text that a 200-byte string covers which also starts elsewhere."""
    out = suffixes.remove_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in out.columns else out


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose text holds a benchmark item, whatever their id: a text goes by its hash here."""
    name = F.xxhash64(docs["text"].cast("string"))
    texts = docs.select(name.alias("doc_id"), docs["text"].cast("string").alias("text"))
    found = Scratch(spark, "leaks").save(decontaminate.leaks(texts, table(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "names")
    return docs.join(small(found), name == found["doc_id"], "left_anti")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 token ids; rows with a null id or text are packed like others."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), end_id=0, limits=packing.DOCUMENT_LIMITS, prompt_share=packing.DOCUMENT_PROMPT)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
