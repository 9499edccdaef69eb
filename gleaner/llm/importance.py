"""Quality by importance resampling with hashed n-gram models and Gumbel top-k.

Two bag-of-n-grams models over BUCKETS hashed unigrams and bigrams (letter case and punctuation kept):
the raw one counts every document, the target one the documents labelled good in half of a bounded
hash sample of labels; the target is smoothed by an equal part of the raw model. A document's log weight is its mean log ratio of the smoothed models times EFFECTIVE, so that
long texts don't outweigh short ones; words alone carry no ratio where a text has none (weight 0).

Gumbel top-k: to every log weight a Gumbel variate of the document's id is added, and the k greatest are
kept, which samples k documents without replacement in proportion to their weights. k is the number
of documents whose weight alone reaches the cut that best parts good from bad labels in the sample's other half
(a lost good share costs GOOD_COST times a kept bad share; of equal cuts the lowest). The k-th key is found by counting key buckets, a radix
selection, so no task sorts the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grams
from .common import Scratch, trimmed

BUCKETS = 1 << 16
EFFECTIVE = 200.0
#: Labelled rows that the target model and the cut are fitted on, at most (16 bytes each are broadcast).
SAMPLE_ROWS = 40_000
#: How much worse it is to lose a share of the good documents than to keep the same share of the bad.
GOOD_COST = 10.0
_SCALE = 1 << 16
_LOW_BITS = 16


def _ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every unigram and bigram, and whose it is."""
    h, at = grams.words(data, offsets, lower=False)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    same = owner[1:] == owner[:-1]
    two = grams.mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])[same]
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    return (np.concatenate([h, two]) >> shift).astype(np.int64), np.concatenate([owner, owner[1:][same]])


def checks(ids: pa.Array) -> np.ndarray:
    """Half of the ids: labels of these fit the cut, those of the others the target model."""
    key = ids.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return (grams.mix(key + np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(63)) == 1


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        good = (batch.column(2).to_numpy(zero_copy_only=False) == 1) & ~checks(batch.column(0))
        for i, data, offsets in grams.slices(batch.column(1)):
            bucket, owner = _ngrams(data, offsets)
            raw += np.bincount(bucket, minlength=BUCKETS)
            target += np.bincount(bucket[good[i + owner]], minlength=BUCKETS)
    some = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], ["bucket", "raw", "target"])


def _weigh(ratio) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ratio.value
        for batch in batches:
            for i, data, offsets in grams.slices(batch.column(1)):
                n = len(offsets) - 1
                bucket, owner = _ngrams(data, offsets)
                size = np.bincount(owner, minlength=n)
                weight = EFFECTIVE * np.bincount(owner, table[bucket], n) / np.maximum(size, 1)
                ids = batch.column(0).slice(i, n)
                key = grams.mix(ids.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) + np.uint64(0xA0761D6478BD642F))
                u = ((key >> np.uint64(12)).astype(np.float64) + 0.5) / 2.0**52
                rank = np.round((weight - np.log(-np.log(u))) * _SCALE).astype(np.int64)
                y = np.where(checks(ids), batch.column(2).slice(i, n).to_numpy(zero_copy_only=False), -1).astype(np.int32)
                columns = [ids, batch.column(3).slice(i, n), pa.array(y), pa.array(size), pa.array(weight), pa.array(rank)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "y", "n_ngrams", "log_weight", "rank"])

    return run


def ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The log ratio of the models for each bucket; 0 everywhere without target counts."""
    if not target.sum():
        return np.zeros(len(raw))
    p = (raw + 1.0) / (raw.sum() + len(raw))
    return np.log((target / target.sum() / p + 1.0) / 2.0)


def best_cut(good: np.ndarray, bad: np.ndarray) -> float | None:
    """The weight at which keeping everything not below it costs least; None without both kinds."""
    if not len(good) or not len(bad):
        return None
    good, bad = np.sort(good), np.sort(bad)
    cuts = np.unique(np.concatenate([good, bad]))
    error = GOOD_COST * np.searchsorted(good, cuts) / len(good) + 1 - np.searchsorted(bad, cuts) / len(bad)
    k = int(np.argmin(error))
    # Halfway to the next lower weight, which doubts in favour of documents.
    return float((cuts[k] + cuts[k - 1]) / 2 if k else cuts[k])


def kth(weights: DataFrame, k: int) -> tuple[int, int | None]:
    """(rank, id): the k-th row in the order of falling rank and rising id; id None: all of that rank."""
    high = F.shiftright("rank", _LOW_BITS)
    for within in (None, True):
        if within is None:
            counts = weights.groupBy(high.alias("b")).count().collect()
        else:
            counts = weights.where(high == top).groupBy(F.col("rank").alias("b")).count().collect()
        for row in sorted(counts, key=lambda x: -x.b):
            top = row.b
            if k <= row["count"]:
                break
            k -= row["count"]
    ids = weights.where(F.col("rank") == top).select("doc_id").orderBy(F.asc_nulls_last("doc_id")).limit(k)
    return top, ids.agg(F.max("doc_id")).first()[0] if k < row["count"] else None


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The kept documents: doc_id, n_ngrams, log_weight, kept (always true) and text_hash (xxhash64 of the text).

    Null, empty and word-less texts have weight 0 and take part like others. Rows of one id have one
    Gumbel variate; equal rows stay or go together, so the result may exceed k by repeated rows. Without
    good and bad labels nothing can be told apart and all documents stay. Labels with null ids or other
    values than 0 and 1 don't count; of an id's labels the least counts. No documents: no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "importance")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
    known = known.where("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.min("y").alias("y"))
    known = scratch.save(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS), "known")
    rows = docs.join(F.broadcast(known), "doc_id", "left").select("doc_id", "text", F.coalesce("y", F.lit(-1)).alias("y"), F.xxhash64("text").alias("text_hash"))
    counted = rows.mapInArrow(trimmed(_count), "bucket long, raw long, target long")
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for row in counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():
        raw[row.bucket], target[row.bucket] = row.raw, row.target
    ratio = spark.sparkContext.broadcast(ratios(raw, target))
    weights = rows.mapInArrow(trimmed(_weigh(ratio)), "doc_id long, text_hash long, y int, n_ngrams long, log_weight double, rank long")
    weights = scratch.save(weights, "weights")
    seen = weights.where("y >= 0").groupBy("doc_id").agg(F.max("y").alias("y"), F.min("log_weight").alias("log_weight")).collect()  # at most SAMPLE_ROWS
    cut = best_cut(*(np.array([r.log_weight for r in seen if r.y == y]) for y in (1, 0)))
    k = weights.where(F.col("log_weight") >= cut).count() if cut is not None else None
    kept = weights
    if k == 0:
        kept = weights.limit(0)
    elif k is not None:
        rank, last = kth(weights, k)
        tie = F.col("rank") == rank
        kept = weights.where((F.col("rank") > rank) | (tie if last is None else tie & (F.col("doc_id") <= last)))
    return kept.select("doc_id", "n_ngrams", "log_weight", F.lit(True).alias("kept"), "text_hash")
