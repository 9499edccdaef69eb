"""Exact nearest vectors by blocked matrix products, and fusion with lexical scores under bounds.

Queries and rows meet on a grid: a query goes to its own column of blocks, a row to one line of them, so that a task holds one
block of queries and streams its rows past it. What leaves a task is at most k rows for each query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import vectors as V
from gleaner.operators import lexical as L
from gleaner.operators import retrieve as R
from gleaner.ship import ship

#: Queries of a block, which a task holds as a matrix with their best rows so far.
QUERY_BLOCK = 2048
#: Rows of a line of blocks, about; more lines than that are made if there are more cores.
ROW_BLOCK = 1 << 18
#: Scores that a task computes at once.
SCORES = 1 << 22
#: Decimals to which scores are rounded before they are ranked, so that ties don't depend on the order of a sum.
DIGITS = 9

_SCORED = "question_id long, passage_id long, score double"


class Best:
    """The k best rows of each query so far, by falling score, then rising id."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, scales: np.ndarray, k: int):
        self.ids, self.queries, self.scales, self.k = ids, queries, scales, k
        self.score = np.full((len(ids), k), -np.inf)
        self.row = np.full((len(ids), k), np.iinfo(np.int64).max)

    def add(self, ids: np.ndarray, rows: np.ndarray, scales: np.ndarray) -> None:
        step = max(1, SCORES // max(1, len(self.ids)))
        for at in range(0, len(ids), step):
            part = slice(at, at + step)
            score = np.round(self.queries @ rows[part].T * scales[part] * self.scales[:, None], DIGITS)
            self._merge(score, ids[part])

    def _merge(self, score: np.ndarray, ids: np.ndarray) -> None:
        """Only what reaches the k-th best score of both is sorted; ties at that score all are."""
        score = np.concatenate([self.score, score], axis=1)
        least = -np.partition(-score, self.k - 1, axis=1)[:, self.k - 1]
        query, column = np.nonzero((score >= least[:, None]) & np.isfinite(score))
        value = score[query, column]
        row = np.where(column < self.k, self.row[query, np.minimum(column, self.k - 1)], ids[np.maximum(column - self.k, 0)])
        order = np.lexsort((row, -value, query))
        query, value, row = query[order], value[order], row[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        kept = place < self.k
        self.score.fill(-np.inf)
        self.score[query[kept], place[kept]] = value[kept]
        self.row[query[kept], place[kept]] = row[kept]

    def rows(self) -> pa.RecordBatch:
        query, place = np.nonzero(np.isfinite(self.score))
        columns = self.ids[query], self.row[query, place], self.score[query, place]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["question_id", "passage_id", "score"])


def _matrix(batch: pa.RecordBatch, rows: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, vectors, scales) of some rows of a batch; all vectors have the same length."""
    part = batch.slice(rows.start, rows.stop - rows.start)
    vectors = part.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return part.column("id").to_numpy(), vectors.reshape(part.num_rows, -1), part.column("scale").to_numpy(zero_copy_only=False)


def _nearest(k: int) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, best = None, [], None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in ("line", "column", "side")], 1)
            edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                line, column, side = key[a].tolist()
                if (line, column) != now:
                    if best:
                        yield best.rows()
                    now, held, best = (line, column), [], None
                if side == 0:
                    held.append(_matrix(batch, slice(a, b)))
                elif held:
                    best = best or Best(*(np.concatenate(x) for x in zip(*held, strict=True)), k)
                    best.add(*_matrix(batch, slice(a, b)))
        if best:
            yield best.rows()

    return run


def nearest(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(question_id, passage_id, score, rank): of each query the k rows of greatest dot product times both scales.

    rows: passage_id, v, scale; queries: question_id, v, scale; all vectors of one length, none null. Scores are
    rounded to DIGITS and ties go to the lower passage_id. Fewer rows than k give fewer.
    """
    spark = ship(rows.sparkSession)
    n, asked = rows.count(), queries.count()
    lines = max(1, -(-n // ROW_BLOCK), min(spark.sparkContext.defaultParallelism, n // 256))
    columns = max(1, -(-asked // QUERY_BLOCK))
    side = lambda df, key, kind: df.select(F.lit(kind).alias("side"), F.col(key).cast("long").alias("id"), F.transform("v", lambda x: x.cast("double")).alias("v"), F.col("scale").cast("double").alias("scale"))
    place = lambda count: F.pmod(F.xxhash64("id"), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    q = side(queries, "question_id", 0).select("*", place(columns).alias("column"), every(lines).alias("line"))
    r = side(rows, "passage_id", 1).select("*", place(lines).alias("line"), every(columns).alias("column"))
    met = q.unionByName(r).repartition("line", "column").sortWithinPartitions("line", "column", "side")
    found = met.mapInArrow(_nearest(k), _SCORED)
    return R.top_k(found, k)


def lexical_top(lexical: DataFrame, k: int) -> DataFrame:
    return R.top_k(lexical.withColumn("score", F.round("lexical", DIGITS)), k).select("question_id", "passage_id", "lexical")


def fused_top(rows: DataFrame, queries: DataFrame, lexical: DataFrame, k: int, weight: float) -> DataFrame:
    """(question_id, passage_id, dense, lexical, score, rank): the k best passages by weight * dense + (1 - weight) * lexical / its greatest.

    A passage without lexical score counts 0 there. Only candidates are scored, and none that belongs to the best is
    missed: those of the k best by either score give a k-th best fused score t; any other passage has a dense score of at most the k-th
    best one, d, so it can reach t only if its lexical share is at least (t - weight * d) / (1 - weight), or if it has none and
    weight * d reaches t, which the k best by dense score already cover. rows and queries as for `nearest`; lexical: question_id,
    passage_id, lexical (0 or more, passages that have a vector).
    """
    dense = nearest(rows, queries, k).withColumnRenamed("score", "dense").drop("rank")
    most = lexical.groupBy("question_id").agg(F.max("lexical").alias("top"))
    floor = dense.groupBy("question_id").agg(F.min("dense").alias("floor"), F.count("*").alias("listed"))
    first = dense.select("question_id", "passage_id").unionByName(lexical_top(lexical, k).select("question_id", "passage_id")).distinct()
    share = F.when(F.col("top") > 0, F.coalesce("lexical", F.lit(0.0)) / F.col("top")).otherwise(0.0)

    def scored(pairs: DataFrame) -> DataFrame:
        """pairs (question_id, passage_id, lexical, top) with their dense and fused scores."""
        q = queries.select("question_id", F.col("v").alias("qv"), F.col("scale").alias("qs"))
        both = pairs.join(rows.select("passage_id", "v", "scale"), "passage_id").join(q, "question_id")
        both = both.withColumn("dense", V.dot(F.col("qv"), F.col("v")) * F.col("scale") * F.col("qs"))
        score = F.round(F.lit(weight) * F.col("dense") + F.lit(1.0 - weight) * share, DIGITS)
        return both.select("question_id", "passage_id", "dense", F.coalesce("lexical", F.lit(0.0)).alias("lexical"), score.alias("score"))

    first = first.persist()
    # Of all lexical pairs only those of the first candidates and those over the bound are kept; the sides they meet are small.
    theirs = lexical.join(L.small(first, 2_000_000), ["question_id", "passage_id"])
    known = first.join(theirs, ["question_id", "passage_id"], "left").join(most, "question_id", "left")
    known = scored(known).persist()
    kth = R.top_k(known, k).groupBy("question_id").agg(F.min("score").alias("t"))
    bound = kth.join(floor, "question_id").join(most, "question_id")
    # Scores are rounded, so the bound gives way by what rounding can add. A question with fewer than k dense rows has them all.
    enough = F.lit(weight) * F.col("floor") + F.lit(1.0 - weight) * share >= F.col("t") - 4 * 10.0**-DIGITS
    more = lexical.join(L.small(bound), "question_id").where((F.col("listed") >= k) & enough).select("question_id", "passage_id", "lexical", "top")
    more = more.join(L.small(first, 2_000_000), ["question_id", "passage_id"], "left_anti")
    return R.top_k(known.unionByName(scored(more)), k)
