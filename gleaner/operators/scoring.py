"""BM25 inside the tasks that hold the passages: the best of each question leave a task, not all pairs of question and passage.

The index's rows lie passage by passage, so a passage's score is complete where it is read. Postings of asked terms reach the workers as
numbers; the questions that ask for a term, with their weights, go to them as arrays. A score is summed in the order of the terms,
so that equal passages have equal scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.config import DEFAULT, RetrievalConfig
from gleaner.operators import lexical as L
from gleaner.operators import plaintext as X
from gleaner.operators import postings as P
from gleaner.ship import ship

#: Weighted terms (question_id, term, weight) that are sent to the workers, at most; more are joined.
ASKED = 4_000_000
#: Scores that a task holds at once.
SCORES = 1 << 22
#: Decimals to which scores are rounded before they are ranked.
DIGITS = 9

_PAIRS = "question_id long, passage_id long, lexical double"
_POSTING = ("passage_id", "doclen", "tf", "code")


def _bags(ids: pa.Array, size: np.ndarray, tokens: pa.Array) -> pa.RecordBatch:
    """Each passage's distinct tokens with their numbers; passages without tokens go."""
    coded = tokens.dictionary_encode()
    most = max(1, len(coded.dictionary))
    key = np.repeat(np.arange(len(size)), size) * most + coded.indices.to_numpy(zero_copy_only=False)
    key, times = np.unique(key, return_counts=True)
    terms = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(key % most)), pa.array(times.astype(np.int64))], ["term", "tf"])
    kept = np.flatnonzero(size)
    ends = np.searchsorted(key // most, kept, "right")
    bags = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), terms)
    return pa.RecordBatch.from_arrays([ids.take(pa.array(kept)), pa.array(size[kept]), bags], ["passage_id", "doclen", "terms"])


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (passage_id, text, t), where t is null if the text is plain, or its tokens: how many tokens it has, and each distinct one with its number."""
    for batch in batches:
        given = batch.filter(batch.column("t").is_valid())
        lists = given.column("t")
        yield _bags(given.column("passage_id"), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten())
        plain = batch.filter(pc.and_(batch.column("text").is_valid(), batch.column("t").is_null()))
        for at, to in X.chunks(plain.column("text")):
            part = plain.slice(at, to - at)
            yield _bags(part.column("passage_id"), *X.tokens(part.column("text")))


class Weights:
    """The questions of each term code, as compressed rows, with weight * idf."""

    def __init__(self, code: np.ndarray, question: np.ndarray, part: np.ndarray):
        order = np.lexsort((question, code))
        self.ids, who = np.unique(question, return_inverse=True)
        self.who, self.part = who[order].astype(np.int32), part[order]
        self.at = np.searchsorted(code[order], np.arange(int(code.max(initial=-1)) + 2))


def _scores(w: Weights, rows: list[np.ndarray], avgdl: float, config: RetrievalConfig) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, scores: passages by questions) of postings (passage_id, doclen, tf, code) that lie passage by passage."""
    edges = np.flatnonzero(np.concatenate([[True], rows[0][1:] != rows[0][:-1], [True]]))
    step = max(1, SCORES // max(1, len(w.ids)))
    for k in range(0, len(edges) - 1, step):
        cut = edges[k : k + step + 1]
        ids, doclen, tf, code = (r[cut[0] : cut[-1]] for r in rows)
        row = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
        order = np.lexsort((code, row))
        row, doclen, tf, code = row[order], doclen[order], tf[order].astype(float), code[order]
        times = w.at[code + 1] - w.at[code]
        place = np.arange(int(times.sum())) + np.repeat(w.at[code] - (np.cumsum(times) - times), times)
        below = tf + config.k1 * (1.0 - config.b + config.b * doclen / avgdl)
        value = w.part[place] * np.repeat(tf, times) * (config.k1 + 1.0) / np.repeat(below, times)
        size = (len(cut) - 1) * len(w.ids)
        found = np.bincount(np.repeat(row, times) * len(w.ids) + w.who[place], value, size)
        yield ids[cut[:-1] - cut[0]], found.reshape(len(cut) - 1, len(w.ids))


class Best:
    """The k best passages of each question so far, by falling rounded score, then rising id."""

    def __init__(self, questions: int, k: int):
        self.k, self.least = k, np.full(questions, -np.inf)
        self.held: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, ids: np.ndarray, lexical: np.ndarray) -> None:
        row, who = np.nonzero((lexical > 0) & (np.round(lexical, DIGITS) >= self.least))
        self.held.append((who, ids[row], lexical[row, who]))
        self.size += len(row)
        if self.size > 2 * self.k * len(self.least) + (1 << 16):
            self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        who, ids, lexical = (np.concatenate(x) for x in zip(*self.held))
        score = np.round(lexical, DIGITS)
        order = np.lexsort((ids, -score, who))
        who, ids, lexical, score = who[order], ids[order], lexical[order], score[order]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        last = place == self.k - 1
        self.least[who[last]] = score[last]
        kept = place < self.k
        self.held, self.size = [(who[kept], ids[kept], lexical[kept])], int(kept.sum())
        return self.held[0]


def _scored(w: Weights, avgdl: float, k: int | None, config: RetrievalConfig) -> Callable:
    """All scores of questions and passages, or the k best of each question among a task's passages."""

    def out(who: np.ndarray, ids: np.ndarray, lexical: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(w.ids[who]), pa.array(ids), pa.array(lexical)], ["question_id", "passage_id", "lexical"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, held = Best(len(w.ids), k) if k else None, None

        def each(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for ids, lexical in _scores(w, rows, avgdl, config):
                if best:
                    best.add(ids, lexical)
                else:
                    row, who = np.nonzero(lexical)
                    yield out(who, ids[row], lexical[row, who])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in _POSTING]
            if held:
                rows = [np.concatenate(pair) for pair in zip(held, rows)]
            last = len(rows[0]) - int(np.argmax(np.append(rows[0][::-1] != rows[0][-1], True)))
            if last:  # the last passage may go on in the next batch
                yield from each([r[:last] for r in rows])
            held = [r[last:] for r in rows]
        if held:
            yield from each(held)
        if best and best.held:
            yield out(*best.cut())

    return run


def _pairs(weighted: DataFrame, index: L.Index, k: int | None, only: DataFrame | None, config: RetrievalConfig, postings: Callable | None = None) -> DataFrame | None:
    """(question_id, passage_id, lexical), or none if there are too many weighted terms for the workers.

    postings: from the asked terms (term, code) to their postings, passage by passage; those of the index, unless given.
    """
    spark = ship(weighted.sparkSession)
    asked = index.dfs.join(L.small(weighted), "term").select("question_id", "term", "df", "weight")
    found = asked.where("question_id is not null").limit(ASKED + 1).toArrow()
    stats = index.stats.first()
    if found.num_rows > ASKED:
        return None
    column = lambda c: found.column(c).to_numpy()
    terms = sorted(set(found.column("term").to_pylist()))
    table = pa.table({"term": pa.array(terms, pa.string()), "code": pa.array(np.arange(len(terms)))})
    code = found.column("term").combine_chunks().dictionary_encode()
    code = np.searchsorted(np.array(terms, object), np.array(code.dictionary.to_pylist(), object))[code.indices.to_numpy()] if terms else np.zeros(0, np.int64)
    part = column("weight") * np.log(1.0 + (stats.n - column("df") + 0.5) / (column("df") + 0.5))
    w = Weights(code, column("question_id"), part)
    codes = F.broadcast(spark.createDataFrame(table, "term string, code long"))
    if postings:
        return postings(codes).mapInArrow(_scored(w, stats.avgdl, k, config), _PAIRS)
    rows = index.tf.where("passage_id is not null")
    if only is not None:
        rows = rows.join(L.small(only, 5_000_000), "passage_id", "left_semi")
    found = rows.join(codes, "term").select(*(F.col(c).cast("long").alias(c) for c in _POSTING))
    return found.mapInArrow(_scored(w, stats.avgdl, k, config), _PAIRS)


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    rows = pairs.withColumn("score", F.round("lexical", DIGITS))
    own = Window.partitionBy("question_id").orderBy(F.desc("score"), "passage_id")
    return rows.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)


def bm25_top(weighted: DataFrame, index: L.Index, k: int, config: RetrievalConfig = DEFAULT) -> DataFrame:
    """(question_id, passage_id, lexical, score, rank): the k best passages of each question by score, which is lexical rounded; ties to the lower id."""
    found = _pairs(weighted, index, k, None, config) if index.whole else None
    return _ranked(L.bm25(weighted, index, config) if found is None else found, k)


def bm25(weighted: DataFrame, index: L.Index, only: DataFrame | None = None, config: RetrievalConfig = DEFAULT) -> DataFrame:
    """(question_id, passage_id, lexical) of every passage (of those in `only`, if given) that holds a weighted term, without a shuffle of pairs."""
    found = _pairs(weighted, index, None, only, config) if index.whole else None
    if found is None:
        found = L.bm25(weighted, index, config)
        found = found if only is None else found.join(only, "passage_id", "left_semi")
    return found


def bm25_top_of_blocks(weighted: DataFrame, blocks: DataFrame, index: L.Index, k: int, config: RetrievalConfig = DEFAULT) -> DataFrame:
    """As bm25_top, from posting blocks: the asked terms' postings, not their pairs with questions, are brought together by passage."""

    def postings(codes: DataFrame) -> DataFrame:
        found = P.read_blocks(blocks.join(codes, "term")).select(*(F.col(c).cast("long").alias(c) for c in _POSTING))
        return found.repartition("passage_id").sortWithinPartitions("passage_id")

    found = _pairs(weighted, index, k, None, config, postings)
    return _ranked(P.bm25(weighted, blocks, index, config) if found is None else found, k)
