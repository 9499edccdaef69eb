"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word counts as itself and as its character n-grams (4 to 7 bytes, with word ends marked), hashed into
BUCKETS rows of an embedding table, so an unseen misspelling shares most rows with the words that it
comes from. A text is the weighted average of its rows; frequent rows weigh less, by the usual
word-vector subsampling rate sqrt(t / frequency). Embeddings and softmax are trained together by
Adagrad on a bounded hash sample of labelled texts. The softmax is linear, so after training each
row has one number, a word is a sum, and a text's score a ratio of two sums over its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grams
from .common import prepared, trimmed

BUCKETS = 1 << 18
GRAMS = (4, 5, 6, 7)
DIMENSIONS = 4
#: Labelled texts to learn from, at most, and characters of all of them together.
SAMPLE_ROWS = 4_000
SAMPLE_CHARS = 14_000_000
#: Steps of 64 texts that training takes, at least; a small sample is passed over more often.
STEPS = 1_000
#: A row must occur in this many texts of the sample to be learned, in fewer if the sample is small; others are ignored.
LEAST_TEXTS = 10
#: How much more a toxic text counts in training, since few are.
TOXIC_WEIGHT = 3.0
#: Pull of embeddings towards zero.
DECAY = 2e-5
#: Distinct words whose sums a worker keeps.
CACHE = 500_000
#: Weight of a neutral row in every text, which keeps very short texts from extremes.
NEUTRAL = 20.0
#: Punctuation that separates words; "@", "$", "*", "'", "-" and "_" also stand inside disguised words and stay.
_SPACED = bytes(32 if k < 127 and not chr(k).isalnum() and chr(k) not in "@$*'-_" else k for k in range(256))
_VALUE = grams.stream(41, 256)


def rows_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The table rows of words (their own and their n-grams'), and whose each is, for many words at once."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = np.array([len(w) for w in words], np.int64) + 2
    end = np.cumsum(size)
    code = _VALUE[np.frombuffer(b"<" + b"><".join(words) + b">", np.uint8)]
    owner = np.repeat(np.arange(len(words)), size)
    left = end[owner] - np.arange(len(code))  # bytes to the word's end
    up, down = grams._powers(len(code))
    total = np.zeros(len(code) + 1, np.uint64)
    np.cumsum(code * up, out=total[1:])
    at = [end - size, *(np.flatnonzero(left >= n) for n in GRAMS)]
    to = [end, *(x + n for x, n in zip(at[1:], GRAMS, strict=True))]
    kind = np.repeat(np.arange(len(at), dtype=np.uint64), [len(x) for x in at])
    at, to = np.concatenate(at), np.concatenate(to)
    rows = grams.mix((total[to] - total[at]) * down[at] + kind) >> np.uint64(64 - BUCKETS.bit_length() + 1)
    return rows.astype(np.int64), owner[at]


def text_words(text: str) -> list[bytes]:
    """Lower-case words in UTF-8, cut at white space and most ASCII punctuation, and after 60 bytes."""
    found = text.lower().encode("utf-8", "replace").translate(_SPACED).split()
    if any(len(w) > 60 for w in found):
        found = [w[k : k + 60] for w in found for k in range(0, len(w), 60)]
    return found


@dataclass
class Model:
    value: np.ndarray  # of each row: weight * (embedding . direction)
    weight: np.ndarray
    bias: float

    def sums(self, words: list[bytes]) -> np.ndarray:
        """(value, weight) of each word."""
        rows, owner = rows_of(words)
        return np.stack([np.bincount(owner, x[rows], len(words)) for x in (self.value, self.weight)], 1)


def _bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A text's distinct rows and their counts."""
    return np.unique(rows_of(text_words(text))[0], return_counts=True)


def train(texts: list[str], labels: list[int], seed: int = 7) -> Model:
    """Jointly learned embeddings and softmax, folded into one number per row. One class only: that class's rate."""
    labels = np.array(labels, int)
    rate = (labels.sum() + 0.5) / (len(labels) + 1.0)
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(BUCKETS), np.zeros(BUCKETS), float(np.log(rate / (1 - rate))))
    # Bags are made twice, so that only the rows that are learned are ever held together.
    total, seen = np.zeros(BUCKETS), np.zeros(BUCKETS, np.int32)
    for text in texts:
        r, c = _bag(text)
        total[r] += c
        seen[r] += 1
    known = seen >= min(LEAST_TEXTS, max(2, len(texts) // 200))
    weight = np.where(known, np.minimum(1.0, np.sqrt(1e-5 * total.sum() / np.maximum(total, 1.0))), 0.0)
    ids = np.flatnonzero(known)
    place = np.zeros(BUCKETS, np.int32)
    place[ids] = np.arange(len(ids))
    used, each, at = [np.zeros(0, np.int32)], [np.zeros(0, np.float32)], [0]
    for text in texts:
        r, c = _bag(text)
        r, c = r[known[r]], c[known[r]]
        x = c * weight[r]
        used.append(place[r])
        each.append((x / (x.sum() + NEUTRAL)).astype(np.float32))
        at.append(at[-1] + len(r))
    used, each, at = np.concatenate(used), np.concatenate(each), np.array(at)
    random = np.random.default_rng(seed)
    e = random.normal(0, 1.0 / DIMENSIONS, (len(ids), DIMENSIONS))
    w, b = np.zeros((DIMENSIONS, 2)), np.log(np.array([1 - rate, rate]))
    ge, gw = np.full(len(ids), 1e-8), np.full((DIMENSIONS, 2), 1e-8)
    w += random.normal(0, 0.5, w.shape)
    target = np.eye(2)[labels]
    for _ in range(-(-STEPS // -(-len(texts) // 64))):
        order = random.permutation(len(texts))
        for k in range(0, len(order), 64):
            batch = order[k : k + 64]
            take = np.concatenate([np.arange(at[i], at[i + 1]) for i in batch])
            whose = np.repeat(np.arange(len(batch)), at[batch + 1] - at[batch])
            r, x = used[take], each[take]
            h = np.stack([np.bincount(whose, x * e[r, d], len(batch)) for d in range(DIMENSIONS)], 1)
            z = h @ w + b
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            g = (p - target[batch]) * np.where(labels[batch] == 1, TOXIC_WEIGHT, 1.0)[:, None] / len(batch)
            back = g @ w.T
            step_w = h.T @ g
            near, inverse = np.unique(r, return_inverse=True)
            grad = np.stack([np.bincount(inverse, x * back[whose, d], len(near)) for d in range(DIMENSIONS)], 1)
            grad += DECAY * e[near]
            ge[near] += (grad**2).mean(axis=1)
            e[near] -= 0.5 * grad / np.sqrt(ge[near])[:, None]
            gw += step_w**2
            w -= 0.2 * step_w / np.sqrt(gw)
    direction = w[:, 1] - w[:, 0]
    value, full = np.zeros(BUCKETS), np.zeros(BUCKETS)
    value[ids] = weight[ids] * (e @ direction)
    full[ids] = weight[ids]
    return Model(value, full, float(b[1] - b[0]))


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.sums = np.zeros((0, 2))

    def scores(self, texts: list[str]) -> np.ndarray:
        if len(self.known) > CACHE:
            self.clear()
        words = [text_words(t) for t in texts]
        flat = [w for ws in words for w in ws]
        new = list(set(flat).difference(self.known))
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.sums = np.concatenate([self.sums, *(self.model.sums(new[k : k + 20_000]) for k in range(0, len(new), 20_000))])
        sums = self.sums[np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))]
        owner = np.repeat(np.arange(len(texts)), [len(ws) for ws in words])
        num, den = (np.bincount(owner, sums[:, k], len(texts)) for k in range(2))
        z = num / (den + NEUTRAL) + self.model.bias
        return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def held_out(id_column) -> F.Column:
    return F.pmod(F.crc32(id_column.cast("string")), F.lit(4)) == 2


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learns from labelled rows that aren't held out, at most SAMPLE_ROWS of them, in a fixed hash order,
    as far as their texts have SAMPLE_CHARS characters together; a text that would pass that bound is left out, those
    after it are not. Of several texts of one id the shortest counts.

    Rows with a null id or label, and labels other than 0 and 1, are left out; of an id's labels the greatest counts.
    """
    rows = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y"))
    rows = rows.where("id is not null and y in (0, 1)").where(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    picked = F.broadcast(rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    one = F.min(F.struct(F.length("text").alias("n"), F.xxhash64("text").alias("t"))).alias("one")
    sizes = texts.join(picked, "id").groupBy("id").agg(one).select(F.xxhash64("id").alias("h"), "id", "one.n", "one.t").collect()
    chosen, size = [], 0
    for row in sorted(sizes):
        if size + row.n <= SAMPLE_CHARS:  # a text that doesn't fit any more is passed over, the next may
            chosen.append((row.id, row.t))
            size += row.n
    listed = F.broadcast(docs.sparkSession.createDataFrame(chosen, "id long, t long"))
    wanted = texts.withColumn("t", F.xxhash64("text")).join(listed, ["id", "t"]).groupBy("id").agg(F.max("text").alias("text"))
    got = [tuple(x) for x in wanted.join(picked, "id").select("id", "y", "text").collect()]
    got.sort()
    return train([x[2] for x in got], [x[1] for x in got])


def _score(model, texts_at: int = 1) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        for batch in batches:
            k, n = 0, batch.num_rows
            texts = batch.column(texts_at)
            while k < n:
                part, size = [], 0
                while k + len(part) < n and (not part or size < 1 << 20):
                    part.append(texts[k + len(part)].as_py() or "")
                    size += len(part[-1])
                rows = batch.slice(k, len(part))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(scorer.scores(part))], [*rows.schema.names, "score"])
                k += len(part)

    return run


def score(docs: DataFrame, labels: DataFrame, cut: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 if score >= cut).

    Null and empty texts get the score of no words, near the share of toxic labels. A null id isn't held
    out. Repeated rows are scored one by one; the order of rows and other columns, whatever their names,
    play no part. An empty table of documents gives no rows; without usable labels every score is 0.5.
    The model (two numbers per row of the table, 4 MB) is broadcast; its size doesn't depend on the data.
    """
    prepared(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, id_col, text_col, label_col))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = rows.mapInArrow(trimmed(_score(model)), "doc_id long, text string, score double")
    return scored.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= cut, 1).otherwise(0).alias("predicted"),
    )
