"""Interfaces of the neural parts, and deterministic stand-ins for them.

A model turns columns into columns over Arrow, its weights loaded once per worker. The stand-ins let
pipelines run without weights; they aren't equal to any neural model, and no quality is claimed from them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.ship import ship


class Embedder(Protocol):
    def embed(self, text: Column) -> Column: ...


class Reader(Protocol):
    def read(self, question: Column, passage: Column) -> Column: ...


class Composer(Protocol):
    def compose(self, prompt: Column, budget: Column) -> Column: ...


class HashEmbedder:
    """Signed feature hashing of words, of unit length."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed(self, text: Column) -> Column:
        n = self.dimensions

        @F.pandas_udf("array<float>")
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            import zlib

            for texts in parts:
                out = []
                for value in texts:
                    v = np.zeros(n, np.float32)
                    for word in (value or "").lower().split():
                        h = zlib.crc32(word.encode())
                        v[h % n] += 1 if h >> 31 else -1
                    out.append(v / (np.linalg.norm(v) + 1e-9))
                yield pd.Series(out)

        return run(text)


class OverlapReader:
    """struct<answer, span_score, null_score>: the sentence with the most question words; its score is their number."""

    def read(self, question: Column, passage: Column) -> Column:
        from .text import question_terms, sentences, tokens

        terms = question_terms(question)
        scored = F.transform(sentences(passage), lambda s: F.struct(F.size(F.array_intersect(tokens(s), terms)).alias("n"), s.alias("s")))
        best = F.aggregate(scored, F.struct(F.lit(0).alias("n"), F.lit("").alias("s")), lambda a, b: F.when(b.n > a.n, b).otherwise(a))
        return F.struct(best.s.alias("answer"), best.n.cast("double").alias("span_score"), F.lit(1.0).alias("null_score"))


class EchoComposer:
    """The prompt's last user line, cut to the budget's words."""

    def compose(self, prompt: Column, budget: Column) -> Column:
        last = F.regexp_extract(prompt, r"(?s).*<\|im_start\|>user\n(.*?)<\|im_end\|>", 1)
        return F.array_join(F.slice(F.split(last, r"\s+"), F.lit(1), budget), " ")


def erf_gelu(x: np.ndarray) -> np.ndarray:
    """x * (1 + erf(x / sqrt 2)) / 2."""
    from math import erf

    return 0.5 * x * (1.0 + np.vectorize(erf)(x / np.sqrt(2.0)))


def transformer(ids: np.ndarray, types: np.ndarray, w: dict[str, np.ndarray], layers: int, heads: int) -> np.ndarray:
    """Hidden states of one sequence of a post-norm encoder; w holds arrays by the usual checkpoint names."""

    def norm(x, name):
        x = x - x.mean(-1, keepdims=True)
        return x / np.sqrt((x**2).mean(-1, keepdims=True) + 1e-12) * w[f"{name}.weight"] + w[f"{name}.bias"]

    def linear(x, name):
        return x @ w[f"{name}.weight"].T + w[f"{name}.bias"]

    e = "embeddings."
    x = norm(w[f"{e}word_embeddings.weight"][ids] + w[f"{e}position_embeddings.weight"][: len(ids)] + w[f"{e}token_type_embeddings.weight"][types], f"{e}LayerNorm")
    for k in range(layers):
        p = f"encoder.layer.{k}."
        q, key, v = (linear(x, f"{p}attention.self.{n}").reshape(len(ids), heads, -1).transpose(1, 0, 2) for n in ("query", "key", "value"))
        s = q @ key.transpose(0, 2, 1) / np.sqrt(q.shape[-1])
        s = np.exp(s - s.max(-1, keepdims=True))
        mixed = (s / s.sum(-1, keepdims=True) @ v).transpose(1, 0, 2).reshape(len(ids), -1)
        x = norm(x + linear(mixed, f"{p}attention.output.dense"), f"{p}attention.output.LayerNorm")
        x = norm(x + linear(erf_gelu(linear(x, f"{p}intermediate.dense")), f"{p}output.dense"), f"{p}output.LayerNorm")
    return x


def transformer_batch(ids: np.ndarray, types: np.ndarray, mask: np.ndarray, w: dict[str, np.ndarray], layers: int, heads: int) -> np.ndarray:
    """Hidden states of padded sequences (sequence, position) at once; positions where mask is false are seen by none."""

    def norm(x, name):
        x = x - x.mean(-1, keepdims=True)
        return x / np.sqrt((x**2).mean(-1, keepdims=True) + 1e-12) * w[f"{name}.weight"] + w[f"{name}.bias"]

    def linear(x, name):
        return x @ w[f"{name}.weight"].T + w[f"{name}.bias"]

    n, size = ids.shape
    split = lambda x: x.reshape(n, size, heads, -1).transpose(0, 2, 1, 3)
    e = "embeddings."
    x = norm(w[f"{e}word_embeddings.weight"][ids] + w[f"{e}position_embeddings.weight"][:size] + w[f"{e}token_type_embeddings.weight"][types], f"{e}LayerNorm")
    unseen = np.where(mask, 0.0, -np.inf)[:, None, None, :]
    for k in range(layers):
        p = f"encoder.layer.{k}."
        q, key, v = (split(linear(x, f"{p}attention.self.{name}")) for name in ("query", "key", "value"))
        s = q @ key.transpose(0, 1, 3, 2) / np.sqrt(q.shape[-1]) + unseen
        s = np.exp(s - s.max(-1, keepdims=True))
        mixed = (s / s.sum(-1, keepdims=True) @ v).transpose(0, 2, 1, 3).reshape(n, size, -1)
        x = norm(x + linear(mixed, f"{p}attention.output.dense"), f"{p}attention.output.LayerNorm")
        x = norm(x + linear(erf_gelu(linear(x, f"{p}intermediate.dense")), f"{p}output.dense"), f"{p}output.LayerNorm")
    return x


def length_groups(sizes: np.ndarray, most: int) -> list[np.ndarray]:
    """Indexes by rising size, cut so that a group's number times its greatest size is at most `most`; a longer one is alone."""
    order, out, start = np.argsort(sizes, kind="stable"), [], 0
    for k in range(1, len(order) + 1):
        if k == len(order) or (k + 1 - start) * sizes[order[k]] > most:
            out.append(order[start:k])
            start = k
    return out


def encode(rows: DataFrame, weights: dict[str, np.ndarray], layers: int, heads: int, key: str = "passage_id", ids: str = "ids", most: int = 8192) -> DataFrame:
    """(key, v): the mean of all positions' hidden states of each token sequence (ids, all of type 0), divided by its length plus 1e-9.

    Weights are broadcast once. In a task rows are encoded in padded groups of similar length, of at most `most` positions together. A null or
    empty sequence has a null vector.
    """
    spark = ship(rows.sparkSession)
    shared = spark.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [x or [] for x in batch.column(1).to_pylist()]
            sizes, out = np.array([len(x) for x in lists], int), [None] * len(lists)
            for group in length_groups(sizes, most) if len(sizes) else []:
                group = group[sizes[group] > 0]
                if not len(group):
                    continue
                padded = np.zeros((len(group), sizes[group].max()), int)
                for row, k in enumerate(group):
                    padded[row, : sizes[k]] = lists[k]
                mask = np.arange(padded.shape[1]) < sizes[group][:, None]
                states = transformer_batch(padded, np.zeros_like(padded), mask, shared.value, layers, heads)
                pooled = (states * mask[:, :, None]).sum(axis=1) / mask.sum(axis=1)[:, None]
                pooled /= np.linalg.norm(pooled, axis=1, keepdims=True) + 1e-9
                for row, k in enumerate(group):
                    out[k] = pooled[row]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], [key, "v"])

    return rows.select(F.col(key).cast("long").alias(key), ids).mapInArrow(run, f"{key} long, v array<double>")
