"""The reading chain: tokens with byte offsets, a reader's logits as rows, best spans, answers as bytes of what was read.

A reader is a function from token rows to the same rows with `start` and `end` logits and the pair's `null_score`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators import answers as A
from gleaner.operators import lexical as L
from gleaner.operators import plaintext as X
from gleaner.ship import ship

PAIR = ["question_id", "passage_id"]
#: Tokens of a reader's input: question, context and three marks.
INPUT = 384
#: Question tokens, at most.
ASKED = 62

Reader = Callable[[DataFrame], DataFrame]


def token_spans(rows: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key..., place, token, source, from_byte, to_byte): a row for each token, from the first on, with its bytes [from, to) in the text.

    `token` is normalised, `source` as it stands; words of which nothing stays are left out. A text's tokens are
    numbered where the text is read, and nothing is shuffled.
    """
    return _located(rows, key, text).select(*key, F.inline("spans"))


def span_digests(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, n, last_byte, digest) of every text with tokens: how many, the byte after the last, and the MD5 of "token:from-to" in order.

    A text is digested in the task that reads it, so that no token leaves it; only the tokens of keys that come more than once are brought together.
    """
    again = rows.groupBy(key).count().where("count > 1").select(key)
    if not again.limit(1).count():
        return _digests(rows, key, text)
    again = L.small(again.withColumnRenamed(key, "again"))
    same = F.col(key).eqNullSafe(F.col("again"))
    item = F.struct("place", F.concat_ws("", "token", F.lit(":"), F.col("from_byte").cast("string"), F.lit("-"), F.col("to_byte").cast("string")).alias("t"))
    shared = token_spans(rows.join(again, same, "left_semi"), [key], text)
    shared = shared.groupBy(key).agg(F.count("*").alias("n"), F.max("to_byte").alias("last_byte"), F.sort_array(F.collect_list(item)).alias("l"))
    shared = shared.select(key, "n", "last_byte", F.md5(F.array_join(F.transform("l", lambda x: x.t), " ")).alias("digest"))
    return _digests(rows.join(again, same, "left_anti"), key, text).unionByName(shared)


def _digests(rows: DataFrame, key: str, text: str) -> DataFrame:
    """span_digests of rows of different keys."""
    kind = dict(rows.dtypes)[key]
    return _pieces(rows, [key], text).mapInArrow(_digested(key), f"`{key}` {kind}, n long, last_byte long, digest string")


def _located(rows: DataFrame, key: list[str], text: str, most: F.Column | None = None) -> DataFrame:
    """(key..., n_tokens, spans): a row for each text with its tokens, the first `most` of them if that is given."""
    kinds = dict(rows.select(*key).dtypes)
    spans = "array<struct<place: int, token: string, source: string, from_byte: long, to_byte: long>>"
    return _pieces(rows, key, text, most).mapInArrow(_numbered(key), ", ".join([*(f"`{c}` {kinds[c]}" for c in key), "n_tokens long", f"spans {spans}"]))


def _pieces(rows: DataFrame, key: list[str], text: str, most: F.Column | None = None) -> DataFrame:
    """(key..., most, plain, pieces, words): a plain text as it is, of others the pieces, and the words as tokens or empty."""
    ship(rows.sparkSession)
    normal = lambda words: F.transform(words, T.normalised)

    def first(words: F.Column) -> F.Column:
        """Twice as many words as tokens are wanted; all of them if too many of these are empty."""
        enough = lambda some: F.when((F.size(words) <= 2 * INPUT) | (F.size(F.filter(some, lambda w: w != "")) >= most), some).otherwise(normal(words))
        return T.bound(normal(F.slice(words, 1, 2 * INPUT)), enough)

    whole = F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("\x01"), F.lit("\x02"))
    rows = rows.select(*key, (F.lit(None) if most is None else most).cast("long").alias("most"), whole.alias("whole"))
    rows = rows.withColumn("is_plain", X.is_plain(F.col("whole")))
    rows = rows.select(*key, "most", F.when(F.col("is_plain"), F.col("whole")).alias("plain"), F.when(~F.col("is_plain"), T.token_pieces(F.col("whole"))).alias("pieces"))
    words = F.filter("pieces", lambda p, n: n % 2 == 1)
    return rows.withColumn("words", normal(words) if most is None else T.bound(words, first))


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, pa.Array, pa.Array]]:
    """A batch's rows, some texts at a time, with their pieces and words."""
    given = batch.filter(batch.column("pieces").is_valid())
    for at, to in X.cuts(given.column("pieces").value_lengths().to_numpy(zero_copy_only=False)):
        part = given.slice(at, to - at)
        yield part, part.column("pieces"), part.column("words")
    plain = batch.filter(batch.column("plain").is_valid())
    for at, to in X.chunks(plain.column("plain")):
        part = plain.slice(at, to - at)
        yield part, *X.pieces(part.column("plain"))


def _places(pieces: pa.Array, words: pa.Array, most: pa.Array) -> tuple:
    """(n, row, at, place, token, from, to): how many tokens each text has, and of each token its text, its piece, its place and its bytes in the text."""
    size = lambda lists: pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = lambda n: np.cumsum(n) - n
    source, token = pieces.flatten(), words.flatten()
    length = pc.binary_length(source).to_numpy(zero_copy_only=False).astype(np.int64)
    upto, n = np.concatenate([[0], np.cumsum(length)]), size(words)
    row, first = np.repeat(np.arange(len(n)), n), starts(size(pieces))
    at = first[row] + 2 * (np.arange(len(row)) - starts(n)[row]) + 1
    kept = pc.binary_length(token).to_numpy(zero_copy_only=False) > 0
    seen = np.concatenate([[0], np.cumsum(kept)])
    place = seen[:-1] - seen[starts(n)][row]
    kept &= place < most.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)[row]
    row, at, place, token = row[kept], at[kept], place[kept], token.take(pa.array(np.flatnonzero(kept)))
    of = upto[first[row]]
    return np.bincount(row, minlength=len(n)), row, at, place, token, upto[at] - of, upto[at + 1] - of


def _edges(n: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))


def _numbered(key: list[str]) -> Callable:
    """From texts' pieces, and their words as tokens or empty, to the tokens with their places and bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, pieces, words in _parts(batch):
                n, _, at, place, token, from_byte, to_byte = _places(pieces, words, part.column("most"))
                columns = [pa.array(place.astype(np.int32)), token, pieces.flatten().take(pa.array(at)), pa.array(from_byte), pa.array(to_byte)]
                spans = pa.ListArray.from_arrays(_edges(n), pa.StructArray.from_arrays(columns, ["place", "token", "source", "from_byte", "to_byte"]))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in key), pa.array(n), spans], [*key, "n_tokens", "spans"])

    return run


def _digested(key: str) -> Callable:
    """From texts' pieces and words to a digest of the tokens with their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, pieces, words in _parts(batch):
                n, _, _, _, token, from_byte, to_byte = _places(pieces, words, part.column("most"))
                there = np.flatnonzero(n)
                number = lambda x: pa.array(x).cast(pa.string())
                items = pc.binary_join_element_wise(pc.binary_join_element_wise(token, number(from_byte), ":"), number(to_byte), "-")
                joined = pc.binary_join(pa.ListArray.from_arrays(_edges(n[there]), items), " ")
                digest = pa.array([hashlib.md5(x.as_buffer()).hexdigest() for x in joined], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(key).take(pa.array(there)), pa.array(n[there]), pa.array(to_byte[np.cumsum(n)[there] - 1]), digest], [key, "n", "last_byte", "digest"])

    return run


def _best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each pair the span of the greatest sum of logits, at most SPAN tokens, not of question tokens only; the first of equal ones."""
    for batch in batches:
        out = []
        for k, tokens in enumerate(batch.column("t").to_pylist()):
            start, end = (np.array([t[c] for t in tokens], float) for c in ("start", "end"))
            own = np.cumsum([0, *(not t["echo"] for t in tokens)])
            n = len(tokens)
            j = np.arange(n)[:, None] + np.arange(A.SPAN)[None, :]
            inside = j < n
            j = np.minimum(j, n - 1)
            score = np.where(inside & (own[j + 1] > own[:n, None]), np.round(start[:, None] + end[j], 6), -np.inf)
            at = int(np.argmax(score)) if n else 0
            if n and np.isfinite(score.flat[at]):
                i, last = at // A.SPAN, int(j.flat[at])
                out.append((k, score.flat[at], i, last, tokens[i]["from_byte"], tokens[last]["to_byte"]))
        rows = pa.array([x[0] for x in out], pa.int64())
        kept = [batch.column(c).take(rows) for c in ("question_id", "passage_id", "null_score")]
        new = [pa.array([x[1] for x in out], pa.float64()), *(pa.array([x[c] for x in out], pa.int64()) for c in range(2, 6))]
        yield pa.RecordBatch.from_arrays([*kept, *new], ["question_id", "passage_id", "null_score", "span_score", "i", "j", "from_byte", "to_byte"])


def read(pairs: DataFrame, reader: Reader, context: str = "context") -> DataFrame:
    """(question_id, passage_id, answer, span_score, null_score, i, j, from_byte, to_byte) of pairs (question_id, passage_id, question, context).

    The context's tokens are those that fit beside the question's; no others leave the task that cuts it. The answer is what stands between the span's bytes, at most 500
    of them, without closing punctuation; it may be empty. A context without a usable token has no row.
    """
    asked = pairs.select(*PAIR, T.truncated(T.tokens(F.col("question")), ASKED).alias("asked"), context)
    tokens = _located(asked, [*PAIR, "asked"], context, INPUT - 3 - F.size("asked"))
    tokens = tokens.select(*PAIR, "asked", "n_tokens", F.inline("spans")).withColumn("echo", F.array_contains("asked", F.col("token")))
    tokens = reader(tokens)
    grouped = tokens.groupBy(*PAIR).agg(F.sort_array(F.collect_list(F.struct("place", "start", "end", "echo", "from_byte", "to_byte"))).alias("t"), F.max("null_score").alias("null_score"))
    numbers = "span_score double, i long, j long, from_byte long, to_byte long"
    spans = grouped.mapInArrow(_best, f"question_id long, passage_id long, null_score double, {numbers}")
    found = spans.join(pairs.select(*PAIR, F.encode(F.translate(F.col(context), "\x01", "\x02"), "utf-8").alias("raw")), PAIR)
    answer = F.decode(F.substring("raw", F.col("from_byte").cast("int") + 1, (F.col("to_byte") - F.col("from_byte")).cast("int")), "utf-8")
    return found.select(*PAIR, A.clipped(answer).alias("answer"), "span_score", "null_score", "i", "j", "from_byte", "to_byte")


def told(answer: F.Column, title: F.Column) -> F.Column:
    """An answer as it is told: a pronoun becomes the title, a leading title goes; null if nothing stays."""
    return A.without_title_prefix(A.resolved(answer, title), title)
