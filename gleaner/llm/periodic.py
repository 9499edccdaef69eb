"""Periodic runs of words in texts, and texts without their repetitions, by the runs theorem.

A run is a stretch of words with smallest period q that no neighbouring word extends. Each run of two periods or
more holds a longest Lyndon word of length q under one of the two opposite orders of the words (runs theorem).
The longest Lyndon word that starts at i ends before the next smaller value of the inverse suffix array, under
either order. From each such root the run is extended to both sides by longest common extensions: minima of
the LCP array between two ranks, which a sparse table gives, forwards on the text and backwards on its reverse.

Only stretches in which every GRAM words in a row occur again in the same text are looked at. A run of LEAST words
or more and three periods or more lies in one: from any of its positions at which GRAM words fit, the words
a period before or after are the same and still inside the run, as it has at least 2 q + GRAM words. Hash collisions only add stretches.

All work is on one text at a time, several texts' stretches being handled together, and texts are not shuffled.
A text's words are held as a list: some 60 bytes a word, and some 400 for each word of a periodic stretch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grams
from .common import prepared, trimmed

#: A run has at least so many words, and at least so many periods.
LEAST = 24
PERIODS = 3
GRAM = 8
#: Words of stretches that are handled together, and bytes of texts; a longer stretch or text is handled alone.
TOGETHER = 1 << 16
SLICE_BYTES = 1 << 20

_FACTOR = grams.stream(77, GRAM) | np.uint64(1)


def suffix_ranks(codes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The inverse suffix array, and the ranks of the first 1, 2, 4, ... codes while some of those are equal.

    codes must end with one that occurs nowhere else.
    """
    n, reach, levels = len(codes), 1, []
    _, rank = np.unique(codes, return_inverse=True)
    while rank.max() < n - 1:
        levels.append(rank.astype(np.int32))
        later = np.zeros(n, np.int64)
        later[: n - reach] = rank[reach:] + 1
        _, rank = np.unique(rank * (n + 1) + later, return_inverse=True)
        reach *= 2
    return rank, levels


def adjacent_lcp(isa: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Of each rank the common prefix of its suffix with that of the rank before (rank 0: 0)."""
    n = len(isa)
    sa = np.empty(n, np.int64)
    sa[isa] = np.arange(n)
    i, j, found = sa[:-1].copy(), sa[1:].copy(), np.zeros(n, np.int32)
    for k in range(len(levels) - 1, -1, -1):
        step = np.where(levels[k][i] == levels[k][j], 1 << k, 0)
        i += step
        j += step
        found[1:] += step
    return found


def minima(values: np.ndarray) -> np.ndarray:
    """Sparse table: row k holds at i the minimum of the 2^k values from i on (fewer at the end)."""
    rows = [values.astype(np.int32)]
    while 1 << len(rows) <= len(values):
        last, half = rows[-1], 1 << (len(rows) - 1)
        rows.append(np.concatenate([np.minimum(last[:-half], last[half:]), last[-half:]]))
    return np.stack(rows)


def next_smaller(table: np.ndarray) -> np.ndarray:
    """Of each position the next one with a smaller value, or the end, by descent through the sparse table."""
    n = table.shape[1]
    own, at = table[0], np.arange(1, n + 1)
    for k in range(len(table) - 1, -1, -1):
        fits = at + (1 << k) <= n
        at = np.where(fits & (table[k][np.minimum(at, n - 1)] > own), at + (1 << k), at)
    return at


class Extensions:
    """Longest common extension of two different positions, as the minimum of the LCP array between their ranks."""

    def __init__(self, isa: np.ndarray, levels: list[np.ndarray]):
        self.isa, self.table = isa, minima(adjacent_lcp(isa, levels))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.isa[i], self.isa[j]
        a, b = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        k = np.frexp((b - a).astype(float))[1] - 1
        return np.minimum(self.table[k, a], self.table[k, b - (1 << k)]).astype(np.int64)


def stretch_runs(stretches: list[np.ndarray], least: int = LEAST, periods: int = PERIODS) -> list[tuple[int, int, int, int]]:
    """All runs (stretch, start, length, period) of at least `least` codes and `periods` (2 or more) periods, ascending.

    Stretches are arrays of codes from 0 on. They are joined with a different end mark after each (and
    one before), all smaller than any code, so that no suffix is compared beyond its stretch.
    """
    if not stretches:
        return []
    marks = len(stretches) + 1
    ends = np.cumsum([0, *(len(s) + 1 for s in stretches)])
    codes = np.empty(ends[-1] + 1, np.int64)
    for k, s in enumerate(stretches):
        codes[ends[k] + 1 : ends[k + 1]] = s + marks
    codes[ends] = np.arange(marks)
    n, places = len(codes), np.flatnonzero(codes >= marks)
    isa, levels = suffix_ranks(codes)
    ahead = Extensions(isa, levels)
    roots = [next_smaller(minima(isa))[places]]
    del levels
    opposite = np.where(codes < marks, codes, codes.max() + marks - codes)
    roots.append(next_smaller(minima(suffix_ranks(opposite)[0]))[places])
    back = Extensions(*suffix_ranks(codes[::-1]))
    found = []
    for j in roots:
        before, after = back(n - places, n - j), ahead(places, j)
        period, start = j - places, places - before
        length = period + before + after
        keep = (length >= least) & (length >= periods * period)
        found.append(np.stack([start, length, period], 1)[keep])
    found = np.unique(np.concatenate(found), axis=0)
    which = np.searchsorted(ends, found[:, 0]) - 1
    rows = np.stack([which, found[:, 0] - ends[which] - 1, found[:, 1], found[:, 2]], 1)
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    return [tuple(r) for r in rows.tolist()]


def repeating_stretches(codes: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the maximal stretches of LEAST words or more in which every GRAM words in a row occur again."""
    n = len(codes) - GRAM + 1
    if len(codes) < LEAST:
        return []
    joined = codes[:n].astype(np.uint64) * _FACTOR[0]
    for k in range(1, GRAM):
        joined += codes[k : k + n].astype(np.uint64) * _FACTOR[k]
    slot = (grams.mix(joined) >> np.uint64(64 - (n.bit_length() + 1))).astype(np.int64)
    again = np.zeros(n + 2, np.int8)
    again[1:-1] = np.bincount(slot)[slot] > 1
    edges = np.diff(again)
    start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    long = end - start + GRAM - 1 >= LEAST
    return list(zip(start[long].tolist(), (end[long] + GRAM - 1).tolist(), strict=True))


def text_runs(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """Of each text, given as its words, all runs (start, length, period), by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    wait, whose = [], []

    def settle() -> None:
        for k, start, length, period in stretch_runs(wait):
            text, first = whose[k]
            out[text].append((first + start, length, period))
        wait.clear()
        whose.clear()

    held = 0
    for k, words in enumerate(texts):
        if len(words) < LEAST:
            continue
        known: dict[bytes, int] = {}
        codes = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
        for start, end in repeating_stretches(codes):
            if held + end - start > TOGETHER and wait:
                settle()
                held = 0
            wait.append(codes[start:end])
            whose.append((k, start))
            held += end - start
    settle()
    return out


def without_repetitions(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _collapse(rewrite) -> callable:
    def rows(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        found = text_runs(texts)
        kept = pa.array([b" ".join(without_repetitions(w, r)) for w, r in zip(texts, found, strict=True)], pa.binary())
        runs = pa.array([[{"start": a, "length": n, "period": p} for a, n, p in r] for r in found], _RUNS)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(map(len, texts), pa.int64()), runs, kept.view(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, at in grams.slices(batch.column(1), SLICE_BYTES):
                ids = batch.column(0)[first : first + len(at) - 1].to_pylist()
                data, at = data.tobytes(), at.tolist()
                texts = [data[a:b].split() for a, b in zip(at, at[1:])]  # bytes are split at 20, 09 to 0D
                if rewrite:
                    texts = [rewrite(k, w) for k, w in zip(ids, texts, strict=True)]
                yield rows(ids, texts)

    return run


def collapse(docs: DataFrame, rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, runs (start, length, period in words; by start, then period), collapsed.

    Words are [^\\x20\\x09-\\x0D]+ of the whole text, as bytes; runs have LEAST words and PERIODS periods or
    more. collapsed is the words that no run contains after its first period, joined by one space. rewrite, if given,
    maps (doc_id, words) to the words to look at. Null, empty and blank texts have no words, no runs and an
    empty collapsed text. A null id stays null; repeated rows are handled one by one. Other columns are not read,
    whatever their names. An empty table gives no rows.
    """
    prepared(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(trimmed(_collapse(rewrite)), _SCHEMA)


def strongest(runs: str = "runs") -> F.Column:
    """The run of the greatest exact length / period, the first of equal ones in the array's order; null without runs."""
    better = lambda x, y: (x["length"] * y["period"]) > (y["length"] * x["period"])
    return F.when(F.size(runs) > 0, F.aggregate(F.slice(runs, 2, F.greatest(F.size(runs), F.lit(1))), F.get(runs, F.lit(0)), lambda best, x: F.when(better(x, best), x).otherwise(best)))
