"""Word pieces by greedy longest match, cut once for each distinct term that a task reads, and the lexical index over pieces."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators import lexical as L
from gleaner.operators import plaintext as X
from gleaner.ship import ship

UNKNOWN = "[UNK]"
#: Characters of a word beyond which it is unknown.
LONGEST = 100
#: Terms of passages that are put in pieces at once, about.
CHUNK = 1 << 20
#: Terms whose pieces a task keeps, about.
KEPT = 1 << 19


def vocabulary(path: str) -> list[str]:
    """The pieces of a tokenizer file with word ends: each of its strings begins a word, or continues one after ##."""
    with open(path, encoding="utf-8") as file:
        strings = json.load(file)["model"]["vocab"]
    plain = sorted({s.removesuffix("</w>") for s in strings} - {""})
    return [UNKNOWN, *plain, *(f"##{s}" for s in plain)]


class Pieces:
    """Greedy longest match. A piece is sought from the longest length that any piece of the vocabulary has."""

    def __init__(self, pieces: list[str]):
        self.begin = frozenset(p for p in pieces if not p.startswith("##"))
        self.go_on = frozenset(p[2:] for p in pieces if p.startswith("##"))
        self.longest = max(map(len, self.begin | self.go_on), default=0)

    def cut(self, word: str) -> list[str]:
        """A word's pieces, ## before all but the first; a word that fails anywhere, or is too long, is unknown."""
        if len(word) > LONGEST:
            return [UNKNOWN]
        out, at = [], 0
        while at < len(word):
            known = self.go_on if at else self.begin
            end = min(len(word), at + self.longest)
            while end > at and word[at:end] not in known:
                end -= 1
            if end == at:
                return [UNKNOWN]
            out.append(word[at:end] if at == 0 else f"##{word[at:end]}")
            at = end
        return out


def term_pieces(terms: DataFrame, pieces: list[str]) -> DataFrame:
    """(term, pieces) of distinct terms (term). The vocabulary, tens of thousands of strings whatever the data, is broadcast once."""
    spark = ship(terms.sparkSession)
    shared = spark.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Pieces(shared.value)
        for batch in batches:
            found = pa.array([known.cut(t) for t in batch.column(0).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), found], ["term", "pieces"])

    return terms.select("term").mapInArrow(run, "term string, pieces array<string>")


def piece_index(index: L.Index, pieces: list[str], folder: str) -> L.Index:
    """The lexical index over pieces of an index over words; a passage's pieces are counted in the task that reads its terms."""
    spark = ship(index.tf.sparkSession)
    bags = index.bags
    if bags is None:
        bags = index.tf.groupBy("passage_id").agg(F.collect_list(F.struct("term", "tf")).alias("terms"))
    form, where = L.bag_form(bags), f"{folder}/bags"
    bags.select("passage_id", "terms").mapInArrow(_counted(spark.sparkContext.broadcast(pieces)), form).write.parquet(where)
    return L.Index.of_bags(spark.read.schema(form).parquet(where), folder)


class Cuts:
    """The pieces of terms as numbers of names; a term is cut when it is first asked for, and kept until there are KEPT of them."""

    def __init__(self, pieces: list[str]):
        self.known, self.code = Pieces(pieces), {p: k for k, p in enumerate(dict.fromkeys([UNKNOWN, *pieces]))}
        self.names = pa.array(list(self.code), pa.string())
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.size, self.piece = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def of(self, terms: list[str]) -> np.ndarray:
        """Of each of different terms its place among the kept ones."""
        if len(self.at) > KEPT:
            self.clear()
        new = [t for t in terms if t not in self.at]
        found = [self.known.cut(t) for t in new]
        self.at.update(zip(new, range(len(self.at), len(self.at) + len(new))))
        self.size = np.concatenate([self.size, np.array([len(f) for f in found], np.int64)])
        self.piece = np.concatenate([self.piece, np.array([self.code[p] for f in found for p in f], np.int64)])
        return np.fromiter(map(self.at.__getitem__, terms), np.int64, len(terms))


def _counted(shared) -> Callable:
    """Rows (passage_id, terms) over words: how many pieces each has, and each distinct one with its number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = Cuts(shared.value)
        for batch in batches:
            for at, to in X.cuts(batch.column("terms").value_lengths().to_numpy(zero_copy_only=False), CHUNK):
                yield _bags(batch.slice(at, to - at), cuts)

    return run


def _bags(batch: pa.RecordBatch, cuts: Cuts) -> pa.RecordBatch:
    lists = batch.column("terms")
    term, tf = lists.flatten().flatten()
    coded = term.dictionary_encode()
    of = cuts.of(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
    n = cuts.size[of]
    first = np.cumsum(cuts.size) - cuts.size
    piece = cuts.piece[np.arange(n.sum()) + np.repeat(first[of] - (np.cumsum(n) - n), n)]
    row = np.repeat(np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False)), n)
    key, which = np.unique(row * len(cuts.names) + piece, return_inverse=True)
    times = np.bincount(which, np.repeat(tf.to_numpy(zero_copy_only=False), n), len(key)).astype(np.int64)
    row, piece = np.divmod(key, len(cuts.names))
    terms = pa.StructArray.from_arrays([cuts.names.take(pa.array(piece)), pa.array(times)], ["term", "tf"])
    ends = np.concatenate([[0], np.searchsorted(row, np.arange(len(lists)), "right")])
    doclen = np.bincount(row, times, len(lists)).astype(np.int64)
    bags = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), terms)
    return pa.RecordBatch.from_arrays([batch.column("passage_id"), pa.array(doclen), bags], ["passage_id", "doclen", "terms"])


def piece_frequencies(index: L.Index, cut: DataFrame) -> DataFrame:
    """(passage_id, term, tf, doclen) over pieces, from an index over words and its terms' pieces (term, pieces); doclen counts pieces."""
    each = cut.select("term", F.explode("pieces").alias("piece")).groupBy("term", "piece").agg(F.count("*").alias("times"))
    rows = index.tf.select("passage_id", "term", "tf").join(L.small(each), "term")
    return rows.groupBy("passage_id", F.col("piece").alias("term")).agg(F.sum(F.col("tf") * F.col("times")).alias("tf"))


def question_pieces(terms: DataFrame, cut: DataFrame) -> DataFrame:
    """(question_id, term) of the distinct pieces of question terms that begin a word and aren't unknown."""
    rows = terms.join(cut, "term").select("question_id", F.explode("pieces").alias("term")).distinct()
    return rows.where(~F.col("term").startswith("##") & (F.col("term") != UNKNOWN))
