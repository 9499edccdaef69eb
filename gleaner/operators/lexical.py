"""Lexical index and BM25 as DataFrames: term frequencies, postings, statistics, scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.config import DEFAULT, RetrievalConfig
from gleaner.functions import text as T
from gleaner.ship import ship


def term_frequencies(passages: DataFrame, bag: str = "text") -> DataFrame:
    """(passage_id, term, tf) of every term in the bag column."""
    found = passages.select("passage_id", F.explode(T.tokens(F.col(bag))).alias("term"))
    return found.groupBy("passage_id", "term").agg(F.count("*").alias("tf"))


def small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """df with a broadcast hint if it has at most that many rows; else as it is, so that the join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def bag_form(rows: DataFrame) -> str:
    """The schema of bags, a row for each passage with its terms, for the rows' kind of passage_id."""
    return f"passage_id {dict(rows.dtypes)['passage_id']}, doclen long, terms array<struct<term: string, tf: long>>"


@dataclass
class Index:
    """A lexical index: tf (passage_id, term, tf, doclen), lengths (passage_id, doclen), dfs (term, df), stats (n, avgdl).

    whole: the rows of a passage lie in one file, one after another.
    bags: the rows that such an index is read from (passage_id, doclen, terms), one for each passage.
    """

    tf: DataFrame
    lengths: DataFrame
    dfs: DataFrame
    stats: DataFrame
    whole: bool = False
    bags: DataFrame | None = None

    @staticmethod
    def of(tf: DataFrame) -> Index:
        """An index of term frequencies (passage_id, term, tf), counted whenever it is read."""
        lengths = document_lengths(tf)
        return Index(tf.join(lengths, "passage_id"), lengths, document_frequencies(tf), lengths.agg(F.count("*").alias("n"), F.avg("doclen").alias("avgdl")))

    @staticmethod
    def open(spark: SparkSession, folder: str) -> Index:
        return Index(*(spark.read.parquet(f"{folder}/{name}") for name in ("tf", "lengths", "dfs", "stats")))

    @staticmethod
    def build(passages: DataFrame, folder: str, bag: str = "text") -> Index:
        """Tokenises every passage once and writes a row for each, with its terms; passages without tokens have no rows.

        A passage's terms are cut and counted where it is read. Only if a passage_id comes more than once are its rows brought together.
        """
        from gleaner.operators.plaintext import is_plain
        from gleaner.operators.scoring import counted

        spark = ship(passages.sparkSession)
        form = bag_form(passages)
        where = f"{folder}/bags"
        plain = is_plain(F.col(bag))  # null texts have no tokens
        passages.select("passage_id", F.col(bag).alias("text"), F.when(~plain, T.tokens(F.col(bag))).alias("t")).mapInArrow(counted, form).write.parquet(where)
        bags = spark.read.schema(form).parquet(where)
        if bags.groupBy("passage_id").count().where("count > 1").limit(1).count():
            where = f"{folder}/merged"
            merged = bags.select("passage_id", F.inline("terms")).groupBy("passage_id", "term").agg(F.sum("tf").alias("tf"))
            merged.groupBy("passage_id").agg(F.sum("tf").alias("doclen"), F.collect_list(F.struct("term", "tf")).alias("terms")).write.parquet(where)
            bags = spark.read.schema(form).parquet(where)
        return Index.of_bags(bags, folder)

    @staticmethod
    def of_bags(bags: DataFrame, folder: str) -> Index:
        """An index read from saved bags (passage_id, doclen, terms), one row for each passage; writes the terms' frequencies and the statistics."""
        spark = bags.sparkSession
        tf, lengths = bags.select("passage_id", F.inline("terms"), "doclen"), bags.select("passage_id", "doclen")
        document_frequencies(tf).write.parquet(f"{folder}/dfs")
        lengths.agg(F.count("*").alias("n"), F.avg("doclen").alias("avgdl")).write.parquet(f"{folder}/stats")
        return Index(tf, lengths, *(spark.read.parquet(f"{folder}/{name}") for name in ("dfs", "stats")), whole=True, bags=bags)

    @staticmethod
    def save(tf: DataFrame, folder: str) -> Index:
        """Writes the relations of term frequencies (passage_id, term, doclen, tf)."""
        spark = tf.sparkSession
        tf.write.parquet(f"{folder}/tf")
        tf = spark.read.parquet(f"{folder}/tf")
        tf.groupBy("passage_id").agg(F.max("doclen").alias("doclen")).write.parquet(f"{folder}/lengths")
        document_frequencies(tf).write.parquet(f"{folder}/dfs")
        spark.read.parquet(f"{folder}/lengths").agg(F.count("*").alias("n"), F.avg("doclen").alias("avgdl")).write.parquet(f"{folder}/stats")
        return Index.open(spark, folder)


def document_lengths(tf: DataFrame) -> DataFrame:
    return tf.groupBy("passage_id").agg(F.sum("tf").alias("doclen"))


def document_frequencies(tf: DataFrame) -> DataFrame:
    return tf.groupBy("term").agg(F.count("*").alias("df"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1.0 + (n - df + 0.5) / (df + 0.5))


def bm25_part(weight: Column, idf_: Column, tf: Column, doclen: Column, avgdl: Column, config: RetrievalConfig = DEFAULT) -> Column:
    k1, b = F.lit(config.k1), F.lit(config.b)
    return weight * idf_ * tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * doclen / avgdl))


def df_cap(n: Column, config: RetrievalConfig = DEFAULT, floor: int | None = None) -> Column:
    """Terms in more passages than this keep their count but lose their postings."""
    return F.greatest(F.lit(config.df_cap_floor if floor is None else floor), F.floor(n * config.df_cap_share).cast("int"))


def postings(tf: DataFrame, span: int = 1 << 32) -> DataFrame:
    """(term, block, n, first_offset, docs array<struct<passage_id, tf>>): the compressed-row form, terms in order.

    A block holds a term's passages among `span` ids, so that a common term is many rows of bounded length. The
    running offset is one global order over terms and blocks; it is summed in ranges of first letters (one
    row each) and then inside each of them.
    """
    block = F.floor(F.col("passage_id") / span).alias("block")
    lists = tf.groupBy("term", block).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("passage_id", "tf"))).alias("docs"))
    lists = lists.withColumn("head", F.substring("term", 1, 1))
    heads = lists.groupBy("head").agg(F.sum("n").alias("m"))
    before = Window.orderBy("head").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("head", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("head").orderBy("term", "block").rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum("n").over(inside), F.lit(0))
    return lists.join(F.broadcast(heads), "head").select("term", "block", "n", (F.col("base") + own).alias("first_offset"), "docs")


def vocabulary(dfs: DataFrame) -> DataFrame:
    """(term, id): terms numbered from 0 by falling frequency, ties by term.

    The order is cut by frequency, and the terms of a frequency, of which the rare ones have very many, by their
    first two bytes; offsets of these ranges are summed (few rows, as frequencies are spread thinly) and terms
    numbered inside them.
    """
    rows = dfs.withColumn("head", F.substring(F.encode("term", "utf-8"), 1, 2))
    ranges = rows.groupBy("df", "head").agg(F.count("*").alias("m"))
    before = Window.orderBy(F.desc("df"), "head").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("df", "head", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("df", "head").orderBy("term")) - 1
    return rows.withColumn("own", own).join(small(ranges), ["df", "head"]).select("term", (F.col("base") + F.col("own")).alias("id"))


def posting_deltas(tf: DataFrame, span: int = 1 << 32) -> DataFrame:
    """(term, passage_id, delta, delta_bytes): gaps between a term's passages and their varint sizes.

    A common term is cut into blocks of `span` ids; a block's first gap reaches back to the last passage of the term's block before.
    """
    tf = tf.withColumn("block", F.floor(F.col("passage_id") / span))
    ends = tf.groupBy("term", "block").agg(F.max("passage_id").alias("end"))
    ends = ends.select("term", "block", F.lag("end").over(Window.partitionBy("term").orderBy("block")).alias("before"))
    own = F.lag("passage_id").over(Window.partitionBy("term", "block").orderBy("passage_id"))
    tf = tf.withColumn("last", own).join(ends, ["term", "block"])
    gap = F.col("passage_id") - F.coalesce("last", "before", F.lit(0))
    bits = F.length(F.bin(F.greatest(F.col("delta"), F.lit(1))))
    return tf.select("term", "passage_id", gap.alias("delta")).select("*", F.ceil(bits / 7.0).cast("int").alias("delta_bytes"))


def question_terms(questions: DataFrame) -> DataFrame:
    """(question_id, term) of every question's distinct terms without stop words."""
    return questions.select("question_id", F.explode(T.question_terms(F.col("text"))).alias("term"))


def with_fuzzy(terms: DataFrame, vocabulary: DataFrame, config: RetrievalConfig = DEFAULT) -> DataFrame:
    """(question_id, term, weight): question terms and related vocabulary terms at a lower weight.

    Related terms share their first four bytes, so the theta join is an equi-join on that prefix with the
    rest as a condition, instead of a nested loop over the vocabulary.
    """
    head = lambda c: F.substring(c, 1, 4)
    exact = terms.select("question_id", "term", F.lit(1.0).alias("weight"))
    q = terms.where(F.octet_length("term") >= 4).select("question_id", F.col("term").alias("q"), head("term").alias("head"))
    v = vocabulary.where(F.octet_length("term") >= 4).select("term", head("term").alias("head"))
    near = q.join(v, "head").where(T.related(F.col("q"), F.col("term")) & (F.col("q") != F.col("term")))
    near = near.select("question_id", "term", F.lit(config.fuzzy_weight).alias("weight"))
    return exact.unionByName(near)


def bm25(weighted: DataFrame, index: Index, config: RetrievalConfig = DEFAULT) -> DataFrame:
    """(question_id, passage_id, lexical): BM25 of every passage that holds a weighted term (question_id, term, weight).

    The terms' frequencies are looked up first; if the terms are few they are broadcast to the index, which is
    then read once and not shuffled.
    """
    terms = index.dfs.join(small(weighted), "term")
    hits = index.tf.join(small(terms), "term").crossJoin(F.broadcast(index.stats))
    part = bm25_part(F.col("weight"), idf(F.col("n"), F.col("df")), F.col("tf"), F.col("doclen"), F.col("avgdl"), config)
    return hits.select("question_id", "passage_id", part.alias("part")).groupBy("question_id", "passage_id").agg(F.sum("part").alias("lexical"))
