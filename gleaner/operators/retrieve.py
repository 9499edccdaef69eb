"""Fusion of dense and lexical scores, top-k with a cap per article, re-ranking, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.config import DEFAULT, RetrievalConfig
from gleaner.functions import text as T
from gleaner.operators import lexical as L


def normalised_lexical(lexical: Column, by: str = "question_id") -> Column:
    """Divided by the question's maximum; 0 where nothing matches."""
    top = F.max(lexical).over(Window.partitionBy(by))
    return F.when(top > 0, lexical / top).otherwise(0.0)


def fused(dense: DataFrame, lexical: DataFrame, weight: float = DEFAULT.dense_weight) -> DataFrame:
    """(question_id, passage_id, dense, lexical, score) for every dense row; a passage without lexical match counts 0."""
    both = dense.join(lexical, ["question_id", "passage_id"], "left").withColumn("lexical", F.coalesce("lexical", F.lit(0.0)))
    return both.withColumn("score", F.lit(weight) * F.col("dense") + F.lit(1.0 - weight) * normalised_lexical(F.col("lexical")))


def top_k(scored: DataFrame, k: int, score: str = "score", key: str = "passage_id", by: str = "question_id") -> DataFrame:
    """Adds rank 1..k by falling score, ties to the lower key; a limit inside the window prunes before the shuffle."""
    own = Window.partitionBy(by).orderBy(F.desc(score), F.asc(key))
    return scored.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)


def diversified(scored: DataFrame, article: str = "article_id", config: RetrievalConfig = DEFAULT, key: str = "passage_id", by: str = "question_id") -> DataFrame:
    """The best candidates, then at most per_article of one article in rank order, then the top; may give fewer."""
    rows = top_k(scored, config.candidates, key=key, by=by).withColumnRenamed("rank", "candidate")
    own = Window.partitionBy(by, article).orderBy("candidate")
    rows = rows.withColumn("in_article", F.row_number().over(own)).where(F.col("in_article") <= config.per_article)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy("candidate")))
    return rows.where(F.col("rank") <= config.top).drop("in_article")


def held_terms(question: Column, text: Column, most: int = 512) -> Column:
    """array<struct<term, found>>: a question's terms, and whether a text's first `most` tokens hold them exactly or as a related term.

    Both texts are tokenised once a pair, and only tokens that can be related to another term are compared with one.
    """
    long = lambda t: (F.octet_length(t) >= 4) & ~t.startswith("#")

    def each(held: Column) -> Column:
        def one(near: Column) -> Column:
            def found(term: Column) -> Column:
                gap = lambda h: F.abs(F.octet_length(h) - F.octet_length(term)) <= 3
                return F.array_contains(held, term) | (long(term) & F.exists(near, lambda h: (h.startswith(term) | term.startswith(h)) & gap(h)))

            terms = F.filter(T.question_terms(question), lambda t: ~t.startswith("##"))
            return F.transform(terms, lambda t: F.struct(t.alias("term"), found(t).alias("found")))

        return T.bound(F.filter(held, long), one)

    return T.bound(F.array_distinct(T.truncated(T.tokens(text), most)), each)


def coverage(pairs: DataFrame, df: DataFrame, n: DataFrame, skip_short_unseen: bool = False, most: int = 512) -> DataFrame:
    """Adds coverage: the share of idf of a question's terms that a text holds, exactly or as a related term.

    pairs: question_id, passage_id, question, text. A question without usable terms has 1. Terms that
    the frequency table lacks count with df 0, or are skipped up to 3 bytes if skip_short_unseen.
    """
    key = ["question_id", "passage_id"]
    terms = pairs.select(*key, F.explode(held_terms(F.col("question"), F.col("text"), most)).alias("t")).select(*key, "t.term", "t.found")
    terms = terms.join(df, "term", "left")
    if skip_short_unseen:
        terms = terms.where(F.col("df").isNotNull() | (F.octet_length("term") > 3))
    weight = L.idf(F.col("n"), F.coalesce("df", F.lit(0)))
    sums = terms.crossJoin(F.broadcast(n)).select(*key, "found", weight.alias("w")).groupBy(*key).agg(
        (F.sum(F.when(F.col("found"), F.col("w")).otherwise(0.0)) / F.sum("w")).alias("coverage")
    )
    return pairs.join(sums, key, "left").withColumn("coverage", F.coalesce("coverage", F.lit(1.0)))


#: Words that may lead a question without being part of its phrase.
LEAD_WORDS = "what which who where when how why is are was were does do did many much the s '".split()


def phrase_tokens(question: Column) -> Column:
    """Question tokens without closing question marks and without a leading run of LEAD_WORDS."""

    def without_end(found: Column) -> Column:
        kept = F.filter(F.transform(found, lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda x: x.t != "?")
        return F.slice(found, 1, F.coalesce(F.try_element_at(kept, F.lit(-1))["i"], F.lit(-1)) + 1)

    def without_lead(found: Column) -> Column:
        first = F.filter(F.transform(found, lambda t, i: F.when(~t.isin(LEAD_WORDS), i)), lambda i: i.isNotNull())
        return F.when(F.size(first) > 0, F.slice(found, F.get(first, F.lit(0)) + 1, F.lit(1_000_000))).otherwise(F.slice(found, 1, 0))

    return T.bound(T.bound(T.truncated(T.tokens(question), 128), without_end), without_lead)


def phrase_match(pairs: DataFrame) -> DataFrame:
    """Adds phrase: the longest run of question tokens that stands in the text's first 512, over the question's length.

    A fold over the run's start: from each one, longer runs than the best so far are looked up in the marked text, until one fails. A
    row stays one row, and its text is tokenised once.
    """
    mark = F.lit("\x1f")
    marked = lambda found: F.concat(mark, F.array_join(found, "\x1f"), mark)

    def longest(q: Column, text: Column) -> Column:
        def lengthened(best: Column, i: Column) -> Column:
            more = F.sequence(F.lit(1), F.size(q) - i)
            return F.aggregate(more, best, lambda b, n: F.when((n == b + 1) & text.contains(marked(F.slice(q, i + 1, n))), n).otherwise(b))

        run = F.aggregate(F.sequence(F.lit(0), F.size(q) - 1), F.lit(0), lengthened)
        return F.when(F.size(q) > 0, run / F.size(q)).otherwise(0.0)

    text = marked(T.truncated(T.tokens(F.col("text")), 512))
    found = T.bound(phrase_tokens(F.col("question")), lambda q: T.bound(text, lambda t: longest(q, t)))
    return pairs.withColumn("phrase", found)


def prerank_score(score: Column, coverage_: Column, phrase: Column, config: RetrievalConfig = DEFAULT) -> Column:
    return score + config.prerank_coverage * coverage_ + config.prerank_phrase * phrase


def interleaved(first: DataFrame, second: DataFrame, most: int = 8) -> DataFrame:
    """A1, B1, A2, B2, ... of two rankings (question_id, passage_id, rank): repeats go to their first place, then the cut."""
    both = first.select("question_id", "passage_id", (F.col("rank") * 2).alias("place")).unionByName(
        second.select("question_id", "passage_id", (F.col("rank") * 2 + 1).alias("place"))
    )
    both = both.groupBy("question_id", "passage_id").agg(F.min("place").alias("place"))
    own = Window.partitionBy("question_id").orderBy("place")
    return both.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= most).select("question_id", "passage_id", "rank")


def best_sentences(pairs: DataFrame, df: DataFrame, n: DataFrame, skip_short_unseen: bool = False) -> DataFrame:
    """(question_id, passage_id, place, coverage, best, with_previous, with_next): a passage's sentence of the highest coverage, first on ties.

    The window modes of the reader take it alone, after the sentence before it, or before the one after it.
    """
    rows = pairs.select("question_id", "passage_id", "question", F.posexplode(T.sentences(F.col("text"))).alias("place", "text"))
    keyed = rows.withColumn("passage_id", F.col("passage_id") * 64 + F.col("place"))
    covered = coverage(keyed, df, n, skip_short_unseen).withColumn("place", F.pmod(F.col("passage_id"), F.lit(64)).cast("int")).withColumn("passage_id", F.floor(F.col("passage_id") / 64))
    own = Window.partitionBy("question_id", "passage_id")
    covered = covered.withColumn("before", F.lag("text").over(own.orderBy("place"))).withColumn("after", F.lead("text").over(own.orderBy("place")))
    covered = covered.withColumn("rank", F.row_number().over(own.orderBy(F.desc(F.round("coverage", 9)), "place"))).where("rank = 1")
    return covered.select("question_id", "passage_id", "place", "coverage", F.col("text").alias("best"), F.concat_ws(" ", "before", "text").alias("with_previous"), F.concat_ws(" ", "text", "after").alias("with_next"))
