"""Spans, answers, votes and acceptance, as Column expressions and small windows over candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.config import DEFAULT, RetrievalConfig

#: Answers that stand for the article's subject.
PRONOUNS = ("it", "they", "he", "she", "this", "these", "the city", "the country", "the species")
SPAN = 24


def best_spans(tokens: DataFrame, by: str = "question_id") -> DataFrame:
    """(by, i, j, span_score): the best start and end at most SPAN - 1 apart, for tokens (by, pos, start, end, echo).

    A span made only of echo tokens (those of the question) doesn't count; of equal sums the first start,
    then the first end wins; sums are rounded to six decimals, as those of equal numbers may differ in the last bit. Starts meet only the ends of their own range, by a generated position.
    """
    starts = tokens.select(by, F.col("pos").alias("i"), "start", F.explode(F.sequence(F.col("pos"), F.col("pos") + SPAN - 1)).alias("pos"))
    ends = tokens.select(by, "pos", "end", F.sum(F.when(F.col("echo"), 0).otherwise(1)).over(Window.partitionBy(by).orderBy("pos")).alias("own"))
    before = tokens.select(by, F.col("pos").alias("i"), (F.sum(F.when(F.col("echo"), 0).otherwise(1)).over(Window.partitionBy(by).orderBy("pos")) - F.when(F.col("echo"), 0).otherwise(1)).alias("base"))
    spans = starts.join(ends, [by, "pos"]).join(before, [by, "i"]).where("own > base")
    best = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("span_score"), "i", "j"))
    spans = spans.select(by, "i", F.col("pos").alias("j"), F.round(F.col("start") + F.col("end"), 6).alias("span_score"))
    return spans.withColumn("n", best).where("n = 1").drop("n")


def confidence(margin: Column, dense: Column, coverage: Column) -> Column:
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return 0.5 / (1.0 + F.exp(-0.35 * margin)) + 0.2 * unit((dense - 0.25) * 2.5) + 0.3 * coverage


def damped(value: Column, answer: Column, sentence: Column) -> Column:
    """x 0.6 for answers of more than 60 % of the sentence or 140 bytes."""
    long = (F.octet_length(answer) > 0.6 * F.octet_length(sentence)) | (F.octet_length(answer) > 140)
    return F.when(long, value * 0.6).otherwise(value)


def clipped(answer: Column) -> Column:
    """At most 500 bytes (a character that would be cut goes), without trailing spaces, full stops, commas and semicolons."""
    raw = F.encode(answer, "utf-8")
    # From the 500th byte back to one that begins a character: at most 3 steps.
    starts = lambda k: ~F.hex(F.substring(raw, k, 1)).rlike("^[89AB]")
    end = F.when(F.octet_length(answer) <= 500, 500).when(starts(501), 500).when(starts(500), 499).when(starts(499), 498).otherwise(497)
    return F.regexp_replace(F.decode(F.substring(raw, F.lit(1), end), "utf-8"), "[ .,;]+$", "")


def bare_title(title: Column) -> Column:
    return F.trim(F.substring_index(title, "(", 1))


def resolved(answer: Column, title: Column) -> Column:
    plain = F.regexp_replace(F.lower(answer), "[ .]+$", "")
    return F.when(plain.isin(list(PRONOUNS)), bare_title(title)).otherwise(answer)


def without_title_prefix(answer: Column, title: Column) -> Column:
    """Without a leading "Title:"; null if nothing stays."""
    cut = F.when(answer.startswith(F.concat(title, F.lit(":"))), F.ltrim(F.substring(answer, F.length(title) + 2, F.length(answer)))).otherwise(answer)
    return F.nullif(cut, F.lit(""))


def _plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[\x00-\x1F!-/:-@\[-`{-~]", ""))


def is_title(answer: Column, title: Column) -> Column:
    """The answer is the article's subject: equal when normalised, or one a prefix of the other by one byte."""
    a = F.regexp_replace(_plain(answer), "^the ", "")
    t = _plain(F.substring_index(title, "(", 1))
    x, y = F.octet_length(a), F.octet_length(t)
    return (F.least(x, y) >= 3) & ((a == t) | ((F.abs(x - y) <= 1) & (a.startswith(t) | t.startswith(a))))


def voting_form(answer: Column) -> Column:
    return F.rtrim(F.regexp_replace(F.regexp_replace(F.lower(answer), "^(the|an|a) ", ""), r"[\x00-\x1F!-/:-@\[-`{-~]", ""))


def candidate_score(margin: Column, score: Column, first: Column, coverage: Column, phrase: Column, titled: Column, config: RetrievalConfig = DEFAULT) -> Column:
    return (
        margin + config.weight_retrieval * (score - first) + config.weight_coverage * (coverage - 1.0)
        + config.weight_phrase * (phrase - 1.0) + F.when(titled, config.weight_title).otherwise(0.0)
    )


def voted(candidates: DataFrame, config: RetrievalConfig = DEFAULT, by: str = "question_id") -> DataFrame:
    """Adds total and won to candidates (by, rank, answer, margin, sc).

    total = sc + weight * the positive margins of other candidates with a matching answer: equal in voting
    form, or one inside the other if both have 4 bytes. A question has at most read_top candidates, so they
    vote inside one array of that size, without a join.
    """
    rows = candidates.withColumn("form", voting_form(F.col("answer")))
    rows = rows.withColumn("all", F.collect_list(F.struct("rank", "form", "margin")).over(Window.partitionBy(by)))
    same = lambda o: (o.form == F.col("form")) | ((F.least(F.octet_length(o.form), F.octet_length("form")) >= 4) & (o.form.contains(F.col("form")) | F.col("form").contains(o.form)))
    other = F.filter("all", lambda o: (o.rank != F.col("rank")) & (o.form != "") & (F.col("form") != "") & same(o))
    votes = F.aggregate(other, F.lit(0.0), lambda s, o: s + F.greatest(o.margin, F.lit(0.0)))
    rows = rows.withColumn("total", F.col("sc") + config.weight_vote * votes)
    first = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("total"), "rank"))
    return rows.withColumn("won", first == 1).drop("all", "form")


def accepted(answer: Column, confidence_: Column, margin: Column, titled: Column, config: RetrievalConfig = DEFAULT) -> Column:
    return (answer != "") & (confidence_ >= config.accept) & ((margin >= 0) | (titled & (margin >= config.title_margin)))


def assembled(texts: Column, most: int = 6, capacity: int = 8192) -> Column:
    """array<struct<place, text, from_byte, to_byte>>: texts in order, up to six and a byte capacity (where it stops), without those inside one another.

    Joined by a space they are the reader's context; from_byte and to_byte are a text's bounds in it.
    """

    def add(state: Column, t: Column, place: Column) -> Column:
        inside = F.exists(state.out, lambda o: F.lower(o.text).contains(F.lower(t)) | F.lower(t).contains(F.lower(o.text)))
        end = F.coalesce(F.try_element_at(state.out, F.lit(-1))["to_byte"], F.lit(0))
        room = end + F.octet_length(t) + 2 < capacity
        take = ~state.stop & ~inside & room & (F.size(state.out) < most)
        start = F.when(end > 0, end + 1).otherwise(0)
        one = F.struct(place.alias("place"), t.alias("text"), start.alias("from_byte"), (start + F.octet_length(t)).alias("to_byte"))
        return F.struct(F.when(take, F.concat(state.out, F.array(one))).otherwise(state.out).alias("out"), (state.stop | (~inside & ~room)).alias("stop"))

    none = F.array().cast("array<struct<place: int, text: string, from_byte: int, to_byte: int>>")
    start = F.struct(none.alias("out"), F.lit(False).alias("stop"))
    return F.aggregate(F.transform(texts, lambda t, k: F.struct(t.alias("t"), k.alias("k"))), start, lambda state, x: add(state, x.t, x.k), lambda s: s.out)


def context_of(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s.text), " ")


def segment_of(segments: Column, from_byte: Column) -> Column:
    """The segment that holds a byte of the context; the first if it stands between two."""
    return F.coalesce(F.get(F.filter(segments, lambda s: (from_byte >= s.from_byte) & (from_byte < s.to_byte)), F.lit(0)), segments[0])


def promoted(hits: DataFrame, by: str = "question_id") -> DataFrame:
    """The winning hit first, the others in order: adds place."""
    return hits.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("won"), "rank")))
