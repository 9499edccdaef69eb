"""Fact selection, prompts, grounding and presentation as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no content of their own (a collection's own names can be added).
CONTENT_STOP = "the and for with from that this are was were has have his her its also into than then kingdom who what which page wiki not but one two all any".split()
# Phrases that ask for a list.
LISTY = ("list", " all ", "what are the", "name the", "which are the", "every")
# Phrases by which a reply refuses.
REFUSALS = ("i can only answer questions about", "i don't have that information", "i cannot answer", "i can't answer")


def content_words(text: Column, most: int = 40, stop=CONTENT_STOP) -> Column:
    """Lower-case ASCII alphanumeric runs of 3 to 23 characters without stop words, at most `most`."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.slice(F.filter(found, lambda w: F.length(w).between(3, 23) & ~w.isin(list(stop))), 1, most)


def adds_nothing(words: Column, seen: Column) -> Column:
    """All content words occur in one earlier line. seen: array of their content words."""
    return (F.size(words) > 0) & F.exists(seen, lambda s: F.size(F.array_except(words, s)) == 0)


def facts_of(hits: Column, most: int = 3) -> Column:
    """array<struct<title, text>> of hits in order without repeats, a third of one shape, or texts that add nothing to one before.

    hits: array<struct<title, text>>, the winner first. Each text's words are cut out once.
    """
    words = F.transform(hits, lambda h: F.struct(h.title.alias("title"), h.text.alias("text"), content_words(h.text).alias("a"), content_words(h.text, 64).alias("b")))

    def add(out: Column, h: Column) -> Column:
        shape = F.size(F.filter(out, lambda o: F.substring(o.text, 1, 20) == F.substring(h.text, 1, 20)))
        same = F.exists(out, lambda o: o.text == h.text)
        drop = same | (shape >= 2) | adds_nothing(h.a, F.transform(out, lambda o: o.b)) | (F.size(out) >= most)
        return F.when(drop, out).otherwise(F.concat(out, F.array(h)))

    none = F.array().cast("array<struct<title: string, text: string, a: array<string>, b: array<string>>>")
    return F.aggregate(words, none, add, lambda out: F.transform(out, lambda o: F.struct(o.title.alias("title"), o.text.alias("text"))))


def fact_prompt(system: str, question: Column, facts: Column, suggested: Column, mode: Column, first_limit: int = 600, limit: int = 200) -> Column:
    """A prompt with facts (array<struct<title, text>>): the reader's suggestion, the facts by title, the question and what it asks for."""
    line = lambda f, i: F.concat(F.lit("- ["), f.title, F.lit("] "), F.when(i == 0, trimmed(f.text, first_limit)).otherwise(trimmed(f.text, limit)), F.lit("\n"))
    hint = F.coalesce(F.concat(F.lit("(The reader suggests the answer is: "), suggested, F.lit(")\n")), F.lit(""))
    marks = F.length(question) - F.length(F.replace(question, F.lit("?"), F.lit("")))
    two = F.when((marks >= 2) & (mode == "normal"), "\n(Two questions - answer both, in order.)").otherwise("")
    wide = F.when(mode == "normal", "\n(Answer in one or two plain sentences using the facts above.)").otherwise("")
    note = F.when(mode == "age", "\n(Use only the birth date or age written in the facts.)").when(mode == "live", "\n(Say that live information is not available.)").when(mode == "bored", "\n(Recommend something and suggest a question.)").otherwise("")
    body = F.concat(hint, F.lit("FACTS:\n"), F.array_join(F.transform(facts, line), ""), F.lit("\nQUESTION: "), question, two, wide, note)
    return F.concat(F.lit(f"<|im_start|>system\n{system}<|im_end|>\n<|im_start|>user\n"), body, F.lit("<|im_end|>\n<|im_start|>assistant\n"))


def trimmed(text: Column, limit: int) -> Column:
    """Cut at the last space within the limit if that lies beyond its half, and marked."""
    cut = F.substring(text, 1, limit)
    at_space = F.regexp_extract(cut, r"(?s)^(.*) [^ ]*$", 1)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.when(F.length(at_space) > limit // 2, at_space).otherwise(cut), F.lit(" ...")))


def suggested_span(answer: Column, confidence: Column, generic_title: str = "") -> Column:
    """The reader's answer as a hint: confident, short; its first sentence if that is over 12 characters; else null."""
    first = F.substring_index(answer, ". ", 1)
    good = (confidence >= 0.45) & (answer != "") & (F.octet_length(answer) < 160) & (F.lower(answer) != generic_title)
    return F.when(good, F.when((F.instr(answer, ". ") > 13), first).otherwise(answer))


def deduplicated(text: Column) -> Column:
    """Sentences whose key (without leading bullets and closing marks) is over 12 characters and came before are dropped."""
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+"), F.lit(0))
    key = lambda s: F.regexp_replace(F.regexp_replace(s, r"^[\s*-]+", ""), r"[\s.!?]+$", "")
    first = F.filter(parts, lambda s, i: (F.length(key(s)) <= 12) | (F.array_position(F.transform(parts, key), key(s)) == i + 1))
    return F.rtrim(F.regexp_replace(F.array_join(first, ""), r"\s+$", ""))


def grounded(answer: Column, reply: Column, confidence: Column, wide: Column) -> Column:
    """At least 70 % of the answer's content words are in the reply; true where that isn't asked for."""
    words, held = content_words(answer), content_words(reply, 400)
    free = (confidence < F.when(wide, 0.5).otherwise(0.6)) | (answer == "") | (F.octet_length(answer) > 100) | (F.size(words) == 0)
    return free | (F.size(F.filter(words, lambda w: F.array_contains(held, w))) * 10 >= F.size(words) * 7)


def token_budget(question: Column) -> Column:
    low, listy = F.lower(question), F.lit(False)
    for phrase in LISTY:
        listy = listy | low.contains(phrase)
    return F.when(listy, 260).otherwise(160)


def first_grounded(answer: Column, title: Column, confidence: Column, wide: Column, replies: list[Column]) -> Column:
    """The first grounded reply; for confident wide answers the answer itself as a last resort; else the first reply."""
    tried = [F.when(grounded(answer, r, confidence, wide), r) for r in replies]
    last = F.when(wide & (confidence >= 0.6), F.concat(answer, F.lit(" (Wikipedia, "), title, F.lit(")")))
    return F.coalesce(*tried, last, replies[0])


def cascade(answer: Column, title: Column, confidence: Column, wide: Column, first: Column, second: Column, focused: Column) -> Column:
    """struct<used, reply>: the first reply if it is grounded, else the second, decoded otherwise.

    If neither is, a confident wide answer gets the reply to the focused prompt, or is told as it is; others keep the first reply.
    """
    chosen = lambda used, reply: F.struct(F.lit(used).alias("used"), reply.alias("reply"))
    good = lambda used, reply: F.when(grounded(answer, reply, confidence, wide), chosen(used, reply))
    told = chosen("told", F.concat(answer, F.lit(" (Wikipedia, "), title, F.lit(")")))
    last = F.when(wide & (confidence >= 0.6), F.coalesce(good("focused", focused), told))
    return F.coalesce(good("first", first), good("second", second), last, chosen("ungrounded", first))


def focus_prompt(system: str, title: Column, passage: Column, question: Column, answer: Column) -> Column:
    """The prompt of the last attempt, without history: one fact, the question, and the answer beside it."""
    body = F.concat(F.lit("FACT ["), title, F.lit("]\n"), passage, F.lit("\n\nQUESTION: "), question, F.lit("\n(The answer is "), answer, F.lit(": give it in one sentence that names what is asked about.)"))
    return F.concat(F.lit(f"<|im_start|>system\n{system}<|im_end|>\n<|im_start|>user\n"), body, F.lit("<|im_end|>\n<|im_start|>assistant\n"))


def turn_block(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), F.when(role == "assistant", "assistant").otherwise("user"), F.lit("\n"), text, F.lit("<|im_end|>\n"))


def prompt(system: str, history: Column, question: Column, facts: Column, mode: Column) -> Column:
    """ChatML prompt of a system text, history array<struct<role, text>>, fact lines, the question and a note for its mode."""
    past = F.array_join(F.transform(history, lambda h: turn_block(h.role, h.text)), "")
    lines = F.when(F.size(facts) > 0, F.concat(F.lit("FACTS:\n"), F.array_join(F.transform(facts, lambda f: F.concat(F.lit("- "), f, F.lit("\n"))), ""), F.lit("\nQUESTION: "))).otherwise("")
    note = F.when(mode == "age", "\n(Use only the birth date or age written in the facts.)").when(mode == "live", "\n(Say that live information is not available.)").otherwise("")
    return F.concat(F.lit(f"<|im_start|>system\n{system}<|im_end|>\n"), past, F.lit("<|im_start|>user\n"), lines, question, note, F.lit("<|im_end|>\n<|im_start|>assistant\n"))


def bucket(confidence: Column) -> Column:
    return F.when(confidence > 0.6, "confident").when(confidence > 0.35, "probably").otherwise("unsure")


def not_found(confidence: Column, answer: Column) -> Column:
    return (confidence < 0.22) | F.coalesce(answer == "", F.lit(True))


def highlighted(sentence: Column, answer: Column) -> Column:
    """struct<before, hit, after> of the first occurrence in any case; all in before if there is none."""
    at = F.when(answer != "", F.instr(F.lower(sentence), F.lower(answer))).otherwise(0)
    n = F.length(answer)
    return F.struct(
        F.when(at > 0, F.substring(sentence, F.lit(1), at - 1)).otherwise(sentence).alias("before"),
        F.when(at > 0, F.substring(sentence, at, n)).otherwise("").alias("hit"),
        F.when(at > 0, F.substring(sentence, at + n, F.length(sentence))).otherwise("").alias("after"),
    )


def graded(reply: Column, accepted: Column) -> Column:
    """Any accepted phrase is in the reply (none: true), no failed flag: !norefuse, !short."""
    low = F.lower(reply)
    phrases, flags = F.filter(accepted, lambda a: ~a.startswith("!")), F.filter(accepted, lambda a: a.startswith("!"))
    ok = (F.size(phrases) == 0) | F.exists(phrases, lambda p: low.contains(F.lower(p)))
    refused = F.lit(False)
    for text in REFUSALS:
        refused = refused | low.contains(text)
    words = F.size(F.filter(F.split(reply, r"\s+"), lambda w: w != ""))
    return ok & ~(F.array_contains(flags, "!norefuse") & refused) & ~(F.array_contains(flags, "!short") & (words > 40))
