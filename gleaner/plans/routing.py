"""Queries on message routing. The tables' prose holds no questions, so fixed phrases are added to it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gleaner.functions import routing as G

from .binding import strings, table, title_of
from .registry import query

PHRASES = (
    "Hello", "hi there friend", "How are you?", "What is your name", "thanks a lot", "Tell me a joke", "what is 15% of 200", "is 17 a prime number", "2024-01-01", "twice the size", "3 + 4", "capital?",
    "What's the population of Tokyo?", "and the queen?", "who is he", "The king of Spain", "what is the weather today", "how old is the king", "I am bored", "do you like the king?", "do you like tea", "why that one?",
    "really", "Is there any news", "our navy", "the world's largest army", "ok", "Great work on that long explanation of all the things", "", "what time is it in Paris",
)
_PH = "ph AS (SELECT unnest(range(0, " + str(len(PHRASES)) + ")) AS id, unnest(" + strings(PHRASES) + ") AS text), msg AS (SELECT 'p' || id AS id, text FROM ph UNION ALL SELECT 'c' || conv_id || '.' || turn, text FROM conversations)"


def _messages(spark, sf_dir):
    fixed = spark.createDataFrame([(f"p{k}", t) for k, t in enumerate(PHRASES)], "id string, text string")
    turns = table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string")).alias("id"), "text")
    return fixed.unionByName(turns)


def _pad(keep: str = "") -> str:
    return f"(' ' || regexp_replace(lower(coalesce(text, '')), '[^a-z0-9{keep}]', ' ', 'g') || ' ')"


def _any(column: str, phrases) -> str:
    return f"len(list_filter({strings(phrases)}, lambda p: contains({column}, p))) > 0"


_TIER = f"""CASE WHEN {_any("na", G.TIER_A)} THEN 1 WHEN len(list_filter(string_split(na, ' '), lambda w: w <> '')) <= 6 AND NOT {_any("na", G.QUESTION_WORDS)} AND {_any("na", G.TIER_B)} THEN 2 ELSE 0 END"""
_NORM = f"""{_PH}, m AS (SELECT id, text, {_pad("''")} AS na, {_pad()} AS n, {_pad(".")} AS nd FROM msg)"""
_MODE = f"""CASE WHEN {_any("n", G.LIVE)} THEN 'live' WHEN {_any("n", G.BORED)} THEN 'bored' WHEN {_any("n", G.AGE)} THEN 'age' WHEN {_any("n", G.OPINION)} AND {_any("n", G.HOME_WORDS)} THEN 'opinion' ELSE 'normal' END"""
_ARITH = f"""(regexp_matches(text, '[0-9]') AND ({_any("nd", G.ARITHMETIC)} OR contains(text, '%') OR regexp_matches(text, '[0-9] *[+\\-*/x^] *[0-9]')))"""
_CONTEXT = f"""(len(list_filter(regexp_extract_all(text, '[A-Za-z0-9'']+'), lambda w: list_contains({strings(G.PRONOUN_WORDS)}, lower(w)))) > 0
  OR (len(regexp_extract_all(text, '[A-Za-z0-9'']+')) <= 5 AND NOT regexp_matches(text, '[A-Za-z0-9 ](?:.*[^A-Za-z0-9])?[A-Z]')))"""


@query("smalltalk", f"WITH {_NORM} SELECT id, {_TIER} AS tier FROM m")
def smalltalk(spark, sf_dir):
    return _messages(spark, sf_dir).select("id", G.smalltalk_tier(F.col("text")).alias("tier"))


@query("arithmetic", f"WITH {_NORM} SELECT id, {_ARITH} AS arithmetic FROM m")
def arithmetic(spark, sf_dir):
    return _messages(spark, sf_dir).select("id", G.is_arithmetic(F.col("text")).alias("arithmetic"))


@query("mode", f"WITH {_NORM} SELECT id, {_MODE} AS mode FROM m")
def mode(spark, sf_dir):
    return _messages(spark, sf_dir).select("id", G.mode(F.col("text")).alias("mode"))


@query("needs_context", f"WITH {_NORM} SELECT id, {_CONTEXT} AS needs_context FROM m")
def needs_context(spark, sf_dir):
    return _messages(spark, sf_dir).select("id", G.needs_context(F.col("text")).alias("needs_context"))


@query("world_cue", f"WITH {_NORM} SELECT id, {_any('n', G.WORLD_CUES)} AS world FROM m")
def world_cue(spark, sf_dir):
    return _messages(spark, sf_dir).select("id", G.world_cue(F.col("text")).alias("world"))


_ENT = f"""words AS (SELECT DISTINCT lower(w) AS word FROM (SELECT unnest(regexp_extract_all(array_to_string(regexp_split_to_array(text, '\\s+')[1:3], ' '), '[A-Za-z0-9][A-Za-z0-9'']*')) AS w FROM documents)
  WHERE length(w) BETWEEN 3 AND 40 AND NOT list_contains({strings(G.TITLE_SKIP)}, lower(w)))"""


def _entities(spark, sf_dir):
    """Distinct lower-case title words of 3 to 40 characters without the skip list."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(title_of("text"), F.lit("[A-Za-z0-9][A-Za-z0-9']*"), F.lit(0))).alias("w"))
    return words.where(F.length("w").between(3, 40)).select(F.lower("w").alias("word")).where(~F.col("word").isin(G.TITLE_SKIP)).distinct()


@query("entity_vocab", f"WITH {_ENT} SELECT word FROM words")
def entity_vocab(spark, sf_dir):
    return _entities(spark, sf_dir)


_HAS = f"""tt AS (SELECT DISTINCT lower(regexp_extract(text, '^[A-Za-z0-9]+')) AS title FROM documents),
fn AS (SELECT DISTINCT id FROM (SELECT id, unnest(regexp_extract_all(text, '[^.?!A-Za-z0-9]([A-Z][A-Za-z0-9''-]+)', 1)) AS w FROM m)
  WHERE length(w) >= 3 AND lower(regexp_replace(w, '''s$', '')) NOT IN (SELECT word FROM words) AND lower(regexp_replace(w, '''s$', '')) IN (SELECT title FROM tt)),
mw AS (SELECT id, unnest(regexp_extract_all(text, '[A-Za-z0-9'']+')) AS w FROM m),
ent AS (SELECT DISTINCT id FROM mw JOIN words ON word = regexp_replace(lower(w), '''s$', '') WHERE length(w) >= 3),
dom AS (SELECT DISTINCT id FROM mw WHERE list_contains({strings(G.DOMAIN_WORDS)}, lower(w))), life AS (SELECT DISTINCT mw.id FROM mw JOIN m ON m.id = mw.id WHERE list_contains({strings(G.LIFE_WORDS)}, lower(w)) AND NOT {_any("m.n", G.WORLD_CUES)} AND mw.id NOT IN (SELECT id FROM fn)),
he AS (SELECT m.*, m.id IN (SELECT id FROM ent UNION SELECT id FROM dom UNION SELECT id FROM life) AS entity FROM m)"""


def _titles(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.lower(F.regexp_extract("text", "^[A-Za-z0-9]+", 0)).alias("word")).distinct()


def _foreign(messages, entities, titles, *key):
    """(key, word): capitalised words inside a sentence that are no entities but titles of the wide collection."""
    words = messages.select(*key, F.explode(F.regexp_extract_all("text", F.lit(r"[^.?!A-Za-z0-9]([A-Z][A-Za-z0-9'-]+)"), F.lit(1))).alias("w"))
    words = words.where(F.length("w") >= 3).select(*key, G.entity_form(F.col("w")).alias("word"))
    return words.join(entities, "word", "left_anti").join(titles, "word", "left_semi")


def _with_entity(messages, entities, titles, key="id"):
    """Adds entity: a word of the vocabulary, a domain word, or a life word without a cue to the outside world or a foreign noun."""
    words = messages.select(key, F.explode(G.ascii_words(F.col("text"))).alias("w"))
    named = words.where(F.length("w") >= 3).select(key, G.entity_form(F.col("w")).alias("word")).join(entities, "word", "left_semi").select(key).distinct()
    foreign = _foreign(messages, entities, titles, key).select(key).distinct()
    rows = messages.join(named.withColumn("named", F.lit(True)), key, "left").join(foreign.withColumn("foreign", F.lit(True)), key, "left")
    own = G.ascii_words(F.col("text"))
    domain = F.exists(own, lambda w: F.lower(w).isin(G.DOMAIN_WORDS))
    life = F.exists(own, lambda w: F.lower(w).isin(G.LIFE_WORDS)) & ~G.world_cue(F.col("text")) & F.col("foreign").isNull()
    return rows.withColumn("entity", F.coalesce("named", F.lit(False)) | domain | life).drop("named", "foreign")


@query("has_entity", f"WITH {_NORM}, {_ENT}, {_HAS} SELECT id, entity FROM he")
def has_entity(spark, sf_dir):
    return _with_entity(_messages(spark, sf_dir), _entities(spark, sf_dir), _titles(spark, sf_dir)).select("id", "entity")


@query("title_member", """WITH t AS (SELECT DISTINCT lower(array_to_string(regexp_split_to_array(text, '\\s+')[1:1], ' ')) AS title FROM documents),
w AS (SELECT DISTINCT lower(w) AS w FROM (SELECT unnest(regexp_split_to_array(text, '\\s+')) AS w FROM conversations)) SELECT w FROM w WHERE w IN (SELECT title FROM t)""")
def title_member(spark, sf_dir):
    titles = table(spark, sf_dir, "documents").select(F.lower(F.split("text", r"\s+")[0]).alias("w")).distinct()
    words = table(spark, sf_dir, "conversations").select(F.explode(F.split(F.lower("text"), r"\s+")).alias("w")).distinct()
    return words.join(titles, "w", "left_semi")


_FOREIGN = f"""f0 AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[^.?!A-Za-z0-9]([A-Z][A-Za-z0-9''-]+)', 1)) AS w FROM conversations),
f1 AS (SELECT conv_id, turn, lower(regexp_replace(w, '''s$', '')) AS w FROM f0 WHERE length(w) >= 3), tt AS (SELECT DISTINCT lower(regexp_extract(text, '^[A-Za-z0-9]+')) AS title FROM documents)"""


@query("foreign_noun", f"WITH {_ENT}, {_FOREIGN} SELECT conv_id, turn, count(DISTINCT w) AS n FROM f1 WHERE w NOT IN (SELECT word FROM words) AND w IN (SELECT title FROM tt) GROUP BY ALL")
def foreign_noun(spark, sf_dir):
    """Capitalised words inside a sentence that are no entities but titles."""
    found = _foreign(table(spark, sf_dir, "conversations"), _entities(spark, sf_dir), _titles(spark, sf_dir), "conv_id", "turn")
    return found.groupBy("conv_id", "turn").agg(F.count_distinct("word").alias("n"))


@query("context_expand", f"""WITH {_ENT}, pn AS (SELECT conv_id, turn, list_distinct_ordered FROM (SELECT conv_id, turn, list(w ORDER BY p)[1:8] AS list_distinct_ordered FROM (
  SELECT conv_id, turn, w, min(p) AS p FROM (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[A-Za-z0-9''&]+')) AS w, generate_subscripts(regexp_extract_all(text, '[A-Za-z0-9''&]+'), 1) AS p FROM conversations)
  WHERE regexp_matches(w, '^[A-Z]') AND NOT list_contains({strings(G.PROPER_STOP)}, w) AND regexp_replace(lower(w), '''s$', '') IN (SELECT word FROM words) GROUP BY conv_id, turn, w) GROUP BY ALL)),
l AS (SELECT c.conv_id, c.turn, c.text, lag(pn.list_distinct_ordered, 1) OVER w AS l1, lag(pn.list_distinct_ordered, 2) OVER w AS l2 FROM conversations c LEFT JOIN pn USING (conv_id, turn) WINDOW w AS (PARTITION BY c.conv_id ORDER BY c.turn)),
e AS (SELECT *, coalesce(l1, []) || list_filter(coalesce(l2, []), lambda x: NOT list_contains(coalesce(l1, []), x)) AS extra FROM l)
SELECT conv_id, turn, md5(CASE WHEN {_CONTEXT} AND len(extra) > 0 THEN text || ' (' || array_to_string(extra[1:16], ' ') || ')' ELSE text END) AS digest FROM e""")
def context_expand(spark, sf_dir):
    """A turn that needs context borrows the capitalised entity words of the two turns before it, newest first."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    words = turns.select("conv_id", "turn", F.posexplode(G.ascii_words(F.col("text"), "'&")).alias("p", "w"))
    words = words.where(F.col("w").rlike("^[A-Z]") & ~F.col("w").isin(G.PROPER_STOP)).withColumn("word", G.entity_form(F.col("w"))).join(_entities(spark, sf_dir), "word", "left_semi")
    words = words.groupBy("conv_id", "turn", "w").agg(F.min("p").alias("p")).groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(F.struct("p", "w"))).alias("l"))
    words = words.select("conv_id", "turn", F.slice(F.transform("l", lambda x: x.w), 1, 8).alias("nouns"))
    own = Window.partitionBy("conv_id").orderBy("turn")
    none = F.array().cast("array<string>")
    rows = turns.join(words, ["conv_id", "turn"], "left").withColumn("l1", F.coalesce(F.lag("nouns", 1).over(own), none)).withColumn("l2", F.coalesce(F.lag("nouns", 2).over(own), none))
    extra = F.slice(F.concat("l1", F.array_except("l2", "l1")), 1, 16)
    full = F.when(G.needs_context(F.col("text")) & (F.size(extra) > 0), F.concat("text", F.lit(" ("), F.array_join(extra, " "), F.lit(")"))).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.md5(full).alias("digest"))


_TALK = f"""c AS (SELECT 'c' || conv_id || '.' || turn AS id, conv_id, turn FROM conversations UNION ALL SELECT 'p' || id, -1, id FROM ph),
k AS (SELECT c.conv_id, c.turn, he.*, {_TIER} AS tier FROM c JOIN he USING (id)),
l AS (SELECT *, lag(tier, 2) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM k),
rx AS (SELECT *, coalesce(before = 1, false) AND NOT entity AND strlen(text) < 40 AND (strlen(text) < 12 OR len(list_filter({strings(G.REACTIONS)}, lambda p: starts_with(lower(text), p))) > 0) AS chat FROM l)"""


def _talk(spark, sf_dir):
    """The turns of conversations and the fixed phrases as one more, with entity and chat (a reaction to an opinion turn two back)."""
    fixed = spark.createDataFrame([(f"p{k}", -1, k) for k in range(len(PHRASES))], "id string, conv_id long, turn long")
    turns = table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string")).alias("id"), "conv_id", "turn")
    rows = _with_entity(_messages(spark, sf_dir), _entities(spark, sf_dir), _titles(spark, sf_dir)).join(turns.unionByName(fixed), "id")
    before = F.lag(G.smalltalk_tier(F.col("text")), 2).over(Window.partitionBy("conv_id").orderBy("turn"))
    return rows.withColumn("chat", F.coalesce(before == 1, F.lit(False)) & ~F.col("entity") & G.is_reaction(F.col("text")))


@query("reaction", f"WITH {_NORM}, {_ENT}, {_HAS}, {_TALK} SELECT conv_id, turn, chat FROM rx")
def reaction(spark, sf_dir):
    return _talk(spark, sf_dir).select("conv_id", "turn", "chat")


@query("route", f"""WITH {_NORM}, {_ENT}, {_HAS}, {_TALK}, r AS (SELECT id, tier, chat, entity, {_MODE} AS mode, {_ARITH} AS arithmetic, ((strlen(text) * 7) % 23) - 8.0 AS margin, (strlen(text) % 10) / 10.0 AS confidence FROM rx)
SELECT id, CASE WHEN tier = 1 OR (tier = 2 AND NOT entity) OR mode = 'live' OR chat THEN 'chat' WHEN arithmetic THEN 'outside' WHEN NOT entity AND NOT (margin > 8 AND confidence >= 0.6) AND confidence >= 0.45 AND margin >= 0 THEN 'wide'
  WHEN entity OR (confidence >= 0.3 AND margin >= 0) THEN 'facts' ELSE 'outside' END AS route FROM r""")
def route(spark, sf_dir):
    """Stand-in reader: margin and confidence follow from the message's length."""
    rows = _talk(spark, sf_dir)
    n = F.octet_length("text")
    rows = rows.withColumn("margin", F.pmod(n * 7, F.lit(23)) - 8.0).withColumn("confidence", F.pmod(n, F.lit(10)) / 10.0)
    text, margin, conf = F.col("text"), F.col("margin"), F.col("confidence")
    sure = G.home_sure(margin, conf, F.lit(""), F.lit(""), text, "-")
    return rows.select("id", G.route(G.smalltalk_tier(text), F.col("entity"), G.mode(text), F.col("chat"), G.is_arithmetic(text), sure, (conf >= 0.45) & (margin >= 0), conf, margin).alias("route"))


@query("provenance", f"""WITH {_PH}, r AS (SELECT id, text AS reply, CASE strlen(text) % 3 WHEN 0 THEN 'wide' WHEN 1 THEN 'outside' ELSE 'facts' END AS route FROM msg)
SELECT id, CASE WHEN route = 'wide' AND reply <> '' AND NOT contains(lower(reply), 'wikipedia') THEN ' (from Wikipedia)' WHEN route = 'outside' AND reply <> '' AND NOT (contains(lower(reply), 'not from the wiki') OR contains(lower(reply), 'wikis say')) THEN ' (not from the wikis)' END AS note FROM r""")
def provenance(spark, sf_dir):
    kind = F.element_at(F.array(F.lit("wide"), F.lit("outside"), F.lit("facts")), (F.octet_length("text") % 3 + 1).cast("int"))
    return _messages(spark, sf_dir).select("id", G.provenance_note(kind, F.col("text")).alias("note"))
