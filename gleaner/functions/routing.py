"""Message classification as Column expressions.

Names of a home collection's own people and places are parameters, since they belong to its data.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import contains_any, padded

# Word and phrase lists of the rules.
PRONOUN_WORDS = "his her hers their theirs he she they them him it its that this there those these one else also too about".split()
TITLE_SKIP = (
    "the and for von van der und his every page wiki site footer image caption how works notable official poster propaganda "
    "france germany siberia netherlands london "
    "country island government culture science education finance housing defence defense military army navy air police "
    "laws law games game train station palace castle home bank royal national history economy politics migration affairs "
    "social foreign health healthcare ministry minister ministers cabinet parliament constitution citizens citizen region regions "
    "city capital kingdom king queen prince princess emperor empire republic state states nation people language anthem flag motto "
    "standard battle war wars peace luxury forest express lines enterprises company companies group timeline overview list map guide rules ranks commands"
).split()
PROPER_STOP = (
    "The A An I It If You Yes No In On At He She They We This That There Hi Hello Hey How What Who Where When Why Which Sure Of And Or But So Is Are Was Were Do Does Did "
    "Can Could Would Should My Your His Her Its Our Their Not To For With As By From About"
).split()
WORLD_CUES = (
    " world ", " earth ", " europe ", " asia ", " africa ", " america ", " country ", " countries ", " planet ", " history ", " real life ", " real world ",
    " france ", " spain ", " england ", " britain ", " uk ", " usa ", " united states ", " germany ", " italy ", " japan ", " china ", " india ", " russia ", " netherlands ", " belgium ",
    " roman ", " british ", " french ", " german ", " dutch republic ", " ancient ", " medieval ", " century ", " bc ", " ad ",
)
DOMAIN_WORDS = "play game games rank ranks citizen citizens server".split()
LIFE_WORDS = (
    "king queen prince princess kingdom minister ministers ministry cabinet parliament army navy airforce military police "
    "laws law anthem hymn motto flag capital region regions train palace castle consulate royal"
).split()
TIER_A = (
    " how are you ", " how r u ", " who are you ", " what are you ", " what can you do ", " what do you do ", " favourite ", " favorite ", " do you like ", " do you love ",
    " what do you think ", " your opinion ", " joke ", " bored ", " boring ", " i m bored ", " tell me about yourself ", " are you a bot ", " are you human ", " are you real ", " what s your name ", " your name ",
)
TIER_B = (
    " hello ", " hi ", " hey ", " hiya ", " yo ", " sup ", " what s up ", " whats up ", " good morning ", " good evening ", " good night ", " good afternoon ", " thank ", " thanks ", " thx ", " ty ",
    " bye ", " goodbye ", " see you ", " see ya ", " cya ", " lol ", " haha ", " nice ", " cool ", " ok ", " okay ", " great ", " awesome ", " wow ", " love you ", " you re great ", " you are great ", " good bot ", " well done ",
)
QUESTION_WORDS = (
    " who ", " what ", " when ", " where ", " which ", " why ", " how ", " tell ", " list ", " name ", " explain ", " give ", " show ", " is ", " are ", " does ", " do ", " can ", " did ", " was ",
)
ARITHMETIC = (
    " plus ", " minus ", " times ", " divided ", " multiplied ", " percent ", " square root ", " squared ", " cubed ", " prime number ",
    " bigger ", " larger ", " smaller ", " greater ", " less than ", " more than ", " how many are left ", " sum of ", " product of ", " difference between ", " average of ", " half of ", " twice ", " equals ",
)
REACTIONS = ("why", "really", "how come", "and you", "and yours", "same", "me too", "cool", "nice", "ok", "okay", "lol", "haha", "seriously", "sure", "no way", "wow", "what about you")
LIVE = (
    " weather ", " temperature today ", " temperature outside ", " temperature right now ", " temperature in ", " raining ", " snowing ", " forecast ", " time is it ", " what time ", " today s date ",
    " what day is ", " who is online ", " who s online ", " anyone online ", " latest news ", " any news ", " the news ",
)
AGE = (" how old ", " age of ", " s age ")
BORED = (" bored ", " boring ", " nothing to do ")
OPINION = (" do you like ", " do you love ", " what do you think of ", " what do you think about ", " your opinion of ", " your opinion on ", " are you a fan of ", " do you admire ")
HOME_WORDS = (" king ", " queen ", " prince ", " kingdom ", " minister ", " region", " army ", " navy ", " military ", " train ", " palace ", " castle ")


def ascii_words(text: Column, extra: str = "'") -> Column:
    """Runs of ASCII letters, digits and the extra characters, as written."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"[A-Za-z0-9{extra}]+"), F.lit(0))


def needs_context(text: Column) -> Column:
    """A pronoun-like word, or at most five words and no capitalised word after the first."""
    words = ascii_words(text)
    pronoun = F.exists(words, lambda w: F.lower(w).isin(PRONOUN_WORDS))
    capital = F.coalesce(text, F.lit("")).rlike(r"[A-Za-z0-9 ](?:.*[^A-Za-z0-9])?[A-Z]")
    return pronoun | ((F.size(words) <= 5) & ~capital)


def smalltalk_tier(text: Column) -> Column:
    """1: persona or opinion talk; 2: a greeting of at most six words without a question word; else 0."""
    n = padded(text, "'")
    words = F.size(F.filter(F.split(n, " "), lambda w: w != ""))
    second = (words <= 6) & ~contains_any(n, QUESTION_WORDS) & contains_any(n, TIER_B)
    return F.when(contains_any(n, TIER_A), 1).when(second, 2).otherwise(0)


def is_arithmetic(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    by_sign = text.rlike(r"[0-9] *[+\-*/x^] *[0-9]")
    return text.rlike("[0-9]") & (contains_any(padded(text, "."), ARITHMETIC) | text.contains("%") | by_sign)


def mode(text: Column, home_words=HOME_WORDS) -> Column:
    n = padded(text)
    opinion = contains_any(n, OPINION) & contains_any(n, home_words)
    return F.when(contains_any(n, LIVE), "live").when(contains_any(n, BORED), "bored").when(contains_any(n, AGE), "age").when(opinion, "opinion").otherwise("normal")


def world_cue(text: Column) -> Column:
    return contains_any(padded(text), WORLD_CUES)


def is_reaction(text: Column) -> Column:
    """A message under 40 bytes that begins with a reaction or has under 12 bytes."""
    low = F.lower(F.coalesce(text, F.lit("")))
    starts = F.lit(False)
    for word in REACTIONS:
        starts = starts | low.startswith(word)
    return (F.octet_length(low) < 40) & (starts | (F.octet_length(low) < 12))


def entity_form(word: Column) -> Column:
    return F.regexp_replace(F.lower(word), "'s$", "")


def home_sure(margin: Column, confidence: Column, answer: Column, title: Column, query: Column, generic_title: str = "") -> Column:
    """The home index is sure by itself: a wide margin, or a decent one with the passage's title in the query."""
    wide = (margin > 8) & ((confidence >= 0.6) | (F.octet_length(answer) > 25)) & (F.lower(answer) != generic_title)
    named = (margin > 4) & (F.octet_length(title) >= 6) & F.lower(query).contains(F.lower(title)) & (F.lower(title) != generic_title)
    return wide | named


def route(tier: Column, entity: Column, mode_: Column, reaction: Column, arithmetic: Column, sure: Column, wide_accepted: Column, confidence: Column, margin: Column) -> Column:
    """chat, facts, wide (the encyclopedia) or outside, by the first rule that holds."""
    return (
        F.when((tier == 1) | ((tier == 2) & ~entity) | (mode_ == "live") | reaction, "chat")
        .when(arithmetic, "outside")
        .when(~entity & ~sure & wide_accepted, "wide")
        .when(entity | ((confidence >= 0.30) & (margin >= 0)), "facts")
        .otherwise("outside")
    )


def provenance_note(route_: Column, reply: Column, home_names=()) -> Column:
    """The note that a reply still needs, or null."""
    low = F.lower(reply)
    noted = low.contains("not from the wiki") | low.contains("wikis say") | contains_any(low, list(home_names))
    return F.when((route_ == "wide") & (reply != "") & ~low.contains("wikipedia"), " (from Wikipedia)").when((route_ == "outside") & (reply != "") & ~noted, " (not from the wikis)")
