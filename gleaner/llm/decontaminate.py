"""Benchmark decontamination by template canonicalisation, with DataFrame functions only.

Texts become lower-case word tokens; numbers (with their separators), units after a number and names (runs of
capitalised words, but for COMMON words) become typed placeholders that keep their value on the side. Windows of
WINDOW template tokens are hash-joined between benchmark and documents. Matches of one item on one
diagonal (document position minus item position) are aligned token by token. Their windows must cover
at least LEAST_TOKENS tokens, or all but EDGE of a shorter item, and the windows' slots must be consistent: within
a type, one item value goes with one document value. A verbatim copy maps every value to itself; a re-parameterised
question maps, say, every 12 to 15, and may give two slots the same new value. LEAST_TOKENS tokens in a row with
equal values leak whatever the other slots say; a unit after an altered number is altered with it.

Benchmark windows with fewer than LEAST_WORDS literal tokens are not joined, since placeholders alone
match anything; they count where a neighbour has found the diagonal. An item that has none other keeps them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small

WINDOW = 8
LEAST_TOKENS = 13
LEAST_WORDS = 4
#: Tokens of a short item that may read otherwise at its ends, where a sentence's first word can look like a name.
EDGE = 2
#: Unit words that are placeholders after a number.
UNITS = ("mm cm m km mg g kg ml l s ms min h hz w kw v a pa mph kmh inch inches foot feet mile miles metre metres meter meters gram grams "
         "kilo kilos litre litres second seconds minute minutes hour hours day days week weeks month months year years percent euro euros dollar dollars").split()
#: Words that begin sentences, which aren't names where they are capitalised.
COMMON = ("A An The This That These Those There Here It Its He She They We You I His Her Their Our My Your If When While Where What Which Who Whom Whose Why How "
          "Is Are Was Were Be Do Does Did Can Could Will Would Should Has Have Had In On At Of For To From By With Without After Before During Under Over Between And But Or "
          "As So Then Thus Let Given Suppose Find Calculate Compute Determine Each Every Some All Any No Not One Two Three Both Many Much More Most Few Several If Since Because").split()
_MARK = "\x01"
_NAME = r"\p{Lu}\p{Ll}\p{L}*(?: \p{Lu}\p{Ll}\p{L}*)*"
_WORD = r"[\x02-\x04\p{L}\p{N}]+"


def value_tokens(text: Column) -> Column:
    """Lower-case tokens; each word of a name carries a mark before it, and a run of them is one token, like a number with separators.

    All steps are passes over the whole text; patterns begin with what is rare.
    """
    text = F.regexp_replace(F.coalesce(text, F.lit("")), "[\x01-\x03]", " ")
    text = F.regexp_replace(text, r"([0-9])(?=\p{L})", "$1 ")
    text = F.regexp_replace(F.regexp_replace(text, r"[.](?=[0-9])(?<=[0-9][.])", "\x02"), "[,](?=[0-9])(?<=[0-9][,])", "\x03")
    # A name, or the next word of one that has just ended.
    rare = rf"(?!(?:{'|'.join(COMMON)})(?!\p{{L}}))"
    text = F.regexp_replace(text, rf"(?:(?=\p{{Lu}})(?<![\x02\x03\p{{L}}\p{{N}}])|(?!^)\G ){rare}(\p{{Lu}}\p{{Ll}}\p{{L}}*)", f"{_MARK}m$1")
    return F.array_remove(F.split(F.lower(text), r"[^\x01-\x03\p{L}\p{N}]+"), "")


def _digit(token: Column) -> Column:
    return F.ascii(token).between(48, 57)


def template(values: Column) -> Column:
    """The typed placeholders and literals of value tokens. values must be an attribute or a lambda's variable."""

    def one(t: Column, i: Column) -> Column:
        unit = t.isin(UNITS) & (i > 0) & _digit(F.get(values, i - 1))
        return (
            F.when(F.substring(t, 1, 1) == _MARK, f"{_MARK}m").when(_digit(t), f"{_MARK}n").when(unit, f"{_MARK}u").otherwise(t)
        )

    return F.transform(values, one)


def bound(value: Column, then) -> Column:
    """then(value), with value computed once, whatever the optimiser merges."""
    return F.transform(F.array(value), then)[0]


def _windows(tokens: Column, width: int) -> Column:
    """Hashes of all windows of that width; none if there are fewer tokens."""
    n = F.size(tokens) - width
    return F.when(
        n >= 0, F.transform(F.sequence(F.lit(0), n), lambda i: F.xxhash64(F.slice(tokens, i + 1, width)))
    ).otherwise(F.array().cast("array<bigint>"))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per leaked (doc_id, item_id): n_windows, matched_tokens, item_tokens, n_slots, changed_slots.

    The values are those of the pair's best diagonal: most matched tokens, then the smallest diagonal.
    n_windows counts the joined windows. Slots are those inside matched windows.
    changed_slots counts distinct slots whose value differs. Null and empty texts leak nothing; null ids
    are left out. Equal rows of one id count their windows together; of a document or an item with several texts the best pair of texts counts. Empty tables give no rows; clashing names of other
    columns don't matter. The benchmark side is broadcast only if it is small by count.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    docs = docs.withColumn("th", F.xxhash64("text"))  # tells texts of one id apart
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    items = items.where("item_id is not null").distinct()
    # Of an id with several texts each is an item; item_id is the text's own name until the end.
    items = items.select(F.col("item_id").alias("owner"), F.xxhash64("item_id", "text").alias("item_id"), value_tokens(F.col("text")).alias("item_values")).where(F.size("item_values") > 0)
    items = items.select("*", template(F.col("item_values")).alias("item_template"))
    items = scratch.save(items.select("*", F.size("item_template").alias("item_tokens")), "items")
    width = F.least("item_tokens", F.lit(WINDOW))
    at = F.explode(F.sequence(F.lit(0), F.col("item_tokens") - width)).alias("at")
    grams = items.select("item_id", "item_tokens", "item_template", at).select("*", F.slice("item_template", F.col("at") + 1, width).alias("gram"))
    words = F.size(F.filter("gram", lambda t: F.substring(t, 1, 1) != _MARK))
    grams = grams.select("item_id", "item_tokens", "at", F.size("gram").alias("width"), F.xxhash64("gram").alias("h"), (words >= LEAST_WORDS).alias("rich"))
    some = grams.groupBy("item_id").agg(F.max("rich").alias("any_rich"), F.count(F.when(~F.col("rich"), 1)).alias("poor"))
    some = some.select("item_id", "any_rich", F.when(F.col("any_rich"), F.col("poor")).otherwise(0).alias("left_out"))
    grams = grams.join(some, "item_id").where("rich or not any_rich").select("h", "width", "item_id", "item_tokens", "left_out", "at")
    grams = scratch.save(grams, "grams")
    widths = [r.width for r in grams.select("width").distinct().collect()]  # at most WINDOW of them
    hashed = lambda values: bound(template(values), lambda t: F.array(*(F.struct(F.lit(w).alias("width"), _windows(t, w).alias("hs")) for w in widths)))
    if not widths:
        return spark.createDataFrame([], "doc_id long, item_id long, n_windows long, matched_tokens long, item_tokens long, n_slots long, changed_slots long")
    seen = docs.select("doc_id", "th", F.explode(bound(value_tokens(F.col("text")), hashed)).alias("s"))
    seen = seen.select("doc_id", "th", F.col("s.width").alias("width"), F.posexplode("s.hs").alias("pos", "h"))
    found = seen.join(small(grams, 100_000), ["h", "width"]).groupBy("doc_id", "th", "item_id", (F.col("pos") - F.col("at")).alias("diagonal"))
    found = found.agg(
        F.count("*").alias("n_windows"), F.max("item_tokens").alias("item_tokens"), F.max("width").alias("width"), F.max("left_out").alias("left_out")
    )
    enough = lambda n: n + F.col("width") - 1 >= F.greatest("width", F.least(F.col("item_tokens") - EDGE, F.lit(LEAST_TOKENS)))
    # Even if all windows that were left out match, the others can't reach the bound.
    found = found.where(enough(F.col("n_windows") + F.col("left_out")))
    found = scratch.save(found.select("doc_id", "th", "item_id", "diagonal", "n_windows", "width"), "found")
    wanted = small(found.select("doc_id", "th").distinct())
    texts = docs.join(wanted, ["doc_id", "th"], "left_semi").groupBy("doc_id", "th").agg(F.max("text").alias("text"))
    texts = texts.select("doc_id", "th", value_tokens(F.col("text")).alias("doc_values"))
    texts = scratch.save(texts.select("*", template(F.col("doc_values")).alias("doc_template")), "texts")
    both = found.join(texts, ["doc_id", "th"]).join(small(items, 10_000), "item_id")
    pair = lambda i: F.struct(
        i.alias("at"),
        F.get("item_template", i).alias("it"),
        F.get("doc_template", i + F.col("diagonal")).alias("dt"),
        F.get("item_values", i).alias("iv"),
        F.get("doc_values", i + F.col("diagonal")).alias("dv"),
    )
    pairs = F.transform(F.sequence(F.lit(0), F.col("item_tokens") - 1), pair)
    both = both.select("doc_id", F.col("owner").alias("item_id"), "diagonal", "n_windows", "item_tokens", "width", pairs.alias("pairs"))
    equal = F.transform("pairs", lambda p: F.coalesce(p.it == p.dt, F.lit(False)))
    literal = F.transform("pairs", lambda p: F.coalesce((p.it == p.dt) & (p.iv == p.dv), F.lit(False)))
    both = scratch.save(both.select("*", equal.alias("equal"), literal.alias("literal")), "aligned")
    starts = F.filter(F.sequence(F.lit(0), F.col("item_tokens") - F.col("width")), lambda i: F.forall(F.slice("equal", i + 1, F.col("width")), lambda e: e))
    # A unit belongs to the number before it: after an altered number it isn't literal.
    literal = F.transform("pairs", lambda p: F.get("literal", p.at) & ((p.it != f"{_MARK}u") | F.coalesce(F.get("literal", p.at - 1), F.lit(False))))
    both = scratch.save(both.select("*", starts.alias("starts"), literal.alias("own")), "matched").where(enough(F.size("starts")))
    copied = F.exists(F.sequence(F.lit(0), F.col("item_tokens") - LEAST_TOKENS), lambda i: F.forall(F.slice("own", i + 1, LEAST_TOKENS), lambda e: e))
    both = both.select("*", F.when(F.col("item_tokens") >= LEAST_TOKENS, copied).otherwise(False).alias("copied"), F.filter("pairs", lambda p: p.it == p.dt).alias("same"))
    inside = lambda p: F.exists("starts", lambda i: (i <= p.at) & (p.at < i + F.col("width")))
    slots = F.filter("same", lambda p: (F.substring(p.it, 1, 1) == _MARK) & inside(p))
    both = scratch.save(both.select("*", F.array_distinct(F.transform(slots, lambda p: F.struct(p.it.alias("k"), p.iv.alias("i"), p.dv.alias("d")))).alias("slots")), "slots")
    given = F.array_distinct(F.transform("slots", lambda p: F.struct(p.k, p.i)))
    both = both.where(F.col("copied") | (F.size(given) == F.size("slots")))
    best = both.select(
        "doc_id",
        "item_id",
        F.struct(
            F.size("same").cast("long").alias("matched_tokens"),
            (-F.col("diagonal")).alias("order"),
            "n_windows",
            F.col("item_tokens").cast("long").alias("item_tokens"),
            F.size("slots").cast("long").alias("n_slots"),
            F.size(F.filter("slots", lambda p: p.i != p.d)).cast("long").alias("changed_slots"),
        ).alias("b"),
    )
    best = best.groupBy("doc_id", "item_id").agg(F.max("b").alias("b"))
    return best.select("doc_id", "item_id", "b.n_windows", "b.matched_tokens", "b.item_tokens", "b.n_slots", "b.changed_slots")


def _sql_units() -> str:
    return "[" + ", ".join(f"'{u}'" for u in UNITS) + "]"


_SQL_CLEAN = "regexp_replace(regexp_replace(coalesce(text, ''), '[\\x01-\\x03]', ' ', 'g'), '([0-9])(\\p{L})', '\\1 \\2', 'g')"
for _from, _to in 2 * (("[.]", 2),) + 2 * ((",", 3),):  # twice, since matches don't overlap
    _SQL_CLEAN = f"regexp_replace({_SQL_CLEAN}, '([0-9]){_from}([0-9])', '\\1' || chr({_to}) || '\\2', 'g')"
for _ in range(2):
    _SQL_CLEAN = f"regexp_replace({_SQL_CLEAN}, '(^|[^\\p{{L}}\\p{{N}}])({'|'.join(COMMON)})([^\\p{{L}}]|$)', '\\1' || chr(4) || '\\2\\3', 'g')"


def _sql_side(name: str, key: str, source: str) -> str:
    return f"""
{name}_v AS (SELECT {key} AS id, list_transform(regexp_extract_all({_SQL_CLEAN}, '{_NAME}|{_WORD}'),
    lambda t: CASE WHEN regexp_matches(t, '^\\p{{Lu}}\\p{{Ll}}') THEN chr(1) || 'm' || lower(t) ELSE lower(replace(t, chr(4), '')) END) AS v FROM {source} WHERE {key} IS NOT NULL),
{name} AS (SELECT id, v, len(v) AS n, list_transform(v, lambda t, i: CASE WHEN t[1] = chr(1) THEN chr(1) || 'm'
    WHEN ascii(t) BETWEEN 48 AND 57 THEN chr(1) || 'n'
    WHEN i > 1 AND list_contains({_sql_units()}, t) AND ascii(v[i - 1]) BETWEEN 48 AND 57 THEN chr(1) || 'u' ELSE t END) AS t FROM {name}_v)"""


SQL = (
    f"WITH {_sql_side('d', 'doc_id', 'documents')}, {_sql_side('b', 'item_id', 'benchmark')}"
    + f"""
, g0 AS (SELECT id AS item_id, n, least(n, {WINDOW}) AS w, unnest(range(n - least(n, {WINDOW}) + 1)) AS b_pos, t FROM b WHERE n > 0),
g1 AS (SELECT item_id, n, w, b_pos, t[(b_pos + 1):(b_pos + w)] AS gram FROM g0),
g2 AS (SELECT *, len(list_filter(gram, lambda x: x[1] <> chr(1))) >= {LEAST_WORDS} AS rich FROM g1),
g3 AS (SELECT item_id, bool_or(rich) AS any_rich, CASE WHEN bool_or(rich) THEN count(*) FILTER (WHERE NOT rich) ELSE 0 END AS left_out FROM g2 GROUP BY ALL),
g AS (SELECT g2.*, left_out FROM g2 JOIN g3 USING (item_id) WHERE rich OR NOT any_rich),
s AS (SELECT id AS doc_id, w, unnest(range(n - w + 1)) AS pos, t FROM d, (SELECT DISTINCT w FROM g) WHERE n >= w),
f AS (SELECT doc_id, item_id, pos - b_pos AS diagonal, count(*) AS n_windows, max(n) AS n, max(g.w) AS w, max(left_out) AS left_out
    FROM (SELECT doc_id, w, pos, t[(pos + 1):(pos + w)] AS gram FROM s) AS x JOIN g USING (gram) GROUP BY ALL),
f2 AS (SELECT *, greatest(w, least(n - {EDGE}, {LEAST_TOKENS})) AS needed FROM f WHERE n_windows + left_out + w - 1 >= greatest(w, least(n - {EDGE}, {LEAST_TOKENS}))),
p AS (SELECT f2.*, list_transform(range(1, f2.n + 1), lambda i: {{'at': i, 'it': b.t[i], 'iv': b.v[i],
    'dt': CASE WHEN i + diagonal >= 1 THEN d.t[i + diagonal] END, 'dv': CASE WHEN i + diagonal >= 1 THEN d.v[i + diagonal] END}}) AS pairs
    FROM f2 JOIN d ON d.id = f2.doc_id JOIN b ON b.id = f2.item_id),
p2 AS (SELECT *, list_transform(pairs, lambda x: coalesce(x.it = x.dt, false)) AS eq, list_transform(pairs, lambda x: coalesce(x.it = x.dt AND x.iv = x.dv, false)) AS lit FROM p),
p3 AS (SELECT *, list_filter(range(1, n - w + 2), lambda i: list_aggregate(eq[i:(i + w - 1)], 'bool_and')) AS starts,
    list_transform(pairs, lambda x: lit[x.at] AND (x.it <> chr(1) || 'u' OR (x.at > 1 AND coalesce(lit[x.at - 1], false)))) AS own, list_filter(pairs, lambda x: x.it = x.dt) AS same FROM p2),
q AS (SELECT *, n >= {LEAST_TOKENS} AND len(list_filter(range(1, n - {LEAST_TOKENS} + 2), lambda i: list_aggregate(own[i:(i + {LEAST_TOKENS} - 1)], 'bool_and'))) > 0 AS copied,
    list_distinct(list_transform(list_filter(same, lambda x: x.it[1] = chr(1) AND len(list_filter(starts, lambda i: i <= x.at AND x.at < i + w)) > 0),
      lambda x: {{'k': x.it, 'i': x.iv, 'd': x.dv}})) AS slots FROM p3 WHERE len(starts) + w - 1 >= needed),
r AS (SELECT * FROM q WHERE copied OR len(list_distinct(list_transform(slots, lambda x: {{'k': x.k, 'i': x.i}}))) = len(slots))
SELECT doc_id, item_id, n_windows, cast(len(same) AS BIGINT) AS matched_tokens, cast(n AS BIGINT) AS item_tokens,
    cast(len(slots) AS BIGINT) AS n_slots, cast(len(list_filter(slots, lambda x: x.i <> x.d)) AS BIGINT) AS changed_slots
FROM r QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY len(same) DESC, diagonal) = 1"""
)
