"""Queries on composing, grading and presentation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gleaner.functions import composing as K
from gleaner.functions import routing as G
from gleaner.operators import answers as A
from gleaner.operators import lexical as L
from gleaner.operators import retrieve as R
from gleaner.operators import scoring as S
from gleaner.streaming import talk as TK

from .answering import _CAND, _CHAIN, _CONF, _candidates, answers, hits
from .reading import winners
from .binding import PASSAGES, folder, index, passages, questions, sql_question_terms, sql_tokens, strings, table
from .dense import DOCS
from .lexical import BM25, TOP
from .registry import query
from .routing import _MODE, _pad


def _cw(column: str, most: int = 40) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({column}, '')), '[a-z0-9]+'), lambda w: length(w) BETWEEN 3 AND 23 AND NOT list_contains({strings(K.CONTENT_STOP)}, w))[1:{most}]"


@query("content_words", f"WITH {PASSAGES} SELECT passage_id, len(c) AS n, md5(array_to_string(c, ' ')) AS digest FROM (SELECT passage_id, {_cw('text')} AS c FROM passages)")
def content_words(spark, sf_dir):
    rows = passages(spark, sf_dir).select("passage_id", K.content_words(F.col("text")).alias("c"))
    return rows.select("passage_id", F.size("c").cast("long").alias("n"), F.md5(F.array_join("c", " ")).alias("digest"))


@query("adds_nothing", f"""WITH {PASSAGES}, c AS (SELECT passage_id, article_id, {_cw("text")} AS a, {_cw("text", 64)} AS b FROM passages)
SELECT x.passage_id, len(x.a) > 0 AND len(list_filter(x.a, lambda w: NOT list_contains(y.b, w))) = 0 AS nothing FROM c x JOIN c y ON y.article_id = x.article_id AND y.passage_id = x.passage_id - 1""")
def adds_nothing(spark, sf_dir):
    rows = passages(spark, sf_dir).select("passage_id", K.content_words(F.col("text")).alias("a"), K.content_words(F.col("text"), 64).alias("b"))
    before = rows.select((F.col("passage_id") + 1).alias("passage_id"), F.col("b").alias("seen"))
    return rows.join(before, "passage_id").select("passage_id", K.adds_nothing(F.col("a"), F.array("seen")).alias("nothing"))


@query("same_shape_cap", f"WITH {PASSAGES} SELECT passage_id FROM passages QUALIFY row_number() OVER (PARTITION BY article_id, text[1:20] ORDER BY passage_id) <= 2")
def same_shape_cap(spark, sf_dir):
    own = Window.partitionBy("article_id", F.substring("text", 1, 20)).orderBy("passage_id")
    return passages(spark, sf_dir).withColumn("n", F.row_number().over(own)).where("n <= 2").select("passage_id")


def _fold(item: str, source: str, key: str, order: str, most: int) -> str:
    """Facts in SQL: rows of `source` (title, text, a, b) by `order`, folded by list_reduce; `item` groups them."""
    kind = "STRUCT(title VARCHAR, text VARCHAR, b VARCHAR[])[]"
    return f"""{item} AS (SELECT {key}, list_reduce(list_prepend({{'o': []::{kind}, 'a': []::VARCHAR[]}}, list({{'o': [{{'title': title, 'text': text, 'b': b}}]::{kind}, 'a': a}} ORDER BY {order})),
  lambda s, x: {{'o': CASE WHEN len(s.o) >= {most} OR len(list_filter(s.o, lambda o: o.text = x.o[1].text)) > 0 OR len(list_filter(s.o, lambda o: o.text[1:20] = x.o[1].text[1:20])) >= 2
    OR (len(x.a) > 0 AND len(list_filter(s.o, lambda o: len(list_filter(x.a, lambda w: NOT list_contains(o.b, w))) = 0)) > 0) THEN s.o ELSE list_append(s.o, x.o[1]) END, 'a': s.a}}).o AS facts FROM {source} GROUP BY {key})"""


@query("fact_select", f"""WITH {PASSAGES}, l AS (SELECT article_id, passage_id, '' AS title, text, {_cw("text")} AS a, {_cw("text", 64)} AS b FROM passages), {_fold("f", "l", "article_id", "passage_id", 6)}
SELECT article_id, list_transform(facts, lambda f: f.text) AS facts FROM f""")
def fact_select(spark, sf_dir):
    """The facts among all lines of every article, an ordered fold."""
    lines = passages(spark, sf_dir).groupBy("article_id").agg(F.array_sort(F.collect_list(F.struct("passage_id", "text"))).alias("l"))
    facts = K.facts_of(F.transform("l", lambda x: F.struct(F.lit("").alias("title"), x.text.alias("text"))), 6)
    return lines.select("article_id", F.transform(facts, lambda f: f.text).alias("facts"))


@query("fact_trim", f"""WITH {PASSAGES}, c AS (SELECT passage_id, text, text[1:240] AS cut FROM passages), s AS (SELECT *, regexp_extract(cut, '^(.*) [^ ]*$', 1, 's') AS sp FROM c)
SELECT passage_id, CASE WHEN length(text) <= 240 THEN text WHEN length(sp) > 120 THEN sp || ' ...' ELSE cut || ' ...' END AS fact FROM s""")
def fact_trim(spark, sf_dir):
    return passages(spark, sf_dir).select("passage_id", K.trimmed(F.col("text"), 240).alias("fact"))


@query("suggested_span", f"WITH {PASSAGES} SELECT passage_id, CASE WHEN text <> '' AND strlen(text) < 160 THEN CASE WHEN instr(text, '. ') > 13 THEN split_part(text, '. ', 1) ELSE text END END AS span FROM passages")
def suggested_span(spark, sf_dir):
    return passages(spark, sf_dir).select("passage_id", K.suggested_span(F.col("text"), F.lit(0.5), "-").alias("span"))


@query("sentence_dedupe", r"""WITH d AS (SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'c' || conv_id || '.' || turn, text FROM conversations),
p AS (SELECT id, unnest(regexp_extract_all(text, '[^.!?\n]*[.!?\n]+|[^.!?\n]+')) AS s, generate_subscripts(regexp_extract_all(text, '[^.!?\n]*[.!?\n]+|[^.!?\n]+'), 1) AS i FROM d),
k AS (SELECT *, regexp_replace(regexp_replace(s, '^[\s*-]+', ''), '[\s.!?]+$', '') AS key FROM p), f AS (SELECT *, row_number() OVER (PARTITION BY id, key ORDER BY i) AS n FROM k)
SELECT id, md5(coalesce(regexp_replace(string_agg(s, '' ORDER BY i) FILTER (WHERE length(key) <= 12 OR n = 1), '\s+$', ''), '')) AS digest FROM f GROUP BY id""")
def sentence_dedupe(spark, sf_dir):
    """Sentences as rows, so that very long texts stay linear."""
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    c = table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string")).alias("id"), "text")
    parts = F.regexp_extract_all("text", F.lit(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+"), F.lit(0))
    rows = d.unionByName(c).select("id", F.posexplode(parts).alias("i", "s"))
    rows = rows.withColumn("key", F.regexp_replace(F.regexp_replace("s", r"^[\s*-]+", ""), r"[\s.!?]+$", ""))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("id", "key").orderBy("i"))).where((F.length("key") <= 12) | (F.col("n") == 1))
    kept = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("i", "s"))).alias("l"))
    return kept.select("id", F.md5(F.regexp_replace(F.array_join(F.transform("l", lambda x: x.s), ""), r"\s+$", "")).alias("digest"))


_GR = f"""gr AS (SELECT question_id, rank, len(a) AS n, len(list_filter(a, lambda w: list_contains(r, w))) AS found, answer, confidence FROM (
  SELECT question_id, rank, answer, {_cw("answer")} AS a, {_cw("d.text", 400)} AS r, {_CONF} AS confidence FROM cand JOIN documents d ON d.doc_id = cand.question_id))"""
_GROUNDED = "(confidence < 0.6 OR answer = '' OR strlen(answer) > 100 OR n = 0 OR found * 10 >= n * 7)"


def _replies(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("question_id"), F.col("text").alias("reply"))
    return _candidates(spark, sf_dir).join(docs, "question_id").withColumn("confidence", A.confidence(F.col("margin"), F.col("dense"), F.col("coverage")))


@query("grounded", f"WITH {_CAND}, {_GR} SELECT question_id, rank, {_GROUNDED} AS grounded FROM gr")
def grounded(spark, sf_dir):
    return _replies(spark, sf_dir).select("question_id", "rank", K.grounded(F.col("answer"), F.col("reply"), F.col("confidence"), F.lit(False)).alias("grounded"))


@query("retry_cascade", f"WITH {_CAND}, {_GR} SELECT question_id, rank, CASE WHEN {_GROUNDED.replace('< 0.6', '< 0.5')} THEN 'reply' WHEN confidence >= 0.6 THEN 'answer' ELSE 'reply' END AS used FROM gr")
def retry_cascade(spark, sf_dir):
    rows = _replies(spark, sf_dir)
    out = K.first_grounded(F.col("answer"), F.col("title"), F.col("confidence"), F.lit(True), [F.col("reply")])
    return rows.select("question_id", "rank", F.when(out == F.col("reply"), "reply").otherwise("answer").alias("used"))


def _held(reply: str) -> str:
    """SQL: most of the answer's words are in the reply, where that is asked for."""
    return f"(free OR len(list_filter(a, lambda w: list_contains({_cw(reply, 400)}, w))) * 10 >= len(a) * 7)"


@query("reply_cascade", f"""WITH {_CAND}, three AS (SELECT question_id, rank, title, answer, rank % 2 = 1 AS wide, {_CONF} AS confidence, coalesce(lead(passage, 1) OVER w, '') AS r1, coalesce(lead(passage, 2) OVER w, '') AS r2, first_value(passage) OVER w AS r3
  FROM cand WINDOW w AS (PARTITION BY question_id ORDER BY rank)), asked AS (SELECT *, {_cw("answer")} AS a, confidence < CASE WHEN wide THEN 0.5 ELSE 0.6 END OR answer = '' OR strlen(answer) > 100 OR len({_cw("answer")}) = 0 AS free FROM three),
chosen AS (SELECT *, CASE WHEN {_held("r1")} THEN 'first' WHEN {_held("r2")} THEN 'second' WHEN wide AND confidence >= 0.6 THEN CASE WHEN {_held("r3")} THEN 'focused' ELSE 'told' END ELSE 'ungrounded' END AS used FROM asked)
SELECT question_id, rank, used, md5(CASE used WHEN 'second' THEN r2 WHEN 'focused' THEN r3 WHEN 'told' THEN answer || ' (Wikipedia, ' || title || ')' ELSE r1 END) AS digest FROM chosen""")
def reply_cascade(spark, sf_dir):
    """Three replies to each candidate, for which passages of the question's other candidates stand: the next two and the best; odd ranks count as wide."""
    own = Window.partitionBy("question_id").orderBy("rank")
    later = lambda n: F.coalesce(F.lead("passage", n).over(own), F.lit(""))
    rows = _candidates(spark, sf_dir).select("question_id", "rank", "title", "answer", (F.col("rank") % 2 == 1).alias("wide"),
        A.confidence(F.col("margin"), F.col("dense"), F.col("coverage")).alias("confidence"), later(1).alias("r1"), later(2).alias("r2"), F.first("passage").over(own).alias("r3"))
    out = K.cascade(*(F.col(c) for c in ("answer", "title", "confidence", "wide", "r1", "r2", "r3")))
    return rows.select("question_id", "rank", out.alias("o")).select("question_id", "rank", "o.used", F.md5("o.reply").alias("digest"))


@query("token_budget", f"SELECT conv_id, turn, CASE WHEN len(list_filter({strings(K.LISTY)}, lambda p: contains(lower(text), p))) > 0 THEN 260 ELSE 160 END AS budget FROM conversations")
def token_budget(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", K.token_budget(F.col("text")).alias("budget"))


@query("history_window", """SELECT conv_id, turn, len(h) AS n, md5(array_to_string(list_transform(h, lambda x: x.role || ':' || x.text), '|')) AS digest FROM (SELECT conv_id, turn,
coalesce(list({'role': CASE WHEN role = 'assistant' THEN 'assistant' ELSE 'user' END, 'text': text}) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), []) AS h FROM conversations)""")
def history_window(spark, sf_dir):
    own = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-6, -1)
    role = F.when(F.col("role") == "assistant", "assistant").otherwise("user")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.collect_list(F.struct(role.alias("role"), "text")).over(own).alias("h"))
    return rows.select("conv_id", "turn", F.size("h").cast("long").alias("n"), F.md5(F.array_join(F.transform("h", lambda x: F.concat_ws(":", x.role, x.text)), "|")).alias("digest"))


@query("prompt", """WITH h AS (SELECT conv_id, turn, text, coalesce(list('<|im_start|>' || CASE WHEN role = 'assistant' THEN 'assistant' ELSE 'user' END || chr(10) || text || '<|im_end|>' || chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), []) AS h FROM conversations)
SELECT conv_id, turn, md5('<|im_start|>system' || chr(10) || 'Answer briefly.<|im_end|>' || chr(10) || array_to_string(h, '') || '<|im_start|>user' || chr(10) || text || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)) AS digest FROM h""")
def prompt(spark, sf_dir):
    own = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-6, -1)
    rows = table(spark, sf_dir, "conversations").withColumn("h", F.collect_list(F.struct("role", "text")).over(own))
    none = F.array().cast("array<string>")
    return rows.select("conv_id", "turn", F.md5(K.prompt("Answer briefly.", F.col("h"), F.col("text"), none, G.mode(F.col("text")))).alias("digest"))


# Test cases: each benchmark text is a question; its first three words, a flag and a phrase that is nowhere are accepted.
_TESTS = """tests AS (SELECT item_id, 'block ' || (item_id % 4) AS block, CASE item_id % 3 WHEN 0 THEN [array_to_string(regexp_split_to_array(text, '\\s+')[1:3], ' '), '!short'] WHEN 1 THEN ['zzzz', array_to_string(regexp_split_to_array(text, '\\s+')[1:2], ' ')] ELSE ['!norefuse'] END AS accepted FROM benchmark),
g AS (SELECT t.item_id, block, d.text AS reply, (len(list_filter(accepted, lambda a: a[1] <> '!')) = 0 OR len(list_filter(accepted, lambda a: a[1] <> '!' AND contains(lower(d.text), lower(a)))) > 0)
  AND NOT (list_contains(accepted, '!short') AND len(list_filter(regexp_split_to_array(d.text, '\\s+'), lambda w: w <> '')) > 40)
  AND NOT (list_contains(accepted, '!norefuse') AND len(list_filter(REFUSALS, lambda p: contains(lower(d.text), p))) > 0) AS ok FROM tests t JOIN documents d ON d.doc_id = t.item_id)""".replace("REFUSALS", strings(K.REFUSALS))


def _graded(spark, sf_dir):
    words = lambda n: F.array_join(F.slice(F.split("text", r"\s+"), 1, n), " ")
    k = F.col("item_id") % 3
    accepted = F.when(k == 0, F.array(words(3), F.lit("!short"))).when(k == 1, F.array(F.lit("zzzz"), words(2))).otherwise(F.array(F.lit("!norefuse")))
    tests = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("block "), (F.col("item_id") % 4).cast("string")).alias("block"), accepted.alias("accepted"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("reply"))
    return tests.join(docs, "item_id").select("item_id", "block", K.graded(F.col("reply"), F.col("accepted")).alias("ok"))


@query("grade", f"WITH {_TESTS} SELECT item_id, block, ok FROM g")
def grade(spark, sf_dir):
    return _graded(spark, sf_dir)


@query("grade_blocks", f"WITH {_TESTS} SELECT coalesce(block, 'all') AS block, count(*) AS n, count(*) FILTER (WHERE ok) AS passed, round(10.0 * count(*) FILTER (WHERE ok) / count(*), 1) AS score FROM g GROUP BY ROLLUP (block)")
def grade_blocks(spark, sf_dir):
    ok = F.sum(F.col("ok").cast("long"))
    return _graded(spark, sf_dir).rollup("block").agg(F.count("*").alias("n"), ok.alias("passed"), F.round(10.0 * ok / F.count("*"), 1).alias("score")).select(F.coalesce("block", F.lit("all")).alias("block"), "n", "passed", "score")


@query("grade_failures", f"WITH {_TESTS} SELECT block, list(item_id ORDER BY item_id) AS failed FROM g WHERE NOT ok GROUP BY block")
def grade_failures(spark, sf_dir):
    """The failed items of each block; a block's failures are one list, as its report prints them."""
    return _graded(spark, sf_dir).where("not ok").groupBy("block").agg(F.sort_array(F.collect_list("item_id")).alias("failed"))


# The last block holds general questions, which need seven of ten; the others need nine.
_LEAST = "CASE WHEN block = 'block 3' THEN 7 ELSE 9 END"


@query("gate", f"WITH {_TESTS}, s AS (SELECT block, round(10.0 * count(*) FILTER (WHERE ok) / count(*), 1) AS score FROM g GROUP BY block) SELECT min(score) AS worst, count(*) FILTER (WHERE score < {_LEAST}) AS failing, count(*) FILTER (WHERE score < {_LEAST}) = 0 AS passed FROM s")
def gate(spark, sf_dir):
    blocks = _graded(spark, sf_dir).groupBy("block").agg(F.round(10.0 * F.sum(F.col("ok").cast("long")) / F.count("*"), 1).alias("score"))
    failing = F.count_if(F.col("score") < F.expr(_LEAST))
    return blocks.agg(F.min("score").alias("worst"), failing.alias("failing"), (failing == 0).alias("passed"))


_EVAL = f"""{_CHAIN}, held AS (SELECT question_id, count(*) FILTER (WHERE contains(passage, question)) > 0 AS found, any_value(question) AS question FROM hit GROUP BY question_id),
ev AS (SELECT h.question_id, h.found, f.answer IS NOT NULL AND contains(lower(h.question), lower(f.answer)) AS exact, d.text IS NOT NULL AND contains(d.text, h.question) AS evidence, f.answer IS NOT NULL AND {_CONF.replace("margin", "f.margin").replace("dense", "c.dense").replace("coverage", "c.coverage")} >= 0.45 AND f.margin >= 0 AS accepted
  FROM held h LEFT JOIN final f ON f.question_id = h.question_id LEFT JOIN cand c ON c.question_id = f.question_id AND c.rank = f.rank LEFT JOIN documents d ON d.doc_id = f.doc_id)"""


@query("eval_answers", f"{_EVAL} SELECT found AS in_domain, count(*) AS items, count(*) FILTER (WHERE exact) AS exact, count(*) FILTER (WHERE evidence) AS evidence, count(*) FILTER (WHERE exact OR evidence) AS answer_or_evidence, count(*) FILTER (WHERE accepted) AS accepted FROM ev GROUP BY found")
def eval_answers(spark, sf_dir):
    """Answers of the chain by whether retrieval finds the benchmark text at all: the answer is part of that text, its document holds it, and accepted.

    Texts that no retrieved document holds are out of domain: what is accepted of them is what a gate should refuse.
    """
    held = hits(spark, sf_dir).groupBy("question_id").agg((F.count_if(F.col("passage").contains(F.col("question"))) > 0).alias("found"), F.max("question").alias("question"))
    known = _candidates(spark, sf_dir).select("question_id", "rank", "coverage", "dense")
    final = answers(spark, sf_dir).select("question_id", "rank", "doc_id", "answer", "margin").join(known, ["question_id", "rank"], "left")
    passage = hits(spark, sf_dir).select("question_id", F.col("passage_id").alias("doc_id"), "passage")
    rows = held.join(final.join(passage, ["question_id", "doc_id"], "left"), "question_id", "left")
    exact = F.coalesce(F.lower("question").contains(F.lower("answer")), F.lit(False))
    evidence = F.coalesce(F.col("passage").contains(F.col("question")), F.lit(False))
    accepted = F.coalesce((A.confidence(F.col("margin"), F.col("dense"), F.col("coverage")) >= 0.45) & (F.col("margin") >= 0), F.lit(False))
    count = lambda c, name: F.count_if(c).alias(name)
    return rows.groupBy(F.col("found").alias("in_domain")).agg(F.count("*").alias("items"), count(exact, "exact"), count(evidence, "evidence"), count(exact | evidence, "answer_or_evidence"), count(accepted, "accepted"))


@query("conf_percentiles", f"WITH {_CAND}, cf AS (SELECT round({_CONF}, 6) AS confidence FROM cand), r AS (SELECT confidence, row_number() OVER (ORDER BY confidence) - 1 AS i, count(*) OVER () AS n FROM cf) SELECT min(confidence) AS lowest, max(CASE WHEN i = n // 10 THEN confidence END) AS p10, max(CASE WHEN i = n // 2 THEN confidence END) AS median FROM r")
def conf_percentiles(spark, sf_dir):
    """By index, not interpolated. Values are counted by thousandths, of which there are at most 1,001; only the two ranges that hold an index are sorted."""
    rows = _replies(spark, sf_dir).select(F.round("confidence", 6).alias("confidence")).withColumn("range", F.floor(F.col("confidence") * 1000).cast("int"))
    counts = sorted(tuple(r) for r in rows.groupBy("range").count().collect())
    total = sum(n for _, n in counts)
    wanted = []
    for name, i in (("p10", total // 10), ("median", total // 2)):
        for number, n in counts:
            if i < n:
                wanted.append((name, number, i))
                break
            i -= n
    own = F.row_number().over(Window.partitionBy("range").orderBy("confidence")) - 1
    inside = rows.where(F.col("range").isin([k for _, k, _ in wanted])).withColumn("i", own)
    at = {name: inside.where((F.col("range") == k) & (F.col("i") == i)).agg(F.max("confidence").alias(name)) for name, k, i in wanted}
    return rows.agg(F.min("confidence").alias("lowest")).crossJoin(at["p10"]).crossJoin(at["median"])  # one row each


@query("retrieval_at_8", f"""WITH {DOCS}, w AS (SELECT *, 1.0 AS weight FROM ({sql_question_terms()})), {BM25}, top AS ({TOP}),
hit AS (SELECT item_id, bool_or(contains(d.text, b.text)) AS held, bool_or(rank = 1 AND contains(d.text, b.text)) AS first FROM benchmark b LEFT JOIN top ON question_id = item_id LEFT JOIN documents d ON d.doc_id = passage_id GROUP BY ALL)
SELECT count(*) AS items, count(*) FILTER (WHERE held) AS found, count(*) FILTER (WHERE first) AS found_first, round(count(*) FILTER (WHERE held) / count(*), 4) AS share FROM hit""")
def retrieval_at_8(spark, sf_dir):
    """Retrieval at 8: for how many benchmark texts the eight best documents by BM25 hold one that has the whole text."""
    items = questions(spark, sf_dir)
    top = S.bm25_top(L.question_terms(items).withColumn("weight", F.lit(1.0)), index(spark, sf_dir, "documents"), 8).select("question_id", "passage_id", "rank")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("passage_id"), F.col("text").alias("doc"))
    rows = docs.join(L.small(top), "passage_id").join(L.small(items), "question_id").where(F.col("doc").contains(F.col("text")))
    found = rows.groupBy("question_id").agg(F.min("rank").alias("at"))
    out = items.select("question_id").join(found, "question_id", "left")
    return out.agg(F.count("*").alias("items"), F.count("at").alias("found"), F.count_if(F.col("at") == 1).alias("found_first"), F.round(F.count("at") / F.count("*"), 4).alias("share"))


@query("confidence_bucket", f"WITH {_CAND}, cf AS (SELECT question_id, rank, answer, {_CONF} AS f FROM cand) SELECT question_id, rank, CASE WHEN f > 0.6 THEN 'confident' WHEN f > 0.35 THEN 'probably' ELSE 'unsure' END AS bucket, f < 0.22 OR answer = '' AS not_found FROM cf")
def confidence_bucket(spark, sf_dir):
    c = A.confidence(F.col("margin"), F.col("dense"), F.col("coverage"))
    return _candidates(spark, sf_dir).select("question_id", "rank", K.bucket(c).alias("bucket"), K.not_found(c, F.col("answer")).alias("not_found"))


@query("highlight", f"""WITH {PASSAGES}, h AS (SELECT passage_id, text, ' the ' AS a, instr(lower(text), ' the ') AS i FROM passages)
SELECT passage_id, CASE WHEN i > 0 THEN text[1:(i - 1)] ELSE text END AS before, CASE WHEN i > 0 THEN text[i:(i + 4)] ELSE '' END AS hit, CASE WHEN i > 0 THEN text[(i + 5):] ELSE '' END AS after FROM h""")
def highlight(spark, sf_dir):
    return passages(spark, sf_dir).select("passage_id", K.highlighted(F.col("text"), F.lit(" the ")).alias("h")).select("passage_id", "h.before", "h.hit", "h.after")


_URL = "'https://example.org/' || d.source || '/' || d.doc_id"
_BODY = f"""{_CHAIN}, hb AS (SELECT h.question_id, list({{'score': round(h.score, 3), 'dense': round(h.dense, 3), 'title': h.title, 'text': h.passage, 'url': {_URL}, 'source': d.source}} ORDER BY h.passage_id <> w.doc_id, h.rank) AS hits
  FROM hit h JOIN w1 w USING (question_id) JOIN documents d ON d.doc_id = h.passage_id GROUP BY h.question_id),
body AS (SELECT w.question_id, w.question, w.answer, w.passage AS sentence, w.title, {_URL} AS url, d.source, round({_CONF}, 3) AS confidence, round(w.span_score, 2) AS span_score, round(w.null_score, 2) AS null_score, 'wikipedia' AS kind, hb.hits
  FROM w1 w JOIN documents d ON d.doc_id = w.doc_id JOIN hb ON hb.question_id = w.question_id)"""
_HIT_DIGEST = "md5(array_to_string(list_transform(hits, lambda h: h.title || '|' || md5(h.text) || '|' || h.url || '|' || h.source), ' '))"
_BODY_FIELDS = "answer string, sentence string, title string, url string, source string, confidence double, span_score double, null_score double, kind string"
_BODY_SCHEMA = f"question string, {_BODY_FIELDS}, hits array<struct<score: double, dense: double, title: string, text: string, url: string, source: string>>"


def answer_bodies(spark, sf_dir):
    """(question_id, body): the JSON reply of each question, with its passages, the winning one first."""
    won = winners(spark, sf_dir)
    source = table(spark, sf_dir, "documents").select("doc_id", "source", F.concat(F.lit("https://example.org/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("url"))
    h = hits(spark, sf_dir).withColumnRenamed("passage_id", "doc_id").join(source, "doc_id").join(won.select("question_id", F.col("doc_id").alias("best")), "question_id")
    item = F.struct((F.col("doc_id") != F.col("best")).alias("later"), "rank", F.round("score", 3).alias("score"), F.round("dense", 3).alias("dense"), "title", F.col("passage").alias("text"), "url", "source")
    h = h.groupBy("question_id").agg(F.sort_array(F.collect_list(item)).alias("h"))
    listed = F.transform("h", lambda x: F.struct(x.score.alias("score"), x.dense.alias("dense"), x.title.alias("title"), x.text.alias("text"), x.url.alias("url"), x.source.alias("source")))
    rows = won.join(source, "doc_id").join(h.select("question_id", listed.alias("hits")), "question_id")
    confidence = A.confidence(F.col("margin"), F.col("dense"), F.col("coverage"))
    rounded = F.round(confidence, 3).alias("confidence"), F.round("span_score", 2).alias("span_score"), F.round("null_score", 2).alias("null_score")
    return rows.select("question_id", F.to_json(F.struct("question", "answer", F.col("passage").alias("sentence"), "title", "url", "source", *rounded, F.lit("wikipedia").alias("kind"), "hits")).alias("body"))


def _hit_digest(hits_):
    return F.md5(F.array_join(F.transform(hits_, lambda h: F.concat_ws("|", h.title, F.md5(h.text), h.url, h.source)), " "))


@query("answer_json", f"{_BODY} SELECT question_id, question, answer, md5(sentence) AS sentence, title, url, source, confidence, span_score, null_score, kind, len(hits) AS n_hits, {_HIT_DIGEST} AS hits FROM body")
def answer_json(spark, sf_dir):
    """Whole replies, written as JSON and parsed back. Times aren't part of them: a batch has none for one question."""
    j = answer_bodies(spark, sf_dir).select("question_id", F.from_json("body", _BODY_SCHEMA).alias("j")).select("question_id", "j.*")
    return j.withColumns({"sentence": F.md5("sentence"), "n_hits": F.size("hits").cast("long"), "hits": _hit_digest(F.col("hits"))})


@query("chat_json", f"""{_BODY} SELECT question_id, answer || ' (Wikipedia, ' || title || ')' AS reply, confidence >= 0.3 AS used_facts, question, answer, title, confidence, len(hits) AS n_hits, {_HIT_DIGEST} AS hits FROM body""")
def chat_json(spark, sf_dir):
    """A chat reply's JSON holds the whole answer as `retrieval`; the reply is the answer with its article."""
    rows = answer_bodies(spark, sf_dir).select("question_id", F.from_json("body", _BODY_SCHEMA).alias("retrieval"))
    reply = F.concat("retrieval.answer", F.lit(" (Wikipedia, "), "retrieval.title", F.lit(")"))
    body = F.to_json(F.struct(reply.alias("reply"), (F.col("retrieval.confidence") >= 0.3).alias("used_facts"), "retrieval"))
    j = rows.select("question_id", F.from_json(body, f"reply string, used_facts boolean, retrieval struct<{_BODY_SCHEMA}>").alias("j"))
    r = "j.retrieval"
    return j.select("question_id", "j.reply", "j.used_facts", f"{r}.question", f"{r}.answer", f"{r}.title", f"{r}.confidence", F.size(f"{r}.hits").cast("long").alias("n_hits"), _hit_digest(F.col(f"{r}.hits")).alias("hits"))


def _cut(n: int) -> str:
    spaced = f"regexp_extract(f.text[1:{n}], '^(.*) [^ ]*$', 1, 's')"
    return f"CASE WHEN length(f.text) <= {n} THEN f.text WHEN length({spaced}) > {n // 2} THEN {spaced} || ' ...' ELSE f.text[1:{n}] || ' ...' END"


@query("answer_prompt", f"""{_CHAIN}, ln AS (SELECT h.question_id, h.title, h.passage AS text, h.passage_id <> w.doc_id AS later, h.rank, {_cw("h.passage")} AS a, {_cw("h.passage", 64)} AS b FROM hit h JOIN w1 w USING (question_id)), {_fold("fx", "ln", "question_id", "later, rank", 3)},
wc AS (SELECT question_id, question, answer, {_CONF} AS confidence, {_pad()} AS nn FROM (SELECT *, question AS text FROM w1)),
pr AS (SELECT question_id, len(facts) AS n, CASE WHEN confidence >= 0.45 AND answer <> '' AND strlen(answer) < 160 THEN '(The reader suggests the answer is: ' || CASE WHEN instr(answer, '. ') > 13 THEN split_part(answer, '. ', 1) ELSE answer END || ')' || chr(10) ELSE '' END AS hint,
  array_to_string(list_transform(facts, lambda f, i: '- [' || f.title || '] ' || CASE WHEN i = 1 THEN {_cut(600)} ELSE {_cut(200)} END || chr(10)), '') AS lines, question, {{MODE}} AS mode FROM fx JOIN wc USING (question_id))
SELECT question_id, n, hint <> '' AS hinted, md5('<|im_start|>system' || chr(10) || 'Answer briefly.<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || hint || 'FACTS:' || chr(10) || lines || chr(10) || 'QUESTION: ' || question
  || CASE WHEN mode = 'normal' AND length(question) - length(replace(question, '?', '')) >= 2 THEN chr(10) || '(Two questions - answer both, in order.)' ELSE '' END || CASE WHEN mode = 'normal' THEN chr(10) || '(Answer in one or two plain sentences using the facts above.)' ELSE '' END
  || CASE mode WHEN 'age' THEN chr(10) || '(Use only the birth date or age written in the facts.)' WHEN 'live' THEN chr(10) || '(Say that live information is not available.)' WHEN 'bored' THEN chr(10) || '(Recommend something and suggest a question.)' ELSE '' END
  || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)) AS digest FROM pr""".replace("{MODE}", _MODE.replace("contains(n,", "contains(nn,")))
def answer_prompt(spark, sf_dir):
    """The composer's prompt of each benchmark text: the reader's suggestion, the winner's passage first, then hits that add something."""
    won = winners(spark, sf_dir)
    h = hits(spark, sf_dir).join(won.select("question_id", F.col("doc_id").alias("best")), "question_id")
    h = h.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct((F.col("passage_id") != F.col("best")).alias("later"), "rank", "title", F.col("passage").alias("text")))).alias("h"))
    h = h.select("question_id", K.facts_of(F.transform("h", lambda x: F.struct(x.title.alias("title"), x.text.alias("text")))).alias("facts"))
    confidence = A.confidence(F.col("margin"), F.col("dense"), F.col("coverage"))
    rows = won.withColumn("hint", K.suggested_span(F.col("answer"), confidence, "-")).join(h, "question_id")
    prompt_ = K.fact_prompt("Answer briefly.", F.col("question"), F.col("facts"), F.col("hint"), G.mode(F.col("question")))
    return rows.select("question_id", F.size("facts").cast("long").alias("n"), F.col("hint").isNotNull().alias("hinted"), F.md5(prompt_).alias("digest"))


@query("focus_prompt", f"""{_CHAIN} SELECT question_id, {_CONF} >= 0.6 AS asked, md5('<|im_start|>system' || chr(10) || 'Answer briefly.<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || 'FACT [' || title || ']' || chr(10) || passage || chr(10) || chr(10) || 'QUESTION: ' || question
  || chr(10) || '(The answer is ' || answer || ': give it in one sentence that names what is asked about.)<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)) AS digest FROM w1""")
def focus_prompt(spark, sf_dir):
    """The focused prompt of each benchmark text's winner, and whether its confidence allows it."""
    asked = A.confidence(F.col("margin"), F.col("dense"), F.col("coverage")) >= 0.6
    text = K.focus_prompt("Answer briefly.", F.col("title"), F.col("passage"), F.col("question"), F.col("answer"))
    return winners(spark, sf_dir).select("question_id", asked.alias("asked"), F.md5(text).alias("digest"))


@query("alternates", f"WITH {_CAND} SELECT question_id, list(answer ORDER BY rank)[2:5] AS alternates FROM cand GROUP BY ALL")
def alternates(spark, sf_dir):
    rows = _candidates(spark, sf_dir).groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "answer"))).alias("l"))
    return rows.select("question_id", F.slice(F.transform("l", lambda x: x.answer), 2, 4).alias("alternates"))


@query("provenance_flags", r"""WITH r AS (SELECT conv_id, turn, text || CASE turn % 3 WHEN 0 THEN ' (not from the wikis).' WHEN 1 THEN ' (from Wikipedia)' ELSE '' END AS reply FROM conversations)
SELECT conv_id, turn, regexp_matches(reply, '(?i)\(not from the wikis\)') AS outside, regexp_matches(reply, '(?i)\(from Wikipedia\)') AS wide, md5(trim(regexp_replace(trim(regexp_replace(reply, '(?i)\s*\(not from the wikis\)\.?', '', 'g')), '(?i)\s*\(from Wikipedia\)\.?', '', 'g'))) AS digest FROM r""")
def provenance_flags(spark, sf_dir):
    note = F.when(F.col("turn") % 3 == 0, " (not from the wikis).").when(F.col("turn") % 3 == 1, " (from Wikipedia)").otherwise("")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("text", note).alias("reply"))
    plain = F.trim(F.regexp_replace(F.trim(F.regexp_replace("reply", r"(?i)\s*\(not from the wikis\)\.?", "")), r"(?i)\s*\(from Wikipedia\)\.?", ""))
    return rows.select("conv_id", "turn", F.col("reply").rlike(r"(?i)\(not from the wikis\)").alias("outside"), F.col("reply").rlike(r"(?i)\(from Wikipedia\)").alias("wide"), F.md5(plain).alias("digest"))


@query("source_label", """SELECT source, CASE source WHEN 'src0' THEN 'first collection' WHEN 'src1' THEN 'second collection' ELSE source END AS label, count(*) AS n FROM documents GROUP BY ALL""")
def source_label(spark, sf_dir):
    labels = F.create_map(F.lit("src0"), F.lit("first collection"), F.lit("src1"), F.lit("second collection"))
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n")).select("source", F.coalesce(F.try_element_at(labels, F.col("source")), "source").alias("label"), "n")


#: Deliveries in which the turns arrive, and files of each.
_DELIVERIES, _FILES = 3, 4


@query("talk_stream", f"""WITH t AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'assistant' ELSE 'user' END AS role, coalesce(text, '') AS text, len({sql_tokens("text")}) + {TK.FRAME} AS n FROM conversations),
h AS (SELECT *, coalesce(list('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10)) OVER w, []) AS h, coalesce(sum(n) OVER w, 0) AS past FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)),
d AS (SELECT *, n + past + {TK.FRAME} >= {TK.CONTEXT} AS dropped FROM h WHERE role = 'user'), u AS (SELECT *, n + {TK.FRAME} + CASE WHEN dropped THEN 0 ELSE past END AS used, {_pad()} AS nn FROM d),
b AS (SELECT *, CASE WHEN len(list_filter({strings(K.LISTY)}, lambda p: contains(lower(text), p))) > 0 AND used + 260 < {TK.CONTEXT} THEN 260 ELSE least(160, {TK.CONTEXT} - used - 1) END AS most,
  CASE {{MODE}} WHEN 'age' THEN chr(10) || '(Use only the birth date or age written in the facts.)' WHEN 'live' THEN chr(10) || '(Say that live information is not available.)' ELSE '' END AS note FROM u)
SELECT conv_id, turn, CASE WHEN dropped THEN 0 ELSE len(h) END AS n_history, dropped, CASE WHEN most > 0 THEN most END::BIGINT AS budget,
  md5('<|im_start|>system' || chr(10) || '{TK.SYSTEM}<|im_end|>' || chr(10) || CASE WHEN dropped THEN '' ELSE array_to_string(h, '') END || '<|im_start|>user' || chr(10) || text || note || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)) AS prompt FROM b""".replace("{MODE}", _MODE.replace("contains(n,", "contains(nn,")))
def talk_stream(spark, sf_dir):
    """All conversations delivered in three parts as files of a stream, whose prompts depend on what state holds from the parts before."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    root = folder(spark, "talk")
    for k in range(_DELIVERIES):
        part = F.when(F.col("turn") < 2, 0).when(F.col("turn") < 4, 1).otherwise(2)
        turns.where(part == k).repartition(_FILES, "conv_id").write.mode("append").json(f"{root}/inbox")
        TK.serve(spark, f"{root}/inbox", f"{root}/outbox", f"{root}/state", _FILES).awaitTermination()
    out = spark.read.parquet(f"{root}/outbox")
    return out.select("conv_id", "turn", "n_history", "dropped", "budget", F.md5("prompt").alias("prompt"))
