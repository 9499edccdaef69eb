"""The opN_ queries, over their whole tables, with their oracle SQL."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitpack, chat, decontaminate, importance, metric, minhash, mixing, packing, periodic, rolling, suffixes, toxicity, urlfilter
from .common import Scratch, table


def op1_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that importance resampling keeps; no SQL: tested by accuracy on labels and against plain Python."""
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every document; no SQL: tested by accuracy on held-out labels."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), 0.3)


def op3_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page as of its fetch day."""
    pages = table(spark, sf_dir, "pages")
    return urlfilter.verdicts(urlfilter.table_captures(pages), urlfilter.intervals(urlfilter.table_entries(pages)))


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of 1024 ids, of at most 1024 pieces and 960 loss-bearing ids (a document's first quarter bears none);
    no SQL: tested against the library's ids and the limits."""
    return packing.pack(
        table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0, limits=packing.DOCUMENT_LIMITS, prompt_share=packing.DOCUMENT_PROMPT
    )


def op5_bitpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes and reads back the id files; no SQL: tested by an exact round trip."""
    folder = Scratch(spark, "token-ids").root
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    written = bitpack.write_ids(table(spark, sf_dir, "documents"), folder, vocabulary("word_bpe_49k.json"), 1, files)
    return bitpack.read_ids(spark, folder, written)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removes what a 200-byte string covers that also starts elsewhere; no SQL: tested against brute force."""
    return suffixes.removal_report(table(spark, sf_dir, "documents"))


def op7_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of equal labels at a cosine of 0.93 or more; no SQL: tested against brute force."""
    return metric.near_vectors(table(spark, sf_dir, "embeddings"), 0.93)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents hold, word for word or with other values in their slots."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes every conversation as an event log, folds and renders it, and reads the output back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", _CONTROL_TEXT), (-7, 1, "assistant", _CONTROL_TEXT)], turns.schema)
    return chat.report(chat.messages(chat.log_of(turns.unionByName(extra))))


OP9_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{_CONTROL_TEXT}' UNION ALL SELECT -7, 1, 'assistant', '{_CONTROL_TEXT}')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  cast(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  cast(sum(24 + 2 * length(role || text) - length(regexp_replace(role || text, '[\\\\<\\[]', '', 'g'))) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id"""


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at a similarity of 0.75 or more on five-word shingles; no SQL: tested against brute force."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document; no SQL: tested against its targets and a plain program of the same draws."""
    return mixing.taken(mixing.mix(table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken")


OP12_RANKS = (("median_chars", 1, 2), ("high_chars", 99, 100))
OP12_WIDTHS = (1800, 86400)


def document_events(docs: DataFrame) -> DataFrame:
    """(doc_id, source, lang, event_s, chars): a time for each document by the rule of the tables, and its length."""
    moved = F.col("doc_id") + F.crc32(F.col("doc_id").cast("string").cast("binary")) % 1000
    return docs.select("doc_id", "source", "lang", (60 * F.floor((moved - F.pmod(moved, F.lit(6))) / 6)).alias("event_s"), F.length("text").cast("long").alias("chars"))


def op12_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of each document's source over the half hour and the day before it."""
    out = rolling.features(document_events(table(spark, sf_dir, "documents")), OP12_WIDTHS, OP12_RANKS, "source", "event_s", "chars", "lang")
    return out.select("doc_id", "window_s", "event_s", "n_events", F.col("total").alias("sum_chars"), F.col("n_labels").alias("n_langs"), "median_chars", "high_chars")


_SQL_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, 1 + length(doc_id::VARCHAR)), lambda k: ascii(substr(doc_id::VARCHAR, k, 1))::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 1, 2, 3, 4, 5, 6, 7]), lambda a, i: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END))))"""
OP12_SQL = f"""
WITH e AS (SELECT doc_id, source, lang, length(text) AS chars, 60 * cast(floor((doc_id + {_SQL_CRC32} % 1000) / 6) AS BIGINT) AS event_s FROM documents),
q AS (SELECT DISTINCT source, event_s, w FROM e, (SELECT unnest([1800, 86400]) AS w)),
f AS (SELECT q.source, q.event_s, q.w, count(e.event_s) AS n_events, cast(coalesce(sum(e.chars), 0) AS BIGINT) AS sum_chars, count(DISTINCT e.lang) AS n_langs,
    list_sort(list(e.chars) FILTER (WHERE e.chars IS NOT NULL)) AS l
  FROM q LEFT JOIN e ON q.source IS NOT DISTINCT FROM e.source AND e.event_s >= q.event_s - q.w AND e.event_s < q.event_s GROUP BY ALL)
SELECT e.doc_id, cast(f.w AS BIGINT) AS window_s, e.event_s, n_events, sum_chars, n_langs,
  l[(len(l) + 1) // 2] AS median_chars, l[(99 * len(l) + 99) // 100] AS high_chars
FROM e JOIN f ON e.source IS NOT DISTINCT FROM f.source AND e.event_s IS NOT DISTINCT FROM f.event_s"""


def periodic_words(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a document, of which one in ten is made periodic from some word on, by the rule of the tables."""
    h = 1 if doc_id is None else zlib.crc32(b"%d" % doc_id)
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document's words, the strongest of them, and digests; no SQL: tested against brute force."""
    found = periodic.collapse(table(spark, sf_dir, "documents"), periodic_words)
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    best = F.col("best")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), periodic.strongest().alias("best"), "runs", "collapsed").select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period", F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_importance": op1_importance,
        "op2_toxicity": op2_toxicity,
        "op3_url_lists": op3_url_lists,
        "op4_packing": op4_packing,
        "op5_bitpack": op5_bitpack,
        "op6_suffix_dedup": op6_suffix_dedup,
        "op7_metric_join": op7_metric_join,
        "op8_decontaminate": op8_decontaminate,
        "op9_chat_format": op9_chat_format,
        "op10_minhash": op10_minhash,
        "op11_mixing": op11_mixing,
        "op12_rolling": op12_rolling,
        "op13_runs": op13_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_url_lists": urlfilter.SQL,
        "op8_decontaminate": decontaminate.SQL,
        "op9_chat_format": OP9_SQL,
        "op12_rolling": OP12_SQL,
    }
