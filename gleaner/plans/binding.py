"""The tables as articles, passages, vectors and questions, in Spark and in SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators import lexical as L
from gleaner.ship import ship

#: passage_id = article_id * STRIDE + line.
STRIDE = 1_000_000


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt over all cores, if they come in fewer partitions than there are cores (a small table in one row group)."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name == "documents" else rows


def folder(spark: SparkSession, name: str) -> str:
    """A new folder where all executors can write: under spark.checkpoint.dir, or a local one where Spark is local and that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="gleaner-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_indexes: dict[tuple[str, str, str], L.Index] = {}


def index(spark: SparkSession, sf_dir: str, of: str = "passages") -> L.Index:
    """The lexical index of all passages, or of all documents, of a folder of tables; built once in an application."""
    key = (spark.sparkContext.applicationId, sf_dir, of)
    if key not in _indexes:
        rows = passages(spark, sf_dir) if of == "passages" else table(spark, sf_dir, "documents").select(F.col("doc_id").alias("passage_id"), "text")
        _indexes[key] = L.Index.build(rows, folder(spark, f"index-{of}"))
    return _indexes[key]


_saved: dict[tuple[str, str, str], DataFrame] = {}


def saved(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """make(spark, sf_dir), written once in an application and read from then on."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _saved:
        where = folder(spark, name)
        make(spark, sf_dir).write.parquet(where)
        _saved[key] = spark.read.parquet(where)
    return _saved[key]


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(passage_id, article_id, text): the lines of documents that aren't empty."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return rows.where("text <> ''").select((F.col("doc_id") * STRIDE + F.col("line")).alias("passage_id"), F.col("doc_id").alias("article_id"), "text")


def title_of(text: str) -> Column:
    """A text's first three words; what follows them isn't split."""
    return F.array_join(F.slice(F.split(text, r"\s+", 4), 1, 3), " ")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(article_id, title, path): a title of the first three words."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), title_of("text").alias("title"), F.concat_ws("/", "source", "doc_id").alias("path"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), "text")


def strings(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_tokens(column: str) -> str:
    token = T.TOKEN.replace(r"\s\p{Z}", r"\s\p{Z}")
    return f"regexp_extract_all(strip_accents(lower(coalesce({column}, ''))), '{token}')"


def sql_pieces(column: str) -> str:
    """Tokens as they stand and what lies between them, by turns."""
    token = T.SOURCE_TOKEN.replace("'", "''")
    return f"string_split(regexp_replace({column}, '({token})', chr(1) || '\\1' || chr(1), 'g'), chr(1))"


PASSAGES = f"""passages AS (SELECT doc_id * {STRIDE} + line - 1 AS passage_id, doc_id AS article_id, text FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents) WHERE text <> '')"""
TF = f"""{PASSAGES},
tf AS (SELECT passage_id, term, count(*) AS tf FROM (SELECT passage_id, unnest({sql_tokens("text")}) AS term FROM passages) GROUP BY ALL),
lengths AS (SELECT passage_id, sum(tf) AS doclen FROM tf GROUP BY ALL),
stats AS (SELECT count(*) AS n, avg(doclen) AS avgdl FROM lengths),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL)"""


def sql_question_terms(column: str = "text", table: str = "benchmark", key: str = "item_id") -> str:
    """question terms (question_id, term) as a CTE body."""
    return f"SELECT DISTINCT question_id, term FROM (SELECT {key} AS question_id, unnest({sql_tokens(column)}[1:128]) AS term FROM {table}) WHERE NOT list_contains({strings(T.STOP_WORDS)}, term)"


def sql_related(a: str, b: str) -> str:
    return (
        f"({a} = {b} OR (least(strlen({a}), strlen({b})) >= 4 AND abs(strlen({a}) - strlen({b})) <= 3 AND left({a}, 1) <> '#' AND left({b}, 1) <> '#' "
        f"AND (starts_with({a}, {b}) OR starts_with({b}, {a}))))"
    )
