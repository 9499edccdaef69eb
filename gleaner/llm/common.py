"""Shared folder, materialised intermediates and size-checked broadcasts."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.ship import ship

#: Rows up to which an id-only side may be broadcast (8 to 24 bytes each, so at most about 24 MB).
BROADCAST_ROWS = 1_000_000


#: Bytes of an Arrow batch between Spark and a Python worker; bounds both sides' buffers when texts are long.
BATCH_BYTES = 4 << 20


def prepared(spark: SparkSession) -> SparkSession:
    """Ships this package and lowers the size of Arrow batches, unless the user has set it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).rstrip("bB") == str(64 << 20):
        spark.conf.set(key, str(BATCH_BYTES))
    return ship(spark)


def trimmed(run):
    """run, a function for mapInArrow, which at its end gives memory that the worker process has freed back to the system.

    Workers serve many tasks of different stages; freed arrays would otherwise stay with each of them.
    """

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
                trim(0)

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new one where that is unset.

    A new one is local, so it is made only where the executors are threads of this process.
    """
    found = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gleaner-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Intermediates written as Parquet in the shared folder, so that a lost executor costs only its own tasks.

    A name that is saved again, or dropped, loses its older files; the last ones stay, because the
    returned DataFrame reads them lazily. They lie in one folder per operator run, to be expired with
    the other content of the checkpoint folder.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.at = prepared(spark), f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}", {}

    def path(self, name: str) -> str:
        return f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"

    def save(self, df: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
        where = self.path(name)
        df.write.parquet(where)
        self.drop(name)
        self.at[name] = where
        return self.spark.read.schema(df.schema).parquet(where)

    def drop(self, *names: str) -> None:
        for name in names:
            if where := self.at.pop(name, None):
                delete(self.spark, where)


def delete(spark: SparkSession, where: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most that many rows; else as it is, so that the join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Rows of one key beyond which a join takes the key's partner from a broadcast instead of a shuffle.
HOT = 256
#: Keys that can have more than HOT rows each, at most; HOT rises with the number of rows to hold this.
HOT_KEYS = 500_000


def join_counted(rows: DataFrame, side: DataFrame, keys: list[str], count: str, how: str = "inner") -> DataFrame:
    """rows joined with side, which has one row for each key and in `count` the number of rows that have it.

    Keys of many rows are joined by broadcast, so their rows stay where they are; there are at most HOT_KEYS of
    them, since the counts add up to all rows. The others are shuffled. how: inner or left.
    """
    found = side.agg(F.sum(count).alias("all"), F.max(count).alias("most")).first()
    least = max(HOT, (found["all"] or 0) // HOT_KEYS)
    if (found.most or 0) <= least:
        return rows.join(side, keys, how)
    hot = F.broadcast(side.where(F.col(count) > least))
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(side.where(F.col(count) <= least), keys, how)
    return rows.join(hot, keys).unionByName(rest)


def rows_matching(docs: DataFrame, found: DataFrame, how: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose (id, hash of the text) is in found (doc_id, text_hash), or with how="left_anti" the others.

    A null id equals a null id; the text tells rows of one id apart. Columns of docs may have any names.
    """
    names = [f"c{k}" for k in range(len(docs.columns))]
    rows = docs.toDF(*names)
    its_id, its_text = (F.col(names[docs.columns.index(c)]) for c in (id_col, text_col))
    found = small(found.select("doc_id", "text_hash").distinct(), 500_000)
    same = its_id.cast("long").eqNullSafe(found["doc_id"]) & (F.xxhash64(its_text.cast("string")) == found["text_hash"])
    return rows.join(found, same, how).toDF(*docs.columns)
