"""Packed indexes as Parquet relations, tab-separated corpora, test files, vocabularies, safetensors, chat histories."""

from __future__ import annotations

import io
import json
import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ARTICLES = "article_id long, path string, title string"
PASSAGES = "article_id long, text string"


def write_index(relations: dict[str, DataFrame], folder: str) -> None:
    """One Parquet relation per name; an index is a folder of them, rebuilt as a whole."""
    for name, rows in relations.items():
        rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/{name}")


def open_index(spark: SparkSession, folder: str, schemas: dict[str, list[str]]) -> dict[str, DataFrame]:
    """Opens relations lazily; a missing column is an error right away."""
    out = {}
    for name, columns in schemas.items():
        rows = spark.read.parquet(f"{folder}/{name}")
        if missing := set(columns) - set(rows.columns):
            raise ValueError(f"{name} lacks {sorted(missing)}")
        out[name] = rows
    return out


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated rows without quoting; the last column takes what is left of the line."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [c.split()[1] for c in schema.split(", ")]
    parts = F.split("value", "\t", len(names))
    return spark.read.text(path).select(*(F.try_element_at(parts, F.lit(k + 1)).cast(kinds[k]).alias(n) for k, n in enumerate(names)))


def write_tsv(rows: DataFrame, path: str) -> None:
    """Tabs and line ends inside values become spaces."""
    cells = [F.translate(F.coalesce(F.col(c).cast("string"), F.lit("")), "\t\n\r", "   ") for c in rows.columns]
    rows.select(F.concat_ws("\t", *cells).alias("value")).write.mode("overwrite").text(path)


def read_json_passages(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of passages (text, title, url, source)."""
    return spark.read.schema("text string, title string, url string, source string").json(path, multiLine=True)


def parse_tests(lines: DataFrame) -> DataFrame:
    """(file, line, value) to (file, block, line, question, accepted): "## " names a block, other # and blank lines don't count."""
    value = F.col("value")
    block = F.when(value.startswith("## "), F.trim(F.substring(value, 4, 1_000_000)))
    own = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("block", F.coalesce(F.last(block, ignorenulls=True).over(own), F.lit("block 1")))
    rows = rows.where((F.trim(value) != "") & ~F.trim(value).startswith("#"))
    answers = F.when(F.instr(value, "|") > 0, F.expr("substring(value, instr(value, '|') + 1)")).otherwise("")
    accepted = F.filter(F.transform(F.split(answers, ";"), lambda a: F.trim(a)), lambda a: a != "")
    return rows.select("file", "block", "line", F.trim(F.substring_index(value, "|", 1)).alias("question"), accepted.alias("accepted"))


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(id, piece): the line number is the id. A vocabulary is one small file, read as a whole."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"(\r?\n)+$", ""), "\r?\n")).alias("id", "piece"))
    return lines.select(F.col("id").cast("long").alias("id"), "piece")


def read_safetensors(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    """Typed slices of one model file (F32, F16, I64), read through Spark's reader on the driver for a broadcast."""
    raw = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    size = struct.unpack("<Q", raw[:8])[0]
    head, body = json.loads(raw[8 : 8 + size]), memoryview(raw)[8 + size :]
    kinds = {"F32": "<f4", "F16": "<f2", "I64": "<i8"}
    out = {}
    for name, x in head.items():
        if name != "__metadata__":
            a, b = x["data_offsets"]
            out[name] = np.frombuffer(body[a:b], kinds[x["dtype"]]).reshape(x["shape"])
    return out


def read_matrix(spark: SparkSession, path: str, dimensions: int, most: int | None = None) -> DataFrame:
    """(row, v) of raw float32 matrices, numbered on over the files by name; an incomplete last row of a file is dropped, as are rows from `most` on.

    Where a file's rows begin follows from the files' lengths, a number for each file on the driver.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for content, first in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                raw = content.as_buffer()
                x = np.frombuffer(raw, "<f4", raw.size // (4 * dimensions) * dimensions)
                rows = pa.FixedSizeListArray.from_arrays(pa.array(x), dimensions)
                n = len(rows) if most is None else max(0, min(len(rows), most - first))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + n)), rows.slice(0, n).cast(pa.list_(pa.float32()))], ["row", "v"])

    files, begin, before = spark.read.format("binaryFile").load(path), [], 0
    for name, size in sorted(tuple(r) for r in files.select("path", "length").collect()):
        begin.append((name, before))
        before += size // (4 * dimensions)
    listed = spark.createDataFrame(begin, "path string, first long")
    return files.join(F.broadcast(listed), "path").select("content", "first").mapInArrow(run, "row long, v array<float>")


def history(text: Column, most: int = 6) -> Column:
    """array<struct<role, text>> of a JSON array: any role but assistant is the user, empty texts are skipped."""
    turns = F.filter(F.from_json(text, "array<struct<role:string,text:string>>"), lambda t: F.coalesce(t.text, F.lit("")) != "")
    role = lambda t: F.when(t.role == "assistant", "assistant").otherwise("user")
    return F.slice(F.transform(turns, lambda t: F.struct(role(t).alias("role"), t.text.alias("text"))), 1, most)


def register_archive(spark: SparkSession) -> None:
    """Registers the format "page_archive": a folder of *.jsonl files of entries (path, title, mimetype, redirect, html).

    Stands in for a packed web archive: redirects and other types than that of the option `type` (text/html) are skipped at the source, invalid UTF-8
    is replaced. The folder is listed once; each file is cut into partitions of `rangeBytes` (64 MB), and an entry belongs to the one in
    which it begins. Entries are read one by one.
    """
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.folder, self.type = options["path"], options.get("type", "text/html")
            self.range = int(options.get("rangeBytes", 64 << 20))

        def _store(self):
            from pyarrow import fs

            return fs.FileSystem.from_uri(self.folder) if "://" in self.folder else (fs.LocalFileSystem(), self.folder)

        def partitions(self):
            from pyarrow import fs

            store, root = self._store()
            found = sorted((f.path, f.size) for f in store.get_file_info(fs.FileSelector(root)) if f.path.endswith(".jsonl"))
            return [InputPartition((path, at, min(size, at + self.range))) for path, size in found for at in range(0, size, self.range)]

        def read(self, partition):
            path, at, end = partition.value
            with io.BufferedReader(self._store()[0].open_input_file(path)) as file:
                if at:  # the entry that began before belongs to the range before
                    file.seek(at - 1)
                    at += len(file.readline()) - 1
                while at < end and (line := file.readline()):
                    at += len(line)
                    if not line.strip():
                        continue
                    entry = json.loads(line.decode("utf-8", "replace"))
                    if not entry.get("redirect") and str(entry.get("mimetype", "")).startswith(self.type):
                        yield entry.get("path"), entry.get("title"), entry.get("html")

    class Archive(DataSource):
        @classmethod
        def name(cls):
            return "page_archive"

        def schema(self):
            return "path string, title string, html string"

        def reader(self, schema):
            return Reader(self.options)

    spark.dataSource.register(Archive)
