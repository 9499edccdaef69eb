"""Functions called on their own, from a folder outside the repository, by workers that don't have the package."""

from __future__ import annotations

import pytest

from tests.shipping import run

CALLS = {
    "nearest": """
from gleaner.operators import dense
rows = spark.createDataFrame([(k, [float(k), 1.0], 1.0) for k in range(9)], "passage_id long, v array<double>, scale double")
print(dense.nearest(rows, rows.withColumnRenamed("passage_id", "question_id"), 2).count())
from gleaner.operators import pca
print(pca.project(rows, pca.fit(rows, 1)).count())
from gleaner.operators import wordpiece
print(wordpiece.term_pieces(spark.createDataFrame([("ab",)], "term string"), ["a", "##b"]).count())
from gleaner.operators import lexical, postings
index = lexical.Index.of(spark.createDataFrame([(1, "a", 2, 3)], "passage_id long, term string, tf long, doclen long").drop("doclen"))
print(postings.read_blocks(postings.write_blocks(index, "file://" + tempfile.mkdtemp() + "/b")).count())
from pyspark.sql import functions as F
from gleaner.operators import reading
pairs = spark.createDataFrame([(1, 2, "q", "some text")], "question_id long, passage_id long, question string, context string")
print(reading.read(pairs, lambda t: t.withColumns({"start": F.lit(1.0), "end": F.lit(1.0), "null_score": F.lit(0.0)})).count())
print("done")
""",
    "stream": """
from gleaner.streaming import talk
root = "file://" + tempfile.mkdtemp()
spark.createDataFrame([(1, 0, "user", "hello"), (1, 1, "user", "again")], talk.TURNS).write.json(root + "/in")
talk.serve(spark, root + "/in", root + "/out", root + "/state").awaitTermination()
print(spark.read.parquet(root + "/out").count())
print("done")
""",
}


@pytest.mark.parametrize("name", CALLS)
def test_workers_without_the_package(tmp_path, name):
    assert run(tmp_path, CALLS[name]).rstrip().endswith("done")
