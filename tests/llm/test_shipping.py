"""Training-data operators called on their own by workers that don't have the package."""

from __future__ import annotations

from tests.shipping import run

BODY = """
import public_tokenizers
from gleaner.llm import bitpack, chat, packing, periodic, toxicity
docs = spark.createDataFrame([(k, "some words in a text " * 8 + str(k), "s") for k in range(6)], "doc_id long, text string, source string")
turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "there")], "conv_id long, turn long, role string, text string")
log = chat.log_of(turns)
rendered = chat.messages(log)
print(rendered.count())
print(chat.report(rendered).count())
"""
# Each in an application of its own: the first call that ships the package would help the others.
ALONE = {
    "pack": 'print(packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).count())',
    "score": 'labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic")\nprint(toxicity.score(docs, labels).count())',
    "read_ids": "print(bitpack.read_ids(spark, 'file:///nowhere', []).count())",
    "collapse": "print(periodic.collapse(docs).count())",
}


def test_workers_without_the_package(tmp_path):
    imports = BODY.split("docs =")[0]
    docs = "docs =" + BODY.split("docs =")[1].split("\n")[0] + "\n"
    assert run(tmp_path, BODY + "print('done')").rstrip().endswith("done")
    for name, call in ALONE.items():
        folder = tmp_path / name
        folder.mkdir()
        assert run(folder, imports + docs + call + "\nprint('done')").rstrip().endswith("done"), name
