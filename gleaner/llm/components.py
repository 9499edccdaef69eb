"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_counted


def _large(edges: DataFrame, scratch: Scratch) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    least = scratch.save(least.select("u", F.least("u", "m").alias("m"), "n"), "large")
    return join_counted(both, least, ["u"], "n").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame, scratch: Scratch) -> DataFrame:
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
    least = scratch.save(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "small")
    moved = join_counted(edges, least, ["u"], "n").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that is not the smallest of its component.

    Nodes are numbers, or structs, which compare by their fields in order. Each pass minimises over neighbours
    with map-side partial aggregates; rows of a hub meet its minimum by broadcast, so no task gets them all.
    A pass's edges are written to the shared folder and read again, so the lineage stays short. It ends when
    a pass changes nothing, tested by a count and two hashes. Null ends and loops are ignored; repeated
    edges count once; no edges give no rows.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    now, before = scratch.save(now, "edges"), None
    while True:
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if state == before or not state[0]:
            scratch.drop("large", "small")
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = state
        larger = scratch.save(_large(now, scratch), "larger")
        now = scratch.save(_small(larger, scratch).distinct(), "edges")
        scratch.drop("larger")
