"""Connected components of a graph of 64-bit nodes by alternating star contractions.

Each round first links every node's larger neighbours to its smallest neighbour, then every
node's smaller neighbours to the smallest. Minima are combined before each shuffle, edges
are only ever rows of a join (which adaptive execution can split for a hub), and each round
is a table in the shared folder. The driver sees a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import Scratch


def component_labels(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges(a, b) -> (node, label): the smallest node reachable; smallest nodes themselves are left out."""
    now = scratch.keep(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("label")).distinct(), "edges")
    state = _state(now)
    while True:
        both = now.select("node", "label").unionByName(now.select(F.col("label").alias("node"), F.col("node").alias("label")))
        least = both.groupBy("node").agg(F.min("label").alias("low")).withColumn("low", F.least("low", "node"))
        large = both.join(least, "node").where(F.col("label") > F.col("node")).select(F.col("label").alias("node"), F.col("low").alias("label")).distinct()
        large = scratch.keep(large, "large")
        low = large.groupBy("node").agg(F.min("label").alias("low"))
        small = large.join(low, "node").where(F.col("label") != F.col("low")).select(F.col("label").alias("node"), F.col("low").alias("label"))
        then = scratch.keep(small.unionByName(low.withColumnRenamed("low", "label")).distinct(), "small")
        scratch.drop(now, large)
        before, state, now = state, _state(then), then
        if state == before:
            return now


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("node", "label")), F.sum(F.hash("label", "node").cast("long"))).first())
