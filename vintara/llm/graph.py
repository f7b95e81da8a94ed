"""Connected components of a graph that only Spark holds, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vintara.llm.common import written


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) of every node of an edge (u, v) with u != v; the root is the least node.

    Every round is written to the shared folder, so a lost executor costs at most a round. A round
    groups edges by node with a minimum, which Spark combines in the map stage, and joins the
    minimum back, a join that adaptive execution splits at a node of many edges. Rounds grow with
    the logarithm of the longest path.
    """
    current = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), name)
    state = _state(current)
    while state[0]:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = written(small.unionByName(least.withColumnRenamed("m", "v")).where("u <> v").distinct(), name)
        before, state = state, _state(current)
        if state == before:
            break
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())
