"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia.llm._store import dropped, shuffle_joined, staged


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """uid, comp for each node that has an edge to another, staged; comp is the component's least node.

    Each round joins edges with the least neighbour of their node (a plain equi
    join, which Spark splits where a node has very many edges) and stages the
    result; rounds grow with the logarithm of a component's size.
    """
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = staged(e, "star-edges")
    mark = lambda x: x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").bitwiseAND(0xFFFFFFFF))).first()
    seen = mark(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = shuffle_joined(both.where("v > u"), least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = staged(large, "star-large")
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = shuffle_joined(large, lowest, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        old, e = e, staged(small, "star-edges")
        dropped(old, large)
        now = mark(e)
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("v").alias("uid"), F.col("v").alias("comp")).distinct()
    out = staged(e.select(F.col("u").alias("uid"), F.col("v").alias("comp")).unionByName(roots), "components")
    dropped(e)
    return out
