"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a grouped minimum and a join, so links stay distributed; a hub's rows can be split by the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histoloom.session import stage


def _toward_minimum(edges: DataFrame, include_self: bool) -> tuple[DataFrame, DataFrame]:
    """edges (u, v) with the least v of each u as m; and those minima."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    if include_self:
        least = least.withColumn("m", F.least("u", "m"))
    return edges.join(least, "u"), least


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of an edge table (a, b); root is the least node of the component. Null ends and loops are ignored."""
    current = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and u != v").distinct()
    current, before = stage(current, "edges"), None
    while True:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        joined, _ = _toward_minimum(both, include_self=True)
        large = joined.where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        joined, least = _toward_minimum(large, include_self=False)
        small = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        current = stage(small, "edges")
        now = current.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first()
        if now == before:
            break
        before = now
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
