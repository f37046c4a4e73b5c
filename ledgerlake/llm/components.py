"""Connected components of an edge table, by large-star and small-star steps.

Every step is joins and minima; its edges are written to the shared folder,
so lineage stays short and lost executors cost one step at most.  A node with
very many edges is salted in the joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import salted_join, stored


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label`` (the least node reachable) of all nodes of ``edges`` (a, b)."""
    now = stored(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                 .distinct(), "edges")
    seen = None
    while True:
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (salted_join(both.filter("v > u"), least, ["u"], ["v"])
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (salted_join(large, least, ["u"], ["v"]).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionAll(least.select("u", F.col("m").alias("v"))).distinct())
        now = stored(small, "edges")
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen:
            break
        seen = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionAll(
        now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
