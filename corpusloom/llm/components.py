"""Connected components by alternating large and small stars, on DataFrames."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import materialize, skew_join


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every end of the edges (a, b); component is the smallest id reachable.
    Each round is written to the shared folder; rounds grow with the logarithm of the longest path.
    A hub's edges are only pre-aggregated, or dealt to several tasks for the join."""
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == before or not now[0]:
            break
        before = now

        def met(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
            least = materialize(pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k")), "least")
            return skew_join(pairs, least.select("u", "m"), ["u"], least, 2 * now[0], F.col("v")), least

        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = met(both)[0].where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        small, least = met(large)
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e = materialize(small.distinct(), "edges")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
