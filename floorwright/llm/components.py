"""Connected components of an edge table by alternating star contractions, all on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floorwright.llm.common import dropped, written


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): component is the least node that links reach. Only nodes with a link are returned.

    edges: two long columns a, b. Nulls and loops are passed over; repeated links count once.
    A node with very many links is never gathered in one task: its minimum is pre-aggregated and written, and links meet
    it in a join of two plain tables, which Spark broadcasts where that one is small and deals out anew where it is skewed.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and a <> b").distinct()
    e = written(e, "links")
    before = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        stars = written(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "stars")
        large = written(both.join(stars, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        state = new.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        for old in (e, stars, large, least):
            dropped(old)
        e = new
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
