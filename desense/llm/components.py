"""Connected components of an edge table, by rounds of joins on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from desense.llm.common import released, written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 100) -> DataFrame:
    """(node, root) for every node of an edge: root is the smallest node it can reach.

    Each round links every node's neighbours (and itself) to the smallest of them, first
    towards larger neighbours, then towards smaller ones; trees become stars in a number
    of rounds that is logarithmic in practice. Minima are summed before the shuffle and
    written, so each join has two plain tables, of which Spark splits the partitions that
    a node with very many edges makes large. Each round's edges are a written table, and
    the round before is deleted.
    """
    edges = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        # larger neighbours of u go to u's smallest
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).distinct())
        # u and its smaller neighbours go to the smallest of them
        low = written(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        released(edges, least, large, low)
        edges = after
        # stars: every node below hangs on one node, which is not below another itself
        ends = after.select("u", F.lit(1).alias("ups"), F.lit(0).alias("downs")).unionByName(after.select(F.col("v").alias("u"), F.lit(0).alias("ups"), F.lit(1).alias("downs")))
        ends = ends.groupBy("u").agg(F.sum("ups").alias("ups"), F.max("downs").alias("downs"))
        if ends.where("ups > 1 or ups = 1 and downs = 1").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    found = written(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots))
    released(edges)
    return found
