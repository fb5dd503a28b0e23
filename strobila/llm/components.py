"""Connected components of a graph given by its edges, by alternating large-star and small-star steps.

Every step groups by a node and rewires its neighbours to the smallest one, so a step moves as many rows as there are
edges, a hub's edges are combined before the shuffle, and the number of rounds grows with the logarithm of the graph.
Each step's rows are written to the shared folder, which ends their lineage. The driver sees two sums a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strobila.llm.store import remove, written


def _smallest(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("_m"))


def _down(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``edges`` (u, v: long) to (node, component): the smallest node that each node of an edge reaches.

    Self-loops, repeated edges and edges with a null end are ignored; nodes without an edge do not appear.
    """
    spark = edges.sparkSession
    now, path = written(_down(edges.select("u", "v").dropna()), "edges")
    before = None
    for _ in range(most_rounds):
        at = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if at == before or not at[0]:
            break
        before = at
        # Minima are written before they are joined: then each side of a join comes straight from a shuffle, and Spark
        # splits the edges of a hub over tasks.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low, low_path = written(_smallest(both).select("u", F.least("u", "_m").alias("m")), "low")
        large, large_path = written(_down(both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))), "edges")
        least, least_path = written(_smallest(large).withColumnRenamed("_m", "m"), "low")
        moved = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new, new_path = written(_down(moved.unionByName(least.select("u", F.col("m").alias("v")))), "edges")
        remove(spark, path, low_path, large_path, least_path)
        now, path = new, new_path
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
