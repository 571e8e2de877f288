"""Connected components by alternating large-star and small-star steps.

Edges are rewired towards smaller neighbours until each vertex points at the smallest
of its component. A step is a minimum per vertex (combined before the shuffle) and an
equi-join with it. Vertices with many neighbours are looked up apart (look_up()), so that
the edges of one never meet in a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.lookup import look_up
from docloom.llm.storage import drop, save


def components(spark: SparkSession, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges: u, v. Returns node, root for every node of an edge; root is its component's smallest node."""
    now = save(spark, edges.where("u <> v").select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        large = _star(spark, now, True)
        small = _star(spark, large, False)
        drop(spark, large)
        drop(spark, now)
        now = small
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _star(spark: SparkSession, edges: DataFrame, large: bool) -> DataFrame:
    """edges: u > v. Large: larger neighbours of a node go to its smallest one; small: smaller ones do."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = save(spark, both.groupBy(F.col("u").alias("at")).agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n")), "least")
    out = look_up(both, least.withColumnRenamed("at", "own"), "u", "own", "n", "v")
    if large:
        moved = out.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = out.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("at").alias("u"), F.col("m").alias("v")))
    done = save(spark, moved.where("u <> v").distinct(), "star")
    drop(spark, least)
    return done
