"""Consolidating pairwise matches into groups: hash-to-min."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.plans.durable import Scratch


def hash_to_min(pairs: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 64) -> DataFrame:
    """(vertex, group): every vertex of the pairs with the smallest vertex it reaches, by hash-to-min.

    Each vertex v keeps a cluster C(v), held as rows (v, member), at first v and
    its neighbours. A round sends all of C(v) to its smallest member m, and m to
    every member, until no cluster changes. Then the smallest vertex of a
    component holds it whole and every other vertex holds only that smallest.
    Pairs with a null on either side link nothing; a pair of a vertex with
    itself makes it a vertex of its own; repeats are harmless; an empty table
    gives an empty result.
    """
    scratch = Scratch(pairs.sparkSession)
    p = pairs.select(F.col(a).alias("v"), F.col(b).alias("w")).where("v IS NOT NULL AND w IS NOT NULL")
    both = F.array(F.struct("v", "w"), F.struct(F.col("w").alias("v"), F.col("v").alias("w")), F.struct("v", F.col("v").alias("w")), F.struct(F.col("w").alias("v"), "w"))
    clusters = scratch.write(p.select(F.explode(both).alias("p")).select("p.*").distinct(), "clusters")
    mark = _mark(clusters)
    for _ in range(max_rounds):
        minima = clusters.groupBy("v").agg(F.min("w").alias("m"))
        sent = clusters.join(minima, "v")
        moved = F.array(F.struct(F.col("m").alias("v"), "w"), F.struct(F.col("w").alias("v"), F.col("m").alias("w")))
        after = scratch.write(sent.select(F.explode(moved).alias("p")).select("p.*").distinct(), "clusters")
        new_mark = _mark(after)
        scratch.drop(clusters)
        clusters = after
        if new_mark == mark:
            return clusters.groupBy("v").agg(F.min("w").alias("group")).select(F.col("v").alias("vertex"), "group")
        mark = new_mark
    raise RuntimeError(f"not stable after {max_rounds} rounds")


def _mark(clusters: DataFrame) -> tuple:
    """Row count and two 64-bit sums: equal marks mean equal cluster tables."""
    h = lambda seed: F.sum(F.xxhash64(F.lit(seed), "v", "w").cast("decimal(38,0)"))
    return tuple(clusters.agg(F.count(F.lit(1)), h(1), h(2)).first())
