"""Splits that keep related records together: random-mate contraction and a cumulative-weight split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkweave.plans.durable import Scratch


def _heads(vertex: str, no: int) -> Column:
    """The coin of a vertex in a round: the same wherever it is looked at."""
    return F.pmod(F.xxhash64(F.lit(no), vertex), F.lit(2)) == 1


def contract(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 400) -> DataFrame:
    """(vertex, root): the vertices of each component of the edges share one root (some vertex of it), by random-mate contraction.

    Every round each vertex tosses a coin; a tails vertex with a heads neighbour
    collapses into the smallest such neighbour, edges are renamed by joins, loops
    and repeats vanish. When no edge is left the labels are unwound backwards
    through the rounds. Edges with a null end are left out; a loop makes its
    vertex a component of its own; an empty table gives an empty result.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark)
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    e = e.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    e = first = scratch.write(e, "edges")
    maps: list[DataFrame] = []
    no = 0
    e = e.where("u <> v")
    while e.limit(1).count():
        if no >= max_rounds:
            raise RuntimeError(f"edges left after {max_rounds} rounds")
        ends = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
        towards = e.select(F.explode(ends).alias("e")).select("e.*").where(~_heads("u", no) & _heads("v", no))
        into = scratch.write(towards.groupBy("u").agg(F.min("v").alias("into")), "into")
        maps.append(into)
        # only tails vertices move, so an end is looked up at most once a round
        left = e.join(into, "u", "left").select(F.coalesce("into", "u").alias("u"), "v")
        both = left.join(into.withColumnRenamed("u", "v"), "v", "left").select("u", F.coalesce("into", "v").alias("v"))
        after = scratch.write(both.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
        if no:
            scratch.drop(e)
        e = after
        no += 1
    vertices = first.select(F.explode(F.array("u", "v")).alias("vertex")).distinct()
    if not maps:
        return vertices.select("vertex", F.col("vertex").alias("root"))
    roots = _unwind(maps, scratch)
    return vertices.join(roots, "vertex", "left").select("vertex", F.coalesce("root", "vertex").alias("root"))


def _unwind(maps: list[DataFrame], scratch: Scratch) -> DataFrame:
    """(vertex, root) of all vertices that ever collapsed, from the (u, into) tables of the rounds.

    A vertex collapses once at most, and what it collapsed into does so in a
    later round or never: together the tables are a forest no deeper than the
    number of rounds. Each pass replaces a vertex's label by its label's label,
    which halves the depth. A label held by any share of the vertices is looked
    up under a salt; the looked-up side is only the labels that are not roots.
    """
    salts = 16
    labels = maps[0]
    for m in maps[1:]:
        labels = labels.unionByName(m)
    labels = scratch.write(labels.select(F.col("u").alias("vertex"), F.col("into").alias("root")), "labels")
    depth = 1
    while depth < len(maps):
        held = labels.select(F.col("root").alias("vertex")).distinct()
        ahead = labels.join(held, "vertex", "left_semi").select(F.col("vertex").alias("root"), F.col("root").alias("next"))
        ahead = ahead.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
        salted = labels.withColumn("salt", F.pmod(F.xxhash64("vertex"), F.lit(salts)))
        after = scratch.write(salted.join(ahead, ["root", "salt"], "left").select("vertex", F.coalesce("next", "root").alias("root")), "labels")
        scratch.drop(labels)
        labels = after
        depth *= 2
    return labels


def bound_groups(keys: DataFrame, record: str, key: str) -> DataFrame:
    """(record, group): records that share a key, directly or through others, get the smallest record id among them.

    `keys` has one row per record and key; a null key binds nothing, so a record
    with no other row stays alone. A key is a star from its smallest record, so
    a key held by any number of records adds one edge per record; its smallest
    record comes from a map-side combined minimum that is broadcast-free joined
    under a salt.
    """
    rows = keys.select(F.col(record).alias("r"), F.col(key).alias("k")).where("r IS NOT NULL").distinct()
    salts = 16
    salted = rows.where("k IS NOT NULL").withColumn("salt", F.pmod(F.xxhash64("r"), F.lit(salts)))
    heads = salted.groupBy("k").agg(F.min("r").alias("head")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    stars = salted.join(heads, ["k", "salt"]).select("head", "r")
    loops = rows.where("k IS NULL").select(F.col("r").alias("head"), "r")
    roots = contract(stars.unionByName(loops), "head", "r")
    return smallest_per_root(roots).select(F.col("vertex").alias(record), "group")


def smallest_per_root(roots: DataFrame) -> DataFrame:
    """(vertex, group) from (vertex, root): the group is the smallest vertex of the root; a root with any share of the vertices is joined under a salt."""
    salts = 16
    salted = roots.withColumn("salt", F.pmod(F.xxhash64("vertex"), F.lit(salts)))
    low = roots.groupBy("root").agg(F.min("vertex").alias("group")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return salted.join(low, ["root", "salt"]).select("vertex", "group")


def split_groups(members: DataFrame, group: str, shares: dict[str, float], seed: int = 0) -> DataFrame:
    """(group, split) so that the splits hold about the given shares of all rows and no group is divided.

    Groups are ordered by a seeded hash, except that those larger than the
    smallest share come first, largest first; the running weight, taken at a
    group's middle, says which split it falls in. A group larger than a split
    lands whole in the split its middle falls in, so shares are only met as
    closely as the groups allow. The running weight is a distributed prefix sum:
    totals of at most 1024 hash ranges, then within each range.
    """
    weights = members.groupBy(F.col(group).alias("group")).agg(F.count(F.lit(1)).alias("weight"))
    total = members.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    big = F.col("weight") > min(shares.values()) * max(total, 1)
    # at most 1 / smallest share groups are big: they share range -1
    placed = weights.withColumn("h", F.pmod(F.xxhash64(F.lit(seed), "group"), F.lit(1 << 40))).withColumn("part", F.when(big, F.lit(-1)).otherwise(F.shiftright("h", 30))).withColumn("first", F.when(big, -F.col("weight")).otherwise(F.lit(0)))
    sums = placed.groupBy("part").agg(F.sum("weight").alias("w")).select("part", (F.sum("w").over(Window.orderBy("part")) - F.col("w")).alias("before"))
    w = Window.partitionBy("part").orderBy("first", "h", "group").rowsBetween(Window.unboundedPreceding, 0)
    running = placed.withColumn("upto", F.sum("weight").over(w)).join(F.broadcast(sums), "part")
    middle = (F.col("before") + F.col("upto") - F.col("weight") / 2) / F.lit(float(max(total, 1)))
    edge, split = 0.0, None
    names = list(shares)
    for name in names[:-1]:
        edge += shares[name] / sum(shares.values())
        split = (split.when(middle < edge, F.lit(name)) if split is not None else F.when(middle < edge, F.lit(name)))
    return running.select("group", (split.otherwise(F.lit(names[-1])) if split is not None else F.lit(names[-1])).alias("split"))
