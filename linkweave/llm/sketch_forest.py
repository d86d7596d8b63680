"""All similar pairs between set-valued records: sorted sketch forests with exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkweave.llm.wordscan import fold, mix
from linkweave.plans.durable import Scratch


def found_share(similarity, depth: int, trees: int):
    """Probability that two sets of the similarity share a prefix of `depth` minhashes in some of the trees."""
    return 1 - (1 - similarity**depth) ** trees


def forest_depths(threshold: float, trees: int, target_recall: float) -> list[int]:
    """Depths to compare neighbourhoods at: a deep one first, down to the one that finds a pair at the threshold with the target probability."""
    last = 1
    while found_share(threshold, last + 1, trees) >= target_recall:
        last += 1
    return [last + 1, last]


def _signatures(trees: int, depths: list[int]):
    """Rows (sid, size, rare, shallow, deep): per set and tree the hashes of its minhash prefixes of both depths, which stand for the tree too, a whole batch of sets at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                lists = part.column("hashes")
                offset = np.asarray(lists.offsets) - lists.offsets[0].as_py()
                h = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                cols = []
                for tree in range(trees):
                    prefix = np.full(len(part), tree, np.uint64)
                    kept = []
                    for no in range(1, depths[0] + 1):
                        seed = mix(np.array([tree * depths[0] + no], np.uint64))
                        prefix = fold(prefix, np.minimum.reduceat(mix(h ^ seed), offset[:-1]))
                        if no in depths:
                            kept.append(prefix.view(np.int64))
                    cols.append(kept)
                every = np.tile(np.arange(len(part)), trees)
                same = part.select(["sid", "size", "rare"]).take(pa.array(every))
                yield pa.RecordBatch.from_arrays([*same.columns, *(pa.array(np.concatenate(c)) for c in zip(*cols))], names=["sid", "size", "rare", "shallow", "deep"])

    return run


def similar_classes(sets: DataFrame, threshold: Fraction, trees: int = 16, target_recall: float = 0.999999) -> tuple[DataFrame, DataFrame]:
    """(members, pairs) of `sets` (kind, record, items): members (kind, record, sid) names each record's class of equal sets, pairs (a, b) the different classes with a similarity of at least the threshold.

    Similarity is (common) / (elements of either). items are arrays without
    nulls or repeats, sorted; empty ones are left out. Sets are compared within
    a kind only. In every tree the classes stand in the order of their minhash
    signatures; those with a common prefix are neighbours. The deep prefixes are
    compared first; if the recall measured on the pairs found (each counts for
    one over the probability that its similarity is found) is under the target,
    those that share the shallow prefix only are compared too, which meets the
    target for pairs at the threshold. Two sets at the threshold share one of
    their first size - ceil(threshold * size) + 1 elements in order of rarity,
    so neighbours are compared only where they share such an element; sets that
    have nothing but a common element together never meet. All pairs are
    verified exactly. An empty table gives empty results.
    """
    spark = sets.sparkSession
    scratch = Scratch(spark)
    num, den = threshold.numerator, threshold.denominator
    depths = forest_depths(float(threshold), trees, target_recall)
    rows = sets.where(F.size("items") > 0).select("kind", "record", "items").distinct()
    classes = rows.select("kind", "items").distinct().withColumn("sid", F.monotonically_increasing_id()).withColumn("size", F.size("items"))
    classes = scratch.write(classes, "classes")
    members = scratch.write(rows.join(classes.select("kind", "items", "sid"), ["kind", "items"]).select("kind", "record", "sid"), "members")

    items = classes.select("kind", "sid", "size", F.explode("items").alias("item"))
    often = items.groupBy("kind", "item").agg(F.count(F.lit(1)).alias("often"))
    ranked = items.join(often, ["kind", "item"]).groupBy("kind", "sid", "size").agg(F.array_sort(F.collect_list(F.struct("often", F.xxhash64("kind", "item").alias("h"), F.hash("item").alias("short")))).alias("ranked"))
    rare = F.slice("ranked", 1, (F.col("size") - F.ceil(F.col("size") * num / den) + 1).cast("int"))
    ready = ranked.select("sid", "size", F.transform("ranked", lambda x: x["h"]).alias("hashes"), F.transform(rare, lambda x: x["short"]).alias("rare"))
    forest = ready.mapInArrow(_signatures(trees, depths), "sid bigint, size int, rare array<int>, shallow bigint, deep bigint")
    wide, narrow = Window.partitionBy("shallow"), Window.partitionBy("shallow", "deep")
    forest = scratch.write(forest.withColumn("n", F.count(F.lit(1)).over(wide)).where("n > 1").withColumn("n_deep", F.count(F.lit(1)).over(narrow)).drop("n"), "forest")

    fits = (F.col("x.size") * den >= F.col("y.size") * num) & (F.col("y.size") * den >= F.col("x.size") * num)
    sides = classes.select("kind", "sid", "items")
    pairs = None
    for depth, prefix, own in ((depths[0], "deep", forest.where("n_deep > 1")), (depths[1], "shallow", forest)):
        t = own.select(*sorted({prefix, "deep"}), "sid", "size", F.explode("rare").alias("element"))
        keys = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in (prefix, "element")]
        apart = [F.col("x.deep") != F.col("y.deep")] if prefix != "deep" else []
        near = t.alias("x").join(t.alias("y"), [*keys, F.col("x.sid") < F.col("y.sid"), fits, *apart]).select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b")).distinct()
        if pairs is not None:
            near = near.join(pairs, ["a", "b"], "left_anti")
        both = near.join(sides.select("kind", F.col("sid").alias("a"), F.col("items").alias("x")), "a").join(sides.select("kind", F.col("sid").alias("b"), F.col("items").alias("y")), ["kind", "b"]).withColumn("common", F.size(F.array_intersect("x", "y")))
        exact = F.col("common") * den >= (F.size("x") + F.size("y") - F.col("common")) * num
        good = scratch.write(both.where(exact).select("a", "b", "common", (F.size("x") + F.size("y") - F.col("common")).alias("either")), f"pairs_{prefix}")
        pairs = good if pairs is None else pairs.unionByName(good)
        seen = good.agg(F.count(F.lit(1)).alias("n"), F.sum(1 / found_share_of(F.col("common") / F.col("either"), depth, trees)).alias("all")).first()
        if seen["n"] and seen["n"] >= target_recall * seen["all"]:
            break
    scratch.drop(forest)
    return members, pairs


def found_share_of(similarity: Column, depth: int, trees: int) -> Column:
    """found_share of a column."""
    return 1 - F.pow(1 - F.pow(similarity, F.lit(float(depth))), F.lit(float(trees)))


def record_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(kind, a, b) with a < b: every pair of different records of one class or of two paired classes, once."""
    m = members.select("kind", "record", "sid")
    x, y = m.select("kind", F.col("record").alias("r"), F.col("sid").alias("a")), m.select(F.col("record").alias("s"), F.col("sid").alias("b"))
    across = pairs.select("a", "b").join(x, "a").join(y, "b").select("kind", "r", "s")
    within = x.join(y, F.col("a") == F.col("b")).where("r < s").select("kind", "r", "s")
    both = across.unionByName(within).where("r <> s")
    return both.select("kind", F.least("r", "s").alias("a"), F.greatest("r", "s").alias("b")).distinct()


def similar_between(left: DataFrame, right: DataFrame, threshold: Fraction, **options) -> DataFrame:
    """(kind, a, b): records a of `left` and b of `right` (both kind, record, items) whose sets are equal or similar."""
    tag = lambda df, side: df.select("kind", F.struct(F.lit(side).alias("side"), F.col("record").alias("id")).alias("record"), "items")
    members, pairs = similar_classes(tag(left, 0).unionByName(tag(right, 1)), threshold, **options)
    m0 = members.where("record.side = 0").select("kind", F.col("record.id").alias("a"), "sid")
    m1 = members.where("record.side = 1").select(F.col("record.id").alias("b"), F.col("sid").alias("other"))
    same = members.select(F.col("sid"), F.col("sid").alias("other")).distinct()
    links = same.unionByName(pairs.select(F.col("a").alias("sid"), F.col("b").alias("other"))).unionByName(pairs.select(F.col("b").alias("sid"), F.col("a").alias("other")))
    return links.join(m0, "sid").join(m1, "other").select("kind", "a", "b").distinct()


def candidate_sets(candidates: DataFrame) -> DataFrame:
    """(kind, record, items) of both list columns of candidates: card ids as their numbers in text, merged_from elements as they stand."""
    from linkweave.functions.ids import card_numbers

    plain = F.array_sort(F.array_distinct(F.array_compact("merged_from")))
    rows = candidates.where("candidate_id IS NOT NULL").select(F.col("candidate_id").alias("record"), card_numbers("cards").cast("array<string>").alias("cards"), F.coalesce(plain, F.array().cast("array<string>")).alias("merged_from"))
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.array_sort(k).alias("items")) for k in ("cards", "merged_from")])
    return rows.select("record", F.explode(each).alias("s")).select("s.kind", "record", "s.items")
