"""Candidate sets: generators, near-duplicate removal, worlds, overlap with reference sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkweave.plans.durable import Scratch

#: Order of sources in dedup, and the sizes a candidate may have.
SOURCE_ORDER = ("ego", "cc", "louvain")
SIZES = (2, 60)

#: Steps of the deduplication between two written tables.
STEPS = 2


def ego_sets(groups: DataFrame) -> DataFrame:
    """(candidate_id, source, cards): the cards of each capped identity value, read off the groups without expanding edges."""
    sets = groups.groupBy("attribute", "value").agg(F.array_sort(F.collect_set("card_id")).alias("cards"))
    return sets.select(F.concat(F.lit("ego:"), "attribute", F.lit("="), "value").alias("candidate_id"), F.lit("ego").alias("source"), "cards")


def component_sets(parts: DataFrame, largest: int = SIZES[1]) -> DataFrame:
    """(candidate_id, source, cards) of components (floor, vertex, component) of at most `largest` vertices; larger ones are counted, never gathered."""
    sizes = parts.groupBy("floor", "component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= largest)
    sets = parts.join(sizes, ["floor", "component"]).groupBy("floor", "component").agg(F.array_sort(F.collect_set("vertex")).alias("cards"))
    return sets.select(F.concat(F.lit("cc:"), F.col("floor").cast("string"), F.lit(":"), "component").alias("candidate_id"), F.lit("cc").alias("source"), "cards")


def community_sets(labels: DataFrame, largest: int = SIZES[1]) -> DataFrame:
    """(candidate_id, source, cards) of communities (resolution, vertex, community), gathered as components are."""
    as_parts = labels.select(F.col("resolution").alias("floor"), "vertex", F.col("community").alias("component"))
    sets = component_sets(as_parts, largest)
    return sets.select(F.regexp_replace("candidate_id", "^cc:", "louvain:").alias("candidate_id"), F.lit("louvain").alias("source"), "cards")


def within_sizes(candidates: DataFrame) -> DataFrame:
    return candidates.where(F.size("cards").between(*SIZES))


def overlapping(candidates: DataFrame, more_than: float = 0.5) -> DataFrame:
    """(a, b, jaccard) with a < b for pairs of candidates whose card sets overlap by more than the bound.

    Two such sets have more than that share of either in common, so they meet in
    one of the first n - floor(n x bound) cards of each in order of rarity: only
    on those, and with sizes that allow it, candidates are joined, so a card in
    very many sets pairs only those that have few rarer ones. Pairs are verified
    on the whole sets. Repeated cards count once.
    """
    sets = candidates.select("candidate_id", F.array_distinct("cards").alias("cards")).withColumn("n", F.size("cards"))
    each = sets.select("candidate_id", "n", F.explode("cards").alias("card"))
    often = each.groupBy("card").agg(F.count(F.lit(1)).alias("often"))
    w = Window.partitionBy("candidate_id").orderBy("often", "card")
    rare = each.join(often, "card").withColumn("no", F.row_number().over(w)).where(F.col("no") <= F.col("n") - F.floor(F.col("n") * more_than))
    x, y = (rare.select(F.col("candidate_id").alias(i), F.col("n").alias(f"n_{i}"), "card") for i in ("a", "b"))
    fits = (F.col("n_a") > F.col("n_b") * more_than) & (F.col("n_b") > F.col("n_a") * more_than)
    near = x.join(y, "card").where((F.col("a") < F.col("b")) & fits).select("a", "b", "n_a", "n_b").distinct()
    of = lambda i: sets.select(F.col("candidate_id").alias(i), F.col("cards").alias(f"cards_{i}"))
    common = near.join(of("a"), "a").join(of("b"), "b").withColumn("c", F.size(F.array_intersect("cards_a", "cards_b")))
    return common.withColumn("jaccard", F.col("c") / (F.col("n_a") + F.col("n_b") - F.col("c"))).where(F.col("jaccard") > more_than).select("a", "b", "jaccard")


def deduplicate(candidates: DataFrame, more_than: float = 0.5) -> DataFrame:
    """(candidate_id, kept, merged_into): greedy near-duplicate removal.

    Candidates are taken by source order, then larger first, then by id; one is
    dropped if it overlaps an already kept one by more than the bound, and is
    merged into the first such. That is the first maximal independent set in
    this order, found in rounds: keep what has no undecided or kept rival ahead
    of it, drop what has a kept rival ahead. Sets equal to an earlier one are
    dropped before pairs are formed.
    """
    scratch = Scratch(candidates.sparkSession)
    rank = F.struct(F.array_position(F.array(*map(F.lit, SOURCE_ORDER)), F.col("source")).alias("s"), (-F.size("cards")).alias("n"), "candidate_id")
    ranked = scratch.write(candidates.select("candidate_id", "source", "cards", rank.alias("rank")), "ranked")
    heads = scratch.write(ranked.groupBy("cards").agg(F.min_by("candidate_id", "rank").alias("head"), F.min("rank").alias("rank")), "heads")
    order = heads.select("head", "rank")
    pairs = overlapping(heads.select(F.col("head").alias("candidate_id"), "cards"), more_than)
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    ahead = both.join(order.select(F.col("head").alias("a"), F.col("rank").alias("ra")), "a").join(order.select(F.col("head").alias("b"), F.col("rank").alias("rb")), "b").where("ra < rb")
    ahead = scratch.write(ahead.select("a", "b", "ra"), "ahead")
    state = scratch.write(order.select(F.col("head").alias("b"), F.lit(None).cast("boolean").alias("kept")), "state")
    while state.where("kept IS NULL").limit(1).count():
        now = state
        for _ in range(STEPS):  # several steps of the chains of rivals a table
            rivals = ahead.join(now.select(F.col("b").alias("a"), F.col("kept").alias("rival")), "a").groupBy("b").agg(F.bool_or(F.coalesce("rival", F.lit(False))).alias("beaten"), F.bool_or(F.col("rival").isNull()).alias("open"))
            settled = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.coalesce("beaten", F.lit(False)), F.lit(False)).when(~F.coalesce("open", F.lit(False)), F.lit(True))
            now = now.join(rivals, "b", "left").select("b", settled.alias("kept"))
        after = scratch.write(now, "state")
        scratch.drop(state)
        state = after
    kept = state.where("kept").select("b")
    into = ahead.join(kept.select(F.col("b").alias("a")), "a").groupBy("b").agg(F.min_by("a", "ra").alias("first"))
    of_head = state.join(into, "b", "left").select(F.col("b").alias("head"), "kept", F.coalesce("first", "b").alias("target"))
    named = ranked.join(heads.select("cards", "head"), "cards").join(of_head, "head")
    alone = F.col("kept") & (F.col("candidate_id") == F.col("head"))
    return named.select("candidate_id", alone.alias("kept"), F.when(~alone, F.col("target")).alias("merged_into"))


def worlds(members: DataFrame, card_world: DataFrame) -> DataFrame:
    """(candidate_id, world_id, n_worlds): most frequent world of the cards, of equal ones the smallest; unknown is -1."""
    rows = members.join(card_world, "card_id", "left").select("candidate_id", F.coalesce("world_id", F.lit(-1)).alias("world_id"))
    counts = rows.groupBy("candidate_id", "world_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("candidate_id").agg((-F.max(F.struct("n", (-F.col("world_id")).alias("w")))["w"]).alias("world_id"), F.count(F.lit(1)).alias("n_worlds"))


def best_overlap(members: DataFrame, reference: DataFrame) -> DataFrame:
    """(candidate_id, ref_id, overlap): of each candidate the reference set (ref_id, card_id) with the largest share of its cards inside, of equal ones the smallest id; no common card, no row."""
    sizes = reference.groupBy("ref_id").agg(F.count(F.lit(1)).alias("size"))
    hits = members.join(reference, "card_id").groupBy("candidate_id", "ref_id").agg(F.count(F.lit(1)).alias("c")).join(sizes, "ref_id")
    w = Window.partitionBy("candidate_id").orderBy(F.desc("overlap"), "ref_id")
    return hits.withColumn("overlap", F.col("c") / F.col("size")).withColumn("no", F.row_number().over(w)).where("no = 1").select("candidate_id", "ref_id", "overlap")


def labels(candidates: DataFrame, best: DataFrame) -> DataFrame:
    """candidates with best_ref_id, best_overlap (4 digits, 0 if none) and is_match (strictly over a half)."""
    full = candidates.join(best, "candidate_id", "left")
    return full.select(*candidates.columns, F.col("ref_id").alias("best_ref_id"), F.round(F.coalesce("overlap", F.lit(0.0)), 4).alias("best_overlap"), (F.coalesce("overlap", F.lit(0.0)) > 0.5).cast("int").alias("is_match"))


def recall(members: DataFrame, reference: DataFrame) -> DataFrame:
    """(ref_id, source, covered): whether some candidate (candidate_id, source, card_id) of the source, or of all, holds over half of the reference set."""
    sizes = reference.groupBy("ref_id").agg(F.count(F.lit(1)).alias("size"))
    hits = members.join(reference, "card_id").groupBy("candidate_id", "source", "ref_id").agg(F.count(F.lit(1)).alias("c"))
    top = hits.select(F.explode(F.array("source", F.lit("all"))).alias("source"), "ref_id", "c").groupBy("source", "ref_id").agg(F.max("c").alias("c"))
    grid = sizes.select("ref_id", "size", F.explode(F.array(*map(F.lit, (*SOURCE_ORDER, "all")))).alias("source"))
    return grid.join(top, ["ref_id", "source"], "left").select("ref_id", "source", (F.coalesce("c", F.lit(0)) * 2 > F.col("size")).alias("covered"))


def measures(members: DataFrame, reference: DataFrame) -> DataFrame:
    """(candidate_id, ref_id, jaccard, covered) of every pair with a common card; pairs without one have 0 in both."""
    n = members.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("n"))
    size = reference.groupBy("ref_id").agg(F.count(F.lit(1)).alias("size"))
    hits = members.join(reference, "card_id").groupBy("candidate_id", "ref_id").agg(F.count(F.lit(1)).alias("c")).join(n, "candidate_id").join(size, "ref_id")
    return hits.select("candidate_id", "ref_id", (F.col("c") / (F.col("n") + F.col("size") - F.col("c"))).alias("jaccard"), (F.col("c") / F.col("size")).alias("covered"))


def survivors(candidates: DataFrame, deduplicated: DataFrame) -> DataFrame:
    """(candidate_id, source, cards, merged_from) of the kept candidates: merged_from lists, in order, those merged into each, at most the near-duplicates of one small set."""
    into = deduplicated.where("NOT kept").groupBy(F.col("merged_into").alias("candidate_id")).agg(F.array_sort(F.collect_list("candidate_id")).alias("merged_from"))
    kept = candidates.join(deduplicated.where("kept").select("candidate_id"), "candidate_id")
    return kept.join(into, "candidate_id", "left").select("candidate_id", "source", "cards", F.coalesce("merged_from", F.array().cast("array<string>")).alias("merged_from"))


def missed(covered: DataFrame) -> DataFrame:
    """ref_id of the reference sets that, by recall(), no candidate of any source covers."""
    return covered.where("source = 'all' AND NOT covered").select("ref_id")


def size_distribution(members: DataFrame) -> DataFrame:
    """(source, n_cards, n): how many candidates (candidate_id, source, card_id) of each source have so many cards."""
    sizes = members.groupBy("candidate_id", "source").agg(F.countDistinct("card_id").alias("n_cards"))
    return sizes.groupBy("source", "n_cards").agg(F.count(F.lit(1)).alias("n"))
