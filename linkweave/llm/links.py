"""Tables of card and candidate sets shared by the linking operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.functions.ids import card_numbers

#: identity_groups rows with more cards than this link nothing.
MAX_CARDINALITY = 12


def card_links(candidates: DataFrame, groups: DataFrame) -> DataFrame:
    """(a, b): each card number of a list linked to the list's smallest; the pairs reach exactly what all pairs of the lists would.

    Lists with fewer than two different cards link nothing. Groups count where
    value is neither null nor blank and cardinality is at most 12; a null
    cardinality links nothing.
    """
    ok = (F.trim(F.regexp_replace("value", r"[\s\p{Z}]+", " ")) != "") & (F.col("cardinality") <= MAX_CARDINALITY)
    lists = candidates.select(card_numbers("cards").alias("c")).unionByName(groups.where(ok).select(card_numbers("cards").alias("c")))
    return lists.where(F.size("c") > 1).select(F.col("c")[0].alias("a"), F.explode(F.slice("c", 2, F.size("c"))).alias("b")).distinct()


def candidate_keys(candidates: DataFrame) -> DataFrame:
    """(candidate_id, key): the cards and the known world (not null, not -1) of each candidate, and a null key, which only names it."""
    rows = candidates.where("candidate_id IS NOT NULL")
    world = F.when(F.col("world_id") >= 0, F.concat(F.lit("w"), F.col("world_id").cast("string")))
    keys = F.concat(F.transform(card_numbers("cards"), lambda c: F.concat(F.lit("c"), c.cast("string"))), F.array(world, F.lit(None).cast("string")))
    return rows.select("candidate_id", F.explode(keys).alias("key")).distinct()
