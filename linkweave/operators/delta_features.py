"""Per-entity feature table kept by signed insert-and-retract deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkweave.functions.ids import id_text
from linkweave.plans.durable import Scratch
from linkweave.sources.tables import arrivals

KEYS = ["card", "merchant"]


def versions(txns: DataFrame) -> DataFrame:
    """(card, merchant, cents, us, received_us, until_us): each distinct version of each transaction and when the next one replaced it (null: never).

    Copies (equal transaction_id and received_at) are one version.
    """
    w = Window.partitionBy("transaction_id", "own").orderBy("received_us")
    rows = arrivals(txns).withColumn("until_us", F.lead("received_us").over(w))
    # of copies only the last has a later neighbour (or none): the others' next has the same time
    return rows.where(F.col("until_us").isNull() | (F.col("until_us") > F.col("received_us"))).select(*KEYS, "cents", "us", "received_us", "until_us")


def deltas(versions: DataFrame, after_us: int | None = None, upto_us: int | None = None) -> DataFrame:
    """(sign, card, merchant, cents, us) of the arrivals after `after_us` and up to `upto_us`: +1 for each version that arrived, -1 for each one replaced.

    Versions without a card or a merchant belong to no feature and give no delta.
    """

    def within(c):
        ok = F.col(c).isNotNull()
        if after_us is not None:
            ok &= F.col(c) > after_us
        if upto_us is not None:
            ok &= F.col(c) <= upto_us
        return ok

    signs = F.array_compact(F.array(F.when(within("received_us"), 1), F.when(within("until_us"), -1)))
    return versions.where(F.col("card").isNotNull() & F.col("merchant").isNotNull()).select(F.explode(signs).alias("sign"), *KEYS, "cents", "us")


def live_at(versions: DataFrame, upto_us: int | None = None) -> DataFrame:
    """The versions in force after all arrivals up to `upto_us`."""
    if upto_us is None:
        return versions.where(F.col("until_us").isNull())
    return versions.where((F.col("received_us") <= upto_us) & (F.col("until_us").isNull() | (F.col("until_us") > upto_us)))


def apply_deltas(state: DataFrame | None, changes: DataFrame, live: DataFrame) -> DataFrame:
    """New feature state (card, merchant, n, cents, last_us) from the old one and signed changes.

    Counts and totals add up. The latest time is the larger of the old one and
    the inserted ones, unless a retraction reaches it: only for those keys it is
    recomputed from `live`, the versions in force after the changes. Keys whose
    count falls to 0 leave the state. A null amount adds nothing, a null time
    is passed over.
    """
    one = F.col("sign")
    step = changes.groupBy(*KEYS).agg(
        F.sum(one.cast("bigint")).alias("n"),
        F.sum(F.coalesce("cents", F.lit(0)) * one).alias("cents"),
        F.max(F.when(one > 0, F.col("us"))).alias("in_us"),
        F.max(F.when(one < 0, F.col("us"))).alias("out_us"),
    )
    if state is not None:
        old = state.select(*KEYS, "n", "cents", F.col("last_us").alias("in_us"), F.lit(None).cast("bigint").alias("out_us"))
        step = step.unionByName(old).groupBy(*KEYS).agg(F.sum("n").alias("n"), F.sum("cents").alias("cents"), F.max("in_us").alias("in_us"), F.max("out_us").alias("out_us"))
    scratch = Scratch(changes.sparkSession)
    step = scratch.write(step.where("n > 0").withColumn("hit", F.coalesce(F.col("out_us") >= F.col("in_us"), F.lit(False))), "features")
    hit = step.where("hit").select(*KEYS)
    again = live.join(hit, KEYS, "left_semi").groupBy(*KEYS).agg(F.max("us").alias("last_us"))
    calm = step.where("NOT hit").select(*KEYS, "n", "cents", F.col("in_us").alias("last_us"))
    redone = step.where("hit").select(*KEYS, "n", "cents").join(again, KEYS, "left")
    return calm.unionByName(redone)


def features(txns: DataFrame) -> DataFrame:
    """Feature state over all arrivals: the delta log of the whole table applied to an empty state."""
    scratch = Scratch(txns.sparkSession)
    log = scratch.write(versions(txns), "versions")
    return apply_deltas(None, deltas(log), live_at(log))


def per_card(state: DataFrame, as_of_us: int) -> DataFrame:
    """One row per card_id: merchants (array of merchant_id, n, cents, seconds since the latest time), sorted by merchant_id; merchants never used are absent and stand for 0, 0, null.

    The list is as long as the card has merchants, so a card with any number of
    events makes one bounded row.
    """
    entry = F.struct(id_text("merchant", "MERCH").alias("merchant_id"), "n", "cents", F.expr(f"({as_of_us} - last_us) div 1000000").alias("seconds_since"))
    return state.groupBy("card").agg(F.array_sort(F.collect_list(entry)).alias("merchants")).select(id_text("card", "CARD").alias("card_id"), "merchants")
