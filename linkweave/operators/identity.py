"""Identity evidence: who shares which value, caps on crowded values, and weighted card-card edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ATTRIBUTES = ("device_fingerprint", "ip_address", "email_hash")
#: Weight of one shared value by attribute before the rarity discount, and the least cap.
TYPE_WEIGHT = {"device_fingerprint": 1.0, "email_hash": 1.0, "ip_address": 0.7}
OTHER_WEIGHT = 0.5
LEAST_CAP = 12
SALTS = 64


def evidence(txn: DataFrame) -> DataFrame:
    """(attribute, value, card_id, n): transactions of each card with each identity value; one pass over txn, nulls are no evidence."""
    long = txn.where("card_id IS NOT NULL").select("card_id", F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).alias("value")) for a in ATTRIBUTES])).alias("e"))
    return long.where("e.value IS NOT NULL").groupBy("e.attribute", "e.value", "card_id").agg(F.count(F.lit(1)).alias("n"))


def cardinalities(pairs: DataFrame) -> DataFrame:
    """(attribute, value, k): distinct cards per value."""
    return pairs.groupBy("attribute", "value").agg(F.count(F.lit(1)).alias("k"))


def caps(values: DataFrame, percentile: float = 0.95, least: int = LEAST_CAP) -> DataFrame:
    """(attribute, cap): the rounded-up percentile of k over all values, single-card ones too, at least `least`. Runs on the histogram of k."""
    hist = values.groupBy("attribute", "k").agg(F.count(F.lit(1)).alias("f"))
    return hist.groupBy("attribute").agg(F.greatest(F.ceil(F.expr(f"percentile(k, {percentile}D, f)")), F.lit(least)).cast("bigint").alias("cap"))


def capped_groups(pairs: DataFrame, values: DataFrame, limits: DataFrame) -> DataFrame:
    """(attribute, value, card_id, n, no, k): the strongest `cap` cards of each value shared by two or more, k the true cardinality.

    Two-stage top-k: within salts of a value first (a crowded value is ranked by
    SALTS tasks), then among at most SALTS x cap survivors. `limits` has one row
    per attribute.
    """
    most = max([r["cap"] for r in limits.collect()], default=LEAST_CAP)
    order = [F.desc("n"), F.asc("card_id")]
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("card_id"), F.lit(SALTS)))
    some = salted.withColumn("no", F.row_number().over(Window.partitionBy("attribute", "value", "salt").orderBy(*order))).where(F.col("no") <= most).drop("no", "salt")
    ranked = some.withColumn("no", F.row_number().over(Window.partitionBy("attribute", "value").orderBy(*order))).where(F.col("no") <= most)
    kept = ranked.join(F.broadcast(limits), "attribute").where("no <= cap").drop("cap")
    return kept.join(values.where("k > 1"), ["attribute", "value"])


def edge_evidence(groups: DataFrame) -> DataFrame:
    """(card_a, card_b, attribute, value, k, weight) with card_a < card_b of every pair of cards of a capped value: at most cap^2 / 2 a value."""
    base = F.lit(OTHER_WEIGHT)
    for a, w in TYPE_WEIGHT.items():
        base = F.when(F.col("attribute") == a, F.lit(w)).otherwise(base)
    x = groups.select("attribute", "value", "k", F.col("card_id").alias("card_a"))
    y = groups.select("attribute", "value", F.col("card_id").alias("card_b"))
    return x.join(y, ["attribute", "value"]).where("card_a < card_b").select("card_a", "card_b", "attribute", "value", "k", (base / F.log2(F.col("k") + 1)).alias("weight"))


def edges(shared: DataFrame) -> DataFrame:
    """(card_a, card_b, weight in (0, 1], n_shared, shared_types, shared): one row per linked pair with its provenance."""
    return shared.groupBy("card_a", "card_b").agg(
        F.least(F.round(F.sum("weight"), 12), F.lit(1.0)).alias("weight"),
        F.count(F.lit(1)).alias("n_shared"),
        F.array_sort(F.collect_set("attribute")).alias("shared_types"),
        F.array_sort(F.collect_list(F.struct("attribute", "value", F.col("k").alias("cardinality")))).alias("shared"),
    )


def collision_stats(values: DataFrame, limits: DataFrame) -> DataFrame:
    """Per attribute: values, shared ones, quantiles and maximum of k, cap, values over it, memberships dropped, pairs of the most crowded value."""
    over = F.greatest(F.col("k") - F.col("cap"), F.lit(0))
    return values.join(F.broadcast(limits), "attribute").groupBy("attribute").agg(
        F.count(F.lit(1)).alias("n_values"), F.count_if(F.expr("k > 1")).alias("n_shared"),
        F.expr("percentile(k, 0.5D)").alias("p50"), F.expr("percentile(k, 0.95D)").alias("p95"), F.expr("percentile(k, 0.99D)").alias("p99"),
        F.max("k").alias("k_max"), F.max("cap").alias("cap"), F.count_if(F.col("k") > F.col("cap")).alias("n_over"), F.sum(over).alias("dropped"), F.max(F.expr("k * (k - 1) div 2")).alias("worst_pairs"),
    )
