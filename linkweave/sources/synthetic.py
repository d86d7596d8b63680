"""A seeded synthetic universe: cards in worlds, merchants, ordinary traffic and planted rings. Distributions, not bits, follow the documented value ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _u(seed: int, *cols) -> Column:
    """Uniform in [0, 1) from a hash of the columns: the same on any partitioning."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 40)) / F.lit(float(1 << 40))


def _generic(card: Column, seed: int) -> Column:
    """Whether a card uses the generic device at times."""
    return _u(seed, F.lit(1), card) < 0.6


def _home(card: Column, first: int) -> Column:
    """The card whose address a card's household has: from `first` on the first three cards of every ten live together."""
    head = F.floor(card / 10) * 10
    return F.when((card % 10 < 3) & (head >= first), head).otherwise(card)


def _ip(card: Column) -> Column:
    return F.format_string("10.%d.%d.%d", (card / 65536).cast("int") % 256, (card / 256).cast("int") % 256, (card % 256).cast("int"))


def universe(spark: SparkSession, cards: int = 300, merchants: int = 90, txns: int = 24_000, rings: int = 25, worlds: int = 5, days: int = 30, seed: int = 42) -> dict[str, DataFrame]:
    """cards, merchants, rings and transactions as DataFrames: households share an address, a tenth of ordinary traffic comes from eight pooled addresses, and cards that use it make a third of theirs on one generic device. Every row is computed from its number, so any size is made in parallel."""
    c = F.col("id")
    in_ring = c < rings * 5
    ring = F.floor(c / 5)
    card = spark.range(cards).select(F.format_string("CARD_%09d", c).alias("card_id"), F.when(in_ring, ring % worlds).otherwise(c % worlds).cast("int").alias("world_id"), F.format_string("DEV_%09d", c + 1000).alias("home_device"), _ip(_home(c, rings * 5)).alias("home_ip"), F.format_string("EMAIL_%09d", c).alias("email_hash"), _generic(c, seed).alias("uses_generic_device"), in_ring.alias("is_ring_member"), F.when(in_ring, F.format_string("RING_%09d", ring)).otherwise("").alias("ring_id"))
    merchant = spark.range(merchants).select(F.format_string("MERCH_%05d", c).alias("merchant_id"), (c % 28 < 8).alias("is_micro_ticket"), F.round(F.when(c % 28 < 8, 5 + 40 * _u(seed, F.lit(2), c)).otherwise(60 + 2000 * _u(seed, F.lit(3), c)), 2).alias("avg_ticket"))
    ring_rows = spark.range(rings).select(F.format_string("RING_%09d", c).alias("ring_id"), (c % worlds).cast("int").alias("world_id"), F.lit(5).alias("n_cards"), F.array_join(F.transform(F.sequence(c * 5, c * 5 + 4), lambda i: F.format_string("CARD_%09d", i)), "|").alias("card_ids"), F.floor(_u(seed, F.lit(4), c) * days * 86400).cast("bigint").alias("planted_at_offset_s"))
    start = 1_767_225_600  # 2026-01-01
    who = F.floor(_u(seed, F.lit(5), c) * cards)
    legit = spark.range(txns - rings * 20).select(c, who.alias("who"), F.round(F.exp(2 + 6 * _u(seed, F.lit(6), c)), 2).alias("amount"), (F.lit(start) + F.floor(_u(seed, F.lit(7), c) * days * 86400)).alias("ts"), F.lit("legit").alias("txn_role"), F.lit("").alias("ring_id"), F.when(_generic(who, seed) & (_u(seed, F.lit(8), c) < 1 / 3), F.lit("DEV_000000001")).otherwise(F.format_string("DEV_%09d", who + 1000)).alias("device_fingerprint"), F.round(0.5 * _u(seed, F.lit(9), c), 4).alias("vulcan_score"))
    r, k = F.floor(c / 20), c % 20
    probe = k < 15
    at = F.lit(start) + F.floor(_u(seed, F.lit(4), r) * days * 86400) + F.when(probe, k * 20).otherwise(600 + (k - 15) * 400)
    planted = spark.range(rings * 20).select((c + txns).alias("id"), (r * 5 + k % 5).alias("who"), F.round(F.when(probe, 1 + 8.9 * _u(seed, F.lit(10), c)).otherwise(18_000 + 42_000 * _u(seed, F.lit(11), c)), 2).alias("amount"), at.alias("ts"), F.when(probe, "probe").otherwise("cashout").alias("txn_role"), F.format_string("RING_%09d", r).alias("ring_id"), F.format_string("DEV_%09d", 900_000 + r).alias("device_fingerprint"), F.round(F.when(probe, 0.1 + 0.2 * _u(seed, F.lit(12), c)).otherwise(0.3 + 0.2 * _u(seed, F.lit(13), c)), 4).alias("vulcan_score"))
    all_rows = legit.unionByName(planted)
    txn = all_rows.select(F.format_string("TXN_%010d", c).alias("transaction_id"), F.format_string("CARD_%09d", F.col("who").cast("bigint")).alias("card_id"), F.format_string("MERCH_%05d", F.floor(_u(seed, F.lit(14), c) * merchants)).alias("merchant_id"), "amount", F.timestamp_seconds("ts").alias("timestamp"), "device_fingerprint", F.when((F.col("ring_id") == "") & (_u(seed, F.lit(15), c) < 0.1), F.format_string("172.16.0.%d", F.floor(_u(seed, F.lit(16), c) * 8))).otherwise(_ip(_home(F.col("who"), rings * 5))).alias("ip_address"), F.format_string("EMAIL_%09d", F.col("who").cast("bigint")).alias("email_hash"), "vulcan_score", (F.col("ring_id") != "").alias("is_ring_txn"), "ring_id", "txn_role", F.timestamp_seconds(F.col("ts") + 5).alias("received_at"))
    return {"cards": card, "merchants": merchant, "rings": ring_rows, "transactions": txn}


def verify(txn: DataFrame) -> DataFrame:
    """(txn_role, n, share_probe, share_cashout, median, smallest, largest, mean_score) of each role."""
    return txn.groupBy("txn_role").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("amount") < 10).cast("int")).alias("share_probe"), F.avg((F.col("amount") > 10_000).cast("int")).alias("share_cashout"), F.expr("percentile(amount, 0.5D)").alias("median"), F.min("amount").alias("smallest"), F.max("amount").alias("largest"), F.avg("vulcan_score").alias("mean_score"))


def device_cardinality(txn: DataFrame) -> DataFrame:
    """One row (devices, p50, p95, p99, most): quantiles of the number of cards on a device."""
    per = txn.where("device_fingerprint IS NOT NULL AND card_id IS NOT NULL").select("device_fingerprint", "card_id").distinct().groupBy("device_fingerprint").agg(F.count(F.lit(1)).alias("k"))
    return per.agg(F.count(F.lit(1)).alias("devices"), *[F.expr(f"percentile(k, {q / 100}D)").alias(f"p{q}") for q in (50, 95, 99)], F.max("k").alias("most"))


def cross_world_rings(rings: DataFrame, cards: DataFrame) -> DataFrame:
    """(ring_id, worlds) of the rings (ring_id, card_id) whose cards are of more than one world; a sound universe has none."""
    return rings.join(cards.select("card_id", F.col("world_id").alias("world")), "card_id").groupBy("ring_id").agg(F.countDistinct("world").alias("worlds")).where("worlds > 1")
