"""File sources and sinks: CSV, JSON lines, Parquet, ORC, with declared schemas."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "transactions": "transaction_id string, card_id string, merchant_id string, amount double, timestamp timestamp, device_fingerprint string, ip_address string, email_hash string, vulcan_score double, is_ring_txn boolean, ring_id string, txn_role string, received_at timestamp",
    "cards": "card_id string, world_id int, home_device string, home_ip string, email_hash string, uses_generic_device boolean, is_ring_member boolean, ring_id string",
    "merchants": "merchant_id string, category string, avg_ticket double, is_micro_ticket boolean",
    "rings": "ring_id string, world_id int, n_cards int, card_ids string, device_pool string, ip_pool string, shared_email string, probe_merchants string, cashout_merchants string, planted_at_offset_s bigint, planted_at timestamp",
    "candidates": "candidate_id string, cards array<string>, source string, source_detail string, world_id int, size int, merged_from array<string>",
}


def read_csv(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A table of SCHEMAS from CSV with a header; a null ring_id reads as ''."""
    df = spark.read.schema(SCHEMAS[kind]).option("header", True).csv(path)
    return df.withColumn("ring_id", F.coalesce("ring_id", F.lit(""))) if kind == "transactions" else df


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMAS["candidates"]).json(path)


def write_candidates(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def ring_cards(rings: DataFrame) -> DataFrame:
    """(ring_id, world_id, card_id): the '|'-joined lists, one row per card."""
    return rings.select("ring_id", "world_id", F.explode(F.split("card_ids", r"\|")).alias("card_id")).where("card_id <> ''")


def save_graph(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    vertices.write.mode("overwrite").parquet(f"{path}/vertices")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges")


def write_metrics(spark: SparkSession, values: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(values),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_metrics(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])
