"""Per-key results when a few keys hold most records: multi-level tree aggregation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tree_merge(chunks: DataFrame, keys: list[str], merges: list[Column], n_chunks: int, fan_in: int = 8) -> DataFrame:
    """Merge per-chunk states (keys, chunk, state columns) to one state per key in ceil(log_fan_in(n_chunks)) rounds.

    `merges` are aggregates over the state columns that keep their names.
    Each round groups by (key, chunk div fan_in), so no reducer ever receives
    more than fan_in states of a key and round, however many rows the key has.
    The first round's grouping also combines each input chunk on the map side.
    """
    while True:
        n_chunks = math.ceil(n_chunks / fan_in)
        chunks = chunks.withColumn("chunk", F.expr(f"chunk div {fan_in}")).groupBy(*keys, "chunk").agg(*merges)
        if n_chunks <= 1:
            return chunks.drop("chunk")


def with_chunk(df: DataFrame) -> tuple[DataFrame, int]:
    """Number the input chunks: one per task of the stage that produces df, folded to the shuffle width."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.withColumn("chunk", F.pmod(F.spark_partition_id().cast("bigint"), F.lit(n))), n


def member_counts(rows: DataFrame, key: str, member: str, fan_in: int = 8) -> DataFrame:
    """(key, member, n) with n the number of rows; rows where either is null are left out."""
    rows, n = with_chunk(rows.where(F.col(key).isNotNull() & F.col(member).isNotNull()).select(key, member))
    return tree_merge(rows.withColumn("n", F.lit(1).cast("bigint")), [key, member], [F.sum("n").alias("n")], n, fan_in)


def top_members(rows: DataFrame, key: str, member: str, fan_in: int = 8) -> DataFrame:
    """One row per key: members (distinct), records, top (the member with most records, of equal ones the smallest), top_records.

    key and member are whole numbers. Nulls in either are left out, repeated
    rows count each, an empty table gives an empty result, other columns are
    ignored. After member_counts every (key, member) is one row, so states of
    different chunks never share a member and their counts just add up.
    """
    counts, n = with_chunk(member_counts(rows, key, member, fan_in))
    states = counts.select(key, "chunk", F.lit(1).cast("bigint").alias("members"), F.col("n").alias("records"), F.struct("n", (-F.col(member)).alias("m")).alias("best"))
    merged = tree_merge(states, [key], [F.sum("members").alias("members"), F.sum("records").alias("records"), F.max("best").alias("best")], n, fan_in)
    return merged.select(key, "members", "records", (-F.col("best.m")).alias("top"), F.col("best.n").alias("top_records"))


def value_card_counts(groups: DataFrame, fan_in: int = 8) -> DataFrame:
    """identity_groups to one row per (attribute, value): rows, named (distinct cards in the lists), cardinality (largest).

    Blank and null values are left out; a null list names no card. Lists are
    capped by their producer, yet the same value may stand in any number of
    batches, so both the list union and the maximum run through the tree.
    """
    from linkweave.functions.ids import card_numbers

    rows = groups.where(F.trim("value") != "").select("attribute", "value", card_numbers("cards").alias("cards"), F.coalesce("cardinality", F.lit(0)).cast("bigint").alias("cardinality"))
    keys = ["attribute", "value"]
    whole, n = with_chunk(rows)
    heads = tree_merge(whole.select(*keys, "chunk", F.lit(1).cast("bigint").alias("rows"), "cardinality"), keys, [F.sum("rows").alias("rows"), F.max("cardinality").alias("cardinality")], n, fan_in)
    named, n = with_chunk(rows.select(*keys, F.explode("cards").alias("card")).distinct())
    named = tree_merge(named.select(*keys, "chunk", F.lit(1).cast("bigint").alias("named")), keys, [F.sum("named").alias("named")], n, fan_in)
    return heads.join(named, keys, "left").select(*keys, "rows", F.coalesce("named", F.lit(0).cast("bigint")).alias("named"), "cardinality")
