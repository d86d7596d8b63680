"""Readers of the domain tables and the one-row-per-transaction view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkweave.functions.ids import id_number, id_text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrivals(txns: DataFrame) -> DataFrame:
    """card_txns as numbers: transaction_id, own (a number only where transaction_id is null), card, merchant, device, cents, us, received_us.

    A null transaction_id matches nothing: each such row is a transaction of
    its own. A null received_at counts as earliest. cents is the amount in
    hundredths; null, NaN and amounts beyond 9e13 give null.
    """
    usable = F.col("amount").isNotNull() & ~F.isnan("amount") & (F.abs("amount") < 9e13)
    return txns.select(
        "transaction_id",
        F.when(F.col("transaction_id").isNull(), F.monotonically_increasing_id()).alias("own"),
        id_number("card_id", "CARD").alias("card"),
        id_number("merchant_id", "MERCH").alias("merchant"),
        id_number("device_fingerprint", "DEV").alias("device"),
        F.when(usable, F.round(F.col("amount") * 100).cast("bigint")).alias("cents"),
        micros("timestamp").alias("us"),
        F.coalesce(micros("received_at"), F.lit(-(2**63))).alias("received_us"),
    )


def micros(col: str):
    """Microseconds since 1970 of a timestamp with or without zone (read as UTC)."""
    return F.unix_micros(F.col(col).cast("timestamp"))


def live(txns: DataFrame, *columns: str) -> DataFrame:
    """The chosen number columns of `arrivals`, one row per transaction: the values of its latest row.

    All buffers are fixed-width, so this is a hash aggregation with map-side
    combine; rows equal in transaction_id and received_at are copies.
    """
    latest = [F.max_by(c, "received_us").alias(c) for c in columns]
    return arrivals(txns).groupBy("transaction_id", "own").agg(*latest).select(*columns)


def transactions(txns: DataFrame) -> DataFrame:
    """All columns, one row per transaction, with canonical ids; labels dropped, blank identity values null, timestamp as unix seconds in ts.

    Rows without transaction_id stay single. Columns of the input beyond the
    documented ones are ignored.
    """
    rows = txns.select(
        "transaction_id", "card_id", "merchant_id", "amount", "timestamp", "device_fingerprint", "ip_address", "email_hash", "vulcan_score", "txn_role",
        F.when(F.col("transaction_id").isNull(), F.monotonically_increasing_id()).alias("own"),
        F.coalesce(micros("received_at"), F.lit(-(2**63))).alias("received_us"),
    )
    # the last row has none after it; a lead needs one sort where a grouped maximum of a struct needs two
    w = Window.partitionBy("transaction_id", "own").orderBy("received_us")
    latest = rows.withColumn("later", F.lead("received_us").over(w)).where("later IS NULL")
    return latest.select(
        "transaction_id",
        id_text(id_number("card_id", "CARD"), "CARD").alias("card_id"),
        id_text(id_number("merchant_id", "MERCH"), "MERCH").alias("merchant_id"),
        F.when(~F.isnan("amount"), F.col("amount")).alias("amount"),
        F.col("timestamp").cast("timestamp").alias("timestamp"),
        id_text(id_number("device_fingerprint", "DEV"), "DEV").alias("device_fingerprint"),
        F.when(F.col("ip_address").rlike("[0-9]"), F.trim("ip_address")).alias("ip_address"),
        F.when(F.col("email_hash").rlike("[0-9]"), F.upper(F.trim("email_hash"))).alias("email_hash"),
        F.when(~F.isnan("vulcan_score"), F.col("vulcan_score")).alias("vulcan_score"),
        "txn_role",
        F.unix_seconds(F.col("timestamp").cast("timestamp")).alias("ts"),
    )


#: The same view for DuckDB oracles, as a WITH member named txn.
def sql_txn() -> str:
    from linkweave.functions.ids import sql_id

    return f"""txn AS (
  SELECT transaction_id, {sql_id('card_id', 'CARD')} AS card_id, {sql_id('merchant_id', 'MERCH')} AS merchant_id,
    CASE WHEN NOT isnan(amount) THEN amount END AS amount, timestamp, {sql_id('device_fingerprint', 'DEV')} AS device_fingerprint,
    CASE WHEN regexp_matches(ip_address, '[0-9]') THEN trim(ip_address) END AS ip_address,
    CASE WHEN regexp_matches(email_hash, '[0-9]') THEN upper(trim(email_hash)) END AS email_hash,
    CASE WHEN NOT isnan(vulcan_score) THEN vulcan_score END AS vulcan_score, txn_role,
    CAST(floor(epoch_us(timestamp) / 1000000) AS BIGINT) AS ts
  FROM (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY received_at DESC) AS version_no FROM card_txns)
  WHERE version_no = 1)"""
