"""Core queries over the project's tables and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.functions.ids import id_text
from linkweave.operators import bitmap_sessions, delta_features, tree_aggregation
from linkweave.sources.tables import live, sql_txn, table

#: 2026-07-01 00:00:00 and 2026-06-17 00:00:00 in microseconds.
AS_OF_US, RECENT_US = 1_782_864_000_000_000, 1_781_654_400_000_000


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    top = tree_aggregation.top_members(live(table(spark, d, "card_txns"), "device", "card"), "device", "card")
    return top.where("members >= 2").select(id_text("device", "DEV").alias("device_fingerprint"), id_text("top", "CARD").alias("card_id"))


def p1_devices(spark: SparkSession, d: str) -> DataFrame:
    """Every device with its cards, transactions and top card."""
    top = tree_aggregation.top_members(live(table(spark, d, "card_txns"), "device", "card"), "device", "card")
    return top.select(id_text("device", "DEV").alias("device_fingerprint"), F.col("members").alias("n_cards"), F.col("records").alias("n_txns"), id_text("top", "CARD").alias("top_card"), F.col("top_records").alias("top_txns"))


def p1_values(spark: SparkSession, d: str) -> DataFrame:
    """Every identity value with its rows, named cards and true cardinality."""
    c = tree_aggregation.value_card_counts(table(spark, d, "identity_groups"))
    return c.select("attribute", "value", F.col("rows").alias("n_rows"), F.col("named").alias("n_named"), "cardinality")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    state = delta_features.features(table(spark, d, "card_txns"))
    hit = state.where((F.col("n") >= 3) & (F.col("cents") >= 100_000) & (F.col("last_us") >= RECENT_US))
    return hit.select(id_text("card", "CARD").alias("card_id"), id_text("merchant", "MERCH").alias("merchant_id"))


def p2_features(spark: SparkSession, d: str) -> DataFrame:
    """One row per card; features lists merchant:transactions:cents:seconds since the latest, in order of merchant."""
    rows = delta_features.per_card(delta_features.features(table(spark, d, "card_txns")), AS_OF_US)
    one = lambda m: F.concat_ws(":", m["merchant_id"], m["n"].cast("string"), m["cents"].cast("string"), F.coalesce(m["seconds_since"].cast("string"), F.lit("")))
    return rows.select("card_id", F.size("merchants").cast("bigint").alias("n_merchants"), F.array_join(F.transform("merchants", one), "|").alias("features"))


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    return bitmap_sessions.sessions(live(table(spark, d, "card_txns"), "card", "us"), "card", "us")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _sessions(spark, d).where("n >= 3").select(id_text("card", "CARD").alias("card_id"), "start_us", "end_us")


def p4_sessions(spark: SparkSession, d: str) -> DataFrame:
    return _sessions(spark, d).select(id_text("card", "CARD").alias("card_id"), "start_us", "end_us", "duration_us", "n")


def queries() -> dict:
    from linkweave import reference_queries

    return reference_queries.queries() | {f.__name__: f for f in (p1_found, p1_devices, p1_values, p2_found, p2_features, p4_found, p4_sessions)}


def oracle_sql() -> dict[str, str]:
    from linkweave.functions.ids import sql_id

    txn = sql_txn()
    cents = "CAST(round(CASE WHEN abs(amount) < 9e13 THEN amount END * 100) AS BIGINT)"
    devices = f"""WITH {txn}, c AS (SELECT device_fingerprint, card_id, count(*) AS n FROM txn WHERE device_fingerprint IS NOT NULL AND card_id IS NOT NULL GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY device_fingerprint ORDER BY n DESC, card_id) AS no, count(*) OVER (PARTITION BY device_fingerprint) AS n_cards, sum(n) OVER (PARTITION BY device_fingerprint) AS n_txns FROM c)"""
    features = f"""WITH {txn}, f AS (SELECT card_id, merchant_id, count(*) AS n, CAST(sum(coalesce({cents}, 0)) AS BIGINT) AS cents, max(epoch_us(timestamp)) AS last_us FROM txn WHERE card_id IS NOT NULL AND merchant_id IS NOT NULL GROUP BY ALL)"""
    sessions = f"""WITH {txn}, e AS (SELECT card_id, epoch_us(timestamp) AS us FROM txn WHERE card_id IS NOT NULL AND timestamp IS NOT NULL),
    o AS (SELECT *, CASE WHEN us - lag(us) OVER w > 1800000000 THEN 1 ELSE 0 END AS opens FROM e WINDOW w AS (PARTITION BY card_id ORDER BY us)),
    g AS (SELECT *, sum(opens) OVER (PARTITION BY card_id ORDER BY us) AS no FROM o),
    s AS (SELECT card_id, min(us) AS start_us, max(us) AS end_us, max(us) - min(us) AS duration_us, count(*) AS n FROM g GROUP BY card_id, no)"""
    from linkweave import reference_sql

    return reference_sql.oracle_sql() | {
        "p1_found": devices + " SELECT device_fingerprint, card_id FROM r WHERE no = 1 AND n_cards >= 2",
        "p1_devices": devices + " SELECT device_fingerprint, n_cards, CAST(n_txns AS BIGINT) AS n_txns, card_id AS top_card, n AS top_txns FROM r WHERE no = 1",
        "p1_values": f"""WITH g AS (SELECT attribute, value, count(*) AS n_rows, max(coalesce(cardinality, 0)) AS cardinality FROM identity_groups WHERE trim(value) <> '' GROUP BY ALL),
    m AS (SELECT attribute, value, count(DISTINCT {sql_id('x', 'CARD')}) AS n_named FROM (SELECT attribute, value, unnest(cards) AS x FROM identity_groups WHERE trim(value) <> '') GROUP BY ALL)
    SELECT g.attribute, g.value, n_rows, coalesce(n_named, 0) AS n_named, cardinality FROM g LEFT JOIN m USING (attribute, value)""",
        "p2_found": features + f" SELECT card_id, merchant_id FROM f WHERE n >= 3 AND cents >= 100000 AND last_us >= {RECENT_US}",
        "p2_features": features + f" SELECT card_id, count(*) AS n_merchants, string_agg(concat_ws(':', merchant_id, n, cents, coalesce(CAST(({AS_OF_US} - last_us) // 1000000 AS VARCHAR), '')), '|' ORDER BY merchant_id) AS features FROM f GROUP BY card_id",
        "p4_found": sessions + " SELECT card_id, start_us, end_us FROM s WHERE n >= 3",
        "p4_sessions": sessions + " SELECT card_id, start_us, end_us, duration_us, n FROM s",
    }
