"""Streaming forms: rolling counts per card, latest-wins arrivals, and edges from stored groups."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from linkweave.operators.identity import ATTRIBUTES

#: Lengths of a window that a stretch of time holds.
STRETCH = 10


def source(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", per_trigger: int = 100) -> DataFrame:
    """A folder that files arrive in."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", per_trigger).load(path)


def rolling(events: DataFrame, key: str, time: str, value: str, length: str = "5 minutes", slide: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """(start, end, key, n, total, most) per sliding window; events later than `late` behind the newest are dropped, as a stream must. Works on batches as well."""
    t = events.where(F.col(key).isNotNull() & F.col(time).isNotNull()).withColumn("at", F.col(time).cast("timestamp"))
    if t.isStreaming:
        t = t.withWatermark("at", late)
    g = t.groupBy(F.window("at", length, slide).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.max(value).alias("most"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "total", "most")


def by_identity(events: DataFrame, attributes: tuple[str, ...] = ATTRIBUTES) -> DataFrame:
    """(kind, id, event columns): each event once for its card and once for each identity value it has, so that windows are kept per card and per value in one stream."""
    ids = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("id")) for k in ("card_id", *attributes)])
    return events.withColumn("e", F.explode(ids)).where("e.id IS NOT NULL").select("e.kind", "e.id", *events.columns)


def velocity(events: DataFrame, time: str = "timestamp", value: str = "amount", length: str = "1 hour", slide: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, end, kind, id, n, total) per sliding hour, card and identity value."""
    return _windowed(events, time, value, length, slide, late).drop("least", "most")


def escalation(events: DataFrame, time: str = "timestamp", value: str = "amount", length: str = "24 hours", slide: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, end, kind, id, n, least, most, escalation) per sliding day, card and identity value: largest over smallest amount, 1 without amounts or where the smallest is 0."""
    size, step = (int(pd.Timedelta(x) / pd.Timedelta("1us")) for x in (length, slide))
    w = _windowed(events, time, value, length, slide, late) if events.isStreaming or size % step else _spans(events, time, value, size, step)
    return w.select("start", "end", "kind", "id", "n", "least", "most", F.coalesce(F.col("most") / F.nullif("least", F.lit(0.0)), F.lit(1.0)).alias("escalation"))


def _windowed(events: DataFrame, time: str, value: str, length: str, slide: str, late: str) -> DataFrame:
    t = by_identity(events.where(F.col(time).isNotNull()).withColumn("at", F.col(time).cast("timestamp")))
    if t.isStreaming:
        t = t.withWatermark("at", late)
    g = t.groupBy(F.window("at", length, slide).alias("w"), "kind", "id").agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "kind", "id", "n", "total", "least", "most")


def _spans(events: DataFrame, time: str, value: str, size: int, step: int) -> DataFrame:
    """(start, end, kind, id, n, least, most) of a batch, as _windowed has them; size and step in microseconds, size a multiple of step.

    Events are exchanged once for each identity value, not once a window, and
    added up by steps of time. What a window holds changes only where a step
    with events comes into it or leaves it: counts and extremes are found at
    those starts, and each start until the next one is a row of the result, made
    after the exchange. A value is split by stretches of time, each holding the
    steps that windows starting in it reach, so a crowded one is shared by many tasks.
    """
    kinds, steps = ("card_id", *ATTRIBUTES), size // step
    stretch = STRETCH * steps
    us = F.unix_micros(F.col(time).cast("timestamp"))
    at = ((us - F.pmod(us, F.lit(step))) / step).cast("bigint")
    t = events.where(F.col(time).isNotNull()).select(at.alias("at"), F.col(value).alias("value"), *kinds)
    parts = F.array_distinct(F.array(F.floor((F.col("at") - (steps - 1)) / stretch), F.floor(F.col("at") / stretch)))
    t = t.withColumn("part", F.explode(parts.cast("array<int>")))
    ids = F.array(*[F.struct(F.lit(i).alias("kind"), F.col(k).alias("id")) for i, k in enumerate(kinds)])
    each = t.select("at", "value", "part", F.explode(ids).alias("e")).where("e.id IS NOT NULL").select("e.kind", "e.id", "part", "at", "value")
    sums = each.repartition("kind", "id", "part").groupBy("kind", "id", "part", "at").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in sums.schema if f.name in ("n", "least", "most")]
    marks = F.array(F.struct("at", "n", "least", "most"), *[F.struct((F.col("at") + i).alias("at"), *empty) for i in (1 - steps, 1)])
    keys = ("key", "kind", "id", "part")  # a number first, which sorts faster than texts that begin alike
    marked = sums.select(F.xxhash64("kind", "id", "part").alias("key"), "kind", "id", "part", F.explode(marks).alias("m")).select(*keys, "m.*")
    order = Window.partitionBy(*keys).orderBy("at")
    inside = order.rangeBetween(0, steps - 1)
    held = marked.select(*keys, "at", F.lead("at").over(order).alias("next"), F.sum("n").over(inside).alias("n"), F.min("least").over(inside).alias("least"), F.max("most").over(inside).alias("most"))
    first, last = F.greatest("at", F.col("part").cast("bigint") * stretch), F.least(F.col("next"), (F.col("part").cast("bigint") + 1) * stretch) - 1
    starts = held.where("n IS NOT NULL").where(first <= last).withColumn("at", F.explode(F.sequence(first, last)))
    name = F.element_at(F.array(*map(F.lit, kinds)), F.col("kind") + 1)
    return starts.select(F.timestamp_micros(F.col("at") * step).alias("start"), F.timestamp_micros(F.col("at") * step + size).alias("end"), name.alias("kind"), "id", "n", "least", "most")


def sessions(events: DataFrame, key: str, time: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """(start, end, key, n) with Spark's session window; end is the last event plus the gap."""
    t = events.where(F.col(key).isNotNull() & F.col(time).isNotNull()).withColumn("at", F.col(time).cast("timestamp"))
    if t.isStreaming:
        t = t.withWatermark("at", late)
    g = t.groupBy(F.session_window("at", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def edge_writer(groups: DataFrame, path: str, members: str | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: new (attribute, value, card_id) rows meet the stored groups, the rows of earlier batches and each other, and new links are appended, one folder a batch, so a repeated batch overwrites itself.

    groups may hold values of a single card. New rows are kept below `members`
    (by default beside path), also one folder a batch. k counts a value's cards
    with this batch.
    """
    kept = members or f"{path.rstrip('/')}-members"
    columns = "attribute string, value string, card string, k bigint"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(kept)
        known = groups.select("attribute", "value", F.col("card_id").alias("card"), F.col("k").cast("bigint").alias("k"))
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            earlier = spark.read.schema(f"{columns}, batch bigint").parquet(kept).where(F.col("batch") < batch_id).drop("batch")
            known = known.unionByName(earlier)
        fresh = batch.select("attribute", "value", F.col("card_id").alias("card")).where("card IS NOT NULL AND value IS NOT NULL").distinct()
        fresh = fresh.join(known, ["attribute", "value", "card"], "left_anti")
        before = known.groupBy("attribute", "value").agg(F.greatest(F.max("k"), F.countDistinct("card")).alias("had"))
        size = fresh.groupBy("attribute", "value").agg(F.count(F.lit(1)).alias("new")).join(before, ["attribute", "value"], "left")
        counted = fresh.join(size, ["attribute", "value"]).select("attribute", "value", "card", (F.col("new") + F.coalesce("had", F.lit(0))).cast("bigint").alias("k"))
        here = f"{kept}/batch={batch_id}"
        counted.write.mode("overwrite").parquet(here)
        added = spark.read.schema(columns).parquet(here)
        others = known.select("attribute", "value", F.col("card").alias("other")).unionByName(added.select("attribute", "value", F.col("card").alias("other")))
        links = added.join(others, ["attribute", "value"]).where("card <> other")
        links.select(F.least("card", "other").alias("card_a"), F.greatest("card", "other").alias("card_b"), "attribute", "value", "k").distinct().write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write
