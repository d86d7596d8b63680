"""Sessions of an entity's events by inactivity gaps, from occupancy bitmaps."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RUN_SCHEMA = "entity bigint, span bigint, start_us bigint, end_us bigint, n bigint"


def _shift_up(x: np.ndarray, by: int) -> np.ndarray:
    """Bitmap x (64-bit words, bit 0 first) moved to higher positions; zeros come in."""
    words, bits = divmod(by, 64)
    out = np.zeros_like(x)
    src = x[: len(x) - words]
    out[words:] = src << np.uint64(bits)
    if bits:
        out[words + 1 :] |= src[:-1] >> np.uint64(64 - bits)
    return out


def _shift_down(x: np.ndarray, by: int) -> np.ndarray:
    words, bits = divmod(by, 64)
    out = np.zeros_like(x)
    src = x[words:]
    out[: len(src)] = src >> np.uint64(bits)
    if bits:
        out[: len(src) - 1] |= src[1:] << np.uint64(64 - bits)
    return out


def close_bitmap(x: np.ndarray, reach: int) -> np.ndarray:
    """Morphological closing: fill every stretch of at most `reach` zeros between ones, by doubling shifts (log2(reach) steps up, as many down)."""
    for shift, join in ((_shift_up, np.bitwise_or), (_shift_down, np.bitwise_and)):
        done = 0
        while done < reach:
            by = min(done + 1, reach - done)
            x = join(x, shift(x, by))
            done += by
    return x


def bitmap_runs(entity, span, sec, n, min_us, max_us, gap_s: int, gap_us: int):
    """Runs of the rows given, which hold whole (entity, span) groups: arrays entity, span, start_us, end_us, n.

    The time line of each group is laid out as bitmap blocks longer than the
    gap; a stretch of empty blocks shrinks to one, which the closing can't
    bridge, so a bitmap is as long as its group has occupied blocks.
    """
    size = 64 * (gap_s // 64 + 1)
    block = sec // size
    order = np.lexsort((sec, span, entity))
    entity, span, sec, block, n, min_us, max_us = (a[order] for a in (entity, span, sec, block, n, min_us, max_us))
    other = np.ones(len(sec), bool)
    other[1:] = (entity[1:] != entity[:-1]) | (span[1:] != span[:-1])
    step = np.zeros(len(sec), np.int64)
    step[1:] = np.where(other[1:], 2, np.minimum(block[1:] - block[:-1], 2))
    slot = np.cumsum(step)
    bit = slot * size + sec % size
    bits = np.zeros((slot[-1] + 2) * size, np.uint8)
    bits[bit] = 1
    closed = close_bitmap(np.packbits(bits, bitorder="little").view("<u8"), gap_s - 1) if gap_s > 1 else np.packbits(bits, bitorder="little").view("<u8")
    filled = np.unpackbits(closed.view(np.uint8), bitorder="little")
    starts = np.flatnonzero(np.diff(filled, prepend=np.uint8(0)) == 1)
    run = np.searchsorted(starts, bit, side="right") - 1
    first = np.ones(len(sec), bool)
    first[1:] = run[1:] != run[:-1]
    # seconds that look within the gap may be a fraction of a second beyond it
    first[1:] |= (sec[1:] - sec[:-1] >= gap_us // 1_000_000) & (min_us[1:] - max_us[:-1] > gap_us)
    at = np.flatnonzero(first)
    return entity[at], span[at], np.minimum.reduceat(min_us, at), np.maximum.reduceat(max_us, at), np.add.reduceat(n, at)


def _runs(gap_s: int, gap_us: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["entity", "span", "sec", "n", "min_us", "max_us"]
        held: list[np.ndarray] | None = None

        def out(cols):
            made = bitmap_runs(*cols, gap_s, gap_us)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in made], names=["entity", "span", "start_us", "end_us", "n"])

        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(b.schema.get_field_index(x)).to_numpy(zero_copy_only=False) for x in names]
            if held is not None:
                cols = [np.concatenate(p) for p in zip(held, cols)]
            last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
            cut = last[-1] + 1 if len(last) else 0  # the last group may go on in the next batch
            if cut:
                yield out([c[:cut] for c in cols])
            held = [c[cut:] for c in cols]
        if held is not None:
            yield out(held)

    return run


def sessions(events: DataFrame, entity: str, us: str, gap_us: int = 1_800_000_000, span_s: int = 86_400) -> DataFrame:
    """(entity column, start_us, end_us, duration_us, n) of each session; the next event more than gap_us after the one before starts a new one.

    `entity` and `us` are whole-number columns; rows where either is null are
    left out, equal times count as events of one session, an empty table gives
    an empty result. Events are first counted per entity and second, then laid
    out as bitmaps per (entity, span of span_s seconds), so an entity with any
    share of all events is spread over its spans and a task holds at most
    span_s seconds of one entity at a time. Runs within a gap of a span's edge
    are stitched to their neighbours; a span has at most two such runs.
    """
    if gap_us < 1_000_000:
        raise ValueError("gaps under a second need a finer resolution")
    gap_s = gap_us // 1_000_000 + (gap_us % 1_000_000 > 0)
    span_s = max(span_s, 4 * gap_s)
    sec = (F.col(us) - F.pmod(F.col(us), F.lit(1_000_000))) / 1_000_000
    counted = (
        events.where(F.col(entity).isNotNull() & F.col(us).isNotNull())
        .select(F.col(entity).alias("entity"), F.col(us).alias("us"), sec.cast("bigint").alias("sec"))
        .groupBy("entity", "sec")
        .agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("min_us"), F.max("us").alias("max_us"))
        .withColumn("span", F.floor(F.col("sec") / span_s).cast("bigint"))
    )
    laid = counted.repartition("entity", "span").sortWithinPartitions("entity", "span")
    runs = laid.select("entity", "span", "sec", "n", "min_us", "max_us").mapInArrow(_runs(gap_s, gap_us), RUN_SCHEMA)
    low, high = F.col("span") * (span_s * 1_000_000), (F.col("span") + 1) * (span_s * 1_000_000)
    edge = (F.col("start_us") - low <= gap_us) | (high - F.col("end_us") <= gap_us)
    runs = runs.withColumn("edge", edge)
    # inner runs ride along under a key of their own each, so the runs are computed once
    keyed = runs.withColumn("own", F.when(~F.col("edge"), F.col("start_us")))
    w = Window.partitionBy("entity", "own").orderBy("start_us")
    opens = F.coalesce(F.col("start_us") - F.lag("end_us").over(w) > gap_us, F.lit(True)).cast("bigint")
    joined = keyed.withColumn("opens", opens).withColumn("no", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = joined.groupBy("entity", "own", "no").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.sum("n").alias("n"))
    return whole.select(F.col("entity").alias(entity), "start_us", "end_us", (F.col("end_us") - F.col("start_us")).alias("duration_us"), "n")
