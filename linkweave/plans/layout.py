"""How rows are spread over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as the cluster runs tasks, for maps that cost far more than reading: an input of few files is redistributed, a large one is left as it lies."""
    want = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want)
