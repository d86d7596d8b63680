"""How many pairs of records share an item: counted in blocks of bit masks, no pair is a row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sets of one block of the block-against-block comparison.
BLOCK = 8192


def sharing_pairs(classes: DataFrame, items: str, times: str) -> int:
    """Number of pairs of records whose item sets meet, from classes of equal sets (items, times).

    Classes are cut into blocks; each unordered pair of blocks is one task that
    multiplies their 0/1 incidence matrices. Only the number of meeting pairs
    leaves a task.
    """
    n = max(1, -(-classes.count() // BLOCK))
    rows = classes.select(F.pmod(F.xxhash64(items), F.lit(n)).alias("block"), F.col(items).alias("items"), F.col(times).alias("times"))
    all_blocks = F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))
    sent = rows.select("items", "times", "block", F.explode(all_blocks).alias("other")).select("items", "times", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), (F.col("block") <= F.col("other")).alias("left"), (F.col("block") >= F.col("other")).alias("right"))

    def count(pdf):
        import numpy as np
        import pandas as pd

        names = {v: i for i, v in enumerate(sorted({v for s in pdf["items"] for v in s}))}

        def matrix(part):
            m = np.zeros((len(part), len(names)), np.float32)
            for i, s in enumerate(part["items"]):
                m[i, [names[v] for v in s]] = 1
            return m, part["times"].to_numpy(np.int64)

        left, right = pdf[pdf["left"]], pdf[pdf["right"]]
        a, na = matrix(left)
        b, nb = matrix(right)
        met = 0
        for lo in range(0, len(a), 1024):
            hit = (a[lo : lo + 1024] @ b.T) > 0
            met += int((na[lo : lo + 1024, None] * nb[None, :] * hit).sum())
        if pdf["x"].iloc[0] == pdf["y"].iloc[0]:  # every ordered pair, and each record with itself
            met = (met - int(na.sum())) // 2
        return pd.DataFrame({"met": [met]})

    got = sent.groupBy("x", "y").applyInPandas(count, "met bigint").agg(F.sum("met").alias("met")).first()
    return int(got["met"] or 0)
