"""Composite of an upstream score and a candidate score, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkweave.operators import memory


def clamp(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def composite(upstream: Column, own: Column, boost: Column, damp: Column) -> Column:
    """Noisy-or of both scores, raised by boost, then lowered by damp, within [0, 1]."""
    base = 1 - (1 - clamp(upstream)) * (1 - clamp(own))
    return clamp(base * (1 + boost) * (1 - damp))


def confidence(upstream: Column, own: Column, boost: Column) -> Column:
    """Agreement and strength of the two scores, a little more if a precedent was found."""
    v, r = clamp(upstream), clamp(own)
    return F.least(F.lit(1.0), 0.55 * (1 - F.abs(v - r)) + 0.45 * F.greatest(v, r) + 0.05 * (boost != 0).cast("int"))


def scored(rows: DataFrame) -> DataFrame:
    """rows with (upstream, own, boost, damp) plus composite, plain (without memory), delta and confidence."""
    u, o, b, d = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("upstream", "own", "boost", "damp"))
    out = rows.withColumn("composite", composite(u, o, b, d)).withColumn("plain", composite(u, o, F.lit(0.0), F.lit(0.0)))
    return out.withColumn("delta", F.col("composite") - F.col("plain")).withColumn("confidence", confidence(u, o, b))


def with_memory(features: DataFrame, names: list[str], upstream: DataFrame, own: DataFrame, cases: DataFrame) -> DataFrame:
    """scored() of every row of features (candidate_id, names), with boost and damp looked up in the case memory.

    upstream is (candidate_id, upstream), own (candidate_id, p) such as out-of-fold
    scores, cases (case_id, fraud boolean, names): confirmed rings and confirmed
    false positives. Signatures of both are scaled by the candidates' population.
    A candidate without an upstream or own score has 0 there.
    """
    v = F.array(*[F.col(c).cast("double") for c in names])
    asked = features.select(F.col("candidate_id").alias("query_id"), v.alias("v"))
    scale = memory.scaler(asked)
    q = memory.signatures(asked, "query_id", "v", scale).withColumnRenamed("signature", "vector")
    near = lambda kind, at: memory.nearest(q, memory.signatures(cases.where(kind).select("case_id", v.alias("v")), "case_id", "v", scale).withColumnRenamed("signature", "vector"), at)
    found = memory.adjustments(q.select("query_id"), near(F.col("fraud"), memory.FRAUD_AT), near(~F.col("fraud"), memory.FALSE_AT))
    rows = found.withColumnRenamed("query_id", "candidate_id").join(upstream, "candidate_id", "left").join(own.select("candidate_id", F.col("p").alias("own")), "candidate_id", "left")
    return scored(rows)
