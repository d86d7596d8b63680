"""Scores against labels: confusion and cost, threshold sweeps, ranking measures. Inputs are (y int, p double) and optional group columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confusion(pred: DataFrame, threshold: float, fn_cost: float, fp_cost: float) -> DataFrame:
    """One row: tp, fp, fn, tn at p >= threshold, rates, precision, recall, f1 (0 where undefined) and cost."""
    y, hit = F.col("y") == 1, F.col("p") >= threshold
    c = pred.agg(F.count_if(y & hit).alias("tp"), F.count_if(~y & hit).alias("fp"), F.count_if(y & ~hit).alias("fn"), F.count_if(~y & ~hit).alias("tn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select("tp", "fp", "fn", "tn", ratio(fp, fp + tn).alias("fpr"), ratio(fn, fn + tp).alias("fnr"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), (fn * fn_cost + fp * fp_cost).alias("cost"))


def prior_shift(confused: DataFrame, incidence: float, fn_cost: float, fp_cost: float) -> DataFrame:
    """One row (rows, cost, per_1k): expected cost of confusion()'s rates where a share `incidence` of what is scored is positive, whatever the share here."""
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    one = (1 - incidence) * F.col("fpr") * fp_cost + incidence * F.col("fnr") * fn_cost
    return confused.select(n.alias("rows"), (one * n).alias("cost"), (one * 1000).alias("per_1k"))


def top_false_positives(pred: DataFrame, key: str, k: int = 1) -> DataFrame:
    """The k negatives scored highest, of equal scores the smaller key first."""
    return pred.where("y = 0").orderBy(F.desc("p"), key).limit(k)


def sweep(pred: DataFrame, fn_cost: float, fp_cost: float, steps: int = 501, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """(step, threshold, tp, fp, fn, tn, cost, f1) on an even grid.

    Each row adds to the last grid step it still passes; counts at a step are
    running sums over the grid, so the predictions are aggregated once to at
    most `steps` rows instead of meeting every threshold.
    """
    width = (high - low) / (steps - 1)
    step = F.floor((F.col("p") - low) / width + 1e-9).cast("bigint")
    hist = pred.select("y", F.least(F.greatest(step, F.lit(-1).cast("bigint")), F.lit(steps - 1).cast("bigint")).alias("step")).groupBy("step").agg(F.count_if(F.expr("y = 1")).alias("pos"), F.count_if(F.expr("y <> 1")).alias("neg"))
    grid = pred.sparkSession.range(-1, steps).withColumnRenamed("id", "step")
    full = grid.join(F.broadcast(hist), "step", "left").fillna(0)  # hist has at most steps + 1 rows
    above = Window.partitionBy(F.lit(0)).orderBy(F.desc("step"))
    whole = Window.partitionBy(F.lit(0))
    c = full.select("step", F.sum("pos").over(above).alias("tp"), F.sum("neg").over(above).alias("fp"), F.sum("pos").over(whole).alias("np"), F.sum("neg").over(whole).alias("nn")).where("step >= 0")
    c = c.select("step", F.round(F.lit(low) + F.col("step") * width, 9).alias("threshold"), "tp", "fp", (F.col("np") - F.col("tp")).alias("fn"), (F.col("nn") - F.col("fp")).alias("tn"))
    return c.withColumn("cost", F.col("fn") * fn_cost + F.col("fp") * fp_cost).withColumn("f1", F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)))


def best_thresholds(swept: DataFrame) -> DataFrame:
    """One row: cheapest and best-f1 thresholds, of equal ones the lowest."""
    return swept.agg(F.min(F.struct("cost", "threshold")).alias("c"), F.max(F.struct("f1", (-F.col("threshold")).alias("t"))).alias("f")).select(F.col("c.threshold").alias("cost_threshold"), F.col("c.cost").alias("least_cost"), (-F.col("f.t")).alias("f1_threshold"), F.col("f.f1").alias("best_f1"))


def cost_sensitivity(pred: DataFrame, ratios: tuple[float, ...] = (1, 2, 3, 3.7, 5, 8, 12)) -> DataFrame:
    """(ratio, threshold, cost): cheapest threshold when a miss costs ratio times a false alarm."""
    swept = sweep(pred, 1.0, 1.0).select("threshold", "fn", "fp", F.explode(F.array(*[F.lit(float(r)) for r in ratios])).alias("ratio"))
    return swept.withColumn("cost", F.col("fn") * F.col("ratio") + F.col("fp")).groupBy("ratio").agg(F.min(F.struct("cost", "threshold")).alias("c")).select("ratio", "c.threshold", "c.cost")


def ranking(pred: DataFrame, group: str = "fold") -> DataFrame:
    """(group, n, positives, roc_auc, average_precision): rank-sum AUC with ties averaged, step-wise average precision with equal scores taken together.

    Works on the table of distinct scores per group; a null measure means that
    one class is missing.
    """
    per = pred.groupBy(group, "p").agg(F.count_if(F.expr("y = 1")).alias("pos"), F.count(F.lit(1)).alias("n"))
    up = Window.partitionBy(group).orderBy(F.desc("p"))
    c = per.withColumn("tp", F.sum("pos").over(up)).withColumn("seen", F.sum("n").over(up))
    neg = F.col("n") - F.col("pos")
    # a negative of this score loses to the positives above it and half to those beside it
    won = neg * (F.col("tp") - F.col("pos") + F.col("pos") / 2)
    s = c.groupBy(group).agg(F.sum("n").alias("n"), F.sum("pos").alias("positives"), F.sum(won).alias("won"), F.sum(F.col("pos") * F.col("tp") / F.col("seen")).alias("ap"))
    return s.select(group, "n", "positives", F.try_divide("won", F.col("positives") * (F.col("n") - F.col("positives"))).alias("roc_auc"), F.try_divide("ap", F.col("positives")).alias("average_precision"))


def latency(times: DataFrame) -> DataFrame:
    """(stage, n, p50, p95, p99, max, mean) of (stage, millis)."""
    return times.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), *[F.expr(f"percentile(millis, {q / 100}D)").alias(f"p{q}") for q in (50, 95, 99)], F.max("millis").alias("max"), F.avg("millis").alias("mean"))
