"""Gradient-boosted scoring of candidates with folds that never split a world."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.operators import evaluation
from linkweave.operators.boosting import Boosted, Rows
from linkweave.plans.durable import Scratch

#: Tasks that fit models, per task that the cluster runs at once.
SHARES = 2


def _models(rows: DataFrame, sets: list[list[str]], folds: int, trees: int, depth: int, seed: int) -> dict[tuple[int, int], Boosted]:
    """Models by (number of the set of columns, fold) of rows (__no, y, columns), each on all rows of the other folds; those that lack a class are left out.

    A task reads all rows once, sorts them once, and fits the models of its
    folds. The rows pass neither the driver nor an exchange; a worker holds
    about 16 bytes a value of them.
    """
    spark = rows.sparkSession
    columns = list(dict.fromkeys(c for x in sets for c in x))
    data = Scratch(spark).write(rows.select(F.col("__no").cast("int").alias("__no"), (F.col("y") == 1).alias("y"), *[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c) for c in columns]), "labelled")
    places = [[columns.index(c) for c in x] for x in sets]
    tasks = min(folds, SHARES * spark.sparkContext.defaultParallelism)

    def fitted(mine: range):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got: list[list[np.ndarray]] = [[] for _ in range(len(columns) + 2)]
            for batch in batches:
                for part, column in zip(got, batch.columns):
                    part.append(column.to_numpy(zero_copy_only=False).copy())
            if not got[0]:
                return
            no, y = (np.concatenate(x) for x in got[:2])
            table = Rows((np.concatenate(x) for x in got[2:]), y)
            for k in mine:
                made = table.boost(no != k, places, trees, depth, seed)
                yield pa.RecordBatch.from_pydict({"s": pa.array(range(len(made)), pa.int32()), "no": pa.array([k] * len(made), pa.int32()), "model": pa.array([m.dumps() if m else None for m in made], pa.string())})

        return run

    # one union of plans that each read all rows in one task
    parts = [data.coalesce(1).mapInArrow(fitted(range(i, folds, tasks)), "s int, no int, model string").rdd for i in range(tasks)]
    return {(r["s"], r["no"]): Boosted.loads(r["model"]) for r in spark.sparkContext.union(parts).collect() if r["model"]}


def fit(rows: DataFrame, columns: list[str], trees: int = 20, depth: int = 4, seed: int = 42) -> Boosted | None:
    """Trees on (y, columns) with positives weighted to balance; None if one class is missing."""
    return _models(rows.withColumn("__no", F.lit(-1)), [list(columns)], 1, trees, depth, seed).get((0, 0))


def _values(columns: list[str]):
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])


def predict(model: Boosted | None, rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with p; without a model p is 0."""
    if model is None:
        return rows.withColumn("p", F.lit(0.0))

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.predict(np.stack(x.to_list()))) if len(x) else pd.Series([], dtype=float)

    return rows.withColumn("p", score(_values(columns)))


def _scored(rows: DataFrame, sets: list[list[str]], fold: str, trees: int, depth: int, seed: int) -> DataFrame:
    """rows with an array p: for each set of columns the prediction of a model of the other folds, 0 where those lack a class."""
    spark = rows.sparkSession
    folds = [r[fold] for r in rows.select(fold).distinct().orderBy(fold).collect()]
    if not folds:
        return rows.withColumn("p", F.array(*[F.lit(0.0)] * len(sets)))
    named = spark.createDataFrame([(v, i) for i, v in enumerate(folds)], f"__fold {rows.schema[fold].dataType.simpleString()}, __no int")
    numbered = rows.join(F.broadcast(named), F.col(fold).eqNullSafe(F.col("__fold"))).drop("__fold")  # one row a fold
    models = _models(numbered, sets, len(folds), trees, depth, seed)
    columns = list(dict.fromkeys(c for x in sets for c in x))
    places = [[columns.index(c) for c in x] for x in sets]

    @F.pandas_udf("array<double>")
    def score(no: pd.Series, x: pd.Series) -> pd.Series:
        out = np.zeros((len(no), len(sets)))
        for k in no.unique():
            mine = (no == k).to_numpy()
            values = np.stack(x[mine].to_list())
            for s, place in enumerate(places):
                if (s, k) in models:
                    out[mine, s] = models[s, k].predict(values[:, place])
        return pd.Series(list(out))

    return numbered.withColumn("p", score("__no", _values(columns))).drop("__no")


def cross_validate(rows: DataFrame, columns: list[str], fold: str = "fold", trees: int = 20, depth: int = 4, seed: int = 42) -> DataFrame:
    """Out-of-fold predictions: each fold is scored by a model of all rows of the others; where those lack a class p is 0.

    The models, a few kilobytes each, score all rows in one pass.
    """
    scored = _scored(rows, [list(columns)], fold, trees, depth, seed)
    return Scratch(rows.sparkSession).write(scored.withColumn("p", F.col("p")[0]), "oof")


def ablation(rows: DataFrame, families: dict[str, list[str]], fold: str = "fold", trees: int = 20, depth: int = 4, seed: int = 42) -> DataFrame:
    """Out-of-fold predictions with all columns (without is "nothing") and without each family of columns, tagged by it; all are fitted in one pass and scored in another."""
    names = ["nothing", *families]
    sets = [[c for f, cs in families.items() if f != name for c in cs] for name in names]
    scored = _scored(rows.select("candidate_id", fold, "y", *sets[0]), sets, fold, trees, depth, seed)
    kept = Scratch(rows.sparkSession).write(scored.select("candidate_id", fold, "y", "p"), "oof")
    each = F.explode(F.array(*[F.struct(F.col("p")[i].alias("p"), F.lit(name).alias("without")) for i, name in enumerate(names)]))
    return kept.select("candidate_id", fold, "y", each.alias("e")).select("candidate_id", fold, "y", "e.p", "e.without")


def ablation_deltas(scores: DataFrame, families: dict[str, list[str]], fn_cost: float, fp_cost: float) -> DataFrame:
    """(without, n_features, average_precision, cost, precision_delta, cost_delta) of ablation's scores: over all folds together, at each one's cheapest threshold, against the model with all columns."""
    whole, out = sum(map(len, families.values())), None
    for name in ("nothing", *families):
        pred = scores.where(F.col("without") == name)
        cost = evaluation.best_thresholds(evaluation.sweep(pred, fn_cost, fp_cost)).select(F.lit(name).alias("without"), F.lit(whole - len(families.get(name, ()))).cast("bigint").alias("n_features"), F.col("least_cost").alias("cost"))
        part = cost.join(evaluation.ranking(pred, "without").select("without", "average_precision"), "without", "left")
        out = part if out is None else out.unionByName(part)
    base = out.where("without = 'nothing'").select(F.col("average_precision").alias("ap"), F.col("cost").alias("c"))
    return out.crossJoin(F.broadcast(base)).select("without", "n_features", "average_precision", "cost", (F.col("average_precision") - F.col("ap")).alias("precision_delta"), (F.col("cost") - F.col("c")).alias("cost_delta"))  # base is one row


def importance(model: Boosted, columns: list[str], spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, float(v)) for c, v in zip(columns, model.importance)], "feature string, importance double")


def importance_by_family(important: DataFrame, families: dict[str, list[str]]) -> DataFrame:
    """(family, features, total, mean) of importance()."""
    named = important.sparkSession.createDataFrame([(f, c) for f, cs in families.items() for c in cs], "family string, feature string")
    return important.join(F.broadcast(named), "feature").groupBy("family").agg(F.count(F.lit(1)).alias("features"), F.sum("importance").alias("total"), F.avg("importance").alias("mean"))  # one row a feature


@dataclass
class Trained:
    """What training gives: out-of-fold scores, the cheapest threshold on them with its measures, the model of all rows, its importance, and the scaler of the features."""

    oof: DataFrame
    threshold: float
    measures: dict
    model: Boosted | None
    columns: list[str]
    importance: DataFrame | None
    scale: DataFrame


def train(rows: DataFrame, columns: list[str], fn_cost: float, fp_cost: float, fold: str = "fold", incidence: float | None = None, **options) -> Trained:
    """Cross-validates with every fold left out once, picks the threshold of least cost on the out-of-fold scores, fits on all rows and measures.

    rows has (candidate_id, fold, y, columns). measures: cost, precision, recall,
    f1 and average precision at the threshold, the share of positives, folds, and
    with an `incidence` the cost per 1,000 at that share of positives. With one
    class only there is no model, and scores are 0.
    """
    from linkweave.operators import memory

    scratch = Scratch(rows.sparkSession)
    oof = scratch.write(cross_validate(rows, columns, fold, **options).select("candidate_id", fold, "y", "p"), "oof")
    best = evaluation.best_thresholds(evaluation.sweep(oof, fn_cost, fp_cost)).first()
    at = evaluation.confusion(oof, best["cost_threshold"], fn_cost, fp_cost)
    row = at.first()
    rank = evaluation.ranking(oof.withColumn("all", F.lit(0)), "all").first()
    measures = {k: row[k] for k in ("tp", "fp", "fn", "tn", "precision", "recall", "f1", "cost")} | {"threshold": best["cost_threshold"], "f1_threshold": best["f1_threshold"], "average_precision": rank and rank["average_precision"], "roc_auc": rank and rank["roc_auc"], "folds": oof.select(fold).distinct().count(), "rows": rank["n"] if rank else 0, "positives": rank["positives"] if rank else 0}
    if incidence is not None:
        measures["per_1k"] = evaluation.prior_shift(at, incidence, fn_cost, fp_cost).first()["per_1k"]
    whole = fit(rows, columns, **options)
    scale = memory.scaler(rows.select(F.array(*[F.col(c).cast("double") for c in columns]).alias("v")))
    return Trained(oof, best["cost_threshold"], measures, whole, list(columns), importance(whole, columns, rows.sparkSession) if whole else None, scale)


def save(model: Boosted, path: str, columns: list[str], threshold: float, scale: DataFrame | None = None, provenance: dict | None = None) -> None:
    """The model and, beside it, its columns, threshold and provenance, and the scaler."""
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(model.dumps(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/model")
    spark.createDataFrame([(json.dumps({"columns": list(columns), "threshold": threshold, "provenance": provenance or {}}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
    if scale is not None:
        scale.coalesce(1).write.mode("overwrite").parquet(f"{path}/scaler")  # one row a column


def load(spark: SparkSession, path: str) -> tuple[Boosted, list[str], float]:
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    return Boosted.loads(spark.read.text(f"{path}/model").first()[0]), meta["columns"], meta["threshold"]


def load_scaler(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/scaler")


def load_provenance(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/meta").first()[0])["provenance"]
