"""Case memory: feature signatures, cosine search, adjustments, templates, latest-wins tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Similarity bounds, neighbours, score adjustments, template sizes.
FRAUD_AT, FALSE_AT, NEIGHBOURS, BOOST, DAMP, TEMPLATE_LEAST = 0.85, 0.80, 3, 0.15, 0.20, 5

#: Stored vectors compared with a batch of queries at once.
BLOCK = 4096


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    n = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0)))


def compressed(v: Column) -> Column:
    """Sign times log1p of the size; null, NaN and infinite entries are 0."""
    def one(x):
        ok = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
        return F.when(ok, F.signum(x) * F.log1p(F.abs(x))).otherwise(F.lit(0.0))

    return F.transform(v, one)


def scaler(vectors: DataFrame, vector: str = "v") -> DataFrame:
    """(pos, mean, std): population mean and deviation of each compressed entry."""
    return vectors.select(F.posexplode(compressed(F.col(vector)))).groupBy("pos").agg(F.avg("col").alias("mean"), F.stddev_pop("col").alias("std"))


def signatures(vectors: DataFrame, key: str, vector: str, scale: DataFrame) -> DataFrame:
    """(key, signature): compressed, standardised (a deviation up to 1e-9 counts as 1), unit length. scale has one row per entry."""
    fixed = sorted(scale.collect(), key=lambda r: r["pos"])
    mean = F.array(*[F.lit(float(r["mean"])) for r in fixed])
    std = F.array(*[F.lit(float(r["std"]) if r["std"] > 1e-9 else 1.0) for r in fixed])
    z = F.zip_with(F.zip_with(compressed(F.col(vector)), mean, lambda x, m: x - m), std, lambda x, s: x / s)
    return vectors.select(key, unit(z).alias("signature"))


def _facing(queries: DataFrame, stored: DataFrame):
    """Both tables grouped so that every slice of the queries meets every block of BLOCK stored vectors in one task."""
    n = max(1, -(-stored.count() // BLOCK))
    slices = max(1, queries.sparkSession.sparkContext.defaultParallelism // n)
    upto = lambda k: F.sequence(F.lit(0).cast("bigint"), F.lit(k - 1).cast("bigint"))
    asked = queries.select(F.explode(upto(n)).alias("block"), F.pmod(F.xxhash64("query_id"), F.lit(slices)).alias("part"), F.col("query_id").alias("id"), "vector")
    blocks = stored.select(F.pmod(F.xxhash64("case_id"), F.lit(n)).alias("block"), F.explode(upto(slices)).alias("part"), F.col("case_id").alias("id"), "vector")
    return asked.groupBy("block", "part"), blocks.groupBy("block", "part")


def _matrix(vectors):
    """Rows of unit length; zero vectors stay."""
    import numpy as np

    m = np.array(vectors.tolist(), float)
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def similarity_histogram(queries: DataFrame, stored: DataFrame, steps: int) -> DataFrame:
    """(step, n): cosines of every query with every stored vector of another id, counted in steps of 1 / steps; counted inside the block tasks."""

    def count(key, left, right):
        import numpy as np
        import pandas as pd

        if not len(left) or not len(right):
            return pd.DataFrame({"step": [], "n": []})
        y, seen = _matrix(right["vector"]).T, {}
        ids = right["id"].to_numpy()
        for lo in range(0, len(left), BLOCK):
            part = left.iloc[lo : lo + BLOCK]
            sim = np.floor(np.round(_matrix(part["vector"]) @ y, 9) * steps).astype(np.int64)
            step, n = np.unique(sim[part["id"].to_numpy()[:, None] != ids[None, :]], return_counts=True)
            for i, c in zip(step.tolist(), n.tolist()):
                seen[i] = seen.get(i, 0) + c
        return pd.DataFrame(sorted(seen.items()), columns=["step", "n"])

    a, b = _facing(queries, stored)
    return a.cogroup(b).applyInPandas(count, "step bigint, n bigint").groupBy("step").agg(F.sum("n").alias("n"))


def similarity_summary(histogram: DataFrame, steps: int, near: float = 0.8) -> DataFrame:
    """One row (pairs, p50, p95, share_near) of a similarity_histogram: lower ends of the steps that half and 19 of 20 pairs lie in or below, and the share of pairs at `near` or above."""
    upto = histogram.withColumn("upto", F.sum("n").over(Window.orderBy("step"))).crossJoin(F.broadcast(histogram.agg(F.sum("n").alias("pairs"))))  # 2 x steps rows and one
    at = lambda q: (F.min(F.when(F.col("upto") >= q * F.col("pairs"), F.col("step"))) / steps)
    return upto.groupBy("pairs").agg(at(0.5).alias("p50"), at(0.95).alias("p95"), (F.coalesce(F.sum(F.when(F.col("step") >= round(near * steps), F.col("n"))), F.lit(0)) / F.col("pairs")).alias("share_near"))


def fingerprint(scale: DataFrame) -> str:
    """Hash of a scaler (pos, mean, std at 9 digits): signatures made with another one must not be compared."""
    row = scale.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.round("mean", 9).alias("m"), F.round("std", 9).alias("s")))), lambda x: F.concat_ws(":", x["pos"].cast("string"), x["m"].cast("string"), x["s"].cast("string"))), "|"), 256).alias("h"))
    return row.first()["h"]


def store(cases: DataFrame, audit: DataFrame, new: DataFrame, scale: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cases, audit) with the new dispositions: of a case the row decided last holds, and every new row, late ones too, is an audit row.

    cases and new have (case_id, disposition, at_us, signature, scaler), audit
    (case_id, disposition, at_us). Raises where a new row's scaler is not that of
    `scale`, whose signatures can't be compared with the stored ones.
    """
    mark = fingerprint(scale)
    other = new.where(F.coalesce("scaler", F.lit("")) != mark).limit(1).collect()
    if other:
        raise ValueError(f"case {other[0]['case_id']} was scaled otherwise")
    return upsert(cases, new, ["case_id"], "at_us"), audit.unionByName(new.select("case_id", "disposition", "at_us"))


def memory_counts(cases: DataFrame, known_templates: DataFrame, audit: DataFrame) -> DataFrame:
    """(what, n): stored cases of each disposition, templates and audit rows."""
    one = lambda df, name: df.agg(F.lit(name).alias("what"), F.count(F.lit(1)).alias("n"))
    return cases.groupBy(F.concat(F.lit("case:"), F.coalesce(F.col("disposition").cast("string"), F.lit("none"))).alias("what")).agg(F.count(F.lit(1)).alias("n")).unionByName(one(known_templates, "templates")).unionByName(one(audit, "audit"))


def page(rows: DataFrame, order: list[Column], skip: int, take: int) -> DataFrame:
    """`take` rows from place `skip` on in a total order."""
    return rows.orderBy(*order).offset(skip).limit(take)


def match_template(queries: DataFrame, known: DataFrame, at_least: float = FRAUD_AT) -> DataFrame:
    """(query_id, template_id, similarity): the nearest template centroid (template_id, centroid), if near enough."""
    near = nearest(queries, known.select(F.col("template_id").alias("case_id"), F.col("centroid").alias("vector")), at_least, 1)
    return near.withColumnRenamed("case_id", "template_id")


def nearest(queries: DataFrame, stored: DataFrame, at_least: float, k: int = NEIGHBOURS) -> DataFrame:
    """(query_id, case_id, similarity): up to k stored vectors with a cosine of at least the bound, of equal ones the smaller id.

    queries is (query_id, vector), stored (case_id, vector). Every query meets
    every stored vector, in blocks: stored vectors are cut into blocks of BLOCK
    and queries are sent to each block's task in Arrow batches, where one matrix
    product keeps the k best; the blocks' best are then merged. No pair is ever
    a row.
    """
    a, b = _facing(queries, stored)
    kind = queries.schema["query_id"].dataType.simpleString(), stored.schema["case_id"].dataType.simpleString()

    def best(key, left, right):
        import numpy as np
        import pandas as pd

        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "case_id": [], "similarity": []}, dtype=object)

        right = right.sort_values("id")
        y, rows = _matrix(right["vector"]).T, []
        for lo in range(0, len(left), BLOCK):
            part = left.iloc[lo : lo + BLOCK]
            sim = np.round(_matrix(part["vector"]) @ y, 9)
            order = np.argsort(-sim, axis=1, kind="stable")[:, :k]
            for i, row in enumerate(order):
                rows += [(part["id"].iloc[i], right["id"].iloc[j], float(sim[i, j])) for j in row if sim[i, j] >= at_least]
        return pd.DataFrame(rows, columns=["query_id", "case_id", "similarity"], dtype=object)

    got = a.cogroup(b).applyInPandas(best, f"query_id {kind[0]}, case_id {kind[1]}, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "case_id")
    return got.withColumn("no", F.row_number().over(w)).where(F.col("no") <= k).drop("no")


def adjustments(query_ids: DataFrame, fraud: DataFrame, false: DataFrame) -> DataFrame:
    """(query_id, boost, damp): constant, not cumulative, wherever a fraud or a false-positive case is near."""
    f = fraud.select("query_id").distinct().withColumn("boost", F.lit(BOOST))
    g = false.select("query_id").distinct().withColumn("damp", F.lit(DAMP))
    return query_ids.join(f, "query_id", "left").join(g, "query_id", "left").fillna(0.0, ["boost", "damp"])


def templates(cases: DataFrame, at_least: float = FRAUD_AT, least: int = TEMPLATE_LEAST) -> DataFrame:
    """(template_id, n, members, centroid) of confirmed cases (kind, case_id, confirmed_at, vector): in order of confirmation a case joins the first cluster with a member near enough, else opens one; clusters of `least` cases stay.

    The order of confirmation makes this sequential per kind; a kind is one task.
    """

    def cluster(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values(["confirmed_at", "case_id"])
        m = np.array(pdf["vector"].tolist(), float)
        size = np.linalg.norm(m, axis=1, keepdims=True)
        m = np.divide(m, size, out=np.zeros_like(m), where=size > 0)
        groups: list[list[int]] = []
        home = np.full(len(m), -1)
        for i in range(len(m)):
            near = home[:i][m[:i] @ m[i] >= at_least] if i else np.empty(0, int)
            home[i] = near.min() if len(near) else len(groups)
            if home[i] == len(groups):
                groups.append([])
            groups[home[i]].append(i)
        ids = pdf["case_id"].tolist()
        rows = []
        for g in groups:
            if len(g) >= least:
                c = m[g].mean(0)
                rows.append((f"T-{ids[g[0]]}", len(g), [str(ids[i]) for i in g], (c / (np.linalg.norm(c) or 1)).tolist()))
        return pd.DataFrame(rows, columns=["template_id", "n", "members", "centroid"], dtype=object)

    return cases.groupBy("kind").applyInPandas(cluster, "template_id string, n bigint, members array<string>, centroid array<double>")


def latest(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """One row per key: the one with the latest `at` (of equal times the largest other values). An append-only log read as an upserted table."""
    rest = [c for c in rows.columns if c not in keys and c != at]
    top = rows.groupBy(*keys).agg(F.max(F.struct(at, *rest)).alias("r"))
    return top.select(*keys, "r.*").select(*rows.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], at: str) -> DataFrame:
    return latest(old.unionByName(new), keys, at)
