import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkweave.operators import features, model
from linkweave.operators.boosting import Rows, boost
from linkweave.streaming import windows


def test_models_are_fitted_on_every_labelled_row(spark):
    """210,000 rows, three folds: each model is that of all rows of the two others, and the one of fit that of all rows."""
    n = 210_000
    x = F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000
    df = spark.range(n).select(F.col("id").cast("string").alias("candidate_id"), (F.col("id") % 3).alias("fold"), x.alias("a"), F.pmod(F.hash("id"), F.lit(7)).cast("double").alias("b"))
    df = df.withColumn("y", ((F.col("a") > 0.7) | (F.col("b") * 100_000 + F.col("candidate_id").cast("int") % 10 == 600_003)).cast("int"))
    pdf = model.cross_validate(df, ["a", "b"], trees=2, depth=2).toPandas()
    assert len(pdf) == n
    values, y = pdf[["a", "b"]].to_numpy(), pdf["y"].to_numpy()
    for k in range(3):
        mine = (pdf["fold"] == k).to_numpy()
        want = boost(values[~mine], y[~mine], trees=2, depth=2)
        assert (want.predict(values[mine]) == pdf["p"].to_numpy()[mine]).all()
    assert model.fit(df, ["a", "b"], trees=2, depth=2).dumps() == boost(values, y, trees=2, depth=2).dumps()


def test_a_model_of_a_part_is_that_of_its_rows_in_any_order():
    rng = np.random.default_rng(4)
    x = np.round(rng.random((900, 3)), 1)  # many equal rows
    x[:50] = -0.0
    y = (x[:, 0] + 0.3 * rng.random(900) > 0.6).astype(int)
    kept, order = rng.random(900) < 0.6, rng.permutation(900)
    whole, part = Rows(list(x.T), y).boost(kept, [[0, 1, 2], [2, 0]], 8, 4)
    inside = order[kept[order]]
    assert whole.dumps() == boost(x[inside], y[inside], 8, 4).dumps()
    assert part.dumps() == boost(x[inside][:, [2, 0]], y[inside], 8, 4).dumps()
    assert Rows(list(x.T), y).boost(y == 1, [[0]]) == [None] == Rows([x[:0, 0]], y[:0]).boost(y[:0] == 1, [[0]])


def test_sums_of_the_larger_node_are_those_of_all_its_rows():
    """Trees by plain sums over every node's rows, with all rows and columns used, against those by differences."""
    from linkweave.operators import boosting as B

    rng = np.random.default_rng(6)
    x, y = np.round(rng.random((400, 3)), 2), rng.random(400) < 0.3
    y |= x[:, 1] > 0.8
    share = B.ROW_SHARE, B.COLUMN_SHARE
    B.ROW_SHARE, B.COLUMN_SHARE = 1 - 2**-40, 1.0
    try:
        m = boost(x, y, trees=1, depth=3)
    finally:
        B.ROW_SHARE, B.COLUMN_SHARE = share
    w = np.where(y, (~y).sum() / y.sum(), 1.0)
    g, h = w * (0.5 - y), w * 0.25
    leaf = np.zeros(400, int)
    for _ in range(3):
        leaf = 2 * leaf + 1 + (x[np.arange(400), m.column[0][leaf]] > m.cut[0][leaf])
    gain = lambda r: g[r].sum() ** 2 / (h[r].sum() + B.PENALTY)
    for k in range(8):
        r = leaf - 7 == k
        assert m.leaf[0][k] == pytest.approx(-B.RATE * g[r].sum() / (h[r].sum() + B.PENALTY), abs=1e-9)
    rows = {0: np.ones(400, bool)}
    for v in range(7):
        r, right = rows[v], x[:, m.column[0][v]] > m.cut[0][v]
        rows[2 * v + 1], rows[2 * v + 2] = r & ~right, r & right
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, B.BINS + 1)[1:-1])) for f in range(3)]
        options = [(gain(r & (x[:, f] <= c)) + gain(r & (x[:, f] > c)) - gain(r)) for f in range(3) for c in cuts[f] if min((r & (x[:, f] <= c)).sum(), (r & (x[:, f] > c)).sum()) >= B.LEAST]
        if np.isfinite(m.cut[0][v]):
            assert gain(r & ~right) + gain(r & right) - gain(r) == pytest.approx(max(options), abs=1e-6)
        else:
            assert not options or max(options) < 1e-6


def test_ablation_has_the_scores_of_cross_validation_on_the_columns_left(spark):
    rnd = random.Random(3)
    rows = [(f"C{i}", i % 4, int(x + 0.2 * rnd.random() > 0.6), x, rnd.random(), rnd.choice([0.0, 1.0, None])) for i, x in ((i, rnd.random()) for i in range(200))]
    df = spark.createDataFrame(rows, "candidate_id string, fold int, y int, a double, b double, c double")
    families = {"one": ["a"], "two": ["b", "c"]}
    got = {(r["without"], r["candidate_id"]): r["p"] for r in model.ablation(df, families, trees=3, depth=2).collect()}
    assert len(got) == 600
    for name, columns in (("nothing", ["a", "b", "c"]), ("one", ["b", "c"]), ("two", ["a"])):
        assert {(name, r["candidate_id"]): r["p"] for r in model.cross_validate(df, columns, trees=3, depth=2).collect()}.items() <= got.items()


def test_days_are_exchanged_once_an_event(spark):
    """Sliding days equal those of a row per event and window, without one in an exchange: a crowded device, stretches' ends, times before 1970, equal times, amounts null and 0."""
    rnd = random.Random(5)
    base = 240 * 3600 * 1880
    times = [base + rnd.randrange(-40, 300) * 3600 + rnd.choice([0, 0, 1, 3599]) for _ in range(300)] + [-1, -86_400, 0, 239 * 3600, 240 * 3600, 240 * 3600 - 1]
    rows = [(f"c{rnd.randrange(9)}", "d" if rnd.random() < 0.7 else None, rnd.choice(["1", "2", None]), None, t, rnd.choice([None, 0.0, 5.0, -2.5, 0.1 * rnd.randrange(90)])) for t in times]
    df = spark.createDataFrame(rows, "card_id string, device_fingerprint string, ip_address string, email_hash string, s bigint, amount double").withColumn("timestamp", F.timestamp_micros(F.col("s") * 1_000_000 + F.pmod(F.col("s"), F.lit(3)) * 333_333))
    got, want = windows.escalation(df), windows._windowed(df, "timestamp", "amount", "24 hours", "1 hour", "1 hour")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and plan.count("Exchange hashpartitioning") + plan.count("Exchange(") <= 1
    columns = ("start", "end", "kind", "id", "n", "least", "most")
    rows_of = lambda x: sorted(map(str, map(tuple, x.select(*columns).collect())))
    assert rows_of(got) == rows_of(want) and got.count() > 3000
    assert got.dtypes == windows.escalation(df, slide="7 hours").dtypes and {(r["n"] > 0, r["escalation"] is not None) for r in got.collect()} == {(True, True)}


def test_the_slice_takes_one_exchange(spark):
    rnd = random.Random(12)
    pick = lambda *x: rnd.choice([None, *x])
    rows = [(f"K{i % 9}", f"c{rnd.randrange(3)}", i, pick("d1", "d2", "d3", f"d{i}"), pick("i1", f"i{i}"), pick(f"e{i}", "e1")) for i in range(160)] + [("alone", "c1", 900, "d1", None, None), ("alone", "c1", 901, "d1", "i1", None), ("none", "c1", 902, None, None, None)]
    df = spark.createDataFrame(rows, "candidate_id string, card_id string, ts bigint, device_fingerprint string, ip_address string, email_hash string")
    marked = features.marked_slice(df)
    assert marked._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = {r["ts"] for r in marked.where("sliced").collect()}
    assert got == {r["ts"] for r in features.shared_slice(df, features.shared_values(df)).collect()} and {900, 901, 902} < got and len(got) < marked.count() == 163
