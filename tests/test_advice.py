import itertools
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from linkweave import reference_queries as Q
from linkweave.operators import candidates as C
from linkweave.operators import dossier, graph, model, scoring
from linkweave.operators import features as X
from linkweave.streaming import windows


def test_sets_hold_communities_of_large_components(spark):
    """A chain of 20 cliques of five cards is one component of 100, which only communities can split."""
    e = [(f"C{k:02d}{a}", f"C{k:02d}{b}", 1.0) for k in range(20) for a, b in itertools.combinations(range(5), 2)]
    e += [(f"C{k:02d}4", f"C{k + 1:02d}0", 1.0) for k in range(19)]
    b = Q.Base(spark, "")
    b.made["edges"] = spark.createDataFrame(e, "card_a string, card_b string, weight double")
    b.made["groups"] = spark.createDataFrame([("email_hash", "E", "X1"), ("email_hash", "E", "X2")], "attribute string, value string, card_id string")
    sets = b.sets.collect()
    assert {r["source"] for r in sets} == {"ego", "louvain"}
    assert all(C.SIZES[0] <= len(r["cards"]) <= C.SIZES[1] for r in sets)
    assert [f"C07{i}" for i in range(5)] in [r["cards"] for r in sets]
    assert any(r["candidate_id"].startswith("louvain:") and r["kept"] for r in C.deduplicate(b.sets).collect())


def test_no_vertex_gains_after_communities(spark):
    """Rings of 40 with chords: four rounds and two levels leave vertices that would still gain by moving."""
    rnd = random.Random(11)
    e = {(i, (i + 1) % 400) for i in range(400)} | {(i, i + rnd.randrange(2, 6)) for i in range(394)} | {tuple(rnd.sample(range(400), 2)) for _ in range(30)}
    rows = sorted({(f"v{min(x):03d}", f"v{max(x):03d}", 1.0 + (sum(x) % 5) / 10) for x in e})
    df = spark.createDataFrame(rows, "a string, b string, weight double").cache()
    for g in (0.5, 2.0):
        label = {r["vertex"]: r["community"] for r in graph.communities(df, [g]).collect()}
        assert len(label) == 400
        near, k, total = defaultdict(float), defaultdict(float), defaultdict(float)
        for a, b, w in rows:
            for x, y in ((a, b), (b, a)):
                k[x] += w
                total[label[x]] += w
                near[label[x], label[y]] += w
        whole = sum(k.values())
        # no two communities gain by merging, which ends the last level
        assert all(w - g * total[x] * total[y] / whole <= 1e-6 for (x, y), w in near.items() if x != y)


def test_composite_reads_case_memory(spark):
    """Features to signatures to nearest cases to adjustments: a confirmed false positive lowers, a confirmed ring raises."""
    rows = [("A", 5.0, 0.9, 100.0), ("B", 2.0, 0.1, 3.0), ("C", 40.0, 0.0, 0.0), ("D", 9.0, 0.4, 7.0)]
    f = spark.createDataFrame(rows, "candidate_id string, x double, y double, z double")
    cases = spark.createDataFrame([("ring", True, 5.0, 0.9, 99.0), ("false", False, 40.0, 0.0, 0.0)], "case_id string, fraud boolean, x double, y double, z double")
    up = spark.createDataFrame([("A", 0.2), ("B", 0.2), ("C", 0.2)], "candidate_id string, upstream double")
    own = spark.createDataFrame([(c, 0.5) for c in "ABCD"], "candidate_id string, p double")
    got = {r["candidate_id"]: r for r in scoring.with_memory(f, ["x", "y", "z"], up, own, cases).collect()}
    assert {c: (r["boost"], r["damp"]) for c, r in got.items()} == {"A": (0.15, 0.0), "B": (0.0, 0.0), "C": (0.0, 0.2), "D": (0.0, 0.0)}
    assert got["A"]["composite"] == pytest.approx(0.6 * 1.15) and got["C"]["composite"] == pytest.approx(0.6 * 0.8)
    assert got["C"]["delta"] < 0 == got["B"]["delta"] and got["D"]["composite"] == pytest.approx(0.5)


def test_every_world_is_a_fold_and_ablation_has_a_baseline(spark, monkeypatch):
    rnd = random.Random(9)
    rows = [(f"C{i}", i % 7, int(x > 0.5), x, rnd.random()) for i, x in ((i, rnd.random()) for i in range(140))]
    df = spark.createDataFrame(rows, "candidate_id string, world_id int, y int, a double, b double")
    monkeypatch.setattr(Q, "_training", lambda s, d: df.withColumnRenamed("world_id", "fold"))
    monkeypatch.setattr(Q.X, "STRUCTURAL", ("a",))
    monkeypatch.setattr(Q.X, "IDENTITY", ("b",))
    monkeypatch.setattr(Q.X, "BEHAVIOURAL", ())
    oof = {r["candidate_id"]: r["p"] for r in Q.ref_gbt_oof(spark, "").collect()}
    assert len(oof) == 140
    for k in range(7):  # each world has the scores of a model with all defaults of the six others
        other = model.fit(df.where(F.col("world_id") != k), ["a", "b"])
        assert {r["candidate_id"]: r["p"] for r in model.predict(other, df.where(F.col("world_id") == k), ["a", "b"]).collect()}.items() <= oof.items()
    got = {r["without"]: r for r in Q.ref_ablation(spark, "").collect()}
    assert {k: r["n_features"] for k, r in got.items()} == {"nothing": 2, "structural": 1, "identity": 1, "behavioural": 2}
    assert got["nothing"]["cost_delta"] == 0 and got["structural"]["cost_delta"] > 0 > got["structural"]["precision_delta"]


def test_dossier_unites_every_kind(spark):
    """A candidate without an induced edge has claims too."""
    txn = spark.createDataFrame([(f"p{i}", "a", f"m{i % 3}", 5.0, "D", None, None, 0.1, 100 + i) for i in range(7)] + [("c1", "b", "m9", 20000.0, "D", None, None, 0.2, 3700)], "transaction_id string, card_id string, merchant_id string, amount double, device_fingerprint string, ip_address string, email_hash string, vulcan_score double, ts bigint").withColumn("timestamp", F.timestamp_seconds("ts"))
    members = spark.createDataFrame([("X", "a"), ("X", "b"), ("Y", "a")], "candidate_id string, card_id string")
    rows = X.gather(members, txn)
    meta = X.meta(rows, X.shared_values(rows))
    m = {r["candidate_id"]: r for r in meta.collect()}
    assert (m["X"]["probe_merchants"], m["X"]["cashout_merchants"], m["X"]["probe_ids"]) == ("m0,m1,m2", "m9", "p0,p1,p2,p3,p4")
    f = X.features(members, txn, spark.createDataFrame([("m0", True)], "merchant_id string, small boolean"), spark.createDataFrame([("a", "b", 0.5)], "card_a string, card_b string, weight double"), 2, 1)
    inner = spark.createDataFrame([("X", "a", "b", "device_fingerprint", "D")], "candidate_id string, card_a string, card_b string, attribute string, value string")
    near = lambda *ids: spark.createDataFrame([("X", i, 0.9) for i in ids], "query_id string, case_id string, similarity double")
    scored = spark.createDataFrame([("X", 0.2), ("Y", None)], "candidate_id string, upstream double")
    e = dossier.assemble(dossier.graph_evidence(inner), dossier.supported(dossier.behavioural_evidence(f), meta), dossier.structural_evidence(f), dossier.score_evidence(scored, meta), dossier.memory_evidence(near("r1", "r2", "r3"), near("f1")))
    got = {(r["candidate_id"], r["claim"], r["citation_id"].split("=")[0]): r["supports"] for r in e.collect()}
    assert got["X", "device_fingerprint=D", "edge:a~b:device_fingerprint"] == 0 and got["X", "composite", "vulcan:0.2000"] == 2 and got["Y", "composite", "vulcan:0.0000"] == 1
    assert got["X", "probe_fraction", "feature:probe_fraction"] == 4 and got["X", "amount_escalation", "txn:p0"] == 2 and got["X", "small_merchant_concentration", "feature:small_merchant_concentration"] == 3
    assert [k[2] for k in sorted(got) if k[1] in ("precedent", "false_positive")] == ["case:f1", "case:r1", "case:r2"]
    q = {r["candidate_id"]: r["claims"] for r in dossier.quality(e).collect()}
    assert q["Y"] >= 3 and q["X"] > q["Y"]


def test_new_cards_of_one_and_of_successive_batches_are_linked(spark, tmp_path):
    groups = spark.createDataFrame([("email_hash", "E", "A", 1)], "attribute string, value string, card_id string, k bigint")
    write = windows.edge_writer(groups, f"{tmp_path}/edges")
    batch = lambda *rows: spark.createDataFrame(rows, "attribute string, value string, card_id string")
    write(batch(("email_hash", "E", "B"), ("email_hash", "N", "C"), ("email_hash", "N", "D")), 0)
    for _ in range(2):
        write(batch(("email_hash", "N", "F"), ("email_hash", "E", "B")), 1)
    got = sorted((r["card_a"], r["card_b"], r["value"], r["k"]) for r in spark.read.parquet(f"{tmp_path}/edges").collect())
    assert got == [("A", "B", "E", 2), ("C", "D", "N", 2), ("C", "F", "N", 3), ("D", "F", "N", 3)]
