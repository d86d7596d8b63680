import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from linkweave.operators import candidates as C
from linkweave.operators import dossier, evaluation, features, graph, identity, memory, model, scoring
from linkweave.sources import files, synthetic
from linkweave.streaming import windows


def groups_of(spark, sizes):
    rows = [(a, v, f"CARD_{i:03d}", n) for a, v, k in sizes for i, n in ((i, 100 - i) for i in range(k))]
    return spark.createDataFrame(rows, "attribute string, value string, card_id string, n bigint")


def test_caps_truncate_and_keep_true_cardinality(spark):
    pairs = groups_of(spark, [("device_fingerprint", "D", 30), ("ip_address", "I", 2), ("email_hash", "alone", 1)])
    values = identity.cardinalities(pairs)
    caps = {r["attribute"]: r["cap"] for r in identity.caps(values).collect()}
    assert caps == {"device_fingerprint": 30, "ip_address": 12, "email_hash": 12}
    limits = spark.createDataFrame([("device_fingerprint", 12), ("ip_address", 12), ("email_hash", 12)], "attribute string, cap bigint")
    got = identity.capped_groups(pairs, values, limits).collect()
    device = sorted((r["no"], r["card_id"]) for r in got if r["attribute"] == "device_fingerprint")
    assert device == [(i + 1, f"CARD_{i:03d}") for i in range(12)]
    assert {r["k"] for r in got if r["attribute"] == "device_fingerprint"} == {30}
    assert len([r for r in got if r["attribute"] == "ip_address"]) == 2 and not [r for r in got if r["value"] == "alone"]


def test_edge_weights_fall_with_cardinality(spark):
    rows = [("device_fingerprint", f"d{k}", c, k) for k in (2, 8, 1492) for c in ("A", "B")] + [("ip_address", "i4", c, 4) for c in ("A", "B")] + [("device_fingerprint", "d4", c, 4) for c in ("A", "B")]
    w = {(r["attribute"], r["value"]): r["weight"] for r in identity.edge_evidence(spark.createDataFrame(rows, "attribute string, value string, card_id string, k bigint")).collect()}
    assert w["device_fingerprint", "d2"] > 0.6 > w["device_fingerprint", "d8"] > w["device_fingerprint", "d1492"] and w["device_fingerprint", "d1492"] < 0.15
    assert w["ip_address", "i4"] == pytest.approx(0.7 * w["device_fingerprint", "d4"])


def test_null_identity_is_no_evidence(spark):
    txn = spark.createDataFrame([("A", None, "1.2.3.4", None), ("B", None, "1.2.3.4", None), (None, "D", "x", "y")], "card_id string, device_fingerprint string, ip_address string, email_hash string")
    assert sorted(map(tuple, identity.evidence(txn).collect())) == [("ip_address", "1.2.3.4", "A", 1), ("ip_address", "1.2.3.4", "B", 1)]


def test_components_of_floors(spark):
    rnd = random.Random(3)
    e = sorted({tuple(sorted(rnd.sample(range(80), 2))) for _ in range(70)})
    df = spark.createDataFrame([(f"v{a:03d}", f"v{b:03d}", rnd.random()) for a, b in e], "card_a string, card_b string, weight double").cache()
    rows = [tuple(r) for r in df.collect()]
    got = {(r["floor"], r["vertex"]): r["component"] for r in graph.components(graph.at_floors(df, [0.3, 0.7]), "floor").collect()}
    want = {}
    for floor in (0.3, 0.7):
        up = {}

        def find(x):
            while up.setdefault(x, x) != x:
                x = up[x]
            return x

        for a, b, w in rows:
            if w >= floor:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
        want |= {(floor, v): find(v) for v in up}
    assert got == want


def _dedup(rows):
    order = sorted(rows, key=lambda r: (C.SOURCE_ORDER.index(r[1]), -len(r[2]), r[0]))
    kept, into = [], {}
    for cid, _, cards in order:
        rival = next((k for k, c in kept if len(set(c) & set(cards)) / len(set(c) | set(cards)) > 0.5), None)
        if rival is None:
            kept.append((cid, cards))
        else:
            into[cid] = rival
    return {c for c, _ in kept}, into


def test_dedup_is_the_greedy_one(spark):
    rnd = random.Random(4)
    rows = [("SMALL", "ego", [f"C{i}" for i in range(4)]), ("BIG", "ego", [f"C{i}" for i in range(6)])]
    for i in range(120):
        rows.append((f"R{i:03d}", rnd.choice(C.SOURCE_ORDER), sorted(rnd.sample([f"C{j}" for j in range(10, 24)], rnd.randrange(2, 7)))))
    df = spark.createDataFrame(rows, "candidate_id string, source string, cards array<string>")
    got = C.deduplicate(df).collect()
    kept, into = _dedup(rows)
    assert {r["candidate_id"] for r in got if r["kept"]} == kept
    assert {r["candidate_id"]: r["merged_into"] for r in got if not r["kept"]} == into
    assert into["SMALL"] == "BIG"


def test_worlds_labels_recall(spark):
    members = spark.createDataFrame([("X", "a"), ("X", "b"), ("X", "c"), ("Y", "z")], "candidate_id string, card_id string")
    world = spark.createDataFrame([("a", 4), ("b", 2), ("c", 4)], "card_id string, world_id int")
    assert {r[0]: (r[1], r[2]) for r in C.worlds(members, world).collect()} == {"X": (4, 2), "Y": (-1, 1)}
    ref = spark.createDataFrame([("R1", "a"), ("R1", "b"), ("R2", "c"), ("R2", "q")], "ref_id string, card_id string")
    got = {r["candidate_id"]: (r["best_ref_id"], r["best_overlap"], r["is_match"]) for r in C.labels(members.select("candidate_id").distinct(), C.best_overlap(members, ref)).collect()}
    assert got == {"X": ("R1", 1.0, 1), "Y": (None, 0.0, 0)}
    rec = {(r["ref_id"], r["source"]): r["covered"] for r in C.recall(members.withColumn("source", F.lit("ego")), ref).collect()}
    assert rec["R1", "ego"] and rec["R1", "all"] and not rec["R2", "ego"] and not rec["R1", "cc"]


def test_structure_on_known_graphs(spark):
    tri = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "e"), ("x", "y")]
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in tri], "card_a string, card_b string, weight double")
    members = spark.createDataFrame([("G", c) for c in "abcd"] + [("H", c) for c in "axy"] + [("I", "q")], "candidate_id string, card_id string")
    got = {r["candidate_id"]: r for r in graph.structure(members, edges, 10, 6).collect()}
    g = got["G"]
    assert (g["cand_size"], g["cand_num_components"], g["cand_diameter"]) == (4, 1, 2)
    assert g["cand_density"] == pytest.approx(4 / 6) and g["cand_clustering_coeff"] == pytest.approx((1 + 1 + 1 / 3) / 4)
    assert g["cand_expansion"] == pytest.approx(1 / 4) and g["cand_modularity_contribution"] == pytest.approx(4 / 6 - (9 / 12) ** 2)
    assert (got["H"]["cand_num_components"], got["H"]["cand_diameter"]) == (2, -1)
    assert (got["I"]["cand_density"], got["I"]["cand_num_components"], got["I"]["cand_diameter"]) == (0.0, 1, -1)
    assert sorted(tuple(r) for r in graph.halo(members, edges).where("candidate_id = 'G'").collect()) == [("G", "e")]


def test_communities_beat_components(spark):
    rnd = random.Random(5)
    e = []
    for k in range(4):
        e += [(f"k{k}v{a}", f"k{k}v{b}") for a, b in itertools.combinations(range(7), 2) if rnd.random() < 0.8]
    e += [("k0v0", "k1v0"), ("k2v1", "k3v1"), ("k1v2", "k2v2")]
    df = spark.createDataFrame([(min(x), max(x), 1.0) for x in e], "a string, b string, weight double").cache()
    labels = graph.communities(df, [1.0]).cache()
    assert labels.count() == 28 and labels.select("vertex").distinct().count() == 28
    whole = labels.withColumn("community", F.lit("one"))
    single = labels.withColumn("community", F.col("vertex"))
    q = [graph.modularity(df, x).first()["modularity"] for x in (labels, whole, single)]
    assert q[0] > 0.5 and q[0] > q[1] and q[0] > q[2]


def test_confusion_fixture(spark):
    pred = spark.createDataFrame(list(zip([1, 1, 0, 0, 0, 0], [0.9, 0.1, 0.8, 0.2, 0.1, 0.05])), "y int, p double")
    r = evaluation.confusion(pred, 0.5, 850_000.0, 230_000.0).first()
    assert (r["tp"], r["fn"], r["fp"], r["tn"], r["cost"]) == (1, 1, 1, 3, 1_080_000.0)
    ends = spark.createDataFrame(list(zip([1, 0, 0, 0], [0.6, 0.5, 0.4, 0.3])), "y int, p double")
    low, high = evaluation.confusion(ends, 0.0, 1.0, 1.0).first(), evaluation.confusion(ends, 1.01, 1.0, 1.0).first()
    assert (low["fn"], low["fp"], high["fp"], high["fn"]) == (0, 3, 0, 1)


def test_sweep_and_ranking(spark):
    rnd = random.Random(6)
    rows = [(0, int(rnd.random() < 0.4), round(rnd.random(), 2)) for _ in range(200)]
    pred = spark.createDataFrame(rows, "fold int, y int, p double")
    for r in evaluation.sweep(pred, 3.0, 1.0, 99).collect():
        t = 0.01 + r["step"] * 0.98 / 98
        assert r["tp"] == sum(y and p >= t - 1e-9 for _, y, p in rows) and r["fp"] == sum(not y and p >= t - 1e-9 for _, y, p in rows)
    best = evaluation.best_thresholds(evaluation.sweep(pred, 3.0, 1.0, 99)).first()
    assert best["least_cost"] == min(r["cost"] for r in evaluation.sweep(pred, 3.0, 1.0, 99).collect())
    pos, neg = [p for _, y, p in rows if y], [p for _, y, p in rows if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert evaluation.ranking(pred).first()["roc_auc"] == pytest.approx(auc)
    assert evaluation.ranking(pred.where("y = 1")).first()["roc_auc"] is None


def test_signature_and_search(spark):
    base = [5.0, 0.8, 1.0, 2.0, 5.0, 0.6, 0.3, 4200.0, 0.7, 2.0, 9.0]
    other = list(base)
    other[7] = 100.0
    odd = [float("nan"), float("inf"), None, *base[3:]]
    v = spark.createDataFrame([(0, base), (1, other), (2, odd), (3, [0.0] * 11)], "id bigint, v array<double>")
    unit = {r["id"]: r["u"] for r in v.select("id", memory.unit(memory.compressed(F.col("v"))).alias("u")).collect()}
    assert sum(x * x for x in unit[0]) == pytest.approx(1) and all(math.isfinite(x) for x in unit[2]) and unit[3] == [0.0] * 11
    assert sum(a * b for a, b in zip(unit[0], unit[1])) > 0.9
    vec = spark.createDataFrame([(i, [float(math.cos(i)), float(math.sin(i)), 0.1]) for i in range(40)], "id bigint, vector array<double>")
    got = {}
    for r in memory.nearest(vec.where("id < 5").withColumnRenamed("id", "query_id"), vec.withColumnRenamed("id", "case_id"), 0.5, 3).collect():
        got.setdefault(r["query_id"], []).append((-r["similarity"], r["case_id"]))
    rows = {r["id"]: r["vector"] for r in vec.collect()}
    norm = lambda x: math.sqrt(sum(a * a for a in x))
    for q in range(5):
        want = sorted((-round(sum(a * b for a, b in zip(rows[q], rows[c])) / norm(rows[q]) / norm(rows[c]), 9), c) for c in rows)[:3]
        assert [c for _, c in sorted(got[q])] == [c for _, c in want]
    scale = memory.scaler(v)
    assert {len(r["signature"]) for r in memory.signatures(v, "id", "v", scale).collect()} == {11}


def test_boost_damp_and_templates(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [-1.0, 0.0])], "query_id bigint, vector array<double>")
    near = lambda v: memory.nearest(q, spark.createDataFrame([(9, v)], "case_id bigint, vector array<double>"), 0.85)
    got = {r["query_id"]: (r["boost"], r["damp"]) for r in memory.adjustments(q.select("query_id"), near([1.0, 0.1]), near([0.1, 1.0])).collect()}
    assert got == {1: (0.15, 0.0), 2: (0.0, 0.2), 3: (0.0, 0.0)}
    cases = spark.createDataFrame([("fraud", f"c{i}", i, [1.0, i / 100]) for i in range(6)] + [("fraud", "far", 9, [0.0, -1.0])], "kind string, case_id string, confirmed_at bigint, vector array<double>")
    (t,) = memory.templates(cases).collect()
    assert t["n"] == 6 and t["members"] == [f"c{i}" for i in range(6)]
    assert memory.match_template(q, memory.templates(cases)).first()["query_id"] == 1


def test_latest_wins(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 5, "y")], "id string, at bigint, v string")
    new = spark.createDataFrame([("a", 2, "z"), ("b", 4, "w"), ("c", 1, None)], "id string, at bigint, v string")
    assert {r["id"]: r["v"] for r in memory.upsert(old, new, ["id"], "at").collect()} == {"a": "z", "b": "y", "c": None}


def test_composite_table(spark):
    df = spark.createDataFrame([(0.34, 0.91, 0.0, 0.0), (0.10, 0.12, 0.0, 0.0), (0.85, 0.05, 0.0, 0.0), (0.9, 0.9, 0.15, 0.2), (2.0, None, 0.0, 0.0)], "upstream double, own double, boost double, damp double")
    got = [round(r["composite"], 2) for r in scoring.scored(df).collect()]
    assert got[:3] == [0.94, 0.21, 0.86] and got[3] == round(min(0.99 * 1.15 * 0.8, 1), 2) and got[4] == 1.0


def test_uncited_claims_fail(spark):
    e = spark.createDataFrame([("A", "x", "edge:1", 1), ("A", "y", "txn:2", 1)], "candidate_id string, claim string, citation_id string, supports int")
    q = dossier.quality(dossier.reject_uncited(e)).first()
    assert (q["uncited"], q["refs_per_claim"]) == (0, 2.0)
    with pytest.raises(Exception, match="claim without citation"):
        dossier.reject_uncited(e.withColumn("citation_id", F.lit("  "))).collect()


def test_features_of_edge_cases(spark):
    txn = spark.createDataFrame([("t1", "a", "m1", 5.0, "D", "1.1.1.1", None, 0.1, 100), ("t2", "b", "m1", 20000.0, "D", "1.1.2.1", None, 0.2, 3700), ("t3", "c", None, None, None, None, None, None, None)], "transaction_id string, card_id string, merchant_id string, amount double, device_fingerprint string, ip_address string, email_hash string, vulcan_score double, ts bigint").withColumn("timestamp", F.timestamp_seconds("ts"))
    members = spark.createDataFrame([("X", "a"), ("X", "b"), ("Y", "c"), ("Z", "nobody")], "candidate_id string, card_id string")
    small = spark.createDataFrame([("m1", True)], "merchant_id string, small boolean")
    edges = spark.createDataFrame([("a", "b", 0.5)], "card_a string, card_b string, weight double")
    got = {r["candidate_id"]: r for r in features.features(members, txn, small, edges, 3, 1).collect()}
    x = got["X"]
    assert (x["cand_size"], x["max_device_reuse"], x["probe_fraction"], x["cashout_fraction"], x["probe_to_cashout_gap_hours"], x["time_span_hours"]) == (2, 2, 0.5, 0.5, 1.0, 1.0)
    assert x["amount_escalation"] == 4000 and x["small_merchant_concentration"] == 1.0 and x["amount_entropy"] == pytest.approx(1.0)
    assert got["Y"]["probe_to_cashout_gap_hours"] == -1.0 and got["Y"]["amount_escalation"] == 1.0
    assert all(got["Z"][c] == 0.0 for c in got["Z"].asDict() if c != "candidate_id")
    assert len(got["X"]) == 32


def test_universe_and_pipeline_recall(spark):
    u = synthetic.universe(spark, cards=200, merchants=30, txns=4000, rings=12)
    txn = u["transactions"].withColumn("ts", F.unix_seconds("timestamp")).cache()
    roles = {r["txn_role"]: r for r in synthetic.verify(txn).collect()}
    assert roles["probe"]["share_probe"] == 1.0 and roles["cashout"]["share_cashout"] == 1.0 and roles["legit"]["n"] == 4000 - 240
    pairs = identity.evidence(txn).cache()
    values = identity.cardinalities(pairs)
    ego = C.within_sizes(C.ego_sets(identity.capped_groups(pairs, values, identity.caps(values))))
    members = ego.select("candidate_id", "source", F.explode("cards").alias("card_id"))
    rings = files.ring_cards(u["rings"]).select(F.col("ring_id").alias("ref_id"), "card_id")
    found = C.recall(members, rings).where("source = 'ego'").agg(F.avg(F.col("covered").cast("int"))).first()[0]
    assert found >= 0.9


def test_files_round_trip(spark, tmp_path):
    u = synthetic.universe(spark, cards=40, merchants=10, txns=300, rings=4)
    files.write_csv(u["transactions"].withColumn("ring_id", F.nullif("ring_id", F.lit(""))), f"{tmp_path}/t")
    back = files.read_csv(spark, f"{tmp_path}/t", "transactions")
    assert back.count() == u["transactions"].count() and back.where("ring_id IS NULL").count() == 0
    c = spark.createDataFrame([("A", ["x", "y"], "ego", "d", 1, 2, [])], files.SCHEMAS["candidates"])
    files.write_candidates(c, f"{tmp_path}/c")
    assert files.read_candidates(spark, f"{tmp_path}/c").collect() == c.collect()
    files.write_metrics(spark, {"auc": 0.9}, f"{tmp_path}/m")
    assert files.read_metrics(spark, f"{tmp_path}/m") == {"auc": 0.9}
    files.save_graph(c.select("candidate_id"), c.select("source"), f"{tmp_path}/g")
    assert [x.count() for x in files.load_graph(spark, f"{tmp_path}/g")] == [1, 1]


def test_streams_equal_batches(spark, tmp_path):
    u = synthetic.universe(spark, cards=40, merchants=10, txns=400, rings=4, days=1)
    u["transactions"].repartition(3).write.parquet(f"{tmp_path}/in")
    stream = windows.source(spark, f"{tmp_path}/in", u["transactions"].schema)
    q = windows.rolling(stream, "card_id", "timestamp", "amount", late="2 days").writeStream.outputMode("update").format("memory").queryName("rolling").start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted((r["start"], r["card_id"], r["n"], round(r["total"], 6)) for r in df.collect())
    assert key(spark.sql("SELECT * FROM rolling")) == key(windows.rolling(u["transactions"], "card_id", "timestamp", "amount"))
    groups = spark.createDataFrame([("email_hash", "E", "CARD_A", 2)], "attribute string, value string, card_id string, k bigint")
    spark.createDataFrame([("email_hash", "E", "CARD_B"), ("email_hash", "E", "CARD_A"), ("email_hash", None, "CARD_C")], "attribute string, value string, card_id string").write.parquet(f"{tmp_path}/new")
    q = spark.readStream.schema("attribute string, value string, card_id string").parquet(f"{tmp_path}/new").writeStream.foreachBatch(windows.edge_writer(groups, f"{tmp_path}/edges")).option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert [(r["card_a"], r["card_b"]) for r in spark.read.parquet(f"{tmp_path}/edges").collect()] == [("CARD_A", "CARD_B")]
    assert windows.sessions(u["transactions"], "card_id", "timestamp").agg(F.sum("n")).first()[0] == 400


def test_model_folds_never_share_a_world(spark, tmp_path):
    rnd = random.Random(8)
    rows = [(f"C{i}", i % 3, int(x > 0.5), x, rnd.random()) for i, x in ((i, rnd.random()) for i in range(150))]
    df = spark.createDataFrame(rows, "candidate_id string, fold int, y int, a double, b double").cache()
    oof = model.cross_validate(df, ["a", "b"], trees=2, depth=2)
    assert oof.count() == 150 and evaluation.ranking(oof.withColumn("fold", F.lit(0))).first()["roc_auc"] > 0.9
    m = model.fit(df, ["a", "b"], trees=2, depth=2)
    model.save(m, f"{tmp_path}/m", ["a", "b"], 0.3)
    again, columns, threshold = model.load(spark, f"{tmp_path}/m")
    p = lambda x: [r["p"] for r in model.predict(x, df, columns).orderBy("candidate_id").collect()]
    assert threshold == 0.3 and p(m) == p(again)
    assert model.fit(df.where("y = 1"), ["a", "b"]) is None and set(p(None)) == {0.0}
    assert {r["feature"] for r in model.importance(m, ["a", "b"], spark).collect()} == {"a", "b"}


@pytest.fixture
def all_skewed(spark):
    """Every partition is taken as skewed and split."""
    conf = {f"spark.sql.adaptive.skewJoin.{k}": v for k, v in (("skewedPartitionThresholdInBytes", "1b"), ("skewedPartitionFactor", "0.01"))} | {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k in conf:
        spark.conf.unset(k)


def test_a_hub_with_most_edges(spark, all_skewed):
    edges = [(0, "z9", f"a{i:04d}") for i in range(1500)] + [(0, f"a{i:04d}", f"a{i + 1:04d}") for i in range(0, 300, 2)] + [(1, "p", "q"), (1, "q", "r")]
    got = {(r["g"], r["vertex"]): r["component"] for r in graph.components(spark.createDataFrame(edges, "g int, a string, b string")).collect()}
    assert got == {(0, "z9"): "a0000"} | {(0, f"a{i:04d}"): "a0000" for i in range(1500)} | {(1, x): "p" for x in "pqr"}


def test_overlapping_sets_with_a_common_card(spark, all_skewed):
    rnd = random.Random(12)
    sets = [(f"s{i:04d}", sorted({"hot"} | {f"c{rnd.randrange(400):03d}" for _ in range(rnd.randrange(1, 7))})) for i in range(400)]
    df = spark.createDataFrame([(i, "ego", s) for i, s in sets], "candidate_id string, source string, cards array<string>").selectExpr("*", "1 as n", "'x' as a")
    got = {(r["a"], r["b"]): r["jaccard"] for r in C.overlapping(df).collect()}
    want = {(i, j): len(set(s) & set(t)) / len(set(s) | set(t)) for (i, s), (j, t) in itertools.combinations(sets, 2)}
    assert got == {k: v for k, v in want.items() if v > 0.5} and got


def test_survivors_list_what_was_merged(spark):
    df = spark.createDataFrame([("e1", "ego", ["a", "b", "c"]), ("e2", "ego", ["a", "b", "c", "d"]), ("c1", "cc", ["a", "b", "c", "d"]), ("c2", "cc", ["x", "y"])], "candidate_id string, source string, cards array<string>")
    got = {r["candidate_id"]: r["merged_from"] for r in C.survivors(df, C.deduplicate(df)).collect()}
    assert got == {"e2": ["c1", "e1"], "c2": []}


@pytest.mark.parametrize("largest", [10_000, 0])
def test_communities_of_small_and_of_spread_components(spark, largest):
    e = [(f"C{k:02d}{a}", f"C{k:02d}{b}", 1.0) for k in range(8) for a, b in itertools.combinations(range(5), 2)] + [(f"C{k:02d}4", f"C{k + 1:02d}0", 1.0) for k in range(7)] + [("x", "y", 0.5)]
    df = spark.createDataFrame(e, "a string, b string, weight double")
    labels = {}
    for r in graph.communities(df, [1.0], largest=largest).collect():
        labels.setdefault(r["community"], set()).add(r["vertex"])
    assert sorted(map(sorted, labels.values())) == [[f"C{k:02d}{i}" for i in range(5)] for k in range(8)] + [["x", "y"]]
    assert graph.communities(df.limit(0), [1.0], largest=largest).count() == 0


def test_burst_across_stretches(spark):
    rnd = random.Random(13)
    rows = [("A", rnd.randrange(3000)) for _ in range(200)] + [("B", 299), ("B", 599), ("B", 600), ("B", None), ("C", -5), ("C", 295)]
    got = {r["candidate_id"]: (r["densest"], r["n"]) for r in features.burst(spark.createDataFrame(rows, "candidate_id string, ts bigint")).collect()}
    for k in "ABC":
        t = [x for i, x in rows if i == k and x is not None]
        assert got[k] == (max(sum(a <= b <= a + 300 for b in t) for a in t), len(t))


def test_prior_shift_and_exhibits(spark):
    pred = spark.createDataFrame([("a", 1, 0.9), ("b", 1, 0.2), ("c", 0, 0.8), ("d", 0, 0.8), ("e", 0, 0.1), ("f", 0, 0.1)], "k string, y int, p double")
    r = evaluation.prior_shift(evaluation.confusion(pred, 0.5, 100.0, 10.0), 0.1, 100.0, 10.0).first()
    assert r["rows"] == 6 and r["per_1k"] == pytest.approx(1000 * (0.9 * 0.5 * 10 + 0.1 * 0.5 * 100))
    assert [x["k"] for x in evaluation.top_false_positives(pred, "k").collect()] == ["c"]


def test_training_in_one_step(spark, tmp_path):
    rnd = random.Random(14)
    rows = [(f"k{i:03d}", i % 3, int(i % 4 == 0), rnd.random() + (i % 4 == 0), rnd.random()) for i in range(120)]
    df = spark.createDataFrame(rows, "candidate_id string, fold int, y int, good double, noise double").cache()
    t = model.train(df, ["good", "noise"], 10.0, 1.0, incidence=0.05, trees=3, depth=2)
    assert t.oof.count() == 120 and t.measures["folds"] == 3 and t.measures["positives"] == 30
    assert t.measures["average_precision"] > 0.8 and t.measures["per_1k"] >= 0 and 0 < t.threshold < 1
    fam = {r["family"]: r["total"] for r in model.importance_by_family(t.importance, {"g": ["good"], "n": ["noise"]}).collect()}
    assert fam["g"] > fam["n"] and sum(fam.values()) == pytest.approx(1)
    model.save(t.model, str(tmp_path / "m"), t.columns, t.threshold, t.scale, {"rows": 120})
    assert model.load(spark, str(tmp_path / "m"))[1:] == (["good", "noise"], t.threshold)
    assert memory.fingerprint(model.load_scaler(spark, str(tmp_path / "m"))) == memory.fingerprint(t.scale) and model.load_provenance(spark, str(tmp_path / "m")) == {"rows": 120}
    one = model.train(df.where("y = 0"), ["good"], 10.0, 1.0, trees=2, depth=2)
    assert one.model is None and one.importance is None and one.oof.agg(F.max("p")).first()[0] == 0


def test_case_memory_keeps_an_audit(spark):
    scale = spark.createDataFrame([(0, 0.5, 1.0), (1, 0.0, 2.0)], "pos int, mean double, std double")
    mark = memory.fingerprint(scale)
    kind = "case_id string, disposition string, at_us bigint, signature array<double>, scaler string"
    old = spark.createDataFrame([("a", "FRAUD", 5, [1.0, 0.0], mark)], kind)
    new = spark.createDataFrame([("a", "FALSE_POSITIVE", 3, [1.0, 0.0], mark), ("b", "FRAUD", 9, [0.0, 1.0], mark)], kind)
    cases, audit = memory.store(old, old.select("case_id", "disposition", "at_us"), new, scale)
    assert {r["case_id"]: r["disposition"] for r in cases.collect()} == {"a": "FRAUD", "b": "FRAUD"} and audit.count() == 3
    counts = {r["what"]: r["n"] for r in memory.memory_counts(cases, cases.limit(0), audit).collect()}
    assert counts == {"case:FRAUD": 2, "templates": 0, "audit": 3}
    with pytest.raises(ValueError):
        memory.store(old, audit, new.withColumn("scaler", F.lit("other")), scale)


def test_windows_per_card_and_value(spark, tmp_path):
    rows = [("c1", "d1", None, None, "2026-01-01 10:00:00", 5.0), ("c2", "d1", None, "e", "2026-01-01 10:30:00", 500.0), ("c1", None, None, None, "2026-01-01 12:00:00", None), ("c1", "d1", None, None, None, 1.0)]
    df = spark.createDataFrame(rows, "card_id string, device_fingerprint string, ip_address string, email_hash string, t string, amount double").selectExpr("card_id", "device_fingerprint", "ip_address", "email_hash", "cast(t as timestamp) as timestamp", "amount")
    v = {(r["kind"], r["id"]): r["m"] for r in windows.velocity(df).groupBy("kind", "id").agg(F.max("n").alias("m")).collect()}
    assert v == {("card_id", "c1"): 1, ("card_id", "c2"): 1, ("device_fingerprint", "d1"): 2, ("email_hash", "e"): 1}
    e = {(r["kind"], r["id"]): r["m"] for r in windows.escalation(df).groupBy("kind", "id").agg(F.max("escalation").alias("m")).collect()}
    assert e["device_fingerprint", "d1"] == 100.0 and e["card_id", "c1"] == 1.0
    df.write.parquet(str(tmp_path / "in"))
    stream = windows.velocity(windows.source(spark, str(tmp_path / "in"), df.schema))
    q = stream.writeStream.format("memory").queryName("velocity_rows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {(r["start"], r["kind"], r["id"], r["n"], r["total"]) for r in windows.velocity(df).collect()}
    assert {(r["start"], r["kind"], r["id"], r["n"], r["total"]) for r in spark.table("velocity_rows").collect()} == want


def test_uncited_claims_are_named(spark):
    e = spark.createDataFrame([("k", "one", "edge:x", 1), ("k", "two", " ", 1), ("k", "three", None, 1)], "candidate_id string, claim string, citation_id string, supports int")
    with pytest.raises(Exception, match="three, two"):
        dossier.reject_uncited(e).collect()
    good = e.where("claim = 'one'")
    assert [tuple(r) for r in dossier.by_kind(good).collect()] == [("edge", 1, 1)]
    assert tuple(dossier.corpus_quality(dossier.quality(dossier.reject_uncited(good))).first()) == (1, 1, 0, 2.0)
    text = dossier.elevation(spark.createDataFrame([("k", 0.5, 0.25, None, 0.7)], "candidate_id string, upstream double, own double, plain double, composite double")).first()["text"]
    assert text == "Upstream score 0.50, own score 0.25: together 0.00 without and 0.70 with case memory."


def test_a_merchant_without_amounts_moves_no_bin(spark):
    rows = [("K", "m1", a, 1000 * i) for i, a in enumerate([10.0, 20.0, 40.0, 80.0])] + [("K", "m2", None, 5)]
    df = spark.createDataFrame(rows, "candidate_id string, merchant_id string, amount double, ts bigint").selectExpr("*", "timestamp_seconds(ts) as timestamp", "'1.2.3.4' as ip_address")
    small = spark.createDataFrame([("m1", True)], "merchant_id string, small boolean")
    r = features.behavioural_features(df, small).first()
    assert r["amount_entropy"] == pytest.approx(features.entropy(df).first()["amount_entropy"]) == 2.0
    assert r["merchant_diversity"] == 0.4 and r["small_merchant_concentration"] == 0.8 and r["geo_spread"] == 0.2


def test_boosting_learns_a_crossed_rule_and_survives_its_text():
    import numpy as np

    from linkweave.operators.boosting import Boosted, boost

    rng = np.random.default_rng(2)
    x = np.c_[rng.random((600, 2)), np.zeros(600), rng.integers(0, 2, 600)]
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(int)
    m = boost(x[:400], y[:400], trees=40)
    assert ((m.predict(x[400:]) > 0.5) == y[400:]).mean() > 0.93 and m.importance[:2].sum() > 0.9 and m.importance[2] == 0
    again = Boosted.loads(m.dumps())
    assert (again.predict(x) == m.predict(x)).all() and boost(x, np.ones(600)) is None and len(m.predict(x[:0])) == 0


def test_universe_has_households_pools_and_whole_rings(spark):
    u = synthetic.universe(spark, cards=200, merchants=30, txns=6000, rings=12)
    cards, txn = u["cards"].cache(), u["transactions"].cache()
    homes = {r["home_ip"]: r["n"] for r in cards.groupBy("home_ip").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert set(homes.values()) == {1, 3} and sum(n == 3 for n in homes.values()) == 14
    pooled = txn.where("ip_address LIKE '172.16.%'")
    assert 0.05 < pooled.count() / 6000 < 0.15 and pooled.select("ip_address").distinct().count() == 8 and pooled.where("is_ring_txn").count() == 0
    users = txn.where("device_fingerprint = 'DEV_000000001'").select("card_id").distinct()
    assert users.count() > 50 and users.join(cards.where("NOT uses_generic_device"), "card_id").count() == 0
    d = synthetic.device_cardinality(txn).first()
    assert d["p50"] == 1.0 and d["most"] == users.count()
    rings = files.ring_cards(u["rings"]).select("ring_id", "card_id")
    assert synthetic.cross_world_rings(rings, cards).count() == 0
    assert [tuple(r) for r in synthetic.cross_world_rings(rings, cards.withColumn("world_id", F.when(F.col("card_id") == "CARD_000000000", 99).otherwise(F.col("world_id")))).collect()] == [("RING_000000000", 2)]
