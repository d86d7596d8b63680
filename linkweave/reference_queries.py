"""Queries of the entity-link pipeline over the project's tables.

Labels (rings, is_ring_txn, ring_id) are ground truth and read by none of them;
where the pipeline compares candidates with known sets, the lists of
identity_groups of at most 12 cards stand in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.functions.ids import card_numbers, id_number, id_text
from linkweave.operators import candidates as C
from linkweave.operators import dossier as D
from linkweave.operators import evaluation as E
from linkweave.operators import features as X
from linkweave.operators import graph as G
from linkweave.operators import identity as I
from linkweave.operators import memory as M
from linkweave.operators import model, scoring
from linkweave.plans.durable import materialize
from linkweave.sources.tables import table, transactions
from linkweave.streaming import windows

FLOORS = [0.3, 0.5, 0.7, 0.9]
RESOLUTIONS = [0.5, 1.0, 1.5, 2.0, 2.5, 3.0]
FN_COST, FP_COST = 850_000.0, 230_000.0


def r6(c: str, name: str | None = None):
    return F.round(F.col(c), 6).alias(name or c.split(".")[-1])


class Base:
    """Tables of the pipeline, made once per query; what several branches read is written to the shared folder first."""

    def __init__(self, spark: SparkSession, d: str):
        self.spark, self.d, self.made = spark, d, {}

    def once(self, name: str, make, write: bool = False) -> DataFrame:
        if name not in self.made:
            self.made[name] = materialize(make(), name) if write else make()
        return self.made[name]

    @property
    def txn(self):
        return self.once("txn", lambda: transactions(table(self.spark, self.d, "card_txns")))

    @property
    def pairs(self):
        return self.once("pairs", lambda: I.evidence(self.txn), write=True)

    @property
    def values(self):
        return self.once("values", lambda: I.cardinalities(self.pairs))

    @property
    def caps(self):
        return self.once("caps", lambda: I.caps(self.values))

    @property
    def groups(self):
        return self.once("groups", lambda: I.capped_groups(self.pairs, self.values, self.caps), write=True)

    @property
    def shared(self):
        return self.once("shared", lambda: I.edge_evidence(self.groups))

    @property
    def edges(self):
        return self.once("edges", lambda: I.edges(self.shared), write=True)

    @property
    def n_edges(self):
        return self.once("n_edges", lambda: self.edges.count())

    @property
    def n_cards(self):
        return self.once("n_cards", lambda: self.txn.where("card_id IS NOT NULL").select("card_id").distinct().count())

    @property
    def members(self):
        """(candidate_id, card_id) of the candidates table, distinct."""
        rows = table(self.spark, self.d, "candidates").select("candidate_id", F.explode(card_numbers("cards")).alias("c")).distinct()
        return self.once("members", lambda: rows.select("candidate_id", id_text("c", "CARD").alias("card_id")))

    @property
    def rows(self):
        return self.once("rows", lambda: X.gather(self.members, self.txn), write=True)

    @property
    def inside(self):
        return self.once("inside", lambda: X.shared_values(self.rows))

    @property
    def small(self):
        m = table(self.spark, self.d, "merchants")
        one = m.select(id_text(id_number("merchant_id", "MERCH"), "MERCH").alias("merchant_id"), F.when(~F.isnan("avg_ticket"), F.col("avg_ticket")).alias("avg_ticket")).where("merchant_id IS NOT NULL").groupBy("merchant_id").agg(F.max("avg_ticket").alias("avg_ticket"))
        return X.small_merchants(one)

    @property
    def card_world(self):
        c = table(self.spark, self.d, "cards").select(id_text(id_number("card_id", "CARD"), "CARD").alias("card_id"), "world_id")
        return c.where("card_id IS NOT NULL").groupBy("card_id").agg(F.max("world_id").alias("world_id"))

    @property
    def reference(self):
        """(ref_id, card_id) of identity_groups of at most 12 cards."""
        g = table(self.spark, self.d, "identity_groups").where("trim(value) <> '' AND cardinality <= 12")
        return g.select(F.concat_ws("=", "attribute", "value").alias("ref_id"), F.explode(card_numbers("cards")).alias("c")).distinct().select("ref_id", id_text("c", "CARD").alias("card_id"))

    @property
    def parts(self):
        """Components at each edge-weight floor, and at 0 of all edges."""
        return self.once("parts", lambda: G.components(G.at_floors(self.edges, [0.0, *FLOORS]), "floor"))

    @property
    def sets(self):
        """Ego, component and community candidates within the size window."""
        sets = lambda: C.ego_sets(self.groups).unionByName(C.component_sets(self.parts.where("floor > 0"))).unionByName(C.community_sets(self.communities))
        return self.once("sets", lambda: C.within_sizes(sets()), write=True)

    @property
    def communities(self):
        e = self.edges.select(F.col("card_a").alias("a"), F.col("card_b").alias("b"), "weight")
        return self.once("communities", lambda: G.communities(e, RESOLUTIONS, self.parts.where("floor = 0")))

    @property
    def predictions(self):
        """(fold, y, p) made from embeddings: a fixed squashing of one entry against the parity of the label."""
        e = table(self.spark, self.d, "embeddings").where("label IS NOT NULL")
        return e.select((F.col("vec_id") % 5).alias("fold"), (F.col("label") % 2).cast("int").alias("y"), F.round(0.5 + 0.45 * F.col("embedding")[F.col("label") % 8].cast("double"), 3).alias("p"))


def ref_txn_view(spark, d):
    b = Base(spark, d)
    return b.txn.select("transaction_id", "card_id", "merchant_id", r6("amount"), "ts", "device_fingerprint", "ip_address", "email_hash", "vulcan_score", "txn_role")


def ref_pair_counts(spark, d):
    return Base(spark, d).pairs


def ref_value_cardinality(spark, d):
    return Base(spark, d).values


def ref_collision_caps(spark, d):
    return Base(spark, d).caps


def ref_collision_stats(spark, d):
    b = Base(spark, d)
    s = I.collision_stats(b.values, b.caps)
    return s.select("attribute", "n_values", "n_shared", r6("p50"), r6("p95"), r6("p99"), "k_max", "cap", "n_over", F.col("dropped").cast("bigint").alias("dropped"), F.col("worst_pairs").cast("bigint").alias("worst_pairs"))


def ref_capped_groups(spark, d):
    b = Base(spark, d)
    return b.groups.select("attribute", "value", "card_id", "n", F.col("no").cast("bigint").alias("no"), "k")


def ref_edge_weights(spark, d):
    b = Base(spark, d)
    return b.shared.select("card_a", "card_b", "attribute", "value", "k", F.round("weight", 9).alias("weight"))


def ref_identity_edges(spark, d):
    b = Base(spark, d)
    return b.edges.select("card_a", "card_b", F.round("weight", 9).alias("weight"), "n_shared", F.array_join("shared_types", ",").alias("shared_types"))


def ref_edge_provenance(spark, d):
    b = Base(spark, d)
    return b.edges.select("card_a", "card_b", F.explode("shared").alias("s")).select("card_a", "card_b", "s.attribute", "s.value", "s.cardinality")


def ref_merchant_saturation(spark, d):
    """Pairs of cards sharing a merchant, counted by blocks of cards against merchant sets."""
    b = Base(spark, d)
    used = b.txn.where("card_id IS NOT NULL AND merchant_id IS NOT NULL").select("card_id", "merchant_id").distinct()
    n = used.select("card_id").distinct().count()
    sets = used.groupBy("card_id").agg(F.sort_array(F.collect_list("merchant_id")).alias("m"))
    # cards with equal merchant sets are one class: pairs are counted between classes, weighted
    classes = sets.groupBy("m").agg(F.count(F.lit(1)).alias("c"))
    from linkweave.operators.saturation import sharing_pairs

    total = sharing_pairs(classes, "m", "c")
    return b.edges.agg(F.count(F.lit(1)).alias("identity_pairs")).select(F.lit(n * (n - 1) // 2).cast("bigint").alias("possible_pairs"), F.lit(total).cast("bigint").alias("merchant_pairs"), "identity_pairs")


def ref_graph_stats(spark, d):
    b = Base(spark, d)
    parts = G.components(b.edges.select(F.lit(0).alias("g"), F.col("card_a").alias("a"), F.col("card_b").alias("b")), "g")
    sizes = parts.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    one = sizes.agg(F.count(F.lit(1)).alias("linked_components"), F.coalesce(F.max("n"), F.lit(1)).alias("largest"), F.coalesce(F.sum("n"), F.lit(0)).alias("linked"))
    return one.select(F.lit(b.n_cards).cast("bigint").alias("nodes"), F.lit(b.n_edges).cast("bigint").alias("edges"), (F.col("linked_components") + F.lit(b.n_cards) - F.col("linked")).cast("bigint").alias("components"), F.col("largest").cast("bigint").alias("largest"))


def ref_node_degree(spark, d):
    return G.degrees(Base(spark, d).edges).select("card_id", "degree", r6("strength"))


def ref_components(spark, d):
    """Every linked card with its component at each edge-weight floor."""
    b = Base(spark, d)
    return b.parts.where("floor > 0").select("floor", F.col("vertex").alias("card_id"), "component")


def _sets_out(sets):
    return sets.select("candidate_id", "source", F.size("cards").cast("bigint").alias("size"), F.array_join("cards", ",").alias("cards"))


def ref_ego_candidates(spark, d):
    return _sets_out(C.ego_sets(Base(spark, d).groups))


def ref_component_candidates(spark, d):
    b = Base(spark, d)
    return _sets_out(C.within_sizes(C.component_sets(b.parts.where("floor > 0"))))


def _plain_sets(b: Base) -> DataFrame:
    return C.within_sizes(C.ego_sets(b.groups).unionByName(C.component_sets(b.parts.where("floor > 0"))))


def ref_jaccard_pairs(spark, d):
    """Pairs of ego and component candidates; communities, which SQL can't give, are compared in dedup_kept."""
    return C.overlapping(_plain_sets(Base(spark, d))).select(F.col("a").alias("candidate_a"), F.col("b").alias("candidate_b"), r6("jaccard"))


def ref_dedup_plain(spark, d):
    """Greedy removal among ego and component candidates."""
    return C.deduplicate(_plain_sets(Base(spark, d)))


def ref_survivors(spark, d):
    """The kept candidates of all sources with what was merged into each."""
    b = Base(spark, d)
    return C.survivors(b.sets, C.deduplicate(b.sets))


def ref_vertices(spark, d):
    b = Base(spark, d)
    return G.vertices(b.txn, b.card_world, b.edges).select("card_id", F.col("world_id").cast("bigint").alias("world_id"), "n_transactions", "degree")


def ref_dedup_kept(spark, d):
    return C.deduplicate(Base(spark, d).sets)


def ref_louvain(spark, d):
    return Base(spark, d).communities


def ref_candidate_world(spark, d):
    b = Base(spark, d)
    return C.worlds(b.members, b.card_world).select("candidate_id", F.col("world_id").cast("bigint").alias("world_id"), "n_worlds")


def ref_best_overlap(spark, d):
    b = Base(spark, d)
    return C.best_overlap(b.members, b.reference).select("candidate_id", "ref_id", r6("overlap"))


def ref_candidate_labels(spark, d):
    b = Base(spark, d)
    ids = b.members.select("candidate_id").distinct()
    return C.labels(ids, C.best_overlap(b.members, b.reference)).withColumn("is_match", F.col("is_match").cast("bigint"))


def ref_set_recall(spark, d):
    """Share of reference sets covered by the candidates of each source and of all."""
    b = Base(spark, d)
    source = table(spark, d, "candidates").groupBy("candidate_id").agg(F.min("source").alias("source"))
    rec = C.recall(b.members.join(source, "candidate_id"), b.reference)
    return rec.groupBy("source").agg(F.count(F.lit(1)).alias("n_sets"), F.count_if("covered").alias("n_covered"))


def _sourced(b: Base) -> DataFrame:
    source = table(b.spark, b.d, "candidates").groupBy("candidate_id").agg(F.min("source").alias("source"))
    return b.members.join(source, "candidate_id")


def ref_missed_sets(spark, d):
    """Reference sets that no candidate covers by more than half."""
    b = Base(spark, d)
    return C.missed(C.recall(_sourced(b), b.reference))


def ref_size_distribution(spark, d):
    return C.size_distribution(_sourced(Base(spark, d)))


def ref_shared_slice(spark, d):
    b = Base(spark, d)
    return X.shared_slice(b.rows, b.inside).select("candidate_id", "transaction_id")


def ref_device_slice_meta(spark, d):
    b = Base(spark, d)
    m = X.meta(b.rows, b.inside)
    return m.select("candidate_id", "n_transactions", F.round("score_mean", 12).alias("score_mean"), r6("score_max"), F.round("score_cashout_mean", 12).alias("score_cashout_mean"), r6("min_amount"), r6("max_amount"), "window_start", "window_end", "probe_ids", "cashout_ids", "shared_devices")


def ref_slice_merchants(spark, d):
    """Merchants of the first 20 probes and cashouts of each candidate's device slice."""
    b = Base(spark, d)
    return X.meta(b.rows, b.inside).select("candidate_id", "probe_merchants", "cashout_merchants")


def ref_timeline(spark, d):
    b = Base(spark, d)
    return X.timeline(b.rows, b.inside).select("candidate_id", "transaction_id", "tag")


def ref_identity_features(spark, d):
    b = Base(spark, d)
    f = X.identity_features(b.rows, b.members.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("n")))
    return f.select("candidate_id", *[F.col(c).cast("bigint").alias(c) for c in X.IDENTITY[:6]], r6("device_to_card_ratio"), r6("ip_to_card_ratio"), r6("cand_ego_overlap_ratio"))


def ref_behavioural_features(spark, d):
    b = Base(spark, d)
    f = X.behavioural_features(X.shared_slice(b.rows, b.inside), b.small)
    return f.select("candidate_id", *[F.round(c, 5).alias(c) for c in X.BEHAVIOURAL if c != "amount_entropy"])


def ref_amount_entropy(spark, d):
    b = Base(spark, d)
    return X.entropy(b.rows).select("candidate_id", F.round("amount_entropy", 5).alias("amount_entropy"))


def ref_burst_window(spark, d):
    b = Base(spark, d)
    return X.burst(b.txn.where("card_id IS NOT NULL"), "card_id").select("card_id", "densest", "n")


def ref_probe_cashout_gap(spark, d):
    b = Base(spark, d)
    return X.probe_gap(b.rows).select("candidate_id", r6("gap_h"))


def ref_structural_features(spark, d):
    b = Base(spark, d)
    s = G.structure(b.members, b.edges, b.n_cards, b.n_edges)
    return s.select("candidate_id", F.col("cand_size").cast("bigint").alias("cand_size"), *[F.round(c, 9).alias(c) for c in ("cand_density", "cand_avg_degree", "cand_expansion", "cand_cut_ratio", "cand_modularity_contribution", "cand_clustering_coeff")])


def ref_hop_shape(spark, d):
    b = Base(spark, d)
    return G.hop_shape(b.members, G.induced(b.members, b.edges))


def ref_halo(spark, d):
    b = Base(spark, d)
    return G.halo(b.members, b.edges)


def _features(spark, d):
    b = Base(spark, d)
    b.once("txn", lambda: transactions(table(spark, d, "card_txns")).select(*[c for c in X.READ if c != "timestamp"]), write=True)  # read for edges, cards and rows
    return X.features(b.members, b.txn, b.small, b.edges, b.n_cards, b.n_edges)


def ref_features(spark, d):
    """All 31 columns, to 5 digits."""
    return _features(spark, d).select("candidate_id", *[F.round(c, 5).alias(c) for c in (*X.STRUCTURAL, *X.IDENTITY, *X.BEHAVIOURAL)])


def ref_small_merchants(spark, d):
    return Base(spark, d).small


def ref_known_cards(spark, d):
    """Cards of each candidate, how many of them have a transaction, and whether some have none."""
    b = Base(spark, d)
    seen = b.txn.where("card_id IS NOT NULL").select("card_id").distinct().withColumn("known", F.lit(1))
    per = b.members.join(seen, "card_id", "left").groupBy("candidate_id").agg(F.count(F.lit(1)).alias("cards"), F.count("known").alias("known"))
    return per.withColumn("degraded", F.col("known") < F.col("cards"))


def ref_role_profile(spark, d):
    """Amount and score profile of the busiest merchants' categories in place of roles, which are labels."""
    b = Base(spark, d)
    m = table(spark, d, "merchants").select(id_text(id_number("merchant_id", "MERCH"), "MERCH").alias("merchant_id"), "category").where("merchant_id IS NOT NULL AND category IS NOT NULL").groupBy("merchant_id").agg(F.max("category").alias("category"))
    r = b.txn.join(m, "merchant_id").where("amount IS NOT NULL")
    return r.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("amount") < 10).cast("int")), 6).alias("share_probe"), F.round(F.expr("percentile(amount, 0.5D)"), 6).alias("median"), F.max("amount").alias("largest"), F.min("amount").alias("smallest"), F.round(F.avg("vulcan_score"), 6).alias("mean_score"))


def ref_confusion_cost(spark, d):
    c = E.confusion(Base(spark, d).predictions, 0.5, FN_COST, FP_COST)
    return c.select("tp", "fp", "fn", "tn", *[r6(x) for x in ("fpr", "fnr", "precision", "recall", "f1", "cost")])


def ref_prior_shift(spark, d):
    """Expected cost where one in fifty is positive."""
    e = E.prior_shift(E.confusion(Base(spark, d).predictions, 0.5, FN_COST, FP_COST), 0.02, FN_COST, FP_COST)
    return e.select("rows", r6("cost"), r6("per_1k"))


def ref_top_false_positive(spark, d):
    e = table(spark, d, "embeddings").where("label IS NOT NULL")
    scored = e.select("vec_id", (F.col("label") % 2).cast("int").alias("y"), F.round(0.5 + 0.45 * F.col("embedding")[F.col("label") % 8].cast("double"), 3).alias("p"))
    return E.top_false_positives(scored, "vec_id").select("vec_id", "p")


def ref_threshold_sweep(spark, d):
    s = E.sweep(Base(spark, d).predictions, FN_COST, FP_COST)
    return s.select("step", "threshold", "tp", "fp", "fn", "tn", r6("cost"), r6("f1"))


def ref_best_thresholds(spark, d):
    return E.best_thresholds(E.sweep(Base(spark, d).predictions, FN_COST, FP_COST)).select("cost_threshold", r6("least_cost"), "f1_threshold", r6("best_f1"))


def ref_cost_sensitivity(spark, d):
    return E.cost_sensitivity(Base(spark, d).predictions).select("ratio", "threshold", r6("cost"))


def ref_ranking(spark, d):
    return E.ranking(Base(spark, d).predictions).select("fold", "n", "positives", r6("roc_auc"), r6("average_precision"))


def ref_latency(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("millis"))
    return E.latency(e).select("stage", "n", *[r6(c) for c in ("p50", "p95", "p99", "max", "mean")])


def _vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def ref_signature_scaler(spark, d):
    return M.scaler(_vectors(spark, d)).select(F.col("pos").cast("bigint").alias("pos"), F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"))


def ref_signatures(spark, d):
    """First entry and sum of entries of each vector's signature."""
    v = _vectors(spark, d)
    g = M.signatures(v, "vec_id", "v", M.scaler(v))
    return g.select("vec_id", F.round(F.col("signature")[0], 6).alias("first"), F.round(F.aggregate("signature", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


def ref_similarity_summary(spark, d):
    """Median, 95th percentile and share of 0.3 and above of the cosines of every vector whose id is divisible by 20 with all others, in steps of 0.002."""
    v = _vectors(spark, d)
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("vector"))
    s = M.similarity_summary(M.similarity_histogram(q, v.select(F.col("vec_id").alias("case_id"), F.col("v").alias("vector")), 500), 500, 0.3)
    return s.select("pairs", r6("p50"), r6("p95"), r6("share_near"))


def ref_cosine_topk(spark, d):
    """The three nearest stored vectors of every vector whose id is divisible by 20, itself included."""
    v = _vectors(spark, d)
    near = M.nearest(v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("vector")), v.select(F.col("vec_id").alias("case_id"), F.col("v").alias("vector")), 0.1)
    return near.select("query_id", "case_id", r6("similarity"))


def ref_memory_adjustments(spark, d):
    v = _vectors(spark, d)
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("vector"))
    case = lambda label: v.where(F.col("label") == label).select(F.col("vec_id").alias("case_id"), F.col("v").alias("vector"))
    return M.adjustments(q.select("query_id"), M.nearest(q, case(0), 0.3), M.nearest(q, case(1), 0.3))


def ref_templates(spark, d):
    v = _vectors(spark, d)
    cases = v.where("label IS NOT NULL").select(F.col("label").alias("kind"), F.col("vec_id").cast("string").alias("case_id"), F.col("vec_id").alias("confirmed_at"), F.col("v").alias("vector"))
    return M.templates(cases, at_least=0.15)


def ref_latest_rows(spark, d):
    """Latest event of each user as an upserted table."""
    e = table(spark, d, "events")
    top = M.latest(e.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), "event_id", "event_type"), ["user_id"], "at_us")
    return top


def ref_composite(spark, d):
    """Composite of each candidate: highest upstream score of its transactions and the share of its cards on one shared value."""
    b = Base(spark, d)
    up = b.rows.groupBy("candidate_id").agg(F.max("vulcan_score").alias("upstream"))
    own = X.identity_features(b.rows, b.members.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("n"))).select("candidate_id", F.col("cand_ego_overlap_ratio").alias("own"))
    rows = up.join(own, "candidate_id").withColumn("boost", F.when(F.col("own") > 0.5, M.BOOST).otherwise(0.0)).withColumn("damp", F.when(F.col("upstream") < 0.3, M.DAMP).otherwise(0.0))
    return scoring.scored(rows).select("candidate_id", *[F.round(c, 12).alias(c) for c in ("composite", "plain", "delta", "confidence")])


def ref_alert_queue(spark, d):
    """The 40 candidates of the highest composite."""
    return ref_composite(spark, d).orderBy(F.desc("composite"), "candidate_id").limit(40).select("candidate_id", "composite")


def ref_evidence(spark, d):
    b = Base(spark, d)
    inner = G.induced(b.members, b.shared)
    return D.graph_evidence(inner.select("candidate_id", "card_a", "card_b", "attribute", "value")).select("candidate_id", "attribute", "value", "cards", F.col("no").cast("bigint").alias("no"), "citations")


def ref_behavioural_evidence(spark, d):
    b = Base(spark, d)
    f = X.behavioural_features(X.shared_slice(b.rows, b.inside), b.small)
    return D.behavioural_evidence(f).select("candidate_id", "claim", F.round("value", 4).alias("value"))


def ref_dossier_quality(spark, d):
    b = Base(spark, d)
    inner = G.induced(b.members, b.shared).select("candidate_id", "card_a", "card_b", "attribute", "value")
    g = D.graph_evidence(inner).select("candidate_id", F.concat_ws("=", "attribute", "value").alias("claim"), F.element_at(F.split("citations", ";"), 1).alias("citation_id"), (F.size(F.split("citations", ";")) - 1).alias("supports"))
    return D.quality(D.reject_uncited(g)).select("candidate_id", "claims", "uncited", r6("refs_per_claim"))


def ref_dossier_corpus(spark, d):
    """Quality of the graph evidence of all candidates together."""
    return D.corpus_quality(ref_dossier_quality(spark, d)).select("dossiers", "claims", "uncited", r6("refs_per_claim"))


def ref_hourly_velocity(spark, d):
    """Sliding hours per card and identity value."""
    return windows.velocity(Base(spark, d).txn).select(F.unix_seconds("start").alias("start_s"), "kind", "id", "n", r6("total"))


def ref_daily_escalation(spark, d):
    """Sliding days per card and identity value."""
    return windows.escalation(Base(spark, d).txn).select(F.unix_seconds("start").alias("start_s"), "kind", "id", "n", r6("escalation"))


def ref_rolling_bursts(spark, d):
    """Sliding windows of five minutes per card, as the streaming job counts them."""
    b = Base(spark, d)
    w = windows.rolling(b.txn, "card_id", "timestamp", "amount")
    return w.select(F.unix_seconds("start").alias("start_s"), "card_id", "n", r6("total"), r6("most"))


def _training(spark, d):
    """Features, labels from the reference sets, and the world as fold."""
    b = Base(spark, d)
    worlds = C.worlds(b.members, b.card_world).select("candidate_id", F.col("world_id").alias("fold"))
    f = _features(spark, d).join(ref_candidate_labels(spark, d).select("candidate_id", F.col("is_match").cast("int").alias("y")), "candidate_id").join(worlds, "candidate_id")
    return materialize(f, "training")


def ref_gbt_oof(spark, d):
    """Out-of-fold scores of the candidates, one world left out at a time."""
    oof = model.cross_validate(_training(spark, d), [*X.STRUCTURAL, *X.IDENTITY, *X.BEHAVIOURAL])
    return oof.select("candidate_id", "fold", "y", "p")


def ref_gbt_folds(spark, d):
    """(fold, n, positives): what each model leaves out; every world is a fold."""
    b = Base(spark, d)
    worlds = C.worlds(b.members, b.card_world).select("candidate_id", F.col("world_id").cast("bigint").alias("fold"))
    return ref_candidate_labels(spark, d).join(worlds, "candidate_id").groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("is_match").alias("positives"))


def ref_train(spark, d):
    """(measure, value) of one training: cross-validation by world, threshold of least cost, fit on all rows."""
    t = model.train(_training(spark, d), [*X.STRUCTURAL, *X.IDENTITY, *X.BEHAVIOURAL], FN_COST, FP_COST, incidence=0.02)
    rows = [(k, None if v is None else float(v)) for k, v in sorted(t.measures.items())]
    families = {"structural": list(X.STRUCTURAL), "identity": list(X.IDENTITY), "behavioural": list(X.BEHAVIOURAL)}
    measures = spark.createDataFrame(rows, "measure string, value double")
    if t.importance is None:
        return measures
    return measures.unionByName(model.importance_by_family(t.importance, families).select(F.concat(F.lit("importance_"), "family").alias("measure"), F.col("total").alias("value")))


def ref_ablation(spark, d):
    """Average precision and least cost with all columns and without each family, one world left out at a time."""
    families = {"structural": list(X.STRUCTURAL), "identity": list(X.IDENTITY), "behavioural": list(X.BEHAVIOURAL)}
    scores = model.ablation(_training(spark, d), families)
    return model.ablation_deltas(scores, families, FN_COST, FP_COST)


def ref_set_measures(spark, d):
    """Jaccard similarity and covered share of each candidate and reference set with a common card."""
    b = Base(spark, d)
    return C.measures(b.members, b.reference).select("candidate_id", "ref_id", r6("jaccard"), r6("covered"))


def ref_cosine_histogram(spark, d):
    """Cosines of every vector whose id is divisible by 20 with all others, in steps of 0.02."""
    v = _vectors(spark, d)
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("vector"))
    return M.similarity_histogram(q, v.select(F.col("vec_id").alias("case_id"), F.col("v").alias("vector")), 50)


def ref_alert_page(spark, d):
    """The second page of 20 candidates with a composite of at least a half, highest first."""
    return M.page(ref_composite(spark, d).where("composite >= 0.5").select("candidate_id", "composite"), [F.desc("composite"), F.asc("candidate_id")], 20, 20)


def ref_case_counts(spark, d):
    """Stored cases by disposition."""
    return table(spark, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def ref_audit_tail(spark, d):
    """The 50 newest log rows."""
    e = table(spark, d, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), "event_type")
    return M.page(e, [F.desc("at_us"), F.desc("event_id")], 0, 50)


def ref_failure_recovery(spark, d):
    """Candidates whose composite memory lowers, with and without it."""
    return ref_composite(spark, d).where("delta < 0").select("candidate_id", F.col("plain").alias("without_memory"), F.col("composite").alias("with_memory"), "delta")


def ref_merchant_tickets(spark, d):
    """Small merchants by observed amounts, where no dimension is at hand."""
    b = Base(spark, d)
    return X.small_merchants(None, b.txn.where("merchant_id IS NOT NULL"))


def ref_synthetic_roles(spark, d):
    """Profile of a generated universe by role."""
    from linkweave.sources import synthetic

    return synthetic.verify(synthetic.universe(spark)["transactions"])


def queries() -> dict:
    return {k[4:]: f for k, f in globals().items() if k.startswith("ref_")}
