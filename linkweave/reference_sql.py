"""DuckDB SQL of the pipeline queries: named parts, joined into one WITH per query as needed."""

from __future__ import annotations

import re

from linkweave.functions.ids import sql_id
from linkweave.sources.tables import sql_txn

_CARD = sql_id("x", "CARD")

PARTS: dict[str, str] = {
    "pair": """SELECT attribute, value, card_id, count(*) AS n FROM (
      SELECT 'device_fingerprint' AS attribute, device_fingerprint AS value, card_id FROM txn UNION ALL
      SELECT 'ip_address', ip_address, card_id FROM txn UNION ALL SELECT 'email_hash', email_hash, card_id FROM txn)
      WHERE value IS NOT NULL AND card_id IS NOT NULL GROUP BY ALL""",
    "vcard": "SELECT attribute, value, count(*) AS k FROM pair GROUP BY ALL",
    "caps": "SELECT attribute, CAST(greatest(ceil(quantile_cont(k, 0.95)), 12) AS BIGINT) AS cap FROM vcard GROUP BY attribute",
    "capped": """SELECT * FROM (SELECT p.*, row_number() OVER (PARTITION BY attribute, value ORDER BY n DESC, card_id) AS no, k, cap FROM pair p JOIN vcard USING (attribute, value) JOIN caps USING (attribute) WHERE k > 1) WHERE no <= cap""",
    "shared_edge": """SELECT a.card_id AS card_a, b.card_id AS card_b, a.attribute, a.value, a.k, (CASE a.attribute WHEN 'ip_address' THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END) / log2(a.k + 1) AS weight
      FROM capped a JOIN capped b ON a.attribute = b.attribute AND a.value = b.value AND a.card_id < b.card_id""",
    "edge": """SELECT card_a, card_b, least(round(sum(weight), 12), 1.0) AS weight, count(*) AS n_shared, string_agg(DISTINCT attribute, ',' ORDER BY attribute) AS shared_types FROM shared_edge GROUP BY ALL""",
    "arc": "SELECT card_a AS u, card_b AS v, weight FROM edge UNION ALL SELECT card_b, card_a, weight FROM edge",
    "degree": "SELECT u AS card_id, count(*) AS degree, sum(weight) AS strength FROM arc GROUP BY u",
    "floors": "SELECT unnest([0.3, 0.5, 0.7, 0.9])::DOUBLE AS floor",
    "card_no": "SELECT card_id, row_number() OVER (ORDER BY card_id) AS i FROM degree",
    "reach": """SELECT floor, u AS s, u AS t FROM arc, floors WHERE weight >= floor UNION SELECT r.floor, r.s, a.v FROM reach r JOIN arc a ON a.u = r.t AND a.weight >= r.floor""",
    "part": "SELECT floor, s AS card_id, min(t) AS component FROM reach GROUP BY ALL",
    "member": f"SELECT DISTINCT candidate_id, {_CARD} AS card_id FROM (SELECT candidate_id, unnest(cards) AS x FROM candidates) WHERE {_CARD} IS NOT NULL",
    "csize": "SELECT candidate_id, count(*) AS n FROM member GROUP BY candidate_id",
    "crow": "SELECT m.candidate_id, t.* FROM member m JOIN txn t ON m.card_id = t.card_id",
    "cvalue": """SELECT candidate_id, attribute, value, count(DISTINCT card_id) AS cards FROM (
      SELECT candidate_id, card_id, 'device_fingerprint' AS attribute, device_fingerprint AS value FROM crow UNION ALL
      SELECT candidate_id, card_id, 'ip_address', ip_address FROM crow UNION ALL SELECT candidate_id, card_id, 'email_hash', email_hash FROM crow)
      WHERE value IS NOT NULL GROUP BY ALL""",
    "cshared": "SELECT * FROM cvalue WHERE cards > 1",
    "flagged": """SELECT c.*, d.value IS NOT NULL AS hit_d, i.value IS NOT NULL AS hit_i, e.value IS NOT NULL AS hit_e FROM crow c
      LEFT JOIN cshared d ON d.candidate_id = c.candidate_id AND d.attribute = 'device_fingerprint' AND d.value = c.device_fingerprint
      LEFT JOIN cshared i ON i.candidate_id = c.candidate_id AND i.attribute = 'ip_address' AND i.value = c.ip_address
      LEFT JOIN cshared e ON e.candidate_id = c.candidate_id AND e.attribute = 'email_hash' AND e.value = c.email_hash""",
    "slice3": "SELECT * FROM (SELECT *, bool_or(hit_d OR hit_i OR hit_e) OVER (PARTITION BY candidate_id) AS any_hit FROM flagged) WHERE hit_d OR hit_i OR hit_e OR NOT any_hit",
    "slice2": "SELECT * FROM (SELECT *, bool_or(hit_d OR hit_i) OVER (PARTITION BY candidate_id) AS any_hit FROM flagged) WHERE hit_d OR hit_i OR NOT any_hit",
    "slice1": "SELECT * FROM (SELECT *, bool_or(hit_d) OVER (PARTITION BY candidate_id) AS any_hit FROM flagged) WHERE hit_d OR NOT any_hit",
    "small": f"SELECT merchant_id, coalesce(max(avg_ticket) < 50, false) AS small FROM (SELECT {sql_id('merchant_id', 'MERCH')} AS merchant_id, CASE WHEN NOT isnan(avg_ticket) THEN avg_ticket END AS avg_ticket FROM merchants) WHERE merchant_id IS NOT NULL GROUP BY merchant_id",
    "card_world": f"SELECT card_id, max(world_id) AS world_id FROM (SELECT {sql_id('card_id', 'CARD')} AS card_id, world_id FROM cards) WHERE card_id IS NOT NULL GROUP BY card_id",
    "cworld": "SELECT candidate_id, coalesce(world_id, -1) AS world_id, count(*) AS n FROM member LEFT JOIN card_world USING (card_id) GROUP BY ALL",
    "ref": f"SELECT DISTINCT concat_ws('=', attribute, value) AS ref_id, {_CARD} AS card_id FROM (SELECT attribute, value, unnest(cards) AS x FROM identity_groups WHERE trim(value) <> '' AND cardinality <= 12) WHERE {_CARD} IS NOT NULL",
    "overlap": "SELECT candidate_id, ref_id, count(*) AS c, (SELECT count(*) FROM ref r WHERE r.ref_id = ref.ref_id) AS size FROM member JOIN ref USING (card_id) GROUP BY ALL",
    "best": "SELECT candidate_id, ref_id, c / size AS overlap FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY c / size DESC, ref_id) AS no FROM overlap) WHERE no = 1",
    "inner_edge": "SELECT a.candidate_id, e.* FROM edge e JOIN member a ON a.card_id = e.card_a JOIN member b ON b.card_id = e.card_b AND b.candidate_id = a.candidate_id",
    "inner_arc": "SELECT candidate_id, card_a AS u, card_b AS v FROM inner_edge UNION ALL SELECT candidate_id, card_b, card_a FROM inner_edge",
    "inner_shared": "SELECT a.candidate_id, e.* FROM shared_edge e JOIN member a ON a.card_id = e.card_a JOIN member b ON b.card_id = e.card_b AND b.candidate_id = a.candidate_id",
    "hops": "SELECT candidate_id, card_id AS s, card_id AS t, 0 AS h FROM member UNION SELECT x.candidate_id, x.s, a.v, x.h + 1 FROM hops x JOIN inner_arc a ON a.candidate_id = x.candidate_id AND a.u = x.t WHERE x.h < 12",
    "pred": "SELECT vec_id % 5 AS fold, CAST(label % 2 AS INT) AS y, round(0.5 + 0.45 * CAST(embedding[label % 8 + 1] AS DOUBLE), 3) AS p FROM embeddings WHERE label IS NOT NULL",
    "grid": "SELECT i AS step, round(0.01 + i * (0.98 / 500), 9) AS threshold, 0.01 + i * (0.98 / 500) - 0.98 / 500 * 1e-9 AS bound FROM range(0, 501) t(i)",
    "swept": """SELECT step, threshold, count(*) FILTER (y = 1 AND p >= bound) AS tp, count(*) FILTER (y <> 1 AND p >= bound) AS fp, count(*) FILTER (y = 1 AND p < bound) AS fn, count(*) FILTER (y <> 1 AND p < bound) AS tn FROM grid, pred GROUP BY ALL""",
    "costed": "SELECT *, fn * 850000.0::DOUBLE + fp * 230000.0::DOUBLE AS cost, coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0.0) AS f1 FROM swept",
    "vec": "SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings",
    "ego": "SELECT 'ego:' || attribute || '=' || value AS candidate_id, 'ego' AS source, count(*) AS size, string_agg(card_id, ',' ORDER BY card_id) AS cards, attribute, value FROM capped GROUP BY attribute, value",
    "ego_card": "SELECT 'ego:' || attribute || '=' || value AS candidate_id, card_id, count(*) OVER (PARTITION BY attribute, value) AS n FROM capped",
    "own": "SELECT s.candidate_id, s.n, coalesce(max(cards) FILTER (cards > 1), 0) / s.n AS own FROM csize s LEFT JOIN cvalue v USING (candidate_id) GROUP BY s.candidate_id, s.n",
    "score": """SELECT o.candidate_id, u, own, CASE WHEN own > 0.5 THEN 0.15 ELSE 0 END AS boost, CASE WHEN u < 0.3 THEN 0.2 ELSE 0 END AS damp FROM own o JOIN (SELECT candidate_id, max(vulcan_score) AS u FROM crow GROUP BY candidate_id) USING (candidate_id)""",
    "scored": "SELECT *, least(greatest((1 - (1 - coalesce(u, 0)) * (1 - own)) * (1 + boost) * (1 - damp), 0), 1) AS composite, 1 - (1 - coalesce(u, 0)) * (1 - own) AS plain, least(1, 0.55 * (1 - abs(coalesce(u, 0) - own)) + 0.45 * greatest(coalesce(u, 0), own) + 0.05 * CAST(boost <> 0 AS INT)) AS confidence FROM score",
    "behave": """SELECT candidate_id, avg(CAST(coalesce(amount < 10, false) AS INT)) AS probe_fraction, coalesce(max(amount) / nullif(min(amount), 0), 1) AS amount_escalation,
      avg(CAST(coalesce(small, false) AS INT)) AS small_merchant_concentration, coalesce((max(ts) - min(ts)) / 3600, 0) AS time_span_hours, count(*) / greatest(coalesce((max(ts) - min(ts)) / 3600, 0), 1e-6) AS velocity_txn_per_hour,
      avg(CAST(coalesce(amount > 10000, false) AS INT)) AS cashout_fraction, count(DISTINCT s.merchant_id) / count(*) AS merchant_diversity, count(DISTINCT regexp_replace(ip_address, '\\.[^.]*$', '')) / count(*) AS geo_spread,
      avg(CAST(coalesce(hour(timestamp) < 6, false) AS INT)) AS night_fraction, avg(CAST(coalesce(isodow(timestamp) >= 6, false) AS INT)) AS weekend_fraction FROM slice3 s LEFT JOIN small m ON m.merchant_id = s.merchant_id GROUP BY candidate_id""",
    "dense": "SELECT candidate_id, max(c) / count(*) AS burst_compression FROM (SELECT candidate_id, count(*) OVER (PARTITION BY candidate_id ORDER BY ts RANGE BETWEEN CURRENT ROW AND 300 FOLLOWING) AS c FROM slice3 WHERE ts IS NOT NULL) GROUP BY candidate_id",
    "gap3": "SELECT candidate_id, (min(ts) FILTER (amount > 10000 AND ts > probe) - min(probe)) / 3600 AS gap FROM (SELECT *, min(ts) FILTER (amount < 10) OVER (PARTITION BY candidate_id) AS probe FROM slice3) GROUP BY candidate_id",
    "behave_all": "SELECT b.*, coalesce(burst_compression, 0) AS burst_compression, coalesce(gap, -1) AS probe_to_cashout_gap_hours FROM behave b LEFT JOIN dense USING (candidate_id) LEFT JOIN gap3 USING (candidate_id)",
    "evidence_value": "SELECT candidate_id, attribute, value, count(DISTINCT card) AS cards FROM (SELECT candidate_id, attribute, value, card_a AS card FROM inner_shared UNION ALL SELECT candidate_id, attribute, value, card_b FROM inner_shared) GROUP BY ALL",
    "evidence_top": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY cards DESC, attribute, value) AS no FROM evidence_value) WHERE no <= 6",
    "evidence_ref": "SELECT candidate_id, attribute, value, string_agg(c, ';' ORDER BY c) AS citations, count(*) AS refs FROM (SELECT *, 'edge:' || card_a || '~' || card_b || ':' || attribute || '=' || value AS c, row_number() OVER (PARTITION BY candidate_id, attribute, value ORDER BY card_a, card_b) AS nth FROM inner_shared) WHERE nth <= 5 GROUP BY ALL",
}

_BEHAVE = "probe_fraction amount_escalation burst_compression small_merchant_concentration time_span_hours velocity_txn_per_hour cashout_fraction probe_to_cashout_gap_hours merchant_diversity geo_spread night_fraction weekend_fraction".split()
_CLAIMS = [("probe_fraction", "> 0.05"), ("cashout_fraction", "> 0.02"), ("amount_escalation", "> 50"), ("burst_compression", "> 0.3"), ("small_merchant_concentration", "> 0.2"), ("probe_to_cashout_gap_hours", ">= 0")]

QUERIES: dict[str, str] = {
    "set_measures": "SELECT candidate_id, ref_id, round(c / (n + size - c), 6) AS jaccard, round(c / size, 6) AS covered FROM overlap JOIN csize USING (candidate_id)",
    "cosine_histogram": "SELECT CAST(floor(round(list_cosine_similarity(q.v, c.v), 9) * 50) AS BIGINT) AS step, count(*) AS n FROM vec q, vec c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id GROUP BY step",
    "alert_page": "SELECT candidate_id, round(composite, 12) AS composite FROM scored WHERE round(composite, 12) >= 0.5 ORDER BY round(composite, 12) DESC, candidate_id LIMIT 20 OFFSET 20",
    "case_counts": "SELECT label, count(*) AS n FROM embeddings GROUP BY label",
    "audit_tail": "SELECT event_id, epoch_us(ts) AS at_us, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50",
    "failure_recovery": "SELECT candidate_id, round(plain, 12) AS without_memory, round(composite, 12) AS with_memory, round(composite - plain, 12) AS delta FROM scored WHERE round(composite - plain, 12) < 0",
    "merchant_tickets": "SELECT merchant_id, coalesce(avg(amount) < 50, false) AS small FROM txn WHERE merchant_id IS NOT NULL GROUP BY merchant_id",
    "txn_view": "SELECT transaction_id, card_id, merchant_id, round(amount, 6) AS amount, ts, device_fingerprint, ip_address, email_hash, vulcan_score, txn_role FROM txn",
    "pair_counts": "SELECT * FROM pair",
    "value_cardinality": "SELECT * FROM vcard",
    "collision_caps": "SELECT * FROM caps",
    "collision_stats": "SELECT attribute, count(*) AS n_values, count(*) FILTER (k > 1) AS n_shared, round(quantile_cont(k, 0.5), 6) AS p50, round(quantile_cont(k, 0.95), 6) AS p95, round(quantile_cont(k, 0.99), 6) AS p99, max(k) AS k_max, max(cap) AS cap, count(*) FILTER (k > cap) AS n_over, CAST(sum(greatest(k - cap, 0)) AS BIGINT) AS dropped, CAST(max(k * (k - 1) // 2) AS BIGINT) AS worst_pairs FROM vcard JOIN caps USING (attribute) GROUP BY attribute",
    "capped_groups": "SELECT attribute, value, card_id, n, no, k FROM capped",
    "edge_weights": "SELECT card_a, card_b, attribute, value, k, round(weight, 9) AS weight FROM shared_edge",
    "identity_edges": "SELECT card_a, card_b, round(weight, 9) AS weight, n_shared, shared_types FROM edge",
    "edge_provenance": "SELECT card_a, card_b, attribute, value, k AS cardinality FROM shared_edge",
    "merchant_saturation": "SELECT (SELECT count(DISTINCT card_id) * (count(DISTINCT card_id) - 1) // 2 FROM txn WHERE merchant_id IS NOT NULL) AS possible_pairs, (SELECT count(*) FROM (SELECT DISTINCT a.card_id, b.card_id AS other FROM (SELECT DISTINCT card_id, merchant_id FROM txn) a JOIN (SELECT DISTINCT card_id, merchant_id FROM txn) b ON a.merchant_id = b.merchant_id AND a.card_id < b.card_id)) AS merchant_pairs, (SELECT count(*) FROM edge) AS identity_pairs",
    "node_degree": "SELECT card_id, degree, round(strength, 6) AS strength FROM degree",
    "components": "SELECT * FROM part",
    "graph_stats": "SELECT (SELECT count(DISTINCT card_id) FROM txn) AS nodes, (SELECT count(*) FROM edge) AS edges, (SELECT count(DISTINCT m) FROM all_part) + (SELECT count(DISTINCT card_id) FROM txn) - (SELECT count(*) FROM all_part) AS components, (SELECT max(c) FROM (SELECT count(*) AS c FROM all_part GROUP BY m)) AS largest",
    "ego_candidates": "SELECT candidate_id, source, size, cards FROM ego",
    "component_candidates": "SELECT 'cc:' || CAST(floor AS VARCHAR) || ':' || component AS candidate_id, 'cc' AS source, count(*) AS size, string_agg(card_id, ',' ORDER BY card_id) AS cards FROM part GROUP BY floor, component HAVING count(*) BETWEEN 2 AND 60",
    "jaccard_pairs": "SELECT a AS candidate_a, b AS candidate_b, round(c / (na + nb - c), 6) AS jaccard FROM (SELECT x.candidate_id AS a, y.candidate_id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS c FROM set_card x JOIN set_card y ON x.card_id = y.card_id AND x.candidate_id < y.candidate_id WHERE x.n BETWEEN 2 AND 60 AND y.n BETWEEN 2 AND 60 GROUP BY 1, 2) WHERE c / (na + nb - c) > 0.5",
    "candidate_world": "SELECT candidate_id, CAST(world_id AS BIGINT) AS world_id, n_worlds FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY n DESC, world_id) AS no, count(*) OVER (PARTITION BY candidate_id) AS n_worlds FROM cworld) WHERE no = 1",
    "best_overlap": "SELECT candidate_id, ref_id, round(overlap, 6) AS overlap FROM best",
    "candidate_labels": "SELECT candidate_id, ref_id AS best_ref_id, round(coalesce(overlap, 0), 4) AS best_overlap, CAST(coalesce(overlap, 0) > 0.5 AS BIGINT) AS is_match FROM csize LEFT JOIN best USING (candidate_id)",
    "set_recall": "SELECT s.source, (SELECT count(DISTINCT ref_id) FROM ref) AS n_sets, count(DISTINCT ref_id) FILTER (c * 2 > size) AS n_covered FROM (SELECT unnest(['ego', 'cc', 'louvain', 'all']) AS source) s LEFT JOIN (SELECT o.*, k.source FROM overlap o JOIN (SELECT candidate_id, min(source) AS source FROM candidates GROUP BY candidate_id) k USING (candidate_id)) o ON s.source = o.source OR s.source = 'all' GROUP BY s.source",
    "shared_slice": "SELECT candidate_id, transaction_id FROM slice3",
    "timeline": "SELECT candidate_id, transaction_id, CASE WHEN amount < 10 THEN 'probe' WHEN amount > 10000 THEN 'cashout' ELSE 'other' END AS tag FROM slice2",
    "device_slice_meta": """SELECT b.candidate_id, n_transactions, round(score_mean, 12) AS score_mean, round(score_max, 6) AS score_max, round(score_cashout_mean, 12) AS score_cashout_mean, round(min_amount, 6) AS min_amount, round(max_amount, 6) AS max_amount, window_start, window_end, coalesce(probe_ids, '') AS probe_ids, coalesce(cashout_ids, '') AS cashout_ids, coalesce(shared_devices, '') AS shared_devices
      FROM (SELECT candidate_id, count(*) AS n_transactions, avg(vulcan_score) AS score_mean, max(vulcan_score) AS score_max, avg(vulcan_score) FILTER (amount > 10000) AS score_cashout_mean, min(amount) AS min_amount, max(amount) AS max_amount, min(ts) AS window_start, max(ts) AS window_end FROM slice1 GROUP BY candidate_id) b
      LEFT JOIN (SELECT candidate_id, string_agg(transaction_id, ',' ORDER BY no) FILTER (kind = 'probe') AS probe_ids, string_agg(transaction_id, ',' ORDER BY no) FILTER (kind = 'cashout') AS cashout_ids FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id, kind ORDER BY card_id, ts NULLS FIRST, transaction_id) AS no FROM (SELECT *, CASE WHEN amount < 10 THEN 'probe' WHEN amount > 10000 THEN 'cashout' END AS kind FROM slice1) WHERE kind IS NOT NULL) WHERE no <= 5 GROUP BY candidate_id) k USING (candidate_id)
      LEFT JOIN (SELECT candidate_id, string_agg(value, ',' ORDER BY value) AS shared_devices FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY value) AS no FROM cshared WHERE attribute = 'device_fingerprint') WHERE no <= 10 GROUP BY candidate_id) v USING (candidate_id)""",
    "identity_features": """SELECT s.candidate_id, count(*) FILTER (attribute = 'device_fingerprint') AS n_unique_devices, count(*) FILTER (attribute = 'ip_address') AS n_unique_ips, count(*) FILTER (attribute = 'email_hash') AS n_unique_emails,
      coalesce(max(cards) FILTER (attribute = 'device_fingerprint'), 0) AS max_device_reuse, coalesce(max(cards) FILTER (attribute = 'ip_address'), 0) AS max_ip_reuse, coalesce(max(cards) FILTER (attribute = 'email_hash'), 0) AS max_email_reuse,
      round(count(*) FILTER (attribute = 'device_fingerprint') / s.n, 6) AS device_to_card_ratio, round(count(*) FILTER (attribute = 'ip_address') / s.n, 6) AS ip_to_card_ratio, round(coalesce(max(cards) FILTER (cards > 1), 0) / s.n, 6) AS cand_ego_overlap_ratio
      FROM csize s LEFT JOIN cvalue USING (candidate_id) GROUP BY s.candidate_id, s.n""",
    "behavioural_features": "SELECT candidate_id, " + ", ".join(f"round({c}, 5) AS {c}" for c in _BEHAVE) + " FROM behave_all",
    "amount_entropy": """SELECT candidate_id, round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 5) AS amount_entropy FROM (SELECT candidate_id, least(greatest(floor(round((log10(x) - lo) / (hi - lo) * 12, 9)), 0), 11) AS bin, count(*) AS c FROM (SELECT candidate_id, greatest(amount, 0.01) AS x, log10(min(greatest(amount, 0.01)) OVER w) AS lo, log10(max(greatest(amount, 0.01)) OVER w + 1e-6) AS hi FROM crow WHERE amount IS NOT NULL WINDOW w AS (PARTITION BY candidate_id)) GROUP BY ALL) GROUP BY candidate_id""",
    "burst_window": "SELECT card_id, max(c) AS densest, count(*) AS n FROM (SELECT card_id, count(*) OVER (PARTITION BY card_id ORDER BY ts RANGE BETWEEN CURRENT ROW AND 300 FOLLOWING) AS c FROM txn WHERE ts IS NOT NULL AND card_id IS NOT NULL) GROUP BY card_id",
    "probe_cashout_gap": "SELECT candidate_id, round(coalesce((min(ts) FILTER (amount > 10000 AND ts > probe) - min(probe)) / 3600, -1), 6) AS gap_h FROM (SELECT *, min(ts) FILTER (amount < 10) OVER (PARTITION BY candidate_id) AS probe FROM crow WHERE ts IS NOT NULL AND amount IS NOT NULL) GROUP BY candidate_id",
    "structural_features": """SELECT candidate_id, n AS cand_size, round(CASE WHEN n > 1 THEN m / (n * (n - 1) / 2) ELSE 0 END, 9) AS cand_density, round(2 * m / n, 9) AS cand_avg_degree, round((d - 2 * m) / n, 9) AS cand_expansion,
      round((d - 2 * m) / (n * greatest((SELECT count(DISTINCT card_id) FROM txn) - n, 1)), 9) AS cand_cut_ratio, round(m / big - pow(d / (2 * big), 2), 9) AS cand_modularity_contribution, round(CASE WHEN n >= 3 THEN cc / n ELSE 0 END, 9) AS cand_clustering_coeff
      FROM (SELECT s.candidate_id, n, coalesce((SELECT count(*) FROM inner_edge e WHERE e.candidate_id = s.candidate_id), 0) AS m, coalesce((SELECT sum(degree) FROM member x JOIN degree USING (card_id) WHERE x.candidate_id = s.candidate_id), 0) AS d, (SELECT count(*) FROM edge) AS big, coalesce((SELECT sum(c) FROM local_c l WHERE l.candidate_id = s.candidate_id), 0) AS cc FROM csize s)""",
    "hop_shape": """SELECT s.candidate_id, p.n_components, CASE WHEN s.n <= 50 AND p.n_components = 1 AND coalesce(e.m, 0) > 0 THEN h.far ELSE -1 END AS diameter FROM csize s
      JOIN (SELECT candidate_id, count(DISTINCT low) AS n_components FROM (SELECT candidate_id, s, min(t) AS low FROM hops GROUP BY ALL) GROUP BY candidate_id) p USING (candidate_id)
      JOIN (SELECT candidate_id, max(near) AS far FROM (SELECT candidate_id, s, t, min(h) AS near FROM hops GROUP BY ALL) GROUP BY candidate_id) h USING (candidate_id)
      LEFT JOIN (SELECT candidate_id, count(*) AS m FROM inner_edge GROUP BY candidate_id) e USING (candidate_id)""",
    "halo": "SELECT DISTINCT m.candidate_id, a.v AS card_id FROM member m JOIN arc a ON a.u = m.card_id WHERE NOT EXISTS (SELECT 1 FROM member x WHERE x.candidate_id = m.candidate_id AND x.card_id = a.v)",
    "small_merchants": "SELECT * FROM small",
    "known_cards": "SELECT *, known < cards AS degraded FROM (SELECT candidate_id, count(*) AS cards, count(*) FILTER (card_id IN (SELECT card_id FROM txn WHERE card_id IS NOT NULL)) AS known FROM member GROUP BY candidate_id)",
    "role_profile": f"SELECT category, count(*) AS n, round(avg(CAST(amount < 10 AS INT)), 6) AS share_probe, round(quantile_cont(amount, 0.5), 6) AS median, max(amount) AS largest, min(amount) AS smallest, round(avg(vulcan_score), 6) AS mean_score FROM txn JOIN (SELECT merchant_id, max(category) AS category FROM (SELECT {sql_id('merchant_id', 'MERCH')} AS merchant_id, category FROM merchants) WHERE merchant_id IS NOT NULL AND category IS NOT NULL GROUP BY merchant_id) USING (merchant_id) WHERE amount IS NOT NULL GROUP BY category",
    "confusion_cost": "SELECT tp, fp, fn, tn, round(coalesce(fp / nullif(fp + tn, 0), 0), 6) AS fpr, round(coalesce(fn / nullif(fn + tp, 0), 0), 6) AS fnr, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(fn * 850000.0::DOUBLE + fp * 230000.0::DOUBLE, 6) AS cost FROM (SELECT count(*) FILTER (y = 1 AND p >= 0.5) AS tp, count(*) FILTER (y <> 1 AND p >= 0.5) AS fp, count(*) FILTER (y = 1 AND p < 0.5) AS fn, count(*) FILTER (y <> 1 AND p < 0.5) AS tn FROM pred)",
    "threshold_sweep": "SELECT step, threshold, tp, fp, fn, tn, round(cost, 6) AS cost, round(f1, 6) AS f1 FROM costed",
    "best_thresholds": "SELECT (SELECT threshold FROM costed ORDER BY cost, threshold LIMIT 1) AS cost_threshold, (SELECT round(min(cost), 6) FROM costed) AS least_cost, (SELECT threshold FROM costed ORDER BY f1 DESC, threshold LIMIT 1) AS f1_threshold, (SELECT round(max(f1), 6) FROM costed) AS best_f1",
    "cost_sensitivity": "SELECT ratio, threshold, round(cost, 6) AS cost FROM (SELECT *, row_number() OVER (PARTITION BY ratio ORDER BY cost, threshold) AS no FROM (SELECT threshold, ratio, fn * ratio + fp AS cost FROM swept, (SELECT unnest([1, 2, 3, 3.7, 5, 8, 12])::DOUBLE AS ratio))) WHERE no = 1",
    "ranking": """SELECT n.fold, n.n, n.positives, round(a.won / nullif(n.positives * (n.n - n.positives), 0), 6) AS roc_auc, round(b.ap / nullif(n.positives, 0), 6) AS average_precision
      FROM (SELECT fold, count(*) AS n, count(*) FILTER (y = 1) AS positives FROM pred GROUP BY fold) n
      LEFT JOIN (SELECT x.fold, sum(CASE WHEN x.p > z.p THEN 1.0 WHEN x.p = z.p THEN 0.5 ELSE 0 END) AS won FROM pred x JOIN pred z ON x.fold = z.fold AND x.y = 1 AND z.y <> 1 GROUP BY x.fold) a USING (fold)
      LEFT JOIN (SELECT fold, sum(pos * tp / seen) AS ap FROM (SELECT fold, pos, sum(pos) OVER w AS tp, sum(n) OVER w AS seen FROM (SELECT fold, p, count(*) FILTER (y = 1) AS pos, count(*) AS n FROM pred GROUP BY ALL) WINDOW w AS (PARTITION BY fold ORDER BY p DESC)) GROUP BY fold) b USING (fold)""",
    "latency": "SELECT event_type AS stage, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(max(value), 6) AS max, round(avg(value), 6) AS mean FROM events GROUP BY event_type",
    "signature_scaler": "SELECT pos, round(avg(c), 9) AS mean, round(stddev_pop(c), 9) AS std FROM (SELECT pos, sign(x) * ln(1 + abs(x)) AS c FROM (SELECT unnest(range(0, len(v))) AS pos, unnest(v) AS x FROM vec)) GROUP BY pos",
    "cosine_topk": "SELECT query_id, case_id, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, case_id) AS no FROM (SELECT q.vec_id AS query_id, c.vec_id AS case_id, round(list_cosine_similarity(q.v, c.v), 9) AS similarity FROM vec q, vec c WHERE q.vec_id % 20 = 0) WHERE similarity >= 0.1) WHERE no <= 3",
    "memory_adjustments": "SELECT q.vec_id AS query_id, max(CASE WHEN c.label = 0 AND s >= 0.3 THEN 0.15 ELSE 0 END)::DOUBLE AS boost, max(CASE WHEN c.label = 1 AND s >= 0.3 THEN 0.2 ELSE 0 END)::DOUBLE AS damp FROM (SELECT q.vec_id, c.label, round(list_cosine_similarity(q.v, c.v), 9) AS s FROM vec q, vec c WHERE q.vec_id % 20 = 0) x(vec_id, label, s) JOIN vec q USING (vec_id) JOIN (SELECT DISTINCT label FROM vec) c ON c.label = x.label GROUP BY q.vec_id",
    "latest_rows": "SELECT user_id, at_us, event_id, event_type FROM (SELECT user_id, epoch_us(ts) AS at_us, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC, event_type DESC) AS no FROM events) WHERE no = 1",
    "composite": "SELECT candidate_id, round(composite, 12) AS composite, round(plain, 12) AS plain, round(composite - plain, 12) AS delta, round(confidence, 12) AS confidence FROM scored",
    "alert_queue": "SELECT candidate_id, round(composite, 12) AS composite FROM scored ORDER BY round(composite, 12) DESC, candidate_id LIMIT 40",
    "evidence": "SELECT candidate_id, attribute, value, cards, no, citations FROM evidence_top JOIN evidence_ref USING (candidate_id, attribute, value)",
    "behavioural_evidence": "SELECT * FROM (" + " UNION ALL ".join(f"SELECT candidate_id, '{f}' AS claim, round({f}, 4) AS value FROM behave_all WHERE {f} {bar}" for f, bar in _CLAIMS) + ")",
    "dossier_quality": "SELECT candidate_id, count(*) AS claims, 0::BIGINT AS uncited, round(sum(refs) / count(*), 6) AS refs_per_claim FROM evidence_top JOIN evidence_ref USING (candidate_id, attribute, value) GROUP BY candidate_id",
    "rolling_bursts": "SELECT start_s, card_id, count(*) AS n, round(sum(amount), 6) AS total, round(max(amount), 6) AS most FROM (SELECT (floor(epoch_us(timestamp) / 60000000)::BIGINT - k) * 60 AS start_s, card_id, amount FROM txn, range(0, 5) r(k) WHERE card_id IS NOT NULL AND timestamp IS NOT NULL) GROUP BY ALL",
}
PARTS["all_part"] = "SELECT card_id, min(component) AS m FROM whole_part GROUP BY card_id"
PARTS["whole_reach"] = "SELECT u AS s, u AS t FROM arc UNION SELECT r.s, a.v FROM whole_reach r JOIN arc a ON a.u = r.t"
PARTS["whole_part"] = "SELECT s AS card_id, min(t) AS component FROM whole_reach GROUP BY s"
PARTS["inner_degree"] = "SELECT candidate_id, u, count(*) AS d FROM inner_arc GROUP BY ALL"
PARTS["triangle"] = "SELECT x.candidate_id, x.card_a AS a, x.card_b AS b, y.card_b AS c FROM inner_edge x JOIN inner_edge y ON x.candidate_id = y.candidate_id AND x.card_b = y.card_a JOIN inner_edge z ON z.candidate_id = x.candidate_id AND z.card_a = x.card_a AND z.card_b = y.card_b"
PARTS["closed"] = "SELECT candidate_id, u, count(*) AS t FROM (SELECT candidate_id, unnest([a, b, c]) AS u FROM triangle) GROUP BY ALL"
PARTS["local_c"] = "SELECT candidate_id, u, CASE WHEN d > 1 THEN 2 * coalesce(t, 0) / (d * (d - 1)) ELSE 0 END AS c FROM inner_degree LEFT JOIN closed USING (candidate_id, u)"

PARTS["set_card"] = "SELECT candidate_id, card_id, n FROM ego_card UNION ALL SELECT 'cc:' || CAST(floor AS VARCHAR) || ':' || component, card_id, count(*) OVER (PARTITION BY floor, component) FROM part"
PARTS["set_pair"] = QUERIES["jaccard_pairs"]
PARTS["set_rank"] = "SELECT candidate_id, row_number() OVER (ORDER BY CASE WHEN candidate_id LIKE 'ego:%' THEN 0 ELSE 1 END, max(n) DESC, candidate_id) AS no FROM set_card WHERE n BETWEEN 2 AND 60 GROUP BY candidate_id"
PARTS["rival"] = "SELECT greatest(x.no, y.no) AS later, list(least(x.no, y.no) ORDER BY least(x.no, y.no)) AS ahead FROM set_pair p JOIN set_rank x ON x.candidate_id = p.candidate_a JOIN set_rank y ON y.candidate_id = p.candidate_b GROUP BY 1"
PARTS["greedy"] = "SELECT 0::BIGINT AS i, []::BIGINT[] AS kept UNION ALL SELECT g.i + 1, CASE WHEN r.ahead IS NOT NULL AND list_has_any(g.kept, r.ahead) THEN g.kept ELSE list_append(g.kept, g.i + 1) END FROM greedy g LEFT JOIN rival r ON r.later = g.i + 1 WHERE g.i < (SELECT count(*) FROM set_rank)"
PARTS["chosen"] = "SELECT kept FROM greedy ORDER BY i DESC LIMIT 1"
PARTS["entry"] = "SELECT vec_id, unnest(range(0, len(v))) AS pos, unnest(list_transform(v, lambda x: sign(x) * ln(1 + abs(x)))) AS x FROM vec"
PARTS["entry_scale"] = "SELECT pos, avg(x) AS mean, CASE WHEN stddev_pop(x) > 1e-9 THEN stddev_pop(x) ELSE 1 END AS std FROM entry GROUP BY pos"
PARTS["entry_z"] = "SELECT vec_id, pos, (x - mean) / std AS z FROM entry JOIN entry_scale USING (pos)"
PARTS["cosine_step"] = "SELECT CAST(floor(round(list_cosine_similarity(q.v, c.v), 9) * 500) AS BIGINT) AS step FROM vec q, vec c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id"
PARTS["named_event"] = "SELECT kind, id, timestamp, amount FROM (SELECT 'card_id' AS kind, card_id AS id, timestamp, amount FROM txn UNION ALL SELECT 'device_fingerprint', device_fingerprint, timestamp, amount FROM txn UNION ALL SELECT 'ip_address', ip_address, timestamp, amount FROM txn UNION ALL SELECT 'email_hash', email_hash, timestamp, amount FROM txn) WHERE id IS NOT NULL AND timestamp IS NOT NULL"
PARTS["sourced"] = "SELECT candidate_id, card_id, source FROM member JOIN (SELECT candidate_id, min(source) AS source FROM candidates GROUP BY candidate_id) USING (candidate_id)"
QUERIES |= {
    "dedup_plain": "SELECT candidate_id, list_contains(kept, no) AS kept, CASE WHEN NOT list_contains(kept, no) THEN (SELECT y.candidate_id FROM set_rank y WHERE y.no = list_filter(ahead, lambda a: list_contains(kept, a))[1]) END AS merged_into FROM set_rank LEFT JOIN rival ON later = no, chosen",
    "vertices": "SELECT card_id, coalesce(any_value(world_id), -1)::BIGINT AS world_id, count(*) AS n_transactions, coalesce(any_value(degree), 0) AS degree FROM txn LEFT JOIN card_world USING (card_id) LEFT JOIN degree USING (card_id) WHERE card_id IS NOT NULL GROUP BY card_id",
    "missed_sets": "SELECT DISTINCT ref_id FROM ref WHERE ref_id NOT IN (SELECT ref_id FROM overlap WHERE c * 2 > size)",
    "size_distribution": "SELECT source, n_cards, count(*) AS n FROM (SELECT candidate_id, source, count(*) AS n_cards FROM sourced GROUP BY ALL) GROUP BY ALL",
    "slice_merchants": """SELECT candidate_id, coalesce(string_agg(DISTINCT merchant_id, ',' ORDER BY merchant_id) FILTER (kind = 'probe'), '') AS probe_merchants, coalesce(string_agg(DISTINCT merchant_id, ',' ORDER BY merchant_id) FILTER (kind = 'cashout'), '') AS cashout_merchants FROM (
      SELECT candidate_id, merchant_id, CASE WHEN no <= 20 THEN kind END AS kind FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id, kind ORDER BY card_id, ts, transaction_id) AS no FROM (SELECT *, CASE WHEN amount < 10 THEN 'probe' WHEN amount > 10000 THEN 'cashout' END AS kind FROM slice1))) GROUP BY candidate_id""",
    "prior_shift": "SELECT n AS rows, round(one * n, 6) AS cost, round(one * 1000, 6) AS per_1k FROM (SELECT count(*) AS n, 0.98::DOUBLE * count(*) FILTER (y <> 1 AND p >= 0.5) / count(*) FILTER (y <> 1) * 230000.0 + 0.02::DOUBLE * count(*) FILTER (y = 1 AND p < 0.5) / count(*) FILTER (y = 1) * 850000.0 AS one FROM pred)",
    "top_false_positive": "SELECT vec_id, p FROM (SELECT vec_id, CAST(label % 2 AS INT) AS y, round(0.5 + 0.45 * CAST(embedding[label % 8 + 1] AS DOUBLE), 3) AS p FROM embeddings WHERE label IS NOT NULL) WHERE y = 0 ORDER BY p DESC, vec_id LIMIT 1",
    "signatures": "SELECT vec_id, round(max(z / size) FILTER (pos = 0), 6) AS first, round(sum(z / size), 6) AS total FROM entry_z JOIN (SELECT vec_id, sqrt(sum(z * z)) AS size FROM entry_z GROUP BY vec_id) USING (vec_id) GROUP BY vec_id",
    "similarity_summary": "SELECT count(*) AS pairs, round(quantile_disc(step, 0.5) / 500, 6) AS p50, round(quantile_disc(step, 0.95) / 500, 6) AS p95, round(avg(CASE WHEN step >= 150 THEN 1.0::DOUBLE ELSE 0 END), 6) AS share_near FROM cosine_step",
    "dossier_corpus": f"SELECT count(*) AS dossiers, sum(claims)::BIGINT AS claims, 0::BIGINT AS uncited, round(avg(refs_per_claim), 6) AS refs_per_claim FROM ({QUERIES['dossier_quality']})",
    "hourly_velocity": "SELECT start_s, kind, id, count(*) AS n, round(sum(amount), 6) AS total FROM (SELECT (floor(epoch_us(timestamp) / 300000000)::BIGINT - k) * 300 AS start_s, kind, id, amount FROM named_event, range(0, 12) r(k)) GROUP BY ALL",
    "daily_escalation": "SELECT start_s, kind, id, count(*) AS n, round(coalesce(max(amount) / nullif(min(amount), 0), 1), 6) AS escalation FROM (SELECT (floor(epoch_us(timestamp) / 3600000000)::BIGINT - k) * 3600 AS start_s, kind, id, amount FROM named_event, range(0, 24) r(k)) GROUP BY ALL",
    "gbt_folds": f"SELECT world_id AS fold, count(*) AS n, sum(is_match)::BIGINT AS positives FROM ({QUERIES['candidate_world']}) JOIN ({QUERIES['candidate_labels']}) USING (candidate_id) GROUP BY world_id",
}
_STRUCT = ["cand_size", "cand_density", "cand_avg_degree", "cand_clustering_coeff", "cand_expansion", "cand_cut_ratio", "cand_modularity_contribution"]
_IDENT = ["n_unique_devices", "n_unique_ips", "n_unique_emails", "max_device_reuse", "max_ip_reuse", "max_email_reuse", "device_to_card_ratio", "ip_to_card_ratio", "cand_ego_overlap_ratio"]
QUERIES["features"] = f"""SELECT c.candidate_id, {", ".join(f"coalesce(nullif(round(CASE WHEN k.candidate_id IS NULL THEN 0 ELSE CAST({x} AS DOUBLE) END, 5), 0), 0) AS {y}" for x, y in [*((x, x) for x in [*_STRUCT, *_IDENT, *_BEHAVE, "amount_entropy"]), ("h.n_components", "cand_num_components"), ("h.diameter", "cand_diameter")])}
    FROM csize c LEFT JOIN (SELECT DISTINCT candidate_id FROM crow) k USING (candidate_id) LEFT JOIN ({QUERIES["structural_features"]}) s USING (candidate_id) LEFT JOIN ({QUERIES["hop_shape"]}) h USING (candidate_id)
    LEFT JOIN ({QUERIES["identity_features"].replace(", 6)", ", 12)")}) i USING (candidate_id) LEFT JOIN ({QUERIES["behavioural_features"]}) b USING (candidate_id) LEFT JOIN ({QUERIES["amount_entropy"].replace("FROM crow", "FROM slice3")}) e USING (candidate_id)"""
#: Parts a recursion reads in every step.
_KEPT = {"rival", "set_rank"}


def _needed(sql: str, seen: list[str], above: tuple[str, ...] = ()) -> list[str]:
    """Names of the parts that sql reads, each after what it reads itself; a part's own name in it is no need."""
    for name in PARTS:
        if name not in seen and name not in above and re.search(rf"(?:FROM|JOIN|,)\s+{name}\b", sql):
            _needed(PARTS[name], seen, (*above, name))
            if name not in seen:
                seen.append(name)
    return seen


def oracle_sql() -> dict[str, str]:
    out = {}
    for key, body in QUERIES.items():
        parts = _needed(body, [])
        ctes = [f"{p} AS {'MATERIALIZED ' if p in _KEPT else ''}({PARTS[p]})" for p in parts]
        if any(re.search(r"\btxn\b", x) for x in [body, *ctes]):
            ctes.insert(0, sql_txn())
        out[key] = ("WITH RECURSIVE " + ",\n    ".join(ctes) + "\n    " if ctes else "") + body
    return out
