"""Cited evidence about candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Feature bars over which a behavioural claim is made.
BARS = {"probe_fraction": 0.05, "cashout_fraction": 0.02, "amount_escalation": 50.0, "burst_compression": 0.3, "small_merchant_concentration": 0.2}


def graph_evidence(inner: DataFrame, top: int = 6, support: int = 5) -> DataFrame:
    """(candidate_id, attribute, value, cards, no, citations): the top shared values by cards linked, with up to `support` edge citations each. inner: candidate_id, card_a, card_b, attribute, value."""
    ends = inner.select("candidate_id", "attribute", "value", F.explode(F.array("card_a", "card_b")).alias("card")).distinct()
    counts = ends.groupBy("candidate_id", "attribute", "value").agg(F.count(F.lit(1)).alias("cards"))
    w = Window.partitionBy("candidate_id").orderBy(F.desc("cards"), "attribute", "value")
    best = counts.withColumn("no", F.row_number().over(w)).where(F.col("no") <= top)
    e = Window.partitionBy("candidate_id", "attribute", "value").orderBy("card_a", "card_b")
    cited = inner.withColumn("k", F.row_number().over(e)).where(F.col("k") <= support)
    text = F.format_string("edge:%s~%s:%s=%s", "card_a", "card_b", "attribute", "value")
    refs = cited.groupBy("candidate_id", "attribute", "value").agg(F.array_join(F.array_sort(F.collect_list(text)), ";").alias("citations"))
    return best.join(refs, ["candidate_id", "attribute", "value"])


def behavioural_evidence(features: DataFrame) -> DataFrame:
    """(candidate_id, claim, citation_id, value): one row for each feature over its bar, and the probe gap where there is one."""
    claims = [F.when(F.col(f) > bar, F.struct(F.lit(f).alias("claim"), F.format_string(f"feature:{f}=%.4f", F.col(f)).alias("citation_id"), F.col(f).alias("value"))) for f, bar in BARS.items()]
    f = "probe_to_cashout_gap_hours"
    claims.append(F.when(F.col(f) >= 0, F.struct(F.lit(f).alias("claim"), F.format_string(f"feature:{f}=%.4f", F.col(f)).alias("citation_id"), F.col(f).alias("value"))))
    return features.select("candidate_id", F.explode(F.array_compact(F.array(*claims))).alias("c")).select("candidate_id", "c.*")


def _listed(c: str, most: int):
    """How many of the first `most` ids a comma list has."""
    return F.when(F.coalesce(c, F.lit("")) == "", 0).otherwise(F.least(F.size(F.split(c, ",")), F.lit(most)))


def supported(behavioural: DataFrame, meta: DataFrame) -> DataFrame:
    """behavioural evidence as (candidate_id, claim, citation_id, supports): the transactions and merchants of features.meta behind each claim. An escalation is cited by its first transaction."""
    pair = F.concat_ws(",", *[F.nullif(F.concat_ws(",", F.slice(F.split(c, ","), 1, 2)), F.lit("")) for c in ("probe_ids", "cashout_ids")])
    full = behavioural.join(meta.select("candidate_id", "probe_ids", "cashout_ids", "probe_merchants", pair.alias("both")), "candidate_id", "left")
    claim = F.col("claim")
    supports = F.when(claim == "probe_fraction", _listed("probe_ids", 4)).when(claim == "cashout_fraction", _listed("cashout_ids", 4)).when(claim == "amount_escalation", F.greatest(_listed("both", 4) - 1, F.lit(0))).when(claim == "burst_compression", 2).when(claim == "probe_to_cashout_gap_hours", _listed("probe_ids", 1) + _listed("cashout_ids", 1)).otherwise(_listed("probe_merchants", 3))
    first = F.when((claim == "amount_escalation") & (F.coalesce("both", F.lit("")) != ""), F.concat(F.lit("txn:"), F.element_at(F.split("both", ","), 1))).otherwise(F.col("citation_id"))
    return full.select("candidate_id", "claim", first.alias("citation_id"), supports.alias("supports"))


def structural_evidence(features: DataFrame) -> DataFrame:
    """(candidate_id, claim, citation_id, supports): size and density of each candidate, backed by size, ego overlap and clustering."""
    return features.select("candidate_id", F.lit("cand_density").alias("claim"), F.format_string("feature:cand_density=%.4f", F.col("cand_density").cast("double")).alias("citation_id"), F.lit(3).alias("supports"))


def score_evidence(scored: DataFrame, meta: DataFrame) -> DataFrame:
    """(candidate_id, claim, citation_id, supports): the upstream score of each row of scoring.scored, backed by its own score and up to two cashouts."""
    full = scored.join(meta.select("candidate_id", "cashout_ids"), "candidate_id", "left")
    return full.select("candidate_id", F.lit("composite").alias("claim"), F.format_string("vulcan:%.4f", F.coalesce("upstream", F.lit(0.0))).alias("citation_id"), (1 + _listed("cashout_ids", 2)).alias("supports"))


def memory_evidence(fraud: DataFrame, false: DataFrame, top: int = 2) -> DataFrame:
    """(candidate_id, claim, citation_id, supports): the `top` nearest confirmed rings and false positives of memory.nearest, each with its disposition."""
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "case_id")
    of = lambda near, claim: near.withColumn("no", F.row_number().over(w)).where(F.col("no") <= top).select(F.col("query_id").alias("candidate_id"), F.lit(claim).alias("claim"), F.concat(F.lit("case:"), F.col("case_id").cast("string")).alias("citation_id"), F.lit(1).alias("supports"))
    return of(fraud, "precedent").unionByName(of(false, "false_positive"))


def assemble(graph: DataFrame, *others: DataFrame) -> DataFrame:
    """(candidate_id, claim, citation_id, supports) of graph_evidence and the other kinds; an uncited claim fails the job."""
    refs = F.split("citations", ";")
    out = graph.select("candidate_id", F.concat_ws("=", "attribute", "value").alias("claim"), F.element_at(refs, 1).alias("citation_id"), (F.size(refs) - 1).alias("supports"))
    for x in others:
        out = out.unionByName(x)
    return reject_uncited(out)


def reject_uncited(evidence: DataFrame) -> DataFrame:
    """The evidence; blank citations fail the job, which names up to three of a candidate's claims."""
    blank = F.coalesce(F.trim("citation_id"), F.lit("")) == ""
    bad = evidence.where(blank).withColumn("no", F.row_number().over(Window.partitionBy("candidate_id").orderBy("claim"))).where("no <= 3")
    named = bad.groupBy("candidate_id").agg(F.array_join(F.array_sort(F.collect_list(F.coalesce("claim", F.lit("?")))), ", ").alias("bad"))
    full = evidence.join(named, "candidate_id", "left")
    checked = F.when(F.col("bad").isNotNull(), F.raise_error(F.concat(F.lit("claim without citation: "), "bad"))).otherwise(F.col("citation_id"))
    return full.withColumn("citation_id", checked).select(*evidence.columns)


def quality(evidence: DataFrame) -> DataFrame:
    """(candidate_id, claims, uncited, refs_per_claim) of (candidate_id, claim, citation_id, supports): own citation and supports over claims."""
    blank = F.coalesce(F.trim("citation_id"), F.lit("")) == ""
    return evidence.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("claims"), F.count_if(blank).alias("uncited"), (F.sum(F.when(blank, 0).otherwise(1) + F.coalesce("supports", F.lit(0))) / F.count(F.lit(1))).alias("refs_per_claim"))


def summary(rows: DataFrame) -> DataFrame:
    """One sentence per candidate from cand_size, n_transactions and composite."""
    return rows.select("candidate_id", F.format_string("%d linked cards with %d transactions; composite score %.2f.", "cand_size", "n_transactions", "composite").alias("summary"))


def corpus_quality(measured: DataFrame) -> DataFrame:
    """One row (dossiers, claims, uncited, refs_per_claim) over all rows of quality(); refs_per_claim is the mean of the dossiers'."""
    return measured.agg(F.count(F.lit(1)).alias("dossiers"), F.coalesce(F.sum("claims"), F.lit(0)).alias("claims"), F.coalesce(F.sum("uncited"), F.lit(0)).alias("uncited"), F.avg("refs_per_claim").alias("refs_per_claim"))


def by_kind(evidence: DataFrame) -> DataFrame:
    """(kind, claims, supports): assembled evidence by the kind of its citation, the part before its colon."""
    return evidence.groupBy(F.substring_index("citation_id", ":", 1).alias("kind")).agg(F.count(F.lit(1)).alias("claims"), F.coalesce(F.sum("supports"), F.lit(0)).alias("supports"))


def elevation(rows: DataFrame) -> DataFrame:
    """(candidate_id, text): a sentence on how far the own score raises the upstream one, of scoring.scored rows."""
    text = F.format_string("Upstream score %.2f, own score %.2f: together %.2f without and %.2f with case memory.", *[F.coalesce(c, F.lit(0.0)).cast("double") for c in ("upstream", "own", "plain", "composite")])
    return rows.select("candidate_id", text.alias("text"))
