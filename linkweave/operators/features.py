"""Candidate features: identity, behavioural, structural. Unknown or empty candidates get 0 in every column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkweave.operators import graph
from linkweave.operators.identity import ATTRIBUTES
from linkweave.plans.durable import Scratch

#: Strict amount bounds, small-merchant ticket, burst window, entropy bins.
PROBE_BELOW, CASHOUT_ABOVE, SMALL_TICKET, BURST_S, ENTROPY_BINS = 10.0, 10_000.0, 50.0, 300, 12

STRUCTURAL = ("cand_size", "cand_density", "cand_avg_degree", "cand_clustering_coeff", "cand_num_components", "cand_expansion", "cand_cut_ratio", "cand_modularity_contribution", "cand_ego_overlap_ratio", "cand_diameter")
IDENTITY = ("n_unique_devices", "n_unique_ips", "n_unique_emails", "max_device_reuse", "max_ip_reuse", "max_email_reuse", "device_to_card_ratio", "ip_to_card_ratio")
BEHAVIOURAL = ("probe_fraction", "amount_escalation", "burst_compression", "small_merchant_concentration", "time_span_hours", "velocity_txn_per_hour", "cashout_fraction", "probe_to_cashout_gap_hours", "merchant_diversity", "geo_spread", "amount_entropy", "night_fraction", "weekend_fraction")


#: Columns of a transaction that features are made of.
READ = ("card_id", "merchant_id", "amount", "timestamp", "ts", *ATTRIBUTES)


def gather(members: DataFrame, txn: DataFrame) -> DataFrame:
    """(candidate_id, transaction columns): all transactions of each candidate's cards. members is distinct (candidate_id, card_id)."""
    return members.join(txn, "card_id")


def shared_values(rows: DataFrame) -> DataFrame:
    """(candidate_id, attribute, value, cards): values used by two or more cards of the candidate."""
    long = rows.select("candidate_id", "card_id", F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).alias("value")) for a in ATTRIBUTES])).alias("e")).where("e.value IS NOT NULL").select("candidate_id", "e.attribute", "e.value", "card_id")
    return long.distinct().groupBy("candidate_id", "attribute", "value").agg(F.count(F.lit(1)).alias("cards")).where("cards > 1")


def shared_slice(rows: DataFrame, shared: DataFrame, attributes: tuple[str, ...] = ATTRIBUTES) -> DataFrame:
    """The rows on a shared value of one of the attributes; all rows of candidates where that leaves none."""
    out, hits = rows, []
    for a in attributes:
        flag = shared.where(F.col("attribute") == a).select("candidate_id", F.col("value").alias(a), F.lit(True).alias(f"hit_{a}"))
        out = out.join(flag, ["candidate_id", a], "left")
        hits.append(F.coalesce(f"hit_{a}", F.lit(False)))
    hit = hits[0]
    for h in hits[1:]:
        hit = hit | h
    # a shared value stands in some row of its candidate
    some = shared.where(F.col("attribute").isin(*attributes)).select("candidate_id").distinct().withColumn("some", F.lit(True))
    return out.withColumn("hit", hit).join(some, "candidate_id", "left").where("hit OR some IS NULL").select(*rows.columns)


def marked_slice(rows: DataFrame) -> DataFrame:
    """rows with sliced: whether shared_slice() on shared_values() has the row, found in one exchange, by candidate: a value is shared where its first card isn't its last."""
    out, hits = rows.repartition("candidate_id"), []
    for a in ATTRIBUTES:
        w = Window.partitionBy("candidate_id", a)
        out = out.withColumn(f"hit_{a}", F.col(a).isNotNull() & (F.min("card_id").over(w) != F.max("card_id").over(w)))
        hits.append(F.col(f"hit_{a}"))
    out = out.withColumn("sliced", F.greatest(*hits))
    some = F.max("sliced").over(Window.partitionBy("candidate_id"))
    return out.withColumn("sliced", F.col("sliced") | ~some).select(*rows.columns, "sliced")


def identity_features(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Distinct devices, addresses and mailboxes, the most cards on one of each, and ratios to the candidate's size n (sizes: candidate_id, n)."""
    long = rows.select("candidate_id", "card_id", F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).alias("value")) for a in ATTRIBUTES])).alias("e")).where("e.value IS NOT NULL").select("candidate_id", "e.attribute", "e.value", "card_id")
    per = long.distinct().groupBy("candidate_id", "attribute", "value").agg(F.count(F.lit(1)).alias("cards"))
    short = {"device_fingerprint": "device", "ip_address": "ip", "email_hash": "email"}
    picks = []
    for a, s in short.items():
        mine = F.col("attribute") == a
        picks += [F.count_if(mine).alias(f"n_unique_{s}s"), F.coalesce(F.max(F.when(mine, F.col("cards"))), F.lit(0)).alias(f"max_{s}_reuse")]
    shared = F.coalesce(F.max(F.when(F.col("cards") > 1, F.col("cards"))), F.lit(0))
    wide = sizes.join(per.groupBy("candidate_id").agg(*picks, shared.alias("covered")), "candidate_id", "left").fillna(0)
    return wide.select("candidate_id", *[f"n_unique_{s}s" for s in short.values()], *[f"max_{s}_reuse" for s in short.values()], (F.col("n_unique_devices") / F.col("n")).alias("device_to_card_ratio"), (F.col("n_unique_ips") / F.col("n")).alias("ip_to_card_ratio"), (F.col("covered") / F.col("n")).alias("cand_ego_overlap_ratio"))


def small_merchants(merchants: DataFrame, txn: DataFrame | None = None) -> DataFrame:
    """(merchant_id, small): average ticket under the bound, from the dimension or, without one, from observed amounts; unknown is not small."""
    if merchants is None:
        merchants = txn.groupBy("merchant_id").agg(F.avg("amount").alias("avg_ticket"))
    return merchants.where("merchant_id IS NOT NULL").select("merchant_id", F.coalesce(F.col("avg_ticket") < SMALL_TICKET, F.lit(False)).alias("small"))


def burst(rows: DataFrame, key: str = "candidate_id", seconds: int = BURST_S) -> DataFrame:
    """(key, densest, n): most rows within any window of so many seconds, both ends included, and all rows with a time.

    Rows are counted per second first; a window that starts in one stretch of so
    many seconds ends in the next at the latest, so a key is split by stretches,
    each seen together with the next one.
    """
    stretch = F.floor(F.col("ts") / seconds)
    each = rows.where("ts IS NOT NULL").groupBy(key, "ts").agg(F.count(F.lit(1)).alias("c"))
    twice = each.withColumn("part", F.explode(F.array(stretch, stretch - 1)))
    w = Window.partitionBy(key, "part").orderBy("ts").rangeBetween(0, seconds)
    starts = twice.withColumn("dense", F.sum("c").over(w)).where(F.col("part") == stretch)
    return starts.groupBy(key).agg(F.max("dense").alias("densest"), F.sum("c").alias("n"))


def _amount_ends() -> list[Column]:
    """Aggregates: the smallest and the largest amount on the scale of the entropy's bins."""
    x = F.greatest("amount", F.lit(0.01))
    return [F.log10(F.min(x)).alias("lo"), F.log10(F.max(x) + 1e-6).alias("hi")]


def _bin() -> Column:
    """The entropy's bin of amount between lo and hi; null without an amount."""
    place = F.floor(F.round((F.log10(F.greatest("amount", F.lit(0.01))) - F.col("lo")) / (F.col("hi") - F.col("lo")) * ENTROPY_BINS, 9))
    return F.when(F.col("amount").isNotNull(), F.least(F.greatest(place, F.lit(0)), F.lit(ENTROPY_BINS - 1)))


def _bits() -> Column:
    """Entropy of the bins' counts c, -sum p log2 p = log2 N - sum c log2 c / N; rows without a bin don't count."""
    c = F.when(F.col("bin").isNotNull(), F.col("c"))
    return F.log2(F.sum(c)) - F.sum(c * F.log2(c)) / F.sum(c)


def entropy(rows: DataFrame) -> DataFrame:
    """(candidate_id, amount_entropy): bits over 12 log-spaced bins from the smallest amount to the largest + 1e-6; amounts up to 0 count as 0.01."""
    r = rows.where("amount IS NOT NULL").select("candidate_id", "amount")
    ends = r.groupBy("candidate_id").agg(*_amount_ends())
    bins = r.join(ends, "candidate_id").groupBy("candidate_id", _bin().alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    return bins.groupBy("candidate_id").agg(_bits().alias("amount_entropy"))


def probe_gap(rows: DataFrame) -> DataFrame:
    """(candidate_id, gap_h): hours from the first probe to the first cashout strictly after it, -1 if there is none."""
    r = rows.where("ts IS NOT NULL AND amount IS NOT NULL").select("candidate_id", "ts", "amount")
    first = r.groupBy("candidate_id").agg(F.min(F.when(F.col("amount") < PROBE_BELOW, F.col("ts"))).alias("probe"))
    after = r.where(F.col("amount") > CASHOUT_ABOVE).join(first, "candidate_id").where("ts > probe").groupBy("candidate_id", "probe").agg(F.min("ts").alias("cashout"))
    return first.join(after.select("candidate_id", ((F.col("cashout") - F.col("probe")) / 3600).alias("gap")), "candidate_id", "left").select("candidate_id", F.coalesce("gap", F.lit(-1.0)).alias("gap_h"))


def behavioural_features(rows: DataFrame, small: DataFrame) -> DataFrame:
    """The 13 behavioural columns per candidate over the rows given (the shared slice); a null amount or time satisfies no condition."""
    hit = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    amount = F.col("amount")
    # per merchant first: it is what the merchants are counted by, and small
    shops = rows.groupBy("candidate_id", "merchant_id").agg(
        F.count(F.lit(1)).alias("n"), hit(amount < PROBE_BELOW).alias("probes"), hit(amount > CASHOUT_ABOVE).alias("cashouts"),
        F.min("amount").alias("least"), F.max("amount").alias("most"), F.min("ts").alias("first"), F.max("ts").alias("last"),
        hit(F.hour("timestamp") < 6).alias("night"), hit(F.weekday("timestamp") >= 5).alias("weekend"),
        F.min(F.when(amount < PROBE_BELOW, F.col("ts"))).alias("probe"),
    )
    per = shops.join(small, "merchant_id", "left").withColumn("small", F.when(F.coalesce("small", F.lit(False)), F.col("n")).otherwise(0))
    nets = rows.groupBy("candidate_id", F.substring_index("ip_address", ".", 3).alias("net")).agg(F.lit(1)).groupBy("candidate_id").agg(F.count("net").alias("nets"))
    span, n = (F.max("last") - F.min("first")) / 3600, F.sum("n")
    main = per.groupBy("candidate_id").agg(
        (F.sum("probes") / n).alias("probe_fraction"),
        F.coalesce(F.max("most") / F.nullif(F.min("least"), F.lit(0.0)), F.lit(1.0)).alias("amount_escalation"),
        (F.sum("small") / n).alias("small_merchant_concentration"),
        F.coalesce(span, F.lit(0.0)).alias("time_span_hours"),
        (n / F.greatest(F.coalesce(span, F.lit(0.0)), F.lit(1e-6))).alias("velocity_txn_per_hour"),
        (F.sum("cashouts") / n).alias("cashout_fraction"),
        (F.count("merchant_id") / n).alias("merchant_diversity"),
        (F.sum("night") / n).alias("night_fraction"),
        (F.sum("weekend") / n).alias("weekend_fraction"),
        n.alias("n"), F.min("probe").alias("probe"), F.log10(F.greatest(F.min("least"), F.lit(0.01))).alias("lo"), F.log10(F.greatest(F.max("most"), F.lit(0.01)) + 1e-6).alias("hi"),
    )
    main = main.join(nets, "candidate_id").withColumn("geo_spread", F.col("nets") / F.col("n"))
    main = Scratch(rows.sparkSession).write(main, "main")
    # one more reading finds the bins between each candidate's ends and the first cashout after its first probe
    later = F.when((amount > CASHOUT_ABOVE) & (F.col("ts") > F.col("probe")), F.col("ts"))
    bins = rows.select("candidate_id", "amount", "ts").join(main.select("candidate_id", "lo", "hi", "probe"), "candidate_id").groupBy("candidate_id", "probe", _bin().alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.min(later).alias("cashout"))
    rest = bins.groupBy("candidate_id", "probe").agg(_bits().alias("amount_entropy"), F.min("cashout").alias("cashout")).select("candidate_id", "amount_entropy", ((F.col("cashout") - F.col("probe")) / 3600).alias("probe_to_cashout_gap_hours"))
    dense = burst(rows).select("candidate_id", (F.col("densest") / F.col("n")).alias("burst_compression"))
    out = main.join(dense, "candidate_id", "left").join(rest, "candidate_id", "left")
    return out.fillna(-1.0, ["probe_to_cashout_gap_hours"]).fillna(0.0).select("candidate_id", *BEHAVIOURAL)


def features(members: DataFrame, txn: DataFrame, small: DataFrame, edges: DataFrame, n_vertices: int, n_edges: int) -> DataFrame:
    """One row per candidate with all 31 columns as doubles."""
    scratch = Scratch(members.sparkSession)
    # read by several branches: written once, with the time once
    carried = [c for c in READ if c != "timestamp"]
    rows = scratch.write(marked_slice(gather(members, txn).select("candidate_id", *carried)), "rows")
    slice_ = rows.where("sliced").withColumn("timestamp", F.timestamp_seconds("ts"))
    sizes = members.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("n"))
    known = rows.select("candidate_id").distinct()
    ident = identity_features(rows, sizes)
    behave = behavioural_features(slice_, small)
    struct = graph.structure(members, edges, n_vertices, n_edges)
    wide = known.join(struct, "candidate_id").join(ident, "candidate_id").join(behave, "candidate_id")
    names = (*STRUCTURAL, *IDENTITY, *BEHAVIOURAL)
    full = sizes.select("candidate_id").join(wide, "candidate_id", "left")
    return full.select("candidate_id", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names])


def meta(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """Per candidate over its device slice: transactions, score mean and maximum, mean score of cashouts, window, amounts, the first 5 probe and cashout ids by card, time and id, the merchants of the first 20, up to 10 shared devices."""
    r = shared_slice(rows, shared, ("device_fingerprint",))
    probe, cash = F.col("amount") < PROBE_BELOW, F.col("amount") > CASHOUT_ABOVE
    w = Window.partitionBy("candidate_id", "kind").orderBy("card_id", "ts", "transaction_id")
    kinds = r.withColumn("kind", F.when(probe, "probe").when(cash, "cashout")).where("kind IS NOT NULL").withColumn("no", F.row_number().over(w)).where("no <= 20")
    places = [F.array_join(F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("merchant_id")))), ",").alias(f"{k}_merchants") for k in ("probe", "cashout")]
    ids = kinds.groupBy("candidate_id").agg(*places, *[F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("kind") == k) & (F.col("no") <= 5), F.struct("no", "transaction_id")))), lambda x: x["transaction_id"]), ",").alias(f"{k}_ids") for k in ("probe", "cashout")])
    top = shared.where("attribute = 'device_fingerprint'").groupBy("candidate_id").agg(F.array_join(F.slice(F.array_sort(F.collect_set("value")), 1, 10), ",").alias("shared_devices"))
    base = r.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("n_transactions"), F.avg("vulcan_score").alias("score_mean"), F.max("vulcan_score").alias("score_max"), F.avg(F.when(cash, F.col("vulcan_score"))).alias("score_cashout_mean"), F.min("amount").alias("min_amount"), F.max("amount").alias("max_amount"), F.min("ts").alias("window_start"), F.max("ts").alias("window_end"))
    return base.join(ids, "candidate_id", "left").join(top, "candidate_id", "left").fillna("", ["probe_ids", "cashout_ids", "probe_merchants", "cashout_merchants", "shared_devices"])


def timeline(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """The device and address slice with a tag: probe, cashout or other."""
    r = shared_slice(rows, shared, ("device_fingerprint", "ip_address"))
    return r.withColumn("tag", F.when(F.col("amount") < PROBE_BELOW, "probe").when(F.col("amount") > CASHOUT_ABOVE, "cashout").otherwise("other"))
