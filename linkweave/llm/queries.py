"""Queries over the project's tables for the operators of this package, and their SQL."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.functions.ids import id_text
from linkweave.llm import bpe_trie, cooccurrence, hash_to_min, leaks, links, random_mate, sketch_forest, truncation
from linkweave.plans.durable import materialize
from linkweave.sources.tables import live, table

SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}
SIMILAR = Fraction(3, 5)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = links.card_links(table(spark, d, "candidates"), table(spark, d, "identity_groups"))
    groups = hash_to_min.hash_to_min(pairs)
    return groups.select(id_text("vertex", "CARD").alias("card_id"), id_text("group", "CARD").alias("group_id"))


def _candidate_groups(spark: SparkSession, d: str) -> DataFrame:
    return random_mate.bound_groups(links.candidate_keys(table(spark, d, "candidates")), "candidate_id", "key")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _candidate_groups(spark, d).select("candidate_id", F.col("group").alias("group_id"))


def p5_splits(spark: SparkSession, d: str) -> DataFrame:
    """(candidate_id, split) of every candidate."""
    groups = _candidate_groups(spark, d)
    return groups.join(random_mate.split_groups(groups, "group", SHARES), "group").select("candidate_id", "split")


def p5_balance(spark: SparkSession, d: str) -> DataFrame:
    """(candidates, divided, off): candidates split, groups in more than one split, and splits whose share is off by more than a hundredth and more than the largest group's share."""
    groups = materialize(_candidate_groups(spark, d), "groups")
    rows = groups.join(random_mate.split_groups(groups, "group", SHARES), "group")
    per = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("split").alias("splits"))
    whole = per.agg(F.sum("n").alias("candidates"), F.count_if(F.col("splits") > 1).alias("divided"), F.max("n").alias("largest"))
    shares = rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    wanted = spark.createDataFrame(list(SHARES.items()), "split string, wanted double").join(shares, "split", "left").fillna(0, ["n"])
    gap = F.abs(F.col("n") / F.col("candidates") - F.col("wanted"))
    return wanted.crossJoin(F.broadcast(whole)).groupBy("candidates", "divided").agg(F.count_if((gap > 0.01) & (gap > F.col("largest") / F.col("candidates"))).alias("off"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    members, pairs = sketch_forest.similar_classes(sketch_forest.candidate_sets(table(spark, d, "candidates")), SIMILAR)
    return sketch_forest.record_pairs(members, pairs).select(F.col("a").alias("candidate_a"), F.col("b").alias("candidate_b"), F.col("kind").alias("field"))


def p6_classes(spark: SparkSession, d: str) -> DataFrame:
    """(candidate_id, field, class_size, links) of every candidate and field with a non-empty set: copies of its set, and other classes similar to it."""
    members, pairs = sketch_forest.similar_classes(sketch_forest.candidate_sets(table(spark, d, "candidates")), SIMILAR)
    sizes = members.groupBy("sid").agg(F.countDistinct("record").alias("class_size"))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("sid")).groupBy("sid").agg(F.count(F.lit(1)).alias("links"))
    rows = members.join(sizes, "sid").join(ends, "sid", "left")
    return rows.select(F.col("record").alias("candidate_id"), F.col("kind").alias("field"), "class_size", F.coalesce("links", F.lit(0).cast("bigint")).alias("links")).distinct()


def _baskets(spark: SparkSession, d: str) -> DataFrame:
    return cooccurrence.baskets(live(table(spark, d, "card_txns"), "card", "merchant"), "card", "merchant")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = cooccurrence.surprise(_baskets(spark, d))
    hit = pairs.where("n >= 5 AND n * n_baskets >= 3 * n_a * n_b")
    return hit.select(id_text("a", "MERCH").alias("merchant_a"), id_text("b", "MERCH").alias("merchant_b"))


def p7_pairs(spark: SparkSession, d: str) -> DataFrame:
    """(merchant_a, merchant_b, baskets, lift) of every pair used by one card."""
    pairs = cooccurrence.surprise(_baskets(spark, d))
    return pairs.select(id_text("a", "MERCH").alias("merchant_a"), id_text("b", "MERCH").alias("merchant_b"), F.col("n").alias("baskets"), F.round("lift", 6).alias("lift"))


def p7_surprise(spark: SparkSession, d: str) -> DataFrame:
    """Every pair with its mean and tail under the fitted null, and whether it is significant."""
    pairs = cooccurrence.surprise(_baskets(spark, d))
    return pairs.select(id_text("a", "MERCH").alias("merchant_a"), id_text("b", "MERCH").alias("merchant_b"), "n", "null_mean", "log10_p", "significant")


def p7_margins(spark: SparkSession, d: str) -> DataFrame:
    """(merchant_id, n): how many baskets each merchant is expected in under the fitted null, rounded: as many as it is in."""
    return cooccurrence.null_margins(_baskets(spark, d)).select(id_text("item", "MERCH").alias("merchant_id"), F.round("expected").cast("bigint").alias("n"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe_trie.encode(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    found = leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.where("run_words >= 12").select("doc_id", "item_id").distinct()


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Every leak with its verified windows, best similarity and longest run."""
    return leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(table(spark, d, "documents")).select("doc_id").distinct()


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_shares(table(spark, d, "documents"))


def p10_limits(spark: SparkSession, d: str) -> DataFrame:
    """(source, unit, length): the lengths at which a source cuts, "" for no source."""
    return truncation.limits(truncation.sized(table(spark, d, "documents")))


def queries() -> dict:
    return {f.__name__: f for f in (p3_found, p5_found, p5_splits, p5_balance, p6_found, p6_classes, p7_found, p7_pairs, p7_surprise, p7_margins, p8_ids, p9_found, p9_leaks, p10_found, p10_shares, p10_limits)}


def oracle_sql() -> dict[str, str]:
    number = lambda c, p: f"TRY_CAST(NULLIF(regexp_extract({c}, '^\\s*(?i:{p})[^A-Za-z0-9]*([0-9]+)\\s*$', 1), '') AS BIGINT)"
    text = lambda c, p, w: f"'{p}_' || lpad(CAST({c} AS VARCHAR), {w}, '0')"
    lists = f"""lists AS (
      SELECT cards, row_number() OVER () AS list_no FROM (
        SELECT cards FROM candidates UNION ALL
        SELECT cards FROM identity_groups WHERE trim(value) <> '' AND cardinality <= 12)),
    member AS (SELECT DISTINCT list_no, card FROM (SELECT list_no, {number('card', 'CARD')} AS card FROM (SELECT list_no, unnest(cards) AS card FROM lists)) WHERE card IS NOT NULL),
    edge AS (SELECT DISTINCT a.card AS a, b.card AS b FROM (SELECT list_no, min(card) AS card FROM member GROUP BY list_no HAVING count(*) > 1) a JOIN member b ON a.list_no = b.list_no AND a.card <> b.card),
    arc AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge)"""
    sets = f"""item AS (
      SELECT DISTINCT candidate_id, 'cards' AS field, CAST({number('x', 'CARD')} AS VARCHAR) AS item FROM (SELECT candidate_id, unnest(cards) AS x FROM candidates) WHERE {number('x', 'CARD')} IS NOT NULL
      UNION SELECT DISTINCT candidate_id, 'merged_from', x FROM (SELECT candidate_id, unnest(merged_from) AS x FROM candidates) WHERE x IS NOT NULL),
    total AS (SELECT candidate_id, field, count(*) AS n FROM item GROUP BY ALL),
    common AS (SELECT x.candidate_id AS a, y.candidate_id AS b, x.field, count(*) AS n FROM item x JOIN item y ON x.field = y.field AND x.item = y.item AND x.candidate_id < y.candidate_id GROUP BY ALL)"""
    basket = f"""v AS (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY received_at DESC) AS version_no FROM card_txns),
    basket AS (SELECT DISTINCT {number('card_id', 'CARD')} AS card, {number('merchant_id', 'MERCH')} AS merchant FROM v WHERE version_no = 1 AND {number('card_id', 'CARD')} IS NOT NULL AND {number('merchant_id', 'MERCH')} IS NOT NULL),
    one AS (SELECT merchant, count(*) AS n FROM basket GROUP BY merchant),
    pair AS (SELECT x.merchant AS a, y.merchant AS b, count(*) AS n FROM basket x JOIN basket y ON x.card = y.card AND x.merchant < y.merchant GROUP BY ALL),
    total AS (SELECT count(DISTINCT card) AS n FROM basket)"""
    words = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda w: w <> '')"
    return {
        "p3_found": f"""WITH RECURSIVE {lists},
    reach(v, w) AS (SELECT a, a FROM arc UNION SELECT reach.v, arc.b FROM reach JOIN arc ON reach.w = arc.a)
    SELECT {text('v', 'CARD', 9)} AS card_id, {text('min(w)', 'CARD', 9)} AS group_id FROM reach GROUP BY v""",
        "p5_found": f"""WITH RECURSIVE key AS (
      SELECT DISTINCT candidate_id, 'c' || {number('x', 'CARD')} AS key FROM (SELECT candidate_id, unnest(cards) AS x FROM candidates) WHERE {number('x', 'CARD')} IS NOT NULL AND candidate_id IS NOT NULL
      UNION SELECT DISTINCT candidate_id, 'w' || world_id FROM candidates WHERE world_id >= 0 AND candidate_id IS NOT NULL),
    head AS (SELECT key, min(candidate_id) AS h FROM key GROUP BY key),
    arc AS (SELECT DISTINCT candidate_id AS a, h AS b FROM key JOIN head USING (key) UNION SELECT DISTINCT h, candidate_id FROM key JOIN head USING (key)),
    reach(v, w) AS (SELECT candidate_id, candidate_id FROM candidates WHERE candidate_id IS NOT NULL UNION SELECT reach.v, arc.b FROM reach JOIN arc ON reach.w = arc.a)
    SELECT v AS candidate_id, min(w) AS group_id FROM reach GROUP BY v""",
        "p5_balance": "SELECT count(DISTINCT candidate_id) AS candidates, CAST(0 AS BIGINT) AS divided, CAST(0 AS BIGINT) AS off FROM candidates",
        "p6_classes": f"""WITH {sets.split('total AS')[0]}
    sets AS (SELECT candidate_id, field, list_sort(list(item)) AS s FROM item GROUP BY ALL),
    class AS (SELECT field, s, count(*) AS class_size, min(candidate_id) AS rep FROM sets GROUP BY ALL),
    entry AS (SELECT field, rep, len(s) AS n, unnest(s) AS item FROM class),
    near AS (SELECT x.field, x.rep AS a, y.rep AS b, x.n AS n_a, y.n AS n_b, count(*) AS c FROM entry x JOIN entry y ON x.field = y.field AND x.item = y.item AND x.rep <> y.rep GROUP BY ALL),
    links AS (SELECT field, a AS rep, count(*) AS links FROM near WHERE c * 5 >= (n_a + n_b - c) * 3 GROUP BY ALL)
    SELECT candidate_id, sets.field, class_size, coalesce(links, 0) AS links FROM sets JOIN class ON class.field = sets.field AND class.s = sets.s LEFT JOIN links ON links.field = class.field AND links.rep = class.rep""",
        "p6_found": f"""WITH {sets}
    SELECT a AS candidate_a, b AS candidate_b, c.field FROM common c JOIN total x ON x.candidate_id = a AND x.field = c.field JOIN total y ON y.candidate_id = b AND y.field = c.field
    WHERE c.n * 5 >= (x.n + y.n - c.n) * 3""",
        "p7_found": f"""WITH {basket}
    SELECT {text('a', 'MERCH', 5)} AS merchant_a, {text('b', 'MERCH', 5)} AS merchant_b FROM pair p JOIN one x ON x.merchant = a JOIN one y ON y.merchant = b, total
    WHERE p.n >= 5 AND p.n * total.n >= 3 * x.n * y.n""",
        "p7_pairs": f"""WITH {basket}
    SELECT {text('a', 'MERCH', 5)} AS merchant_a, {text('b', 'MERCH', 5)} AS merchant_b, p.n AS baskets, round(p.n * CAST(total.n AS DOUBLE) / (x.n * y.n), 6) AS lift FROM pair p JOIN one x ON x.merchant = a JOIN one y ON y.merchant = b, total""",
        "p7_margins": f"""WITH {basket}
    SELECT {text('merchant', 'MERCH', 5)} AS merchant_id, n FROM one""",
        "p10_limits": """WITH t AS (SELECT DISTINCT coalesce(source, '') AS source, rtrim(text) AS t, length(text) AS chars, strlen(text) AS bytes FROM documents WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''),
    h AS (SELECT source, unit, length, count(*) AS n FROM (SELECT source, 'chars' AS unit, chars AS length FROM t UNION ALL SELECT source, 'bytes', bytes FROM t) GROUP BY ALL),
    w AS (SELECT *, sum(n) OVER (PARTITION BY source, unit ORDER BY length RANGE BETWEEN 40 PRECEDING AND 40 FOLLOWING) - n AS near,
      coalesce(sum(n) OVER (PARTITION BY source, unit ORDER BY length RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS longer FROM h)
    SELECT source, unit, length FROM w WHERE n >= 4 AND n >= near / 10.0 AND 2 * n >= longer""",
        "p9_found": f"""WITH w AS (SELECT doc_id, {words.format('text')} AS w FROM documents WHERE text IS NOT NULL),
    i AS (SELECT item_id, {words.format('passage')} AS w FROM eval_items WHERE passage IS NOT NULL),
    dw AS (SELECT doc_id, array_to_string(w[k:k + 11], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM w WHERE len(w) >= 12)),
    iw AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 11], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i WHERE len(w) >= 12))
    SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (s)""",
    }
