"""Items that appear together: exact pair counts and their surprise under a bipartite configuration null."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkweave.plans.durable import Scratch

#: Baskets counted at once and the widest block of items.
ROWS, TILE = 2048, 2048
#: Classes of basket sizes and of item frequencies in the fit of the null: values up to EXACT are their own class, larger ones share one with those within a hundredth.
EXACT, WIDTH = 512, 0.01


def _dense(items: np.ndarray, code: np.ndarray, basket: np.ndarray, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pair counts of a block of baskets from products of its 0/1 incidence matrix."""
    for i in range(0, len(items), TILE):
        for j in range(i, len(items), TILE):
            blocks = []
            for k in (i, j):
                m = np.zeros((rows, min(TILE, len(items) - k)), np.float32)
                inside = (code >= k) & (code < k + TILE)
                m[basket[inside], code[inside] - k] = 1
                blocks.append(m)
            together = blocks[0].T @ blocks[1]
            if i == j:
                together = np.triu(together, 1)
            x, y = np.nonzero(together)
            yield items[x + i], items[y + j], together[x, y].astype(np.int64)


def _sparse(items: np.ndarray, code: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The same from the few entries of a thin matrix: every entry against the later ones of its basket."""
    order = np.lexsort((code, np.repeat(np.arange(len(sizes)), sizes)))
    code = code[order]
    end = np.repeat(np.cumsum(sizes), sizes)
    later = end - np.arange(len(code)) - 1
    x = np.repeat(np.arange(len(code)), later)
    y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(later) - later, later)
    pair, n = np.unique(code[x] * np.int64(len(items)) + code[y], return_counts=True)
    yield items[pair // len(items)], items[pair % len(items)], n


def _block_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def merged():
        a, b, n = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((b, a))
        a, b, n = a[order], b[order], n[order]
        at = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        return a[at], b[at], np.add.reduceat(n, at)

    def out(part):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in part], names=["a", "b", "n"])

    for batch in batches:
        col = batch.column(0)
        for lo in range(0, len(col), ROWS):
            part = col.slice(lo, ROWS)
            flat = part.flatten().to_numpy(zero_copy_only=False)
            if not len(flat):
                continue
            basket = np.repeat(np.arange(len(part)), np.diff(part.offsets.to_numpy()))
            items, code = np.unique(flat, return_inverse=True)
            sizes = np.bincount(basket)
            pairs = int((sizes * (sizes - 1) // 2).sum())
            held += _sparse(items, code, sizes) if pairs * 400 < len(part) * len(items) ** 2 // 2 else _dense(items, code, basket, len(part))
            if sum(len(h[0]) for h in held) > 1_000_000:
                held[:] = [merged()]
                if len(held[0][0]) > 500_000:  # mostly new pairs: pass them on, the sum follows
                    yield out(held.pop())
    if held:
        yield out(merged())


def baskets(rows: DataFrame, basket: str, item: str) -> DataFrame:
    """(basket, items): the set of items of each basket; rows with a null in either are left out. A basket is at most as long as there are items."""
    pairs = rows.where(F.col(basket).isNotNull() & F.col(item).isNotNull()).select(F.col(basket).alias("basket"), F.col(item).alias("item")).distinct()
    return pairs.groupBy("basket").agg(F.collect_list("item").alias("items"))


def pair_counts(sets: DataFrame) -> DataFrame:
    """(a, b, n) with a < b: the number of baskets holding both items (whole numbers).

    Blocks of baskets become 0/1 incidence matrices whose products hold all
    pair counts of the block, so no pair of a basket is ever a row; only summed
    counts are shuffled. A block with far more items than its baskets are long is
    counted by its entries instead, with the same result.
    """
    return sets.select("items").mapInArrow(_block_counts, "a bigint, b bigint, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))


def item_counts(sets: DataFrame) -> DataFrame:
    return sets.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"))


def fit_null(size_counts: dict[float, int], degree_counts: dict[float, int], tolerance: float = 1e-9, max_rounds: int = 20_000) -> tuple[dict[float, float], dict[float, float]]:
    """Fitnesses (by basket size, by item frequency) of the bipartite configuration model.

    p(basket, item) = x y / (1 + x y), with expected basket sizes and item
    frequencies equal to the observed ones. Baskets of one size share x and
    items of one frequency share y, so the fit works on the distinct sizes and
    frequencies only. Full baskets and items of every basket have p = 1, which
    is approached up to a fitness of 1e12. Raises if the expected margins don't
    come within a thousandth of the observed ones.
    """
    sizes, degrees = sorted(size_counts), sorted(degree_counts)
    k, nk = np.array(sizes, float), np.array([size_counts[v] for v in sizes], float)
    d, nd = np.array(degrees, float), np.array([degree_counts[v] for v in degrees], float)
    total = (k * nk).sum()
    x, y = k / np.sqrt(total), d / np.sqrt(total)
    gap = np.inf
    for _ in range(max_rounds):
        x = np.minimum(k / (nd * y / (1 + np.outer(x, y))).sum(1), 1e12)
        got = y * ((nk * x)[:, None] / (1 + np.outer(x, y))).sum(0)
        gap = np.abs(got / d - 1).max()
        y = np.minimum(y * d / got, 1e12)
        if gap < tolerance:
            break
    if gap > 1e-3:
        raise RuntimeError(f"the null misses a margin by a share of {gap:.2g}")
    return dict(zip(sizes, x)), dict(zip(degrees, y))


def log_tail(q: np.ndarray, times: np.ndarray, n: np.ndarray) -> np.ndarray:
    """ln P(X >= n) for Poisson-binomial X: row i of q holds the probabilities, times how often each occurs.

    Saddlepoint (Lugannani-Rice) with the lattice correction; near the mean,
    where that is singular, a normal tail with continuity correction. A count
    of 0 has probability 1.
    """
    q = np.clip(q, 1e-300, 1 - 1e-15)
    mean = (times * q).sum(1)
    var = (times * q * (1 - q)).sum(1)
    top = (times * np.ones_like(q)).sum(1)
    goal = np.minimum(n, top - 1e-9).astype(float)
    s = np.zeros(len(n))
    for _ in range(60):
        e = q * np.exp(np.clip(s, -700, 700))[:, None]
        p = e / (1 - q + e)
        step = ((times * p).sum(1) - goal) / np.maximum((times * p * (1 - p)).sum(1), 1e-12)
        s -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    e = q * np.exp(np.clip(s, -700, 700))[:, None]
    p = e / (1 - q + e)
    k0 = (times * np.log1p(q * np.expm1(np.clip(s, -700, 700))[:, None])).sum(1)
    k2 = np.maximum((times * p * (1 - p)).sum(1), 1e-12)
    r = np.sign(s) * np.sqrt(np.maximum(2 * (s * goal - k0), 0))
    u = (1 - np.exp(-s)) * np.sqrt(k2)
    phi = lambda z: -0.5 * z * z - 0.5 * np.log(2 * np.pi)
    with np.errstate(all="ignore"):
        upper = np.exp(_log_normal_tail(r)) + np.exp(phi(r)) * (1 / u - 1 / r)
        # deep in the tail the bracket is taken relative to the density, where nothing cancels
        deep = phi(r) + np.log(np.maximum(1 / u - 1 / r + np.exp(_log_normal_tail(r) - phi(r)), 1e-300))
        out = np.where(r > 5, deep, np.log(np.maximum(upper, 1e-300)))
    close = np.abs(goal - mean) < 0.05 * np.sqrt(np.maximum(var, 1e-12)) + 1e-9
    out = np.where(close, _log_normal_tail((goal - 0.5 - mean) / np.sqrt(np.maximum(var, 1e-12))), out)
    return np.where(n <= 0, 0.0, np.minimum(out, 0.0))


def _log_normal_tail(z: np.ndarray) -> np.ndarray:
    """ln P(Z >= z)."""
    from math import erfc, log

    z = np.asarray(z, float)
    small = np.clip(z, -30, 30)
    direct = np.array([log(max(0.5 * erfc(v / 2**0.5), 1e-300)) for v in small])
    with np.errstate(all="ignore"):
        series = -0.5 * z * z - 0.5 * np.log(2 * np.pi) - np.log(z) + np.log1p(-1 / z**2 + 3 / z**4)
    return np.where(z > 25, series, direct)


def surprise(sets: DataFrame, fdr: float = 0.01) -> DataFrame:
    """(a, b, n, n_a, n_b, n_baskets, expected, lift, log10_p, significant) for every pair of items found together.

    expected, lift: under independent baskets (n_a n_b / baskets). log10_p: of
    at least n common baskets under the configuration null fitted to item
    frequencies and basket sizes. significant: by Benjamini-Hochberg at `fdr`
    over all pairs of items, seen together or not. An empty input gives an
    empty result.
    """
    spark = sets.sparkSession
    scratch = Scratch(spark)
    sets = scratch.write(sets, "baskets")
    counts = scratch.write(pair_counts(sets), "pairs")
    items = scratch.write(item_counts(sets), "items")
    size_counts, degree_counts = _histogram(sets.select(F.size("items").alias("k")).where("k > 0")), _histogram(items.select(F.col("n").alias("k")))
    n_baskets, n_items = sum(size_counts.values()), sum(degree_counts.values())
    x, y = fit_null(size_counts, degree_counts) if size_counts else ({}, {})
    xs, times = np.array(list(x.values())), np.array([size_counts[k] for k in x], float)
    at, height = np.log(np.array(list(y), float)), np.log(np.array(list(y.values()), float))
    weight = lambda n: np.exp(np.interp(np.log(n), at, height))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                t = b.slice(lo, 1024)
                n, na, nb = (t.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
                pa_, pb = np.outer(weight(na), xs), np.outer(weight(nb), xs)
                q = pa_ / (1 + pa_) * (pb / (1 + pb))
                lp = log_tail(q, times, n) / np.log(10)
                cols = [*(t.column(i) for i in range(5)), pa.array((q * times).sum(1)), pa.array(lp)]
                yield pa.RecordBatch.from_arrays(cols, names=["a", "b", "n", "n_a", "n_b", "null_mean", "log10_p"])

    named = counts.join(items.select(F.col("item").alias("a"), F.col("n").alias("n_a")), "a").join(items.select(F.col("item").alias("b"), F.col("n").alias("n_b")), "b")
    scored = scratch.write(named.select("a", "b", "n", "n_a", "n_b").mapInArrow(score, "a bigint, b bigint, n bigint, n_a bigint, n_b bigint, null_mean double, log10_p double"), "scored")
    tests = max(n_items * (n_items - 1) / 2, 1)
    limit = _bh_limit(scored.select("log10_p"), tests, fdr)
    return scored.select(
        "a", "b", "n", "n_a", "n_b", F.lit(n_baskets).cast("bigint").alias("n_baskets"), "null_mean",
        (F.col("n_a") * F.col("n_b") / F.lit(float(max(n_baskets, 1)))).alias("expected"),
        (F.col("n") * float(max(n_baskets, 1)) / (F.col("n_a") * F.col("n_b"))).alias("lift"),
        "log10_p", (F.col("log10_p") <= limit).alias("significant"),
    )


def _class(v: Column) -> Column:
    return F.when(v <= EXACT, v).otherwise(EXACT + 1 + F.floor(F.log(v / EXACT) / F.log1p(F.lit(WIDTH)))).cast("bigint")


def _histogram(values: DataFrame) -> dict[float, int]:
    """How many of the values in column k are in each class, under the class's mean; at most one row a class comes to the driver."""
    rows = values.groupBy(_class(F.col("k").cast("double")).alias("c")).agg(F.avg("k").alias("k"), F.count(F.lit(1)).alias("n")).orderBy("c").collect()
    return {float(r["k"]): r["n"] for r in rows}


def null_margins(sets: DataFrame) -> DataFrame:
    """(item, n, expected): in how many baskets each item is, and is expected under the fitted null."""
    sets = Scratch(sets.sparkSession).write(sets, "baskets")
    items = item_counts(sets)
    size_counts, degree_counts = _histogram(sets.select(F.size("items").alias("k")).where("k > 0")), _histogram(items.select(F.col("n").alias("k")))
    x, y = fit_null(size_counts, degree_counts) if size_counts else ({}, {})
    # one row per class of frequencies
    rows = [(k, sum(n * x[s] * v / (1 + x[s] * v) for s, n in size_counts.items()) / k) for k, v in y.items()]
    ratio = sets.sparkSession.createDataFrame([(float(k), float(r)) for k, r in rows], "at double, ratio double")
    if not rows:
        return items.select("item", "n", F.lit(None).cast("double").alias("expected"))
    classed = items.withColumn("class", _class(F.col("n").cast("double")))
    return classed.join(ratio.withColumn("class", _class(F.col("at"))), "class").select("item", "n", (F.col("n") * F.col("ratio")).alias("expected"))


def _bh_limit(scored: DataFrame, tests: float, fdr: float) -> float:
    """Largest log10 p with p <= rank / tests * fdr, ranks by a prefix sum over 1/50 decades; -inf if none."""
    top = float(np.log10(fdr))
    some = scored.where(F.col("log10_p") <= top).withColumn("part", F.floor(F.greatest(F.col("log10_p"), F.lit(-20_000.0)) * 50))
    ahead = some.groupBy("part").agg(F.count(F.lit(1)).alias("c")).select("part", (F.sum("c").over(Window.orderBy("part")) - F.col("c")).alias("ahead"))
    ranked = some.withColumn("no", F.row_number().over(Window.partitionBy("part").orderBy("log10_p"))).join(ahead, "part")
    ok = F.col("log10_p") <= F.log10((F.col("no") + F.col("ahead")) / F.lit(tests)) + F.lit(top)
    best = ranked.where(ok).agg(F.max("log10_p").alias("m")).first()["m"]
    return float("-inf") if best is None else float(best)
