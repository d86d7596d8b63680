import itertools
import random
from collections import Counter

import numpy as np

from linkweave.llm import cooccurrence


def _rows(seed=1, baskets=300, items=25):
    rnd = random.Random(seed)
    out = []
    for b in range(baskets):
        for i in {int(rnd.paretovariate(0.7)) % items for _ in range(rnd.randrange(1, 9))}:
            out.append((b, i))
        if rnd.random() < 0.25:
            out += [(b, 20), (b, 21)]
    return out


def test_counts_and_surprise(spark):
    rows = _rows()
    df = spark.createDataFrame([*rows, *rows[:30], (None, 3), (4, None)], "card bigint, merchant bigint").selectExpr("*", "1 as n", "2 as items", "3 as basket")
    sets = cooccurrence.baskets(df, "card", "merchant")
    by = {}
    for b, i in rows:
        by.setdefault(b, set()).add(i)
    pairs = Counter(p for s in by.values() for p in itertools.combinations(sorted(s), 2))
    one = Counter(i for s in by.values() for i in s)
    got = {(r["a"], r["b"]): r for r in cooccurrence.surprise(sets).collect()}
    assert {k: r["n"] for k, r in got.items()} == pairs
    assert all(r["n_a"] == one[a] and r["n_b"] == one[b] and r["n_baskets"] == len(by) for (a, b), r in got.items())
    assert got[20, 21]["significant"] and got[20, 21]["log10_p"] < -5
    calm = [r["log10_p"] for k, r in got.items() if k != (20, 21)]
    assert sum(x < -4 for x in calm) < 0.1 * len(calm)


def test_tiles(spark, monkeypatch):
    monkeypatch.setattr(cooccurrence, "TILE", 4)
    import pyarrow as pa

    rows = [[1, 2, 9, 11, 30], [2, 30], [], [1, 11, 12, 13, 14, 15]]
    got = Counter()
    for b in cooccurrence._block_counts(iter([pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int64()))], names=["items"])])):
        for r in b.to_pylist():
            got[r["a"], r["b"]] += r["n"]
    assert got == Counter(p for s in rows for p in itertools.combinations(sorted(s), 2))


def test_null_reproduces_margins():
    sizes, degrees = {2: 50, 5: 20, 10: 1}, {10: 20, 5: 2}
    assert sum(k * n for k, n in sizes.items()) == sum(k * n for k, n in degrees.items())
    x, y = cooccurrence.fit_null(sizes, degrees)
    p = {(k, d): x[k] * y[d] / (1 + x[k] * y[d]) for k in sizes for d in degrees}
    assert all(abs(sum(n * p[k, d] for d, n in degrees.items()) - k) < 1e-6 * k for k in sizes)
    assert all(abs(sum(n * p[k, d] for k, n in sizes.items()) - d) < 1e-6 * d for d in degrees)


def test_tail_matches_exact_distribution():
    q, times = np.array([0.02, 0.3, 0.7]), np.array([40.0, 15.0, 4.0])
    dist = np.array([1.0])
    for p, t in zip(q, times):
        for _ in range(int(t)):
            dist = np.convolve(dist, [1 - p, p])
    n = np.arange(0, 30)
    exact = np.array([np.log(dist[k:].sum()) for k in n])
    got = cooccurrence.log_tail(np.tile(q, (len(n), 1)), times, n)
    assert np.abs(got - exact)[1:].max() < 0.12
    assert got[0] == 0


def test_empty(spark):
    sets = cooccurrence.baskets(spark.createDataFrame([], "card bigint, merchant bigint"), "card", "merchant")
    assert cooccurrence.surprise(sets).count() == 0


def test_thin_blocks_and_large_sizes(spark, monkeypatch):
    rnd = random.Random(3)
    rows = [(b, i) for b in range(400) for i in {rnd.randrange(5000) for _ in range(rnd.randrange(1, 6))} | ({1, 2} if b % 7 == 0 else set())]
    sets = cooccurrence.baskets(spark.createDataFrame(rows, "card bigint, merchant bigint"), "card", "merchant")
    by = {}
    for b, i in rows:
        by.setdefault(b, set()).add(i)
    want = Counter(p for s in by.values() for p in itertools.combinations(sorted(s), 2))
    assert {(r["a"], r["b"]): r["n"] for r in cooccurrence.pair_counts(sets).collect()} == want
    full = {(r["a"], r["b"]): r["log10_p"] for r in cooccurrence.surprise(sets).collect()}
    monkeypatch.setattr(cooccurrence, "EXACT", 3)
    binned = {(r["a"], r["b"]): r["log10_p"] for r in cooccurrence.surprise(sets).collect()}
    assert full.keys() == binned.keys() and max(abs(full[k] - binned[k]) for k in full) < 0.02 * max(-v for v in full.values())
