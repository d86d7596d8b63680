import random
from collections import Counter
from fractions import Fraction

import pytest

from linkweave.llm import hash_to_min, links, random_mate, sketch_forest


def _components(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {v: find(v) for v in list(up)}


def _graph(seed):
    rnd = random.Random(seed)
    pairs = [(i, i + 1) for i in range(0, 60)]  # a chain
    pairs += [(500, rnd.randrange(501, 700)) for _ in range(150)]  # a hub
    pairs += [(rnd.randrange(800, 1000), rnd.randrange(800, 1000)) for _ in range(120)]
    pairs += [(2000, 2000)]
    rnd.shuffle(pairs)
    return pairs


@pytest.mark.parametrize("seed", [1, 2])
def test_hash_to_min(spark, seed):
    pairs = _graph(seed)
    df = spark.createDataFrame([*pairs, *pairs[:9], (None, 3), (4, None)], "a bigint, b bigint").selectExpr("a", "b", "'x' as v", "'y' as w", "1 as n", "2 as m")
    got = {r["vertex"]: r["group"] for r in hash_to_min.hash_to_min(df).collect()}
    assert got == _components(pairs)


@pytest.fixture
def all_skewed(spark):
    """Every partition is taken as skewed and split."""
    conf = {f"spark.sql.adaptive.skewJoin.{k}": v for k, v in (("skewedPartitionThresholdInBytes", "1b"), ("skewedPartitionFactor", "0.01"))} | {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k in conf:
        spark.conf.unset(k)


def test_a_vertex_with_most_of_the_pairs(spark, all_skewed):
    pairs = [*_graph(3), *((1_000_000, 1_000_000 + i) for i in range(1, 3000)), *((2_000_000 - i, 2_000_000) for i in range(1, 3000))]
    df = spark.createDataFrame(pairs, "a bigint, b bigint")
    want = _components(pairs)
    assert {r["vertex"]: r["group"] for r in hash_to_min.hash_to_min(df).collect()} == want
    assert {r["vertex"]: r["group"] for r in random_mate.smallest_per_root(random_mate.contract(df)).collect()} == want


def test_hash_to_min_empty(spark):
    assert hash_to_min.hash_to_min(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_contract(spark):
    pairs = _graph(4)
    df = spark.createDataFrame([*pairs, (None, 3), (4, None)], "a bigint, b bigint").selectExpr("a", "b", "1 as u", "2 as v", "3 as root")
    rows = random_mate.contract(df).collect()
    assert len(rows) == len({r["vertex"] for r in rows})
    want = _components(pairs)
    assert {r["vertex"] for r in rows} == set(want)
    named = {}
    for r in rows:
        assert named.setdefault(r["root"], want[r["vertex"]]) == want[r["vertex"]]
    assert len(named) == len(set(want.values()))
    assert random_mate.contract(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_bound_groups_and_split(spark):
    rnd = random.Random(5)
    rows = [(f"C{i:04d}", f"k{rnd.randrange(400)}") for i in range(600)] + [(f"C{i:04d}", None) for i in range(650)] + [(f"C{i:04d}", "hot") for i in range(0, 200)]
    groups = random_mate.bound_groups(spark.createDataFrame(rows, "id string, key string"), "id", "key").cache()
    got = {r["id"]: r["group"] for r in groups.collect()}
    want = _components([(a, b) for x in {k for _, k in rows if k} for m in [sorted({r for r, k in rows if k == x})] for a, b in zip(m, m[1:])])
    assert got == {f"C{i:04d}": want.get(f"C{i:04d}", f"C{i:04d}") for i in range(650)}
    shares = {"train": 0.8, "validation": 0.1, "test": 0.1}
    split = {r["group"]: r["split"] for r in random_mate.split_groups(groups, "group", shares).collect()}
    assert set(split) == set(got.values())
    n = Counter(split[g] for g in got.values())
    assert 0.7 < n["train"] / 650 < 0.9 and n["validation"] > 20 and n["test"] > 20
    assert random_mate.split_groups(groups.limit(0), "group", shares).count() == 0


def test_links_and_keys(spark):
    c = spark.createDataFrame([("A", ["CARD_1", "card 2", None, "x"], 3), ("B", None, None), ("C", ["CARD_9"], -1), (None, ["CARD_5", "CARD_6"], 3)], "candidate_id string, cards array<string>, world_id int")
    g = spark.createDataFrame([("v", ["CARD_2", "CARD_3"], 12), ("w", ["CARD_7", "CARD_8"], 13), (" ", ["CARD_7", "CARD_8"], 2), (None, ["CARD_7", "CARD_8"], 2), ("z", ["CARD_7", "CARD_8"], None)], "value string, cards array<string>, cardinality bigint")
    assert sorted(map(tuple, links.card_links(c, g).collect())) == [(1, 2), (2, 3), (5, 6)]
    assert sorted(((r[0], r[1] or "") for r in links.candidate_keys(c).collect())) == [("A", ""), ("A", "c1"), ("A", "c2"), ("A", "w3"), ("B", ""), ("C", ""), ("C", "c9")]


def _sets(seed, n=300):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        size = rnd.choice([1, 2, 3, 5, 8, 20])
        s = set(rnd.sample(range(60), size)) | ({0} if rnd.random() < 0.4 else set())
        out.append((i, s))
        if rnd.random() < 0.4:
            t = set(s)
            if rnd.random() < 0.6 and len(t) > 2:
                t.pop()
            out.append((1000 + i, t))
    return out


def test_similar_pairs(spark):
    sets = _sets(6)
    rows = [("k", f"R{i:05d}", [f"{x:03d}" for x in sorted(s)]) for i, s in sets] + [("k", "empty", []), ("other", "R00000", ["000", "001"])]
    df = spark.createDataFrame([*rows, *rows[:20]], "kind string, record string, items array<string>").selectExpr("*", "1 as sid", "2 as size", "3 as n")
    members, pairs = sketch_forest.similar_classes(df, Fraction(3, 5))
    got = {(r["a"], r["b"]) for r in sketch_forest.record_pairs(members, pairs).where("kind = 'k'").collect()}
    want = {tuple(sorted((f"R{i:05d}", f"R{j:05d}"))) for i, s in sets for j, t in sets if i < j and 5 * len(s & t) >= 3 * len(s | t)}
    assert got == want
    assert sketch_forest.forest_depths(0.6, 64, 0.999999) == [4, 3]


def test_similar_pairs_around_a_common_element(spark):
    rows = [("k", f"R{i:05d}", ["0", f"x{i:04d}"]) for i in range(1500)]
    rows += [("k", f"S{i:05d}", ["0", f"x{i:04d}", f"x{i:04d}y"]) for i in range(0, 1500, 3)]
    df = spark.createDataFrame(rows, "kind string, record string, items array<string>")
    members, pairs = sketch_forest.similar_classes(df, Fraction(3, 5))
    got = {(r["a"], r["b"]) for r in sketch_forest.record_pairs(members, pairs).collect()}
    assert got == {(f"R{i:05d}", f"S{i:05d}") for i in range(0, 1500, 3)}


def test_similar_between(spark):
    a, b = _sets(7, 80), _sets(8, 80)
    make = lambda s: spark.createDataFrame([("k", i, [f"{x:03d}" for x in sorted(v)]) for i, v in s], "kind string, record bigint, items array<string>")
    got = {(r["a"], r["b"]) for r in sketch_forest.similar_between(make(a), make(b), Fraction(3, 5)).collect()}
    assert got == {(i, j) for i, s in a for j, t in b if 5 * len(s & t) >= 3 * len(s | t)}
    assert sketch_forest.similar_between(make(a).limit(0), make(b), Fraction(3, 5)).count() == 0


def test_candidate_sets(spark):
    c = spark.createDataFrame([("A", ["card 2", "CARD_02", None, "-"], ["x", None, "x"]), ("B", None, None), (None, ["CARD_1"], [])], "candidate_id string, cards array<string>, merged_from array<string>")
    assert sorted((r["kind"], r["record"], tuple(r["items"])) for r in sketch_forest.candidate_sets(c).collect()) == [("cards", "A", ("2",)), ("cards", "B", ()), ("merged_from", "A", ("x",)), ("merged_from", "B", ())]
