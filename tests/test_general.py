import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import micros

from linkweave.functions.ids import card_numbers, id_number, id_text
from linkweave.operators import bitmap_sessions, delta_features, tree_aggregation
from linkweave.sources.tables import live


def test_ids(spark):
    rows = [(" CARD_000000543 ",), ("card-663 ",), ("CARD000",), ("UNKNOWN",), ("",), (None,), ("MERCH_00012",), ("Card 12345678901",), ("\tcard_7\n",)]
    df = spark.createDataFrame(rows, "c string")
    got = [r[0] for r in df.select(id_text(id_number("c", "CARD"), "CARD")).collect()]
    assert got == ["CARD_000000543", "CARD_000000663", "CARD_000000000", None, None, None, None, "CARD_12345678901", "CARD_000000007"]
    lists = spark.createDataFrame([(["card 3", "CARD_03", None, "x", "CARD_1"],), (None,), ([],)], "cards array<string>")
    assert [r[0] for r in lists.select(card_numbers("cards")).collect()] == [[1, 3], [], []]


def test_top_members(spark, txns, current):
    count = Counter((d["device"], d["card"]) for d in current if d["device"] is not None and d["card"] is not None)
    want = {}
    for dev in {k[0] for k in count}:
        mine = [(-n, c) for (x, c), n in count.items() if x == dev]
        want[dev] = (len(mine), -sum(n for n, _ in mine), min(mine)[1], -min(mine)[0])
    got = tree_aggregation.top_members(live(txns, "device", "card"), "device", "card", fan_in=2).collect()
    assert {r["device"]: (r["members"], r["records"], r["top"], r["top_records"]) for r in got} == want
    assert tree_aggregation.top_members(live(txns.limit(0), "device", "card"), "device", "card").count() == 0


def test_top_members_tie_takes_smallest(spark):
    df = spark.createDataFrame([(1, 9), (1, 4), (1, 4), (1, 9), (1, None), (None, 3), (2, 5)], "device bigint, card bigint")
    got = {r["device"]: r["top"] for r in tree_aggregation.top_members(df, "device", "card").collect()}
    assert got == {1: 4, 2: 5}


def test_value_cards(spark):
    rows = [("ip", "a", ["CARD_1", "card 1", None], 3), ("ip", "a", ["CARD_2"], 7), ("ip", " ", ["CARD_1"], 2), ("ip", None, ["CARD_1"], 2), ("ip", "b", None, None)]
    df = spark.createDataFrame(rows, "attribute string, value string, cards array<string>, cardinality bigint")
    got = {r["value"]: (r["rows"], r["named"], r["cardinality"]) for r in tree_aggregation.value_card_counts(df).collect()}
    assert got == {"a": (2, 2, 7), "b": (1, 0, 0)}


def _features(current):
    out = defaultdict(lambda: [0, 0, None])
    for d in current:
        if d["card"] is None or d["merchant"] is None:
            continue
        f = out[d["card"], d["merchant"]]
        f[0] += 1
        f[1] += round((d["amount"] or 0) * 100) if d["amount"] == d["amount"] and d["amount"] is not None else 0
        if d["t"] is not None:
            f[2] = max(f[2] or micros(d["t"]), micros(d["t"]))
    return {k: tuple(v) for k, v in out.items()}


def _state(df):
    return {(r["card"], r["merchant"]): (r["n"], r["cents"], r["last_us"]) for r in df.collect()}


def test_features_match_current_rows(txns, current):
    assert _state(delta_features.features(txns)) == _features(current)


def test_features_in_batches_retract(spark, txns, current):
    log = delta_features.versions(txns).cache()
    times = sorted(r[0] for r in log.select("received_us").collect())
    cuts = [None, times[len(times) // 3], times[len(times) // 2], times[-1]]
    state = None
    for a, b in zip(cuts, cuts[1:]):
        state = delta_features.apply_deltas(state, delta_features.deltas(log, a, b), delta_features.live_at(log, b))
    assert _state(state) == _features(current)
    signs = {r["sign"] for r in delta_features.deltas(log).collect()}
    assert signs == {1, -1}


def test_latest_is_recomputed_when_retracted(spark):
    rows = [("T1", "CARD_1", "MERCH_1", 1.0, "2026-01-05 00:00:00", "2026-01-05 01:00:00"), ("T1", "CARD_1", "MERCH_1", 1.0, "2026-01-02 00:00:00", "2026-01-06 00:00:00"), ("T2", "CARD_1", "MERCH_1", 2.0, "2026-01-03 00:00:00", "2026-01-03 01:00:00")]
    df = spark.createDataFrame(rows, "transaction_id string, card_id string, merchant_id string, amount double, t string, r string").selectExpr("*", "cast(t as timestamp_ntz) as timestamp", "cast(r as timestamp_ntz) as received_at", "'' as device_fingerprint")
    (r,) = delta_features.features(df).collect()
    assert (r["n"], r["cents"], r["last_us"]) == (2, 300, 1_767_398_400_000_000)
    (w,) = delta_features.per_card(delta_features.features(df), 1_767_398_400_000_000 + 5_000_000).collect()
    assert w["card_id"] == "CARD_000000001" and [tuple(m) for m in w["merchants"]] == [("MERCH_00001", 2, 300, 5)]


def _sessions(events, gap):
    by = defaultdict(list)
    for e, us in events:
        by[e].append(us)
    out = []
    for e, ts in by.items():
        ts.sort()
        start, n = ts[0], 0
        for i, t in enumerate(ts):
            if i and t - ts[i - 1] > gap:
                out.append((e, start, ts[i - 1], n))
                start, n = t, 0
            n += 1
        out.append((e, start, ts[-1], n))
    return sorted(out)


def _got(df):
    return sorted((r["card"], r["start_us"], r["end_us"], r["n"]) for r in df.collect())


def test_sessions_match(txns, current):
    events = [(d["card"], micros(d["t"])) for d in current if d["card"] is not None and d["t"] is not None]
    assert _got(bitmap_sessions.sessions(live(txns, "card", "us"), "card", "us")) == _sessions(events, 1_800_000_000)


@pytest.mark.parametrize("gap,span", [(1_800_000_000, 86_400), (10_000_000, 600), (1_000_000, 60), (2_500_000, 100)])
def test_sessions_of_any_gap(spark, gap, span):
    rnd = random.Random(gap)
    events = []
    for e in range(6):
        t = rnd.randrange(-(10**9), 10**9) * 1000
        for _ in range(300 if e else 1500):
            t += rnd.choice([0, 1, gap - 1, gap, gap + 1, gap // 3, gap * 7, 999_999])
            events.append((e, t))
    rnd.shuffle(events)
    df = spark.createDataFrame([*events, (None, 5), (3, None)], "card bigint, us bigint")
    assert _got(bitmap_sessions.sessions(df, "card", "us", gap, span)) == _sessions(events, gap)


def test_sessions_empty(spark):
    assert bitmap_sessions.sessions(spark.createDataFrame([], "card bigint, us bigint"), "card", "us").count() == 0


def test_closing_fills_short_gaps():
    bits = np.zeros(256, np.uint8)
    bits[[3, 8, 14, 130, 200]] = 1
    closed = bitmap_sessions.close_bitmap(np.packbits(bits, bitorder="little").view("<u8"), 5)
    filled = np.flatnonzero(np.unpackbits(closed.view(np.uint8), bitorder="little"))
    assert filled.tolist() == [*range(3, 15), 130, 200]
