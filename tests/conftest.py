import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


TXN = "transaction_id string, card_id string, merchant_id string, amount double, timestamp timestamp_ntz, device_fingerprint string, ip_address string, email_hash string, vulcan_score double, txn_role string, received_at timestamp_ntz"


@pytest.fixture(scope="session")
def txns(spark):
    """Random transactions with dirt, copies and corrections, and columns whose names clash with the operators' own."""
    import random
    from datetime import datetime, timedelta

    rnd = random.Random(7)
    base = datetime(2026, 6, 20)
    spell = [lambda n: f"CARD_{n:09d}", lambda n: f" card-{n} ", lambda n: f"CARD_{n:012d}", lambda n: None if n % 5 == 0 else f"Card {n}"]
    rows = []
    for i in range(900):
        n = 1 if rnd.random() < 0.35 else rnd.randrange(12)
        t = base + timedelta(seconds=rnd.choice([0, 1800, 1800, 1801, 7, 90_000]) * rnd.randrange(40), microseconds=rnd.choice([0, 0, 1, 999_999]))
        row = [f"TXN_{i % 800:010d}" if i % 97 else None, rnd.choice(spell)(n), rnd.choice([f"MERCH_{n % 4:05d}", f"merch {rnd.randrange(5)}", "N/A", None]), rnd.choice([1.25, 700.5, float("nan"), None, 12000.0]), None if i % 31 == 0 else t, rnd.choice(["DEV_000000001", "dev-1", f"DEV_{n:09d}", "UNKNOWN", ""]), f"10.0.0.{n % 3}", None if n % 2 else f"EMAIL_{n % 3}", 0.25, "legit", base + timedelta(seconds=i, days=rnd.randrange(3))]
        rows.append(tuple(row))
        if i % 10 == 0:
            rows.append(tuple(row))
    df = spark.createDataFrame(rows, TXN)
    from pyspark.sql import functions as F

    for name in ("n", "chunk", "entity", "span", "sec", "us", "card", "device", "sign", "cents", "own"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def current(txns):
    """The same transactions in plain Python: one dict per transaction."""
    import re

    def number(x, prefix):
        m = re.match(rf"^\s*{prefix}[^A-Za-z0-9]*([0-9]+)\s*$", x or "", re.I)
        return int(m.group(1)) if m else None

    last, single = {}, []
    for r in txns.collect():
        d = {"card": number(r["card_id"], "card"), "merchant": number(r["merchant_id"], "merch"), "device": number(r["device_fingerprint"], "dev"), "amount": r["amount"], "t": r["timestamp"], "at": r["received_at"]}
        if r["transaction_id"] is None:
            single.append(d)
        elif r["transaction_id"] not in last or last[r["transaction_id"]]["at"] < d["at"]:
            last[r["transaction_id"]] = d
    return [*last.values(), *single]


def micros(t):
    from datetime import datetime

    d = t - datetime(1970, 1, 1)
    return (d.days * 86400 + d.seconds) * 1_000_000 + d.microseconds
