import os
import re

import __spark_entry__ as entry

SQL_FREE = {"dedup_kept", "survivors", "louvain", "templates", "gbt_oof", "train", "ablation", "synthetic_roles", "p5_splits", "p7_surprise", "p8_ids", "p9_leaks", "p10_found", "p10_shares"}


def test_every_query_has_sql_or_a_reason():
    q, o = set(entry.queries()), set(entry.oracle_sql())
    assert o <= q and (q - o) <= SQL_FREE


def test_core_stands_without_llm():
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for folder, _, names in os.walk(f"{root}/linkweave"):
        if os.path.basename(folder) == "llm":
            continue
        for n in names:
            if n.endswith(".py"):
                assert not re.search(r"^\s*(from|import) linkweave\.llm", open(f"{folder}/{n}").read(), re.M), n
