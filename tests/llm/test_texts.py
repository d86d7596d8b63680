import os
import random

import pytest

from linkweave.llm import bpe_trie, leaks, truncation

VOCABULARY = os.environ.get("LINKWEAVE_VOCABULARY", bpe_trie.DEFAULT_VOCABULARY)
ODD = ["", "  ", "<|endoftext|> x", "a" * 5000, "नमस्ते दुनिया। " * 40, "ñandú€😀‍👍", "\x00\x01\n\r\n\t x", "TXN_0002640117 12,345.67", "I'll we've don't", "-" * 400 + " " * 300, "ΑΣ ß İ"]


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary")
def test_encoding_equals_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    rnd = random.Random(1)
    texts = ODD + ["".join(rnd.choice("ab eéनह1 2.,'\n😀") for _ in range(rnd.randrange(300))) for _ in range(150)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate([*texts, None])], "doc_id bigint, text string").selectExpr("*", "1 as ids")
    got = {r["doc_id"]: r["ids"] for r in bpe_trie.encode(df, vocabulary=VOCABULARY).collect()}
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)] + [[]]
    assert [got[i] for i in range(len(want))] == want
    assert [t.decode(got[i], skip_special_tokens=False) for i in range(len(texts))] == texts
    assert bpe_trie.encode(df.limit(0), vocabulary=VOCABULARY).count() == 0


def _leaks(docs, items, n=12):
    out = set()
    for i, p in items:
        w = leaks.words_of(p)
        have = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        for d, t in docs:
            x = leaks.words_of(t)
            if any(tuple(x[k : k + n]) in have for k in range(len(x) - n + 1)):
                out.add((d, i))
    return out


def _corpus():
    rnd = random.Random(2)
    vocabulary = [f"w{i}" for i in range(300)] + ["दुकान", "naïve", "Straße"]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(f"I{i}", text(rnd.choice([5, 12, 40, 90]))) for i in range(20)] + [("null", None), ("blank", " ")]
    items.append(("twin", items[3][1]))
    docs = [(i, text(rnd.randrange(5, 200))) for i in range(60)]
    for i in range(60, 120):
        w = leaks.words_of(rnd.choice(items[:20])[1])
        k = rnd.randrange(len(w))
        docs.append((i, (text(20) + "; " + " -- ".join(x.upper() for x in w[k : k + rnd.choice([8, 11, 12, 13, 60])]) + "\n" + text(9))))
    return docs + [(900, None), (901, "")], items


def test_leaks(spark, monkeypatch):
    docs, items = _corpus()
    d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "'c' as item_id", "2 as windows")
    i = spark.createDataFrame(items, "item_id string, passage string").selectExpr("*", "1 as doc_id")
    found = leaks.find_leaks(d, i).cache()
    want = _leaks(docs, items)
    assert want and {(r["doc_id"], r["item_id"]) for r in found.where("run_words >= 12").collect()} == want
    monkeypatch.setattr(leaks, "BLOCK_WORDS", 100)
    assert {(r["doc_id"], r["item_id"]) for r in leaks.find_leaks(d, i).where("run_words >= 12").collect()} == want
    assert leaks.find_leaks(d.limit(0), i).count() == 0 and leaks.find_leaks(d, i.limit(0)).count() == 0


def test_hamming_index_finds_all_within_the_radius():
    import numpy as np

    rng = np.random.default_rng(3)
    prints = rng.integers(0, 2**63, 400, dtype=np.uint64)
    queries = prints[rng.integers(0, 400, 300)] ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64))
    q, p = leaks.HammingIndex(prints, 3).near(queries)
    want = {(i, j) for i in range(300) for j in range(400) if int(queries[i] ^ prints[j]).bit_count() <= 3}
    assert set(zip(q.tolist(), p.tolist())) == want and len(q) == len(want)


def test_truncated(spark):
    rnd = random.Random(4)
    ends = ["and the customer agreed", "so the case stays open", "which fits a family plan"]
    sentence = lambda: f"The {rnd.choice(['older device', 'night crew', 'branch officer', 'merchant desk'])} {rnd.choice(['checked', 'reported', 'matched'])} score 0.{rnd.randrange(10, 99)} on the outgoing leg, {rnd.choice(ends)}"
    docs, cut = [], set()
    for i in range(400):
        src = f"note_{i % 6}"
        t = ". ".join(sentence() for _ in range(rnd.randrange(2, 6)))
        if i % 6 == 0:
            if len(t) > 240:
                cut.add(i)
                t = t[:240]
                if t.endswith(tuple(ends)) or t[-1] in ".,":
                    t = t[:-4] + "zzzz"
        elif i % 17 == 0:
            cut.add(i)
            t = t[: t.rfind("outgoing") + 5]
            t = t + rnd.choice(["", " (more)", "…", "  \n"])
        else:
            t += rnd.choice([".", ".", "...", "", ".\nCase closed", "!"])
        docs.append((i, t, None if i % 50 == 49 else src))
    docs += [(1000, docs[17][1], "note_5"), (1001, None, "x"), (1002, "", "x"), (1003, " \n ", "x"), (1004, '{"a": "b", "c": "open', "x"), (1005, '{"a": "b"}', "x"), (1006, "The night crew checked sco�", None)]
    cut |= {1000, 1004, 1006}
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string").selectExpr("*", "1 as key", "2 as n", "3 as reason")
    got = {r["doc_id"] for r in truncation.truncated(df).collect()}
    assert len(got - cut) <= 3, sorted(got - cut)[:9]
    assert len(cut - got) <= 0.08 * len(cut), sorted(cut - got)[:9]
    shares = {r["source"]: r for r in truncation.truncation_shares(df).collect()}
    assert shares["x"]["texts"] == 2 and shares["x"]["cut"] == 1
    assert truncation.truncated(df.limit(0)).count() == 0


def test_a_cut_inside_a_word_of_any_length_is_seen(spark):
    word = "".join("abcdefghij"[i * 7 % 10] + "klmnopqrst"[i * 3 % 10] for i in range(60))
    rows = [(i, f"Desk {i} reviewed the file {word} before noon.", f"s{i % 5}") for i in range(40)]
    rows += [(100 + n, "x " * n + f"Desk 7 reviewed the file {word[:n]}", "s9") for n in (15, 30, 50, 119)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    assert {r["doc_id"]: r["reason"] for r in truncation.truncated(df).collect()} == {115: "tail", 130: "tail", 150: "tail", 219: "tail"}


def test_spikes_decide_first(spark):
    rnd = random.Random(9)
    words = ["desk", "card", "queue", "score", "branch", "ledger", "window", "notice"]
    text = lambda n: (" ".join(rnd.choice(words) for _ in range(60)))[:n]
    rows = [(i, text(rnd.randrange(60, 150)) + ".", "a") for i in range(300)]
    rows += [(1000 + i, text(160).rstrip().ljust(160, "q"), "a") for i in range(30)]
    rows += [(2000 + i, "ñ" * 10 + text(130).ljust(130, "q"), "b") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r["doc_id"]: r["reason"] for r in truncation.truncated(df).collect()}
    assert {i for i, r in got.items() if r == "limit"} >= {r[0] for r in rows if r[0] >= 1000} and not any(i < 1000 for i in got)


def test_words_of_long_texts_are_those_of_their_pieces(monkeypatch):
    import numpy as np

    from linkweave.llm import wordscan

    rnd = random.Random(8)
    text = "\n".join(" ".join("".join(rnd.choice("abñहé1") for _ in range(rnd.randrange(1, 9))) for _ in range(rnd.randrange(1, 12))) + rnd.choice(["", ".", "..", ", "]) for _ in range(120)) + " " + "z" * 900 + " end of it"
    whole = wordscan.Scan.of([text.lower()])
    assert [whole.string(a, b) for a, b in zip(whole.start, whole.end)] == wordscan.WORD.findall(text.lower())
    every = lambda keys: np.ones(len(keys), bool)

    def seen(parts):
        out = {}
        for piece, low, high in parts:
            for k in truncation._seen(wordscan.Scan.of([piece.lower()], digits=False), np.array([low]), np.array([high]), every).tolist():
                out[k] = out.get(k, 0) + 1
        return out

    want = seen([(text, 0, len(text))])
    monkeypatch.setattr(wordscan, "CHUNK", 200)
    assert (wordscan.word_hashes(text) == whole.words()).all()
    assert len(list(truncation._pieces(text))) > 10 and seen(truncation._pieces(text)) == want


def test_edited_passages_leak(spark):
    rnd = random.Random(6)
    vocabulary = [f"word{i}" for i in range(4000)]
    words = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [(f"I{i}", words(rnd.choice([60, 75, 110]))) for i in range(100)] + [("short", words(9))]
    docs, want = [], {}
    for name, w in items:
        for kind in (10, 12, 20, "dropped", "inserted", "whole"):
            x = list(w)
            if isinstance(kind, int):
                for j in range(rnd.randrange(kind), len(x), kind):
                    x[j] = rnd.choice(vocabulary)
            elif kind == "dropped":
                del x[len(x) // 2]
            elif kind == "inserted":
                x.insert(len(x) // 3, "else")
            want[len(docs)] = (name, kind)
            docs.append((len(docs), " ".join([*words(rnd.randrange(80)), *x, *words(rnd.randrange(80))])))
    other = len(docs)
    docs += [(i, " ".join(words(150))) for i in range(other, other + 100)]
    found = leaks.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id string, passage string")).collect()
    got = {(r["doc_id"], r["item_id"]): r for r in found}
    for kind in (10, 12, 20, "dropped", "inserted", "whole"):
        mine = [d for d, (i, k) in want.items() if k == kind and i != "short"]
        assert sum((d, want[d][0]) in got for d in mine) >= 0.9 * len(mine), kind
    assert all(d in want and want[d][0] == i for d, i in got)
    assert ({d for d, i in got if i == "short"} & {d for d, x in want.items() if x == ("short", "whole")}) and min(r["similarity"] for r in found) < 1


def test_similarity_against_brute_force():
    import numpy as np

    rnd = random.Random(7)
    for _ in range(40):
        n = rnd.randrange(5, 30)
        texts = [[rnd.randrange(1, 4) for _ in range(n + 4)] for _ in range(2)]
        if rnd.random() < 0.7:
            texts[1][3:] = texts[0][3:]
            texts[1][n // 2] = 9
        weights = [[rnd.random() for _ in range(n)] for _ in range(2)]
        grams = [[tuple(t[i : i + 5]) if i + 5 <= n + 4 else None for i in range(n + 4)] for t in texts]
        have = [set(g) - {None} for g in grams]
        both = total = 0.0
        for k in (0, 1):
            for j in range(n):
                total += weights[k][j]
                both += weights[k][j] * any(grams[k][i] in have[1 - k] for i in range(j, j + 5) if grams[k][i])
        names = {g: i + 1 for i, g in enumerate(sorted(have[0] | have[1]))}
        x, y = (np.array([[names.get(v, 0) for v in g]], np.uint64) for g in grams)
        assert abs(leaks.similarity(x, y, *(np.array([w]) for w in weights))[0] - both / total) < 1e-12


def test_a_wide_radius_finds_all(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    prints = rng.integers(0, 2**63, 900, dtype=np.uint64)
    queries = prints[rng.integers(0, 900, 60)].copy()
    for _ in range(14):
        queries ^= np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)
    q, p = leaks.HammingIndex(prints, 15).near(queries)
    want = {(i, j) for i in range(60) for j in range(900) if int(queries[i] ^ prints[j]).bit_count() <= 15}
    assert set(zip(q.tolist(), p.tolist())) == want and len(q) == len(want) >= 60
