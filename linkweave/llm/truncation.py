"""Text cut off by field limits or in transfer.

First, per source and in characters and bytes, histograms of text lengths: a
spike at a length the source's texts do not exceed by themselves is a limit, and
a text at the spike without a terminal mark is cut there. Then, for texts away
from any spike, what proves itself: a cut mark behind the text, half a
character, a record never closed, and last words that elsewhere in the corpus go
on, or begin a longer word, and hardly ever end anything.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkweave.llm import wordscan
from linkweave.llm.wordscan import Scan, fold
from linkweave.plans.durable import Scratch
from linkweave.plans.layout import spread

#: What systems put behind a cut: fixed patterns.
MARKER = regex.compile(r"\s*(?:[(\[<{]\s*(?:more|cut|cont|continued|truncated|snip|clipped)\.{0,3}\s*[)\]>}]|…)\s*$", regex.I)
_MARKER_ENDS = frozenset(")]>}…")
_TERMINAL = regex.compile(r"[\s\"'”’»)\]}]*[.!?।॥。]|[^\w\s]*[\]}]")
_RECORD = regex.compile(r'\s*\{\s*"')
#: Marks that join two words when no blank stands beside them: decimals, ids, addresses, compounds.
_JOINT = regex.compile(r"[.,_\-'’/:~=@&+]+")
_BACKWARDS = regex.compile(r"(?r)[\p{L}\p{M}\p{N}]+")
ORDERS = 4
#: Smallest number of texts, and of sources, that make a closing line.
FINAL_TEXTS, FINAL_SOURCES = 8, 3
#: Bits (as a power of 2) of the filter of contexts asked for: 8 MB at every size of the data. A full one lets more rows through to the exact join, and loses none.
FILTER_BITS = 26

#: Keys of contexts leave the low three bits to the column they are counted in.
_KEY = ~np.uint64(7)
_LINE_START, _FIRST, _OWN, _BEGUN, _LAST = wordscan.mix(np.arange(1, 6, dtype=np.uint64))


def core(text: str) -> tuple[str, bool]:
    """The text without blanks at its end and markers behind a cut; whether there was a marker."""
    text = text.rstrip()
    m = MARKER.search(text, max(0, len(text) - 200)) if text[-1:] in _MARKER_ENDS else None
    return (text[: m.start()].rstrip(), True) if m else (text, False)


def _dots(tail: str) -> bool:
    return tail[:2] == ".." or tail[:1] == "…"


def _before(words: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    """Per order 1 to ORDERS, hash of the order - 1 words before each word in its line; place counts words within the line, and before the first stands the line's start. An order holds for a word where place >= order - 2."""
    out = [np.full(len(words), _FIRST)]
    for back in range(1, ORDERS):
        shifted = np.concatenate([np.zeros(min(back, len(words)), np.uint64), words[:-back]])
        out.append(fold(out[-1], np.where(place >= back, shifted, _LINE_START)))
    return out


def _places(scan: Scan) -> np.ndarray:
    """Number of each word within its line."""
    line = np.cumsum(scan.codes == 10)[scan.start]
    at = np.arange(len(line))
    first = np.r_[True, line[1:] != line[:-1]] if len(line) else np.empty(0, bool)
    return at - np.maximum.accumulate(np.where(first, at, 0))


def _kinds(scan: Scan, place: np.ndarray) -> np.ndarray:
    """What follows each word, as its place in "twcne": terminal mark, another word (perhaps joined), other punctuation, the line's end, the text's end."""
    breaks = np.flatnonzero(scan.codes == 10)
    stop = breaks[np.searchsorted(breaks, scan.end)]
    after = np.r_[scan.start[1:], len(scan.codes)]
    last = stop < after
    stop = np.minimum(stop, after)
    ends_text = np.r_[scan.text[1:] != scan.text[:-1], True]
    # dots at a text's end may stand for what was cut, so they are no evidence of a sentence's end
    place_kind = np.where(last, np.where(ends_text, 2, 1), 0).astype(np.uint64)
    key = fold(scan.hashes(scan.end, stop), place_kind)
    _, first, back = np.unique(key, return_index=True, return_inverse=True)
    kinds = np.empty(len(first), np.uint8)
    for k, i in enumerate(first.tolist()):
        gap = scan.string(scan.end[i], stop[i])
        if not last[i]:
            kinds[k] = 1 if _JOINT.fullmatch(gap) else 0 if _TERMINAL.match(gap) else 2 if gap.strip() else 1
        elif _TERMINAL.match(gap) and not (ends_text[i] and _dots(gap.strip())):
            kinds[k] = 0
        else:
            kinds[k] = 4 if ends_text[i] else 3
    return kinds[back]


def _pieces(text: str) -> Iterator[tuple[str, int, int]]:
    """(piece, from, to): a long text in pieces that begin ORDERS words early and end a word late, with the part to be counted."""
    at = wordscan.cuts(text)
    for a, b in zip(at, at[1:]):
        lead = a
        for _, m in zip(range(ORDERS), _BACKWARDS.finditer(text, 0, a)):
            lead = m.start()
        more = wordscan.WORD.match(text, b)
        end = more.end() if more else b
        yield text[lead:end], a - lead, b - lead


def _seen(scan: Scan, low: np.ndarray, high: np.ndarray, asked: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The key of everything asked for, with its column in the low bits: contexts with what follows (t w c n as 0 to 3), beginnings of longer words behind a context (4). Words of text i count if they start in [low[i], high[i])."""
    words = scan.words()
    place = _places(scan)
    kinds = _kinds(scan, place)
    inside = scan.start - scan.offset[scan.text]
    counted = (kinds != 4) & (inside >= low[scan.text]) & (inside < high[scan.text])
    column = kinds.astype(np.uint64)
    before = _before(words, place)
    keys = []
    for order, b in enumerate(before, 1):
        at = np.flatnonzero(counted & (place >= order - 2))
        key = fold(b[at], words[at] ^ _OWN) & _KEY
        hit = asked(key)
        keys.append(key[hit] | column[at[hit]])
    # beginnings of each word: up to every character inside it
    size = scan.end - scan.start - 1
    word = np.repeat(np.flatnonzero(counted), size[counted])
    begun = np.arange(len(word)) - np.repeat(np.cumsum(size[counted]) - size[counted], size[counted])
    start = scan.start[word]
    part = scan.hashes(start, start + begun + 1)
    hit = asked(part ^ _LAST)
    word, part = word[hit], part[hit]
    for order, b in enumerate(before, 1):
        at = place[word] >= order - 2
        key = fold(b[word[at]], part[at] ^ _BEGUN) & _KEY
        keys.append(key[asked(key)] | np.uint64(4))
    return np.concatenate(keys)


def _counts(filter_words: tuple[np.ndarray, np.ndarray]):
    """Counts of the contexts in the filter, summed over many texts at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
        bits[filter_words[0]] = filter_words[1].view(np.uint64)
        held: list[tuple[np.ndarray, np.ndarray]] = []  # sorted keys with columns, and how often

        def asked(key: np.ndarray) -> np.ndarray:
            at = key >> np.uint64(64 - FILTER_BITS)
            return (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1

        def merged() -> tuple[np.ndarray, np.ndarray]:
            key, n = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(key)
            key, n = key[order], n[order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
            return key[first], np.add.reduceat(n, first) if len(key) else n

        def out() -> pa.RecordBatch:
            key, n = merged()
            held.clear()
            keys, back = np.unique(key & _KEY, return_inverse=True)
            wide = np.zeros((len(keys), 5), np.int64)
            wide[back, (key & ~_KEY).astype(np.int64)] = n
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *(pa.array(wide[:, k]) for k in range(5))], names=["key", *"twcn", "more"])

        def take(scan: Scan, low, high) -> bool:
            key = np.sort(_seen(scan, low, high, asked))
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
            held.append((key[first], np.diff(np.r_[first, len(key)])))
            if sum(len(k) for k, _ in held) > 1_000_000:
                held[:] = [merged()]
                return len(held[0][0]) > 500_000
            return False

        for b in batches:
            texts = [core(t)[0].lower() for t in b.column(0).to_pylist() if t]
            for some in wordscan.batches(texts):
                if len(texts[some[0]]) > wordscan.CHUNK:
                    todo = (([p], np.array([lo]), np.array([hi])) for p, lo, hi in _pieces(texts[some[0]]))
                else:
                    part = [texts[i] for i in some]
                    todo = [(part, np.zeros(len(part), int), np.array([len(t) for t in part]))]
                for part, low, high in todo:
                    if take(Scan.of(part, digits=False), low, high):
                        yield out()
        if held:
            yield out()

    return run


def _tail(body: str) -> tuple[str, str] | None:
    """The last ORDERS words of the last line that has one, up to the line's end, and what stands behind them there."""
    end = len(body)
    for m in _BACKWARDS.finditer(body):
        stop = body.find("\n", m.end())
        end = len(body) if stop < 0 else stop
        line = body.rfind("\n", 0, m.start()) + 1
        start = m.start()
        for _, w in zip(range(ORDERS), _BACKWARDS.finditer(body, line, m.end())):
            start = w.start()
        return body[start : m.end()].lower(), body[m.end() : end].strip()
    return None


_ENDS = "doc_id bigint, source string, chars int, bytes int, h1 bigint, h2 bigint, marked boolean, broken boolean, record boolean, closed boolean, tail string, number boolean, stopped boolean, keys array<bigint>, begun array<bigint>, last bigint"


def _ends_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        bodies = [core(t) for t in b.column("text").to_pylist()]
        tails = [_tail(body) for body, _ in bodies]
        have = [i for i, t in enumerate(tails) if t]
        keys, begun = [None] * len(tails), [None] * len(tails)
        last: list = [None] * len(tails)
        number = [False] * len(tails)
        if have:
            scan = Scan.of([tails[i][0] for i in have], digits=False)
            words, place = scan.words(), _places(scan)
            before = _before(words, place)
            at = np.flatnonzero(np.r_[scan.text[1:] != scan.text[:-1], True])
            own = [(fold(x[at], words[at] ^ _OWN) & _KEY).view(np.int64).tolist() for x in before]
            more = [(fold(x[at], words[at] ^ _BEGUN) & _KEY).view(np.int64).tolist() for x in before]
            spot = (words[at] ^ _LAST).view(np.int64).tolist()
            zero = (scan.codes[scan.end[at] - 1] == 48).tolist()
            for n, (i, p) in enumerate(zip(have, place[at].tolist())):
                orders = range(min(ORDERS, p + 2) - 1, -1, -1)  # longest first
                keys[i], begun[i] = [own[o][n] for o in orders], [more[o][n] for o in orders]
                last[i], number[i] = spot[n], zero[n]
        tail = [t[1] if t else None for t in tails]
        stopped = [bool(t) and bool(_TERMINAL.match(t)) and not _dots(t) for t in tail]
        flags = [[m for _, m in bodies], [x.endswith("�") for x, _ in bodies], [bool(_RECORD.match(x)) for x, _ in bodies], [x.endswith("}") for x, _ in bodies]]
        kept = ["doc_id", "source", "chars", "bytes", "h1", "h2"]
        longs = pa.list_(pa.int64())
        cols = [*(b.column(k) for k in kept), *(pa.array(f, pa.bool_()) for f in flags), pa.array(tail, pa.string()), pa.array(number, pa.bool_()), pa.array(stopped, pa.bool_()), pa.array(keys, longs), pa.array(begun, longs), pa.array(last, pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=[*kept, "marked", "broken", "record", "closed", "tail", "number", "stopped", "keys", "begun", "last"])


def complete_end(tail: str, number: bool, keys: list[int], begun: list[int], stats: dict) -> str:
    """How a line ends: mark, final, end (as elsewhere), cut or unknown."""
    dots = _dots(tail)
    number = tail == "." and number
    if tail and _TERMINAL.match(tail) and not dots and not number:
        return "mark"
    if tail and tail[-1] in ",;:([{<\"'~-=/&@#_+":
        return "cut"
    own = [stats.get(k, {}) for k in keys]
    more = [stats.get(k, {}).get("more") or 0 for k in begun]
    if not tail and own and (own[0].get("e") or 0) >= FINAL_TEXTS and (own[0].get("sources") or 0) >= FINAL_SOURCES and own[0]["e"] > max(own[0].get("w") or 0, more[0]):
        return "final"
    if tail and not dots and not number:
        return "end"
    for i, s in enumerate(own):
        t, w, c, n = (s.get(k) or 0 for k in "twcn")
        if more[i] >= 2 and t + w + c + n <= 0.05 * more[i] and not number:
            return "cut"
        if t + w + c + n >= 3:
            if number:  # a number's point: cut only if it hardly ever is the sentence's
                return "cut" if t + n <= 0.02 * w else "mark"
            if t + n and t + n >= (0.15 if len(own) - i >= 3 else 0.05) * (t + n + w):
                return "mark" if dots else "end"
            return "cut" if w + c else "end"
    return "mark" if tail else "unknown"


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [complete_end(r["tail"], r["number"], r["keys"], r["begun"], {s["key"]: s for s in r["stats"]}) for r in b.to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["point", "end"])


def _filter_of(keys: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The bits set by `key`, as (place, 64 bits) of the words that have any: at most 2 ** (FILTER_BITS - 6) of them, however many keys there are."""
    at = F.shiftrightunsigned("key", 64 - FILTER_BITS)
    words = keys.select(F.shiftright(at, 6).alias("at"), F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(key, {64 - FILTER_BITS}) & 63 AS INT))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits"))
    got = words.toArrow()
    return got.column("at").to_numpy(), got.column("bits").to_numpy()


def sized(documents: DataFrame) -> DataFrame:
    """(doc_id, source, chars, bytes, h1, h2, text) of each text that is not blank: its lengths, and a 128-bit hash of it without blanks at its end."""
    docs = spread(documents.where(F.col("text").rlike(r"\S")).select("doc_id", "text", "source"))
    return docs.select("doc_id", "source", F.length("text").alias("chars"), F.octet_length("text").alias("bytes"), *[F.xxhash64(F.lit(k), F.rtrim("text")).alias(f"h{k}") for k in (1, 2)], "text")


def limits(ended: DataFrame, least: int = 4, ratio: float = 8.0, around: int = 40) -> DataFrame:
    """(source, unit, length): lengths (chars or bytes) at which a source's texts pile up.

    A length is a spike if at least `least` different texts (by h1, h2) have it,
    `ratio` times as many as an average length within `around` of it, and at least
    half as many as all longer texts together. Histograms have one row per source and
    length, however many texts there are; sources of null are one source.
    """
    each = F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("length")))
    rows = ended.select(F.coalesce("source", F.lit("")).alias("source"), "h1", "h2", "chars", "bytes").distinct()
    hist = rows.select("source", F.explode(each).alias("u")).select("source", "u.*").groupBy("source", "unit", "length").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("source", "unit").orderBy("length")
    near = F.sum("n").over(w.rangeBetween(-around, around)) - F.col("n")
    longer = F.sum("n").over(w.rangeBetween(1, Window.unboundedFollowing))
    spike = (F.col("n") >= least) & (F.col("n") >= ratio * F.col("near") / (2 * around)) & (F.col("n") * 2 >= F.coalesce("longer", F.lit(0)))
    return hist.withColumn("near", near).withColumn("longer", longer).where(spike).select("source", "unit", "length")


def truncated(documents: DataFrame) -> DataFrame:
    """(doc_id, source, reason) of each cut text; reason is limit, marked, broken, record, tail or copy.

    limit: at a length spike of its source (characters or bytes) and without a
    terminal mark, closed record or closing line. Away from a spike: marked, a
    system's marker stands behind the cut; broken, it ends in a replacement
    character; record, a record opened and never closed; tail, its last words go
    on elsewhere. copy: equal to a text cut by one of these. Null, empty and
    blank texts are complete; repeated rows are reported once per doc_id; rows
    without a doc_id count in the statistics but can't be reported; an empty
    table gives an empty result.

    Texts are read twice: for their ends and lengths, and to count what follows
    the last words some text ends in. Only contexts that pass a filter of fixed
    size built from the first reading leave a worker, summed.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark)
    lengths = sized(documents)
    docs = lengths.select("text")
    ended = scratch.write(lengths.mapInArrow(_ends_of, _ENDS), "ends")

    # texts that end alike are one point
    alike = ["tail", "number", "keys", "begun"]
    pointed = ended.where("keys IS NOT NULL").withColumn("point", F.xxhash64(*alike))
    points = scratch.write(pointed.select("point", "last", *alike).dropDuplicates(["point"]), "points")
    keys = points.select(F.explode(F.concat("keys", "begun", F.array("last"))).alias("key")).distinct()
    seen = docs.mapInArrow(_counts(_filter_of(keys)), "key bigint, t bigint, w bigint, c bigint, n bigint, more bigint")
    counts = seen.groupBy("key").agg(*[F.sum(k).alias(k) for k in (*"twcn", "more")])
    # how many texts end in a line's whole words without a mark, and of how many sources
    closing = pointed.where("NOT stopped").select(F.col("keys")[0].alias("key"), F.coalesce("source", F.lit("")).alias("source")).groupBy("key", "source").agg(F.count(F.lit(1)).alias("e")).groupBy("key").agg(F.sum("e").alias("e"), F.count(F.lit(1)).alias("sources"))
    asked = points.select("point", F.explode(F.concat("keys", "begun")).alias("key"))
    stats = counts.join(closing, "key", "full")
    own = asked.join(stats, "key").groupBy("point").agg(F.collect_list(F.struct("key", *"twcn", "more", "e", "sources")).alias("stats"))  # at most 2 x ORDERS a point
    none = F.array().cast(own.schema["stats"].dataType)
    judged = points.join(own, "point", "left").select("point", *alike, F.coalesce("stats", none).alias("stats")).mapInArrow(_judged, "point bigint, end string")

    found = scratch.write(limits(ended), "limits")
    every = ended.withColumn("point", F.when(F.col("keys").isNotNull(), F.xxhash64(*alike)))
    for unit in ("chars", "bytes"):
        at = found.where(F.col("unit") == unit).select(F.col("source").alias("s"), F.col("length").alias(unit), F.lit(True).alias(f"at_{unit}"))
        every = every.withColumn("s", F.coalesce("source", F.lit(""))).join(at, ["s", unit], "left").drop("s")
    spike = F.coalesce("at_chars", F.lit(False)) | F.coalesce("at_bytes", F.lit(False))
    open_ = F.when(F.col("record"), ~F.col("closed")).otherwise((F.coalesce("end", F.lit("")) == "cut") | (spike & F.coalesce("end", F.lit("")).isin("end", "unknown")))
    reason = F.when(F.col("marked") | F.col("broken") | open_, F.when(spike, "limit").when(F.col("marked"), "marked").when(F.col("broken"), "broken").when(F.col("record"), "record").otherwise("tail")).otherwise("")
    named = scratch.write(every.join(judged, "point", "left").select("doc_id", "source", "h1", "h2", reason.alias("reason")), "reasons")
    cut = named.where("reason <> ''").select("h1", "h2").distinct()
    out = named.join(cut, ["h1", "h2"]).where("doc_id IS NOT NULL").select("doc_id", "source", F.when(F.col("reason") == "", "copy").otherwise(F.col("reason")).alias("reason"))
    return out.groupBy("doc_id").agg(F.min(F.struct("source", "reason")).alias("r")).select("doc_id", "r.source", "r.reason")


def truncation_shares(documents: DataFrame) -> DataFrame:
    """(source, texts, cut, share): per source, its non-blank texts, how many are cut and their share."""
    docs = documents.where(F.col("text").rlike(r"\S")).select("doc_id", "source").distinct()
    flagged = docs.join(truncated(documents).select("doc_id").withColumn("cut", F.lit(1)), "doc_id", "left")
    return flagged.groupBy("source").agg(F.count(F.lit(1)).alias("texts"), F.count("cut").alias("cut")).withColumn("share", F.col("cut") / F.col("texts"))
