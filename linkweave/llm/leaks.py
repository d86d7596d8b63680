"""Evaluation texts leaking into training text: SimHash of item-sized windows behind a multi-index Hamming search, verified by weighted five-word shingles."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.llm import wordscan
from linkweave.llm.wordscan import WORD, Scan, fold
from linkweave.plans.layout import spread

#: Words of items searched for at a time; more items than that are searched in further blocks.
BLOCK_WORDS = 250_000

SHINGLE = 5
#: Radius of windows of the smallest size, where equal ones are at distance 0, and of item-sized ones. Of passages with every tenth word replaced 996 in 1000 are found at 11 as at 15, since one of the windows at each alignment is enough.
NEAR_RADIUS, EDIT_RADIUS = 3, 11
_BLOCKS = 4


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def shingles(words: np.ndarray) -> np.ndarray:
    """Hash of the five words from each place on; the last four places have none."""
    out = words[: max(len(words) - SHINGLE + 1, 0)]
    for k in range(1, SHINGLE):
        out = fold(out, words[k : len(out) + k])
    return out


def fingerprints(words: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """SimHash (64 bits) of the window from each of the sorted places `at`: bit by bit the majority of its words. Words outside all windows are not looked at."""
    if not len(at):
        return np.empty(0, np.uint64)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + window, -1)
    needed = np.cumsum(edges[:-1]) > 0
    rank = np.cumsum(needed) - 1
    bits = np.unpackbits(words[needed].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.zeros((len(bits) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=sums[1:])
    first = rank[at]
    return np.packbits((sums[first + window] - sums[first]) * 2 > window, axis=1, bitorder="little").view(np.uint64).ravel()


class HammingIndex:
    """Fingerprints by each of their four 16-bit blocks. Two within the radius agree in some block up to radius // 4 bits (pigeonhole), so looking up every block under all such changes finds all of them."""

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius = prints, radius
        width, each = 64 // _BLOCKS, radius // _BLOCKS
        flips = [sum(1 << b for b in bits) for k in range(each + 1) for bits in itertools.combinations(range(width), k)]
        self.flips, self.width, self.blocks = np.array(flips, np.uint64), np.uint64(width), []
        for k in range(_BLOCKS):
            key = self._block(prints, k)
            self.blocks.append((np.cumsum(np.bincount(key + 1, minlength=(1 << width) + 1)), np.argsort(key, kind="stable")))

    def _block(self, prints: np.ndarray, k: int) -> np.ndarray:
        return ((prints >> (np.uint64(k) * self.width)) & np.uint64((1 << int(self.width)) - 1)).astype(np.int64)

    def near(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query index, print index) of every pair within the radius, without repeats."""
        found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        if len(self.prints) <= len(self.flips):  # fewer prints than blocks to look up: compared one by one
            step = max(1, 4_000_000 // max(len(self.prints), 1))
            for lo in range(0, len(queries), step):
                q, p = np.nonzero(np.bitwise_count(queries[lo : lo + step, None] ^ self.prints[None, :]) <= self.radius)
                found.append((q + lo, p))
            return tuple(np.concatenate(x) for x in zip(*found))
        step = max(1, 400_000 // len(self.flips))
        for k, (upto, order) in enumerate(self.blocks):
            for lo in range(0, len(queries), step):
                part = queries[lo : lo + step]
                key = self._block(part, k)[:, None] ^ self.flips.astype(np.int64)[None, :]
                n = upto[key + 1] - upto[key]
                full = np.flatnonzero(n)
                first, n = upto[key].ravel()[full], n.ravel()[full]
                ends = np.cumsum(n)
                for a, b in _slices(ends, 4_000_000):
                    m = n[a:b]
                    q = np.repeat(full[a:b] // len(self.flips), m)
                    p = order[np.repeat(first[a:b], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)]
                    close = np.bitwise_count(part[q] ^ self.prints[p]) <= self.radius
                    found.append((q[close] + lo, p[close]))
        q, p = (np.concatenate(x) for x in zip(*found))
        size = max(len(self.prints), 1)
        pair = np.unique(q * np.int64(size) + p)
        return pair // size, pair % size


def _slices(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of a running total that add up to about `most` each."""
    a = 0
    while a < len(ends):
        done = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield a, b
        a = b


@dataclass
class Size:
    """The item windows of one size; documents are looked at every `stride` words."""

    window: int
    stride: int
    position: np.ndarray  # of each window in the items' words
    item: np.ndarray
    index: HammingIndex


def sizes_of(length: int, window: int) -> list[tuple[int, int]]:
    """(window size, stride) for an item of so many words: `window` at every word, its doublings at half a window as long as one of those must lie within the item, and for items too short for any their own length at every word."""
    out, size = ([(window, 1)] if length >= window else []), 2 * window
    while size + size // 2 - 1 <= length:
        out.append((size, size // 2))
        size *= 2
    if SHINGLE <= length < 3 * window - 1 and length != window:
        out.append((length, 1))
    return out


class Items:
    """Word hashes of a block of items, end to end, with a SimHash index per window size."""

    def __init__(self, rows: list[tuple[str, str]], window: int, radius: int, edit_radius: int):
        self.ids = [i for i, _ in rows]
        words = [wordscan.word_hashes(t) for _, t in rows]
        start = np.cumsum([0, *map(len, words)])
        self.words = np.concatenate([np.empty(0, np.uint64), *words])
        self.start = start
        every = shingles(self.words)
        owner = np.searchsorted(start, np.arange(len(every)), side="right") - 1
        whole = np.arange(len(every)) + SHINGLE <= start[owner + 1] if len(every) else np.empty(0, bool)
        one = np.unique(np.stack([every[whole], owner[whole].astype(np.uint64)]), axis=1)
        self.known, n = np.unique(one[0], return_counts=True)
        self.weight = np.log1p(len(rows) / np.maximum(n, 1))
        self.rare = math.log1p(len(rows))
        self.shingle = np.full(len(self.words), 0, np.uint64)
        self.shingle[: len(every)][whole] = every[whole]
        self.heavy = self.position_weights(self.shingle)
        #: where each known shingle stands, -1 if at several places
        at = np.flatnonzero(self.shingle)
        self.place = np.full(len(self.known), -1, np.int64)
        spots, n = np.searchsorted(self.known, self.shingle[at]), np.zeros(len(self.known), np.int64)
        np.add.at(n, spots, 1)
        self.place[spots] = at
        self.place[n > 1] = -1
        by_size: dict[tuple[int, int], list[int]] = {}
        for no, w in enumerate(words):
            for size in sizes_of(len(w), window):
                by_size.setdefault(size, []).append(no)
        self.sizes = []
        for (size, stride), owners in sorted(by_size.items()):
            position = np.concatenate([np.arange(start[o], start[o + 1] - size + 1) for o in owners])
            own = np.concatenate([np.full(start[o + 1] - start[o] - size + 1, o) for o in owners])
            self.sizes.append(Size(size, stride, position, own, HammingIndex(fingerprints(self.words, position, size), radius if size == window else edit_radius)))

    def position_weights(self, shingle: np.ndarray) -> np.ndarray:
        """Weight of each word: the largest of the shingles over it (0 stands for no shingle); one counts the more the fewer items have it."""
        w = np.full(len(shingle), self.rare)
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, shingle), len(self.known) - 1)
            hit = self.known[at] == shingle
            w[hit] = self.weight[at[hit]]
        w[shingle == 0] = 0
        out = w.copy()
        for back in range(1, SHINGLE):
            out[back:] = np.maximum(out[back:], w[: len(w) - back])
        return out

    def places(self, shingle: np.ndarray) -> np.ndarray:
        """Where each shingle stands in the items: -1 if at several places, -2 if nowhere."""
        if not len(self.known):
            return np.full(len(shingle), -2)
        at = np.minimum(np.searchsorted(self.known, shingle), len(self.known) - 1)
        return np.where(self.known[at] == shingle, self.place[at], -2)


def _around(shingle: np.ndarray, at: np.ndarray, low: np.ndarray, window: int) -> np.ndarray:
    """Shingles that touch the window from each place, one row each: those from four words before it, not before `low`, to its end; 0 where there is none."""
    spots = at[:, None] + np.arange(1 - SHINGLE, window)
    return np.where(spots >= low[:, None], shingle[np.maximum(spots, 0)], 0)


def _covered(hit: np.ndarray, width: int) -> np.ndarray:
    """Which of the `width` words of each window some shingle hit lies over; hit has the shingles from four words before the window on."""
    n = np.zeros((len(hit), hit.shape[1] + 1), np.int16)
    np.cumsum(hit, axis=1, out=n[:, 1:])
    return n[:, SHINGLE:] > n[:, :width]


def similarity(x: np.ndarray, y: np.ndarray, wx: np.ndarray, wy: np.ndarray) -> np.ndarray:
    """Of each pair of windows (rows of their shingles, and of their words' weights): the share of the words' weight in both that lies in five-word shingles the two have in common."""
    out = np.empty(len(x))
    step = max(1, 4_000_000 // (x.shape[1] ** 2))
    for lo in range(0, len(x), step):
        a, b = x[lo : lo + step], y[lo : lo + step]
        same = (a[:, :, None] == b[:, None, :]) & (a != 0)[:, :, None]
        both = total = 0
        for hit, w in ((same.any(2), wx[lo : lo + step]), (same.any(1), wy[lo : lo + step])):
            both, total = both + (w * _covered(hit, w.shape[1])).sum(1), total + w.sum(1)
        out[lo : lo + step] = np.divide(both, total, out=np.zeros(len(a)), where=total > 0)
    return out


def _found(items: Items, words: np.ndarray, start: np.ndarray, window: int, least: float) -> list[np.ndarray]:
    """[document, item, windows, similarity, run_words] of the documents whose words lie end to end, document i from start[i] to start[i + 1]."""
    empty = [np.empty(0, np.int64)] * 3 + [np.empty(0), np.empty(0, np.int64)]
    every = shingles(words)
    if not len(every):
        return empty
    owner = np.repeat(np.arange(len(start) - 1), np.diff(start))
    inside = np.arange(len(every)) + SHINGLE <= start[owner[: len(every)] + 1]
    place = np.full(len(words), -2, np.int64)
    place[: len(every)] = np.where(inside, items.places(every), -2)
    known = place[: len(every)] > -2
    if not known.any():
        return empty
    shingle = np.zeros(len(words), np.uint64)
    shingle[: len(every)][inside] = every[inside]
    heavy = items.position_weights(shingle)
    # a window is as similar to an item's as the weight of its words in shingles of any item allows at most; only those that may reach the bound are fingerprinted
    total, covered = np.zeros(len(words) + 1), np.zeros(len(words) + 1)
    np.cumsum(heavy, out=total[1:])
    touched = np.zeros(len(words) + SHINGLE, np.int64)
    np.cumsum(known, out=touched[SHINGLE : len(known) + SHINGLE])
    touched[len(known) + SHINGLE :] = touched[len(known) + SHINGLE - 1]
    np.cumsum(heavy * (touched[SHINGLE:] > touched[: len(words)]), out=covered[1:])
    parts: list[list[np.ndarray]] = []
    for size in items.sizes:
        n = size.window
        at = np.arange(max(len(words) - n + 1, 0))
        low, high = start[owner[at]], start[owner[at] + 1]
        spots = ((at - low) % size.stride == 0) | (at + n == high)
        most = n * items.rare
        at = at[spots & (at + n <= high) & (covered[at + n] - covered[at] + most >= (least - 1e-9) * (total[at + n] - total[at] + most))]
        if not len(at):
            continue
        prints = fingerprints(words, at, n)
        q, p = size.index.near(prints)
        if not len(q):
            continue
        a, b, item = at[q], size.position[p], size.item[p]
        steps = np.arange(n)
        same = size.index.prints[p] == prints[q]  # equal windows have equal prints
        for k in np.array_split(np.flatnonzero(same), max(1, int(same.sum()) // 20_000 + 1)):
            same[k] = (words[a[k, None] + steps] == items.words[b[k, None] + steps]).all(1)
        sim = np.where(same, 1.0, 0.0)
        rest = np.flatnonzero(~same)
        for k in range(0, len(rest), 20_000):
            r = rest[k : k + 20_000]
            # first what the document's shingles at the item's place allow at most
            spots = a[r][:, None] + np.arange(1 - SHINGLE, n)
            stands = np.where(spots >= start[owner[a[r]]][:, None], place[np.maximum(spots, 0)], -2)
            hit = (stands == -1) | ((stands > b[r][:, None] - SHINGLE) & (stands < b[r][:, None] + n))
            w, whole = (heavy[a[r][:, None] + steps] * _covered(hit, n)).sum(1), total[a[r] + n] - total[a[r]]
            r = r[w + most >= (least - 1e-9) * (whole + most)]
            x, y = _around(shingle, a[r], start[owner[a[r]]], n), _around(items.shingle, b[r], items.start[item[r]], n)
            sim[r] = similarity(x, y, heavy[a[r][:, None] + steps], items.heavy[b[r][:, None] + steps])
        good = np.flatnonzero(sim >= least)
        run = same[good] if n == window else np.zeros(len(good), bool)
        parts.append([owner[a[good]], item[good], a[good], b[good], sim[good], run])
    if not parts:
        return empty
    doc, item, a, b, sim, run = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((a, a - b, ~run, item, doc))
    doc, item, a, b, sim, run = (v[order] for v in (doc, item, a, b, sim, run))
    if not len(doc):
        return empty
    # equal windows one after the other are a run of words
    joined = np.r_[False, (doc[1:] == doc[:-1]) & (item[1:] == item[:-1]) & run[1:] & run[:-1] & (a[1:] == a[:-1] + 1) & (b[1:] == b[:-1] + 1)]
    no = np.arange(len(doc))
    length = np.where(run, no - np.maximum.accumulate(np.where(joined, 0, no)) + window, 0)
    edge = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])])
    return [doc[edge], item[edge], np.diff(np.r_[edge, len(doc)]), np.maximum.reduceat(sim, edge), np.maximum.reduceat(length, edge)]


def _search(items: Items, window: int, least: float, key: str):
    names = [key, "item_id", "windows", "similarity", "run_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for some in wordscan.batches(texts):
                if len(texts[some[0]]) > wordscan.CHUNK:
                    words = wordscan.word_hashes(texts[some[0]])
                    start = np.array([0, len(words)])
                else:
                    scan = Scan.of([texts[i].lower() for i in some])
                    words, start = scan.words(), np.searchsorted(scan.text, np.arange(len(some) + 1))
                doc, item, windows, sim, run_words = _found(items, words, start, window, least)
                if len(doc):
                    ids = b.column(0).take(pa.array(np.array(some)[doc]))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([items.ids[i] for i in item], pa.string()), pa.array(windows.astype(np.int64)), pa.array(sim), pa.array(run_words.astype(np.int64))], names=names)

    return run


def find_leaks(documents: DataFrame, items: DataFrame, window: int = 12, radius: int = NEAR_RADIUS, edit_radius: int = EDIT_RADIUS, least: float = 0.8, key: str = "doc_id") -> DataFrame:
    """(doc_id, item_id, windows, similarity, run_words): documents with passages of items, whole or in part, as written or edited.

    Items are cut into windows of `window` words and of its doublings up to two
    thirds of their length, shorter items into their own length. Windows of a
    document that a five-word shingle of some item touches are fingerprinted and
    looked up among the items' windows of the same size: within `radius` bits at
    size `window`, where parts as written are found, and within `edit_radius` at
    the item-sized ones, where edited ones are. Pairs are verified by the share of
    their words' weight that lies in common five-word shingles (at least `least`).
    windows: verified window pairs; similarity: of the best; run_words: longest
    stretch of equal consecutive words, 0 if none reaches `window`. Words are
    compared as 64-bit hashes. Null texts and passages, and those of fewer than
    five words, match nothing; a passage under several ids leaks under each;
    repeated documents are reported once for each row. Items are searched in
    blocks of about BLOCK_WORDS words, which bounds what is sent to a worker;
    documents are read once a block and never shuffled.
    """
    spark = documents.sparkSession
    kind = documents.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, item_id string, windows bigint, similarity double, run_words bigint"
    rows = items.where("item_id IS NOT NULL AND passage IS NOT NULL").select("item_id", "passage").distinct()
    letters = rows.agg(F.sum(F.length("passage"))).first()[0] or 0
    n_blocks = max(1, math.ceil(letters / 4 / BLOCK_WORDS))
    found, texts = None, spread(documents.select(key, "text").where("text <> ''"))
    for k in range(n_blocks):
        block = [(r["item_id"], r["passage"]) for r in rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == k).orderBy("item_id", "passage").collect()]
        built = Items(block, window, radius, edit_radius)
        if not built.sizes:
            continue
        part = texts.mapInArrow(_search(built, window, least, key), schema)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], schema)
