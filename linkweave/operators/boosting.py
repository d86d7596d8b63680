"""Gradient-boosted trees for two classes on arrays: logistic loss, second-order steps, histograms of binned columns."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np

#: Learning rate, rows of a leaf, shares of rows and columns per tree, weight of the leaf penalty, bins per column.
RATE, LEAST, ROW_SHARE, COLUMN_SHARE, PENALTY, BINS = 0.1, 5, 0.9, 0.8, 1.0, 64
#: Rows whose sums are taken at once, so that they stay in a core's cache.
CHUNK = 1 << 15


@dataclass
class Boosted:
    """Complete trees of one depth: per inner node a column and a cut (values above it go right), per leaf a step; importance is each column's share of the gain."""

    base: float
    column: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    importance: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 of each row."""
        score = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for column, cut, leaf in zip(self.column, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            while len(x) and node[0] < len(column):
                node = 2 * node + 1 + (x[rows, column[node]] > cut[node])
            score += leaf[node - len(column)]
        return 1 / (1 + np.exp(-score))

    def dumps(self) -> str:
        return json.dumps({"base": self.base} | {k: getattr(self, k).tolist() for k in ("column", "cut", "leaf", "importance")})

    @classmethod
    def loads(cls, text: str) -> Boosted:
        d = json.loads(text)
        return cls(d["base"], np.array(d["column"], np.int64), np.array(d["cut"], float), np.array(d["leaf"], float), np.array(d["importance"], float))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Each 64-bit number well mixed."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rows:
    """Labelled rows with every column sorted once, for models of several parts of them.

    A model depends on the set of rows only, not on their order: sums are taken
    over whole multiples of a power of two, so they are exact, and which rows a
    tree uses is drawn by a hash of the row and its number among equal ones.
    Takes about 13 bytes a value.
    """

    def __init__(self, columns: Iterable[np.ndarray], y: np.ndarray):
        self.y, self.order, self.sorted, self.hash = y == 1, [], [], []
        for x in columns:
            x = np.asarray(x, float) + 0.0  # one zero
            order = np.argsort(x, kind="stable").astype(np.int32)
            self.order.append(order)
            self.sorted.append(x[order])
            self.hash.append(_mixed(x.view(np.uint64)))
        self.keyed: dict[tuple[int, ...], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def _keys(self, columns: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rows' hashes over some columns, the order they sort in, and where in it each row's equals begin."""
        if columns not in self.keyed:
            key = self.y.astype(np.uint64)
            for no, c in enumerate(columns):
                key += _mixed(self.hash[c] + np.uint64(2 * no + 1))
            order = np.argsort(key, kind="stable")
            new = np.r_[True, key[order][1:] != key[order][:-1]]
            self.keyed[columns] = key, order, np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        return self.keyed[columns]

    def _drawn(self, columns: tuple[int, ...], kept: np.ndarray) -> np.ndarray:
        """A number for each kept row: its hash, and for equal rows their count so far."""
        key, order, first = self._keys(columns)
        before = np.cumsum(kept[order]) - kept[order]
        number = np.empty(len(order), np.uint64)
        number[order] = before - before[first]
        return _mixed(key + _mixed(number))[kept]

    def binned(self, kept: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The kept rows' bins, a row of them a column, and each column's cuts at the quantiles of the kept rows."""
        place = np.cumsum(kept) - 1
        n = int(place[-1]) + 1
        code, edges = np.empty((len(self.order), n), np.uint8), []
        at = np.linspace(0, 1, BINS + 1)[1:-1] * (n - 1)
        low = at.astype(np.int64)
        for f, (order, values) in enumerate(zip(self.order, self.sorted)):
            inside = kept[order]
            v = values[inside]
            e = np.unique(v[low] + (v[np.minimum(low + 1, n - 1)] - v[low]) * (at - low))
            upto = np.searchsorted(v, e, side="right")
            code[f, place[order[inside]]] = np.repeat(np.arange(len(e) + 1, dtype=np.uint8), np.diff(np.r_[0, upto, n]))
            edges.append(e)
        return code, edges

    def boost(self, kept: np.ndarray, sets: list[list[int]], trees: int = 20, depth: int = 4, seed: int = 42) -> list[Boosted | None]:
        """A model of the kept rows on each set of columns, with positives weighted to balance; None if one class is missing."""
        y = self.y[kept]
        if not len(y) or y.all() or not y.any():
            return [None] * len(sets)
        code, edges = self.binned(kept)
        return [_grown(code[c], [edges[i] for i in c], y, self._drawn(tuple(c), kept), trees, depth, seed) for c in sets]


def _sums(code: np.ndarray, columns: np.ndarray, slot: np.ndarray, values: tuple[np.ndarray, np.ndarray], slots: int) -> np.ndarray:
    """(3, slots, columns, bins): sums of both values and numbers of rows by slot and bin of each column."""
    out = np.zeros((3, len(columns), slots * BINS))
    place = np.empty(CHUNK, np.int64)
    for lo in range(0, len(slot), CHUNK):
        base, (g, h) = slot[lo : lo + CHUNK] * BINS, (v[lo : lo + CHUNK] for v in values)
        to = place[: len(base)]
        for j, c in enumerate(columns):
            np.add(base, code[c, lo : lo + CHUNK], out=to)
            out[0, j] += np.bincount(to, g, slots * BINS)
            out[1, j] += np.bincount(to, h, slots * BINS)
            out[2, j] += np.bincount(to, minlength=slots * BINS)
    return out.reshape(3, len(columns), slots, BINS).swapaxes(1, 2)


def _grown(code: np.ndarray, edges: list[np.ndarray], y: np.ndarray, drawn: np.ndarray, trees: int, depth: int, seed: int) -> Boosted:
    width, n = code.shape
    positive = int(y.sum())
    weight = np.where(y, (n - positive) / positive, 1.0)
    # sums of these over all rows stay below 2**52
    unit = 2.0 ** min(40, 51 - (2 * (n - positive)).bit_length())
    rng = np.random.default_rng(seed)
    inner = 2**depth - 1
    made = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)), np.zeros(width)
    score, rows, flat = np.zeros(n), np.arange(n), code.ravel()
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = np.rint(weight * (p - y) * unit), np.rint(weight * p * (1 - p) * unit)
        used = np.flatnonzero(_mixed(drawn + np.uint64(seed * 1_000_003 + t)) < np.uint64(int(ROW_SHARE * 2**64)))
        kept = np.sort(rng.permutation(width)[: max(1, round(COLUMN_SHARE * width))])
        some, both = code[:, used], (g[used], h[used])
        node, place = np.zeros(n, np.int64), np.zeros(len(used), np.int64)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            if not level:
                sums = _sums(some, kept, place, both, 1)
            else:
                # only the smaller of two nodes is summed up; the other is what it leaves of their parent
                count = np.bincount(place, minlength=nodes)
                small = 2 * np.arange(nodes // 2) + (count[1::2] < count[::2])
                slot = np.full(nodes, -1)
                slot[small] = np.arange(nodes // 2)
                few = np.flatnonzero(slot[place] >= 0)
                part = _sums(some[:, few], kept, slot[place[few]], tuple(v[few] for v in both), nodes // 2)
                whole, sums = sums, np.empty((3, nodes, len(kept), BINS))
                sums[:, small], sums[:, small ^ 1] = part, whole - part
            up = sums.cumsum(3)
            (gl, hl, nl), (gt, ht, nt) = up / np.array([unit, unit, 1]).reshape(3, 1, 1, 1), up[..., -1:] / np.array([unit, unit, 1]).reshape(3, 1, 1, 1)
            split = gl**2 / (hl + PENALTY) + (gt - gl) ** 2 / (ht - hl + PENALTY) - gt**2 / (ht + PENALTY)
            gain = np.where((nl >= LEAST) & (nt - nl >= LEAST), split, -1)
            best = gain.reshape(nodes, -1).argmax(1)
            column, cut = np.zeros(nodes, np.int64), np.full(nodes, BINS)
            for v in range(nodes):
                f, b = divmod(int(best[v]), BINS)
                if gain[v, f, b] > 1e-12 and b < len(edges[kept[f]]):
                    column[v], cut[v] = kept[f], b
                    made[0][t, first + v], made[1][t, first + v] = kept[f], edges[kept[f]][b]
                    made[3][kept[f]] += gain[v, f, b]
            node = 2 * node + (flat[column[node] * n + rows] > cut[node])
            place = node[used]
        total = [np.bincount(place, v, inner + 1) / unit for v in both]
        made[2][t] = -RATE * total[0] / (total[1] + PENALTY)
        score += made[2][t][node]
    return Boosted(0.0, made[0], made[1], made[2], made[3] / (made[3].sum() or 1.0))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 20, depth: int = 4, seed: int = 42) -> Boosted | None:
    """A model of the rows with positives weighted to balance; None if one class is missing."""
    width = x.shape[1]
    return Rows([x[:, f] for f in range(width)], np.asarray(y)).boost(np.ones(len(x), bool), [list(range(width))], trees, depth, seed)[0]
