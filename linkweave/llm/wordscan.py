"""Words of many texts at once, as numpy arrays: their places, and hashes of any stretch of characters in constant time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import regex

#: A word: a longest run of letters, combining marks and digits.
WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_DIGIT = regex.compile(r"\p{N}+")

#: Characters scanned at once; a longer text is scanned in pieces.
CHUNK = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_ODD), -1, 1 << 64))
_tables: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Each 64-bit value scattered over all 64 bits, one to one."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def fold(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    return mix(a * _ODD + (b ^ (b >> np.uint64(29))))


def _by_code(name: str) -> np.ndarray:
    """Tables over all code points: is_word, digit, and a random 64-bit value of each."""
    if not _tables:
        codes = np.arange(0x110000, dtype=np.uint32)
        text = codes.copy()
        text[0xD800:0xE000] = 0  # surrogates are no characters
        text = text.astype("<u4").tobytes().decode("utf-32-le")
        for key, pattern in (("word", WORD), ("digit", _DIGIT)):
            table = np.zeros(len(codes), bool)
            for m in pattern.finditer(text):
                table[m.start() : m.end()] = True
            _tables[key] = table
        _tables["value"] = mix(codes.astype(np.uint64) + np.uint64(1))
    return _tables[name]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the odd base and of its inverse modulo 2**64, at least n of each."""
    if len(_tables.get("up", ())) < n:
        size = max(n, CHUNK + 4096)
        for key, base in (("up", _ODD), ("down", _BACK)):
            p = np.full(size, base)
            p[0] = 1
            _tables[key] = np.multiply.accumulate(p)
    return _tables["up"], _tables["down"]


@dataclass
class Scan:
    """The words of some texts, in order."""

    codes: np.ndarray  # characters of all texts, a line break behind each
    offset: np.ndarray  # of each text in codes, and the end
    start: np.ndarray  # of each word in codes
    end: np.ndarray
    text: np.ndarray  # of each word
    sums: np.ndarray

    @classmethod
    def of(cls, texts: list[str], digits: bool = True) -> Scan:
        """`digits` False takes every digit as 0. Texts should be in lower case; the two forms of a small sigma are one."""
        whole = "\n".join(texts) + "\n"
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        codes[codes == 0x3C2] = 0x3C3
        if not digits:
            codes[_by_code("digit")[codes]] = 48
        inside = np.zeros(len(codes) + 2, np.int8)
        inside[1:-1] = _by_code("word")[codes]
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edge[0::2], edge[1::2]
        offset = np.cumsum([0, *(len(t) + 1 for t in texts)])
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(_by_code("value")[codes] * _powers(len(codes))[0][: len(codes)], out=sums[1:])
        return cls(codes, offset, start, end, np.searchsorted(offset, start, side="right") - 1, sums)

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of the characters from each start up to each end."""
        return mix((self.sums[end] - self.sums[start]) * _powers(len(self.codes))[1][start] + (end - start).astype(np.uint64))

    def words(self) -> np.ndarray:
        return self.hashes(self.start, self.end)

    def string(self, start: int, end: int) -> str:
        return self.codes[start:end].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def batches(texts: list[str]) -> Iterator[list[int]]:
    """Indexes of consecutive texts of about CHUNK characters together; a longer one comes alone."""
    some, size = [], 0
    for i, t in enumerate(texts):
        if some and size + len(t) > CHUNK:
            yield some
            some, size = [], 0
        some.append(i)
        size += len(t)
    if some:
        yield some


def cuts(text: str) -> list[int]:
    """Places, each a word's start or the text's end, that cut a text into pieces of about CHUNK characters and whole words; 0 comes first."""
    at = [0]
    while len(text) - at[-1] > CHUNK:
        near = WORD.search(text, at[-1] + CHUNK)
        if near and near.start() == at[-1] + CHUNK:  # perhaps inside a word
            near = WORD.search(text, near.end())
        if near is None:
            break
        at.append(near.start())
    return [*at, len(text)]


def word_hashes(text: str) -> np.ndarray:
    """Hash of each word of a text of any length, in lower case."""
    at = cuts(text) if len(text) > CHUNK else [0, len(text)]
    return np.concatenate([Scan.of([text[a:b].lower()]).words() for a, b in zip(at, at[1:])])
