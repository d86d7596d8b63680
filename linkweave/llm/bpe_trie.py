"""Encoding of a corpus with a public byte-level BPE by prefix-sharing trie traversal."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from linkweave.plans.layout import spread

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"

#: The published pattern that splits text into words before the merges.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Encoded words a worker keeps between batches; it starts afresh beyond that.
KEPT_WORDS = 300_000

_NEVER = 1 << 60


def _byte_letters() -> dict[str, int]:
    """The published byte-to-letter rule of byte-level vocabularies, inverted: printable bytes stand for themselves, the rest follow from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TrieEncoder:
    """Byte-level BPE in which the encoding of a word is a path of last tokens.

    For every prefix of a word exactly one vocabulary token can end it: the one
    whose neighbour, the last token of what precedes it, is stable beside it.
    Last tokens depend on the prefix alone, so words that share a prefix share
    its states. Sorted words are the depth-first order of their trie; the path
    from the root is kept as a stack, so each trie node is computed once.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters, vocab = _byte_letters(), model["vocab"]
        self.parts: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        known = {c for c in letters if c in vocab}
        self.ids: dict[bytes, int] = {bytes([letters[c]]): vocab[c] for c in known}
        for merge in model["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            left, right, made = vocab[a], vocab[b], vocab[a + b]
            self.parts[made] = (left, right)
            self.joined[left, right] = made
            self.ids[bytes(letters[c] for c in a + b)] = made
        self.length = {i: len(t) for t, i in self.ids.items()}
        ends: dict[bytes, set[int]] = {}
        for t in self.ids:
            ends.setdefault(t[-2:], set()).add(len(t))
        #: by the last two bytes of a prefix: lengths of the tokens that may end it, longest first
        self.ending = {k: sorted(v, reverse=True) for k, v in ends.items()}
        self.rims: tuple[dict[int, list[int]], dict[int, list[int]]] = ({}, {})
        self.stable: dict[tuple[int, int], bool] = {}

    def rim(self, token: int, side: int) -> list[int]:
        """The tokens at the left (0) or right (1) rim of a token while its merges are made, from a byte up to itself."""
        made = self.rims[side].get(token)
        if made is None:
            made, at = [token], token
            while at in self.parts:
                at = self.parts[at][side]
                made.append(at)
            made.reverse()
            self.rims[side][token] = made
        return made

    def is_stable(self, left: int, right: int) -> bool:
        """Whether two tokens side by side stay apart: no merge across them comes due before a merge inside takes its part away.

        A token is made at the time of its own id (ids are merge ranks). Of
        equal merges the one further left comes first, so one inside `left`
        beats an equal one across, and one across beats an equal one inside `right`.
        """
        known = self.stable.get((left, right))
        if known is None:
            a, b = self.rim(left, 1), self.rim(right, 0)
            i = j = 0
            known = True
            while True:
                next_a = a[i + 1] if i + 1 < len(a) else _NEVER
                next_b = b[j + 1] if j + 1 < len(b) else _NEVER
                across = self.joined.get((a[i], b[j]))
                if across is not None and across < next_a and across <= next_b:
                    known = False
                    break
                if next_a == next_b == _NEVER:
                    break
                if next_a <= next_b:
                    i += 1
                else:
                    j += 1
            if len(self.stable) > 4_000_000:
                self.stable.clear()
            self.stable[left, right] = known
        return known

    def encode_sorted(self, words: Iterable[bytes]) -> Iterator[list[int]]:
        """Token ids of each of the non-empty words, which come sorted."""
        ids, ending, length, is_stable = self.ids, self.ending, self.length, self.is_stable
        path: list[int] = []  # last token of each prefix, by length - 1
        before = b""
        for word in words:
            shared, most = 0, min(len(before), len(word))
            if before[:most] == word[:most]:
                shared = most
            else:
                while before[shared] == word[shared]:
                    shared += 1
            del path[shared:]
            for end in range(shared + 1, len(word) + 1):
                for size in ending.get(word[end - 2 : end] if end > 1 else word[:1], ()):
                    if size <= end:
                        token = ids.get(word[end - size : end])
                        if token is not None and (size == end or is_stable(path[end - size - 1], token)):
                            path.append(token)
                            break
                else:
                    path.append(ids[word[end - 1 : end]])
            before = word
            out, end = [], len(word)
            while end:
                token = path[end - 1]
                out.append(token)
                end -= length[token]
            out.reverse()
            yield out


_encoders: dict[str, tuple[TrieEncoder, dict[str, list[int]]]] = {}
_split = regex.compile(WORD_PATTERN)


def encode_texts(texts: list[str | None], path: str = DEFAULT_VOCABULARY) -> list[list[int]]:
    """Ids of each text; null and empty texts give []."""
    if path not in _encoders:
        _encoders[path] = TrieEncoder(path), {}
    encoder, done = _encoders[path]
    if len(done) > KEPT_WORDS:
        done.clear()
    split = [_split.findall(t) if t else [] for t in texts]
    new = {w for words in split for w in words if w not in done}
    order = sorted((w.encode("utf-8"), w) for w in new)
    for (_, word), ids in zip(order, encoder.encode_sorted(b for b, _ in order)):
        done[word] = ids
    return [[i for w in words for i in done[w]] for words in split]


def encode(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(key, ids) of each row: the text exactly as stored, no special tokens; null and empty texts give an empty list.

    Whole texts of any length are encoded; special-token strings are ordinary
    text; repeated rows give repeated results; an empty table an empty one.
    The vocabulary path must exist on every executor. A map; only an input of
    fewer files than the cluster runs tasks is redistributed first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                ids = encode_texts(part.column(1).to_pylist(), vocabulary)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    kind = documents.schema[key].dataType.simpleString()
    return spread(documents.select(key, text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
