"""Encoding of a corpus with a public byte-level BPE tokenizer by prefix-sharing trie traversal (problem 6).

The distinct words (pieces of the tokenizer's splitting pattern) go into a trie of bytes. For a prefix of a word only
the *last token* of its encoding is kept: it is the one vocabulary entry t that ends there such that the
encoding of what precedes t ends in a token u and the pair (u, t) is stable, which means that encoding u + t gives u, t
again. States are set depth-first as nodes appear, so a prefix that many words share is encoded once; the ids of a
word are read off by following the last tokens back. Everything runs inside the scan's tasks: no shuffle.

Defined results: null, empty -> empty list; blank texts are encoded like any other; whole texts always; special tokens
are never produced; lone surrogates can't occur in Arrow strings. Repeated rows come out repeated, extra columns
are not carried.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the tokenizer's published splitting pattern.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class PrefixBpe:
    """The vocabulary and the trie of words met so far."""

    def __init__(self, path: str = TOKENIZER, pattern: str = PATTERN, nodes: int = 500_000, words: int = 200_000) -> None:
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes_of = {r: t for t, r in self.rank.items()}
        self.split = regex.compile(pattern).findall
        self.endings: dict = {}  # vocabulary by last byte first; key -1 holds the rank
        for t, r in self.rank.items():
            node = self.endings
            for b in reversed(t):
                node = node.setdefault(b, {})
            node[-1] = r
        self.stable: dict[tuple[int, int], bool] = {}
        self.limits = nodes, words
        self.reset()

    def reset(self) -> None:
        """Start a new trie; keeps memory bounded on any corpus."""
        self.child: list[dict[int, int]] = [{}]
        self.last = [-1]
        self.known: dict[str, list[int]] = {}

    def merge(self, data: bytes) -> list[int]:
        """Plain BPE, for the stability of a pair of tokens only."""
        parts = [bytes([b]) for b in data]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.rank[p] for p in parts]

    def is_stable(self, u: int, t: int) -> bool:
        key = (u, t)
        hit = self.stable.get(key)
        if hit is None:
            if len(self.stable) > 2_000_000:
                self.stable.clear()
            hit = self.stable[key] = self.merge(self.bytes_of[u] + self.bytes_of[t]) == [u, t]
        return hit

    def _last_token(self, data: bytes, end: int, path: list[int]) -> int:
        """The last token of the encoding of data[:end]; path: trie nodes of the shorter prefixes."""
        node, at, fits = self.endings, end - 1, []
        while at >= 0:
            node = node.get(data[at])
            if node is None:
                break
            r = node.get(-1)
            if r is not None:
                fits.append((at, r))
            at -= 1
        for at, r in reversed(fits):  # longest first
            if at == 0 or self.is_stable(self.last[path[at]], r):
                return r
        raise ValueError("a byte is missing from the vocabulary")

    def word(self, w: str) -> list[int]:
        hit = self.known.get(w)
        if hit is not None:
            return hit
        data = w.encode()
        child, last = self.child, self.last
        path, node = [0], 0
        for i, b in enumerate(data):
            nxt = child[node].get(b)
            if nxt is None:
                nxt = len(last)
                last.append(self._last_token(data, i + 1, path))
                child.append({})
                child[node][b] = nxt
            node = nxt
            path.append(node)
        out, end = [], len(data)
        while end:
            t = last[path[end]]
            out.append(t)
            end -= len(self.bytes_of[t])
        out.reverse()
        if len(last) > self.limits[0] or len(self.known) > self.limits[1]:
            self.reset()
        self.known[w] = out
        return out

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if text:
            for w in self.split(text):
                out += self.word(w)
        return out


_held: dict[str, PrefixBpe] = {}


def tokenizer(path: str) -> PrefixBpe:
    """One for each worker process."""
    if path not in _held:
        _held[path] = PrefixBpe(path)
    return _held[path]


def encoded(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str = TOKENIZER) -> DataFrame:
    """``key, ids``."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array([bpe.encode(t) for t in b.column(text).to_pylist()], pa.list_(pa.int32()))], names=[key, "ids"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def token_counts(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str = TOKENIZER) -> DataFrame:
    """``key, n_tokens``: the encoded ids never leave the task."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array([len(bpe.encode(t)) for t in b.column(text).to_pylist()], pa.int64())], names=[key, "n_tokens"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens bigint")
