"""Token counts by a linear longest-match automaton.

A word's pieces are found greedily, the longest vocabulary entry first, left to right. The vocabulary's trie carries
failure links: where a word leaves the trie at a node, the pieces that greedy matching would emit there are known in
advance, and so is the node from which matching goes on. The automaton keeps only how many pieces are popped, so a
word costs one pass over its bytes and no piece is ever built.

Words are the matches of a pattern in the text (by default letters, single digits, and other signs, each ended by a
word-end sign), lower-cased in normal form C. A word that no sequence of greedy pieces covers counts as one token.
Null and empty texts have none; very long texts, and words, are read whole. Any row gives one row, repeated and null ids included. Other
columns take no part. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: ends each word; never part of UTF-8
END = 0xFF
#: fixed values: how the vocabulary's tokenizer cuts texts into words
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
#: words whose counts a task remembers, and the signs that such a word has at most: some 100 MB
CACHE, CACHED = 500_000, 64


@dataclass
class Automaton:
    """Arrays that can be broadcast: trie edges (node * 256 + byte -> node), failure links (-1: none) and popped counts."""

    keys: np.ndarray
    targets: np.ndarray
    fail: np.ndarray
    pops: np.ndarray

    @classmethod
    def build(cls, pieces: Iterable[bytes]) -> Automaton:
        edges: dict[int, int] = {}
        accepts = [False]
        for piece in pieces:
            node = 0
            for byte in piece:
                child = edges.get(node << 8 | byte)
                if child is None:
                    child = edges[node << 8 | byte] = len(accepts)
                    accepts.append(False)
                node = child
            accepts[node] = node != 0
        children: list[list[tuple[int, int]]] = [[] for _ in accepts]
        for key, child in edges.items():
            children[key >> 8].append((key & 255, child))
        fail, pops, level = [-1] * len(accepts), [0] * len(accepts), [0]
        while level:
            below = []
            for node in level:
                for byte, child in children[node]:
                    below.append(child)
                    if accepts[child]:
                        fail[child], pops[child] = 0, 1
                        continue
                    back, popped = fail[node], pops[node]
                    while back >= 0 and (back << 8 | byte) not in edges:
                        popped += pops[back]
                        back = fail[back]
                    if back >= 0:
                        fail[child], pops[child] = edges[back << 8 | byte], popped
            level = below
        return cls(np.fromiter(edges.keys(), np.int64), np.fromiter(edges.values(), np.int32), np.array(fail, np.int32), np.array(pops, np.int32))


class Counter(dict):
    """Pieces of each word, remembered."""

    def __init__(self, automaton: Automaton) -> None:
        super().__init__()
        self.edges = dict(zip(automaton.keys.tolist(), automaton.targets.tolist(), strict=True))
        self.fail, self.pops = automaton.fail.tolist(), automaton.pops.tolist()

    def count(self, word: bytes) -> int:
        edges, fail, pops = self.edges, self.fail, self.pops
        node = total = 0
        for byte in word:
            child = edges.get(node << 8 | byte)
            while child is None:
                total += pops[node]
                node = fail[node]
                if node < 0:
                    return 1
                child = edges.get(node << 8 | byte)
            node = child
        while node:
            total += pops[node]
            node = fail[node]
            if node < 0:
                return 1
        return total

    def __missing__(self, word: str) -> int:
        n = self.count(word.encode() + bytes([END]))
        if len(word) <= CACHED:
            if len(self) >= CACHE:
                self.clear()
            self[word] = n
        return n


def _byte_signs() -> dict[str, int]:
    """The printable sign that stands for each byte in vocabulary files: itself where printable, else the next above 255."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=4)
def load_pieces(path: str, end_mark: str = "</w>") -> tuple[bytes, ...]:
    """The vocabulary of a public tokenizer file (driver side), the word-end sign as the byte END."""
    signs = _byte_signs()
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    pieces = []
    for piece in vocabulary:
        ended = piece.endswith(end_mark)
        body = piece[: -len(end_mark)] if ended else piece
        if all(c in signs for c in body):
            pieces.append(bytes(signs[c] for c in body) + (bytes([END]) if ended else b""))
    return tuple(pieces)


def normal_words(text: str, pattern: regex.Pattern) -> list[str]:
    return pattern.findall(unicodedata.normalize("NFC", text).lower())


def token_counts(docs: DataFrame, pieces: Iterable[bytes], id_col: str = "doc_id", words: str = WORDS) -> DataFrame:
    """id, n_words, n_tokens of each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(Automaton.build(pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, pattern = Counter(shared.value), regex.compile(words)
        for batch in batches:
            n_words, n_tokens = [], []
            for text in batch.column(1):
                found = normal_words(text.as_py() or "", pattern)
                n_words.append(len(found))
                n_tokens.append(sum(map(counter.__getitem__, found)))
            yield pa.record_batch([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], names=[id_col, "n_words", "n_tokens"])

    schema = docs.select(id_col).schema.add("n_words", "long").add("n_tokens", "long")
    return docs.select(id_col, "text").mapInArrow(run, schema)
