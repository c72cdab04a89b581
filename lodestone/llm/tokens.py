"""Byte-pair vocabularies: reading, splitting text into pieces, and two ways to apply the merges.

``MergeReplay`` encodes many distinct pieces at once: an inverted index from a pair of neighbouring symbols
to all its places, and merges applied to all places of a pair in rank order. ``SymbolCounter`` works piece by
piece on a linked list with a priority queue and only counts what survives.
"""

from __future__ import annotations

import base64
import heapq
import os
import re

import regex
from pyspark.sql import SparkSession

#: Default place of the vocabulary files; every operator takes another path as a parameter.
TOKENIZERS = "/opt/tokenizers"
#: A vocabulary file larger than this is not sent to the executors.
MAX_VOCABULARY_BYTES = 64 << 20
#: Pieces a worker remembers before it starts afresh; only memory depends on it, results don't.
REMEMBERED = 300_000

#: The vocabulary's published split of text into pieces; the first form is for ASCII text.
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.A)
_ANY = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")


def pieces_of(text: str) -> list[str]:
    """The pieces of a text, in order; merges never cross from one piece to the next."""
    return (_ASCII if text.isascii() else _ANY).findall(text)


def vocabulary_path(name: str, directory: str = TOKENIZERS) -> str:
    return os.path.join(directory, f"{name}.tiktoken")


def share_vocabulary(spark: SparkSession, path: str):
    """Broadcast of a rank file's bytes, refused above MAX_VOCABULARY_BYTES."""
    if (n := os.path.getsize(path)) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} has {n} bytes, more than a vocabulary may have ({MAX_VOCABULARY_BYTES})")
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


class Vocabulary:
    """Byte strings with their ids; a merge's rank is the id of the joined bytes."""

    def __init__(self, rank_file: bytes):
        self.id_of = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in rank_file.splitlines() if line)}
        self.bytes_of = {i: b for b, i in self.id_of.items()}
        self.byte_id = [self.id_of[bytes([b])] for b in range(256)]
        self._joined: dict[tuple[int, int], int] = {}

    def joined(self, left: int, right: int) -> int:
        """Id of two neighbouring symbols as one, or -1."""
        key = (left, right)
        if (found := self._joined.get(key)) is None:
            found = self._joined[key] = self.id_of.get(self.bytes_of[left] + self.bytes_of[right], -1)
            if len(self._joined) > 4_000_000:
                self._joined.clear()
        return found


_LOADED: dict[int, Vocabulary] = {}


def loaded(shared) -> Vocabulary:
    """The vocabulary of a broadcast, parsed once in each worker process."""
    key = hash(shared.value)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Vocabulary(shared.value)
    return _LOADED[key]


class MergeReplay:
    """Encodes a set of distinct pieces together by replaying the merges in rank order.

    All symbols of all pieces stand in one sequence with links to their neighbours. ``places`` is the inverted
    index: for each pair that can merge, where it occurs. The pair of lowest rank is taken next, merged at all
    its places from left to right, and only the pairs with the two neighbours of each place are touched.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        joined, byte_id = self.vocabulary.joined, self.vocabulary.byte_id
        symbol = [byte_id[b] for piece in pieces for b in piece]
        after, before = list(range(1, len(symbol) + 1)), list(range(-1, len(symbol) - 1))
        first, at = [], 0
        for piece in pieces:
            first.append(at)
            if piece:
                before[at] = -1
                at += len(piece)
                after[at - 1] = -1
        places: dict[tuple[int, int], list[int]] = {}
        for i, j in enumerate(after):
            if j >= 0:
                pair = (symbol[i], symbol[j])
                if pair in places:
                    places[pair].append(i)
                elif joined(*pair) >= 0:
                    places[pair] = [i]
        queue = [(joined(*pair), pair) for pair in places]
        heapq.heapify(queue)
        while queue:
            merged, pair = heapq.heappop(queue)
            left, right = pair
            for i in sorted(places.pop(pair)):
                j = after[i]
                if symbol[i] != left or j < 0 or symbol[j] != right:
                    continue  # one of the two went into another merge
                symbol[i], symbol[j] = merged, -1
                k = after[i] = after[j]
                if k >= 0:
                    before[k] = i
                for a, b in ((before[i], i), (i, k)):
                    if a >= 0 and b >= 0:
                        new = (symbol[a], symbol[b])
                        if new in places:
                            places[new].append(a)
                        elif (rank := joined(*new)) >= 0:
                            places[new] = [a]
                            heapq.heappush(queue, (rank, new))
        out = []
        for piece, i in zip(pieces, first):
            ids = []
            if piece:
                while i >= 0:
                    ids.append(symbol[i])
                    i = after[i]
            out.append(ids)
        return out


class SymbolCounter(dict):
    """Piece -> number of its tokens, found on first use and remembered."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = self[piece] = self._count(piece.encode("utf-8", "surrogatepass"))
        return n

    def _count(self, piece: bytes) -> int:
        """Symbols that survive: a linked list of symbols, a queue of (rank, place) for the merges."""
        joined, symbol = self.vocabulary.joined, [self.vocabulary.byte_id[b] for b in piece]
        n = alive = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(rank, i, symbol[i], symbol[i + 1]) for i in range(n - 1) if (rank := joined(symbol[i], symbol[i + 1])) >= 0]
        heapq.heapify(queue)
        while queue:
            merged, i, left, right = heapq.heappop(queue)
            j = after[i]
            if symbol[i] != left or j >= n or symbol[j] != right:
                continue
            symbol[i], symbol[j] = merged, -1
            alive -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (rank := joined(merged, symbol[k])) >= 0:
                    heapq.heappush(queue, (rank, i, merged, symbol[k]))
            if (h := before[i]) >= 0 and (rank := joined(symbol[h], merged)) >= 0:
                heapq.heappush(queue, (rank, h, symbol[h], merged))
        return alive
