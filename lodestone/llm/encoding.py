"""Problem 5: the token ids of every document by a public tokenizer."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.tokens import REMEMBERED, TOKENIZERS, MergeReplay, loaded, pieces_of, share_vocabulary, vocabulary_path

#: Characters of text a worker turns into pieces before it writes their ids; bounds its memory.
BLOCK_CHARS = 4_000_000


class _Lexicon:
    """Distinct pieces with their ids, as one ragged array that whole blocks of text are looked up in."""

    def __init__(self, vocabulary):
        self.replay = MergeReplay(vocabulary)
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.flat, self.start, self.length = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, pieces: list[str]) -> None:
        ids = self.replay.encode([p.encode("utf-8", "surrogatepass") for p in pieces])
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        start = np.cumsum(length) - length + len(self.flat)
        self.number.update(zip(pieces, range(len(self.number), len(self.number) + len(pieces))))
        self.flat = np.concatenate([self.flat, np.fromiter((i for x in ids for i in x), np.int32, int(length.sum()))])
        self.start, self.length = np.concatenate([self.start, start]), np.concatenate([self.length, length])

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        """The ids of each text. The pieces not met before are encoded together, as one vocabulary."""
        split = [pieces_of(t) if t else [] for t in texts]
        new = set(every := list(chain.from_iterable(split)))
        if len(self.number) > REMEMBERED:
            self.clear()
        new.difference_update(self.number)
        if new:
            self.add(sorted(new))
        n_pieces = np.fromiter(map(len, split), np.int64, len(split))
        total = len(every)
        which = np.fromiter(map(self.number.__getitem__, every), np.int64, total)
        length = self.length[which]
        ends = np.cumsum(length)
        n_ids = int(ends[-1]) if total else 0
        flat = self.flat[np.repeat(self.start[which] - (ends - length), length) + np.arange(n_ids)]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n_pieces)])]
        return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat, pa.int32()))


_LEXICON: dict[int, _Lexicon] = {}


def _lexicon(shared) -> _Lexicon:
    vocabulary = loaded(shared)
    if id(vocabulary) not in _LEXICON:
        _LEXICON.clear()
        _LEXICON[id(vocabulary)] = _Lexicon(vocabulary)
    return _LEXICON[id(vocabulary)]


def encode_corpus(df: DataFrame, id_column: str, text_column: str, tokenizer: str = "byte_bpe_50k", directory: str = TOKENIZERS) -> DataFrame:
    """``(id_column, ids array<int>)``, one row for each row of ``df``, without special tokens.

    Null and empty texts have the empty list; repeated rows and null ids come out as often as they come in;
    all other columns of ``df`` are ignored whatever their names. Method: merge replay over the distinct
    pieces of a block of documents. Each task takes its documents in blocks, gathers the pieces it has not
    met, and replays the merges over all of them at once (``MergeReplay``); a piece's ids do not depend on
    which others are replayed with it, so the blocks give what one replay over the whole corpus gives,
    without a shuffle and with memory bounded by the block.
    """
    shared = share_vocabulary(df.sparkSession, vocabulary_path(tokenizer, directory))
    slim = df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = _lexicon(shared)
        for batch in batches:
            texts, at = batch.column("text").to_pylist(), 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and (end == at or chars + len(texts[end] or "") <= BLOCK_CHARS):
                    chars += len(texts[end] or "")
                    end += 1
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, end - at), lexicon.encode(texts[at:end])], ["id", "ids"])
                at = end

    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(encode, f"id {kind}, ids array<int>").select(F.col("id").alias(id_column), "ids")
