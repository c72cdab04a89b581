"""Problem 2: how many tokens of usable text each source, language and domain holds."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.names import domain_name, is_blank, language_name, source_name
from lodestone.llm.tokens import TOKENIZERS, SymbolCounter, loaded, pieces_of, share_vocabulary, vocabulary_path
from lodestone.operators.deliveries import first_delivery

_COUNTERS: dict[int, SymbolCounter] = {}


def _counter(shared) -> SymbolCounter:
    vocabulary = loaded(shared)
    if id(vocabulary) not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[id(vocabulary)] = SymbolCounter(vocabulary)
    return _COUNTERS[id(vocabulary)]


def count_tokens(df: DataFrame, text_column: str, tokenizer: str = "byte_bpe_50k", directory: str = TOKENIZERS, keep: tuple[str, ...] = ()) -> DataFrame:
    """The ``keep`` columns of every row with ``n_chars`` and ``n_tokens`` of its text; 0 and 0 for null.

    A text is cut into pieces, each distinct piece is a linked symbol list merged through a priority queue
    (``SymbolCounter``), and the surviving symbols are weighted by how often the text has the piece.
    """
    shared = share_vocabulary(df.sparkSession, vocabulary_path(tokenizer, directory))
    slim = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_column).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = _counter(shared)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            tokens = [sum(n * symbols[p] for p, n in Counter(pieces_of(t)).items()) if t else 0 for t in texts]
            out = [batch.column(f"k{i}") for i in range(len(keep))]
            out += [pa.array([len(t or "") for t in texts], pa.int64()), pa.array(tokens, pa.int64())]
            yield pa.RecordBatch.from_arrays(out, [*[f"k{i}" for i in range(len(keep))], "n_chars", "n_tokens"])

    kinds = [f"k{i} {slim.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep))]
    counted = slim.mapInArrow(count, ", ".join([*kinds, "n_chars long", "n_tokens long"]))
    return counted.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "n_chars", "n_tokens")


def document_tokens(df: DataFrame, tokenizer: str = "byte_bpe_50k", directory: str = TOKENIZERS) -> DataFrame:
    """``row_id, source, lang, domain, n_chars, n_tokens`` of every distinct ``row_id`` with usable text, under one spelling a
    source, language and domain; see ``token_budget``."""
    usable = df.filter(~is_blank(F.col("text")))
    counted = count_tokens(usable, "text", tokenizer, directory, keep=("row_id", "source", "lang", "domain", "loaded_at"))
    return first_delivery(counted, "row_id", "loaded_at", {
        "source": source_name(F.col("source")), "lang": language_name(F.col("lang")), "domain": domain_name(F.col("domain")),
        "n_chars": F.col("n_chars"), "n_tokens": F.col("n_tokens"),
    })


def token_budget(df: DataFrame, tokenizer: str = "byte_bpe_50k", directory: str = TOKENIZERS) -> DataFrame:
    """``slice, source, lang, domain, n_rows, n_chars, n_tokens`` over the distinct ``row_id`` with usable text.

    ``slice`` names the grain: ``cell`` (source, language and domain together), ``source``, ``lang``,
    ``domain`` or ``all``; the columns rolled up are null. Usable text is text with something but white
    space. A ``row_id`` counts once, by its earliest delivery; a row without ``row_id`` once for each content.
    Sources, languages and domains come under one spelling, ``unknown`` where there is none. An empty table
    gives the single row ``all`` with zeros. Texts never leave the task that read them: what is shuffled is
    one small row for each text, and the roll-up is a partial aggregate over exact integers.
    """
    once = document_tokens(df, tokenizer, directory)
    cells = once.groupBy("source", "lang", "domain").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n_chars").alias("n_chars"), F.sum("n_tokens").alias("n_tokens"))
    nothing = df.sparkSession.range(1).select(*[F.lit(None).cast("string").alias(c) for c in ("source", "lang", "domain")], *[F.lit(0).cast("long").alias(c) for c in ("n_rows", "n_chars", "n_tokens")])
    keys = [F.col(c) for c in ("source", "lang", "domain")]
    rolled = cells.unionByName(nothing).groupingSets([keys, keys[:1], keys[1:2], keys[2:], []], *keys).agg(F.grouping_id().alias("g"), *[F.sum(c).alias(c) for c in ("n_rows", "n_chars", "n_tokens")])
    rolled = rolled.filter((F.col("g") == 7) | (F.col("n_rows") > 0))  # the empty line is there for the grand total alone
    grain = F.when(F.col("g") == 0, "cell").when(F.col("g") == 3, "source").when(F.col("g") == 5, "lang").when(F.col("g") == 6, "domain").otherwise("all")
    return rolled.select(grain.alias("slice"), "source", "lang", "domain", "n_rows", "n_chars", "n_tokens")
