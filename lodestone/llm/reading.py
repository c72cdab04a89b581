"""Problem 7: how demanding a document is to read, on the scale of graded passages."""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.pairs import language

#: Sizes of the nested familiar lists, by rank of document frequency; their size bounds what is broadcast. (Left out one
#: by one, of the 160 graded passages one list of 300 words misses 20, eight nested lists 1, these sixteen none.)
LISTS = (50, 100, 150, 200, 250, 300, 350, 400, 450, 500, 550, 600, 700, 800, 1000, 1200)
#: The list whose share is reported beside the level.
REPORTED = LISTS.index(500)
#: The classifier is fitted on at most so many graded passages (the table has 160): the first by ref_id.
MAX_GRADED = 20_000
MIN_CHARS = 600

_BREAK = "\\n\\u000b\\u000c\\u0085\\u2028"
_LINK = re.compile(r"!?\[([^\[\]\n]{0,500})\]\([^()\s]{0,2000}\)")
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,200}>")
_FENCE = re.compile(r"```.*?(?:```|\Z)|\\begin\{(\w+\*?)\}.*?(?:\\end\{\1\}|\Z)|\$\$.*?\$\$", re.S)
_PARAGRAPH = re.compile(rf"(?:[{_BREAK}][ \t\u00a0\u3000]*){{2,}}|\u2029")
#: Lines that are no running text: headings, rules, tables, captions, chapter lines.
_APPARATUS = re.compile(r"\s*(?:#{1,6}\s|\\(?:sub)*section|\\\w+\{|\||[-=*_]{3,}\s*$|CHAPTER\b|\[Illustration|={2,})")
#: What stands before running text in a line: list marks, quotation marks of mail, line numbers, speakers, question marks.
_LEAD = re.compile(r"^(?:[>*+•|-]+\s+|\d{1,4}[.)]?\s{1,2}(?=\S)|Q:\s*|A:\s*|[A-Z][A-Z' -]{2,40}\.\s+|\w{3,30} wrote:\s*)+")
_HYPHENATED = re.compile(rf"(?<=[a-z])-[ \t]*[{_BREAK}][ \t>]*(?=[a-z])")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’)\]*_]*\s+(?=[\"'“‘(\[*_]*[A-Z0-9])")
_TITLE = re.compile(r"\b(Dr|Mr|Mrs|Ms|St|No|vol|p|Cf|cf|e\.g|i\.e)\.\s")
_WORD = re.compile(r"[^\W\d_]+(?:['’][a-z]+)?")
_INVISIBLE = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])


def sentences_of(text: str) -> list[list[str]]:
    """The words of each sentence of a document's running text; headings, tables, code, labels and lists of
    words are left out, wrapped lines joined. Words keep their case."""
    if "&" in text:
        text = html.unescape(text)
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text.translate(_INVISIBLE))
    if "](" in text:
        text = _LINK.sub(r"\1", text)
    if "<" in text:
        text = _TAG.sub("", text)
    if "```" in text or "$$" in text or "\\begin" in text:
        text = _FENCE.sub("\n\n", text)
    if "-" in text:
        text = _HYPHENATED.sub("", text)
    out = []
    for paragraph in _PARAGRAPH.split(text):
        if not paragraph:
            continue
        lines = [_LEAD.sub("", line.strip()) for line in re.split(f"[{_BREAK}]", paragraph) if not _APPARATUS.match(line)]
        # lines that nearly all begin like sentences are sentences, with or without their full stops
        own_lines = len(lines) > 1 and sum(line[:1].isupper() for line in lines[1:]) >= 0.8 * (len(lines) - 1)
        for unit in lines if own_lines else [" ".join(lines)]:
            for sentence in _SENTENCE.split(_TITLE.sub(r"\1 ", unit)):
                words = _WORD.findall(sentence)
                if len(words) > 2 and (own_lines or sentence.rstrip("\"'”’)]*_ ")[-1:] in (".", "!", "?", "…")):
                    out.append(words)
    return out


def plain_words(sentence: list[str]) -> list[str]:
    """The words that aren't names: those in lower case, and the first one, which a sentence sets in upper case."""
    return [w.lower() for i, w in enumerate(sentence) if w.islower() or i == 0 and w[1:].islower()]


def features(text: str, rank: dict[str, int]) -> np.ndarray | None:
    """Share of words outside each familiar list, and the average sentence length; None without running text.

    ``rank`` is a word's place by document frequency. A sentence of which less than half is in the longest list
    counts if its function words are English; a text that has no other sentences is measured on all of them."""
    last, kept, rest = LISTS[-1], [], []
    for sentence in sentences_of(text):
        places = [rank.get(w, last) for w in plain_words(sentence)]
        if places:
            foreign = 2 * places.count(last) > len(places) and language(" ".join(sentence)) != "en"
            (rest if foreign else kept).append((sentence, places))
    every, n_long, n_sentences = [], 0, 0
    for sentence, places in kept or rest:
        every += places
        n_long += len(sentence)
        n_sentences += 1
    if not n_sentences:
        return None
    outside = (np.array(every)[:, None] >= np.array(LISTS)).mean(0)
    return np.append(outside, np.log(n_long / n_sentences))


class ReadingScale:
    """A linear reading formula fitted to graded passages: for each level, weights for the unfamiliar shares and
    the sentence length (linear discriminants with a common, slightly shrunk covariance)."""

    def __init__(self, x: np.ndarray, level: np.ndarray, shrink: float = 0.1):
        self.levels = np.unique(level)
        means = np.stack([x[level == k].mean(0) for k in self.levels])
        centred = np.concatenate([x[level == k] - m for k, m in zip(self.levels, means)])
        cov = centred.T @ centred / max(len(x) - len(self.levels), 1)
        cov = (1 - shrink) * cov + shrink * np.diag(np.diag(cov)) + 1e-8 * np.eye(len(cov))
        self.weights = np.linalg.solve(cov, means.T)
        self.bias = -0.5 * np.einsum("kj,jk->k", means, self.weights)

    def score(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias

    def grade(self, x: np.ndarray) -> int:
        return int(self.levels[int(np.argmax(self.score(x)))])


def familiar_words(english: DataFrame, text: str = "text") -> DataFrame:
    """``word, n_docs, place``: the corpus's words by how many documents' running text has them, the LISTS[-1] first.

    Each task counts its batch's documents first, so the shuffle carries a word once a batch; of the result, as
    many rows as the longest list has are ever collected."""
    slim = english.select(F.col(text).alias("text")).filter("text is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter[str] = Counter()
            for t in batch.column("text").to_pylist():
                seen.update({w for s in sentences_of(t) for w in plain_words(s)})
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    counts = slim.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n_docs"))
    return counts.orderBy(F.desc("n_docs"), "word").limit(LISTS[-1])


def _scale(graded: DataFrame, rank: dict[str, int]) -> tuple[ReadingScale | None, int]:
    """The scale fitted to the graded passages (none without familiar words to measure by), and its lowest level."""
    rows = graded.filter("text is not null and level is not null").orderBy("ref_id").limit(MAX_GRADED).select("level", "text").collect()
    if not rows:
        raise ValueError("there are no graded passages to fit the reading scale on")
    known = [(r.level, x) for r in rows if (x := features(r.text, rank)) is not None]
    scale = ReadingScale(np.stack([x for _, x in known]), np.array([k for k, _ in known])) if known else None
    return scale, min(r.level for r in rows)


def reading_levels(documents: DataFrame, graded: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", doc_format: str = "doc_format") -> DataFrame:
    """``doc_id, level, unfamiliar, words_per_sentence`` of each English document of running prose.

    These are the rows with ``lang`` exactly ``en``, another ``doc_format`` than listing and code (null is another)
    and at least MIN_CHARS characters of text. Method: a familiar-word formula. The familiar lists are the most
    frequent words by document frequency over all English documents (``familiar_words``); a document's score for
    each level is a weighted sum of its shares of words outside the lists and of its average sentence length, the
    weights fitted to the graded passages. ``unfamiliar`` is the share outside the list of 500 words. A document
    without a single sentence has the lowest level and nulls for both figures. Repeated rows come out as they come in.
    """
    spark = documents.sparkSession
    english = documents.filter(F.col(lang) == "en")
    rank = {r.word: i for i, r in enumerate(familiar_words(english, text).collect())}
    scale = spark.sparkContext.broadcast((rank, *_scale(graded, rank)))
    prose = english.filter((F.length(text) >= MIN_CHARS) & ~F.coalesce(F.col(doc_format).isin("listing", "code"), F.lit(False)))
    slim = prose.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))

    def grade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, fitted, lowest = scale.value
        for batch in batches:
            found = [features(t, rank) for t in batch.column("text").to_pylist()]
            level = [lowest if x is None or fitted is None else fitted.grade(x) for x in found]
            share = [None if x is None else float(x[REPORTED]) for x in found]
            length = [None if x is None else float(np.exp(x[-1])) for x in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(level, pa.int32()), pa.array(share, pa.float64()), pa.array(length, pa.float64())], ["doc", "level", "unfamiliar", "words_per_sentence"])

    kind = slim.schema["doc"].dataType.simpleString()
    return slim.mapInArrow(grade, f"doc {kind}, level int, unfamiliar double, words_per_sentence double").withColumnRenamed("doc", doc_id)
