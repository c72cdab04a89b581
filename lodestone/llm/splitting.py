"""Problem 1: texts above a size limit, cut into pieces at their own boundaries."""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.deliveries import first_delivery

LIMIT, OVERLAP = 3500, 200

#: Strength of a boundary; a cut is better the higher it is.
CHARACTER, WORD, CLAUSE, SENTENCE, LINE, PARAGRAPH, SECTION = range(1, 8)

#: Line ends, longest first; one or more with only white space between them.
_BREAK = re.compile(r"(?:\r\n|[\n\r\x0b\x0c\x85\u2028\u2029])(?:[ \t\u00a0\u3000]*(?:\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]))*")
_LINE_END = re.compile(r"\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]")
#: What opens a section: a Markdown or LaTeX heading, a chapter line, a rule.
_HEADING = re.compile(r"#{1,6} |\\(?:sub)*section|\\chapter|CHAPTER |[-=*]{3,}\s*$", re.M)
#: Sentence ends: Latin ones need white space after them, those of East Asian scripts don't. A match begins where its run
#: of marks does, so a long run is read once.
_SENTENCE = re.compile(r"(?<![.!?…])[.!?…]++[\"'”’»)\]]*[ \t\u00a0\u3000]+|(?<![。！？])[。！？]++[」』）]*[ \t\u00a0\u3000]*|(?<![।؟۔])[।؟۔]++[ \t\u00a0\u3000]+")
_CLAUSE = re.compile(r"[,;:—،؛][\"'”’»)\]]*[ \t\u00a0\u3000]+|[、，；：]|\|[ \t]+")
_WORD = re.compile(r"\s+")
#: Abbreviations after which a full stop ends no sentence.
_ABBREVIATION = re.compile(r"(?:\b(?:e\.g|i\.e|cf|vs|etc|al|dr|mr|mrs|ms|prof|st|no|nos|nr|vol|vols|p|pp|fig|figs|ch|sec|eq|ed|eds|approx|jr|sr|bzw|usw|[A-Za-z]))\.[ \t\u00a0\u3000]+$", re.I)
_CLUSTER = regex.compile(r"\X")


def _splits_cluster(text: str, i: int) -> bool:
    """Would a cut at i part what is one character to a reader?"""
    if i >= len(text):
        return False
    c = text[i]
    if c < "\u0300":
        return c == "\n" and text[i - 1] == "\r"
    return unicodedata.category(c)[0] == "M" or c in "\u200d\ufe0e\ufe0f" or "\U0001f3fb" <= c <= "\U0001f3ff" or text[i - 1] == "\u200d"


def _sentence_ends(text: str, start: int, end: int) -> Iterator[int]:
    for m in _SENTENCE.finditer(text, start, end):
        i = m.end()
        if text[m.start()] == ".":
            if i < end and text[i].islower() or _ABBREVIATION.search(text, max(start, m.start() - 8), i):
                continue
        yield i


def _runs(text: str, start: int, end: int, most: int) -> Iterator[int]:
    """Ends of runs of whole characters, as a reader sees them, of at most ``most``; a longer character is one by itself."""
    at = last = start
    for m in _CLUSTER.finditer(text, start, end):
        if m.end() - at > most and last > at:
            yield last
            at = last
        last = m.end()


def _atoms(text: str, most: int) -> tuple[list[int], list[int]]:
    """Starts of the atomic segments and the strength of the boundary before each.

    Segments are sentences and lines; only one longer than ``most`` is taken apart further, into clauses, then
    words, then runs of an eighth of it at most, of whole characters as a reader sees them. White space stays with the
    segment before it.
    """
    run = max(1, most // 8)
    cuts: list[tuple[int, int]] = []
    at = 0
    for m in [*_BREAK.finditer(text), None]:
        end = m.end() if m else len(text)
        cuts += ((i, SENTENCE) for i in _sentence_ends(text, at, m.start() if m else end) if i < end)
        if m and end < len(text):
            heading = _HEADING.match(text, end)
            cuts.append((end, SECTION if heading else PARAGRAPH if len(_LINE_END.findall(m.group())) > 1 or "\u2029" in m.group() else LINE))
        at = end
    starts, strengths = [0], [SECTION]
    for i, strength in cuts:
        if i > starts[-1] and not _splits_cluster(text, i):
            starts.append(i)
            strengths.append(strength)
    for level, pattern in ((CLAUSE, _CLAUSE), (WORD, _WORD), (CHARACTER, None)):
        if all(b - a <= most for a, b in zip(starts, [*starts[1:], len(text)])):
            break
        finer, fine = [], []
        for a, b, strength in zip(starts, [*starts[1:], len(text)], strengths):
            finer.append(a)
            fine.append(strength)
            if b - a > most:
                ends = (m.end() for m in pattern.finditer(text, a, b) if not _splits_cluster(text, m.end())) if pattern else _runs(text, a, b, run)
                for i in ends:
                    if finer[-1] < i < b:
                        finer.append(i)
                        fine.append(level)
        starts, strengths = finer, fine
    if any(b - a > most for a, b in zip(starts, [*starts[1:], len(text)])):  # a single character of more than the limit
        starts = sorted({*starts, *(i for a, b in zip(starts, [*starts[1:], len(text)]) for i in range(a + most, b, most))})
        known = dict(zip(starts, [CHARACTER] * len(starts))) | {a: s for a, s in zip(finer, fine)}
        strengths = [known[a] for a in starts]
    return starts, strengths


def _merged(starts: list[int], strengths: list[int], length: int, limit: int, overlap: int) -> list[int]:
    """Starts of the pieces: adjacent segments merged, over the weakest boundary first, the smaller pair of
    equals first, while their size together with the overlap still fits."""
    n = len(starts)
    end, after, before, alive = [*starts[1:], length], list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    fits = lambda i, j: end[j] - starts[i] + (overlap if i else 0) <= limit
    queue = [(strengths[i + 1], end[i + 1] - starts[i], i, i + 1) for i in range(n - 1) if fits(i, i + 1)]
    heapq.heapify(queue)
    while queue:
        strength, size, i, j = heapq.heappop(queue)
        if not alive[i] or not alive[j] or after[i] != j or end[j] - starts[i] != size:
            continue  # one of the two has grown since; the grown pair is in the queue if it fits
        alive[j], end[i], k = False, end[j], after[j]
        after[i] = k
        if k < n:
            before[k] = i
            if fits(i, k):
                heapq.heappush(queue, (strengths[k], end[k] - starts[i], i, k))
        if (h := before[i]) >= 0 and fits(h, i):
            heapq.heappush(queue, (strengths[i], end[i] - starts[h], h, i))
    return [s for s, a in zip(starts, alive) if a]


def _overlap_start(text: str, low: int, cut: int) -> int:
    """Where the repeated tail before ``cut`` begins, at ``low`` or later: at a sentence if one leaves at least
    half of what is allowed, else at a word, else at a whole character."""
    if low <= 0:
        return 0
    for i in _sentence_ends(text, low, cut):
        if cut - i >= (cut - low) // 2 and not _splits_cluster(text, i):
            return i
    for m in _WORD.finditer(text, low - 1, cut):
        if m.end() < cut and m.end() >= low and not _splits_cluster(text, m.end()):
            return m.end()
    return next((i for i in range(low, cut) if not _splits_cluster(text, i)), cut)


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """``(start, end, overlap)`` of each piece; text[start:end] is the piece, its first ``overlap`` characters
    repeat the end of the one before it. Every piece has at most ``limit`` characters; the pieces without
    their overlaps are the text. A text within the limit is one piece, the empty text none."""
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be at least 0 and below half the limit")
    if len(text) <= limit:
        return [(0, len(text), 0)] if text else []
    starts = _merged(*_atoms(text, limit - overlap), len(text), limit, overlap)
    out = [(0, starts[1] if len(starts) > 1 else len(text), 0)]
    for k, (a, b) in enumerate(zip(starts[1:], [*starts[2:], len(text)])):
        s = _overlap_start(text, max(a - overlap, starts[k]), a) if overlap else a
        out.append((s, b, a - s))
    return out


def split_long_texts(df: DataFrame, id_column: str, text_column: str, limit: int = LIMIT, overlap: int = OVERLAP, arrived: str | None = None) -> DataFrame:
    """The pieces of every text of more than ``limit`` characters.

    Columns: ``id_column``, ``piece_no`` from 0, ``n_pieces``, ``start_pos`` and ``end_pos`` in the text (code
    points), ``overlap`` (how many of the piece's first characters repeat the piece before), ``body_chars``
    (of the whole text without white space at its ends), ``piece``. Null, empty and short texts have no piece;
    an id that was delivered repeatedly is cut once, by its earliest ``arrived``; rows without an id once for each
    content. Other columns are ignored. Only texts above the limit are shuffled, for that.

    Method: agglomerative merging (``_merged``) of atomic segments (``_atoms``) with a heap of adjacent pairs.
    """
    long = df.filter(F.length(text_column) > limit)
    once = first_delivery(long, id_column, arrived, {"text": F.col(text_column)}).select(F.col(id_column).alias("id"), "text")
    white = " \t\r\n\u00a0\u3000"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, no, of, start, end, lap, body, piece = ([] for _ in range(8))
            for r, text in enumerate(batch.column("text").to_pylist()):
                pieces, chars = split_text(text, limit, overlap), len(text.strip(white))
                for k, (a, b, o) in enumerate(pieces):
                    for column, value in zip((row, no, of, start, end, lap, body, piece), (r, k, len(pieces), a, b, o, chars, text[a:b])):
                        column.append(value)
            ints = [pa.array(x, pa.int32()) for x in (no, of, start, end, lap, body)]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row, pa.int32())), *ints, pa.array(piece, pa.string())], ["id", "piece_no", "n_pieces", "start_pos", "end_pos", "overlap", "body_chars", "piece"])

    kind = once.schema["id"].dataType.simpleString()
    out = once.mapInArrow(cut, f"id {kind}, piece_no int, n_pieces int, start_pos int, end_pos int, overlap int, body_chars int, piece string")
    return out.withColumnRenamed("id", id_column)
