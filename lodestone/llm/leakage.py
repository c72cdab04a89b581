"""Problem 6: passages of held-out evaluation items inside documents."""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: More items, or more characters of them, are not sent to every executor (see ``leaked_items``).
MAX_ITEMS, MAX_ITEM_CHARS = 200_000, 64_000_000
#: A passage is this many words of a document; consecutive ones share half.
PASSAGE = 160
#: Postings in a block of the index.
BLOCK = 16
#: Share of an item's own BM25 score that a passage needs to be verified.
RETRIEVE = 0.2
#: Share of an item's words that a passage must hold, in order.
HALF = 0.5
#: Share of an item's BM25 weight those words must have: stock instructions and phrases weigh next to nothing.
WEIGHT = 0.5
#: Words that may stand between two held ones without counting as an interruption; the longest interruption, and
#: for longer items that many times the item's own words.
GAP, INTERRUPTION, INTERRUPTION_X = 5, 80, 4
K1, B = 1.2, 0.75

#: Tags that stand inside a word, and commands of a typesetter; any other tag parts words.
_INLINE = re.compile(r"</?(?:a|abbr|b|bdi|bdo|big|cite|code|del|dfn|em|font|i|ins|kbd|mark|q|s|samp|small|span|strike|strong|sub|sup|tt|u|var|wbr)(?:\s[^<>]{0,200})?/?>|<!--.{0,200}?-->|\\[a-z]+\{", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,200}>")
_BROKEN = re.compile(r"(?<=[^\W\d_])-[ \t]*(?:\r\n|[\n\r\x0b\x0c\x85\u2028\u2029])[ \t>|*\d]*(?=[^\W\d_])")
_LINE_MARK = re.compile(r"(?:\r\n|[\n\r\x0b\x0c\x85\u2028\u2029])[ \t\u00a0]*(?:[>|*+#-]+|\d{1,4}(?=[ \t\u00a0]{2}))?")
#: Scripts written without spaces have each character for a word.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORD = re.compile(rf"[{_UNSPACED}]|[^\W_{_UNSPACED}]+")
_ASCII_WORD = re.compile(r"[a-z0-9]+")
_INVISIBLE = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x2060, 0x2061, 0x2062, 0x2063, 0xFEFF])
#: Marks that wrong decoding makes of curly quotes, dashes, dots and hard spaces: they stand for no letter.
_MISREAD = re.compile("â€[\u0080-¿‘-›œšŸž˜™€¦]?|â[\u0080-\u009f][\u0080-¿]|[ÂÃ][\u0080-¿]|Â")


def words_of(text: str) -> list[str]:
    """Lower-case words of a text, whatever its typography, markup, decoding or line ends."""
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKD", _MISREAD.sub(" ", text.translate(_INVISIBLE)))
        text = "".join(c for c in text if not unicodedata.combining(c)) if not text.isascii() else text
    if "<" in text or "\\" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    text = text.lower()
    if "-" in text:
        text = _BROKEN.sub("", text)
    return (_ASCII_WORD if text.isascii() else _WORD).findall(_LINE_MARK.sub("\n", text))


class ItemIndex:
    """BM25 inverted index of the items over pairs of neighbouring words, with block maxima.

    A posting is (item, impact); impacts are divided by the item's own score, or the part of it that a passage has room
    for, so one threshold holds for all items.
    """

    def __init__(self, items: list[tuple[int, str]]):
        known: dict[int, list[str]] = {}
        for i, text in items:
            known.setdefault(i, words_of(text or ""))
        self.ids = sorted(i for i, w in known.items() if len(w) > 1)
        self.words = [known[i] for i in self.ids]
        n = len(self.ids)
        pairs = [Counter(zip(w, w[1:])) for w in self.words]
        holders = Counter(p for c in pairs for p in c)
        idf = lambda df: math.log(1 + (n - df + 0.5) / (df + 0.5))
        mean = sum(map(len, self.words)) / max(n, 1)
        postings: dict[tuple[str, str], list[tuple[int, float]]] = {}
        for k, (w, c) in enumerate(zip(self.words, pairs)):
            saturation = K1 * (1 - B + B * len(w) / mean)
            raw = {p: idf(holders[p]) * f * (K1 + 1) / (f + saturation) for p, f in c.items()}
            own = sum(raw.values()) * min(1.0, PASSAGE / len(w))
            for p, x in raw.items():
                postings.setdefault(p, []).append((k, x / own))
        #: pair -> (items ascending, impacts, greatest impact of each block, greatest impact)
        self.postings = {}
        for p, entries in postings.items():
            at, impact = [k for k, _ in entries], [x for _, x in entries]
            blocks = [max(impact[b : b + BLOCK]) for b in range(0, len(impact), BLOCK)]
            self.postings[p] = (at, impact, blocks, max(blocks))
        in_items = Counter(x for w in self.words for x in set(w))
        self.weight = [[idf(in_items[x]) for x in w] for w in self.words]

    def retrieve(self, terms: set[tuple[str, str]], threshold: float) -> list[int]:
        """All items whose score for the terms is at least the threshold, by block-max WAND."""
        cursors = [[self.postings[t][0], 0, self.postings[t]] for t in terms]
        found, n = [], len(self.ids)
        while cursors:
            cursors.sort(key=lambda c: c[0][c[1]])
            bound, pivot = 0.0, None
            for i, c in enumerate(cursors):
                bound += c[2][3]
                if bound >= threshold:
                    pivot = i
                    break
            if pivot is None:
                break
            item = cursors[pivot][0][cursors[pivot][1]]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0][cursors[pivot + 1][1]] == item:
                pivot += 1
            if cursors[0][0][cursors[0][1]] < item:
                target = item  # the lists before the pivot can't reach the threshold without it
            elif sum(c[2][2][c[1] // BLOCK] for c in cursors[: pivot + 1]) < threshold:
                # nor can this block: on to the nearest block end of these lists, or to the next list's item
                ends = [c[0][min((c[1] // BLOCK + 1) * BLOCK, len(c[0])) - 1] + 1 for c in cursors[: pivot + 1]]
                target = max(item + 1, min([*ends, cursors[pivot + 1][0][cursors[pivot + 1][1]] if pivot + 1 < len(cursors) else n]))
            else:
                if sum(c[2][1][c[1]] for c in cursors[: pivot + 1]) >= threshold:
                    found.append(item)
                target = item + 1
            for c in cursors[: pivot + 1]:
                while c[1] < len(c[0]) and c[0][c[1]] < target:
                    c[1] += 1
            cursors = [c for c in cursors if c[1] < len(c[0])]
        return found

    def interruption(self, item: int) -> int:
        return max(INTERRUPTION, INTERRUPTION_X * len(self.words[item]))

    def holds(self, item: int, passage: list[str]) -> tuple[float, float]:
        """Shares of the item's words and of their weight that the passage holds in order, as one run or interrupted once."""
        own, weight = self.words[item], self.weight[item]
        runs: list[tuple[int, int, float, int]] = []  # start and end in the passage, weight, words
        for a, b, size in SequenceMatcher(None, own, passage, autojunk=False).get_matching_blocks():
            if not size:
                continue
            w = sum(weight[a : a + size])
            if runs and b - runs[-1][1] <= GAP:
                s, _, w0, n0 = runs[-1]
                runs[-1] = (s, b + size, w0 + w, n0 + size)
            else:
                runs.append((b, b + size, w, size))
        best_w, best_n, longest = 0.0, 0, self.interruption(item)
        for i, (_, end, w, n) in enumerate(runs):
            nearby = [(w2, n2) for s2, _, w2, n2 in runs[i + 1 :] if s2 - end <= longest]
            more = max(nearby, default=(0.0, 0), key=lambda x: x[1])
            if n + more[1] > best_n:
                best_w, best_n = w + more[0], n + more[1]
        return best_n / len(own), best_w / sum(weight)

    def leaks(self, text: str) -> list[tuple[int, float, float]]:
        """``(item, share of words, share of weight)`` of every item the text holds; each passage is a query."""
        words = words_of(text)
        pairs = list(zip(words, words[1:]))
        known = self.postings
        hits = [k for k, p in enumerate(pairs) if p in known]
        if not hits:
            return []
        found: dict[int, tuple[float, float]] = {}
        at = 0
        for start in range(0, max(len(words) - PASSAGE // 2, 1), PASSAGE // 2):
            while at < len(hits) and hits[at] < start:
                at += 1
            end, terms = at, set()
            while end < len(hits) and hits[end] < start + PASSAGE:
                terms.add(pairs[hits[end]])
                end += 1
            for item in self.retrieve(terms, RETRIEVE):
                words_held, weight_held = self.holds(item, words[max(0, start - PASSAGE // 2) : start + PASSAGE * 3 // 2])
                if words_held < HALF or weight_held < WEIGHT:  # as far as the item and its interruption can reach
                    reach = len(self.words[item]) + self.interruption(item)
                    words_held, weight_held = max((words_held, weight_held), self.holds(item, words[max(0, start - reach) : start + PASSAGE + reach]))
                if words_held > found.get(item, (-1.0, 0.0))[0]:
                    found[item] = (words_held, weight_held)
        return [(self.ids[k], w, x) for k, (w, x) in sorted(found.items())]


def _shards(items: DataFrame, id_column: str, text_column: str) -> Iterator[list[tuple[int, str]]]:
    """The items in lists that each keep within MAX_ITEMS and MAX_ITEM_CHARS, by a checked count: one, for a usual benchmark.
    The driver holds one at a time."""
    slim = items.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).filter("id is not null and text is not null")
    n, chars, longest = slim.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0)), F.coalesce(F.max(F.length("text")), F.lit(0))).first()
    if longest > MAX_ITEM_CHARS // 8:
        raise ValueError(f"an item has {longest} characters, more than an item may have ({MAX_ITEM_CHARS // 8})")
    k = 1 if n <= MAX_ITEMS and chars <= MAX_ITEM_CHARS else 2 * math.ceil(max(n / MAX_ITEMS, chars / MAX_ITEM_CHARS))
    parts = [slim.filter(F.pmod(F.xxhash64("id"), F.lit(k)) == i) for i in range(k)] if k > 1 else [slim]
    for part in parts:
        yield [(r.id, r.text) for r in sorted(part.collect(), key=lambda r: (r.id, r.text))]


def leaked_items(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_id, item_id, words_held, weight_held`` of every document that carries passages of an item.

    A document's words (typography, markup, wrong decoding, line breaks and hyphens undone) are cut into
    overlapping passages; each passage is a BM25 query against the inverted index of the items, walked by
    block-max WAND, and every item above the threshold is verified: the passage must hold HALF of the item's
    words in order, as one run or interrupted once, with WEIGHT of their BM25 weight. Null and empty documents
    and items of fewer than two words hold nothing; a repeated item counts by its first text, repeated documents
    once; extra columns are ignored. The index is broadcast, its size checked first; a larger set of items is
    searched in several indexes, one pass over the documents each.
    """
    slim = documents.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).filter(F.length("text") > 0)
    kind, item_kind = slim.schema["doc"].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    found = None
    for shard in _shards(items, item_id, item_text):
        shared = documents.sparkSession.sparkContext.broadcast(shard)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(shared.value)
            for batch in batches:
                rows = [(r, *hit) for r, t in enumerate(batch.column("text").to_pylist()) for hit in index.leaks(t)]
                row, item, held, weight = ([x[i] for x in rows] for i in range(4))
                yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(row, pa.int32())), pa.array(item).cast(item_arrow), pa.array(held, pa.float64()), pa.array(weight, pa.float64())], ["doc", "item", "words_held", "weight_held"])

        item_arrow = to_arrow_type(items.schema[item_id].dataType)
        one = slim.mapInArrow(search, f"doc {kind}, item {item_kind}, words_held double, weight_held double")
        found = one if found is None else found.unionByName(one)
    held = found.filter((F.col("words_held") >= HALF) & (F.col("weight_held") >= WEIGHT))
    best = held.groupBy("doc", "item").agg(F.max("words_held").alias("words_held"), F.max("weight_held").alias("weight_held"))
    return best.select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), "words_held", "weight_held")
