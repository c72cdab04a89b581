"""Text transforms and predicates as column expressions; only Unicode normalisation leaves the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What breaks a line, what prints as nothing, the end of a sentence, the shortest compared sentence.
LINE_BREAKS = "[\\x{0B}\\x{0C}\\x{1C}-\\x{1E}\\x{85}\\x{2028}\\x{2029}]"
SPACES = "[\\t\\p{Zs}]"
INVISIBLE = "[\\x{FEFF}\\x{200B}\\x{200C}\\x{200D}\\x{2060}\\x{AD}\\x{00}-\\x{09}\\x{0B}-\\x{1F}\\x{7F}-\\x{9F}]"
SENTENCE_END = "(?<![.!?\\x{2026}])([.!?\\x{2026}]+[\"'\\x{201D}\\x{2019})\\]]*)\\s"
MIN_SENTENCE_CHARS = 60
WHITE = "[ \\t\\r\\n]+"
#: Control character that marks a cut while a text is being split; the normalised text can't hold it.
_MARK = "\u0001"


@F.pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Unicode normal form NFC; null stays null. ASCII text is returned as it is."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def normalise_characters(c: Column) -> Column:
    """One line end, plain spaces, no invisible or control characters, then NFC; idempotent."""
    c = F.regexp_replace(c, "\r\n?", "\n")
    c = F.regexp_replace(F.regexp_replace(c, LINE_BREAKS, "\n"), SPACES, " ")
    return nfc(F.regexp_replace(c, INVISIBLE, ""))


def tokens(c: Column) -> Column:
    """Words between white space (space, tab, CR, LF); the empty array for null and blank text."""
    return F.when(c.isNull(), F.array().cast("array<string>")).otherwise(F.filter(F.split(c, WHITE), lambda w: w != ""))


def collapse(c: Column) -> Column:
    """White-space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, "[ \\t\\r\\n\\f]+", " "))


def sentences(c: Column, least: int = MIN_SENTENCE_CHARS) -> Column:
    """Sentences of at least ``least`` characters, white space collapsed; a paragraph break ends one too."""
    blocks = F.transform(F.split(c, "\n\\s*\n"), lambda b: F.regexp_replace(collapse(b), SENTENCE_END, "$1" + _MARK))
    cut = F.flatten(F.transform(blocks, lambda b: F.split(b, _MARK)))
    return F.filter(F.transform(cut, lambda s: F.trim(s)), lambda s: F.length(s) >= least)


def fingerprint(c: Column) -> Column:
    return F.sha2(c, 256)


def once(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use(c)``, with ``c`` worked out once however often it is named in it: a lambda's argument is, an expression isn't."""
    return F.element_at(F.transform(F.array(c), use), 1)


def repeat_share(c: Column, n: int = 8) -> Column:
    """Share of the text's word n-grams that repeat an earlier one; 0 for a text of fewer than n words."""

    def share(words: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))
        repeated = once(grams, lambda g: 1.0 - F.size(F.array_distinct(g)) / F.size(g).cast("double"))
        return F.when(F.size(words) < n, F.lit(0.0)).otherwise(repeated)

    return once(tokens(c), share)


def cut_at_marker(c: Column, markers: list[str]) -> Column:
    """What stands before the first of the markers, trimmed."""
    for m in markers:
        c = F.substring_index(c, m, 1)
    return F.trim(c)


def excerpt(c: Column, chars: int = 60) -> Column:
    return F.substring(collapse(c), 1, chars)


def is_structural(line: Column) -> Column:
    """Empty, or a Markdown heading, list item, table row or quotation."""
    return (line == "") | line.rlike("^(#|- |\\* |\\||> |[0-9]+\\.\\s)")


#: The field syntax that a botched JSON answer leaves in a question, or that an answer consists of.
LEAKED_JSON = '"(question|answer)"\\s*:|\\{\\s*"(question|answer)"'
JSON_ANSWER = '\\A\\s*(?:```\\w*\\s*)?\\[?\\s*\\{\\s*"(?:question|answer)"\\s*:|"(?:question|answer)"\\s*:\\s*"(?:[^"\\\\]|\\\\.)*"?\\s*\\}?\\s*\\]?\\s*(?:```)?\\s*\\z'
#: How a question or answer speaks of the text it was written from.
SOURCE_TEXT = (
    r"(?i)\b(?:the|this|that)\s+(?:(?:given|provided|above|original|same)\s+)?(?:passage|excerpt)\b(?!\s+(?:of|through|to|from|between|across|into|way)\b)"
    r"|\b(?:in|from|according\s+to|based\s+on|within)\s+(?:the|this|that)\s+(?:(?:given|provided|above|original|same)\s+)?(?:passage|excerpt)\b(?!\s+(?:of|from)\b)"
    r"|\b(?:according\s+to|in|from|based\s+on|within|by)\s+(?:the|this)\s+(?:(?:given|provided|above|original|same)\s+)?text\b(?!\s+of\b)"
    r"|\b(?:the|this)\s+(?:given|provided|above)\s+text\b"
    r"|\b(?:the|this)\s+text\s+(?:(?:also|explicitly|clearly|further)\s+)?(?:provided|given|above|says|said|states|stated|mentions|mentioned|describes|described|suggests|suggested|explains|explained|notes|noted"
    r"|implies|implied|discusses|discussed|highlights|emphasi[sz]es|indicates|argues|presents|references|referenced|contrasts|contrasted|provides|gives|lists|shows|outlines|does\s+not|doesn't|did\s+not|is\s+not|isn't)\b"
    r"|\bthe\s+text(?:'|\x{2019})s\b|\bin\s+the\s+context\s+of\s+the\s+text\b(?!\s*\w)"
)
AUTHOR_REPORTS = (
    r"(?i)\bthe\s+author\s+(?:also\s+)?(?:states|stated|mentions|mentioned|says|said|notes|noted|writes|wrote|describes|described|explains|explained|suggests|suggested|argues|argued|claims|claimed|believes"
    r"|implies|implied|means|meant|concludes|concluded|emphasi[sz]es|highlights|points\s+out|pointed\s+out|discusses|discussed|refers|uses|used|compares|indicates|presents|does\s+not|doesn't|did\s+not)\b"
)
NAMES_AUTHOR = r"(?i)\bthe\s+author\b"


def leaks_json(question: Column, answer: Column) -> Column:
    """The writer's JSON shows: its field syntax in the question, or an answer in the shape of a pair object."""
    return F.coalesce(question.rlike(LEAKED_JSON), F.lit(False)) | F.coalesce(answer.rlike(JSON_ANSWER), F.lit(False))


def refers_to_source(question: Column, answer: Column) -> Column:
    """Question or answer cites its passage, or the answer reports an author the question didn't ask about."""
    q, a = F.coalesce(question, F.lit("")), F.coalesce(answer, F.lit(""))
    return q.rlike(SOURCE_TEXT) | a.rlike(SOURCE_TEXT) | (a.rlike(AUTHOR_REPORTS) & ~q.rlike(NAMES_AUTHOR))


def answer_text(c: Column, stops: list[str]) -> Column:
    """``struct<answer, finished>``: the turn up to its first stop, an empty thought block dropped, and whether it stopped."""
    finished = F.lit(False)
    out = c
    for s in stops:
        finished = finished | c.contains(s)
        out = F.substring_index(out, s, 1)
    return F.struct(trim_space(F.regexp_replace(out, "^\\s*<think>\\s*</think>\\s*", "")).alias("answer"), finished.alias("finished"))


def trim_space(c: Column) -> Column:
    """Python's strip(): Unicode white space off both ends."""
    return F.regexp_replace(c, "(?U)^\\s++|(?<!\\s)\\s++$", "")  # a run of white space is read once


def clean_question(c: Column) -> Column:
    """White space collapsed and trimmed, quotation marks off the ends."""
    return F.regexp_replace(F.trim(F.regexp_replace(c, "(?U)\\s+", " ")), '^"+|"+$', "")


def usable_question(c: Column) -> Column:
    return c.rlike("(?U)\\w")


def slug(c: Column) -> Column:
    """One path component: other characters than letters, digits, dot, underscore and hyphen as ``--``, the last 60."""
    return F.right(F.regexp_replace(c, "[^A-Za-z0-9._-]+", "--"), F.lit(60))


#: Directory names that say where text lies, not what it is about.
GENERIC_NAMES = ["train", "training", "test", "val", "valid", "validation", "heldout", "held out", "dev", "data", "dataset", "datasets", "corpus", "corpora", "text", "texts", "docs", "documents", "raw", "clean", "cleaned", "input", "inputs", "src"]


def domain_of_path(path: Column) -> Column:
    """The nearest name on a path, from its end, that isn't generic, with spaces for ``_`` and ``-``; else ``the domain``."""
    stem = F.regexp_replace(path, "\\.[A-Za-z0-9]{1,5}$", "")
    names = F.reverse(F.transform(F.split(stem, "/"), lambda p: F.trim(F.regexp_replace(p, "[_\\-]+", " "))))
    own = F.filter(names, lambda n: (n != "") & ~F.lower(n).isin(GENERIC_NAMES))
    return F.coalesce(F.try_element_at(own, F.lit(1)), F.lit("the domain"))


def instruction_prompt(instruction: Column, extra: Column, label: str) -> Column:
    """The instruction with a labelled extra folded in; null where the instruction is blank."""
    i, x = trim_space(instruction), trim_space(F.coalesce(extra, F.lit("")))
    return F.when(F.coalesce(i, F.lit("")) == "", F.lit(None)).otherwise(F.when(x == "", i).otherwise(F.concat(i, F.lit(f"\n\n{label}: "), x)))


def signed_percent(after: Column, before: Column) -> Column:
    """Change in per cent, rounded half-even to one decimal; null where there is no baseline."""
    return F.bround(F.try_divide(after - before, before) * 100, 1)


def drop_burn_in(ids: Column, n: int) -> Column:
    """Token ids without the first n."""
    return F.slice(ids, n + 1, F.greatest(F.size(ids) - n, F.lit(0)))


def render(template: str, **fields: Column) -> Column:
    """A template with its ``{name}`` places filled from columns; null fields as the empty string."""
    out = F.lit(template)
    for name, c in fields.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(c.cast("string"), F.lit("")))
    return out


def render_pair(prompt: Column, response: Column, template: str = "{prompt}\n{response}") -> Column:
    """A pair as one text: by a chat template given as text, else a line each."""
    return render(template, prompt=prompt, response=response)


def strip_licence(c: Column, start: str = "\\*\\*\\*\\s*START OF .*?\\*\\*\\*", end: str = "\\*\\*\\*\\s*END OF ") -> Column:
    """What stands between a licence header's end and its footer's start; the whole text where there are none."""
    head = F.regexp_replace(c, f"(?s)^.*?{start}", "")
    return trim_space(F.regexp_replace(head, f"(?s){end}.*$", ""))


def synthetic_text(topic: Column, number: Column, frames: list[str], n: int, pick: Column | None = None) -> Column:
    """Filler of n sentences chosen from frames by the hash of topic, document and place: the same for the same arguments."""
    options = F.array(*[F.lit(f) for f in frames])
    chosen = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.element_at(options, (F.pmod(F.conv(F.substring(F.sha2(F.concat_ws("/", topic, number.cast("string"), i.cast("string")), 256), 1, 8), 16, 10).cast("long"), F.lit(len(frames))) + 1).cast("int")))
    body = F.replace(F.array_join(chosen, " "), F.lit("{topic}"), topic)
    return F.concat(F.lit("# "), topic, F.lit(" note "), number.cast("string"), F.lit("\n\n"), body, F.lit("\n"))
