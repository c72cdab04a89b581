import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import folds, text


def one(spark, column, *values, schema="t string"):
    return [r.x for r in spark.createDataFrame([v if isinstance(v, tuple) else (v,) for v in values], schema).select(column.alias("x")).collect()]


def test_characters_are_normalised(spark):
    raw = ["a\r\nb\rc", "a\x0bb\x0cc\x85d e f", "a b c\td", "x​y﻿z­w", "é", "a\x00b\x07c", None, ""]
    want = ["a\nb\nc", "a\nb\nc\nd\ne\nf", "a b c d", "xyzw", "é", "abc", None, ""]
    out = one(spark, text.normalise_characters(F.col("t")), *raw)
    assert out == want
    assert one(spark, text.normalise_characters(F.col("t")), *want) == want


def test_cleaning_takes_artifacts_out_and_is_idempotent(spark):
    raw = "# Head\n\nSome <sup>1</sup> text\nthat wraps [link](http://x) here.\n\n![img](a.png)\n\n- item\n- more\n\n**Bold only**\n\n---\n\nblank \\_\\_\\_\\_ line  two"
    once = one(spark, folds.clean_text(F.col("t")), raw)[0]
    assert once == "# Head\n\nSome 1 text that wraps link here.\n\n- item\n- more\n\nblank ____ line two"
    assert one(spark, folds.clean_text(F.col("t")), once)[0] == once
    assert one(spark, folds.clean_text(F.col("t")), None, "", " \n ") == [None, "", ""]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<sup>", "</sup>", "<sub>", "</sub>", "<span x>", "</span>", "[", "]", "[[", "]]", "\\*", "\\_", "![", "](", ")", "**", "---", "\n", "\n\n", " ", "- ", "# ", "1. ", "a", "b c", "e\u0301"]), max_size=30).map("".join))
def test_cleaning_is_idempotent(raw):
    once = folds.clean(raw)
    assert folds.clean(once) == once


def test_nested_tags_are_cleaned_at_once():
    assert folds.clean("a<sup>1<sub>2</sub></sup> b") == "a12 b" and folds.clean("a<sup>1<sup>2</sup></sup> b") == "a12 b"
    assert folds.clean("a\n\n ---\n\nb") == "a\n\nb"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab .!?\n", max_size=400), max_size=6), st.integers(20, 120))
def test_splitting_loses_nothing(parts, target):
    whole = "\n\n".join(parts)
    pieces = folds.split_documents(whole, target)
    assert "".join("".join(pieces).split()) == "".join(whole.split())
    assert all(pieces)


def test_splitting_rules():
    p = "x" * 60
    assert folds.split_documents("\n\n".join([p] * 4), 100) == [p + "\n\n" + p] * 2
    assert folds.split_documents("\n\n".join([p, p, "short"]), 100) == [p + "\n\n" + p + "\n\nshort"]
    assert folds.split_documents("short", 100) == ["short"] and folds.split_documents("", 100) == []
    long = ("word " * 9 + "end. ") * 20
    cut = folds.split_documents(long, 100)
    assert all(50 <= len(c) <= 250 for c in cut) and all(c.endswith("end.") for c in cut)
    assert folds.split_documents("\n\n".join([p, p, "short"]), 100, least=50) == [p + "\n\n" + p]
    with pytest.raises(ValueError):
        folds.split_documents("x", 0)


def test_passages_drop_runts():
    assert folds.passages("a" * 300 + "\n\n" + "b" * 300 + "\n\n" + "c" * 100, 500, 200) == ["a" * 300, "b" * 300 + "\n\n" + "c" * 100]
    assert folds.passages("tiny", 500, 200) == [] and folds.passages("", 500, 200) == []


@pytest.mark.parametrize(
    "raw, want",
    [
        ('["What is X?", "Why Y?"] and [1] after', ["What is X?", "Why Y?"]),
        ('[1] then [{"question": "How?"}]', ["How?"]),
        ('["topic", "other"] ["Real one?"]', ["Real one?"]),
        ("['What\\'s this?', 'And that?']", ["What's this?", "And that?"]),
        ('[{"question": "Cut off?", "answer": "x', ["Cut off?"]),
        ('["One?" "Two?"', ["One?", "Two?"]),
        ('[{"question": "One?", "answer": "yes?"}, {"question": "Two?"', ["One?", "Two?"]),
        ('[[1, ["Inner?"]], "Outer?"] x', ["Outer?"]),
        ("['it's one?', 'two?']", ["it's one?", "two?"]),
        ("1. First?\n- Second?\nQ3: Third?\nnot one", ["First?", "Second?", "Third?"]),
        ('["..."]', []),
        ("", []),
    ],
)
def test_questions_are_parsed_forgivingly(raw, want):
    assert folds.parse_questions(raw) == want


def test_html_becomes_markdown():
    page = "<html><head><title>t</title></head><body><nav>menu</nav><h2>Head</h2><p>One <b>two</b> <a href='u'>three</a></p><ul><li>a</li><li>b</li></ul><script>x()</script><footer>f</footer></body></html>"
    assert folds.html_to_markdown(page) == "## Head\n\nOne **two** [three](u)\n\n* a\n* b"
    assert folds.html_to_markdown("plain") == "plain" and folds.html_to_markdown("") == ""


def test_code_and_tables_keep_their_form():
    page = "<body><pre><code>def f(x):\n    if x &lt; 1:\n\treturn <b>x</b>\n</code></pre><p>Use <code>f</code>.</p><table><tr><th>a</th><th>b</th></tr><tr><td>1 <i>x</i></td><td>p|q</td></tr><tr><td>3</td></tr></table><table><tr><td>only</td></tr></table>"
    want = "```\ndef f(x):\n    if x < 1:\n\treturn x\n```\n\nUse `f`.\n\n| a | b |\n| --- | --- |\n| 1 *x* | p\\|q |\n| 3 |  |\n\n|  |\n| --- |\n| only |"
    assert folds.html_to_markdown(page) == want
    assert folds.html_to_markdown("<pre>open\n  end") == "```\nopen\n  end\n```" and folds.html_to_markdown("<table><tr><td>x") == "|  |\n| --- |\n| x |"
    assert folds.html_to_markdown("<table></table>\0<td>y</td>") == "y"


def test_repeat_share(spark):
    eight = "a b c d e f g h"
    out = one(spark, text.repeat_share(F.col("t")), "a b c", eight, f"{eight} {eight} {eight}", "", None)
    assert out[0] == 0 and out[1] == 0 and out[3] == 0 and out[4] == 0
    assert out[2] == pytest.approx(1 - 8 / 17)


def test_predicates(spark):
    pairs = [("What?", '{"question": "a"'), ('He said "question": x', "fine"), ("What does the passage say?", "x"), ("Why?", "According to the text, yes."), ("Why?", "The passage of time."), ("Why?", "The author states it."), ("What does the author mean?", "The author means it."), (None, None)]
    df = spark.createDataFrame(pairs, "q string, a string")
    got = [tuple(r) for r in df.select(text.leaks_json(F.col("q"), F.col("a")), text.refers_to_source(F.col("q"), F.col("a"))).collect()]
    assert got == [(True, False), (True, False), (False, True), (False, True), (False, False), (False, True), (False, False), (False, False)]
    assert one(spark, text.is_structural(F.col("t")), "", "# x", "- x", "* x", "| x", "> x", "1. x", "prose", "-x") == [True] * 7 + [False] * 2


def test_small_transforms(spark):
    cut = one(spark, text.answer_text(F.col("t"), ["<|im_end|>"]), "<think>\n</think>\nYes.<|im_end|> more", "never ends")
    assert [(r.answer, r.finished) for r in cut] == [("Yes.", True), ("never ends", False)]
    assert one(spark, text.cut_at_marker(F.col("t"), ["##", "@@"]), "a @@ b ## c", "plain ") == ["a", "plain"]
    assert one(spark, text.clean_question(F.col("t")), ' "What  is\n this?" ') == ["What is this?"]
    assert one(spark, text.slug(F.col("t")), "Org/Model name:1") == ["Org--Model--name--1"]
    assert one(spark, text.domain_of_path(F.col("t")), "/data/dar_win/train", "corpus/texts", "/x/notes.txt") == ["dar win", "the domain", "notes"]
    assert one(spark, text.instruction_prompt(F.col("q"), F.col("e"), "Input"), (" do ", " x "), ("do", ""), (" ", "x"), (None, None), schema="q string, e string") == ["do\n\nInput: x", "do", None, None]
    assert one(spark, text.signed_percent(F.col("a"), F.col("b")), (110.0, 100.0), (1.0, 0.0), (99.75, 100.0), schema="a double, b double") == [10.0, None, -0.2]


@pytest.mark.parametrize("unit", [".", " ", "[", "[x](", "-\n", "*", "_", "\\_", "<", ". ", "# a\n", "```\n", '["', "?"])
def test_very_long_texts_end_soon(spark, unit):
    import time

    text_ = (unit * 100_000)[:100_000]
    began = time.monotonic()
    folds.clean(text_), folds.split_documents(text_), folds.passages(text_)
    one(spark, F.struct(F.size(text.sentences(F.col("t"))), text.trim_space(F.col("t"))), text_)
    assert time.monotonic() - began < 20
