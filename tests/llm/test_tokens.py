import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import budget, encoding, tokens

pytestmark = pytest.mark.skipif(not os.path.isdir(tokens.TOKENIZERS), reason="the vocabulary files aren't here")
ODD = ["", "<|endoftext|> a", "\x1c\x1d x\x1e", "\u00a0\u3000 a  b", "a" * 3000, "ab" * 1500, "it's IT'S don't'll", "\u0301\u0301", "١٢٣ ⅷ ²", "👩\u200d👩\u200d👧" * 50, "\x85\x85a\u2028", "\ufeffx", " " * 2001, "\ud7ff"]


@pytest.fixture(scope="module")
def vocabulary():
    with open(tokens.vocabulary_path("byte_bpe_50k"), "rb") as f:
        return tokens.Vocabulary(f.read())


@pytest.fixture(scope="module")
def public():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(os.path.join(tokens.TOKENIZERS, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_ids_and_counts_are_those_of_the_public_tokenizer(vocabulary, public):
    want = public(ODD)
    lexicon, counter = encoding._Lexicon(vocabulary), tokens.SymbolCounter(vocabulary)
    assert lexicon.encode(ODD).to_pylist() == want
    assert lexicon.encode(ODD[::-1]).to_pylist() == want[::-1]  # from what is remembered
    assert [sum(counter[p] for p in tokens.pieces_of(t)) for t in ODD] == [len(w) for w in want]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=8))
def test_any_text(vocabulary, public, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    got = encoding._Lexicon(vocabulary).encode(texts).to_pylist()
    assert got == public(texts)
    assert [b"".join(vocabulary.bytes_of[i] for i in ids).decode() for ids in got] == texts  # and back


def test_encode_corpus(spark, public):
    rows = [(1, "Hello world"), (1, "Hello world"), (2, None), (3, ""), (None, "x"), (4, "many words " * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("id", F.lit(0))
    got = sorted(((r.doc_id, list(r.ids)) for r in encoding.encode_corpus(df, "doc_id", "text").collect()), key=str)
    assert got == sorted(((i, public([t])[0] if t else []) for i, t in rows), key=str)
    assert encoding.encode_corpus(df.limit(0), "doc_id", "text").count() == 0


def test_blocks_do_not_change_ids(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"text number {i} and more") for i in range(50)], "doc_id long, text string").coalesce(1)
    whole = sorted(map(str, encoding.encode_corpus(df, "doc_id", "text").collect()))
    monkeypatch.setattr(encoding, "BLOCK_CHARS", 30)
    assert sorted(map(str, encoding.encode_corpus(df, "doc_id", "text").collect())) == whole


def test_vocabulary_is_bounded(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(tokens, "MAX_VOCABULARY_BYTES", 10)
    with pytest.raises(ValueError):
        tokens.share_vocabulary(spark, tokens.vocabulary_path("byte_bpe_50k"))


def test_tokens_of_each_document_are_as_many_as_its_ids(spark, public):
    texts = ["One text, told once.", "Two " * 30, "日本語のテキスト", "x"]
    rows = [(i, t, "Some-Source ", "EN_us", None, 1) for i, t in enumerate(texts)] + [(0, "later", "other", "fr", "d", 2), (9, " ", "s", "en", "d", 1), (8, None, "s", "en", "d", 1)]
    df = spark.createDataFrame(rows, "row_id long, text string, source string, lang string, domain string, loaded_at int").withColumn("loaded_at", F.timestamp_seconds("loaded_at"))
    got = {r.row_id: (r.source, r.lang, r.domain, r.n_tokens) for r in budget.document_tokens(df).collect()}
    ids = {r.row_id: len(r.ids) for r in encoding.encode_corpus(df.filter("loaded_at = timestamp_seconds(1)"), "row_id", "text").collect()}
    assert got == {i: ("some_source", "en", "unknown", ids[i]) for i in range(4)}
    assert budget.document_tokens(df.limit(0)).count() == 0


def test_budget_rolls_up_exactly(spark, public):
    texts = {1: "Hello world", 2: "Bonjour le monde", 3: "  ", 4: None, 5: "again and again " * 300, 6: "x"}
    rows = [
        (1, texts[1], "Dolly", "en", "history", 2), (1, texts[1], "Dolly", "en", "history", 1), (2, texts[2], "red-pajama ", "FR-fr", " History", 1), (3, texts[3], "dolly", "en", None, 1),
        (4, texts[4], None, None, None, 1), (5, texts[5], "", None, "", 1), (6, texts[6], None, "und", "misc", None), (None, "no id", "dolly", "en", "history", 1), (None, "no id", "dolly", "en", "history", 2),
    ]
    df = spark.createDataFrame(rows, "row_id long, text string, source string, lang string, domain string, loaded_at int").withColumn("loaded_at", F.timestamp_seconds("loaded_at")).withColumn("n_tokens", F.lit("clash"))
    got = {(r.slice, r.source, r.lang, r.domain): (r.n_rows, r.n_tokens) for r in budget.token_budget(df).collect()}
    n = lambda t: len(public([t])[0])
    assert got[("cell", "dolly", "en", "history")] == (2, n(texts[1]) + n("no id"))
    assert got[("source", "red_pajama", None, None)] == (1, n(texts[2])) and got[("lang", None, "fr", None)] == (1, n(texts[2]))
    assert got[("source", "unknown", None, None)] == (2, n(texts[5]) + n(texts[6])) and got[("lang", None, "unknown", None)][0] == 2
    assert got[("domain", None, None, "history")] == (3, n(texts[1]) + n("no id") + n(texts[2]))
    total = got[("all", None, None, None)]
    for s in ("cell", "source", "lang", "domain"):
        assert tuple(map(sum, zip(*[v for k, v in got.items() if k[0] == s]))) == total
    empty = [(r.slice, r.n_rows, r.n_tokens) for r in budget.token_budget(df.limit(0)).collect()]
    assert empty == [("all", 0, 0)]
