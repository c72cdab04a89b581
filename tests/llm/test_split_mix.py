import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import mixing, splitting

SEED = "row_id long, text string, loaded_at int, source string"


def check(text, pieces, limit, overlap):
    assert "".join(text[a + o : b] for a, b, o in pieces) == text
    assert all(b - a <= limit and 0 <= o <= overlap for a, b, o in pieces)
    for (a, _, _), (s, _, o) in zip(pieces, pieces[1:]):
        assert s >= a and not splitting._splits_cluster(text, s + o) or limit < 40


@settings(max_examples=120, deadline=None)
@given(st.lists(st.sampled_from(["word ", "Ein Satz. ", "e.g. No. 3 ", "\n", "\n\n", "\r\n", "# Head\n", "日本。", "👩\u200d👩\u200d👧", "e\u0301", "   ", "x" * 70, "| a | b |\n", "\u2029", ";"]), max_size=120), st.integers(60, 300))
def test_nothing_is_lost_and_nothing_is_too_long(parts, limit):
    text = "".join(parts)
    check(text, splitting.split_text(text, limit, limit // 10), limit, limit // 10)


def test_boundaries_are_the_texts_own():
    text = "\n\n".join(" ".join(f"Sentence {i} of paragraph {p} stands here." for i in range(8)) for p in range(12))
    pieces = splitting.split_text(text, 700, 80)
    assert all(text[a + o - 2 : a + o] == "\n\n" for a, _, o in pieces[1:])  # a paragraph fits, so cuts fall between them
    one = " ".join(f"Dr. Who saw No. {i} of them, e.g. Fig. {i} there." for i in range(60))
    for a, b, o in splitting.split_text(one, 300, 40)[1:]:
        assert one[a + o - 2] == "." and one[a + o : a + o + 3] == "Dr."
    bare = "x" * 1000
    assert len(splitting.split_text(bare, 300, 0)) >= 4


def test_edges():
    assert splitting.split_text("") == [] and splitting.split_text("short") == [(0, 5, 0)]
    assert splitting.split_text("a" * 3500) == [(0, 3500, 0)]
    one = "e" + "\u0301" * 9000  # a single character to a reader, longer than a piece may be: it has to be cut
    assert "".join(one[a + o : b] for a, b, o in splitting.split_text(one)) == one and all(b - a <= 3500 for a, b, _ in splitting.split_text(one))
    check(" " * 4000, splitting.split_text(" " * 4000), 3500, 200)
    big = ("A long text. " * 20000)[:250_000]
    check(big, splitting.split_text(big), 3500, 200)
    with pytest.raises(ValueError):
        splitting.split_text("x" * 100, 50, 25)


def test_operator_cuts_each_row_once(spark):
    long, white = "Word and more. " * 400, " " * 4000
    rows = [(1, long, 2, "a"), (1, long, 1, "a"), (2, "short", 1, "a"), (3, None, 1, "a"), (4, "", 1, "a"), (5, white, 1, "a"), (None, long, 1, "a"), (None, long, 2, "a"), (6, long, None, None)]
    df = spark.createDataFrame(rows, SEED).withColumn("loaded_at", F.timestamp_seconds("loaded_at")).withColumn("piece", F.lit("clash")).withColumn("id", F.lit(9))
    out = splitting.split_long_texts(df, "row_id", "text", arrived="loaded_at").toPandas()
    assert sorted(out.row_id.dropna().unique()) == [1, 5, 6] and out.row_id.isna().sum() == out[out.row_id == 1].shape[0]
    one = out[out.row_id == 1].sort_values("piece_no")
    assert "".join(p[o:] for p, o in zip(one.piece, one.overlap)) == long and one.n_pieces.nunique() == 1
    assert (out[out.row_id == 5].body_chars == 0).all()
    assert splitting.split_long_texts(df.limit(0), "row_id", "text", arrived="loaded_at").count() == 0


PLAN = "plan_id string, source string, weight double, max_repeats int, budget_ratio double"


def corpus(spark, rows):
    return spark.createDataFrame(rows, SEED).withColumn("loaded_at", F.timestamp_seconds("loaded_at"))


def test_pfair_keeps_every_source_within_a_block():
    rng = random.Random(1)
    for _ in range(20):
        w = [rng.random() + 0.01 for _ in range(rng.randint(1, 8))]
        shares = [x / sum(w) for x in w]
        n = 400
        slots = mixing.pfair_slots(shares, [int(n * u) + 1 for u in shares])
        done = [0] * len(shares)
        for s, i, j in slots[: n - len(shares)]:
            assert j == done[i]
            done[i] += 1
            assert all(abs(d - u * (s + 1)) < 1 + 1e-6 for d, u in zip(done, shares))
    assert mixing.pfair_slots([], []) == [] and mixing.pfair_slots([1.0], [0]) == []
    assert [i for _, i, _ in mixing.pfair_slots([0.5, 0.5], [1, 3])] == [0, 1, 1, 1]  # a source that runs out


def test_mix_reaches_the_targets(spark):
    rng = random.Random(2)
    rows = [(i, "x" * rng.randint(20, 60), 1, ["Big-Source ", "mid", "small"][0 if i % 3 else 1 if i % 2 else 2]) for i in range(3000)]
    df = corpus(spark, rows)
    plan = spark.createDataFrame([("p", "big_source", 1.0, 2, 0.5), ("p", "mid", 1.0, 9, 0.5), ("p", "small", 2.0, 1, 0.5), ("q", "mid", 3.0, 1, 0.1), ("q", "gone", 1.0, 1, 0.1)], PLAN)
    t = {(r.plan_id, r.source): r for r in mixing.plan_targets(plan, mixing.usable_rows(df)).collect()}
    shares = {(r.plan_id, r.source): r for r in mixing.mix_shares(df, plan).collect()}
    short = sorted(map(tuple, mixing.short_sources(df, plan).collect()))
    assert short == sorted(k for k, r in t.items() if r["size"] * r.max_repeats < r.target) == [("p", "small"), ("q", "gone")]
    for k, r in shares.items():
        reach = min(t[k].target, t[k].capacity)
        assert abs(r.actual_chars - reach) <= 60 and r.max_copies <= t[k].max_repeats
    mixed = mixing.mix(df, plan).toPandas()
    assert mixed.groupby(["plan_id", "source"]).n_chars.sum().to_dict() == {k: r.actual_chars for k, r in shares.items() if r.actual_chars}
    assert not mixed.duplicated(["plan_id", "source", "row_id", "copy"]).any()
    run = mixed[(mixed.plan_id == "p") & (mixed.source != "small")].sort_values(["slot", "place"])
    run = run.assign(big=(run.source == "big_source") * run.n_chars).head(len(run) // 2)
    assert abs(run.big.sum() / run.n_chars.sum() - 0.5) < 0.05
    again = mixing.mix(df.repartition(7), plan).toPandas()
    by = ["plan_id", "source", "row_id", "copy"]
    assert again.sort_values(by).reset_index(drop=True).equals(mixed.sort_values(by).reset_index(drop=True))


def test_blocks_dont_grow_with_the_corpus(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_CHARS", 50)
    df = corpus(spark, [(i, "x" * 40, 1, "ab"[i % 2]) for i in range(300)])
    plan = spark.createDataFrame([("p", "a", 1.0, 1, 0.9), ("p", "b", 1.0, 1, 0.9)], PLAN)
    slots = mixing.schedule(mixing.plan_targets(plan, mixing.usable_rows(df)), blocks=2).toPandas()
    assert (slots.block_chars == 50).all() and len(slots) == 2 * 108  # 10,800 characters
    mixed = mixing.mix(df, plan, blocks=2).toPandas().sort_values(["slot", "place"])
    done = (mixed.source == "a").mul(mixed.n_chars).cumsum() / mixed.n_chars.cumsum()
    assert (done[20:] - 0.5).abs().max() < 0.1


def test_long_runs_end_soon():
    import time

    began = time.monotonic()
    for run in ("x" * 1_000_000, "👩\u200d👩\u200d👧" * 100_000):
        pieces = splitting.split_text(run)
        check(run, pieces, 3500, 200)
        assert len(pieces) < len(run) / 2500
    assert time.monotonic() - began < 30


def test_mix_edges(spark):
    df = corpus(spark, [(1, "abcd", 1, "A"), (1, "abcd", 2, "A"), (2, "  ", 1, "a"), (3, None, 1, "a"), (4, "xy", 1, None), (None, "zz", 1, "a"), (None, "zz", 2, "a")])
    rows = sorted(mixing.usable_rows(df).collect(), key=str)
    assert [tuple(r) for r in rows] == sorted([(1, "a", 4), (4, "unknown", 2), (None, "a", 2)], key=str)
    plan = spark.createDataFrame([("p", "a", 1.0, 2, 1.0), ("p", "unknown", None, 1, 1.0), (None, "a", 1.0, None, 1.0)], PLAN)
    assert {(r.plan_id, r.source) for r in mixing.short_sources(df, plan).collect()} == {("", "a")}
    assert mixing.mix(df.limit(0), plan).count() == 0 and mixing.mix(df, plan.limit(0)).count() == 0
    assert mixing.short_sources(df.limit(0), plan).count() == 0
