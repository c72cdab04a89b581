import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions.seeded import epoch_offset
from lodestone.operators import chunking, corpora


def plain_spans(n, off, length=512, stride=512):
    """Brute force: cut positions, then the pieces between."""
    off = 0 if off < 10 or n <= length else off
    starts = [(s, min(s + length, off, n)) for s in range(0, off, stride)] + [(s, min(s + length, n)) for s in range(off, n, stride)]
    return [(a, b) for a, b in starts if b - a >= 10]


@pytest.mark.parametrize("stride", [512, 128, 700])
def test_chunks_are_those_of_brute_force(spark, stride):
    lengths = [0, 1, 9, 10, 511, 512, 513, 600, 1024, 1500, 2049, 5000]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "id long, n long")
    for off in (0, 5, 9, 10, 200, 511):
        got = {}
        for r in chunking.chunk_bounds(df, "id", "n", off, stride=stride).collect():
            got.setdefault(r.id, []).append((r.start, r.end))
        counts = {r.id: r.c for r in df.select("id", chunking.chunk_count(F.col("n"), chunking.document_offset(F.col("n"), off), stride=stride).alias("c")).collect()}
        for i, n in enumerate(lengths):
            want = plain_spans(n, off, stride=stride)
            assert sorted(got.get(i, [])) == sorted(want), (n, off)
            assert counts[i] == len(want), (n, off)


def test_every_offset_tiles_the_document(spark):
    missing = spark.createDataFrame([(n,) for n in (513, 600, 700, 1024, 1500, 2049, 5000)], "n long").select("n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(511).cast("long"))).alias("o"))
    o = F.when(F.col("o") < 10, 0).otherwise(F.col("o")).cast("long")
    held = F.aggregate(chunking.spans(F.col("n"), o), F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    assert missing.filter(F.col("n") - held > 9).count() == 0
    # the control: a cut that leaves the leading part out misses it, and the same assertion sees that
    bad = missing.filter("o >= 10").filter(F.col("n") - (held - F.col("o")) > 9)
    assert bad.count() > 0


def test_batches_pad_on_the_left(spark):
    df = spark.createDataFrame([(i, list(range(i + 1))) for i in range(7)], "id long, ids array<long>")
    out = chunking.batches(df, "id", "ids", 3, seed=1, pad=-1).toPandas()
    assert sorted(out.groupby("batch").size()) == [1, 3, 3]
    for _, b in out.groupby("batch"):
        assert b.padded.map(len).nunique() == 1
    assert all(list(p[-m:]) == list(range(m)) and all(x == -1 for x in p[:-m]) for p, m in zip(out.padded, out.mask_ones))


def test_windows_score_each_token_once(spark):
    for n in (0, 1, 512, 2048, 2049, 5000):
        ws = spark.createDataFrame([(n,)], "n long").select(chunking.scoring_windows(F.col("n")).alias("w")).first().w
        assert sum(w.new for w in ws) == n and (not ws or ws[-1].end == n)


def test_reports_of_nothing(spark):
    none = spark.createDataFrame([], "id long, n long")
    r = chunking.chunk_report(none, "n", F.lit(False)).first()
    assert (r.n_docs, r.n_chunks, r.total_tokens) == (0, 0, 0)
    assert chunking.shape_report(none, "id", "n").first().dominant_share is None
    assert epoch_offset(0, 1, 512) == 0 and 0 <= epoch_offset(3, 1, 512) < 512


def test_source_predicates(spark):
    cases = [("{'arxiv_id': '1'}", ["redpajama_arxiv"]), ("{'url': 'https://ARXIV.org/x'}", ["redpajama_arxiv"]), ('{"url": "http://facebook.com"}', ["redpajama_book", "redpajama_web"]), ("{'title': 'A Book'}", ["redpajama_book"]), ("{'url': 'https://en.wikipedia.org'}", ["redpajama_wikipedia"]), ("{'url': 'https://git", []), (None, []), ("", []), ("{}", [])]
    got = spark.createDataFrame([(i, m) for i, (m, _) in enumerate(cases)], "i int, m string").select("i", corpora.source_labels(F.col("m")).alias("s")).orderBy("i").collect()
    assert [r.s for r in got] == [w for _, w in cases]


def test_quotas_and_ratio(spark):
    a = corpora.allocate(spark.createDataFrame([("x", 2000), ("y", 2000)], "name string, n int"), 100)
    assert sorted(r.quota for r in a.collect()) == [50, 50]
    assert sorted(r.quota for r in corpora.allocate(spark.createDataFrame([("x", 5000), ("y", 2000)], "name string, n int"), 70).collect()) == [20, 50]
    one, two = spark.range(500), spark.range(900)
    assert {r.side: r["count"] for r in corpora.ratio_mix(one, two, "id").groupBy("side").count().collect()} == {"first": 500, "second": 50}
    assert {r.side: r["count"] for r in corpora.ratio_mix(one, spark.range(30), "id").groupBy("side").count().collect()} == {"first": 300, "second": 30}
    assert corpora.ratio_mix(one, spark.range(0), "id").count() == 0


@pytest.mark.parametrize("target", [0.0, 0.05, 0.13, 0.5, 0.95])
def test_budget_prefix_is_that_of_brute_force(spark, target):
    rng = random.Random(3)
    pairs = spark.createDataFrame([(i, rng.randint(1, 60)) for i in range(40)], "id long, n long")
    from lodestone.functions.seeded import order_key

    order = [r.n for r in pairs.orderBy(order_key(42, "pairs", F.col("id")), "id").collect()]
    raw, cums = 1000, [0]
    for n in order:
        cums.append(cums[-1] + n)
    best = min(range(len(cums)), key=lambda k: (abs(cums[k] / (raw + cums[k]) - target), k)) if target else 0
    got = corpora.budget_prefix(pairs, "id", "n", raw, target).first()
    assert (got.n_pairs, got.pair_tokens) == (best, cums[best])
    assert got.under_target == (best == 40 and cums[best] / (raw + cums[best]) < target - 1e-9 and target > 0)
    assert corpora.budget_prefix(pairs.limit(0), "id", "n", raw, target).first().n_pairs == 0
    with pytest.raises(ValueError):
        corpora.budget_prefix(pairs, "id", "n", raw, 1.0)


def test_forest_pairs(spark):
    long = "A message that is long enough to count."
    rows = [("p", None, "prompter", "en", long, 1), ("a", "p", "assistant", "de", long, 1), ("b", "p", "assistant", None, long, 1), ("s", "p", "assistant", "en", "short", 1), ("d", None, "prompter", "de", long, 1), ("e", "d", "assistant", "en", long, 1), ("o", "gone", "assistant", "en", long, 1), ("a", "p", "assistant", "de", long + "!", 2), (None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "message_id string, parent_id string, role string, lang string, text string, loaded_at int").withColumn("loaded_at", F.timestamp_seconds("loaded_at"))
    got = sorted((r.message_id, r.reply_id, r.response) for r in corpora.forest_pairs(df).collect())
    assert got == [("p", "a", long + "!"), ("p", "b", long)]
    assert corpora.forest_pairs(df.limit(0)).count() == 0


def test_turns_carry_their_history(spark):
    turns = [(1, 0, "system", "s"), (1, 1, "user", "q1"), (1, 2, "assistant", "a1"), (1, 3, "user", "q2"), (1, 4, "assistant", "a2"), (2, 0, "user", ""), (2, 1, "assistant", "x"), (3, 0, "user", "only")]
    got = [(r.c, r.turn, r.prompt, r.response) for r in corpora.turn_pairs(spark.createDataFrame(turns, "c int, turn int, role string, text string"), "c", "turn").orderBy("c", "turn").collect()]
    assert got == [(1, 1, "Conversation history:\nSystem: s\n\nUser: q1", "a1"), (1, 3, "Conversation history:\nSystem: s\n\nUser: q1\n\nAssistant: a1\n\nUser: q2", "a2")]


def test_statistics_and_tally(spark):
    df = spark.createDataFrame([("a", "xxxx"), (None, "yy"), ("a", None)], "source string, text string")
    got = {r.source: (r.n_rows, r.n_chars, r.n_tokens, r.mean_chars) for r in corpora.corpus_statistics(df, F.col("source"), F.length("text")).collect()}
    assert got == {"a": (2, 4, 1, 2.0), "unknown": (1, 2, 0, 2.0)}
    tally = corpora.rejection_tally(spark.createDataFrame([("x",), ("x",)], "reason string"), ["x", "y"])
    assert sorted((r.reason, r.n) for r in tally.collect()) == [("x", 2), ("y", 0)]
