import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import documents, lineage, ranking
from lodestone.functions.seeded import order_key
from lodestone.operators.deliveries import first_delivery
from lodestone.plans import prepare
from lodestone.sources import files, sinks

A = "This is a sentence of well over sixty characters, so that it is compared with others."
C = "A third sentence stands here, and nothing else in any of these texts is at all like it."
B = "Another sentence that is long enough to be compared, and that is not the same as the first."


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_overlap_counts_characters_and_repeats(spark):
    new = spark.createDataFrame([(1, f"{A} {A} {B}"), (2, B), (3, "short"), (4, None), (5, "")], "id long, text string")
    old = spark.createDataFrame([(9, f"Head\n\n{A} Tail."), (8, A), (7, None)], "item long, text string")
    got = {r.id: (r.total_chars, r.shared_chars, r.verdict) for r in documents.overlap_share(new, old, "id", "item").collect()}
    assert got == {1: (2 * len(A) + len(B), 2 * len(A), "refuse"), 2: (len(B), 0, "ok")}
    top = rows(documents.attribution(new, old, "id", "item"))
    assert top == [(1, 8, 2 * len(A), 1, 2), (1, 9, 2 * len(A), 2, 2)]


def test_attribution_against_all_pairs(spark):
    rng = random.Random(5)
    pool = [f"Sentence number {i} of the shared pool is long enough to be compared with others." for i in range(30)]
    texts = [" ".join([pool[0]] * rng.randint(0, 1) + rng.sample(pool, rng.randint(0, 4))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts[:40])), "id long, text string")
    held = spark.createDataFrame(list(enumerate(texts[20:])), "h long, t string")
    cut = lambda t: [x + "others." for x in t.split("others.")[:-1]] if t else []
    want = []
    for i, t in enumerate(texts[:40]):
        mine = [x.strip() for x in cut(t)]
        credit = {h: c for h, u in enumerate(texts[20:]) if (c := sum(len(x) for x in mine if x in {y.strip() for y in cut(u)}))}
        best = sorted(credit.items(), key=lambda x: (-x[1], x[0]))
        want += [(i, h, c, p, len(best)) for p, (h, c) in enumerate(best[:3], 1)]
    assert rows(documents.attribution(df, held, "id", "h", holder_text="t")) == sorted(want)


def test_overlap_is_of_existing_and_earlier_texts_together(spark):
    new = spark.createDataFrame([(1, A), (2, f"{A} {B} {C}")], "id long, text string")
    old = spark.createDataFrame([(9, B), (8, f"{A} {B}")], "item long, text string")
    got = {r.id: (r.shared_chars, r.verdict) for r in documents.ordered_overlap(new, "id", existing=old.filter("item = 9")).collect()}
    assert got == {1: (0, "ok"), 2: (len(A) + len(B), "refuse")}
    got = {r.id: r.shared_chars for r in documents.ordered_overlap(new, "id", existing=old).collect()}
    assert got == {1: len(A), 2: len(A) + len(B)}  # held twice, counted once


def test_ordered_overlap_looks_back_only(spark):
    df = spark.createDataFrame([(1, f"{A} {A}"), (2, A), (3, f"{A} {B}")], "id long, text string")
    got = {r.id: r.verdict for r in documents.ordered_overlap(df, "id").collect()}
    assert got[1] == "ok" and got[2] == "refuse" and got[3] == ("warn" if len(A) < len(B) else "refuse")
    assert documents.ordered_overlap(df.limit(0), "id").count() == 0


def test_held_out_split(spark):
    df = spark.range(25).withColumnRenamed("id", "doc")
    split = documents.split_held_out(df, "doc", 0.1, 42)
    assert split.filter("held_out").count() == 3  # floor(25 * 0.9) = 22 stay
    again = documents.split_held_out(df.repartition(7), "doc", 0.1, 42)
    assert rows(split) == rows(again) and rows(split) != rows(documents.split_held_out(df, "doc", 0.1, 43))
    assert documents.split_held_out(df, "doc", 0, 42).filter("held_out").count() == 0
    assert documents.split_held_out(df.limit(1), "doc", 0.5, 42).filter("held_out").count() == 0
    with pytest.raises(documents.PreparationRefused):
        documents.split_held_out(df.limit(2), "doc", 0.9, 42)
    assert [documents.min_documents_for_held_out(v) for v in (0, 0.1, 0.5, 0.9)] == [2, 2, 2, 11]  # 10 * (1 - 0.9) is just below 1
    with pytest.raises(ValueError):
        documents.min_documents_for_held_out(1.0)


def test_prefix_is_a_global_order(spark):
    df = spark.range(500).select(F.col("id"), (F.col("id") % 3).alias("g"), (F.col("id") % 7).alias("n"))
    run = ranking.with_prefix(df.repartition(5), order_key(1, "t", F.col("id")), {"total": F.col("n")}, by=("g",), tie="id").toPandas()
    for _, part in run.groupby("g"):
        part = part.sort_values("rnk")
        assert part.rnk.tolist() == list(range(1, len(part) + 1)) and part.total.tolist() == part.n.cumsum().tolist()
    assert ranking.with_prefix(df.limit(0), order_key(1, "t", F.col("id")), tie="id").count() == 0


def test_first_delivery(spark):
    df = spark.createDataFrame([(1, "a", 2), (1, "a", 1), (2, None, 1), (None, "x", 1), (None, "x", 2), (None, "y", 1), (3, "b", None), (3, "c", 5)], "k long, v string, at int")
    out = first_delivery(df.withColumn("at", F.timestamp_seconds("at")), "k", "at", {"v": F.col("v")})
    assert sorted(out.collect(), key=str) == sorted([(1, "a"), (2, None), (3, "c"), (None, "x"), (None, "y")], key=str)


def test_names_never_collide(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("a", 4)], "stem string, o int")
    assert rows(documents.unique_names(df, "stem", "o").select("o", "name")) == [(1, "a"), (2, "a_1"), (3, "b"), (4, "a_2")]
    taken = spark.createDataFrame([("a",), ("a_1",)], "name string")
    assert rows(documents.unique_names(df, "stem", "o", taken).select("o", "name")) == [(1, "a_2"), (2, "a_3"), (3, "b"), (4, "a_4")]
    gaps = spark.createDataFrame([("a_1",), ("a_3",), ("a_03",), ("x",)], "name string")
    assert rows(documents.unique_names(df, "stem", "o", gaps).select("o", "name")) == [(1, "a"), (2, "a_2"), (3, "b"), (4, "a_4")]
    like = spark.createDataFrame([("a", 1), ("a", 2), ("a_1", 3), ("a_1", 4), ("a_1_1", 5), (None, 6)], "stem string, o int")
    names = rows(documents.unique_names(like, "stem", "o", taken).select("o", "name"))
    assert names == [(1, "a_2"), (2, "a_3"), (3, "a_1_2"), (4, "a_1_3"), (5, "a_1_1"), (6, None)]
    one = spark.createDataFrame([("chapter_3", 1)], "stem string, o int")
    assert rows(documents.unique_names(one, "stem", "o", one.select(F.col("stem").alias("name"))).select("name")) == [("chapter_3_1",)]


@pytest.mark.parametrize("seed", range(4))
def test_names_of_random_stems(spark, seed):
    rng = random.Random(seed)
    stem = lambda: rng.choice("ab") + "".join(f"_{rng.choice([0, 1, 2, 10, '01'])}" for _ in range(rng.randint(0, 3)))
    df = spark.createDataFrame([(stem(), i) for i in range(150)], "stem string, o int")
    taken = spark.createDataFrame([(stem(),) for _ in range(60)], "name string")
    names = [r.name for r in documents.unique_names(df, "stem", "o", taken).collect()]
    assert len(set(names)) == 150 and not set(names) & {r.name for r in taken.collect()}


def test_combined_and_fingerprint(spark):
    df = spark.createDataFrame([("g", "n2", "two", 2), ("g", "n1", "one", 1), (None, "n3", "x", 5)], "g string, n string, t string, o int")
    blocks = documents.combined(df, "g", "n", "t", "o").filter("g = 'g'").orderBy("o").collect()
    assert "".join(b.block for b in blocks) == "# Source: n1\n\none" + documents.RULE + "# Source: n2\n\ntwo"
    prints = lambda x: {r.g: r.fingerprint for r in documents.corpus_fingerprint(x, "t", "o", "g").collect()}
    assert prints(df) == prints(df.repartition(3)) and set(prints(df)) == {"g", None}
    assert prints(df)["g"] != prints(df.withColumn("o", -F.col("o")))["g"] and prints(df)["g"] != prints(df.withColumn("t", F.upper("t")))["g"]


@pytest.mark.parametrize("kind", ["int", "string"])
def test_ordered_rank(spark, kind):
    df = spark.range(700).select((F.col("id") * 7919 % 10007).cast(kind).alias("o"), F.when(F.col("id") % 10 < 8, "hot").when(F.col("id") % 10 == 8, "cold").alias("g"))
    got = ranking.with_ordered_rank(df.repartition(5), "o", by=("g",)).toPandas()
    for _, part in got.groupby("g", dropna=False):
        assert part.sort_values("o").rnk.tolist() == list(range(1, len(part) + 1))
    assert ranking.with_ordered_rank(df.limit(0), "o").count() == 0


def test_files_are_found_extracted_and_prepared(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes(b"bad \xff byte")
    (tmp_path / "sub" / "b.html").write_text("<body><h1>T</h1><p>x</p></body>")
    (tmp_path / "c.bin").write_text("no")
    found = files.find_files(spark, [str(tmp_path)])
    assert sorted(r.extension for r in found.collect()) == ["html", "txt"]
    assert sorted(r.text for r in files.extract(found).collect()) == ["# T\n\nx", "bad � byte"]
    with pytest.raises(files.SourceUnavailable):
        files.find_files(spark, [str(tmp_path / "none")]).count()
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    with pytest.raises(files.MissingExtra):
        files.extract(files.find_files(spark, [str(tmp_path)]))
    assert "4" in [r.text for r in files.extract(files.find_files(spark, [str(tmp_path)]), lambda b: str(len(b))).collect()]


def test_preparation_is_refused_before_it_writes(spark, tmp_path):
    (tmp_path / "one.txt").write_text(" ".join(f"Sentence number {i} of the first book is long enough to be compared." for i in range(40)))
    (tmp_path / "two.txt").write_text(" ".join(f"Sentence number {i} of the second book is long enough to be compared." for i in range(40)))
    docs, report = prepare.prepare_documents(spark, [str(tmp_path)], split_chars=600)
    assert report["missing"] == 0 and report["n_documents"] == docs.count() > 4
    with pytest.raises(prepare.PreparationRefused):
        prepare.prepare_documents(spark, [str(tmp_path)], split_chars=499)
    with pytest.raises(prepare.PreparationRefused, match="in .*(one|two)"):
        prepare.prepare_documents(spark, [str(tmp_path)], existing=docs.select(F.col("path").alias("name"), "text"))
    (tmp_path / "zcopy.txt").write_text((tmp_path / "one.txt").read_text())
    with pytest.raises(prepare.PreparationRefused):
        prepare.prepare_documents(spark, [str(tmp_path)])


def test_all_inputs_shared_in_part_are_reported(spark, monkeypatch):
    n = 1100
    own = [(f"p{i:04}", " ".join(f"Sentence number {j} of the book {i} is long enough to be compared with others." for j in range(3))) for i in range(n)]
    texts = [(p, t + " The sentence that every one of the many books repeats at its end stands here.") for p, t in own]
    monkeypatch.setattr(prepare, "find_files", lambda s, inputs: inputs)
    monkeypatch.setattr(prepare, "extract", lambda found, converter: spark.createDataFrame(texts, "path string, text string"))
    docs, report = prepare.prepare_documents(spark, [], min_length=1)
    shares = {r["path"]: r["share"] for r in report["shared"].collect()}
    assert docs.count() == n and set(shares) == {p for p, _ in texts[1:]} and all(0 < s < 0.5 for s in shares.values())


def test_corpus_and_pairs_are_read(spark, tmp_path):
    (tmp_path / "a.md").write_text("whole")
    (tmp_path / "b.jsonl").write_text('{"text": "t1"}\n\n{"text": 5, "content": "t2"}\n{"text": ""}\n{"prompt": "p", "response": "r"}\nbroken\n')
    (tmp_path / "c.json").write_text('[{"body": "e1"}, {"document": "e2"}]')
    (tmp_path / "d.json").write_text('{"passage": "e3"}')
    assert sorted(r.text for r in files.read_corpus(spark, str(tmp_path)).collect()) == ["e1", "e2", "e3", "p\nr", "t1", "t2", "whole"]
    (tmp_path / "pairs.jsonl").write_text('{"prompt": "p", "response": "r"}\n\n{"prompt": " "}\n{"prompt": "q"}\n')
    assert [(r.prompt, r.response) for r in files.read_pairs(spark, str(tmp_path / "pairs.jsonl")).orderBy("path", "block", "line").collect()] == [("p", "r"), ("q", "")]
    with pytest.raises(files.SourceUnavailable):
        files.load_source(spark, lambda s, p: 1 / 0, "x")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "stem string, o int, text string")
    path = str(tmp_path / "docs")
    sinks.write_documents(df, path, "stem", "o")
    out = sinks.write_documents(df, path, "stem", "o")
    assert sorted(r.name for r in out.collect()) == ["a", "a_1", "a_2", "a_3"]
    stats = sinks.write_json_lines(df.withColumn("source", F.lit("s")), str(tmp_path / "j"))
    assert stats["s"]["n_rows"] == 2 and spark.read.json(str(tmp_path / "j" / "rows")).count() == 2
    for _ in range(2):
        sinks.write_batch(df, str(tmp_path / "b"), 0)
    sinks.write_batch(df, str(tmp_path / "b"), 1)
    assert spark.read.parquet(str(tmp_path / "b")).count() == 4
    sinks.write_artifact(df, str(tmp_path / "art"), {"version": 1, "built_with": "lodestone"})
    assert files.read_artifact(spark, str(tmp_path / "art")).count() == 2


def test_a_failed_read_is_not_an_empty_folder(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "x")], "stem string, o int, text string")
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception, match="(?i)parquet|footer|file"):
        sinks.write_documents(df, str(tmp_path / "bad"), "stem", "o")
    assert sinks.if_written(lambda: spark.read.parquet(str(tmp_path / "none"))) is None


def test_a_cluster_must_name_its_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        lineage.shared_folder(Session())
    Session.conf = {"spark.checkpoint.dir": "hdfs://shared"}
    assert lineage.shared_folder(Session()) == "hdfs://shared"


def test_supplement_and_generated_corpus_with_injected_writers(spark):
    docs = spark.createDataFrame([(1, "para one " * 40), (2, "tiny")], "doc long, text string")
    ask = lambda ps: ['["What is it?", "What is it?", "What does the passage say?"]' for _ in ps]
    reply = lambda ps, qs: ["It is a long enough answer to be kept in the supplement.<|im_end|>" for _ in qs]
    pairs, rejected = prepare.supplement(docs, "doc", ask, reply, ["<|im_end|>"])
    assert [r.prompt for r in pairs.collect()] == ["What is it?"]
    assert sorted(r.reason for r in rejected.collect()) == ["duplicate", "refers_to_source"]
    kept, tally = prepare.generated_share(spark, lambda ids: ["good text " * 30 if i % 2 else "" for i in ids], 10, ["<end>"], min_chars=50, max_repeat=1.0)
    assert kept.count() == 5 and tally == {"kept": 5, "rejected": 5}
