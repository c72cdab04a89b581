import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions.seeded import order_key
from lodestone.operators import checks, corpora, metrics, mixture, ranking, sampling, vectors
from lodestone.sources import files, sinks, store, tables
from lodestone.streaming.fold import fold_moments, folded


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(1, 2, (300, 4)), rng.normal(-3, 0.5, (100, 4))])
    rows = [(i, i % 2, [float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame([*rows, (999, 0, None)], "id long, site int, v array<double>"), x


def test_moments_and_covariance(spark, cloud):
    df, x = cloud
    for r in vectors.moments(df.repartition(5), "site", "v").collect():
        own = x[r.site :: 2]
        assert r.n == len(own)
        np.testing.assert_allclose(r["mean"], own.mean(0), atol=1e-12)
        np.testing.assert_allclose(r["std"], np.sqrt(own.var(0, ddof=1) + 1e-10), atol=1e-12)
    for r in vectors.covariance_rows(df.repartition(5), "site", "v").collect():
        np.testing.assert_allclose(r["cov"], np.cov(x[r.site :: 2].T, ddof=0)[r.i], atol=1e-12)
    assert vectors.moments(df.limit(0), "site", "v").count() == 0
    assert vectors.moments(df.filter("id = 3"), "site", "v").first()["std"] is None


def test_merge_is_that_of_the_pool(spark, cloud):
    df, x = cloud
    parts = []
    for part in ("id < 150", "id >= 150 and id <> 999"):
        m = vectors.moments(df.filter(part), "site", "v")
        parts.append(m.select("site", F.col("n"), "mean", F.transform("m2", lambda s: s / F.col("n")).alias("var")))
    for r in mixture.merge_moments(*parts, "site").collect():
        own = x[r.site :: 2]
        assert r.n == len(own)
        np.testing.assert_allclose(r["mean"], own.mean(0), atol=1e-12)
        np.testing.assert_allclose(r["var"], own.var(0), atol=1e-12)
    alone = mixture.merge_moments(parts[0], parts[1].limit(0), "site")
    assert {r.site: r.n for r in alone.collect()} == {0: 75, 1: 75}


def test_axes_span_the_variance(spark, cloud):
    df, x = cloud
    for r in vectors.principal_axes(vectors.covariance_rows(df, "site", "v"), "site").collect():
        values = np.linalg.eigvalsh(np.cov(x[r.site :: 2].T, ddof=0))[::-1]
        np.testing.assert_allclose(r.eigenvalues, values, atol=1e-9)
        basis = np.array(r.components)
        np.testing.assert_allclose(basis.T @ basis, np.eye(r.n_components), atol=1e-9)


def test_mixture_finds_two_clouds():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, (400, 3)), rng.normal(8, 0.5, (200, 3))])
    m = vectors.DiagonalMixture(2, seed=1).fit(x)
    order = np.argsort(m.means[:, 0])
    np.testing.assert_allclose(m.weights[order], [2 / 3, 1 / 3], atol=0.02)
    np.testing.assert_allclose(m.means[order][:, 0], [0, 8], atol=0.2)
    assert m.bic(x) < vectors.DiagonalMixture(1, seed=1).fit(x).bic(x)
    with pytest.raises(ValueError):
        vectors.DiagonalMixture(5).fit(x[:3])


def test_sites_are_fitted_extended_and_drawn_from(spark, cloud):
    df, x = cloud
    base = vectors.fit_sites(df.filter("id < 300"), "site", "id", "v", k=3).cache()
    added = mixture.domain_mixtures(df.filter("id >= 300 and id <> 999"), base, "site", "id", "v")
    merged = mixture.merge_artifacts(base, added, "site").orderBy("site").collect()
    assert [r.gmm_n_components for r in merged] == [4, 4] and [r.n_samples for r in merged] == [200, 200]
    assert all(abs(sum(r.gmm_weights) - 1) < 1e-9 and abs(r.gmm_weights[-1] - 0.25) < 1e-9 for r in merged)
    for level in ("gmm", "pca", "diagonal"):
        draws = sampling.sample_sites(base, "site", 5000, level=level)
        got = np.array(draws.filter("site = 0").toPandas().v.tolist())
        assert len(got) == 5000
        np.testing.assert_allclose(got.mean(0), x[:300][0::2].mean(0), atol=0.25)
        np.testing.assert_allclose(got.std(0), x[:300][0::2].std(0), rtol=0.15)
        again = sampling.sample_sites(base.repartition(3), "site", 5000, level=level).filter("site = 0").toPandas()
        np.testing.assert_allclose(np.array(again.sort_values("draw").v.tolist()), np.array(draws.filter("site = 0").toPandas().sort_values("draw").v.tolist()))
    assert sampling.sample_sites(base.select("site", F.lit(None).cast("array<double>").alias("mean"), F.lit(None).cast("array<double>").alias("std")), "site", 5).count() == 0


def test_a_domain_is_counted_whole_whatever_its_reservoir(spark, cloud):
    df, x = cloud
    base = vectors.fit_sites(df.filter("id < 300"), "site", "id", "v", k=3).cache()
    domain = df.filter("id >= 300 and id <> 999")
    added = mixture.domain_mixtures(domain, base, "site", "id", "v", size=20).orderBy("site").collect()
    for r in added:
        v = np.array(domain.filter(F.col("site") == r.site).toPandas().v.tolist())
        assert r.n_samples == len(v) == 50
        np.testing.assert_allclose(r["mean"], v.mean(0))
        np.testing.assert_allclose(r["std"], v.std(0, ddof=1))


def test_reservoir_and_permutation_keep_what_they_must(spark, cloud):
    df, _ = cloud
    a = {r.id for r in vectors.reservoir(df, "site", "id", 10).collect()}
    assert len(a) == 20 and a == {r.id for r in vectors.reservoir(df.repartition(9), "site", "id", 10).collect()}
    clean = df.filter("id <> 999")
    out = sampling.decorrelated(clean, "site", "id", "v").toPandas()
    before = clean.select("site", "id", F.posexplode("v").alias("d", "x")).toPandas()
    for key, part in out.groupby(["site", "d"]):
        same = before[(before.site == key[0]) & (before.d == key[1])]
        assert sorted(part.x) == sorted(same.x) and sorted(part.id) == sorted(same.id)
    assert sampling.first_per_site(clean, "site", "id", 3).count() == 6
    iso = sampling.isotropic_moments(clean, "site", "v").first()
    assert iso.n == 200 and iso.sigma > 0


@pytest.mark.parametrize("n", [20, 1001, 200_000])
def test_no_task_takes_a_whole_group_however_large_the_reservoir(spark, n):
    """A hot site of 250,000 vectors: the window is over buckets of it, and only those that hold the first n are kept."""
    df = spark.range(260_000).select("id", (F.col("id") % 26 == 0).cast("int").alias("site"))
    out = vectors.reservoir(df, "site", "id", n, seed=1)
    assert "windowspecdefinition(site" in (plan := out._jdf.queryExecution().toString()) and "windowspecdefinition(site#" in plan and "_bucket" in plan
    got = out.groupBy("site").agg(F.count("*").alias("c"), F.max("place").alias("m"), F.count_distinct("place").alias("d")).collect()
    assert {r.site: (r.c, r.m, r.d) for r in got} == {0: (min(n, 250_000),) * 3, 1: (min(n, 10_000),) * 3}
    key = order_key(1, "reservoir", F.col("site"), F.col("id"))
    want = [r.id for r in df.filter("site = 1").orderBy(key, "id").limit(50).collect()]
    assert [r.id for r in out.filter("site = 1 and place <= 50").orderBy("place").collect()] == want[: min(n, 50)]


def test_first_rows_of_each_group(spark):
    rows = [(i, g, f"k{i % 17:02}{i:05}") for i, g in enumerate([None] * 30 + ["a"] * 500 + ["b"] * 3)]
    df = spark.createDataFrame(rows, "id long, g string, o string").withColumn("n", F.when(F.col("g") == "a", 40).otherwise(2))
    got = {(r.g, r.place): r.o for r in ranking.first_of_each(df.repartition(6), "g", F.col("n"), order="o").collect()}
    want = {}
    for g, n in ((None, 2), ("a", 40), ("b", 2)):
        want |= {(g, k): o for k, o in enumerate(sorted(o for _, h, o in rows if h == g)[:n], 1)}
    assert got == want
    assert ranking.first_of_each(df.limit(0), "g", 3, order="id").count() == 0


def test_partial_results_of_many_tasks_merge_on_two_levels(spark, monkeypatch):
    monkeypatch.setattr(vectors, "MERGE_GROUPS", 3)
    x = np.random.default_rng(5).normal(4, 2, (200, 3))
    df = spark.createDataFrame([(i, None if i % 4 else "s", r.tolist()) for i, r in enumerate(x)], "id long, site string, v array<double>").repartition(23)
    for r in vectors.moments(df, "site", "v").collect():
        own = x[::4] if r.site else x[[i for i in range(200) if i % 4]]
        assert r.n == len(own) and np.allclose(r["mean"], own.mean(0)) and np.allclose(r.std, np.sqrt(own.var(0, ddof=1) + 1e-10))
    cov = {(r.site, r.i): r["cov"] for r in vectors.covariance_rows(df, "site", "v").collect()}
    assert np.allclose([cov["s", i] for i in range(3)], np.cov(x[::4].T, bias=True))


def test_covariance_of_more_rows_than_a_block(spark):
    width = vectors.BLOCK_ROWS + 7
    x = np.random.default_rng(6).normal(size=(90, width))
    df = spark.createDataFrame([(i, "s", r.tolist()) for i, r in enumerate(x)], "id long, site string, v array<double>").repartition(5)
    got = {r.i: (r.n, r["cov"]) for r in vectors.covariance_rows(df, "site", "v").collect()}
    assert sorted(got) == list(range(width)) and np.allclose([got[i][1] for i in range(width)], np.cov(x.T, bias=True)) and {n for n, _ in got.values()} == {90}
    assert vectors.covariance_rows(df.limit(0), "site", "v").count() == 0


def test_draws_from_a_table_and_isotropic_controls(spark):
    table = spark.createDataFrame([(1, [1.0, 0.0], 3), (2, [0.0, 2.0], 1), (3, [9.0, 9.0], 0), (4, [8.0, 8.0], None)], "item long, v array<double>, w int")
    drawn = sampling.sample_lookup(table, "item", "v", 2000, weight="w").toPandas()
    assert len(drawn) == 2000 and set(drawn.item) == {1, 2} and abs((drawn.item == 1).mean() - 0.75) < 0.05
    assert all(list(v) == ([1.0, 0.0] if i == 1 else [0.0, 2.0]) for i, v in zip(drawn.item, drawn.v))
    assert set(sampling.sample_lookup(table, "item", "v", 200).toPandas().item) == {1, 2, 3, 4}
    assert sampling.sample_lookup(table.limit(0), "item", "v", 5).count() == 0
    control = sampling.isotropic_moments(table.withColumn("site", F.lit("s")), "site", "v", "w")
    r = control.first()
    assert np.allclose(r["mean"], [0.75, 0.5]) and np.isclose(r.sigma, np.sqrt((0.1875 + 0.75) / 2))
    x = np.stack(sampling.sample_isotropic(control, "site", 3000).toPandas().v)
    assert np.allclose(x.mean(0), [0.75, 0.5], atol=0.06) and np.allclose(x.std(0), r.sigma, atol=0.05)
    unit = np.stack(sampling.sample_isotropic(control, "site", 3000, mode="unit").toPandas().v)
    assert np.allclose(unit.mean(0), 0, atol=0.08) and np.allclose(unit.std(0), 1, atol=0.06)
    with pytest.raises(ValueError):
        sampling.sample_isotropic(control, "site", 3, mode="other")
    stats = spark.createDataFrame([("s", [0.0, 0.0], [1.0, 1.0]), ("t", [5.0, 5.0], [0.1, 0.1]), ("u", None, None)], "site string, mean array<double>, std array<double>")
    best = sampling.sample_best(stats, "site", 50, lookup=table, lookup_site="s", weight="w").toPandas()
    assert best.groupby("site").rung.unique().map(list).to_dict() == {"s": ["lookup"], "t": ["diagonal"]} and (best.site == "s").sum() == 50


def test_statistics_are_stored_compactly_and_checked(spark, tmp_path):
    rng = np.random.default_rng(4)
    axes = rng.normal(size=(9, 3))
    sites = spark.createDataFrame([("a", [0.5] * 9, axes.tolist(), [[1.0, 2.0]]), ("b", [0.5] * 9, None, [])], "site string, mean array<double>, pca_components array<array<double>>, gmm_means array<array<double>>")
    path = str(tmp_path / "int8")
    sinks.write_artifact(sites, path, checks.make_meta("m", 9, 1, ["a", "b"], 7), int8=True)
    back = {r.site: r for r in files.read_artifact(spark, path).collect()}
    assert np.abs(np.array(back["a"].pca_components) - axes).max() < 0.02 * np.abs(axes).max() and back["a"]["mean"] == [0.5] * 9
    assert back["b"].pca_components is None and back["b"].gmm_means == [] and np.allclose(back["a"].gmm_means, [[1, 2]], atol=0.02)
    assert dict(spark.read.parquet(f"{path}/sites").dtypes)["pca_components"].startswith("struct")
    sinks.write_artifact(sites, str(tmp_path / "other"), {"built_with": "another"})
    with pytest.raises(checks.ForeignArtifact):
        files.read_artifact(spark, str(tmp_path / "other"))
    with pytest.raises(files.SourceUnavailable):
        files.read_artifact(spark, str(tmp_path / "none"))


def test_reading_stops_when_every_site_has_enough(spark):
    df = spark.createDataFrame([(i, "ab"[i % 3 == 0], i // 10) for i in range(100)], "id long, site string, batch long")
    assert vectors.until_enough(df, "site", "batch", 9).agg(F.max("batch")).first()[0] == 2  # 10 of the rarer in 30
    assert vectors.until_enough(df, "site", "batch", 1000).count() == 100
    assert vectors.until_enough(df.limit(0), "site", "batch", 1).count() == 0


def test_reports_and_records(spark):
    t = spark.createDataFrame([("long label", 1.25, None), (None, 12345.678, 2.0)], "name string, a double, other double")
    lines = [r.text for r in metrics.markdown_table(t, "name", ["a", "other"]).orderBy("line").collect()]
    assert lines == ["|            |        a | other |", "| ---------- | -------- | ----- |", "|            | 12345.68 |  2.00 |", "| long label |     1.25 |       |"]
    assert metrics.markdown_table(t.limit(0), "name", ["a"]).count() == 2
    own = spark.createDataFrame([("x", "s1"), ("x", "s1"), ("y", "s2"), (None, "s3")], "side string, source string")
    got = {tuple(r) for r in corpora.composition_differences(own, recorded={"x": {"s1": 2}, "y": {"s2": 3}, "z": {"s9": 1}}).collect()}
    assert got == {("y", "s2", 1, 3), (None, "s3", 1, 0), ("z", "s9", 0, 1)}
    before = spark.createDataFrame([(1, 0, [1.0, 2.0]), (2, 1, [0.0, 0.0]), (3, 1, [9.0])], "id long, layer long, w array<double>")
    after = spark.createDataFrame([(1, 0, [1.0, 4.0]), (2, 1, [3.0, 4.0])], "id long, layer long, w array<double>")
    loss = metrics.weight_loss(before.drop("layer"), after, ["id"], "w", "layer", spark.createDataFrame([(0, 0.25), (1, 2.0)], "layer long, weight double"))
    assert loss.first().loss == 0.25 * 4 + 2 * 25


def test_ledgers_are_appended_whole_and_resumed(tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    ledger = store.Ledger(str(tmp_path / "l"))
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(lambda i: ledger.append("a", {"i": i}), range(40)))
    assert sorted(r["run"] for r in ledger.runs()) == sorted(["a", *(f"a_{k}" for k in range(2, 41))])
    ran, book = [], store.Ledger(str(tmp_path / "m"))
    known = {"one": lambda x=0: ran.append(("one", x)) or {}, "two": lambda: ran.append("two") or {}}
    store.run_chain([{"stage": "one", "options": {"x": 1}}], known, book)
    steps = [{"stage": "one", "options": {"x": 1}}, {"stage": "two"}]
    assert [r["run"] for r in store.run_chain(steps, known, book, resume=True)] == ["one", "two"] and ran == [("one", 1), "two"]
    assert len(store.run_chain(steps, known, book, resume=True)) == 2 and len(ran) == 2
    for other in ([{"stage": "one", "options": {"x": 2}}, {"stage": "two"}], steps[:1], steps[::-1]):
        with pytest.raises(store.ResumeRefused):
            store.run_chain(other, known, book, resume=True)
    assert len(ran) == 2


def test_small_scans_are_spread(spark, tmp_path):
    spark.range(1000).withColumn("t", F.lit("x")).coalesce(1).write.parquet(str(tmp_path / "one.parquet"))
    wide = tables.read_table(spark, str(tmp_path), "one")
    assert "REPARTITION_BY_NUM" in wide._jdf.queryExecution().toString() and wide.count() == 1000
    kept = wide.filter("id < 5").select("id")
    assert "GreaterThan" in (p := kept._jdf.queryExecution().toString()) or "LessThan" in p
    behind = wide.groupBy("t").count()
    assert tables.spread(behind) is behind


def test_categorical_draws_follow_the_weights(spark):
    w = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 0.0), ("d", None)], "item string, w double")
    got = {r.item: r["count"] for r in sampling.sample_categorical(w, "item", "w", 4000).groupBy("item").count().collect()}
    assert set(got) == {"a", "b"} and sum(got.values()) == 4000 and abs(got["a"] - 1000) < 120


def test_quantized_vectors_come_back(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 3, (20, 100)).astype(np.float32)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(99, [0.0] * 100), (98, [])], "id long, v array<float>")
    q = mixture.quantize(df, "id", "v").cache()
    back = {r.id: r.v for r in q.select("id", mixture.dequantize(F.col("blocks"), F.col("numel")).alias("v")).collect()}
    err = np.linalg.norm(np.array([back[i] for i in range(20)]) - x) / np.linalg.norm(x)
    assert err < 0.02 and back[99] == [0.0] * 100 and back[98] == []
    for r in q.filter("id < 20").collect():
        for b, block in enumerate(r.blocks):
            own = np.pad(x[r.id], (0, 28))[b * 64 : b * 64 + 64]
            scale = np.float32(max(np.abs(own).max() / np.float32(127), 1e-12))
            assert [int(v) for v in block.q] == np.clip(np.round(own / scale), -127, 127).astype(int).tolist()
            assert np.float16(scale) == np.float16(block.scale)


def test_curves(spark):
    rows = [("f", 1, 3.0), ("f", 2, 2.0), ("t", 1, 2.0), ("t", 2, 2.0), ("t", 3, 2.3), ("d", 1, 2.0), ("d", 2, float("inf")), ("n", 1, None), ("o", 1, 2.0), ("o", 2, 2.01), ("l", 1, 2.0), ("l", 2, 2.1), ("z", 1, float("nan"))]
    got = {r.run: (r.best_epoch, r.verdict, r.advice) for r in metrics.curve_verdict(spark.createDataFrame(rows, "run string, e int, m double"), "run", "e", "m").collect()}
    assert got == {"f": (2, "still_falling", "none"), "t": (1, "turned", "warn"), "d": (1, "diverged", "none"), "n": (None, "no_curve", "none"), "o": (1, "turned", "optional"), "l": (1, "turned", "likely"), "z": (None, "diverged", "none")}


def test_schedules_and_tables(spark):
    w = [round(r.weight, 4) for r in metrics.layer_weights(spark, 4, 0.1).orderBy("layer").collect()]
    assert w == [0.3774, 0.3276, 0.2075, 0.0875]
    rates = [r.rate for r in metrics.learning_rates(spark, 100, 1.0, warmup=10).orderBy("step").collect()]
    assert rates[0] == pytest.approx(0.1) and rates[10] == pytest.approx(1.0) and rates[-1] < 0.01
    t = metrics.perplexity_table(spark.createDataFrame([("a", "before", 10.0), ("a", "after", 9.0), ("b", "after", 1.0)], "axis string, stage string, v double"), "axis", "stage", "v", ["before", "after"])
    assert sorted((r.axis, r.before, r.after, r.after_delta_pct) for r in t.collect()) == [("a", 10.0, 9.0, -10.0), ("b", None, 1.0, None)]
    p = spark.createDataFrame([("x", 1.0, 10), ("x", 3.0, 30), ("y", 1.0, 0)], "g string, nll double, n int").groupBy("g").agg(metrics.perplexity(F.col("nll"), F.col("n")).alias("p"))
    assert {r.g: r.p for r in p.collect()} == {"x": pytest.approx(np.exp(2.5)), "y": float("inf")}
    ls = metrics.level_shape(spark.createDataFrame([("u", 2.0), ("u", 2.0), ("s", 1e-9), ("n", None)], "c string, r double"), ["c"], "r")
    assert {r.c: (round(r.level, 6), r.shape) for r in ls.collect()} == {"u": (2.0, 0.0), "s": (0.001, 0.0)}
    price = metrics.site_price(spark.createDataFrame([("s", [1.0, 2.0])], "site string, v array<double>"), "site", "v", [[1, 0], [0, 3]]).first().price
    assert price == 37.0


def test_ledger_rows(spark):
    rows = [("s", "r1", 1, 4), ("s", "r2", 2, 4), ("s", "r3", 3, None), ("t", "r4", 4, 4)]
    got = {r.run: r.rerun_of for r in metrics.earlier_turn(spark.createDataFrame(rows, "stage string, run string, at int, e int"), "stage", "run", "at", "e").collect()}
    assert got == {"r1": None, "r2": "r1", "r3": None, "r4": None}
    m = spark.createDataFrame([("a", None), ("b", 1)], "x string, y int")
    assert [r.x for r in metrics.reusable(m, spark.createDataFrame([("a", None)], "x string, y int"), ["x", "y"]).collect()] == ["a"]


def test_store_builds_once_and_cleans_up(tmp_path):
    s = store.ResultStore(str(tmp_path / "store"))
    built = []
    entry, reused = s.obtain("Org/Model", {"seed": 1}, lambda d: built.append(d) or {"n": 1})
    assert not reused and s.obtain("Org/Model", {"seed": 1}, lambda d: 1 / 0) == (entry, True) and len(built) == 1
    with pytest.raises(ZeroDivisionError):
        s.obtain("Org/Model", {"seed": 2}, lambda d: 1 / 0)
    assert [e["state"] for e in s.entries()] == ["complete"]
    lock = s.entry("Org/Model", {"seed": 3}) + ".lock"
    import os
    import socket

    with open(lock, "w") as f:
        f.write(f"{socket.gethostname()}:{os.getpid()}")
    with pytest.raises(store.StoreLocked):
        s.obtain("Org/Model", {"seed": 3}, lambda d: {})
    with open(lock, "w") as f:
        f.write(f"{socket.gethostname()}:999999999")
    assert s.obtain("Org/Model", {"seed": 3}, lambda d: {})[1] is False
    ledger = store.Ledger(str(tmp_path / "ledger"))
    runs = store.run_chain([{"stage": "train"}, {"stage": "train", "options": {"x": 2}}], {"train": lambda x=1: {"x": x}}, ledger)
    assert [(r["run"], r["x"]) for r in runs] == [("train", 1), ("train_2", 2)] and len(ledger.runs()) == 2
    with pytest.raises(ValueError):
        store.run_chain([{"stage": "train"}, {"stage": "other"}], {"train": dict}, ledger)
    assert len(ledger.runs()) == 2


def test_stream_folds_to_the_batch_result(spark, cloud, tmp_path):
    df, x = cloud
    clean = df.filter("id <> 999")
    for i in range(3):
        clean.filter(F.col("id") % 3 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(clean.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    fold_moments(stream, "site", "v", str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination()
    for r in folded(spark, str(tmp_path / "state")).collect():
        own = x[r.site :: 2][:, r.d]
        assert r.n == len(own) and abs(r["mean"] - own.mean()) < 1e-9 and abs(r["std"] - own.std(ddof=1)) < 1e-6


def test_generated_corpus_goes_on_where_it_stopped(spark, tmp_path):
    from lodestone.plans import prepare

    path, fail = str(tmp_path / "corpus"), {"at": 2}
    text = "one two three four five six seven eight nine ten " * 6

    def generate(ids):
        return [text + str(i) if i % 10 else "" for i in ids]

    def breaking(ids):
        if min(ids, default=0) >= 32:
            raise RuntimeError("stopped")
        return generate(ids)

    with pytest.raises(Exception, match="stopped"):
        prepare.write_generated_corpus(spark, breaking, path, 60, [], batch=16, min_docs=5, max_repeat=1.0)
    before = spark.read.parquet(path).count()
    got = prepare.write_generated_corpus(spark, generate, path, 60, [], batch=16, min_docs=5, max_repeat=1.0)
    assert before == 32 and got["kept"] >= 60 and got["batches"] == 5 and fail
    out = prepare.read_generated_corpus(spark, path, 60).collect()
    assert len(out) == 60 and [r.draw for r in out] == [i for i in range(80) if i % 10][:60]
    with pytest.raises(prepare.DegenerateCorpus):
        prepare.write_generated_corpus(spark, lambda ids: ["" for _ in ids], str(tmp_path / "bad"), 40, [], batch=16)
    with pytest.raises(prepare.DegenerateCorpus):
        prepare.write_generated_corpus(spark, generate, str(tmp_path / "few"), 10, [], batch=16, max_repeat=1.0)


def test_settings_and_checks(spark, tmp_path):
    import json

    from lodestone.operators import checks

    p = tmp_path / "s.json"
    p.write_text(json.dumps({"name": "n", "model_id": "m", "frame": {"k": 1}}))
    s = checks.Settings.load(str(p))
    assert s.stage_lambdas(1) == (160_000.0, 160_000.0) and s.stage_lambdas(3) == (480_000.0, 480_000.0)
    assert s.warnings(32, {"k": 1}) == [] and len(s.warnings(16, {"k": 2, "j": 1})) == 3
    for bad in ({"name": "n"}, {"name": "n", "model_id": "m", "other": 1}, {"name": "n", "model_id": "m", "epochs": 0}, {"name": "n", "model_id": "m", "val_fraction": 1.0}):
        p.write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            checks.Settings.load(str(p))
    meta = checks.make_meta("m", 4, 2, ["a"], 10)
    assert checks.require_own(meta) is meta
    for foreign in ({}, {**meta, "built_with": "other"}, {**meta, "format_version": 9}):
        with pytest.raises(checks.ForeignArtifact):
            checks.require_own(foreign)


def test_gated_unit_change(spark):
    rng = np.random.default_rng(4)
    x, g, u, d = rng.normal(size=(6, 3)), rng.normal(size=(5, 3)), rng.normal(size=(5, 3)), rng.normal(size=(2, 5))
    dg, du, dd = rng.normal(size=(5, 3)) * 0.1, rng.normal(size=(5, 3)) * 0.1, rng.normal(size=(2, 5)) * 0.1
    silu = lambda z: z / (1 + np.exp(-z))
    full = (silu(x @ (g + dg).T) * (x @ (u + du).T)) @ (d + dd).T - (silu(x @ g.T) * (x @ u.T)) @ d.T
    np.testing.assert_allclose(vectors.swiglu_change(x, g, u, d, dg, du, dd), full, atol=1e-12)
    df = spark.createDataFrame([("s", r.tolist()) for r in x], "site string, v array<double>")
    price = vectors.swiglu_price(df, "site", "v", {"gate": g, "up": u, "down": d, "d_gate": dg, "d_up": du, "d_down": dd}).first().price
    assert price == pytest.approx((full**2).sum(1).mean())
    assert vectors.layer_group_size(1024, 2048, 28, 200_000, 2, None) == 7 and vectors.layer_group_size(1024, 2048, 28, 200_000, 2, 1) == 1


def test_command_line(spark, tmp_path, capsys):
    from lodestone import cli

    (tmp_path / "book.txt").write_text("\n\n".join(f"Paragraph {i} of the book is here, and it is long enough to be counted as text." for i in range(60)))
    out = str(tmp_path / "out")
    assert cli.main(["prepare-domain", str(tmp_path / "book.txt"), "--out", out, "--split-chars", "600"]) == 0
    assert cli.main(["prepare-domain", str(tmp_path / "book.txt"), "--out", out, "--split-chars", "600", "--existing"]) == 2
    assert cli.main(["prepare-domain", str(tmp_path / "book.txt"), "--out", out, "--split-chars", "10"]) == 2
    assert cli.main(["train"]) == 2
    rng = np.random.default_rng(0)
    spark.createDataFrame([(i, "s", rng.normal(size=3).tolist()) for i in range(60)], "vec_id long, site string, v array<double>").write.parquet(str(tmp_path / "v"))
    assert cli.main(["build-artifact", "--vectors", str(tmp_path / "v"), "--out", str(tmp_path / "a"), "--model", "m", "--components", "2", "--int8"]) == 0
    assert {k: v for k, v in files.read_meta(spark, str(tmp_path / "a")).items() if k in ("hidden_size", "sites", "n_samples_total")} == {"hidden_size": 3, "sites": ["s"], "n_samples_total": 60}
    assert cli.main(["extend", "--artifact", str(tmp_path / "a"), "--vectors", str(tmp_path / "v"), "--out", str(tmp_path / "b"), "--name", "d"]) == 0
    assert cli.main(["extend", "--artifact", str(tmp_path / "b"), "--vectors", str(tmp_path / "v"), "--out", str(tmp_path / "c"), "--name", "d"]) == 2  # folded in already
    (tmp_path / "scores.json").write_text('{"axis": "a", "stage": "before", "value": 10.0}\n{"axis": "a", "stage": "after", "value": 9.0}\n')
    capsys.readouterr()
    assert cli.main(["evaluate", "--scores", str(tmp_path / "scores.json")]) == 0
    assert '"after_delta_pct": -10.0' in capsys.readouterr().out
    (tmp_path / "spec.json").write_text('[{"stage": "nothing"}]')
    assert cli.main(["chain", str(tmp_path / "spec.json"), "--ledger", str(tmp_path / "l")]) == 2
    (tmp_path / "spec.json").write_text('[{"stage": "evaluate", "options": {"scores": "' + str(tmp_path / "scores.json") + '"}}]')
    assert cli.main(["chain", str(tmp_path / "spec.json"), "--ledger", str(tmp_path / "l")]) == 0 == cli.main(["chain", str(tmp_path / "spec.json"), "--ledger", str(tmp_path / "l"), "--resume"])
    (tmp_path / "spec.json").write_text('[{"stage": "evaluate", "options": {"score": "x"}}]')
    assert cli.main(["chain", str(tmp_path / "spec.json"), "--ledger", str(tmp_path / "l")]) == 2
    assert cli.main(["list-artifacts", "--root", str(tmp_path)]) == 0
