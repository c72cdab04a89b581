"""Queries over vectors, curves and ledgers, each with the SQL that must give the same rows."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import metrics, mixture, sampling, vectors
from lodestone.operators.lineage import shared_folder
from lodestone.streaming.fold import fold_moments, fold_reservoir, folded, folded_reservoir

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sha(purpose: str, ident: str, seed: int = 42) -> str:
    return f"sha256('{seed}:{purpose}:' || {ident})"


def _uniform(purpose: str, ident: str) -> str:
    return f"((('0x' || substring({_sha(purpose, ident)}, 1, 12))::bigint)::double + 0.5::double) / 281474976710656.0::double"


_LONG = "(select vec_id, label, unnest(range(64)) as d, unnest(embedding)::double as x from embeddings)"


@query(f"select label, d::int as d, count(*) as n, round(avg(x), 6) as mean, round(sqrt(var_samp(x) + 1e-10), 6) as std from {_LONG} group by label, d")
def vector_moments(spark, d):
    m = vectors.moments(table(spark, d, "embeddings"), "label", "embedding")
    flat = m.select("label", "n", F.posexplode(F.arrays_zip("mean", "std")).alias("d", "v"))
    return flat.select("label", "d", "n", F.round("v.mean", 6).alias("mean"), F.round("v.std", 6).alias("std"))


@query(f"select label, round(sum(v), 6) as trace from (select label, d, var_pop(x) as v from {_LONG} group by label, d) group by label")
def vector_covariance_trace(spark, d):
    rows = vectors.covariance_rows(table(spark, d, "embeddings"), "label", "embedding")
    return rows.groupBy("label").agg(F.round(F.sum(F.element_at("cov", F.col("i") + 1)), 6).alias("trace"))


@query(f"select a.label, a.d::int as i, b.d::int as j, round(covar_pop(a.x, b.x), 6) + 0.0 as cov from {_LONG} a join {_LONG} b on a.vec_id = b.vec_id and a.label = b.label  group by all")
def vector_covariance_pairs(spark, d):
    rows = vectors.covariance_rows(table(spark, d, "embeddings"), "label", "embedding")
    return rows.select("label", "i", F.posexplode("cov").alias("j", "c")).select("label", "i", "j", (F.round("c", 6) + 0.0).alias("cov"))


def _parts(spark, d) -> tuple[DataFrame, DataFrame]:
    """Moments of two halves of the vectors, with population variances."""
    v = table(spark, d, "embeddings")
    out = []
    for half in (0, 1):
        m = vectors.moments(v.filter(F.pmod("vec_id", F.lit(2)) == half), "label", "embedding")
        out.append(m.select("label", "n", "mean", F.transform("m2", lambda x: x / F.col("n")).alias("var")))
    return out[0], out[1]


@query(f"select label, d::int as d, count(*) as n, round(avg(x), 6) as mean, round(var_pop(x), 6) as var from {_LONG} group by label, d")
def moment_merge_exact(spark, d):
    merged = mixture.merge_moments(*_parts(spark, d), "label")
    flat = merged.select("label", "n", F.posexplode(F.arrays_zip("mean", "var")).alias("d", "v"))
    return flat.select("label", "d", "n", F.round("v.mean", 6).alias("mean"), F.round("v.var", 6).alias("var"))


@query("""with c as (select label, count(*)::double as n from embeddings group by label), t as (select sum(n) filter (where label < 5) as a, sum(n) filter (where label >= 5) as b from c)
  select label, round(case when label < 5 then n / a * (1 - b / (a + b)) else n / b * (b / (a + b)) end, 9) as weight from c, t""")
def mixture_union(spark, d):
    """Two mixtures, the labels below 5 and the others as components, united by their counts."""
    c = table(spark, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    side = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.struct("label", "n"))))  # noqa: E731 - a component each
    two = c.agg(side(F.col("label") < 5).alias("a"), side(F.col("label") >= 5).alias("b"), F.sum(F.when(F.col("label") < 5, F.col("n"))).alias("na"), F.sum(F.when(F.col("label") >= 5, F.col("n"))).alias("nb"))
    w = mixture.mixture_union(F.transform("a", lambda x: x["n"] / F.col("na")), F.transform("b", lambda x: x["n"] / F.col("nb")), mixture.alpha_from_counts(F.col("na"), F.col("nb")))
    labels = F.transform(F.concat("a", "b"), lambda x: x["label"])
    return two.select(F.explode(F.arrays_zip(labels.alias("label"), w.alias("weight"))).alias("z")).select("z.label", F.round("z.weight", 9).alias("weight"))


@query(f"select label, vec_id, row_number() over (partition by label order by {_sha('reservoir', "label || ':' || vec_id")}, vec_id) as place from embeddings qualify place <= 20")
def reservoir_sample(spark, d):
    return vectors.reservoir(table(spark, d, "embeddings"), "label", "vec_id", 20).select("label", "vec_id", F.col("place").cast("long").alias("place"))


_LINES = "(select l_orderkey * 10 + l_linenumber as id, l_returnflag as flag from lineitem)"


@query(f"select flag, id, row_number() over (partition by flag order by {_sha('reservoir', "flag || ':' || id")}, id) as place from {_LINES} qualify place <= 5000")
def reservoir_large(spark, d):
    """Reservoirs of more rows than Spark's own group limits go up to."""
    lines = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_returnflag").alias("flag"))
    return vectors.reservoir(lines, "flag", "id", 5000).select("flag", "id", F.col("place").cast("long").alias("place"))


@query()
def pca_eigenvalues(spark, d):
    p = vectors.principal_axes(vectors.covariance_rows(table(spark, d, "embeddings"), "label", "embedding"), "label")
    return p.select("label", "n", "n_components", F.round("explained", 6).alias("explained"), F.transform("eigenvalues", lambda x: F.round(x, 6)).alias("eigenvalues"))


@query(f"""with c as (select a.label, a.d, b.d as e, covar_pop(a.x, b.x) as c, count(*) as n from {_LONG} a join {_LONG} b on a.vec_id = b.vec_id and a.label = b.label group by all)
  select label, max(n) as n, count(*) filter (where d = e) as n_values, round(sum(c) filter (where d = e), 5) as trace, round(sum(c * c), 5) as squares from c group by label""")
def pca_invariants(spark, d):
    """What holds for all eigenvalues of a covariance: as many as dimensions, their sum its trace, their squares' sum its norm's square."""
    p = vectors.principal_axes(vectors.covariance_rows(table(spark, d, "embeddings"), "label", "embedding"), "label", 1.0)
    total = lambda f: F.round(F.aggregate("eigenvalues", F.lit(0.0), lambda a, x: a + f(x)), 5)
    return p.select("label", "n", F.size("eigenvalues").cast("long").alias("n_values"), total(lambda x: x).alias("trace"), total(lambda x: x * x).alias("squares"))


@query(f"""with m as (select label, d, avg(x) as mu, var_pop(x) as v from {_LONG} group by label, d),
  p as (select vec_id, l.label, sum(-0.5 * (ln(2 * pi()) + ln(v + 1e-6) + pow(x - mu, 2) / (v + 1e-6))) as ll from {_LONG} l join m on m.label = l.label and m.d = l.d group by vec_id, l.label)
  select label, round(avg(ll), 4) as log_likelihood, round(-2 * sum(ll) + 128 * ln(count(*)), 2) as bic, round(quantile_cont(ll, 0.1), 4) as p10, round(quantile_cont(ll, 0.5), 4) as p50, round(quantile_cont(ll, 0.9), 4) as p90 from p group by label""")
def single_component_fit(spark, d):
    """A mixture of one component is the diagonal normal of the moments, so SQL knows its likelihoods."""
    v = table(spark, d, "embeddings")
    m = vectors.fit_mixtures(vectors.reservoir(v, "label", "vec_id"), "label", "vec_id", "embedding", k=1)
    return m.select("label", *[F.round(c, digits).alias(c) for c, digits in (("log_likelihood", 4), ("bic", 2), ("p10", 4), ("p50", 4), ("p90", 4))])


@query()
def gmm_fit_summary(spark, d):
    v = table(spark, d, "embeddings")
    return vectors.fit_mixtures(vectors.reservoir(v, "label", "vec_id"), "label", "vec_id", "embedding", k=3).select("label", "n_components", "log_likelihood", "bic", "p10", "p50", "p90")


@query("""with c as (select label, count(*) as n, count(*) filter (where vec_id % 2 = 1) as m from embeddings group by label)
  select label, n as n_samples, 2 + least(8, greatest(1, m // 200))::int as gmm_n_components, 'gmm' as rung, 64::bigint as n_draws from c""")
def site_statistics(spark, d):
    """Moments, basis and mixture of each site, a domain folded in, and draws from what comes out."""
    v = table(spark, d, "embeddings")
    base = vectors.fit_sites(v.filter("vec_id % 2 = 0"), "label", "vec_id", "embedding", k=2)
    added = mixture.domain_mixtures(v.filter("vec_id % 2 = 1"), base, "label", "vec_id", "embedding")
    merged = mixture.merge_artifacts(base, added, "label")
    draws = sampling.sample_sites(merged, "label", 64).groupBy("label", "rung").agg(F.count(F.lit(1)).alias("n_draws"))
    return merged.select("label", "n_samples", "gmm_n_components").join(draws, "label")


@query(f"""with m as (select label, d, avg(x) as mu, var_samp(x) + 1e-6 as v from {_LONG} group by label, d),
  ll as (select e.vec_id, e.label, sum(-0.5 * (ln(2 * pi()) + ln(m.v) + (e.x - m.mu) * (e.x - m.mu) / m.v)) as ll from {_LONG} e join m on m.label = e.label and m.d = e.d group by e.vec_id, e.label)
  select label, round(quantile_cont(ll, 0.1), 5) as p10, round(quantile_cont(ll, 0.5), 5) as p50, round(quantile_cont(ll, 0.9), 5) as p90 from ll group by label""")
def diag_loglik_percentiles(spark, d):
    v = table(spark, d, "embeddings")
    m = vectors.moments(v, "label", "embedding").select("label", "mean", F.transform("m2", lambda x: x / (F.col("n") - 1) + 1e-6).alias("var"))
    j = v.join(m, "label")
    terms = F.zip_with(F.zip_with("embedding", "mean", lambda x, mu: x.cast("double") - mu), "var", lambda e, s: F.ln(s) + e * e / s)
    ll = F.aggregate(terms, F.lit(0.0), lambda a, t: a - 0.5 * (t + math.log(2 * math.pi)))
    q = j.select("label", ll.alias("ll")).groupBy("label").agg(F.percentile("ll", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("q"))
    return q.select("label", *[F.round(F.col("q")[i], 5).alias(n) for i, n in enumerate(("p10", "p50", "p90"))])


@query("""select vec_id, b::int as block, i::int as i, cast(greatest(-127, least(127, round_even((x::float / s::float)::double, 0))) as int) as q from (
  select *, greatest(max(abs(x)) over (partition by vec_id, b) / 127::float, 1e-12::float)::float as s from (select vec_id, d // 16 as b, d % 16 as i, x::float as x from (select vec_id, unnest(range(64)) as d, unnest(embedding) as x from embeddings)))""")
def quantize_roundtrip(spark, d):
    q = mixture.quantize(table(spark, d, "embeddings"), "vec_id", "embedding", 16)
    blocks = q.select("vec_id", F.posexplode("blocks").alias("block", "z"))
    return blocks.select("vec_id", "block", F.posexplode("z.q").alias("i", "q")).withColumn("q", F.col("q").cast("int"))


#: A vector's blocks of 64 (each vector is one), in single precision as they are stored.
_CODES = """select vec_id, embedding as e, greatest(cast(list_max(list_transform(embedding, lambda x: abs(x))) / 127.0::float as float), cast(1e-12 as float)) as s from embeddings"""


@query(f"""select vec_id, round(sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(e[i]::double - cast(q[i] * h as float)::double, 2)))) / sqrt(list_sum(list_transform(e, lambda x: x::double * x::double))), 6) as relative_error from (
  select vec_id, e, list_transform(e, lambda x: greatest(-127, least(127, round_even((cast(x / s as float))::double, 0)::int))) as q,
    cast(round_even(s::double / pow(2, greatest(floor(log2(s::double)), -14) - 10), 0) * pow(2, greatest(floor(log2(s::double)), -14) - 10) as float) as h from ({_CODES}))""")
def quantize_error(spark, d):
    v = table(spark, d, "embeddings")
    j = mixture.quantize(v, "vec_id", "embedding").join(v, "vec_id")
    e = F.zip_with("embedding", mixture.dequantize(F.col("blocks"), F.col("numel")), lambda a, b: F.pow(a.cast("double") - b.cast("double"), F.lit(2)))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    error = F.sqrt(total(e)) / F.sqrt(total(F.transform("embedding", lambda x: x.cast("double") * x.cast("double"))))
    return j.select("vec_id", F.round(error, 6).alias("relative_error"))


@query(f"""with l as {_LONG}, t as (select label, d, vec_id, row_number() over (partition by label, d order by {_sha('to', "d || ':' || vec_id")}, vec_id) as r from l),
  f as (select label, d, x, row_number() over (partition by label, d order by {_sha('from', "d || ':' || vec_id")}, vec_id) as r from l)
  select t.label, t.vec_id, t.d::int as d, round(f.x, 6) as x from t join f using (label, d, r)""")
def decorrelate_marginals(spark, d):
    out = sampling.decorrelated(table(spark, d, "embeddings"), "label", "vec_id", "embedding")
    return out.select("label", "vec_id", "d", F.round(F.col("x").cast("double"), 6).alias("x"))


@query(f"""with m as (select label, d, avg(x) as mu, sqrt(var_samp(x) + 1e-10) as s from {_LONG} group by label, d)
  select label, g::int as draw, d::int as d, round(mu + s * sqrt(-2 * ln({_uniform('diagonal:u', "label || ':' || g || ':' || d")})) * cos(6.283185307179586::double * {_uniform('diagonal:v', "label || ':' || g || ':' || d")}), 5) as x from m, range(50) r(g)""")
def sample_diag_draws(spark, d):
    m = vectors.moments(table(spark, d, "embeddings"), "label", "embedding")
    draws = sampling.sample_diagonal(m, "label", 50)
    return draws.select("label", "draw", F.posexplode("v").alias("d", "x")).withColumn("x", F.round("x", 5))


@query(f"""with w as (select event_type, count(*)::double as w from events group by event_type), c as (select event_type, (sum(w) over o - w) / sum(w) over () as lo, sum(w) over o / sum(w) over () as hi from w window o as (order by sha256(event_type), event_type)),
  u as (select g as draw, {_uniform('categorical', 'g')} as u from range(2000) r(g)) select draw, event_type from u join c on u >= lo and u < hi""")
def sample_categorical_draws(spark, d):
    w = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("w"))
    return sampling.sample_categorical(w, "event_type", "w", 2000)


_LOOKED_UP = f"""with c as (select vec_id, embedding, (sum(w) over o - w) / sum(w) over () as lo, sum(w) over o / sum(w) over () as hi from (select *, (label % 3)::double as w from embeddings where label % 3 > 0) window o as (order by sha256(vec_id::varchar), vec_id)),
  u as (select g as draw, {_uniform('categorical', 'g')} as u from range(3000) r(g))"""


@query(f"{_LOOKED_UP} select draw, vec_id, round(embedding[1]::double, 6) as first, round(embedding[64]::double, 6) as last from u join c on u >= lo and u < hi")
def sample_lookup_draws(spark, d):
    """Rows of the vector table drawn by weight; a third of the labels has weight 0."""
    v = table(spark, d, "embeddings").withColumn("w", F.pmod("label", F.lit(3)))
    draws = sampling.sample_lookup(v, "vec_id", "embedding", 3000, weight="w")
    return draws.select("draw", "vec_id", F.round(F.col("v")[0], 6).alias("first"), F.round(F.col("v")[63], 6).alias("last"))


@query("select label, case when label = 0 then 'lookup' else 'diagonal' end as rung, count(*) as n_sites, 40::bigint as n_draws, 64 as width from (select distinct label from embeddings) group by label")
def sample_ladder(spark, d):
    """Draws at the finest level of each site: the table itself for one, a diagonal normal for the others."""
    v = table(spark, d, "embeddings")
    out = sampling.sample_best(vectors.moments(v, "label", "embedding"), "label", 40, lookup=v, lookup_site=0, item="vec_id", vector="embedding")
    return out.groupBy("label", "rung").agg(F.count_distinct("rung").alias("n_sites"), F.count(F.lit(1)).alias("n_draws"), F.max(F.size("v")).alias("width"))


@query(f"""with m as (select label, d, avg(x) as mu, var_pop(x) as v from {_LONG} group by label, d), s as (select label, sqrt(avg(v)) as sigma from m group by label),
  z as (select label, g, d, mu, sigma, sqrt(-2 * ln({_uniform('isotropic:u', "label || ':' || g || ':' || d")})) * cos(6.283185307179586::double * {_uniform('isotropic:v', "label || ':' || g || ':' || d")}) as z from m join s using (label), range(20) r(g))
  select label, g::int as draw, d::int as d, round(mu + sigma * z, 5) + 0.0 as matched, round(z, 5) + 0.0 as unit from z""")
def isotropic_draws(spark, d):
    control = sampling.isotropic_moments(table(spark, d, "embeddings"), "label", "embedding")
    flat = lambda mode: sampling.sample_isotropic(control, "label", 20, mode=mode).select("label", "draw", F.posexplode("v").alias("d", "x"))
    both = flat("matched").withColumnRenamed("x", "matched").join(flat("unit").withColumnRenamed("x", "unit"), ["label", "draw", "d"])
    return both.select("label", "draw", "d", (F.round("matched", 5) + 0.0).alias("matched"), (F.round("unit", 5) + 0.0).alias("unit"))


@query(f"""with w as (select vec_id, label, d, x, (vec_id % 5)::double as w from {_LONG} where vec_id % 5 > 0), m as (select label, d, count(*) as n, sum(w * x) / sum(w) as m, sum(w * x * x) / sum(w) - pow(sum(w * x) / sum(w), 2) as v from w group by label, d)
  select label, max(n) as n, round(avg(m), 6) as mean_of_means, round(sqrt(avg(v)), 6) as sigma from m group by label""")
def isotropic_weighted_moments(spark, d):
    v = table(spark, d, "embeddings").withColumn("w", F.pmod("vec_id", F.lit(5)))
    m = sampling.isotropic_moments(v, "label", "embedding", "w")
    mean = F.aggregate("mean", F.lit(0.0), lambda a, x: a + x) / F.size("mean")
    return m.select("label", "n", F.round(mean, 6).alias("mean_of_means"), F.round("sigma", 6).alias("sigma"))


@query(f"select label, max(n) as n, round(avg(m), 6) as mean_of_means, round(sqrt(avg(v)), 6) as sigma from (select label, d, count(*) as n, avg(x) as m, var_pop(x) as v from {_LONG} group by label, d) group by label")
def isotropic_control_moments(spark, d):
    m = sampling.isotropic_moments(table(spark, d, "embeddings"), "label", "embedding")
    mean = F.aggregate("mean", F.lit(0.0), lambda a, x: a + x) / F.size("mean")
    return m.select("label", "n", F.round(mean, 6).alias("mean_of_means"), F.round("sigma", 6).alias("sigma"))


@query("select label, vec_id from embeddings qualify row_number() over (partition by label order by vec_id) <= 5")
def first_vectors(spark, d):
    return sampling.first_per_site(table(spark, d, "embeddings").select("label", "vec_id"), "label", "vec_id", 5)


@query(f"select label, round(avg(p), 5) as price from (select vec_id, label, pow(sum(case when d < 8 then x else 0 end), 2) + pow(sum(case when d >= 8 and d < 16 then 2 * x else 0 end), 2) as p from {_LONG} group by vec_id, label) group by label")
def linear_site_price(spark, d):
    delta = [[1.0 if j < 8 else 0.0 for j in range(64)], [2.0 if 8 <= j < 16 else 0.0 for j in range(64)]]
    return metrics.site_price(table(spark, d, "embeddings"), "label", "embedding", delta).withColumn("price", F.round("price", 5))


# --- schedules, curves, reports -------------------------------------------------------------------------------
def _layer_sql(kind: str, w: str) -> str:
    return f"select '{kind}' as kind, n::int as layers, l as layer, round(w / sum(w) over (partition by n), 9) as weight from (select n, unnest(range(n)) as l, {w} as w from (values (4), (28)) v(n))"


@query(" union all ".join([
    _layer_sql("cosine", "0.1::double + 0.9::double * (1 + cos(pi() * unnest(range(n)) / n)) / 2"),
    _layer_sql("linear", "1 - 0.9::double * unnest(range(n)) / n"), _layer_sql("exponential", "pow(0.1::double, unnest(range(n)) / n::double)"),
]))
def layer_schedule(spark, d):
    every = [metrics.layer_weights(spark, n, 0.1, k).select(F.lit(k).alias("kind"), F.lit(n).alias("layers"), "layer", F.round("weight", 9).alias("weight")) for k in ("cosine", "linear", "exponential") for n in (4, 28)]
    out = every[0]
    for e in every[1:]:
        out = out.unionByName(e)
    return out


@query("select s as step, round(case when s < 50 then 3e-4::double * (0.1::double + 0.9::double * s / 50) else 3e-5::double + (3e-4::double - 3e-5::double) * (1 + cos(pi() * (s - 50) / 950)) / 2 end, 12) as rate from range(1000) r(s)")
def lr_schedule(spark, d):
    return metrics.learning_rates(spark, 1000, 3e-4, floor=0.1).withColumn("rate", F.round("rate", 12))


_EPOCHS = "(select run_id, stage, epoch, arg_max({'p': val_perplexity, 't': train_loss, 'n': n_tokens}, {'l': logged_at, 'p': val_perplexity, 't': train_loss, 'n': n_tokens}) as v, min(logged_at) as started from run_history group by run_id, stage, epoch)"
_CURVES = f"(select run_id, stage, epoch, v.p as val_perplexity, v.t as train_loss, v.n as n_tokens, started from {_EPOCHS})"
_VERDICTS = f"""(select run_id, stage, n_measured, best.e as best_epoch, best.m as best, case when ok then final.m end as final, case when not ok then 'diverged' when n_measured = 0 then 'no_curve' when final.e = best.e then 'still_falling' else 'turned' end as verdict, started from (
  select *, coalesce(isfinite(final.m) and final.m > 0, true) as ok from (
  select run_id, stage, count(val_perplexity) as n_measured, min({{'m': val_perplexity, 'e': epoch}}) filter (where isfinite(val_perplexity) and val_perplexity > 0) as best, max({{'e': epoch, 'm': val_perplexity}}) filter (where val_perplexity is not null) as final,
    min(started) as started from {_CURVES} group by run_id, stage)))"""


def _curves(spark, d) -> DataFrame:
    h = table(spark, d, "run_history").withColumn("key", F.struct("run_id", "stage"))
    columns = ["val_perplexity", "train_loss", "n_tokens"]
    last = metrics.latest_epochs(h, "key", "epoch", "logged_at", columns)
    first = h.groupBy("key").agg(F.min("logged_at").alias("started"))
    return last.join(first, "key").select("key", "epoch", *columns, "started")


@query(f"""select run_id, stage, n_measured, best_epoch::double as best_epoch, round(best, 6) as best, round(final, 6) as final, case when verdict = 'turned' then round(final / best - 1, 6) end as gap, verdict,
  case when verdict <> 'turned' then 'none' when final >= 1.10::double * best then 'warn' when round_even((final / best - 1) * 100, 1) < 1.0 then 'optional' else 'likely' end as advice from {_VERDICTS}""")
def held_out_verdict(spark, d):
    v = metrics.curve_verdict(_curves(spark, d), "key", "epoch", "val_perplexity")
    return v.select("key.run_id", "key.stage", "n_measured", F.col("best_epoch").cast("double").alias("best_epoch"), *[F.round(c, 6).alias(c) for c in ("best", "final", "gap")], "verdict", "advice")


@query(f"select run_id, stage, round(exp(sum(train_loss * n_tokens) / sum(n_tokens)), 6) as perplexity, cast(sum(n_tokens) as bigint) as n_tokens from {_CURVES} where train_loss is not null and n_tokens is not null group by run_id, stage")
def weighted_perplexity(spark, d):
    scored = _curves(spark, d).filter("train_loss is not null and n_tokens is not null")
    return scored.groupBy("key").agg(F.round(metrics.perplexity(F.col("train_loss"), F.col("n_tokens")), 6).alias("perplexity"), F.sum("n_tokens").alias("n_tokens")).select("key.run_id", "key.stage", "perplexity", "n_tokens")


@query(f"""with v as (select vec_id % 7 as class, label, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) as r from embeddings),
  g as (select class, label, count(*) as n, exp(avg(ln(greatest(r, 1e-3)))) as level, coalesce(stddev_samp(ln(greatest(r, 1e-3))), 0) as shape from v group by class, label)
  select class, round(median(level), 6) as median, round(median(shape), 6) as floor_median, round(median(level) / nullif(median(shape), 0), 4) as times_floor from g group by class""")
def level_shape(spark, d):
    norm = F.sqrt(F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x))
    ratios = table(spark, d, "embeddings").select(F.pmod("vec_id", F.lit(7)).alias("class"), "label", norm.alias("r"))
    medians = metrics.class_medians(metrics.level_shape(ratios, ["class", "label"], "r"), "class", "level", "shape")
    return medians.select("class", F.round("median", 6).alias("median"), F.round("floor_median", 6).alias("floor_median"), F.round("times_floor", 4).alias("times_floor"))


_EPOCHS = ["e1", "e2", "e3"]


@query("""with s as (select run_id || '/' || stage as axis, epoch, avg(val_perplexity) as v from run_history where epoch <= 3 group by all),
  w as (select axis, max(v) filter (where epoch = 1) as e1, max(v) filter (where epoch = 2) as e2, max(v) filter (where epoch = 3) as e3 from s group by axis)
  select axis, round(e1, 4) as e1, round(e2, 4) as e2, round(e3, 4) as e3, round_even((e2 - e1) / nullif(e1, 0) * 100, 1) + 0.0::double as e2_delta_pct, round_even((e3 - e1) / nullif(e1, 0) * 100, 1) + 0.0::double as e3_delta_pct from w""")
def perplexity_table(spark, d):
    """The held-out perplexity of each run and stage after its first epochs, and its change; null where nothing was held out."""
    own = table(spark, d, "run_history").filter("epoch <= 3")
    scores = own.groupBy(F.concat_ws("/", "run_id", "stage").alias("axis"), F.concat(F.lit("e"), F.col("epoch")).alias("stage")).agg(F.avg("val_perplexity").alias("v"))
    t = metrics.perplexity_table(scores, "axis", "stage", "v", _EPOCHS)
    return t.select("axis", *[F.round(c, 4).alias(c) for c in _EPOCHS], *[(F.col(f"{c}_delta_pct") + 0.0).alias(f"{c}_delta_pct") for c in _EPOCHS[1:]])


@query(f"""select run_id, stage, turned_epoch::double as turned_epoch, case when turned_epoch is not null then last_value(run_id) over (partition by stage, turned_epoch order by started, run_id rows between unbounded preceding and 1 preceding) end as rerun_of from (
  select run_id, stage, started, case when verdict = 'turned' then best_epoch end as turned_epoch from {_VERDICTS})""")
def ledger_last_run(spark, d):
    curves = _curves(spark, d)
    v = metrics.curve_verdict(curves, "key", "epoch", "val_perplexity").select("key", F.when(F.col("verdict") == "turned", F.col("best_epoch")).alias("turned_epoch"))
    ledger = v.join(curves.groupBy("key").agg(F.min("started").alias("started")), "key").select("key.run_id", "key.stage", "started", "turned_epoch")
    return metrics.earlier_turn(ledger, "stage", "run_id", "started", "turned_epoch").select("run_id", "stage", F.col("turned_epoch").cast("double").alias("turned_epoch"), "rerun_of")


@query("""select m.source, m.lang, m.n, sha256('source=' || coalesce(m.source, '') || chr(10) || 'lang=' || coalesce(m.lang, '')) as frame from (select source, lang, count(*) as n from documents group by all) m
  where exists (select 1 from documents w where w.doc_format = 'book' and w.source is not distinct from m.source and w.lang is not distinct from m.lang)""")
def manifest_reuse(spark, d):
    docs = table(spark, d, "documents")
    manifests = docs.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    same = metrics.reusable(manifests, docs.filter("doc_format = 'book'"), ["source", "lang"])
    named = [F.concat(F.lit(f"{c}="), F.coalesce(c, F.lit(""))) for c in ("source", "lang")]
    return same.select("source", "lang", "n", metrics.frame_hash(*named).alias("frame"))


@query(f"select label::int as label, d::int as d, count(*) as n, round(avg(x), 6) as mean, round(sqrt(var_samp(x) + 1e-10), 6) as std from {_LONG} group by label, d")
def stream_moment_fold(spark, d):
    """The vectors as a stream of files, folded into standing moments batch by batch; equal to ``vector_moments``."""
    stream, where = _stream(spark, d, "moments")
    fold_moments(stream, "label", "embedding", f"{where}/state", f"{where}/checkpoint").awaitTermination()
    out = folded(spark, f"{where}/state")
    return out.select(F.col("site").alias("label"), "d", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def _stream(spark, d, name: str) -> tuple[DataFrame, str]:
    """The vectors as a stream of files, and a folder for its state."""
    where = f"{shared_folder(spark).rstrip('/')}/lodestone-fold-{name}-{uuid.uuid4()}"
    path = f"{d}/embeddings.parquet"
    whole = spark.read.parquet(path)
    one_file = whole.inputFiles()[0].rstrip("/") == f"file://{path}"  # a stream reads folders, or what a pattern finds
    return spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/embeddings.parque[t]" if one_file else path), where


@query(f"select label, vec_id, row_number() over (partition by label order by {_sha('reservoir', "label || ':' || vec_id")}, vec_id) as place from embeddings qualify place <= 30")
def stream_reservoir_fold(spark, d):
    """The reservoirs of a stream's batches, folded into that of the whole."""
    stream, where = _stream(spark, d, "reservoir")
    fold_reservoir(stream, "label", "vec_id", f"{where}/state", f"{where}/checkpoint", 30).awaitTermination()
    return folded_reservoir(spark, f"{where}/state", "label", "vec_id", 30).select("label", "vec_id", F.col("place").cast("long").alias("place"))


@query("""with b as (select label, vec_id, vec_id // 20 as batch from embeddings), c as (select label, batch, sum(count(*)) over (partition by label order by batch) as n from b group by label, batch),
  r as (select label, min(batch) filter (where n >= 15) as hit from c group by label), l as (select case when count(hit) = count(*) then max(hit) end as last from r) select label, vec_id, batch from b, l where last is null or batch <= last""")
def vectors_until_enough(spark, d):
    v = table(spark, d, "embeddings").select("label", "vec_id", F.floor(F.col("vec_id") / 20).alias("batch"))
    return vectors.until_enough(v, "label", "batch", 15)
