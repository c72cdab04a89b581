"""Queries of the checks, reports and small transforms, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.functions.names import source_name
from lodestone.functions.seeded import epoch_offset
from lodestone.operators import checks, chunking, corpora, metrics, vectors
from lodestone.plans.text_queries import _N_WORDS, _sha, _word_counts, _words, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"select doc_id, len(w) - least(len(w), 5) as n_left, w[6] as first_left from (select doc_id, coalesce({_words('text')}, []) as w from documents)")
def burn_in_dropped(spark, d):
    left = text.drop_burn_in(text.tokens(F.col("text")), 5)
    return table(spark, d, "documents").select("doc_id", left.alias("w")).select("doc_id", F.size("w").cast("long").alias("n_left"), F.try_element_at("w", F.lit(1)).alias("first_left"))


@query(r"""select doc_id, length(regexp_replace(regexp_replace(regexp_replace('Front matter.' || chr(10) || '*** START OF THIS BOOK ***' || text || '*** END OF THIS BOOK ***' || chr(10) || 'Licence.', '(?s)^.*?\*\*\*\s*START OF .*?\*\*\*', ''), '(?s)\*\*\*\s*END OF .*$', ''),
  '^[\t-\r\x{1C}-\x{20}\x{85}\p{Z}]+|[\t-\r\x{1C}-\x{20}\x{85}\p{Z}]+$', '', 'g')) as n_chars from documents where text is not null""")
def licence_stripped(spark, d):
    head, tail = F.lit("Front matter.\n*** START OF THIS BOOK ***"), F.lit("*** END OF THIS BOOK ***\nLicence.")
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.length(text.strip_licence(F.concat(head, "text", tail))).cast("long").alias("n_chars"))


_FRAMES = ["In {topic}, a note is read once.", "This {topic} text is filler.", "Nothing here is about {topic} itself.", "A later note follows this one."]


@query(f"""select topic, n, '# ' || topic || ' note ' || n || chr(10) || chr(10) || replace(string_agg(['{"', '".join(_FRAMES)}'][(('0x' || substring(sha256(topic || '/' || n || '/' || i), 1, 8))::bigint % 4) + 1], ' ' order by i), '{{topic}}', topic) || chr(10) as text
  from (values ('weaving'), ('tides')) t(topic), range(25) r(n), range(1, 7) s(i) group by topic, n""")
def synthetic_corpus(spark, d):
    topics = spark.createDataFrame([("weaving",), ("tides",)], "topic string").crossJoin(spark.range(25).withColumnRenamed("id", "n"))  # 50 rows
    return topics.select("topic", "n", text.synthetic_text(F.col("topic"), F.col("n"), _FRAMES, 6).alias("text"))


@query("select row_id, sha256('User: ' || coalesce(prompt, '') || chr(10) || 'Assistant: ' || coalesce(response, '')) as text_hash from (select row_id, any_value(prompt) as prompt, any_value(response) as response from seed_corpus group by row_id) where prompt is not null")
def rendered_pairs(spark, d):
    rows = table(spark, d, "seed_corpus").groupBy("row_id").agg(F.min_by(F.struct("prompt", "response"), "loaded_at").alias("v")).filter("v.prompt is not null")
    return rows.select("row_id", text.fingerprint(text.render_pair(F.col("v.prompt"), F.col("v.response"), "User: {prompt}\nAssistant: {response}")).alias("text_hash"))


@query(f"select doc_id, n, rnk, reached from (select doc_id, n, row_number() over w as rnk, cast(sum(n) over w as bigint) as reached from {_N_WORDS} window w as (order by {_sha('until', 'doc_id')}, doc_id rows unbounded preceding)) where reached - n < 20000")
def documents_until_need(spark, d):
    return chunking.chunks_until(_word_counts(spark, d), "doc_id", "n", 20000)


_EPOCHS = [epoch_offset(e, 42, 512) for e in range(4)]


def _kept(m: str) -> str:
    return f"case when {m} < 10 then 0 else floor(({m} - 10) / 512.0)::bigint + 1 end"


@query(f"""select e::int as epoch, cast(sum(c) as bigint) as n_chunks, cast(ceil(ceil(sum(c) / 6.0) / 2.0) as bigint) as steps from (
  select e, case when o > 0 then {_kept('least(o, n)')} else 0 end + {_kept('greatest(n - o, 0)')} as c from (select n, e, case when n <= 512 or o between 1 and 9 then 0 else o end as o from {_N_WORDS}, (values {', '.join(f'({e}, {o})' for e, o in enumerate(_EPOCHS))}) v(e, o))) group by e""")
def optimizer_steps(spark, d):
    return chunking.optimizer_steps(_word_counts(spark, d), "n", _EPOCHS, 6, 2)


@query("select cast(sum(length(text)) as bigint) as n_chars, cast(sum(length(text)) // 4 as bigint) as n_tokens, cast(sum(length(text)) // 4 * 35 as bigint) as n_bytes from documents")
def memory_estimate(spark, d):
    return chunking.memory_estimate(table(spark, d, "documents"), "text")


@query("select epoch::int as epoch, round(avg(train_loss), 6) as train_loss, round(avg(anchor_loss), 6) as anchor_loss, round(coalesce(avg(case when stage >= 2 then learning_rate end), 0), 9) as grad_norm, count(*) as n_batches, count(*) filter (where stage >= 2) as n_steps from run_history group by epoch")
def epoch_means(spark, d):
    h = table(spark, d, "run_history").withColumn("stepped", F.col("stage") >= 2)
    m = metrics.epoch_means(h, "epoch", ["train_loss", "anchor_loss"], "learning_rate", "stepped")
    return m.select("epoch", F.round("train_loss", 6).alias("train_loss"), F.round("anchor_loss", 6).alias("anchor_loss"), F.round("grad_norm", 9).alias("grad_norm"), "n_batches", "n_steps")


@query("with c as (select label, count(*) as n from embeddings group by label) select arg_min(label, n * 1000 + label) as thinnest, min(n) as least, arg_max(label, n * 1000 + label) as largest, max(n) as most from c")
def site_extremes(spark, d):
    return metrics.thinnest_and_largest(table(spark, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n")), "label", "n")


@query("""with m as (select label as layer, avg(embedding[1]::double * embedding[1]::double) as m from embeddings group by label), w as (select l, 0.1::double + 0.9::double * (1 + cos(pi() * l / 10)) / 2 as w from range(10) r(l))
  select round(sum(m * w / (select sum(w) from w)), 9) as loss from m join w on l = layer""")
def weighted_site_loss(spark, d):
    errors = table(spark, d, "embeddings").select(F.col("label").cast("long").alias("layer"), (F.col("embedding")[0].cast("double") * F.col("embedding")[0].cast("double")).alias("mse"))
    return metrics.weighted_site_loss(errors, metrics.layer_weights(spark, 10, 0.1), "layer", "mse").withColumn("loss", F.round("loss", 9))


@query("""select vec_id, round(4 * list_sum(list_transform(range(1, 5), lambda i: list_sum(list_transform(range(1, 4), lambda j: pow(e[i] * e[5 + j] + e[8 + i] * e[12 + j], 2))))), 6) as loss
  from (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings)""")
def factored_weight_loss(spark, d):
    e = [F.col("embedding")[i].cast("double") for i in range(16)]
    a = F.array(F.array(*e[5:8]), F.array(*e[12:15]))  # 2 x 3
    b = F.array(*[F.array(e[i], e[8 + i]) for i in range(4)])  # 4 x 2
    return table(spark, d, "embeddings").select("vec_id", F.round(metrics.factored_weight_loss(a, b, 2.0), 6).alias("loss"))


@query("select label, count(*) as n from embeddings where embedding[1] > 0 and label < 8 group by label")
def padding_left_out(spark, d):
    masked = table(spark, d, "embeddings").withColumn("mask", (F.col("embedding")[0] > 0).cast("int"))
    return vectors.without_padding(masked, "mask", "label", 8).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("select label as layer, 'v' as site, case when label = 3 then 'mixture_not_diagonal' when label = 5 then 'weights_off_one' when label = 7 then 'other_width' end as problem from (select distinct label from embeddings) where label in (3, 5, 7) union all select 99, 'v', 'missing_site'")
def artifact_violations(spark, d):
    """Planted faults in site rows: a full covariance, weights that don't sum to 1, another width, a missing site."""
    l = F.col("label")
    sites = table(spark, d, "embeddings").groupBy("label").agg(F.min_by("embedding", "vec_id").cast("array<double>").alias("mean")).select(
        l.alias("layer"), F.lit("v").alias("site"), "mean", F.col("mean").alias("std"), F.lit(2).alias("gmm_n_components"), F.when(l == 3, "full").otherwise("diag").alias("gmm_covariance_type"),
        F.array(F.lit(0.5), F.when(l == 5, 0.6).otherwise(0.5)).alias("gmm_weights"),
    )
    expected = sites.select("layer", "site", F.when(F.col("layer") == 7, 65).otherwise(64).alias("width")).unionByName(spark.createDataFrame([(99, "v", 64)], "layer int, site string, width int"))
    return checks.artifact_violations(sites, expected=expected)


@query("select cast(count(distinct case when label <> 9 then label end) as bigint) as num_layers, 64 as hidden_dim, count(distinct label) as n_sites from embeddings")
def site_topology(spark, d):
    sites = table(spark, d, "embeddings").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("mean")).select(F.col("label").alias("layer"), F.when(F.col("label") == 9, "pre_lm_head").otherwise("pre_mlp").alias("site"), "mean")
    return checks.topology(sites)


@query("select doc_id, case when not regexp_matches(coalesce(h, ''), '^[0-9a-f]{64}$') then 'sha256: not 64 lower-case hex digits' end as problem from (select doc_id, case when doc_id % 5 = 0 then upper(sha256(text)) else sha256(text) end as h from documents)")
def pin_problems(spark, d):
    h = text.fingerprint(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.when(F.pmod("doc_id", F.lit(5)) == 0, F.upper(h)).otherwise(h).alias("h")).select("doc_id", checks.pin_problem(F.col("h"), "sha256").alias("problem"))


@query("select source_index as doc_id, 'unknown' as side from (select distinct source_index from supplement) where source_index not in (select doc_id from documents) union all select doc_id, 'missing' from documents where doc_id not in (select source_index from supplement where source_index is not null)")
def key_differences(spark, d):
    return checks.key_differences(table(spark, d, "documents").select("doc_id"), table(spark, d, "supplement").filter("source_index is not null").select(F.col("source_index").alias("doc_id")), ["doc_id"])


@query("""select doc_id, ((lang is distinct from 'en')::int + (doc_format is distinct from 'book')::int)::int as n_different from documents""")
def frame_differences(spark, d):
    recorded = F.create_map(F.lit("lang"), F.col("lang"), F.lit("format"), F.col("doc_format"))
    wanted = F.create_map(F.lit("lang"), F.lit("en"), F.lit("format"), F.lit("book"))
    return table(spark, d, "documents").select("doc_id", F.size(checks.frame_differences(recorded, wanted)).alias("n_different"))


@query("select run_id, stage, case when q is null or a is null then 'unknown' when q > 0 or a > 0 then 'anchored' else 'unanchored' end as training from (select run_id, stage, max(anchor_loss) as q, max(val_perplexity) as a from run_history group by all)")
def adapter_training(spark, d):
    h = table(spark, d, "run_history").groupBy("run_id", "stage").agg(F.max("anchor_loss").alias("q"), F.max("val_perplexity").alias("a"))
    return h.select("run_id", "stage", checks.adapter_training(F.col("q"), F.col("a")).alias("training"))


@query("select doc_id, case when n and s then 'fit_on_named_training_corpus' when n then 'whole_as_named' when h then 'held_out' else 'fit_on_training_side' end as scored from (select doc_id, doc_id % 2 = 0 as n, doc_id % 3 = 0 as s, doc_id % 5 = 0 as h from documents)")
def scored_as(spark, d):
    flag = lambda k: F.pmod("doc_id", F.lit(k)) == 0
    return table(spark, d, "documents").select("doc_id", checks.scored_as(flag(2), flag(3), flag(5)).alias("scored"))


_RECORDED = ", ".join(f"('{side}', '{source}', {n})" for side, part in corpora.COMPOSITION.items() for source, n in part.items())


@query(rf"""with c as (select side, source, count(*) as n from (select case when prompt is null then 'pretraining' else 'instruction' end as side, case when s is null or s = '' then 'unknown' else s end as source from (
    select any_value(prompt) as prompt, min_by(replace(lower(regexp_replace(source, '^[ \t\r\n\x{{A0}}\x{{3000}}]+|[ \t\r\n\x{{A0}}\x{{3000}}]+$', '', 'g')), '-', '_'), loaded_at) as s from seed_corpus group by row_id)) group by all)
  select * from (select side, source, coalesce(n, 0) as n, coalesce(recorded, 0)::bigint as recorded from c full join (values {_RECORDED}) v(side, source, recorded) using (side, source)) where n <> recorded""")
def composition_differences(spark, d):
    """The seed corpus against the recorded composition."""
    rows = table(spark, d, "seed_corpus").groupBy("row_id").agg(F.min_by(F.struct(F.col("prompt").isNull().alias("text"), source_name(F.col("source")).alias("source")), "loaded_at").alias("v"))
    return corpora.composition_differences(rows.select(F.when(F.col("v.text"), "pretraining").otherwise("instruction").alias("side"), "v.source"))


@query("""with m as (select epoch::varchar as label, coalesce(printf('%.2f', round_even(avg(train_loss), 2)), '') as a, coalesce(printf('%.2f', round_even(avg(val_perplexity), 2)), '') as b from run_history group by epoch),
  w as (select max(length(label))::int as w, greatest(max(length(a)), 10)::int as wa, greatest(max(length(b)), 14)::int as wb from m)
  select 0 as line, '| ' || repeat(' ', w) || ' | ' || lpad('train_loss', wa, ' ') || ' | ' || lpad('val_perplexity', wb, ' ') || ' |' as text from w union all select 1, '| ' || repeat('-', w) || ' | ' || repeat('-', wa) || ' | ' || repeat('-', wb) || ' |' from w
  union all select cast(row_number() over (order by label) + 1 as int), '| ' || rpad(label, w, ' ') || ' | ' || lpad(a, wa, ' ') || ' | ' || lpad(b, wb, ' ') || ' |' from m, w""")
def report_lines(spark, d):
    means = table(spark, d, "run_history").groupBy("epoch").agg(F.avg("train_loss").alias("train_loss"), F.avg("val_perplexity").alias("val_perplexity"))
    return metrics.markdown_table(means, "epoch", ["train_loss", "val_perplexity"])


@query("""with w as (select l, 0.2::double + 0.8::double * (1 + cos(pi() * l / 10)) / 2 as w from range(10) r(l)), p as (select label as l, sum(pow(a.x::double - b.x::double, 2)) as loss from (select vec_id, label, unnest(embedding) as x, unnest(range(64)) as d from embeddings) b
    join (select vec_id, unnest(list_reverse(embedding)) as x, unnest(range(64)) as d from embeddings) a using (vec_id, d) group by label)
  select round(sum(loss * w / (select sum(w) from w)), 6) as loss from p join w using (l)""")
def general_weight_loss(spark, d):
    """What changed between the vectors and the same ones backwards, by layers."""
    v = table(spark, d, "embeddings")
    changed = v.withColumn("embedding", F.reverse("embedding"))
    return metrics.weight_loss(v.select("vec_id", "embedding"), changed, ["vec_id"], "embedding", "label", metrics.layer_weights(spark, 10, 0.2)).withColumn("loss", F.round("loss", 6))
