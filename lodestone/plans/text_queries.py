"""Queries over documents, corpora and pairs, each with the SQL that must give the same rows."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import folds, text
from lodestone.functions.names import source_name
from lodestone.functions.seeded import epoch_offset, order_key
from lodestone.operators import chunking, corpora, documents
from lodestone.operators.deliveries import first_delivery
from lodestone.plans.prepare import REASONS, generated_share, judged_answers, judged_questions
from lodestone.sources.files import TEXT_FIELDS, record_text
from lodestone.sources.tables import read_table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def long(df: DataFrame, *columns: str) -> DataFrame:
    """The columns as longs, the type that SQL's counts and lengths have."""
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


def query(sql: str | None = None, longs: tuple[str, ...] = ()):
    def add(f):
        QUERIES[f.__name__] = functools.wraps(f)(lambda spark, d: long(f(spark, d), *longs)) if longs else f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


# --- SQL fragments ------------------------------------------------------------------------------------------
def _words(c: str) -> str:
    return f"list_filter(string_split_regex({c}, '[ \\t\\r\\n]+'), lambda w: w <> '')"


def _collapse(c: str) -> str:
    return f"trim(regexp_replace({c}, '[ \\t\\r\\n\\f]+', ' ', 'g'))"


def _norm(c: str) -> str:
    breaks = r"[\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"
    gone = r"[\x{FEFF}\x{200B}\x{200C}\x{200D}\x{2060}\x{AD}\x{00}-\x{09}\x{0B}-\x{1F}\x{7F}-\x{9F}]"
    return rf"nfc_normalize(regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '\r\n?', chr(10), 'g'), '{breaks}', chr(10), 'g'), '[\t\p{{Zs}}]', ' ', 'g'), '{gone}', '', 'g'))"


def _sentences(table_name: str, key: str, c: str = "text") -> str:
    """One row a distinct sentence of a text: key, hash, n_chars, uses."""
    end = "([.!?…]+[\"''”’)\\]]*)\\s"
    return rf"""(select {key}, sha256(s) as hash, max(length(s)) as n_chars, count(*) as uses from (
      select {key}, trim(unnest(string_split(regexp_replace({_collapse('b')}, '{end}', '\1' || chr(1), 'g'), chr(1)))) as s from (
        select {key}, unnest(string_split_regex({_norm(c)}, '\n\s*\n')) as b from {table_name} where {c} is not null)) where length(s) >= 60 group by {key}, sha256(s))"""


_N_WORDS = f"(select doc_id, cast(coalesce(len({_words('text')}), 0) as bigint) as n from documents)"


def _sha(purpose: str, ident: str, seed: int = 42) -> str:
    return f"sha256('{seed}:{purpose}:' || {ident})"


def _word_counts(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(text.tokens(F.col("text"))).cast("long").alias("n"))


# --- documents ------------------------------------------------------------------------------------------------
@query(f"select doc_id, length(text) as n_chars, substring({_collapse('text')}, 1, 60) as excerpt from documents where length(text) >= 1000 and regexp_matches(text, '[^ \\t\\r\\n\\f]')", longs=("n_chars",))
def doc_length_filter(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").filter((F.length(t) >= 1000) & t.rlike("[^ \\t\\r\\n\\f]")).select("doc_id", F.length(t).alias("n_chars"), text.excerpt(t).alias("excerpt"))


@query("select coalesce(source, 'unknown') as source, count(*) as n_rows, cast(sum(coalesce(length(text), 0)) as bigint) as n_chars, cast(sum(coalesce(length(text), 0)) // 4 as bigint) as n_tokens, round(avg(coalesce(length(text), 0)), 6) as mean_chars from documents group by 1")
def doc_source_stats(spark, d):
    return corpora.corpus_statistics(table(spark, d, "documents"), F.col("source"), F.length("text")).withColumn("mean_chars", F.round("mean_chars", 6))


@query("select source, count(*) filter (where lang = 'de') as de, count(*) filter (where lang = 'en') as en, count(*) filter (where lang = 'es') as es, count(*) filter (where lang = 'fr') as fr from documents group by source")
def doc_lang_source_matrix(spark, d):
    langs = ["de", "en", "es", "fr"]
    return table(spark, d, "documents").groupBy("source").pivot("lang", langs).count().fillna(0, langs)


@query(f"select doc_id, cast(sum(uses) as bigint) as n_sentences, cast(sum(n_chars * uses) as bigint) as n_chars from {_sentences('documents', 'doc_id')} group by doc_id")
def sentence_extract(spark, d):
    s = documents.sentence_table(table(spark, d, "documents"), "doc_id")
    return s.groupBy("doc_id").agg(F.sum("uses").alias("n_sentences"), F.sum(F.col("n_chars") * F.col("uses")).alias("n_chars"))


@query(f"select hash, max(n_chars) as n_chars, cast(sum(uses) as bigint) as n_uses, count(*) as n_docs, min(doc_id) as first_doc from {_sentences('documents', 'doc_id')} group by hash", longs=("n_chars",))
def sentence_hash_index(spark, d):
    s = documents.sentence_table(table(spark, d, "documents"), "doc_id")
    return s.groupBy("hash").agg(F.max("n_chars").alias("n_chars"), F.sum("uses").alias("n_uses"), F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc"))


_VERDICT = "case when share >= 0.5 then 'refuse' when share > 0 then 'warn' else 'ok' end as verdict"


@query(f"""select doc_id, total_chars, shared_chars, round(share, 9) as share, {_VERDICT} from (
  select doc_id, cast(sum(n_chars * uses) as bigint) as total_chars, cast(sum(case when h.hash is not null then n_chars * uses else 0 end) as bigint) as shared_chars,
    cast(sum(case when h.hash is not null then n_chars * uses else 0 end) as double) / sum(n_chars * uses) as share
  from {_sentences('documents', 'doc_id')} s left join (select distinct hash from {_sentences('benchmark', 'item_id')}) h using (hash) group by doc_id)""")
def overlap_share_benchmark(spark, d):
    return documents.overlap_share(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "item_id").withColumn("share", F.round("share", 9))


@query(f"""with s as {_sentences('documents', 'doc_id')}, f as (select hash, min(doc_id) as first from s group by hash)
  select doc_id, total_chars, shared_chars, round(share, 9) as share, {_VERDICT} from (
  select doc_id, cast(sum(n_chars * uses) as bigint) as total_chars, cast(sum(case when first < doc_id then n_chars * uses else 0 end) as bigint) as shared_chars,
    cast(sum(case when first < doc_id then n_chars * uses else 0 end) as double) / sum(n_chars * uses) as share from s join f using (hash) group by doc_id)""")
def overlap_ordered_inputs(spark, d):
    return documents.ordered_overlap(table(spark, d, "documents"), "doc_id").withColumn("share", F.round("share", 9))


_UNION_SHARE = f"""with s as {_sentences('documents', 'doc_id')}, e as (select distinct hash from {_sentences('benchmark', 'item_id')}), f as (select hash, min(doc_id) as first from s group by hash),
  m as (select s.doc_id, s.n_chars * s.uses as chars, e.hash is not null or f.first < s.doc_id as held from s join f using (hash) left join e using (hash))"""


@query(f"""{_UNION_SHARE} select doc_id, total_chars, shared_chars, round(share, 9) as share, {_VERDICT} from (select doc_id, cast(sum(chars) as bigint) as total_chars,
  cast(sum(case when held then chars else 0 end) as bigint) as shared_chars, cast(sum(case when held then chars else 0 end) as double) / sum(chars) as share from m group by doc_id)""")
def overlap_existing_and_earlier(spark, d):
    """Each document against the held-out items and the documents before it, together."""
    out = documents.ordered_overlap(table(spark, d, "documents"), "doc_id", existing=table(spark, d, "benchmark"))
    return out.withColumn("share", F.round("share", 9))


@query(f"""select * from (select doc_id, item_id, chars, row_number() over (partition by doc_id order by chars desc, item_id) as place, count(*) over (partition by doc_id) as n_holders from (
  select s.doc_id, h.item_id, cast(sum(s.n_chars * s.uses) as bigint) as chars from {_sentences('documents', 'doc_id')} s join {_sentences('benchmark', 'item_id')} h using (hash) group by all)) where place <= 3""", longs=("place", "n_holders"))
def overlap_attribution_top3(spark, d):
    return documents.attribution(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "item_id")


@query(f"""with s as {_sentences('documents', 'doc_id')}, c as (select s.doc_id, h.holder, cast(sum(s.n_chars * s.uses) as bigint) as chars from s join (select doc_id as holder, hash from s) h using (hash) group by all)
  select * from (select doc_id, holder, chars, row_number() over (partition by doc_id order by chars desc, holder) as place, count(*) over (partition by doc_id) as n_holders from c) where place <= 2""", longs=("place", "n_holders"))
def documents_attribution(spark, d):
    """The documents that hold most of each document's sentences, itself included: many share their licence notices."""
    docs = table(spark, d, "documents")
    return documents.attribution(docs, docs.select(F.col("doc_id").alias("holder"), F.col("text").alias("held")), "doc_id", "holder", 2, holder_text="held")


@query("select min(doc_id) as doc_id, count(*) as n_copies from documents where text is not null group by sha256(text)")
def exact_copy_first_kept(spark, d):
    return documents.first_copies(table(spark, d, "documents"), "doc_id")


@query(f"select doc_id, row_number() over (order by {_sha('split', 'doc_id')}, doc_id) > floor(cast(count(*) over () as double) * (1 - 0.1::double)) as held_out from documents")
def holdout_split(spark, d):
    return documents.split_held_out(table(spark, d, "documents").select("doc_id"), "doc_id", 0.1, 42)


@query("select fraction::double as fraction, (select min(n) from range(2, 2000) t(n) where floor(n * (1 - fraction::double)) between 1 and n - 1) as least from (values (0.05), (0.1), (0.25), (0.5), (0.75), (0.9)) v(fraction)")
def holdout_min_documents(spark, d):
    return spark.createDataFrame([(f, documents.min_documents_for_held_out(f)) for f in (0.05, 0.1, 0.25, 0.5, 0.75, 0.9)], "fraction double, least long")


@query("select doc_id, doc_id % 8 = 7 as held_out from documents")
def holdout_every_eighth(spark, d):
    return table(spark, d, "documents").select("doc_id", (F.pmod("doc_id", F.lit(8)) == 7).alias("held_out"))


@query(f"select doc_id, row_number() over (order by {_sha('shuffle', 'doc_id')}, doc_id) as rnk from documents qualify rnk <= 100", longs=("rnk",))
def seeded_shuffle_topn(spark, d):
    return documents.seeded_first(table(spark, d, "documents").select("doc_id"), "doc_id", 100, 42, "shuffle")


_STEMS = r"select doc_id, case when doc_id % 4 = 0 then stem || '_' || (doc_id % 7) else stem end as stem from (select doc_id, regexp_replace(coalesce(source, 'none'), '[^A-Za-z0-9._-]+', '--', 'g') as stem from documents)"


@query(rf"""with d as ({_STEMS}), taken as (select stem as name from d where doc_id % 10 = 0 union select stem || '_' || (doc_id % 5) from d where doc_id % 3 = 0),
  n as (select name, true as whole from taken union all select distinct stem, false from d),
  blocked as (select distinct * from (select regexp_extract(name, '^(.*)_(0|[1-9][0-9]*)$', 1) as stem, try_cast(regexp_extract(name, '^(.*)_(0|[1-9][0-9]*)$', 2) as bigint) as no from n) where no > 0 union select name, 0 from n where whole),
  sizes as (select stem, count(*) + (select count(*) from blocked) as most from d group by stem),
  free as (select stem, no, row_number() over (partition by stem order by no) as k from (select stem, unnest(range(0, most)) as no from sizes) anti join blocked using (stem, no)),
  j as (select doc_id, stem, row_number() over (partition by stem order by doc_id) as k from d)
  select doc_id, stem, case when no = 0 then stem else stem || '_' || no end as name from j join free using (stem, k)""")
def output_names(spark, d):
    """Names of documents by source, some stems ending like a number, some names and numbers taken already."""
    stem = text.slug(F.coalesce("source", F.lit("none")))
    stems = table(spark, d, "documents").select("doc_id", F.when(F.pmod("doc_id", F.lit(4)) == 0, F.concat(stem, F.lit("_"), F.pmod("doc_id", F.lit(7)))).otherwise(stem).alias("stem"))
    ends = stems.filter(F.pmod("doc_id", F.lit(3)) == 0).select(F.concat("stem", F.lit("_"), F.pmod("doc_id", F.lit(5))).alias("name"))
    taken = stems.filter(F.pmod("doc_id", F.lit(10)) == 0).select(F.col("stem").alias("name")).unionByName(ends).distinct()
    return documents.unique_names(stems, "stem", "doc_id", taken)


@query("select doc_format, doc_id, sha256(case when doc_id = min(doc_id) over (partition by doc_format) then '' else chr(10) || chr(10) || repeat('=', 80) || chr(10) || chr(10) end || '# Source: ' || doc_id || chr(10) || chr(10) || coalesce(text, '')) as block_hash from documents")
def combined_output(spark, d):
    docs = table(spark, d, "documents").select("doc_format", "doc_id", F.col("doc_id").cast("string").alias("name"), F.coalesce("text", F.lit("")).alias("text"))
    return documents.combined(docs, "doc_format", "name", "text", "doc_id").select("doc_format", "doc_id", text.fingerprint(F.col("block")).alias("block_hash"))


@query("""select source, sha256(count(*) || ':' || sum(('0x' || substring(h, 1, 12))::bigint) || ':' || sum(('0x' || substring(h, 13, 12))::bigint)) as fingerprint
  from (select source, sha256(doc_id || ':' || sha256(coalesce(text, ''))) as h from documents) group by source""")
def corpus_fingerprint(spark, d):
    return documents.corpus_fingerprint(table(spark, d, "documents"), "text", "doc_id", "source")


# --- chunks ---------------------------------------------------------------------------------------------------
_OFFSET = epoch_offset(3, 42, 512)


def _spans(source: str, o: str) -> str:
    """Spans of at least 10 tokens of (key, n) rows at offset o, numbered in order."""
    return f"""select k, cast(row_number() over (partition by k order by s) - 1 as int) as chunk_ix, s as "start", e as "end" from (
      select k, s, least(s + 512, o, n) as e from (select k, n, o, unnest(range(0, o, 512)) as s from (select k, n, {o} as o from {source})) union all
      select k, s, least(s + 512, n) as e from (select k, n, unnest(range(o, n, 512)) as s from (select k, n, {o} as o from {source}))) where e - s >= 10"""


_DOC_N = f"(select doc_id as k, n from {_N_WORDS})"


@query(f'select k as doc_id, chunk_ix, "start", "end" from ({_spans(_DOC_N, "0")})')
def chunk_bounds_epoch0(spark, d):
    return chunking.chunk_bounds(_word_counts(spark, d), "doc_id", "n")


@query(f'select k as doc_id, chunk_ix, "start", "end" from ({_spans(_DOC_N, f"case when n <= 512 then 0 else {_OFFSET} end")})')
def chunk_bounds_offset(spark, d):
    return chunking.chunk_bounds(_word_counts(spark, d), "doc_id", "n", _OFFSET)


@query("""select n::bigint as n, o as "offset", sum(case when e - s >= 10 then 1 else 0 end)::bigint as n_chunks, n - coalesce(sum(case when e - s >= 10 then e - s end), 0)::bigint as n_missing from (
  select n, off as o, unnest(list_concat(list_transform(range(0, o2, 512), lambda x: {'s': x, 'e': least(x + 512, o2, n)}), list_transform(range(o2, n, 512), lambda x: {'s': x, 'e': least(x + 512, n)})), recursive := true)
  from (select n, off, case when off between 1 and 9 or n <= 512 then 0 else off end as o2 from (values (513), (600), (700), (1024), (1500), (2049), (5000)) v(n), range(512) r(off))) group by n, o""")
def chunk_offset_sweep(spark, d):
    lengths = spark.createDataFrame([(n,) for n in (513, 600, 700, 1024, 1500, 2049, 5000)], "n long")
    sweep = lengths.select("n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(511).cast("long"))).alias("offset"))
    o = F.when(F.col("n") <= 512, F.lit(0)).when(F.col("offset").between(1, 9), F.lit(0)).otherwise(F.col("offset")).cast("long")
    cut = chunking.spans(F.col("n"), o)
    held = F.aggregate(cut, F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return sweep.select("n", "offset", F.size(cut).cast("long").alias("n_chunks"), (F.col("n") - held).alias("n_missing"))


@query(f'select d.k as doc_id, count(c.k) as n_chunks from {_DOC_N} d left join ({_spans(_DOC_N, f"case when n <= 512 then 0 else {_OFFSET} end")}) c on c.k = d.k group by d.k')
def chunk_count_closed_form(spark, d):
    n = F.col("n")
    return _word_counts(spark, d).select("doc_id", chunking.chunk_count(n, chunking.document_offset(n, _OFFSET)).alias("n_chunks"))


_PAIR_N = "(select pair_id, any_value(question) as question, any_value(answer) as answer from supplement group by pair_id)"
_PAIR_WORDS = f"(select pair_id, cast(coalesce(len({_words('question')}), 0) + coalesce(len({_words('answer')}), 0) as bigint) as n from {_PAIR_N})"


def _pairs(spark, d) -> DataFrame:
    """Distinct pairs with the words of question and answer."""
    once = first_delivery(table(spark, d, "supplement"), "pair_id", "loaded_at", {"question": F.col("question"), "answer": F.col("answer")})
    return once.select("pair_id", "question", "answer", (F.size(text.tokens(F.col("question"))) + F.size(text.tokens(F.col("answer")))).cast("long").alias("n"))


@query(f"""with x as (select doc_id as k, n, false as s from {_N_WORDS} union all select -pair_id, n, true from {_PAIR_WORDS}), c as ({_spans('x', '0')})
  select (select count(*) from x) as n_docs, (select count(*) from x where s) as n_supplement_docs, (select count(*) from x where n < 10) as n_short_docs,
    (select cast(sum(cast(ceil(n / 512.0) as bigint)) as bigint) from x) - (select count(*) from c) as n_dropped_short_chunks, (select count(*) from c) as n_chunks, (select cast(sum("end" - "start") as bigint) from c) as total_tokens""")
def chunk_report(spark, d):
    every = _word_counts(spark, d).select("n", F.lit(False).alias("s")).unionByName(_pairs(spark, d).select("n", F.lit(True).alias("s")))
    return chunking.chunk_report(every, "n", F.col("s"))


@query(f"""with c as (select k, count(*) as c from ({_spans(_DOC_N, '0')}) group by k), t as (select sum(c) as n_chunks, max(c) as most, arg_max(k, c * 1000000000000 - k) as dominant_doc from c)
  select cast(n_chunks as bigint) as n_chunks, (select cast(sum(n) as bigint) from {_N_WORDS}) as n_tokens, cast(ceil(ceil(n_chunks / 6.0)) as bigint) as steps_per_epoch, dominant_doc, round(most::double / n_chunks, 9) as dominant_share,
    ceil(n_chunks / 6.0) < 8 as few_steps, most::double / n_chunks > 0.5 as one_document_dominates, (select sum(n) from {_N_WORDS}) < 500000 as many_epochs_on_little_text from t""")
def dominant_document(spark, d):
    return chunking.shape_report(_word_counts(spark, d), "doc_id", "n").withColumn("dominant_share", F.round("dominant_share", 9))


@query(f"""select doc_id, batch, n as mask_ones, max(n) over (partition by batch) - n as n_padding from (
  select doc_id, n, cast(floor((row_number() over (order by {_sha('batch', 'doc_id')}, doc_id) - 1) / 6) as bigint) as batch from {_N_WORDS})""", longs=("mask_ones", "n_padding"))
def left_pad_batches(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.transform(text.tokens(F.col("text")), lambda w: F.xxhash64(w)).alias("ids"))
    out = chunking.batches(docs, "doc_id", "ids", 6, seed=42)
    return out.select("doc_id", "batch", "mask_ones", (F.size("padded") - F.col("mask_ones")).alias("n_padding"))


@query("""select n, cast(b as bigint) as "begin", cast(least(b + 2048, n) as bigint) as "end", cast(least(b + 2048, n) - lag(least(b + 2048, n), 1, 0) over (partition by n order by b) as bigint) as "new" from (
  select n, unnest(range(0, n, 512)) as b from (select unnest([1, 511, 512, 513, 2047, 2048, 2049, 4096, 10000])::bigint as n)) qualify "new" > 0""")
def sliding_window_plan(spark, d):
    n = spark.createDataFrame([(x,) for x in (1, 511, 512, 513, 2047, 2048, 2049, 4096, 10000)], "n long")
    return n.select("n", F.explode(chunking.scoring_windows(F.col("n"))).alias("w")).select("n", "w.begin", "w.end", "w.new")


# --- corpora --------------------------------------------------------------------------------------------------
_PREFIX = f"""with raw as (select sum(n)::double as raw from {_N_WORDS}), run as (select sum(n) over (order by {_sha('pairs', 'pair_id')}, pair_id) as cum, row_number() over (order by {_sha('pairs', 'pair_id')}, pair_id) as rnk from {_PAIR_WORDS}),
  cand as (select 0 as rnk, 0 as cum union all select rnk, cum from run), best as (select arg_min({{'rnk': rnk, 'cum': cum}}, {{'d': abs(cum / (raw + cum) - 0.13::double), 'n': rnk}}) as b, any_value(raw) as raw from cand, raw)"""


@query(f"""{_PREFIX} select cast(b.rnk as bigint) as n_pairs, cast(b.cum as bigint) as pair_tokens, round(b.cum / (raw + b.cum), 9) as achieved,
  b.rnk = (select count(*) from {_PAIR_WORDS}) and b.cum / (raw + b.cum) < 0.13::double - 1e-9::double as under_target from best""")
def supplement_prefix(spark, d):
    raw = _word_counts(spark, d).agg(F.sum("n").alias("raw"))
    return corpora.budget_prefix(_pairs(spark, d), "pair_id", "n", raw, 0.13).withColumn("achieved", F.round("achieved", 9))


@query(f"""{_PREFIX}, kept as (select pair_id, n from {_PAIR_WORDS} qualify row_number() over (order by {_sha('pairs', 'pair_id')}, pair_id) <= (select b.rnk from best)),
  both_ as (select false as is_supplement, doc_id as id, n from {_N_WORDS} union all select true, pair_id, n from kept)
  select is_supplement, id, n, row_number() over (order by {_sha('shuffle', "is_supplement::varchar || ':' || id", 43)}, is_supplement) as place from both_""")
def supplement_mix(spark, d):
    docs = _word_counts(spark, d).withColumnRenamed("doc_id", "id")
    return corpora.budget_mix(docs, _pairs(spark, d).select(F.col("pair_id").alias("id"), "n"), "id", "n", 0.13)


@query("select name, n, cast(floor(7777 * n / sum(n) over ()) as bigint) as quota from (values ('arxiv', 2000), ('book', 2000), ('dolly', 5000), ('oasst2', 5000), ('code_alpaca', 2000)) v(name, n)")
def allocate_quota(spark, d):
    return corpora.allocate(spark.createDataFrame([("arxiv", 2000), ("book", 2000), ("dolly", 5000), ("oasst2", 5000), ("code_alpaca", 2000)], "name string, n int"), 7777)


_WHOLE = r"coalesce(regexp_matches(trim(meta), '^\{.*\}$'), false)"
_URL = rf"case when {_WHOLE} then lower(regexp_extract(meta, '[\"'']url[\"'']\s*:\s*(?:\"([^\"]*)\"|''([^'']*)'')', 1) || regexp_extract(meta, '[\"'']url[\"'']\s*:\s*(?:\"([^\"]*)\"|''([^'']*)'')', 2)) else '' end"
_LABELLED = rf"""(select row_id, text, meta, unnest(list_filter([
    case when ({_WHOLE} and regexp_matches(meta, '[\"'']arxiv_id[\"'']\s*:')) or contains(url, 'arxiv') then 'redpajama_arxiv' end, case when contains(url, 'wikipedia') then 'redpajama_wikipedia' end, case when contains(url, 'github') then 'redpajama_github' end,
    case when contains(url, 'stackexchange') then 'redpajama_stackexchange' end, case when {_WHOLE} and contains(lower(meta), 'book') then 'redpajama_book' end,
    case when url <> '' and not regexp_matches(url, 'arxiv|wikipedia|github|stackexchange') then 'redpajama_web' end], lambda x: x is not null)) as source
  from (select row_id, text, meta, {_URL} as url from (select row_id, any_value(text) as text, any_value(meta) as meta from seed_corpus group by row_id)))"""


def _seed_rows(spark, d) -> DataFrame:
    return first_delivery(table(spark, d, "seed_corpus"), "row_id", "loaded_at", {c: F.col(c) for c in ("text", "meta")})


@query(f"select source, count(*) as n_rows, cast(sum(row_id) as bigint) as id_sum from {_LABELLED} group by source")
def source_predicates(spark, d):
    labelled = table(spark, d, "seed_corpus").select("row_id", F.explode(corpora.source_labels(F.col("meta"))).alias("source")).distinct()
    return labelled.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("row_id").alias("id_sum"))


_STRIP = r"regexp_replace(text, '^[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]+|[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]+$', '', 'g')"


@query(rf"""with h as (select * from {_LABELLED} qualify row_number() over (partition by source order by row_id) <= 150),
  p as (select * from h qualify row_number() over (partition by source order by sha256('42:sample:' || source || ':' || row_id)) <= 50)
  select source, row_id, sha256(substring(t, 1, 2048)) as text_hash from (select source, row_id, regexp_replace(text, '^[\t-\r\x{{1C}}-\x{{20}}\x{{85}}\p{{Z}}]+|[\t-\r\x{{1C}}-\x{{20}}\x{{85}}\p{{Z}}]+$', '', 'g') as t from p) where length(t) > 50""")
def multi_source_head_sample(spark, d):
    quotas = dict.fromkeys(corpora.DEFAULT_SAMPLES, 50)
    return corpora.head_samples(_seed_rows(spark, d), quotas).select("source", "row_id", text.fingerprint(F.col("text")).alias("text_hash"))


@query(rf"""with h as (select * from {_LABELLED} qualify row_number() over (partition by source order by row_id) <= 6000),
  p as (select * from h qualify row_number() over (partition by source order by sha256('42:sample:' || source || ':' || row_id)) <= 2000)
  select source, row_id, length(substring(t, 1, 2048)) as n_chars from (select source, row_id, regexp_replace(text, '^[\t-\r\x{{1C}}-\x{{20}}\x{{85}}\p{{Z}}]+|[\t-\r\x{{1C}}-\x{{20}}\x{{85}}\p{{Z}}]+$', '', 'g') as t from p) where length(t) > 50""", longs=("n_chars",))
def multi_source_default_sample(spark, d):
    """The default quotas, above the limit of Spark's own group limits."""
    return corpora.head_samples(_seed_rows(spark, d), corpora.DEFAULT_SAMPLES).select("source", "row_id", F.length("text").alias("n_chars"))


@query(f"""with d as (select doc_id as id, row_number() over (order by {_sha('mix:first', 'doc_id')}, doc_id) as r from documents where length(text) >= 1000), p as (select pair_id as id, row_number() over (order by {_sha('mix:second', 'pair_id')}, pair_id) as r from {_PAIR_WORDS}),
  s as (select least((select count(*) from d) / 10.0::double, (select count(*) from p) / 1.0::double) as scale),
  u as (select 'first' as side, id from d, s where r <= floor(scale * 10) union all select 'second', id from p, s where r <= floor(scale))
  select side, id, row_number() over (order by {_sha('shuffle', "side || ':' || id", 43)}, side) as place from u""")
def ratio_mix_10_1(spark, d):
    docs = table(spark, d, "documents").filter(F.length("text") >= 1000).select(F.col("doc_id").alias("id"))
    return corpora.ratio_mix(docs, _pairs(spark, d).select(F.col("pair_id").alias("id")), "id")


_ONCE = "(select row_id, any_value(prompt) as prompt, any_value(response) as response, any_value(source) as source from seed_corpus group by row_id)"
_PY_STRIP = r"'^[\t-\r\x{1C}-\x{20}\x{85}\p{Z}]+|[\t-\r\x{1C}-\x{20}\x{85}\p{Z}]+$', '', 'g'"


def _turns(spark, d) -> DataFrame:
    """The pairs written from one passage as a conversation: question and answer by turns, in the order of their ids."""
    pairs = _pairs(spark, d).select("pair_id", "question", "answer")
    places = first_delivery(table(spark, d, "supplement"), "pair_id", "loaded_at", {c: F.col(c) for c in ("source_index", "passage_index")})
    turns = F.array(*[F.struct((F.col("pair_id") * 2 + i).alias("turn"), F.lit(r).alias("role"), F.coalesce(c, F.lit("")).alias("text")) for i, (r, c) in enumerate((("user", "question"), ("assistant", "answer")))])
    return pairs.join(places, "pair_id").select(F.concat_ws("/", "source_index", "passage_index").alias("conversation"), F.explode(turns).alias("t")).select("conversation", "t.*")


@query(rf"""with p as (select pair_id, concat_ws('/', source_index, passage_index) as conversation, coalesce(question, '') as q, coalesce(answer, '') as a from (
    select pair_id, any_value(source_index) as source_index, any_value(passage_index) as passage_index, any_value(question) as question, any_value(answer) as answer from supplement group by pair_id)),
  t as (select conversation, pair_id * 2 as turn, 'User' as role, q as text from p union all select conversation, pair_id * 2 + 1, 'Assistant', a from p),
  s as (select *, regexp_replace(text, {_PY_STRIP}) as said from t),
  w as (select *, lead(said) over o as reply, string_agg(case when said <> '' then role || ': ' || said end, chr(10) || chr(10)) over (partition by conversation order by turn rows between unbounded preceding and 1 preceding) as before from s window o as (partition by conversation order by turn))
  select conversation, turn, sha256(case when before is not null then 'Conversation history:' || chr(10) || before || chr(10) || chr(10) || 'User: ' || said else said end) as prompt_hash, sha256(reply) as response_hash from w where role = 'User' and said <> '' and reply <> ''""")
def conversation_history_pairs(spark, d):
    pairs = corpora.turn_pairs(_turns(spark, d), "conversation", "turn")
    return pairs.select("conversation", "turn", text.fingerprint(F.col("prompt")).alias("prompt_hash"), text.fingerprint(F.col("response")).alias("response_hash"))


@query(rf"""with m as (select message_id, arg_max({{'p': parent_id, 'r': role, 'l': lang, 't': text}}, {{'a': loaded_at, 't': text}}) as v from messages group by message_id),
  x as (select message_id, v.p as parent_id, v.r as role, coalesce(v.l, 'en') as lang, regexp_replace(v.t, {_PY_STRIP}) as text from m)
  select p.message_id, c.message_id as reply_id, substring(p.text, 1, 2048) as prompt, substring(c.text, 1, 2048) as response from x p join x c on c.parent_id = p.message_id
  where p.role = 'prompter' and p.lang = 'en' and c.role = 'assistant' and length(p.text) > 20 and length(c.text) > 20""")
def conversation_forest_join(spark, d):
    return corpora.forest_pairs(table(spark, d, "messages"))


_SOURCE_NAME = r"replace(lower(regexp_replace(source, '^[ \t\r\n\x{A0}\x{3000}]+|[ \t\r\n\x{A0}\x{3000}]+$', '', 'g')), '-', '_')"


@query(rf"""with x as (select row_id, prompt, response, case when s is null or s = '' then 'unknown' else s end as source from (select row_id, prompt, response, {_SOURCE_NAME} as s from {_ONCE} where prompt is not null)),
  k as (select * from x qualify row_number() over (partition by source order by sha256('42:pairs:' || source || ':' || row_id), row_id) <= 90),
  g as (select row_id, source, substring(regexp_replace(prompt, {_PY_STRIP}), 1, 2048) as prompt, substring(regexp_replace(response, {_PY_STRIP}), 1, 2048) as response from k)
  select source, row_id, sha256(prompt) as prompt_hash, row_number() over (partition by source order by sha256('42:pairs:' || source || ':' || row_id), row_id) as taken from g where length(prompt) > 20 and length(response) > 20 qualify taken <= 30""", longs=("taken",))
def pair_quota_extract(spark, d):
    rows = first_delivery(table(spark, d, "seed_corpus"), "row_id", "loaded_at", {"prompt": F.col("prompt"), "response": F.col("response"), "source": source_name(F.col("source"))})
    return corpora.pair_quota(rows.filter("prompt is not null"), 30).select("source", "row_id", text.fingerprint(F.col("prompt")).alias("prompt_hash"), "taken")


@query(rf"""with x as (select row_id, prompt, response, case when s is null or s = '' then 'unknown' else s end as source from (select row_id, prompt, response, {_SOURCE_NAME} as s from {_ONCE} where prompt is not null)),
  k as (select * from x qualify row_number() over (partition by source order by sha256('42:pairs:' || source || ':' || row_id), row_id) <= 15000)
  select source, row_id, row_number() over (partition by source order by sha256('42:pairs:' || source || ':' || row_id), row_id) as taken from k
  where length(substring(regexp_replace(prompt, {_PY_STRIP}), 1, 2048)) > 20 and length(substring(regexp_replace(response, {_PY_STRIP}), 1, 2048)) > 20 qualify taken <= 5000""", longs=("taken",))
def pair_quota_default(spark, d):
    """The default quota, above the limit of Spark's own group limits."""
    rows = first_delivery(table(spark, d, "seed_corpus"), "row_id", "loaded_at", {"prompt": F.col("prompt"), "response": F.col("response"), "source": source_name(F.col("source"))})
    return corpora.pair_quota(rows.filter("prompt is not null"), 5000).select("source", "row_id", "taken")


@query(rf"""select row_id, sha256(case when x = '' then i else i || chr(10) || chr(10) || 'Context: ' || x end) as prompt_hash from (
  select row_id, regexp_replace(prompt, {_PY_STRIP}) as i, regexp_replace(coalesce(source, ''), {_PY_STRIP}) as x from {_ONCE} where prompt is not null) where i <> ''""")
def instruction_prompts(spark, d):
    rows = first_delivery(table(spark, d, "seed_corpus"), "row_id", "loaded_at", {c: F.col(c) for c in ("prompt", "source")})
    return rows.select("row_id", text.instruction_prompt(F.col("prompt"), F.col("source"), "Context").alias("p")).filter("p is not null").select("row_id", text.fingerprint(F.col("p")).alias("prompt_hash"))


@query(rf"""select row_id, sha256(t) as text_hash from (select row_id, case when row_id % 6 < 5 then text else nullif(trim(concat_ws(chr(10), prompt, response), ' '), '') end as t from (
  select row_id, any_value(text) as text, any_value(prompt) as prompt, any_value(response) as response from seed_corpus group by row_id))""")
def json_record_text(spark, d):
    """Records whose text stands in one field or another, after fields that hold a number or an object; or is a pair."""
    rows = first_delivery(table(spark, d, "seed_corpus"), "row_id", "loaded_at", {c: F.col(c) for c in ("text", "prompt", "response")})
    at = F.pmod("row_id", F.lit(6))
    own = [F.when(at == i, F.to_json(F.struct(*[F.col("row_id").alias(n) for n in TEXT_FIELDS[:i]], F.col("text").alias(name), F.lit("later").alias("z")))) for i, name in enumerate(TEXT_FIELDS)]
    pair = F.to_json(F.struct("prompt", "response", F.struct(F.lit("not text").alias("text")).alias("body")))
    return rows.select("row_id", text.fingerprint(record_text(F.coalesce(*own, pair))).alias("text_hash"))


# --- text -----------------------------------------------------------------------------------------------------
@query(f"select doc_id, length({_norm('text')}) as n_chars, sha256({_norm('text')}) as text_hash from documents where text is not null", longs=("n_chars",))
def char_normalise(spark, d):
    n = text.normalise_characters(F.col("text"))
    return table(spark, d, "documents").filter("text is not null").select("doc_id", n.alias("n")).select("doc_id", F.length("n").alias("n_chars"), text.fingerprint(F.col("n")).alias("text_hash"))


def _cleaned(source: str) -> str:
    """One round of the cleaning, as a select over (doc_id, t)."""
    steps = [
        ("<sup>(.*?)</sup>", r"\1"), ("<sub>(.*?)</sub>", r"\1"), ("</?span[^>]*>", ""), (r"(?s)\\\*\[{2,3}(.*?)\]{2,3}", r"\1"), (r"(?s)\[\[(.*?)\]\]", r"\1"), (r"\[\\\*\]", ""),
        (r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[([^\]]*)\]\([^)]*\)", r"\1"),
        # an escaped underscore by itself stays, those of a run lose their strokes
        (r"\\_", r"\x02"), (r"(^|[^\x02])\x02([^\x02]|$)", r"\1\\_\2"), (r"(^|[^\x02])\x02([^\x02]|$)", r"\1\\_\2"), (r"\x02", "_"),
        (r"(?m)^\*\*[^*]+\*\*$", ""), (r"\n-{3,}\n", r"\n\n"),
    ]
    c = "t"
    for pattern, to in steps:
        to = {r"\x02": "' || chr(2) || '", r"\n\n": "' || chr(10) || chr(10) || '"}.get(to, to)
        c = f"regexp_replace({c}, '{pattern}', '{to}', 'g')"
    plain = lambda x: rf"({x} <> '' and not regexp_matches({x}, '^(#|- |\* |\||> |\p{{Nd}}+[.] )'))"
    joined = f"array_to_string(list_transform(l, lambda x, i: case when i = 1 then '' when {plain('x')} and {plain('l[i - 1]')} then ' ' else chr(10) end || x), '')"
    return rf"""select doc_id, nfc_normalize(trim(regexp_replace(regexp_replace({joined}, '\n{{3,}}', chr(10) || chr(10), 'g'), ' {{2,}}', ' ', 'g'), ' ' || chr(10))) as t
      from (select doc_id, list_transform(string_split({c}, chr(10)), lambda x: trim(x, ' ')) as l from ({source}))"""


_CLEANED = _cleaned(_cleaned(_cleaned(f"select doc_id, {_norm('text')} as t from documents where text is not null")))


@query(f"select doc_id, length(t) as n_chars, sha256(t) as text_hash from ({_CLEANED})", longs=("n_chars",))
def clean_text(spark, d):
    cleaned = table(spark, d, "documents").filter("text is not null").select("doc_id", folds.clean_text(F.col("text")).alias("text"))
    return cleaned.select("doc_id", F.length("text").alias("n_chars"), text.fingerprint(F.col("text")).alias("text_hash"))


_CELL = "trim(regexp_replace(coalesce({c}, ''), '[ \\t\\r\\n\\f\\x{{A0}}]+', ' ', 'g'))"


@query(f"""select doc_id, '# ' || {_CELL.format(c="coalesce(title, 'untitled')")} || chr(10) || chr(10) || '```' || chr(10) || regexp_replace(text, '^\n+|\n+$', '', 'g') || chr(10) || '```' || chr(10) || chr(10)
  || '| lang | source |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || {_CELL.format(c='lang')} || ' | ' || {_CELL.format(c='source')} || ' |' as text from documents where text is not null""")
def html_to_text(spark, d):
    """Pages with boilerplate, a heading, the text as code and a table; code keeps its lines and spaces."""
    escaped = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    table_ = F.concat(F.lit("<table><tr><th>lang</th><th>source</th></tr><tr><td>"), escaped("lang"), F.lit("</td><td>"), escaped("source"), F.lit("</td></tr></table>"))
    page = F.concat(F.lit("<html><head><title>x</title></head><body><nav>menu</nav><h1>"), escaped(F.coalesce("title", F.lit("untitled"))), F.lit("</h1><pre><code>"), escaped("text"), F.lit("</code></pre>"), table_, F.lit("<footer>end</footer></body></html>"))
    return table(spark, d, "documents").filter("text is not null").select("doc_id", folds.html_to_markdown_column(page).alias("text"))


@query()
def split_documents_3500(spark, d):
    pieces = table(spark, d, "documents").select("doc_id", F.posexplode(folds.split_documents_column(folds.clean_text(F.col("text")))).alias("piece", "text"))
    return pieces.select("doc_id", "piece", F.concat_ws("_", F.col("doc_id").cast("string"), F.lpad((F.col("piece") + 1).cast("string"), 4, "0")).alias("name"), F.length("text").alias("n_chars"), text.fingerprint(F.col("text")).alias("text_hash"))


@query(rf"select doc_id, length(regexp_replace({_norm('text')}, '[ \n]', '', 'g')) as n_visible from documents where length(regexp_replace({_norm('text')}, '[ \n]', '', 'g')) > 0", longs=("n_visible",))
def split_no_text_lost(spark, d):
    pieces = table(spark, d, "documents").select("doc_id", F.explode(folds.split_documents_column(text.normalise_characters(F.col("text")))).alias("text"))
    return pieces.groupBy("doc_id").agg(F.sum(F.length(F.regexp_replace("text", "[ \\n]", ""))).cast("int").alias("n_visible"))


@query(r"""select doc_id, generate_subscripts(done, 1) - 1 as passage_index, unnest(done) as passage from (
  select doc_id, list_filter(list_reduce(list_transform(ps, lambda p: {'done': [p], 'held': length(p)}), lambda a, x: case when len(a.done) > 0 and a.held + x.held <= 4000
      then {'done': list_append(a.done[:-2], a.done[-1] || chr(10) || chr(10) || x.done[1]), 'held': a.held + x.held + 2} else {'done': list_append(a.done, x.done[1]), 'held': x.held} end, {'done': []::varchar[], 'held': 0::bigint}).done, lambda d: length(d) >= 200) as done
  from (select doc_id, list_filter(string_split(text, chr(10) || chr(10)), lambda p: regexp_matches(p, '[^\t-\r\x{1C}-\x{20}\x{85}\p{Z}]')) as ps from documents where text is not null))""", longs=("passage_index",))
def passages_4000(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(folds.passages_column(F.col("text"))).alias("passage_index", "passage"))


@query(f"""select doc_id, round(case when len(w) < 8 then 0 else 1 - len(list_distinct(g)) / len(g)::double end, 9) as repeat_share from (
  select doc_id, w, list_transform(range(1, greatest(len(w) - 6, 1)), lambda i: array_to_string(w[i:i + 7], ' ')) as g from (select doc_id, {_words('text')} as w from documents where text is not null))""")
def repeat_8gram_filter(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.round(text.repeat_share(F.col("text")), 9).alias("repeat_share"))


@query("select doc_id, sha256(trim(split_part(split_part(text, '. The ', 1), '. A ', 1), ' ')) as text_hash from documents where text is not null")
def clean_raw_marker(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", text.fingerprint(text.cut_at_marker(F.col("text"), [". The ", ". A "])).alias("text_hash"))


@query("select doc_id, (length(text) - length(replace(text, 'the ', ''))) // 4 as n_the from documents where text is not null and contains(text, 'the ')")
def substring_occurrences(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").filter(t.contains("the ")).select("doc_id", ((F.length(t) - F.length(F.replace(t, F.lit("the "), F.lit("")))) / 4).cast("long").alias("n_the"))


@query(f"select token, count(*) as n, round(count(*) / (sum(count(*)) over ())::double, 12) as freq from (select unnest({_words('text')}) as token from documents where text is not null) group by token")
def token_frequencies(spark, d):
    from lodestone.operators.vectors import token_frequencies as counted

    return counted(table(spark, d, "documents").select(text.tokens(F.col("text")).alias("w")), "w").withColumn("freq", F.round("freq", 12))


@query(r"""select reason, count(x.pair_id) as n from (values ('leaked_json'), ('short_answer')) r(reason) left join (
  select pair_id, case when regexp_matches(coalesce(question, ''), '"(question|answer)"\s*:|\{\s*"(question|answer)"') then 'leaked_json' when length(regexp_replace(coalesce(answer, ''), """ + _PY_STRIP + r""")) < 40 then 'short_answer' end as reason
  from (select pair_id, any_value(question) as question, any_value(answer) as answer from supplement group by pair_id)) x using (reason) group by reason""")
def answer_length_tally(spark, d):
    p = _pairs(spark, d)
    q, a = F.coalesce("question", F.lit("")), text.trim_space(F.coalesce("answer", F.lit("")))
    return corpora.rejection_tally(p.select(F.when(q.rlike(text.LEAKED_JSON), "leaked_json").when(F.length(a) < 40, "short_answer").alias("reason")).filter("reason is not null"), ["leaked_json", "short_answer"])


#: The patterns of ``functions.text`` for an engine without look-ahead: what a match must not go on with is a second, longer pattern, and
#: a text has such a match if it has fewer of the longer than of the shorter.
_PASSAGE = r"\b(?:the|this|that)\s+(?:(?:given|provided|above|original|same)\s+)?(?:passage|excerpt)\b"
_FROM_PASSAGE = r"\b(?:in|from|according\s+to|based\s+on|within)\s+(?:the|this|that)\s+(?:(?:given|provided|above|original|same)\s+)?(?:passage|excerpt)\b"
_FROM_TEXT = r"\b(?:according\s+to|in|from|based\s+on|within|by)\s+(?:the|this)\s+(?:(?:given|provided|above|original|same)\s+)?text\b"
_OF_TEXT = r"\bin\s+the\s+context\s+of\s+the\s+text\b"


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


def _more(c: str, pattern: str, not_then: str) -> str:
    return f"len(regexp_extract_all({c}, '(?i){_q(pattern)}')) > len(regexp_extract_all({c}, '(?i){_q(pattern + not_then)}'))"


def _cites(c: str) -> str:
    plain = "|".join(p.replace("(?i)", "") for p in text.SOURCE_TEXT.split("|" + r"\b(?:the|this)\s+(?:given", 1)[1:])
    plain = r"\b(?:the|this)\s+(?:given" + plain.split(r"|\bin\s+the\s+context")[0]
    return f"({_more(c, _PASSAGE, r'\s+(?:of|through|to|from|between|across|into|way)\b')} or {_more(c, _FROM_PASSAGE, r'\s+(?:of|from)\b')} or {_more(c, _FROM_TEXT, r'\s+of\b')} or {_more(c, _OF_TEXT, r'\s*\w')} or regexp_matches({c}, '(?i){_q(plain)}'))"


_JSON_ANSWER = text.JSON_ANSWER
_REFERS = f"({_cites('q')} or {_cites('a')} or (regexp_matches(a, '{_q(text.AUTHOR_REPORTS)}') and not regexp_matches(q, '{_q(text.NAMES_AUTHOR)}')))"
_LEAKS = f"(regexp_matches(q, '{_q(text.LEAKED_JSON)}') or regexp_matches(a, '{_q(_JSON_ANSWER)}'))"


_TURN = r"regexp_replace(split_part(coalesce(answer, ''), '<|im_end|>', 1), '^\s*<think>\s*</think>\s*', '')"


@query(f"""with p as (select pair_id, coalesce(question, '') as q, regexp_replace({_TURN}, {_PY_STRIP}) as a from {_PAIR_N}),
  r as (select case when {_LEAKS} then 'leaked_json' when {_REFERS} then 'refers_to_source' when length(a) < 40 then 'short_answer' end as reason from p)
  select v.reason, count(r.reason) as n from (values {', '.join(f"('{x}')" for x in REASONS)}) v(reason) left join r using (reason) group by v.reason""")
def question_filter_tally(spark, d):
    judged = judged_answers(_pairs(spark, d).withColumn("output", F.concat(F.coalesce("answer", F.lit("")), F.lit("<|im_end|>"))), "question", "output", ["<|im_end|>"])
    return corpora.rejection_tally(judged.filter("reason is not null"), REASONS)


_TIDY = r"trim(regexp_replace(coalesce(question, ''), '[^A-Za-z0-9?]+', ' ', 'g'))"


@query(f"""with p as (select pair_id, {_TIDY} as q, '' as a from {_PAIR_N}), f as (select *, case when not regexp_matches(q, '[A-Za-z0-9]') then 'unparseable_passage' when {_LEAKS} then 'leaked_json' when {_cites('q')} then 'refers_to_source' end as reason from p)
  select pair_id, coalesce(reason, case when pair_id > min(case when reason is null then pair_id end) over (partition by q) then 'duplicate' end) as reason from f""")
def first_pass_reasons(spark, d):
    """The first pass of a supplement: a writer's questions judged, each a duplicate of an equal one kept earlier."""
    outputs = _pairs(spark, d).select("pair_id", F.to_json(F.array(F.trim(F.regexp_replace(F.coalesce("question", F.lit("")), "[^A-Za-z0-9?]+", " ")))).alias("output"))
    return judged_questions(outputs, ["pair_id"], "output").select("pair_id", "reason")


@query(f"""select pair_id, case when not regexp_matches(q, '[A-Za-z0-9]') or (pair_id % 5 = 4 and not ends_with(q, '?')) then [] else [q] end as questions from (select pair_id, {_TIDY} as q from {_PAIR_N})""")
def parsed_questions(spark, d):
    """Every question as a writer may put it: in a JSON array, as an object's field, in single quotes, in an array that is broken
    off, on a line of its own."""
    q = F.trim(F.regexp_replace(F.coalesce("question", F.lit("")), "[^A-Za-z0-9?]+", " "))
    shapes = [('Here they are: ["', '"] done'), ('[1] then [{"answer": "None.", "question": "', '"}]'), ("I ask: ['", "'] and so on"), ('[{"question": "', '", "answer": "It is cut'), ("My questions\n  3. ", "\nwere these.")]
    at = F.pmod("pair_id", F.lit(5))
    written = F.coalesce(*[F.when(at == i, F.concat(F.lit(a), q, F.lit(b))) for i, (a, b) in enumerate(shapes)])
    return _pairs(spark, d).select("pair_id", folds.parse_questions_column(written).alias("questions"))


_GENERIC = ", ".join(f"'{n}'" for n in text.GENERIC_NAMES)


@query(f"""select source, path, coalesce(list_filter(list_transform(list_reverse(string_split(regexp_replace(path, '[.][A-Za-z0-9]{{1,5}}$', ''), '/')), lambda x: trim(regexp_replace(x, '[_-]+', ' ', 'g'))), lambda x: x <> '' and lower(x) not in ({_GENERIC}))[1], 'the domain') as domain
  from (select distinct source, unnest(['/data/' || coalesce(source, '') || '/train', 'corpus/' || coalesce(source, '') || '.v2', 'texts/Held_Out/' || coalesce(source, '-') || '/clean/docs.txt']) as path from documents)""")
def domain_names(spark, d):
    s = F.coalesce("source", F.lit(""))
    paths = F.array(F.concat(F.lit("/data/"), s, F.lit("/train")), F.concat(F.lit("corpus/"), s, F.lit(".v2")), F.concat(F.lit("texts/Held_Out/"), F.coalesce("source", F.lit("-")), F.lit("/clean/docs.txt")))
    own = table(spark, d, "documents").select("source").distinct().select("source", F.explode(paths).alias("path"))
    return own.select("source", "path", text.domain_of_path(F.col("path")).alias("domain"))


@query("""select case when n < 3 then 'rejected' when n % 5 = 0 then 'rejected' else 'kept' end as outcome, count(*) as n from (select g % 9 as n from range(450) r(g)) group by 1""")
def generated_tally(spark, d):
    """Draws of a stand-in generator: too short, looping, or kept."""
    del d
    draw = lambda ids: ["one two three four five six seven eight nine. " * (5 if i % 9 % 5 == 0 else 1) + " ".join(f"w{i}x{k}" for k in range(0 if i % 9 < 3 else 60)) if i % 9 % 5 else "la " * (400 if i % 9 >= 3 else 2) for i in ids]
    kept, tally = generated_share(spark, draw, 450, ["<end>"], min_chars=200, max_repeat=0.5)
    return spark.createDataFrame([("kept", kept.count()), ("rejected", tally["rejected"])], "outcome string, n long")


@query(f"select doc_id, {_sha('order', 'doc_id')} as key from documents")
def seeded_order_keys(spark, d):
    return table(spark, d, "documents").select("doc_id", order_key(42, "order", F.col("doc_id")).alias("key"))
