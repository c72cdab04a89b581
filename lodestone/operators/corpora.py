"""Corpora of several sources: predicates, quotas, pair extraction, ratio and budget mixes, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.seeded import order_key
from lodestone.functions.text import trim_space
from lodestone.operators.ranking import first_of_each, with_prefix

MIN_TEXT, MIN_SIDE, MAX_CHARS = 50, 20, 2048
#: The samples each source gives by default.
DEFAULT_SAMPLES = {"redpajama_arxiv": 2000, "redpajama_wikipedia": 2000, "redpajama_github": 2000, "redpajama_stackexchange": 2000, "redpajama_book": 2000, "redpajama_web": 2000}

#: How many rows of each source the composed corpus has, text and instruction rows.
COMPOSITION = {
    "pretraining": {"redpajama_arxiv": 1524, "redpajama_book": 1998, "redpajama_wikipedia": 1995, "redpajama_stackexchange": 2000, "redpajama_web": 1999, "redpajama_github": 147},
    "instruction": {"dolly": 203, "alpaca": 231, "code_alpaca": 96, "ultrachat": 212, "oasst2": 224},
}


def composition_differences(corpus: DataFrame, side: str = "side", source: str = "source", recorded: dict[str, dict[str, int]] = COMPOSITION) -> DataFrame:
    """``side, source, n, recorded``: the sources of a composed corpus whose rows aren't as many as recorded; a source that only one of
    the two has counts 0 in the other."""
    known = corpus.sparkSession.createDataFrame([(k, s, n) for k, part in recorded.items() for s, n in part.items()], "_side string, _source string, recorded long")
    counts = corpus.groupBy(F.col(side).alias("side"), F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    both = counts.join(known, F.col("side").eqNullSafe(F.col("_side")) & F.col("source").eqNullSafe(F.col("_source")), "full")
    out = both.select(F.coalesce("side", "_side").alias("side"), F.coalesce("source", "_source").alias("source"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("recorded", F.lit(0)).alias("recorded"))
    return out.filter("n <> recorded")


def meta_url(meta: Column) -> Column:
    """The lower-case ``url`` of a meta field, a JSON or Python literal; the empty string where there is none, or where
    the literal is cut short (an unreadable field counts as empty)."""
    whole = F.trim(meta).rlike("^\\{.*\\}$")
    url = F.regexp_extract(meta, "[\"']url[\"']\\s*:\\s*(?:\"([^\"]*)\"|'([^']*)')", 1)
    alt = F.regexp_extract(meta, "[\"']url[\"']\\s*:\\s*(?:\"([^\"]*)\"|'([^']*)')", 2)
    return F.when(whole, F.lower(F.concat(url, alt))).otherwise(F.lit(""))


def source_labels(meta: Column) -> Column:
    """Every source whose predicate a meta field meets; a row may meet several. Null and unreadable meta meet none."""
    url = meta_url(meta)
    whole = F.coalesce(F.trim(meta).rlike("^\\{.*\\}$"), F.lit(False))
    has_id = whole & meta.rlike("[\"']arxiv_id[\"']\\s*:")
    other = url.contains("arxiv") | url.contains("wikipedia") | url.contains("github") | url.contains("stackexchange")
    rules = {
        "redpajama_arxiv": has_id | url.contains("arxiv"), "redpajama_wikipedia": url.contains("wikipedia"), "redpajama_github": url.contains("github"),
        "redpajama_stackexchange": url.contains("stackexchange"), "redpajama_book": whole & F.lower(meta).contains("book"), "redpajama_web": (url != "") & ~other,
    }
    return F.filter(F.array(*[F.when(F.coalesce(r, F.lit(False)), F.lit(n)) for n, r in rules.items()]), lambda x: x.isNotNull())


def allocate(defaults: DataFrame, total: int) -> DataFrame:
    """``defaults`` (name, n) with ``quota`` = floor(total * n / sum of n)."""
    whole = F.sum("n").over(Window.partitionBy())  # one row a source
    return defaults.withColumn("quota", F.coalesce(F.floor(F.try_divide(F.lit(total) * F.col("n"), whole)), F.lit(0)).cast("long"))


def head_samples(rows: DataFrame, quotas: dict[str, int], seed: int = 42, id_column: str = "row_id", scan: int = 3) -> DataFrame:
    """``source, row_id, text``: of each source's first ``scan`` times quota matches in id order, a seeded sample of the
    quota; stripped, over MIN_TEXT characters, cut to MAX_CHARS. One scan serves all sources; both limits shuffle the rows near
    them alone (``ranking.first_of_each``). The text is joined back to the sampled ids."""
    labelled = rows.select(F.col(id_column), F.explode(source_labels(F.col("meta"))).alias("source"))
    quota = F.create_map(*[x for n, q in quotas.items() for x in (F.lit(n), F.lit(q))])[F.col("source")]
    asked = labelled.withColumn("quota", quota).filter("quota > 0")
    head = first_of_each(asked, "source", scan * F.col("quota"), order=id_column).drop("place")
    picked = first_of_each(head, "source", F.col("quota"), key=order_key(seed, "sample", F.col("source"), F.col(id_column)), tie=id_column)
    texts = rows.select(id_column, trim_space(F.col("text")).alias("text"))
    return picked.select("source", id_column).join(texts, id_column).filter(F.length("text") > MIN_TEXT).withColumn("text", F.substring("text", 1, MAX_CHARS))


def pair_quota(pairs: DataFrame, quota: int, seed: int = 42, id_column: str = "row_id", scan: int = 3) -> DataFrame:
    """Of each source's seeded ``scan`` * quota rows, the first ``quota`` usable pairs: both sides over MIN_SIDE characters,
    after cutting to MAX_CHARS. Columns ``source, row_id, prompt, response, taken``."""
    keyed = pairs.withColumn("k", order_key(seed, "pairs", F.col("source"), F.col(id_column)))
    some = first_of_each(keyed, "source", scan * quota, key=F.col("k"), tie=id_column).drop("place")
    cut = some.withColumns({"prompt": F.substring(trim_space(F.col("prompt")), 1, MAX_CHARS), "response": F.substring(trim_space(F.col("response")), 1, MAX_CHARS)})
    good = cut.filter((F.length("prompt") > MIN_SIDE) & (F.length("response") > MIN_SIDE))
    return first_of_each(good, "source", quota, key=F.col("k"), tie=id_column).select("source", id_column, "prompt", "response", F.col("place").alias("taken"))


def forest_pairs(messages: DataFrame, lang: str = "en") -> DataFrame:
    """``message_id, reply_id, prompt, response`` of every prompter message in ``lang`` with each of its assistant replies.

    A message id that occurs again keeps its latest delivery; a null language counts as ``lang``; the reply's language
    isn't looked at. Both sides have over MIN_SIDE characters, then are cut to MAX_CHARS. A very popular parent
    is one key of an equi-join whose sides AQE may split."""
    content = F.struct("parent_id", "role", "lang", "text")
    last = messages.groupBy("message_id").agg(F.max_by(content, F.struct("loaded_at", "text")).alias("m")).select("message_id", "m.*")
    text = trim_space(F.col("text"))
    long = F.length(text) > MIN_SIDE
    asked = last.filter((F.col("role") == "prompter") & (F.coalesce("lang", F.lit(lang)) == lang) & long).select("message_id", text.alias("prompt"))
    said = last.filter((F.col("role") == "assistant") & long & F.col("parent_id").isNotNull()).select(F.col("message_id").alias("reply_id"), F.col("parent_id").alias("message_id"), text.alias("response"))
    return asked.join(said, "message_id").select("message_id", "reply_id", F.substring("prompt", 1, MAX_CHARS).alias("prompt"), F.substring("response", 1, MAX_CHARS).alias("response"))


def turn_pairs(turns: DataFrame, conversation: str, turn: str, role: str = "role", text: str = "text") -> DataFrame:
    """Each user turn with the assistant turn right after it: ``conversation, turn, prompt, response``, the prompt opening
    with the conversation so far. Turns of one conversation meet in one task; conversations are short."""
    w = Window.partitionBy(conversation).orderBy(turn)
    said = F.when(trim_space(F.col(text)) != "", F.concat(F.initcap(role), F.lit(": "), trim_space(F.col(text))))
    seen = turns.withColumns({"_next_role": F.lead(role).over(w), "_next": F.lead(text).over(w), "_said": F.array_compact(F.collect_list(said).over(w.rowsBetween(Window.unboundedPreceding, -1)))})
    pair = seen.filter((F.col(role) == "user") & (F.col("_next_role") == "assistant"))
    own, reply = trim_space(F.col(text)), trim_space(F.col("_next"))
    prompt = F.when(F.size("_said") > 0, F.concat(F.lit("Conversation history:\n"), F.array_join("_said", "\n\n"), F.lit("\n\nUser: "), own)).otherwise(own)
    return pair.filter((own != "") & (reply != "")).select(conversation, turn, prompt.alias("prompt"), reply.alias("response"))


def _beside(df: DataFrame, one: DataFrame) -> DataFrame:
    """``df`` with the columns of a table of one row."""
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(one.withColumn("_one", F.lit(1))), "_one").drop("_one")


def ratio_mix(first: DataFrame, second: DataFrame, id_column: str, weights: tuple[int, int] = (10, 1), seed: int = 42) -> DataFrame:
    """``side, id_column, place``: seeded samples of two sides in the ratio of the weights, as large as the shorter side
    allows, shuffled together. One side empty gives nothing. The sides are counted in the plan itself."""
    counts = _beside(first.agg(F.count(F.lit(1)).alias("_n1")), second.agg(F.count(F.lit(1)).alias("_n2")))
    scale = counts.select(F.least(F.col("_n1") / F.lit(float(weights[0])), F.col("_n2") / F.lit(float(weights[1]))).alias("_scale"))
    parts = []
    for name, side, weight in zip(("first", "second"), (first, second), weights):
        ranked = with_prefix(side.select(id_column), order_key(seed, "mix:" + name, F.col(id_column)), tie=id_column)
        parts.append(_beside(ranked, scale).filter(F.col("rnk") <= F.floor(F.col("_scale") * weight)).select(F.lit(name).alias("side"), id_column))
    both = parts[0].unionByName(parts[1])
    return with_prefix(both, order_key(seed + 1, "shuffle", F.col("side"), F.col(id_column)), tie="side").withColumnRenamed("rnk", "place")


def budget_prefix(pairs: DataFrame, id_column: str, n: str, raw_tokens: int | DataFrame, target: float, seed: int = 42) -> DataFrame:
    """One row ``n_pairs, pair_tokens, achieved, under_target``: how many pairs, in seeded order, bring their share of all
    tokens closest to the target; the fewer of two that are as close. ``raw_tokens`` is a number, or a table of one row
    with a column ``raw``."""
    if not 0 <= target < 1:
        raise ValueError("the target share must be at least 0 and below 1")
    given = pairs.sparkSession.range(1).select(F.lit(raw_tokens).alias("raw")) if isinstance(raw_tokens, int) else raw_tokens
    raw = given.select(F.coalesce("raw", F.lit(0)).cast("long").alias("_raw"))
    run = with_prefix(pairs.select(id_column, F.col(n).cast("long").alias("_n")), order_key(seed, "pairs", F.col(id_column)), {"cum": F.col("_n")}, tie=id_column)
    need = F.lit(target / (1 - target)) * F.col("_raw")
    # the candidates are the last count within the need and the next one; both are single rows of partial aggregates
    ends = _beside(run, raw).agg(F.max(F.when(F.col("cum") <= need, F.struct("rnk", "cum"))).alias("k"), F.min(F.when(F.col("cum") > need, F.struct("rnk", "cum"))).alias("j"), F.count(F.lit(1)).alias("pool"))
    share = lambda c: F.coalesce(F.try_divide(c.cast("double"), (c + F.col("_raw")).cast("double")), F.lit(0.0))
    k = _beside(ends, raw).select("_raw", "pool", F.coalesce(F.col("k.rnk"), F.lit(0)).alias("kn"), F.coalesce(F.col("k.cum"), F.lit(0)).alias("kc"), F.col("j.rnk").alias("jn"), F.col("j.cum").alias("jc"))
    none = F.lit(target == 0) | (F.col("_raw") == 0)
    nearer = ~none & F.col("jn").isNotNull() & (F.abs(share(F.col("jc")) - target) < F.abs(share(F.col("kc")) - target))
    out = k.select(F.when(none, 0).when(nearer, F.col("jn")).otherwise(F.col("kn")).cast("long").alias("n_pairs"), F.when(none, 0).when(nearer, F.col("jc")).otherwise(F.col("kc")).cast("long").alias("pair_tokens"), "pool", "_raw")
    return out.select("n_pairs", "pair_tokens", share(F.col("pair_tokens")).alias("achieved"), ((F.col("n_pairs") == F.col("pool")) & (share(F.col("pair_tokens")) < target - 1e-9) & F.lit(target > 0)).alias("under_target"))


def budget_mix(documents: DataFrame, pairs: DataFrame, id_column: str, n: str, target: float, seed: int = 42) -> DataFrame:
    """``is_supplement, id_column, n, place``: all documents and the budgeted prefix of the pairs, shuffled together."""
    taken = budget_prefix(pairs, id_column, n, documents.agg(F.sum(n).alias("raw")), target, seed).select(F.col("n_pairs").alias("_taken"))
    ranked = with_prefix(pairs.select(id_column, n), order_key(seed, "pairs", F.col(id_column)), tie=id_column)
    kept = _beside(ranked, taken).filter(F.col("rnk") <= F.col("_taken"))
    both = documents.select(F.lit(False).alias("is_supplement"), id_column, n).unionByName(kept.select(F.lit(True).alias("is_supplement"), id_column, n))
    return with_prefix(both, order_key(seed + 1, "shuffle", F.col("is_supplement").cast("string"), F.col(id_column)), tie="is_supplement").withColumnRenamed("rnk", "place")


def corpus_statistics(rows: DataFrame, source: Column, chars: Column) -> DataFrame:
    """``source, n_rows, n_chars, n_tokens, mean_chars``; a missing source is ``unknown``, a token four characters."""
    one = rows.select(F.coalesce(source, F.lit("unknown")).alias("source"), F.coalesce(chars, F.lit(0)).alias("c"))
    return one.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("c").alias("n_chars"), F.floor(F.sum("c") / F.lit(4)).cast("long").alias("n_tokens"), F.avg("c").alias("mean_chars"))


def rejection_tally(questions: DataFrame, reasons: list[str]) -> DataFrame:
    """``reason, n`` for each of the reasons, 0 where none was rejected for it."""
    every = questions.sparkSession.createDataFrame([(r,) for r in reasons], "reason string")
    return every.join(questions.groupBy("reason").count(), "reason", "left").select("reason", F.coalesce("count", F.lit(0)).alias("n"))
