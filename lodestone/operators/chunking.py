"""Token chunks with a rotating offset, their counts and reports, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.seeded import order_key
from lodestone.operators.ranking import with_prefix

LENGTH, MIN_TOKENS = 512, 10


def document_offset(n: Column, offset: int, length: int = LENGTH, keep_short_whole: bool = True) -> Column:
    """The offset a document is cut at: 0 for offsets under MIN_TOKENS, and for a short document kept whole."""
    o = F.lit(0 if 0 < offset < MIN_TOKENS else offset).cast("long")
    return F.when(n <= length, F.lit(0).cast("long")).otherwise(o) if keep_short_whole else o


def spans(n: Column, o: Column, length: int = LENGTH, stride: int = LENGTH) -> Column:
    """``array<struct<start, end>>`` of the chunks of n tokens at offset o; pieces under MIN_TOKENS are left out."""
    none = F.array().cast("array<struct<start: bigint, end: bigint>>")
    step = F.lit(stride).cast("long")

    def span(s: Column, limit: Column) -> Column:
        return F.struct(s.cast("long").alias("start"), F.least(s + length, limit).cast("long").alias("end"))

    lead = F.when(o > 0, F.transform(F.sequence(F.lit(0).cast("long"), o - 1, step), lambda s: span(s, F.least(o, n)))).otherwise(none)
    rest = F.when(n > o, F.transform(F.sequence(o, n - 1, step), lambda s: span(s, n))).otherwise(none)
    return F.filter(F.concat(lead, rest), lambda x: x["end"] - x["start"] >= MIN_TOKENS)


def chunk_bounds(df: DataFrame, id_column: str, n: str, offset: int = 0, length: int = LENGTH, stride: int = LENGTH, keep_short_whole: bool = True) -> DataFrame:
    """``id_column, chunk_ix, start, end`` of every chunk; documents without a chunk have no row."""
    n_ = F.col(n).cast("long")
    cut = df.select(id_column, F.posexplode(spans(n_, document_offset(n_, offset, length, keep_short_whole), length, stride)).alias("chunk_ix", "c"))
    return cut.select(id_column, "chunk_ix", F.col("c.start").alias("start"), F.col("c.end").alias("end"))


def chunk_count(n: Column, o: Column, length: int = LENGTH, stride: int = LENGTH) -> Column:
    """How many chunks ``spans`` gives, in closed form: all strides of either part but the last ones left too short."""

    def kept(m: Column) -> Column:  # spans [s, min(s + length, m)) for s = 0, stride, … < m that hold MIN_TOKENS
        return F.when(m < MIN_TOKENS, F.lit(0)).otherwise(F.floor((m - MIN_TOKENS) / F.lit(stride)) + 1)

    return (F.when(o > 0, kept(F.least(o, n))).otherwise(F.lit(0)) + kept(F.greatest(n - o, F.lit(0)))).cast("long")


def chunk_ids(ids: Column, start: Column, end: Column) -> Column:
    """The token ids of one chunk."""
    return F.slice(ids, (start + 1).cast("int"), (end - start).cast("int"))


def chunk_report(df: DataFrame, n: str, is_supplement: Column, offset: int = 0) -> DataFrame:
    """One row: documents, supplement documents, documents under MIN_TOKENS, dropped short pieces, chunks, tokens kept."""
    n_ = F.col(n).cast("long")
    o = document_offset(n_, offset)
    made = F.ceil(F.greatest(n_ - o, F.lit(0)) / F.lit(LENGTH)) + F.when(o > 0, F.ceil(F.least(o, n_) / F.lit(LENGTH))).otherwise(F.lit(0))
    kept = spans(n_, o)
    tokens = F.aggregate(kept, F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return df.select(is_supplement.alias("s"), n_.alias("n"), made.alias("made"), F.size(kept).alias("kept"), tokens.alias("t")).agg(
        F.count(F.lit(1)).alias("n_docs"), F.count_if("s").alias("n_supplement_docs"), F.count_if(F.col("n") < MIN_TOKENS).alias("n_short_docs"),
        F.coalesce(F.sum(F.col("made") - F.col("kept")), F.lit(0)).cast("long").alias("n_dropped_short_chunks"), F.coalesce(F.sum("kept"), F.lit(0)).cast("long").alias("n_chunks"), F.coalesce(F.sum("t"), F.lit(0)).alias("total_tokens"),
    )


def shape_report(df: DataFrame, id_column: str, n: str, batch: int = 6, accumulate: int = 1, epochs: int = 15) -> DataFrame:
    """One row: steps an epoch, the largest document's share of the chunks, tokens, and which shape warnings hold."""
    n_ = F.col(n).cast("long")
    each = df.select(F.col(id_column).alias("doc"), n_.alias("n"), chunk_count(n_, F.lit(0).cast("long")).alias("chunks"))
    one = each.agg(F.sum("chunks").alias("n_chunks"), F.max("chunks").alias("most"), F.max_by("doc", F.struct("chunks", -F.col("doc"))).alias("dominant_doc"), F.sum("n").alias("n_tokens"))
    steps = F.ceil(F.ceil(F.col("n_chunks") / F.lit(batch)) / F.lit(accumulate))
    share = F.try_divide(F.col("most").cast("double"), F.col("n_chunks").cast("double"))
    return one.select("n_chunks", "n_tokens", steps.cast("long").alias("steps_per_epoch"), "dominant_doc", share.alias("dominant_share"), (steps < 8).alias("few_steps"), (share > 0.5).alias("one_document_dominates"), ((F.lit(epochs) > 5) & (F.col("n_tokens") < 500_000)).alias("many_epochs_on_little_text"))


def batches(df: DataFrame, id_column: str, ids: str, size: int, seed: int | None = None, pad: int = 0) -> DataFrame:
    """``batch, id_column, padded, mask_ones``: rows in seeded order in batches of ``size``, left-padded to the longest of each.

    Two prefix sums give the batch number, so no task orders all rows; the longest row is a partial aggregate."""
    key = order_key(seed if seed is not None else 0, "batch", F.col(id_column))
    ranked = with_prefix(df.select(id_column, F.col(ids).alias("_ids")), key, tie=id_column).withColumn("batch", F.floor((F.col("rnk") - 1) / F.lit(size)).cast("long"))
    longest = ranked.groupBy("batch").agg(F.max(F.size("_ids")).alias("_most"))
    padded = F.concat(F.array_repeat(F.lit(pad).cast("long"), F.col("_most") - F.size("_ids")), F.transform("_ids", lambda x: x.cast("long")))
    return ranked.join(longest, "batch").select("batch", id_column, padded.alias("padded"), F.size("_ids").alias("mask_ones"))


def scoring_windows(n: Column, length: int = 2048, stride: int = 512) -> Column:
    """``array<struct<begin, end, new>>``: sliding windows over n tokens in which every token is new once."""
    step = F.lit(stride).cast("long")
    starts = F.when(n > 0, F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0)), step)).otherwise(F.array().cast("array<bigint>"))
    window = F.transform(starts, lambda b: F.struct(b.alias("begin"), F.least(b + length, n).alias("end"), (F.least(b + length, n) - F.when(b == 0, F.lit(0)).otherwise(F.least(b - stride + length, n))).alias("new")))
    return F.filter(window, lambda w: w["new"] > 0)


def optimizer_steps(df: DataFrame, n: str, offsets: list[int], batch: int = 6, accumulate: int = 1) -> DataFrame:
    """``epoch, n_chunks, steps``: each epoch's chunks at its own offset, batches rounded up, steps rounded up. One pass
    over the documents serves all epochs."""
    n_ = F.col(n).cast("long")
    sums = df.agg(*[F.coalesce(F.sum(chunk_count(n_, document_offset(n_, o))), F.lit(0)).alias(str(e)) for e, o in enumerate(offsets)])
    each = sums.select(F.explode(F.array(*[F.struct(F.lit(e).alias("epoch"), F.col(str(e)).alias("n_chunks")) for e in range(len(offsets))])).alias("x")).select("x.*")
    return each.withColumn("steps", F.ceil(F.ceil(F.col("n_chunks") / F.lit(batch)) / F.lit(accumulate)).cast("long"))


def memory_estimate(df: DataFrame, text: str, bytes_per_token: int = 35, chars_per_token: int = 4) -> DataFrame:
    """One row ``n_chars, n_tokens, n_bytes``: what a single machine would hold of the corpus; Spark itself spills."""
    chars = F.coalesce(F.sum(F.length(text)), F.lit(0))
    tokens = F.floor(chars / F.lit(chars_per_token)).cast("long")
    return df.agg(chars.alias("n_chars"), tokens.alias("n_tokens"), (tokens * bytes_per_token).alias("n_bytes"))


def chunks_until(df: DataFrame, id_column: str, tokens: str, need: int, seed: int = 42) -> DataFrame:
    """Rows in seeded order until their tokens reach ``need``: those whose predecessors hold fewer; all if there are too few."""
    run = with_prefix(df, order_key(seed, "until", F.col(id_column)), {"reached": F.col(tokens).cast("long")}, tie=id_column)
    return run.filter(F.col("reached") - F.col(tokens) < need)
