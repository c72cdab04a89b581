"""The pN_ queries: each problem's operator over its whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import budget, encoding, leakage, mixing, pairs, reading, splitting
from lodestone.sources.tables import read_table


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_long_texts(_table(spark, sf_dir, "seed_corpus"), "row_id", "text", arrived="loaded_at")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_pieces(spark, sf_dir).filter((F.col("piece_no") == 0) & (F.col("body_chars") > splitting.LIMIT)).select("row_id")


def p1_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each long text put together again from its pieces, and what holds for all of them; SQL has it from the text."""
    one = F.struct("piece_no", F.substring("piece", F.col("overlap") + 1, F.length("piece")).alias("own"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda p: p["own"]), "")  # the pieces of one text
    held = p1_pieces(spark, sf_dir).groupBy("row_id").agg(
        F.sha2(whole, 256).alias("text_hash"), F.max(F.length("piece")).alias("longest"), F.max("overlap").alias("overlap"), (F.max("piece_no") + 1 == F.max("n_pieces")).alias("numbered"),
        (F.count(F.lit(1)) > 1).alias("cut"),
    )
    return held.select("row_id", "text_hash", (F.col("longest") <= splitting.LIMIT).alias("within_limit"), (F.col("overlap") <= splitting.OVERLAP).alias("within_overlap"), "numbered", "cut")


def p2_document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget.document_tokens(_table(spark, sf_dir, "seed_corpus"))


def p2_usable_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The budget's rows and characters, which SQL can count as well."""
    return p2_token_budget(spark, sf_dir).drop("n_tokens")


def p2_token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget.token_budget(_table(spark, sf_dir, "seed_corpus"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.defective_pairs(_table(spark, sf_dir, "supplement"))


def p4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "seed_corpus"), _table(spark, sf_dir, "mix_plan"))


def p4_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = mixing.mix_shares(_table(spark, sf_dir, "seed_corpus"), _table(spark, sf_dir, "mix_plan"))
    return shares.withColumns({c: F.round(c, 6) for c in ("target_share", "target_chars", "actual_share")})


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.short_sources(_table(spark, sf_dir, "seed_corpus"), _table(spark, sf_dir, "mix_plan"))


def p5_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode_corpus(_table(spark, sf_dir, "documents"), "doc_id", "text")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).select("doc_id", "item_id")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.reading_levels(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "graded_passages")).select("doc_id", "level")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_pieces, p1_restored, p2_token_budget, p2_document_tokens, p2_usable_text, p3_found, p4_found, p4_mix, p4_shares, p5_ids, p6_found, p7_found)
}
