"""Incremental paths: new vectors folded into standing moments, new files prepared as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.functions.folds import clean_text
from lodestone.operators.vectors import moments, reservoir
from lodestone.sources.sinks import write_batch


def fold_moments(stream: DataFrame, site: str, vector: str, state: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Writes each micro-batch's moments by site to its own partition of ``state``: a batch that is repeated after a failure
    replaces itself, so every vector counts once. ``folded`` reads the merged statistic."""

    def keep(batch: DataFrame, number: int) -> None:
        write_batch(moments(batch, site, vector).select(F.col(site).alias("site"), "n", "mean", "m2"), state, number)

    writer = stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")).start()


def fold_reservoir(stream: DataFrame, site: str, id_column: str, state: str, checkpoint: str, size: int, seed: int = 42) -> StreamingQuery:
    """Keeps each micro-batch's reservoir in its own partition of ``state``. Reservoirs are the rows with the lowest keys, so the
    reservoir of all of them is that of the whole stream (``folded_reservoir``)."""

    def keep(batch: DataFrame, number: int) -> None:
        write_batch(reservoir(batch, site, id_column, size, seed).drop("place"), state, number)

    return stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def folded_reservoir(spark: SparkSession, state: str, site: str, id_column: str, size: int, seed: int = 42) -> DataFrame:
    """The reservoir of everything that has come so far; ``size`` at most that of the kept ones."""
    return reservoir(spark.read.parquet(state).drop("batch"), site, id_column, size, seed)


def folded(spark: SparkSession, state: str) -> DataFrame:
    """``site, d, n, mean, std``: the moments of all batches so far, merged exactly coordinate by coordinate."""
    parts = spark.read.parquet(state).select("site", "n", F.posexplode(F.arrays_zip("mean", "m2")).alias("d", "v")).select("site", "n", "d", "v.mean", "v.m2")
    total = parts.groupBy("site", "d").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("mean")).alias("s"), F.sum("m2").alias("within"), F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("q"))
    mean = F.col("s") / F.col("n")
    m2 = F.col("within") + F.greatest(F.col("q") - F.col("n") * mean * mean, F.lit(0.0))
    return total.select("site", "d", "n", mean.alias("mean"), F.sqrt(F.try_divide(m2, (F.col("n") - 1).cast("double")) + F.lit(1e-10)).alias("std"))


def prepare_stream(stream: DataFrame, text: str, out: str, checkpoint: str, least: int = 1000) -> StreamingQuery:
    """Cleans texts as they arrive and appends those of ``least`` characters or more."""
    cleaned = stream.withColumn(text, clean_text(F.col(text))).filter(F.length(text) >= least)
    return cleaned.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
