"""Reading Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer splits than there are cores, its rows dealt out to all cores; any other DataFrame as it is.

    A table of one small file is read by one task, however much work its texts are. A scan has fewer splits than cores only
    while it is small for the cluster, so what this shuffles is bounded by (cores x the size of a split). Filters and
    column selections are pushed through it to the scan."""
    execution = df._jdf.queryExecution()
    if execution.executedPlan().getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return df  # behind a shuffle; asking for its partitions would run it
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < execution.toRdd().getNumPartitions() < cores else df


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{folder}/{name}.parquet"))
