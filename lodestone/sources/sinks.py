"""Writing documents, corpora and statistics."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.corpora import corpus_statistics
from lodestone.operators.documents import unique_names
from lodestone.operators.mixture import compacted


def if_written(read: Callable[[], DataFrame]) -> DataFrame | None:
    """What ``read`` gives; None where the path isn't there or holds no data yet. Any other failure is one."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def write_documents(df: DataFrame, path: str, stem: str, order: str) -> DataFrame:
    """Appends documents under names not taken in ``path`` yet, and returns them with their ``name``. Nothing is overwritten."""
    spark = df.sparkSession
    standing = if_written(lambda: spark.read.parquet(path))
    taken = None if standing is None else standing.select("name")
    named = unique_names(df, stem, order, taken)
    named.write.mode("append").parquet(path)
    return spark.read.parquet(path)


def write_json_lines(df: DataFrame, path: str) -> dict:
    """JSON lines under ``path/rows`` and a ``path/stats`` side-car (JSON) with the statistics of ``corpus_statistics``."""
    df.write.mode("overwrite").json(f"{path}/rows")
    chars = F.length("text") if "text" in df.columns else F.length("prompt") + F.length("response")
    stats = corpus_statistics(df, F.col("source"), chars)
    stats.coalesce(1).write.mode("overwrite").json(f"{path}/stats")
    return {r.source: r.asDict() for r in stats.collect()}  # a row a source


def write_artifact(sites: DataFrame, path: str, meta: dict | None = None, int8: bool = False) -> None:
    """Site rows under ``path/sites`` and a one-row ``path/meta``; the metadata is written last, so a reader that finds it
    finds all. With ``int8`` the matrices are stored in blocks of eight bits a number; ``sites`` stays as it is."""
    (compacted(sites) if int8 else sites).write.mode("overwrite").parquet(f"{path}/sites")
    sites.sparkSession.createDataFrame([(json.dumps(meta or {}, sort_keys=True),)], "meta string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def write_batch(df: DataFrame, path: str, batch: int) -> None:
    """One batch of a durable append, in its own partition: writing it again replaces it, so a resumed writer may repeat
    its last batch."""
    df.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)
