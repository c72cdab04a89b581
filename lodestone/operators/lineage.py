"""Cutting a lineage through a folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``. Where that is unset and everything runs in this one process, as
    in tests, a temporary folder that is removed at its end; on a cluster an unset folder is refused, as no
    executor could read what another wrote to its own disk."""
    if named := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return named
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="lodestone-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    return "file://" + own


def materialise(df: DataFrame) -> DataFrame:
    """The rows of ``df``, computed once and written to the shared folder. Losing an executor later costs no recomputation; the
    files go when nothing refers to them any more, where spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)
