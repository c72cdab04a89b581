"""Rows that were delivered more than once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_delivery(df: DataFrame, key: str, arrived: str | None, columns: dict[str, Column]) -> DataFrame:
    """One row for each ``key`` with the given columns, those of its earliest delivery.

    Ties in ``arrived`` (and a null ``arrived``, which counts as latest) go to the smallest values, so the
    result is the same for any partitioning. Rows whose key is null have no identity but their content: they
    are kept, once for each distinct content. The aggregate is partial first, so a key that holds a third of
    the rows costs one row a task in the shuffle.
    """
    content = F.struct(*[c.alias(f"c{i}") for i, c in enumerate(columns.values())])
    late = F.lit(None).cast("timestamp") if arrived is None else F.col(arrived)
    slim = df.select(F.col(key).alias("k"), F.when(F.col(key).isNull(), F.sha2(F.to_json(content), 256)).alias("u"), F.struct(late.isNull().alias("n"), late.alias("a"), content.alias("c")).alias("v"))
    best = slim.groupBy("k", "u").agg(F.min("v").alias("v"))
    return best.select(F.col("k").alias(key), *[F.col(f"v.c.c{i}").alias(name) for i, name in enumerate(columns)])
