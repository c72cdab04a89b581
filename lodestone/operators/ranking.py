"""Global order without a global window: row numbers and running sums over a seeded key.

Rows fall into buckets by the first digits of their key. The buckets' sizes, a small table, are run over, and the
window over rows works inside a bucket, so no task ever holds a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: 4,096 buckets a group.
BUCKET_DIGITS = 3


#: Buckets of ``with_ordered_rank``: this many order values are collected and sent to the tasks, whatever the data's size.
RANGES = 256


def range_of(df: DataFrame, order: str) -> Column:
    """The number of the range that a row's value of a column falls into, ascending in the value; -1 for null. The bounds of
    RANGES ranges are found from all rows of ``df`` first."""
    kind = dict(df.dtypes)[order]
    if kind == "string":
        sample = df.select(F.col(order).alias("v")).filter("v is not null").orderBy(F.sha2("v", 256)).limit(RANGES)  # seeded
        bounds = [r.v for r in sample.collect()]
    else:
        bounds = df.select(F.col(order).alias("v")).agg(F.percentile_approx("v", [(i + 1) / RANGES for i in range(RANGES - 1)], 10_000).alias("b")).first().b or []
    at = F.size(F.filter(F.array(*[F.lit(b) for b in sorted(set(bounds))]), lambda b: b < F.col(order))) if bounds else F.lit(0)
    return F.coalesce(F.when(F.col(order).isNull(), F.lit(-1)).otherwise(at), F.lit(-1))


def _starts(bucketed: DataFrame, by: tuple[str, ...], sums: tuple[str, ...] = ()) -> DataFrame:
    """``by…, _bucket, _b_…``: how many rows (and how much of ``sums``) come before each bucket. The window is over the buckets'
    totals alone."""
    totals = bucketed.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_s{c}") for c in sums])
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*by, "_bucket", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_b{c}") for c in ("_n", *[f"_s{c}" for c in sums])])


def _same(by: tuple[str, ...]) -> list[Column]:
    return [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in (*by, "_bucket")]


def with_ordered_rank(df: DataFrame, order: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``rnk`` from 1 in the order of a column, in the whole table or inside each group of ``by``; the column's
    values are distinct in a group. Rows fall into ranges of the column (``range_of``); then as in ``with_prefix``. Nulls
    come first."""
    ranged = df.withColumn("_bucket", range_of(df, order))
    run = ranged.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(order)))
    joined = run.alias("r").join(_starts(ranged, by).alias("s"), _same(by))
    return joined.select(*[F.col(f"r.{c}").alias(c) for c in df.columns], (F.col("s._b_n") + F.col("r._r")).alias("rnk"))


def first_of_each(df: DataFrame, by: str, n: int | Column, key: Column | None = None, order: str | None = None, tie: str | None = None) -> DataFrame:
    """``df`` with ``place``: the first ``n`` rows of each group of ``by`` (a number, or a column that is the same in a group),
    in the order of a hex digest ``key`` (ties by ``tie``) or of a column ``order``.

    Spark's own group limit works up to a limit of a thousand rows; above it a window takes a whole group into one task. Here the
    groups' rows are counted by buckets of the order first, and only those of the buckets that the first ``n`` reach into
    are shuffled, each bucket of a group apart."""
    if key is not None:
        keyed = df.withColumn("_key", key)
        keyed = keyed.withColumn("_bucket", F.substring("_key", 1, BUCKET_DIGITS))
        inside = ("_key", *([tie] if tie else []))
    else:
        keyed, inside = df.withColumn("_bucket", range_of(df, order)), (order, *([tie] if tie else []))
    limit = F.lit(n) if isinstance(n, int) else n
    starts = _starts(keyed.select(F.col(by), "_bucket"), (by,))
    kept = keyed.withColumn("_limit", limit).alias("r").join(starts.alias("s"), _same((by,))).filter(F.col("s._b_n") < F.col("r._limit"))
    placed = kept.select("r.*", F.col("s._b_n").alias("_before"))
    place = F.col("_before") + F.row_number().over(Window.partitionBy(by, "_bucket").orderBy(*inside))
    return placed.withColumn("place", place).filter(F.col("place") <= F.col("_limit")).select(*df.columns, "place")


def with_prefix(df: DataFrame, key: Column, sums: dict[str, Column] | None = None, by: tuple[str, ...] = (), tie: str | None = None) -> DataFrame:
    """``df`` with ``rnk`` (from 1, in the order of the hex digest ``key``, ties by ``tie``) and, for each of ``sums``, the
    running total up to and with the row, in the whole table or inside each group of ``by``."""
    sums = sums or {}
    keyed = df.withColumns({"_key": key, **{f"_m_{n}": c for n, c in sums.items()}}).withColumn("_bucket", F.substring("_key", 1, BUCKET_DIGITS))
    inside = Window.partitionBy(*by, "_bucket").orderBy("_key", *([tie] if tie else []))
    up_to = inside.rowsBetween(Window.unboundedPreceding, 0)
    run = keyed.withColumns({"_r": F.row_number().over(inside), **{f"_t_{n}": F.sum(f"_m_{n}").over(up_to) for n in sums}})
    joined = run.alias("r").join(_starts(keyed, by, tuple(f"_m_{n}" for n in sums)).alias("s"), _same(by))
    return joined.select(*[F.col(f"r.{c}").alias(c) for c in df.columns], (F.col("s._b_n") + F.col("r._r")).alias("rnk"), *[(F.col(f"s._b_s_m_{n}") + F.col(f"r._t_{n}")).alias(n) for n in sums])
