"""Token-weighted metrics, curves and their verdicts, schedules, report tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import signed_percent

#: From which rise over the best a curve is warned about, and below which another run is optional (per cent).
WARN_RATIO, OPTIONAL_PERCENT = 1.10, 1.0
LOG_FLOOR = 1e-3


def perplexity(nll: Column, n: Column) -> Column:
    """exp of the token-weighted mean; infinite where nothing was scored."""
    return F.when(F.coalesce(F.sum(n), F.lit(0)) == 0, F.lit(float("inf"))).otherwise(F.exp(F.sum(nll * n) / F.sum(n)))


def level_shape(df: DataFrame, by: list[str], ratio: str) -> DataFrame:
    """``by, n, level, shape``: geometric mean of the ratios, and the standard deviation of their logs (0 for one).
    Ratios are clamped from below at LOG_FLOOR; null and NaN ratios are left out."""
    log = F.ln(F.greatest(F.col(ratio), F.lit(LOG_FLOOR)))
    kept = df.filter(F.col(ratio).isNotNull() & ~F.isnan(ratio)).withColumn("_log", log)
    return kept.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.exp(F.avg("_log")).alias("level"), F.coalesce(F.stddev_samp("_log"), F.lit(0.0)).alias("shape"))


def class_medians(report: DataFrame, cls: str, value: str, floor: str) -> DataFrame:
    """``cls, median, floor_median, times_floor``: exact medians, and their ratio; null where the floor is 0."""
    m = report.groupBy(cls).agg(F.percentile(value, F.lit(0.5)).alias("median"), F.percentile(floor, F.lit(0.5)).alias("floor_median"))
    return m.withColumn("times_floor", F.try_divide(F.col("median"), F.nullif(F.col("floor_median"), F.lit(0.0))))


def curve_verdict(history: DataFrame, run: str, epoch: str, metric: str) -> DataFrame:
    """``run, n_measured, best_epoch, best, final, gap, verdict, advice`` of each run's curve.

    Null values are not measured. ``no_curve`` without any; ``diverged`` if the last one isn't finite and positive (final
    and gap are then null); ``still_falling`` if the best is the last; else ``turned``, with the rise from best to
    last. The best of equals is the earliest. An epoch logged again counts by its latest value, chosen before."""
    ok = F.col(metric).isNotNull() & ~F.isnan(metric) & (F.col(metric) > 0) & (F.col(metric) < float("inf"))
    g = history.groupBy(run).agg(
        F.count(metric).alias("n_measured"), F.min(F.when(ok, F.struct(F.col(metric).alias("m"), F.col(epoch).alias("e")))).alias("b"),
        F.max(F.when(F.col(metric).isNotNull(), F.struct(F.col(epoch).alias("e"), F.col(metric).alias("m"), ok.alias("ok")))).alias("l"),
    )
    gap = F.col("l.m") / F.col("b.m") - 1
    kind = F.when(F.col("n_measured") == 0, "no_curve").when(~F.col("l.ok"), "diverged").when(F.col("l.e") == F.col("b.e"), "still_falling").otherwise("turned")
    final = F.when(F.col("l.ok"), F.col("l.m"))
    turned = kind == "turned"
    advice = F.when(turned & (F.col("l.m") >= WARN_RATIO * F.col("b.m")), "warn").when(turned & (F.bround(gap * 100, 1) < OPTIONAL_PERCENT), "optional").when(turned, "likely").otherwise("none")
    return g.select(run, "n_measured", F.col("b.e").alias("best_epoch"), F.col("b.m").alias("best"), final.alias("final"), F.when(turned, gap).alias("gap"), kind.alias("verdict"), advice.alias("advice"))


def latest_epochs(history: DataFrame, run: str, epoch: str, logged: str, columns: list[str]) -> DataFrame:
    """One row for each run and epoch, that logged last."""
    return history.groupBy(run, epoch).agg(F.max_by(F.struct(*columns), F.struct(logged, *columns)).alias("v")).select(run, epoch, "v.*")


def perplexity_table(scores: DataFrame, axis: str, stage: str, value: str, stages: list[str]) -> DataFrame:
    """``axis`` and, for each stage, its value; for each after the first, its change in per cent too. An axis that a stage
    didn't measure has null there; a baseline of 0 gives no change."""
    wide = scores.groupBy(axis).agg(*[F.max(F.when(F.col(stage) == s, F.col(value))).alias(s) for s in stages])
    return wide.select(axis, *stages, *[signed_percent(F.col(s), F.col(stages[0])).alias(f"{s}_delta_pct") for s in stages[1:]])


def layer_weights(spark, layers: int, floor: float, kind: str = "cosine") -> DataFrame:
    """``layer, weight``: a depth schedule over t = layer / layers, normalised to 1; the last layer doesn't reach the floor."""
    t = F.col("id") / F.lit(layers)
    w = {"linear": 1 - (1 - floor) * t, "cosine": floor + (1 - floor) * (1 + F.cos(F.lit(math.pi) * t)) / 2, "exponential": F.pow(F.lit(float(floor)), t)}[kind]
    raw = spark.range(layers).select(F.col("id").alias("layer"), w.alias("w"))
    return raw.select("layer", (F.col("w") / F.sum("w").over(Window.partitionBy())).alias("weight"))  # a row a layer


def learning_rates(spark, steps: int, peak: float, warmup: int = 50, floor: float = 0.0, kind: str = "cosine") -> DataFrame:
    """``step, rate``: linear warm-up from a tenth of the peak, then a cosine down to floor * peak, or flat."""
    warm = min(warmup, steps)
    s = F.col("id")
    rise = F.lit(peak) * (0.1 + 0.9 * s / F.lit(max(warm, 1)))
    low = floor * peak
    fall = F.lit(low) + (peak - low) * (1 + F.cos(F.lit(math.pi) * (s - warm) / F.lit(max(steps - warm, 1)))) / 2
    return spark.range(steps).select(s.alias("step"), F.when(s < warm, rise).otherwise(fall if kind == "cosine" else F.lit(peak)).alias("rate"))


def site_price(vectors: DataFrame, site: str, vector: str, delta: list[list[float]]) -> DataFrame:
    """``site, price``: the mean squared norm of delta applied to each site's vectors (delta as rows)."""
    rows = F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in delta])
    dot = lambda r: F.aggregate(F.zip_with(r, F.col(vector), lambda a, b: a * b.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
    norm = F.aggregate(F.transform(rows, dot), F.lit(0.0), lambda acc, y: acc + y * y)
    return vectors.select(site, norm.alias("p")).groupBy(site).agg(F.avg("p").alias("price"))


def earlier_turn(ledger: DataFrame, stage: str, run: str, started: str, turned_epoch: str) -> DataFrame:
    """Each run with the last earlier run of its stage that turned at the same epoch (``rerun_of``, null if none)."""
    w = Window.partitionBy(stage, turned_epoch).orderBy(started, run).rowsBetween(Window.unboundedPreceding, -1)
    return ledger.withColumn("rerun_of", F.when(F.col(turned_epoch).isNotNull(), F.last(run, ignorenulls=True).over(w)))


def frame_hash(*fields: Column) -> Column:
    """A hash of named fields in a canonical form: ``name=value`` lines, null as the empty string."""
    return F.sha2(F.concat_ws("\n", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields]), 256)


def reusable(manifests: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The manifests that match a wanted one in every key, nulls matching nulls."""
    m, w = manifests.alias("m"), wanted.select(*keys).distinct().alias("w")
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(f"m.{k}").eqNullSafe(F.col(f"w.{k}"))
    return m.join(w, condition, "left_semi")


def epoch_means(batches: DataFrame, epoch: str, losses: list[str], grad_norm: str, stepped: str) -> DataFrame:
    """``epoch, losses…, grad_norm, n_batches, n_steps``: losses averaged over micro-batches, gradient norms over the batches
    that ended a step."""
    step = F.col(stepped)
    return batches.groupBy(epoch).agg(*[F.avg(c).alias(c) for c in losses], F.coalesce(F.avg(F.when(step, F.col(grad_norm))), F.lit(0.0)).alias("grad_norm"), F.count(F.lit(1)).alias("n_batches"), F.count_if(step).alias("n_steps"))


def thinnest_and_largest(counts: DataFrame, site: str, n: str) -> DataFrame:
    """One row: the site with the fewest vectors and the one with the most, ties by name."""
    low, high = F.min(F.struct(F.col(n).alias("n"), F.col(site).alias("s"))), F.max(F.struct(F.col(n).alias("n"), F.col(site).alias("s")))
    return counts.agg(low.alias("a"), high.alias("b")).select(F.col("a.s").alias("thinnest"), F.col("a.n").alias("least"), F.col("b.s").alias("largest"), F.col("b.n").alias("most"))


def weighted_site_loss(errors: DataFrame, weights: DataFrame, layer: str, mse: str) -> DataFrame:
    """One row ``loss``: the sites' squared errors averaged in each layer, then summed with the depth schedule's weights."""
    mean = errors.groupBy(layer).agg(F.avg(mse).alias("_m"))
    return mean.join(weights, layer).agg(F.coalesce(F.sum(F.col("_m") * F.col("weight")), F.lit(0.0)).alias("loss"))


def factored_weight_loss(a: Column, b: Column, scale: float) -> Column:
    """Squared norm of scale * B A for factor matrices given as rows, as scale^2 tr((B'B)(AA')): the product is never made."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    columns = F.transform(F.sequence(F.lit(1), F.size(F.element_at(b, 1))), lambda j: F.transform(b, lambda row: F.element_at(row, j)))
    grams = F.transform(F.arrays_zip(columns.alias("c"), a.alias("r")), lambda i: F.aggregate(F.transform(F.arrays_zip(columns.alias("c"), a.alias("r")), lambda j: dot(i["c"], j["c"]) * dot(i["r"], j["r"])), F.lit(0.0), lambda s, v: s + v))
    return F.aggregate(grams, F.lit(0.0), lambda s, v: s + v) * (scale * scale)


def weight_loss(before: DataFrame, after: DataFrame, keys: list[str], weights: str, layer: str, layer_weights: DataFrame) -> DataFrame:
    """One row ``loss``: the squared norm of what changed between two tables of weights (arrays by ``keys``), each layer's part
    times its ``weight``. Weights that only one of the two has don't count; the sum is of partial sums."""
    b = before.select(*keys, F.col(weights).alias("_b"))
    change = F.aggregate(F.zip_with("_b", weights, lambda x, y: (y - x).cast("double")), F.lit(0.0), lambda s, d: s + d * d)
    parts = after.join(b, keys).groupBy(layer).agg(F.sum(change).alias("_loss"))
    return parts.join(layer_weights.select(F.col("layer").alias("_layer"), "weight"), F.col(layer) == F.col("_layer")).agg(F.coalesce(F.sum(F.col("_loss") * F.col("weight")), F.lit(0.0)).alias("loss"))


def markdown_table(table: DataFrame, label: str, columns: list[str], digits: int = 2) -> DataFrame:
    """``line, text``: a report as the lines of a Markdown table of even width, in the order of its labels; numbers rounded to
    ``digits``, nulls empty. For reports: one task orders its lines."""
    number = lambda c: F.when(F.col(c).isNull(), "").otherwise(F.format_string(f"%.{digits}f", F.bround(F.col(c).cast("double"), digits)))
    cells = table.select(F.coalesce(F.col(label).cast("string"), F.lit("")).alias("_label"), *[number(c).alias(f"_c{i}") for i, c in enumerate(columns)])
    width = cells.agg(F.coalesce(F.max(F.length("_label")), F.lit(0)).alias("_width"), *[F.greatest(F.coalesce(F.max(F.length(f"_c{i}")), F.lit(0)), F.lit(max(len(c), 3))).alias(f"_w{i}") for i, c in enumerate(columns)])
    n = range(len(columns))
    heads = width.select(F.posexplode(F.array(
        F.concat(F.lit("| "), F.rpad(F.lit(""), F.col("_width"), F.lit(" ")), *[F.concat(F.lit(" | "), F.lpad(F.lit(columns[i]), F.col(f"_w{i}"), F.lit(" "))) for i in n], F.lit(" |")),
        F.concat(F.lit("| "), F.rpad(F.lit(""), F.col("_width"), F.lit("-")), *[F.concat(F.lit(" | "), F.rpad(F.lit(""), F.col(f"_w{i}"), F.lit("-"))) for i in n], F.lit(" |")),
    )).alias("line", "text"))
    one = cells.withColumn("_one", F.lit(1)).join(F.broadcast(width.withColumn("_one", F.lit(1))), "_one")  # one row
    line = F.concat(F.lit("| "), F.rpad("_label", F.col("_width"), F.lit(" ")), *[F.concat(F.lit(" | "), F.lpad(f"_c{i}", F.col(f"_w{i}"), F.lit(" "))) for i in n], F.lit(" |"))
    body = one.select((F.row_number().over(Window.orderBy("_label")) + 1).alias("line"), line.alias("text"))
    return heads.unionByName(body)
