"""Merging site statistics without their data, adding a domain in a base's own basis, compact storage."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.vectors import RESERVOIR, DiagonalMixture, moments, reservoir

BLOCK = 64
SAMPLES_PER_COMPONENT = 200


def alpha_from_counts(n: Column, m: Column) -> Column:
    """The second part's weight, m / (n + m); null for two empty parts."""
    return F.try_divide(m.cast("double"), (n + m).cast("double"))


def merged_mean(mean: Column, mean2: Column, alpha: Column) -> Column:
    return F.zip_with(mean, mean2, lambda a, b: a * (1 - alpha) + b * alpha)


def merged_variance(mean: Column, var: Column, mean2: Column, var2: Column, alpha: Column) -> Column:
    """Population variance of the union: the law of total variance."""
    d2 = F.zip_with(mean, mean2, lambda a, b: (a - b) * (a - b))
    within = F.zip_with(var, var2, lambda a, b: a * (1 - alpha) + b * alpha)
    return F.zip_with(within, d2, lambda w, d: w + d * alpha * (1 - alpha))


def merge_moments(base: DataFrame, added: DataFrame, site: str) -> DataFrame:
    """``site, n, mean, var``: exact moments of the union of both sides' vectors; a site of one side alone passes through.
    Both sides have those columns."""
    a, b = base.select(site, "n", "mean", "var"), added.select(site, F.col("n").alias("n2"), F.col("mean").alias("mean2"), F.col("var").alias("var2"))
    j = a.join(b, site, "full").withColumns({"n": F.coalesce("n", F.lit(0)), "n2": F.coalesce("n2", F.lit(0))})
    # a column of its own: inside a lambda the name n would be taken for the new n of the same select
    j = j.withColumn("_alpha", alpha_from_counts(F.col("n"), F.col("n2")))
    alpha = F.col("_alpha")
    both = F.col("mean").isNotNull() & F.col("mean2").isNotNull()
    mean = F.when(both, merged_mean(F.col("mean"), F.col("mean2"), alpha)).otherwise(F.coalesce("mean", "mean2"))
    var = F.when(both, merged_variance(F.col("mean"), F.col("var"), F.col("mean2"), F.col("var2"), alpha)).otherwise(F.coalesce("var", "var2"))
    return j.select(site, (F.col("n") + F.col("n2")).alias("n"), mean.alias("mean"), var.alias("var"))


def mixture_union(weights: Column, weights2: Column, alpha: Column) -> Column:
    """Weights of two mixtures' components together, the second part's share being alpha, normalised."""
    joined = F.concat(F.transform(weights, lambda w: w * (1 - alpha)), F.transform(weights2, lambda w: w * alpha))
    return F.transform(joined, lambda w: w / F.aggregate(joined, F.lit(0.0), lambda a, x: a + x))


def merge_artifacts(base: DataFrame, domain: DataFrame, site: str, alpha: float | None = None) -> DataFrame:
    """A base's site rows with a domain's folded in. Where both have a mixture, components are united and the base keeps
    its mean, std and basis; where not, means and variances are merged; a site without a counterpart passes through.

    An explicit ``alpha`` overrides the counts; counts are then unknown (null) unless both sides have them."""
    d = domain.select(site, *[F.col(c).alias("d_" + c) for c in ("n_samples", "mean", "std", "gmm_weights", "gmm_means", "gmm_covariances")])
    j = base.join(d, site, "left")
    met = F.col("d_n_samples").isNotNull() | F.col("d_mean").isNotNull()
    j = j.withColumn("_alpha", F.lit(alpha).cast("double") if alpha is not None else alpha_from_counts(F.col("n_samples"), F.col("d_n_samples")))
    a = F.col("_alpha")  # of its own, as in merge_moments
    mixed = met & F.col("gmm_weights").isNotNull() & F.col("d_gmm_weights").isNotNull()
    plain = met & ~mixed & F.col("d_mean").isNotNull()
    square = lambda c: F.transform(c, lambda x: x * x)
    var = merged_variance(F.col("mean"), square(F.col("std")), F.col("d_mean"), square(F.col("d_std")), a)
    out = {
        "n_samples": F.when(met, F.col("n_samples") + F.col("d_n_samples")).otherwise(F.col("n_samples")),
        "mean": F.when(plain, merged_mean(F.col("mean"), F.col("d_mean"), a)).otherwise(F.col("mean")),
        "std": F.when(plain, F.transform(var, lambda x: F.sqrt(x))).otherwise(F.col("std")),
        "gmm_weights": F.when(mixed, mixture_union(F.col("gmm_weights"), F.col("d_gmm_weights"), a)).otherwise(F.col("gmm_weights")),
        "gmm_means": F.when(mixed, F.concat("gmm_means", "d_gmm_means")).otherwise(F.col("gmm_means")),
        "gmm_covariances": F.when(mixed, F.concat("gmm_covariances", "d_gmm_covariances")).otherwise(F.col("gmm_covariances")),
        "gmm_n_components": F.when(mixed, F.size("gmm_weights") + F.size("d_gmm_weights")).otherwise(F.col("gmm_n_components")),
    }
    return j.select(*[(out[c] if c in out else F.col(c)).alias(c) for c in base.columns])


def domain_mixtures(vectors: DataFrame, base: DataFrame, site: str, id_column: str, vector: str, k: int = 8, seed: int = 42, size: int = RESERVOIR) -> DataFrame:
    """``site, n_samples, mean, std, gmm_weights, gmm_means, gmm_covariances``: count and moments of all of a site's vectors,
    and a mixture of its reservoir of ``size`` in the base's whitened basis, carried back to its coordinates, with at
    most one component for SAMPLES_PER_COMPONENT vectors; the best of three starts."""
    kind = vectors.schema[site].dataType.simpleString()
    vectors = vectors.filter(F.col(vector).isNotNull())
    whole = moments(vectors, site, vector)
    deviation = F.transform("m2", lambda x: F.sqrt(x / F.greatest(F.col("n") - 1, F.lit(1))))
    whole = whole.select(site, F.col("n").alias("n_samples"), "mean", deviation.alias("std"))
    sample = reservoir(vectors, site, id_column, size, seed)
    basis = base.select(F.col(site).alias("site"), F.col("mean").alias("mu"), F.col("pca_components").alias("basis_rows"), F.col("pca_eigenvalues").alias("lam"))
    slim = sample.select(F.col(site).alias("site"), F.col(id_column).alias("id"), F.col(vector).cast("array<double>").alias("v"))

    def fit(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = ["site", "gmm_weights", "gmm_means", "gmm_covariances"]
        if left.empty or right.empty:
            return pd.DataFrame(columns=columns)
        x = np.stack(left.sort_values("id").v.to_numpy())
        axes = np.stack(right.basis_rows.iloc[0])
        scale = np.sqrt(np.asarray(right.lam.iloc[0])[: axes.shape[1]])
        z = (x - np.asarray(right.mu.iloc[0])) @ axes / scale
        m = DiagonalMixture(min(k, max(1, len(x) // SAMPLES_PER_COMPONENT)), seed, starts=3, regular=1e-4).fit(z)
        return pd.DataFrame([(left.site.iloc[0], m.weights, [list(r) for r in m.means * scale], [list(r) for r in m.variances * scale**2])], columns=columns)

    schema = f"site {kind}, gmm_weights array<double>, gmm_means array<array<double>>, gmm_covariances array<array<double>>"
    fitted = slim.groupBy("site").cogroup(basis.groupBy("site")).applyInPandas(fit, schema).withColumnRenamed("site", site)
    return whole.join(fitted, site)


def quantize(df: DataFrame, id_column: str, vector: str, block: int = BLOCK) -> DataFrame:
    """``id_column, numel, blocks array<struct<scale float, q array<tinyint>>>``: absmax int8 by blocks, padded with zeros.

    Codes are rounded half to even with the unrounded 32-bit scale; the scale is stored in half precision. All in
    array expressions: no row ever explodes."""
    return df.select(F.col(id_column), F.size(vector).alias("numel"), quantized(F.col(vector), block).alias("blocks"))


def quantized(vector: Column, block: int = BLOCK) -> Column:
    """The blocks of ``quantize``; null for a null vector."""
    padded = F.concat(F.transform(vector, lambda x: x.cast("float")), F.array_repeat(F.lit(0.0).cast("float"), F.pmod(-F.size(vector), F.lit(block))))
    n_blocks = F.ceil(F.size(vector) / F.lit(block)).cast("int")
    cut = F.when(n_blocks > 0, F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda b: F.slice(padded, b * block + 1, block))).otherwise(F.array().cast("array<array<float>>"))
    sized = F.transform(cut, lambda x: F.struct(x.alias("x"), F.greatest(F.array_max(F.transform(x, lambda y: F.abs(y))) / F.lit(127.0).cast("float"), F.lit(1e-12)).cast("float").alias("s")))
    codes = F.transform(sized, lambda b: F.struct(b["s"].alias("scale"), F.transform(b["x"], lambda y: F.greatest(F.lit(-127), F.least(F.lit(127), F.bround((y / b["s"]).cast("float").cast("double"), 0).cast("int"))).cast("tinyint")).alias("q")))
    return F.when(vector.isNotNull(), F.transform(codes, lambda b: F.struct(half(b["scale"]).alias("scale"), b["q"].alias("q"))))


def half(c: Column) -> Column:
    """A positive number rounded to half precision, half to even, as a float; Spark has no such type."""
    x = c.cast("double")
    near = F.floor(F.log2(x))
    exponent = F.when(F.pow(F.lit(2.0), near) > x, near - 1).when(F.pow(F.lit(2.0), near + 1) <= x, near + 1).otherwise(near)  # log2 may miss a power of two
    unit = F.pow(F.lit(2.0), F.greatest(exponent, F.lit(-14)) - 10)
    rounded = F.bround(x / unit, 0) * unit
    return F.when(rounded > 65504.0, F.lit(float("inf"))).otherwise(rounded).cast("float")


def dequantize(blocks: Column, numel: Column) -> Column:
    return F.slice(F.flatten(F.transform(blocks, lambda b: F.transform(b["q"], lambda q: (q * b["scale"]).cast("float")))), F.lit(1), numel)


#: Matrices of a site's row that are stored in int8 where that is asked for; variances and weights stay as they are.
COMPACT = ("pca_components", "gmm_means")


def compacted(sites: DataFrame) -> DataFrame:
    """Site rows with their matrices as ``struct<width, numel, blocks>``."""
    have = [c for c in COMPACT if c in sites.columns]
    pack = lambda m: F.when(m.isNotNull(), F.struct(F.coalesce(F.size(F.try_element_at(m, F.lit(1))), F.lit(0)).alias("width"), F.size(F.flatten(m)).alias("numel"), quantized(F.flatten(m)).alias("blocks")))
    return sites.withColumns({c: pack(F.col(c)) for c in have})


def expanded(sites: DataFrame) -> DataFrame:
    """Site rows with their matrices as matrices again, whether they were stored compactly or not."""
    packed = [c for c in COMPACT if c in sites.columns and dict(sites.dtypes)[c].startswith("struct")]

    def unpack(c: str) -> Column:
        flat, width = dequantize(F.col(f"{c}.blocks"), F.col(f"{c}.numel")), F.greatest(F.col(f"{c}.width"), F.lit(1))
        n_rows = (F.col(f"{c}.numel") / width).cast("int")
        held = F.transform(F.array(flat), lambda v: F.transform(F.sequence(F.lit(0), n_rows - 1), lambda r: F.transform(F.slice(v, r * width + 1, width), lambda x: x.cast("double"))))
        return F.when(n_rows > 0, held[0]).when(n_rows == 0, F.array().cast("array<array<double>>"))

    return sites.withColumns({c: unpack(c) for c in packed})
