"""Draws from site statistics; every draw is a function of seed, site and its own number, never of the partitioning."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.seeded import normal, order_key, uniform
from lodestone.operators.ranking import first_of_each, with_prefix

#: Rows drawn by one task of ``sample_sites``.
DRAW_BLOCK = 4096


def sample_diagonal(stats: DataFrame, site: str, n: int, seed: int = 42) -> DataFrame:
    """``site, draw, v``: n draws a site from a normal with its mean and std, coordinate by coordinate."""
    drawn = stats.select(site, "mean", "std", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("draw"))
    dims = F.sequence(F.lit(0), F.size("mean") - 1)
    v = F.transform(dims, lambda d: F.element_at("mean", d + 1) + F.element_at("std", d + 1) * normal(seed, "diagonal", F.col(site), F.col("draw"), d))
    return drawn.select(site, "draw", v.alias("v"))


def rung(row: pd.Series) -> str:
    """The finest level of fidelity that a site's row supports."""
    known = lambda c: c in row.index and row[c] is not None and np.size(row[c]) > 0
    if known("gmm_weights") and known("gmm_means") and known("pca_components"):
        return "gmm"
    if known("pca_components") and known("pca_eigenvalues"):
        return "pca"
    return "diagonal" if known("mean") and known("std") else "none"


def sample_sites(stats: DataFrame, site: str, n: int, seed: int = 42, level: str = "best") -> DataFrame:
    """``site, rung, draw, v``: n draws a site at the given level (gmm, pca, diagonal) or the best it has.

    A mixture is drawn in the principal basis and carried back; what the basis doesn't span is added as independent
    noise of the remaining variance. Blocks of DRAW_BLOCK draws are seeded and drawn apart from each other, so
    one site's draws spread over many tasks. A site without statistics gives no rows."""
    kind = stats.schema[site].dataType.simpleString()
    wanted = ["mean", "std", "pca_components", "pca_eigenvalues", "gmm_weights", "gmm_means", "gmm_covariances"]
    have = [c for c in wanted if c in stats.columns]
    blocks = stats.select(F.col(site).alias("site"), *have, F.explode(F.sequence(F.lit(0), F.lit((n - 1) // DRAW_BLOCK))).alias("block"))

    def draw(batches):
        for pdf in batches:
            for _, r in pdf.iterrows():
                at = rung(r) if level == "best" else level
                if at == "none":
                    continue
                m = min(DRAW_BLOCK, n - int(r.block) * DRAW_BLOCK)
                rng = np.random.default_rng(int.from_bytes(hashlib.sha256(f"{seed}:{r.site}:{r.block}".encode()).digest()[:8], "big"))
                mean, std = np.asarray(r["mean"]), np.asarray(r["std"])
                if at == "diagonal":
                    x = mean + std * rng.standard_normal((m, len(mean)))
                else:
                    axes = np.stack(r.pca_components)
                    lam = np.asarray(r.pca_eigenvalues)[: axes.shape[1]]
                    if at == "pca":
                        z = rng.standard_normal((m, len(lam))) * np.sqrt(lam)
                    else:
                        w = np.asarray(r.gmm_weights)
                        k = rng.choice(len(w), m, p=w / w.sum())
                        z = np.stack(r.gmm_means)[k] + np.sqrt(np.stack(r.gmm_covariances))[k] * rng.standard_normal((m, len(lam)))
                    left = np.sqrt(np.maximum(std**2 - (axes**2) @ lam, 0))
                    x = mean + z @ axes.T + left * rng.standard_normal((m, len(mean)))
                yield pd.DataFrame({"site": r.site, "rung": at, "draw": np.arange(m) + int(r.block) * DRAW_BLOCK, "v": list(x)})

    return blocks.mapInPandas(draw, f"site {kind}, rung string, draw long, v array<double>").withColumnRenamed("site", site)


def sample_categorical(weights: DataFrame, item: str, weight: str, n: int, seed: int = 42, buckets: int = 1024) -> DataFrame:
    """``draw, item``: n draws with replacement in proportion to the weights; items of weight 0 or null are never drawn.

    Items lie on the line of cumulative weight in order of their value. Draws and items meet by an equi-join on the
    line's buckets: an item stands in every bucket it reaches into, a draw in one."""
    live = weights.filter(F.col(weight) > 0).select(F.col(item).alias("_item"), F.col(weight).cast("double").alias("_w"))
    run = with_prefix(live, F.sha2(F.col("_item").cast("string"), 256), {"hi": F.col("_w")}, tie="_item")
    total = live.agg(F.sum("_w").alias("total")).withColumn("one", F.lit(1))  # one row
    placed = run.withColumn("one", F.lit(1)).join(F.broadcast(total), "one").select("_item", ((F.col("hi") - F.col("_w")) / F.col("total")).alias("lo"), (F.col("hi") / F.col("total")).alias("hi"))
    reach = placed.select("*", F.explode(F.sequence(F.floor(F.col("lo") * buckets), F.least(F.floor(F.col("hi") * buckets), F.lit(buckets - 1).cast("long")))).alias("b"))
    draws = weights.sparkSession.range(n).select(F.col("id").alias("draw"), uniform(seed, "categorical", F.col("id")).alias("u")).withColumn("b", F.floor(F.col("u") * buckets))
    return draws.join(reach, "b").filter((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).select("draw", F.col("_item").alias(item))


def sample_lookup(vectors: DataFrame, item: str, vector: str, n: int, seed: int = 42, weight: str | None = None) -> DataFrame:
    """``draw, item, v``: n rows of a table of vectors, with replacement: in proportion to ``weight`` (an item of weight 0 or null is
    never drawn), or uniformly. Items are distinct; a table without a weight above 0 gives no draws. Only drawn
    vectors leave the scan."""
    known = vectors.select(F.col(item), (F.col(weight) if weight else F.lit(1)).alias("_weight"))
    drawn = sample_categorical(known, item, "_weight", n, seed)
    return drawn.join(vectors.select(F.col(item), F.col(vector).cast("array<double>").alias("v")), item).select("draw", item, "v")


def sample_best(stats: DataFrame, site: str, n: int, seed: int = 42, lookup: DataFrame | None = None, lookup_site=None, item: str = "item", vector: str = "v", weight: str | None = None) -> DataFrame:
    """``site, rung, draw, v`` at the finest level each site has: rows of the ``lookup`` table itself for ``lookup_site``, else mixture,
    principal basis or diagonal (``sample_sites``)."""
    fitted = sample_sites(stats if lookup is None else stats.filter(~F.col(site).eqNullSafe(F.lit(lookup_site))), site, n, seed)
    if lookup is None:
        return fitted
    exact = sample_lookup(lookup, item, vector, n, seed, weight)
    return fitted.unionByName(exact.select(F.lit(lookup_site).cast(stats.schema[site].dataType).alias(site), F.lit("lookup").alias("rung"), "draw", "v"))


def sample_isotropic(control: DataFrame, site: str, n: int, seed: int = 42, mode: str = "matched") -> DataFrame:
    """``site, draw, v``: n draws a site with the same spread in every direction: ``matched`` about the mean with the sigma of
    ``isotropic_moments``, ``unit`` about zero with 1, for as many dimensions as the mean has."""
    if mode not in ("matched", "unit"):
        raise ValueError(f"the mode is matched or unit, not {mode!r}")
    drawn = control.select(site, "mean", "sigma", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("draw"))
    noise = lambda d: normal(seed, "isotropic", F.col(site), F.col("draw"), d)
    v = F.transform("mean", (lambda m, d: m + F.col("sigma") * noise(d)) if mode == "matched" else (lambda m, d: noise(d)))
    return drawn.select(site, "draw", v.alias("v"))


def isotropic_moments(vectors: DataFrame, site: str, vector: str, weight: str | None = None) -> DataFrame:
    """``site, n, mean, sigma``: a matched isotropic control: each site's mean and the root of its average variance (population),
    where given in proportion to ``weight``; rows of weight 0 or null don't count."""
    rows = vectors.select(site, (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"), F.posexplode(vector).alias("d", "x")).filter("w > 0")
    x, w = F.col("x").cast("double"), F.sum("w")
    mean = F.sum(F.col("w") * x) / w
    d = rows.groupBy(site, "d").agg(F.count("x").alias("n"), (F.avg("x") if weight is None else mean).alias("m"), (F.var_pop("x") if weight is None else F.greatest(F.sum(F.col("w") * x * x) / w - mean * mean, F.lit(0.0))).alias("v"))
    return d.groupBy(site).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("mean"), F.sqrt(F.avg("v")).alias("sigma"))


def decorrelated(vectors: DataFrame, site: str, id_column: str, vector: str, seed: int = 42) -> DataFrame:
    """``site, id_column, d, x``: every coordinate shuffled by itself inside its site: the marginals stay, what ties them goes.

    Each value moves from its place in one seeded order to the vector at that place in another; both places are
    prefix counts, so no task orders a whole site."""
    long = vectors.select(site, id_column, F.posexplode(vector).alias("d", "x"))
    place = lambda which: with_prefix(long, order_key(seed, which, F.col("d"), F.col(id_column)), by=(site, "d"), tie=id_column)
    to, source = place("to").select(site, "d", "rnk", id_column), place("from").select(site, "d", "rnk", "x")
    return to.join(source, [site, "d", "rnk"]).select(site, id_column, "d", "x")


def first_per_site(vectors: DataFrame, site: str, order: str, n: int) -> DataFrame:
    """The first n vectors of each site in the order of a column; only those near the limit are shuffled."""
    return first_of_each(vectors, site, n, order=order).drop("place")
