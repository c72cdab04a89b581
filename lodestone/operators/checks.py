"""Checks of stored statistics, pins, settings and histories: each gives its violations as rows or raises before any work."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Who wrote a statistic, and which layouts are read.
BUILT_WITH, FORMATS = "lodestone", (1, 2)


class ForeignArtifact(ValueError):
    """A statistic that wasn't built here, or not in a form that is read."""


def artifact_violations(sites: DataFrame, layer: str = "layer", site: str = "site", width: str | None = None, expected: DataFrame | None = None) -> DataFrame:
    """``layer, site, problem`` of every site row that can't be used: a mixture that isn't diagonal, weights that don't sum to
    1, moments of unlike length; with ``expected`` (layer, site, width) also rows that are missing, unknown or of another
    width. No rows: the statistic is sound."""
    w = F.coalesce(F.size("mean"), F.lit(0)) if width is None else F.col(width)
    total = F.aggregate(F.coalesce("gmm_weights", F.array().cast("array<double>")), F.lit(0.0), lambda a, x: a + x)
    mixed = F.coalesce(F.col("gmm_n_components"), F.lit(0)) > 0
    kind = F.coalesce("gmm_covariance_type", F.lit("none")) if "gmm_covariance_type" in sites.columns else F.lit("diag")
    problem = F.when(mixed & (kind != "diag"), "mixture_not_diagonal").when(mixed & (F.abs(total - 1) > 1e-6), "weights_off_one").when(F.size("mean") != F.size("std"), "moments_of_unlike_length")
    own = sites.select(F.col(layer).alias("layer"), F.col(site).alias("site"), w.alias("w"), problem.alias("problem"))
    bad = own.filter("problem is not null").select("layer", "site", "problem")
    if expected is None:
        return bad
    e = expected.select(F.col("layer").alias("l"), F.col("site").alias("s"), F.col("width").alias("ew"))
    j = own.join(e, F.col("layer").eqNullSafe(F.col("l")) & F.col("site").eqNullSafe(F.col("s")), "full")
    gap = F.when(F.col("ew").isNull(), "unknown_site").when(F.col("w").isNull(), "missing_site").when(F.col("w") != F.col("ew"), "other_width")
    return bad.unionByName(j.select(F.coalesce("layer", "l").alias("layer"), F.coalesce("site", "s").alias("site"), gap.alias("problem")).filter("problem is not null"))


def require_own(meta: dict) -> dict:
    """A statistic's metadata, refused if another program wrote it or in a format that isn't read (none counts as 1)."""
    if meta.get("built_with") != BUILT_WITH:
        raise ForeignArtifact(f"built with {meta.get('built_with')!r}, not {BUILT_WITH}")
    if meta.get("format_version", 1) not in FORMATS:
        raise ForeignArtifact(f"format {meta.get('format_version')!r} isn't among {FORMATS}")
    return meta


def make_meta(model_id: str, hidden_size: int, num_layers: int, sites: list[str], n_samples: int, **more) -> dict:
    return {"model_id": model_id, "hidden_size": hidden_size, "num_layers": num_layers, "sites": sites, "n_samples_total": n_samples, "built_with": BUILT_WITH, "format_version": FORMATS[-1], **more}


def topology(sites: DataFrame, layer: str = "layer", site: str = "site", head: str = "pre_lm_head") -> DataFrame:
    """One row ``num_layers, hidden_dim, n_sites``: layers without the head's, the width of the first site."""
    return sites.agg(F.count_distinct(F.when(F.col(site) != head, F.col(layer))).alias("num_layers"), F.min(F.struct(layer, site, F.size("mean").alias("w")))["w"].alias("hidden_dim"), F.count(F.lit(1)).alias("n_sites"))


def pin_problem(value: Column, name: str) -> Column:
    """What is wrong with a pin's field, by its name: a hash, a size, an address; null if nothing is."""
    text = value.cast("string")
    if name.endswith("sha256"):
        return F.when(~F.coalesce(text.rlike("^[0-9a-f]{64}$"), F.lit(False)), f"{name}: not 64 lower-case hex digits")
    if name.endswith("size_bytes"):
        return F.when(~F.coalesce(text.try_cast("long") > 0, F.lit(False)), f"{name}: not a positive integer")
    if name.endswith("_url"):
        return F.when(~F.coalesce(text.startswith("https://"), F.lit(False)), f"{name}: not an https address")
    return F.when(value.isNull(), f"{name}: missing")


def key_differences(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, side``: keys of the left side alone (``missing``) and of the right side alone (``unknown``)."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.exceptAll(b).withColumn("side", F.lit("missing")).unionByName(b.exceptAll(a).withColumn("side", F.lit("unknown")))


def frame_differences(recorded: Column, wanted: Column) -> Column:
    """``array<struct<key, recorded, wanted>>``: the entries of two maps that differ, by key; a missing one is null."""
    keys = F.array_sort(F.array_union(F.map_keys(recorded), F.map_keys(wanted)))
    every = F.transform(keys, lambda k: F.struct(k.alias("key"), F.try_element_at(recorded, k).alias("recorded"), F.try_element_at(wanted, k).alias("wanted")))
    return F.filter(every, lambda e: ~e["recorded"].eqNullSafe(e["wanted"]))


def adapter_training(qkv: Column, mlp: Column) -> Column:
    """How an adapter was trained, by its two anchor weights: anchored, unanchored, or unknown where one isn't recorded."""
    return F.when(qkv.isNull() | mlp.isNull(), "unknown").when((qkv > 0) | (mlp > 0), "anchored").otherwise("unanchored")


def scored_as(named: Column, same_corpus: Column, held_out: Column) -> Column:
    """What a domain score measures: a fit, a whole corpus as named, or held-out text."""
    return F.when(named & same_corpus, "fit_on_named_training_corpus").when(named, "whole_as_named").when(held_out, "held_out").otherwise("fit_on_training_side")


@dataclass
class Settings:
    """An operating point: validated when made, so a file edited by hand fails before any work."""

    name: str
    model_id: str
    artifact: str = "self-generated"
    rank: int = 32
    lambda_qkv: float = 160_000.0
    lambda_mlp: float = 160_000.0
    mu: float = 0.05
    epochs: int = 15
    learning_rate: float = 3e-4
    lr_schedule: str = "cosine"
    batch_size: int = 6
    gradient_accumulation_steps: int = 1
    warmup_steps: int = 50
    sequence_length: int = 512
    seed: int = 42
    val_fraction: float = 0.1
    supplement_fraction: float = 0.13
    stage2_multiplier: float = 3.0
    calibrated_rank: int = 32
    frame: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        wrong = [
            (self.epochs < 1, "epochs must be at least 1"), (self.rank < 1, "rank must be at least 1"), (self.lr_schedule not in ("cosine", "constant"), "lr_schedule must be cosine or constant"),
            (self.stage2_multiplier <= 0, "stage2_multiplier must be positive"), (not 0 <= self.val_fraction < 1, "val_fraction must be in [0, 1)"), (not 0 <= self.supplement_fraction < 1, "supplement_fraction must be in [0, 1)"),
            (not isinstance(self.frame, dict), "frame must be a mapping"),
        ]
        for bad, why in wrong:
            if bad:
                raise ValueError(f"{self.name}: {why}")

    @classmethod
    def load(cls, path: str) -> Settings:
        """From a JSON file (or YAML, where its reader is installed); fields that are unknown or missing are named."""
        with open(path) as f:
            raw = f.read()
        if path.endswith(".json"):
            values = json.loads(raw)
        else:
            import yaml

            values = yaml.safe_load(raw)
        known = {f.name for f in dataclasses.fields(cls)}
        if extra := sorted(set(values) - known):
            raise ValueError(f"{path}: unknown fields {', '.join(extra)}")
        if lacking := sorted({"name", "model_id"} - set(values)):
            raise ValueError(f"{path}: missing fields {', '.join(lacking)}")
        return cls(**values)

    def stage_lambdas(self, stage: int) -> tuple[float, float]:
        """The anchor weights of a stage: the multiplier applies from the second on, once."""
        m = self.stage2_multiplier if stage > 1 else 1.0
        return self.lambda_qkv * m, self.lambda_mlp * m

    def warnings(self, rank: int, frame: dict | None = None) -> list[str]:
        """What is off the calibrated point; none of it is a refusal."""
        notes = [f"rank {rank} differs from the calibrated {self.calibrated_rank}"] if rank != self.calibrated_rank else []
        if frame is not None:
            notes += [f"{k} is {frame.get(k)!r}, calibrated at {self.frame.get(k)!r}" for k in sorted(set(frame) | set(self.frame)) if frame.get(k) != self.frame.get(k)]
        return notes
