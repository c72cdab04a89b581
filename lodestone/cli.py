"""Command line: the data-plane commands. Refusals are one line and exit 2; an interrupt exits 130."""

from __future__ import annotations

import argparse
import importlib
import json
import re
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestone.operators import corpora, metrics, mixture, vectors
from lodestone.operators.checks import ForeignArtifact, Settings, make_meta
from lodestone.operators.documents import PreparationRefused
from lodestone.operators.lineage import materialise
from lodestone.plans import prepare
from lodestone.sources import files, sinks, store

REFUSALS = (PreparationRefused, ForeignArtifact, files.SourceUnavailable, files.MissingExtra, store.StoreLocked, prepare.DegenerateCorpus, ValueError)
#: Commands that run or train a language model; they take a runtime that isn't part of this library.
MODEL_COMMANDS = ("init", "train", "fuse", "regenerate-artifact", "probe-artifact")


def session() -> SparkSession:
    return SparkSession.builder.appName("lodestone").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def named(path: str):
    """``module:function`` as the function."""
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


def prepare_domain(a) -> dict:
    spark = session()
    existing = spark.read.parquet(a.out).select("name", "text") if a.existing else None
    documents, report = prepare.prepare_documents(spark, a.inputs, existing, a.split_chars, a.min_length, a.val_fraction)
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), "\\.[A-Za-z]+$", "")
    written = sinks.write_documents(documents.withColumn("stem", stem).withColumn("o", F.concat_ws(":", "path", F.lpad(F.col("piece").cast("string"), 6, "0"))), a.out, "stem", "o")
    shared = {r["path"]: r["share"] for r in report["shared"].orderBy(F.desc("share"), "path").toLocalIterator()}
    return {**report, "shared": shared, "written": written.count()}


def prepare_seed_corpus(a) -> dict:
    spark = session()
    rows, messages = spark.read.parquet(a.rows), spark.read.parquet(a.messages)
    quotas = {r["name"]: r["quota"] for r in corpora.allocate(spark.createDataFrame(list(corpora.DEFAULT_SAMPLES.items()), "name string, n int"), a.total).collect()}
    pairs = rows.filter("prompt is not null").select("source", "row_id", "prompt", "response")
    mixed = prepare.build_corpus(rows, pairs, messages, quotas, a.pairs, a.seed)
    mixed.write.mode("overwrite").parquet(a.out)
    return {"rows": spark.read.parquet(a.out).count()}


def prepare_supplement(a) -> dict:
    docs = session().read.parquet(a.documents).select(F.monotonically_increasing_id().alias("doc"), "text")
    pairs, rejected = prepare.supplement(docs, "doc", named(a.ask), named(a.reply), a.stop)
    pairs.write.mode("overwrite").json(a.out)
    return {r["reason"]: r["n"] for r in corpora.rejection_tally(rejected, prepare.REASONS).collect()}


def build_artifact(a) -> dict:
    v = session().read.parquet(a.vectors)
    sites = materialise(vectors.fit_sites(v, a.site, a.id, a.vector, a.components, seed=a.seed))
    found = sites.select(F.col(a.site).cast("string").alias("s"), F.size("mean").alias("w"), "n_samples").orderBy("s").collect()  # a row a site
    layers = {m[1] for r in found if (m := re.match(r"(\d+)_", r.s or ""))}
    meta = make_meta(a.model, max((r.w for r in found), default=0), len(layers), [r.s for r in found], max((r.n_samples for r in found), default=0), provenance=a.provenance)
    sinks.write_artifact(sites, a.out, meta, a.int8)
    return {"sites": files.read_artifact(session(), a.out).count()}


def extend(a) -> dict:
    spark = session()
    meta = files.read_meta(spark, a.artifact)
    if a.name in meta.get("extended_with", []):
        raise ValueError(f"{a.artifact} has been extended with {a.name} already")
    base = files.read_artifact(spark, a.artifact)
    width = spark.read.parquet(a.vectors).select(F.size(a.vector).alias("w")).filter("w >= 0").limit(1).collect()
    if width and meta["hidden_size"] and width[0].w != meta["hidden_size"]:
        raise ValueError(f"vectors of {width[0].w} numbers don't fit a statistic of {meta['hidden_size']}")
    added = mixture.domain_mixtures(spark.read.parquet(a.vectors), base, a.site, a.id, a.vector, seed=a.seed, size=a.need)
    merged = mixture.merge_artifacts(base, added, a.site)
    sinks.write_artifact(merged, a.out, {**meta, "version": meta.get("version", 1) + 1, "extended_with": [*meta.get("extended_with", []), a.name]})
    return {"sites": files.read_artifact(spark, a.out).count()}


def evaluate(a) -> dict:
    scores = session().read.json(a.scores)
    table = metrics.perplexity_table(scores, "axis", "stage", "value", a.stages)
    return {r["axis"]: {k: v for k, v in r.asDict().items() if k != "axis"} for r in table.collect()}


def list_artifacts(a) -> list[dict]:
    return store.ResultStore(a.root).entries()


def load_yaml(f):
    try:
        import yaml
    except ImportError:
        raise files.MissingExtra("a YAML specification takes the yaml package; write it as JSON") from None
    return yaml.safe_load(f)


def chain(a) -> list[dict]:
    with open(a.spec) as f:
        steps = load_yaml(f) if a.spec.endswith((".yaml", ".yml")) else json.load(f)
    known = {name: _stage(run) for name, run in (("prepare-domain", prepare_domain), ("prepare-seed-corpus", prepare_seed_corpus), ("prepare-supplement", prepare_supplement), ("build-artifact", build_artifact), ("extend", extend), ("evaluate", evaluate))}
    return store.run_chain(steps, known, store.Ledger(a.ledger), a.resume)


def _stage(command):
    """A command as a stage: options that aren't given have the command line's defaults."""
    name = command.__name__.replace("_", "-")

    def run(**options):
        sub = next(x for x in parser()._subparsers._group_actions).choices[name]
        defaults = {x.dest: x.default for x in sub._actions if x.dest != "help"}
        if unknown := set(options) - set(defaults):
            raise ValueError(f"{name}: unknown options {sorted(unknown)}")
        return command(argparse.Namespace(**{**defaults, **options}))

    return run


def check_settings(a) -> dict:
    s = Settings.load(a.path)
    return {"name": s.name, "warnings": s.warnings(a.rank if a.rank else s.calibrated_rank)}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestone")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name, run, *arguments):
        c = sub.add_parser(name)
        for flags, options in arguments:
            c.add_argument(*flags, **options)
        c.set_defaults(run=run)

    req = lambda *flags, **o: (flags, {"required": True, **o})
    opt = lambda *flags, **o: (flags, o)
    common = (opt("--site", default="site"), opt("--id", default="vec_id"), opt("--vector", default="v"), opt("--seed", type=int, default=42))
    command("prepare-domain", prepare_domain, opt("inputs", nargs="+"), req("--out"), opt("--split-chars", type=int), opt("--min-length", type=int, default=1000), opt("--val-fraction", type=float, default=0.1), opt("--existing", action="store_true"))
    command("prepare-seed-corpus", prepare_seed_corpus, req("--rows"), req("--messages"), req("--out"), opt("--total", type=int, default=12000), opt("--pairs", type=int, default=5000), opt("--seed", type=int, default=42))
    command("prepare-supplement", prepare_supplement, req("--documents"), req("--out"), req("--ask", help="module:function"), req("--reply", help="module:function"), opt("--stop", nargs="*", default=["<|im_end|>"]))
    command("build-artifact", build_artifact, req("--vectors"), req("--out"), req("--model"), opt("--components", type=int, default=32), opt("--provenance"), opt("--int8", action="store_true"), *common)
    command("extend", extend, req("--artifact"), req("--vectors"), req("--out"), req("--name"), opt("--need", type=int, default=40000), *common)
    command("evaluate", evaluate, req("--scores"), opt("--stages", nargs="+", default=["before", "after"]))
    command("list-artifacts", list_artifacts, req("--root"))
    command("chain", chain, opt("spec"), req("--ledger"), opt("--resume", action="store_true"))
    command("check-settings", check_settings, opt("path"), opt("--rank", type=int))
    for name in MODEL_COMMANDS:
        command(name, None)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.run is None:
        print(f"{a.command} takes a language-model runtime, which this library doesn't have", file=sys.stderr)
        return 2
    try:
        print(json.dumps(a.run(a), sort_keys=True))
        return 0
    except REFUSALS as e:
        print(f"{a.command}: {str(e).splitlines()[0]}", file=sys.stderr)
        return 2
    except KeyboardInterrupt:
        return 130


if __name__ == "__main__":
    sys.exit(main())
