"""Reading documents, JSON records, pairs and statistics from files."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.folds import html_to_markdown_column
from lodestone.operators.checks import require_own
from lodestone.operators.mixture import expanded

#: What can be prepared, and the fields in which a record's text is looked for, in order.
EXTENSIONS = ("txt", "md", "html", "htm", "pdf")
TEXT_FIELDS = ("text", "content", "body", "document", "passage")


class SourceUnavailable(RuntimeError):
    """A source that can't be read."""


class MissingExtra(ImportError):
    """A format whose reader isn't installed."""


def decode_utf8(content: Column) -> Column:
    """Bytes as text; bytes that aren't UTF-8 become replacement characters."""
    return F.make_valid_utf8(content.cast("string"))


def find_files(spark: SparkSession, inputs: list[str], recursive: bool = True) -> DataFrame:
    """``path, ord, extension, content`` of the files that can be prepared, each once, in the order of their paths.

    Files are kept by extension, directories searched. ``ord`` is that of the path itself, so it costs no global
    sort of contents. A path that doesn't exist raises SourceUnavailable."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(inputs)
    except AnalysisException as e:
        raise SourceUnavailable(str(e).splitlines()[0]) from e
    kept = files.withColumn("extension", F.lower(F.regexp_extract("path", "\\.([A-Za-z]+)$", 1))).filter(F.col("extension").isin(*EXTENSIONS))
    return kept.select("path", "extension", "content").dropDuplicates(["path"]).withColumn("ord", F.col("path"))


def extract(files: DataFrame, pdf_converter: Callable[[bytes], str] | None = None) -> DataFrame:
    """``path, ord, text``: plain text and Markdown decoded, HTML to Markdown, PDF through the given converter.

    The converter is called for each file in the tasks that hold it; PDF files without one raise MissingExtra."""
    plain = files.filter(F.col("extension").isin("txt", "md")).select("path", "ord", decode_utf8(F.col("content")).alias("text"))
    pages = files.filter(F.col("extension").isin("html", "htm")).select("path", "ord", html_to_markdown_column(decode_utf8(F.col("content"))).alias("text"))
    out = plain.unionByName(pages)
    pdf = files.filter(F.col("extension") == "pdf")
    if pdf_converter is None:
        if not pdf.isEmpty():
            raise MissingExtra("reading PDF files takes a converter: pass pdf_converter")
        return out

    def convert(batches):
        for b in batches:
            yield pd.DataFrame({"path": b.path, "ord": b.ord, "text": [pdf_converter(c) for c in b.content]})

    return out.unionByName(pdf.select("path", "ord", "content").mapInPandas(convert, "path string, ord string, text string"))


def record_text(record: Column) -> Column:
    """The text of a JSON record: the first of TEXT_FIELDS that holds a string, an empty one included; else prompt and
    response, a line each. Numbers and objects don't count as strings. Null where there is nothing."""
    v = F.try_parse_json(record)
    string = lambda f: F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{f}", "variant")) == "STRING", F.try_variant_get(v, f"$.{f}", "string"))
    joined = F.nullif(F.trim(F.concat_ws("\n", string("prompt"), string("response"))), F.lit(""))
    return F.coalesce(*[string(f) for f in TEXT_FIELDS], joined)


def _lines(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """``path, block, line, value`` of the lines of text files. (path, block, line) is the order of the lines: ``block`` is
    where the split begins in its file, and ids grow inside a split, so a long file is read by many tasks."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """``path, block, line, text`` of every document under a path: a text or Markdown file whole, a line of a JSON-lines file,
    an element of a JSON file (an object or an array of them). Blank documents are left out; (path, block, line) is
    their order."""
    whole_files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{txt,md,json}").load(path)
    kinds = whole_files.select("path", F.lower(F.regexp_extract("path", "\\.([A-Za-z]+)$", 1)).alias("kind"), decode_utf8(F.col("content")).alias("content"))
    zero = F.lit(0).cast("long")
    whole = kinds.filter("kind <> 'json'").select("path", zero.alias("block"), zero.alias("line"), F.col("content").alias("text"))
    lines = _lines(spark, path, "*.jsonl").filter("trim(value) <> ''").select("path", "block", "line", F.col("value").alias("r"))
    parsed = kinds.filter("kind = 'json'").select("path", F.try_parse_json("content").alias("v"))
    items = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.array(F.col("v")))
    elements = parsed.filter("v is not null").select("path", F.posexplode(items).alias("line", "e")).select("path", zero.alias("block"), F.col("line").cast("long").alias("line"), F.to_json("e").alias("r"))
    records = lines.unionByName(elements).select("path", "block", "line", record_text(F.col("r")).alias("text"))
    return whole.unionByName(records).filter(F.col("text").rlike("\\S"))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """``path, block, line, prompt, response`` of JSON-lines files of pairs, in the order (path, block, line); lines without
    a prompt are left out."""
    rows = _lines(spark, path, "*.jsonl")
    pair = rows.select("path", "block", "line", F.from_json("value", "prompt string, response string").alias("p"))
    return pair.select("path", "block", "line", "p.prompt", F.coalesce("p.response", F.lit("")).alias("response")).filter(F.coalesce(F.trim("prompt"), F.lit("")) != "")


def load_source(spark: SparkSession, loader: Callable[[SparkSession, str], DataFrame], path: str) -> DataFrame:
    """A table by an injected loader; whatever it raises comes as SourceUnavailable."""
    try:
        return loader(spark, path)
    except Exception as e:
        raise SourceUnavailable(f"{path}: {e}") from e


def read_meta(spark: SparkSession, path: str) -> dict:
    """The metadata of a stored statistic; one without (an interrupted writer's) is unavailable, another program's foreign."""
    try:
        return require_own(json.loads(spark.read.parquet(f"{path}/meta").first()["meta"]))
    except AnalysisException as e:
        raise SourceUnavailable(str(e).splitlines()[0]) from e


def read_artifact(spark: SparkSession, path: str) -> DataFrame:
    """The site rows of a stored statistic, compact matrices expanded; see ``sources.sinks.write_artifact``. Refused if its
    metadata isn't of this library (``read_meta``)."""
    read_meta(spark, path)
    try:
        return expanded(spark.read.parquet(f"{path}/sites"))
    except AnalysisException as e:
        raise SourceUnavailable(str(e).splitlines()[0]) from e
