"""Whole preparations: files to documents, several sources to one corpus, a writer's output to pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.folds import clean_text, parse_questions_column, passages_column, split_documents_column
from lodestone.functions.text import answer_text, cut_at_marker, leaks_json, refers_to_source, repeat_share
from lodestone.operators.corpora import forest_pairs, head_samples, pair_quota, ratio_mix
from lodestone.operators.documents import REFUSE_SHARE, PreparationRefused, attribution, min_documents_for_held_out, ordered_overlap
from lodestone.operators.lineage import materialise
from lodestone.sources.files import extract, find_files
from lodestone.sources.sinks import if_written, write_batch

MIN_SPLIT = 500
REASONS = ["unparseable_passage", "leaked_json", "refers_to_source", "duplicate", "truncated_answer", "short_answer"]


def prepare_documents(spark: SparkSession, inputs: list[str], existing: DataFrame | None = None, split_chars: int | None = None, min_length: int = 1000, val_fraction: float = 0.1, pdf_converter=None) -> tuple[DataFrame, dict]:
    """``(documents, report)``: the files cleaned, long enough, split if asked for; ``documents`` has ``path, piece, text``.

    Refused, before anything is written: a split size under MIN_SPLIT, an input of which half the sentence text is
    already in ``existing`` (``name, text``) or in an earlier input, both together; the message names who holds most of it. The report has the number of documents, how many
    are missing for a held-out split, and as ``shared`` the inputs that are shared in part, a DataFrame of ``path, share``
    with all of them."""
    if split_chars is not None and split_chars < MIN_SPLIT:
        raise PreparationRefused(f"a split size of {split_chars} is below {MIN_SPLIT}")
    texts = extract(find_files(spark, inputs), pdf_converter).select("path", clean_text(F.col("text")).alias("text")).filter(F.length("text") >= min_length)
    texts = materialise(texts)
    shares = ordered_overlap(texts, "path", existing=existing).select("path", "share", "verdict")
    shared = materialise(shares.filter("verdict <> 'ok'").select("path", "share"))
    worst = shared.orderBy(F.desc("share"), "path").first()
    if worst and worst["share"] >= REFUSE_SHARE:
        raise PreparationRefused(f"{worst['path']}: {worst['share']:.0%} of its text has been prepared already, in {_held_by(texts, existing, worst['path'])}")
    pieces = split_documents_column(F.col("text"), split_chars) if split_chars else F.array("text")
    documents = texts.select("path", F.posexplode(pieces).alias("piece", "text"))
    n = documents.count()
    return documents, {"n_documents": n, "missing": max(0, min_documents_for_held_out(val_fraction) - n), "shared": shared}


def _held_by(texts: DataFrame, existing: DataFrame | None, path: str, top: int = 3) -> str:
    """The names that hold most of an input's text: existing texts and earlier inputs."""
    holders = texts.filter(F.col("path") < path).select(F.col("path").alias("name"), "text")
    if existing is not None:
        holders = holders.unionByName(existing.select("name", "text"))
    best = attribution(texts.filter(F.col("path") == path), holders, "path", "name", top).orderBy("place").collect()  # ``top`` rows
    more = best[0]["n_holders"] - len(best) if best else 0
    return ", ".join(r["name"] for r in best) + (f" and {more} more" if more else "")


def build_corpus(rows: DataFrame, pairs: DataFrame, messages: DataFrame, quotas: dict[str, int], pair_quota_each: int, seed: int = 42) -> DataFrame:
    """``side, key, place``: the text samples and the instruction pairs of all sources in the ratio of ten to one, shuffled.
    ``pairs`` has ``source, row_id, prompt, response``; the message forest gives the source ``oasst2``."""
    text = head_samples(rows, quotas, seed).select(F.concat_ws(":", "source", F.col("row_id").cast("string")).alias("key"))
    tree = forest_pairs(messages).select(F.lit("oasst2").alias("source"), F.concat_ws("/", "message_id", "reply_id").alias("row_id"), "prompt", "response")
    every = pairs.select("source", F.col("row_id").cast("string").alias("row_id"), "prompt", "response").unionByName(tree)
    instruction = pair_quota(every, pair_quota_each, seed).select(F.concat_ws(":", "source", "row_id").alias("key"))
    return ratio_mix(text, instruction, "key", (10, 1), seed)


def generated_share(spark: SparkSession, generate: Callable[[list[int]], list[str]], asked: int, markers: list[str], min_chars: int = 200, max_repeat: float = 0.5) -> tuple[DataFrame, dict]:
    """``(draw, text)`` of an injected generator's draws that pass, with the tally of kept and rejected ones."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"draw": b.id, "raw": generate(b.id.tolist())})

    drawn = spark.range(asked).mapInPandas(draw, "draw long, raw string").withColumn("text", cut_at_marker(F.col("raw"), markers))
    judged = materialise(drawn.withColumn("kept", (F.length("text") >= min_chars) & (repeat_share(F.col("text")) <= max_repeat)))
    tally = judged.agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("rejected")).first()
    return judged.filter("kept").select("draw", "text"), tally.asDict()


def judged_questions(outputs: DataFrame, order: list[str], output: str) -> DataFrame:
    """First pass of a supplement: ``order…, question_ix, question, reason``, the reason null for a question that is kept.

    Reasons in order: unparseable_passage, leaked_json, refers_to_source, duplicate (of a question kept earlier; a
    rejected one is never the first)."""
    parsed = outputs.select(*order, parse_questions_column(F.coalesce(output, F.lit(""))).alias("qs"))
    each = parsed.select(*order, F.posexplode_outer("qs").alias("question_ix", "question"))
    empty = F.lit("")
    reason = F.when(F.col("question").isNull(), "unparseable_passage").when(leaks_json(F.col("question"), empty), "leaked_json").when(refers_to_source(F.col("question"), empty), "refers_to_source")
    first = each.withColumn("reason", reason)
    place = F.struct(*order, "question_ix")
    earliest = first.filter("reason is null").groupBy(F.col("question").alias("q")).agg(F.min(place).alias("first"))
    joined = first.join(earliest, (F.col("question") == F.col("q")) & F.col("reason").isNull(), "left")
    return joined.select(*order, "question_ix", "question", F.when(F.col("reason").isNull() & (place != F.col("first")), "duplicate").otherwise(F.col("reason")).alias("reason"))


def judged_answers(pairs: DataFrame, question: str, output: str, stops: list[str], min_chars: int = 40) -> DataFrame:
    """Second pass: the pairs with ``answer`` and ``reason``: truncated_answer, leaked_json, refers_to_source, short_answer."""
    cut = pairs.withColumn("_a", answer_text(F.coalesce(output, F.lit("")), stops))
    a = F.col("_a.answer")
    reason = F.when(~F.col("_a.finished"), "truncated_answer").when(leaks_json(F.col(question), a), "leaked_json").when(refers_to_source(F.col(question), a), "refers_to_source").when(F.length(a) < min_chars, "short_answer")
    return cut.withColumns({"answer": a, "reason": reason}).drop("_a")


def supplement(documents: DataFrame, doc_id: str, ask: Callable[[list[str]], list[str]], reply: Callable[[list[str], list[str]], list[str]], stops: list[str]) -> tuple[DataFrame, DataFrame]:
    """``(pairs, judged)``: question-answer pairs from documents by an injected writer, in two passes, and every rejected item
    with its reason. ``ask`` gets passages, ``reply`` passages and questions."""
    passages = documents.select(F.col(doc_id).alias("source_index"), F.posexplode(passages_column(F.col("text"))).alias("passage_index", "passage"))
    kind = passages.schema["source_index"].dataType.simpleString()

    def asked(batches):
        for b in batches:
            yield b.assign(output=ask(b.passage.tolist()))

    def replied(batches):
        for b in batches:
            yield b.assign(output=reply(b.passage.tolist(), b.question.tolist()))

    written = materialise(passages.mapInPandas(asked, f"source_index {kind}, passage_index int, passage string, output string"))
    order = ["source_index", "passage_index"]
    questions = materialise(judged_questions(written, order, "output"))
    kept = questions.filter("reason is null").join(written.select(*order, "passage"), order).drop("reason")
    answers = kept.mapInPandas(replied, f"source_index {kind}, passage_index int, question_ix int, question string, passage string, output string")
    judged = materialise(judged_answers(answers, "question", "output", stops))
    pairs = judged.filter("reason is null").select(F.col("question").alias("prompt"), F.col("answer").alias("response"), *order)
    return pairs, questions.select("reason").unionByName(judged.select("reason")).filter("reason is not null")


class DegenerateCorpus(RuntimeError):
    """A generator whose draws are mostly empty, or too few in the end."""


def write_generated_corpus(spark: SparkSession, generate: Callable[[list[int]], list[str]], path: str, wanted: int, markers: list[str], batch: int = 256, max_empty_fraction: float = 0.2, min_docs: int = 50, min_chars: int = 200, max_repeat: float = 0.5) -> dict:
    """Draws until ``wanted`` texts pass, batch by batch, each batch a partition of ``path``: empty draws are replaced by later
    ones. A writer that was interrupted goes on after its last whole batch, with the same draws. Refused once the
    rejected draws exceed ``max_empty_fraction`` of those asked for, or with fewer than ``min_docs`` texts.

    The state is what is written: every batch's rows carry what became of each draw."""
    schema = "draw long, text string, kept boolean, batch int"

    def standing() -> DataFrame:
        written = if_written(lambda: spark.read.schema(schema).parquet(path))
        return spark.createDataFrame([], schema) if written is None else written

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"draw": b.id, "raw": generate(b.id.tolist())})

    while True:
        t = standing().agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("empty"), F.coalesce(F.max("batch") + 1, F.lit(0)).alias("next")).first()
        if t["empty"] > max_empty_fraction * wanted:
            raise DegenerateCorpus(f"{t['empty']} of {t['kept'] + t['empty']} draws were empty or looping")
        if t["kept"] >= wanted:
            break
        ids = spark.range(t["next"] * batch, (t["next"] + 1) * batch)
        drawn = ids.mapInPandas(draw, "draw long, raw string").withColumn("text", cut_at_marker(F.coalesce("raw", F.lit("")), markers))
        kept = (F.length("text") >= min_chars) & (repeat_share(F.col("text")) <= max_repeat)
        write_batch(drawn.select("draw", "text", kept.alias("kept")), path, int(t["next"]))
    if min(t["kept"], wanted) < min_docs:
        raise DegenerateCorpus(f"{t['kept']} texts, fewer than {min_docs}")
    return {"kept": int(t["kept"]), "empty": int(t["empty"]), "batches": int(t["next"])}


def read_generated_corpus(spark: SparkSession, path: str, wanted: int) -> DataFrame:
    """``draw, text`` of the first ``wanted`` texts that passed, in the order of their draws."""
    return spark.read.parquet(path).filter("kept").orderBy("draw").limit(wanted).select("draw", "text")
