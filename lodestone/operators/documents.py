"""Documents: sentences, overlap with existing text, hold-out, names and combined output."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.seeded import order_key
from lodestone.functions.text import fingerprint, normalise_characters, once, sentences
from lodestone.operators.ranking import with_ordered_rank, with_prefix

REFUSE_SHARE = 0.5


class PreparationRefused(ValueError):
    """An input that mustn't be prepared; nothing has been written."""


def sentence_hashes(df: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """The ``keep`` columns with ``hash``: a row for every distinct sentence of a text, of at least 60 characters. Hashes alone
    leave the scan; null and short texts have none."""
    each = F.array_distinct(F.transform(sentences(normalise_characters(F.col(text))), fingerprint))
    return df.select(*keep, F.explode(each).alias("hash"))


def sentence_table(df: DataFrame, id_column: str, text: str = "text") -> DataFrame:
    """``id_column, hash, n_chars, uses``: each document's distinct sentences of at least 60 characters and how often
    it has them. All of them stand in the document's own row, so they are counted there, without a shuffle."""
    each = F.array_sort(F.transform(sentences(normalise_characters(F.col(text))), lambda s: F.struct(fingerprint(s).alias("hash"), F.length(s).alias("n_chars"))))

    def runs(e: Column) -> Column:  # sorted, so equal ones are neighbours: a run's length is the distance from its start to the next one's
        starts = F.filter(F.transform(e, lambda x, i: F.when((i == 0) | (F.get(e, i - 1)["hash"] != x["hash"]), i)), lambda i: i.isNotNull())
        return once(starts, lambda at: F.transform(at, lambda i, k: F.struct(F.get(e, i).alias("s"), (F.coalesce(F.get(at, k + 1), F.size(e)) - i).cast("long").alias("uses"))))

    return df.select(F.col(id_column), F.explode(once(each, runs)).alias("r")).select(id_column, "r.s.hash", "r.s.n_chars", "r.uses")


def verdict(share):
    return F.when(share >= REFUSE_SHARE, "refuse").when(share > 0, "warn").otherwise("ok")


def _judged(marked: DataFrame, id_column: str) -> DataFrame:
    """Shares and verdicts of documents from rows ``id_column, chars, held``."""
    out = marked.groupBy(id_column).agg(F.sum("chars").alias("total_chars"), F.sum(F.when(F.col("held"), F.col("chars")).otherwise(0)).alias("shared_chars"))
    return out.withColumn("share", F.col("shared_chars") / F.col("total_chars").cast("double")).withColumn("verdict", verdict(F.col("share")))


def overlap_share(inputs: DataFrame, existing: DataFrame, id_column: str, holder: str, text: str = "text", holder_text: str = "text") -> DataFrame:
    """``id_column, total_chars, shared_chars, share, verdict`` of each input with a sentence: how much of its sentence
    text, repeats counted, the existing texts hold. The existing side is one row a sentence, so a hot sentence
    never multiplies rows; where it is small, AQE broadcasts it and the inputs' sentences aren't shuffled at all."""
    s = sentence_table(inputs, id_column, text)
    held = sentence_hashes(existing, text=holder_text).distinct().withColumn("held", F.lit(True))
    return _judged(s.join(held, "hash", "left").select(id_column, (F.col("n_chars") * F.col("uses")).alias("chars"), "held"), id_column)


def ordered_overlap(inputs: DataFrame, id_column: str, text: str = "text", existing: DataFrame | None = None, holder_text: str = "text") -> DataFrame:
    """As ``overlap_share``, against the earlier inputs in the order of their ids and, where given, the ``existing`` texts as
    well: a sentence is shared if they hold it or its first holder comes earlier. It counts once, whoever holds
    it, so the share is of the union. One aggregate a sentence, no pairs of holders."""
    s = sentence_table(inputs, id_column, text)
    every = s.select("hash", F.col(id_column).alias("by"), F.lit(False).alias("old"))
    if existing is not None:
        every = every.unionByName(sentence_hashes(existing, text=holder_text).select("hash", F.lit(None).cast(s.schema[id_column].dataType).alias("by"), F.lit(True).alias("old")))
    first = every.groupBy("hash").agg(F.min("by").alias("first"), F.max("old").alias("old"))
    held = F.col("old") | (F.col("first") < F.col(id_column))
    return _judged(s.join(first, "hash").select(id_column, (F.col("n_chars") * F.col("uses")).alias("chars"), held.alias("held")), id_column)


def attribution(inputs: DataFrame, existing: DataFrame, id_column: str, holder: str, top: int = 3, text: str = "text", holder_text: str = "text") -> DataFrame:
    """``id_column, holder, chars, place, n_holders``: the ``top`` holders of each input's shared sentences, and how many it
    has in all. Every holder of a sentence is credited with it in full.

    Inputs with the same shared sentences form a class, and so do holders with the same ones: a boilerplate
    sentence that most of both have makes one pair of classes, not a pair for each two of them."""
    s = sentence_table(inputs, id_column, text).select(id_column, "hash", (F.col("n_chars") * F.col("uses")).alias("chars"))
    h = sentence_hashes(existing, holder, text=holder_text).select("hash", F.col(holder).alias("_h")).distinct()
    shared = s.join(h.select("hash").distinct(), "hash").groupBy(id_column).agg(F.array_sort(F.collect_list(F.struct("hash", "chars"))).alias("e"))
    asked = shared.select(id_column, F.sha2(F.to_json("e"), 256).alias("_ask"), "e")
    asks = asked.groupBy("_ask").agg(F.first("e").alias("e")).select("_ask", F.explode("e").alias("x")).select("_ask", "x.*")
    wanted = h.join(asks.select("hash").distinct(), "hash").groupBy("_h").agg(F.array_sort(F.collect_list("hash")).alias("e"))
    classes = wanted.select("_h", F.sha2(F.to_json("e"), 256).alias("_held"), "e")
    place = F.row_number().over(Window.partitionBy("_held").orderBy("_h"))  # a group limit: ``top`` is small
    first = classes.select("_held", "_h").withColumn("_i", place).filter(F.col("_i") <= top)
    helds = classes.groupBy("_held").agg(F.first("e").alias("e"), F.count(F.lit(1)).alias("_n"))
    met = asks.join(helds.select("_held", "_n", F.explode("e").alias("hash")), "hash").groupBy("_ask", "_held").agg(F.sum("chars").alias("chars"), F.first("_n").alias("_n"))
    in_all = met.groupBy("_ask").agg(F.sum("_n").alias("n_holders"))
    best = met.join(first, "_held").withColumn("place", F.row_number().over(Window.partitionBy("_ask").orderBy(F.desc("chars"), "_h"))).filter(F.col("place") <= top)
    out = asked.select(id_column, "_ask").join(best.join(in_all, "_ask"), "_ask")
    return out.select(id_column, F.col("_h").alias(holder), "chars", "place", "n_holders")


def first_copies(df: DataFrame, id_column: str, text: str = "text") -> DataFrame:
    """``id_column, n_copies``: the lowest id of each distinct text, and how many rows have it."""
    return df.filter(F.col(text).isNotNull()).groupBy(fingerprint(F.col(text)).alias("hash")).agg(F.min(id_column).alias(id_column), F.count(F.lit(1)).alias("n_copies")).drop("hash")


def min_documents_for_held_out(fraction: float) -> int:
    """The fewest documents of which a fraction can be held out with something left on either side."""
    if not 0 <= fraction < 1:
        raise ValueError("the held-out fraction must be at least 0 and below 1")
    if fraction == 0:
        return 2
    n = 2
    while not 1 <= math.floor(n * (1 - fraction)) < n:
        n += 1
    return n


def split_held_out(df: DataFrame, id_column: str, fraction: float, seed: int) -> DataFrame:
    """``df`` with ``held_out``: whole documents in seeded order, the first floor(n (1 - fraction)) for training.

    Nothing is held out at a fraction of 0, and of a single document; a split that leaves no training document is
    refused."""
    if fraction <= 0:
        return df.withColumn("held_out", F.lit(False))
    n = df.count()
    cut = n if n <= 1 else math.floor(n * (1 - fraction))
    if n > 1 and cut == 0:
        raise PreparationRefused(f"holding out {fraction} of {n} documents leaves none to train on")
    ranked = with_prefix(df, order_key(seed, "split", F.col(id_column)), tie=id_column)
    return ranked.withColumn("held_out", F.col("rnk") > cut).drop("rnk")


def seeded_first(df: DataFrame, id_column: str, n: int, seed: int, purpose: str) -> DataFrame:
    """The first n rows in seeded order with their ``rnk``: a top-n, which keeps n rows a task before the last one."""
    key = order_key(seed, purpose, F.col(id_column))
    return df.withColumn("_key", key).orderBy("_key", id_column).limit(n).select(*df.columns, F.row_number().over(Window.orderBy("_key", id_column)).alias("rnk"))


def unique_names(df: DataFrame, stem: str, order: str, taken: DataFrame | None = None) -> DataFrame:
    """``df`` with ``name``: the stem for the first of its rows, then ``stem_1``, ``stem_2`` …; names in ``taken`` (one column
    ``name``) and names that are another row's stem are passed over, so no two rows have the same name and none has a
    taken one.

    Of a stem's numbers, the blocked ones and the rows stand in one order: a row's place in it is its number, however
    the blocked ones lie. A stem that most rows share is numbered in many tasks."""
    parts = r"^(.*)_(0|[1-9][0-9]{0,17})$"  # a name that another stem's number could give
    stems = df.select(F.col(stem).alias("_stem")).filter("_stem is not null").distinct()
    names = stems.select(F.col("_stem").alias("name"), F.lit(False).alias("_whole"))
    if taken is not None:
        names = names.unionByName(taken.select("name", F.lit(True).alias("_whole")))
    blocked = names.select(F.regexp_extract("name", parts, 1).alias("_stem"), F.regexp_extract("name", parts, 2).try_cast("long").alias("_no")).filter("_no > 0").unionByName(names.filter("_whole").select(F.col("name").alias("_stem"), F.lit(0).cast("long").alias("_no")))
    blocked = blocked.distinct().join(stems, "_stem", "left_semi")
    before = with_ordered_rank(blocked, "_no", by=("_stem",))  # the p-th blocked number stands before the rows from number - p on
    events = before.select("_stem", (2 * (F.col("_no") - F.col("rnk") + 1)).alias("_at"), F.lit(None).cast(df.schema[order].dataType).alias("_o"), F.lit(False).alias("_row"))
    rows = with_ordered_rank(df.select(F.col(stem).alias("_stem"), F.col(order).alias("_o")), "_o", by=("_stem",))
    events = events.unionByName(rows.select("_stem", (2 * F.col("rnk") - 1).alias("_at"), "_o", F.lit(True).alias("_row")))
    placed = with_ordered_rank(events, "_at", by=("_stem",)).filter("_row").select("_stem", "_o", (F.col("rnk") - 1).alias("_no"))
    joined = df.alias("d").join(placed.alias("p"), F.col(f"d.{stem}").eqNullSafe(F.col("p._stem")) & F.col(f"d.{order}").eqNullSafe(F.col("p._o")))
    name = F.when(F.col("p._no") == 0, F.col(f"d.{stem}")).otherwise(F.concat(F.col(f"d.{stem}"), F.lit("_"), F.col("p._no")))
    return joined.select(*[F.col(f"d.{c}").alias(c) for c in df.columns], name.alias("name"))


RULE = "\n\n" + "=" * 80 + "\n\n"


def combined(df: DataFrame, group: str, name: str, text: str, order: str) -> DataFrame:
    """``group, order, block``: the blocks whose concatenation, in order, is the group's combined text: each text under a
    ``# Source:`` line, with rules between. A block a row, so a group may be of any size; a sink writes them in order."""
    first = df.groupBy(group).agg(F.min(order).alias("_first"))
    joined = df.alias("d").join(first.alias("f"), F.col(f"d.{group}").eqNullSafe(F.col(f"f.{group}")))
    head = F.when(F.col(f"d.{order}") == F.col("f._first"), F.lit("")).otherwise(F.lit(RULE))
    return joined.select(F.col(f"d.{group}").alias(group), F.col(f"d.{order}").alias(order), F.concat(head, F.lit("# Source: "), F.col(f"d.{name}"), F.lit("\n\n"), F.col(f"d.{text}")).alias("block"))


def corpus_fingerprint(df: DataFrame, text: str, order: str, group: str) -> DataFrame:
    """``group, fingerprint``: a hash of a group's texts and their order, from sums of the hashes of (order, text): a partial
    aggregate, so a group may be of any size. 96 bits of every row's hash enter."""
    row = F.sha2(F.concat_ws(":", F.col(order).cast("string"), fingerprint(F.coalesce(text, F.lit("")))), 256)
    part = lambda start: F.sum(F.conv(F.substring(row, start, 12), 16, 10).cast("decimal(28,0)"))
    sums = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), part(1).alias("a"), part(13).alias("b"))
    return sums.select(group, fingerprint(F.concat_ws(":", F.col("n").cast("string"), F.col("a").cast("string"), F.col("b").cast("string"))).alias("fingerprint"))
