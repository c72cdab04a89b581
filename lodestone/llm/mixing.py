"""Problem 4: records of several sources mixed to target weights, with a cap on repeats."""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.names import is_blank, source_name
from lodestone.functions.seeded import order_key
from lodestone.operators.deliveries import first_delivery
from lodestone.operators.ranking import with_prefix

#: A plan's budget is cut into so many blocks at least, and a block is never larger than BLOCK_CHARS, so that however much
#: text there is, no source fills a longer stretch of the mix; a hundred TB make some three million blocks, which one
#: task schedules.
BLOCKS, BLOCK_CHARS = 2048, 32_000_000


def usable_rows(corpus: DataFrame) -> DataFrame:
    """``row_id, source, n_chars`` of the distinct ``row_id`` with non-blank text; no text is shuffled."""
    kept = corpus.filter(~is_blank(F.col("text")))
    return first_delivery(kept, "row_id", "loaded_at", {"source": source_name(F.col("source")), "n_chars": F.length("text").cast("long")})


def plan_targets(plan: DataFrame, rows: DataFrame) -> DataFrame:
    """One row for each source of each plan, with what it has to supply and what it can.

    ``plan_id, source`` (as the plan spells it), ``name`` (normalised), ``weight``, ``max_repeats``, ``size``
    (characters, 0 for a source without rows), ``budget`` and ``target`` of the plan, ``capacity`` = size x
    max_repeats, ``short`` (capacity below target). Null weights, ratios and repeats count as 0, lines
    without a plan as a plan named by the empty string; a source that a plan names twice has the sum of the weights and
    the larger cap.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    one = plan.withColumn("plan_id", F.coalesce("plan_id", F.lit(""))).groupBy("plan_id", source_name(F.col("source")).alias("name")).agg(
        F.min("source").alias("source"), F.sum(zero("weight").cast("double")).alias("weight"), F.max(zero("max_repeats").cast("long")).alias("max_repeats"), F.max(zero("budget_ratio").cast("double")).alias("ratio")
    )
    sizes = rows.groupBy(F.col("source").alias("name")).agg(F.sum("n_chars").alias("size"))
    joined = one.join(sizes, "name", "left").withColumn("size", F.coalesce("size", F.lit(0)))
    whole = Window.partitionBy("plan_id")  # the sources of one plan, a handful
    budget = F.max("ratio").over(whole) * F.sum("size").over(whole)
    share = F.coalesce(F.try_divide(F.col("weight"), F.sum("weight").over(whole)), F.lit(0.0))
    out = joined.select("plan_id", "source", "name", "weight", "max_repeats", "size", budget.alias("budget"), share.alias("share"), (share * budget).alias("target"))
    capacity = (F.col("size") * F.col("max_repeats")).cast("double")
    return out.withColumns({"capacity": capacity, "short": capacity < F.col("target")})


def pfair_slots(shares: list[float], n_blocks: list[int]) -> list[tuple[int, int, int]]:
    """``(slot, source, block)``: blocks of all sources in one sequence, earliest deadline first.

    Block j (from 0) of a source with share u is released at slot floor(j / u) and due at ceil((j + 1) / u). In
    each slot the released block with the earliest deadline goes next, so that after any number of slots a
    source is less than one block from its share, as long as it has blocks left; a source that runs out
    leaves its slots empty, and they are closed up.
    """
    waiting = [(0, math.ceil(1 / u - 1e-9), i, 0) for i, (u, n) in enumerate(zip(shares, n_blocks)) if n and u > 0]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    out, slot = [], 0
    while waiting or ready:
        if not ready and waiting[0][0] > slot:
            slot = waiting[0][0]
        while waiting and waiting[0][0] <= slot:
            _, due, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (due, i, j))
        _, i, j = heapq.heappop(ready)
        out.append((len(out), i, j))
        slot += 1
        if j + 1 < n_blocks[i]:
            heapq.heappush(waiting, (math.floor((j + 1) / shares[i] + 1e-9), math.ceil((j + 2) / shares[i] - 1e-9), i, j + 1))
    return out


def schedule(targets: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """``plan_id, source, name, target, block, slot, block_chars, until``: the Pfair schedule of each plan, ``blocks`` long or
    as many as blocks of BLOCK_CHARS take, plus one for each source at most.

    ``until`` is how much its source has supplied after a block, ``target`` what it should supply in all; a source
    with nothing to give has one line with null block and slot. One task a plan, whose input is the plan's
    own lines.
    """

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("name")
        size = min(max(float(pdf.budget.iloc[0]) / blocks, 1.0), float(BLOCK_CHARS))
        give = [min(t, c) for t, c in zip(pdf.target, pdf.capacity)]
        n_blocks = [math.ceil(g / size - 1e-9) for g in give]
        slots = [(s, i, j, give[i] if j + 1 == n_blocks[i] else (j + 1) * size) for s, i, j in pfair_slots(pdf.share.tolist(), n_blocks)]
        slots += [(None, i, None, 0.0) for i, n in enumerate(n_blocks) if not n]
        out = pdf[["plan_id", "source", "name", "target"]].iloc[[i for _, i, *_ in slots]].reset_index(drop=True)
        out = out.assign(block_chars=size, until=[u for *_, u in slots])
        return out.assign(block=pd.array([j for *_, j, _ in slots], "Int64"), slot=pd.array([s for s, *_ in slots], "Int64"))

    slim = targets.select("plan_id", "source", "name", "share", "target", "capacity", "budget")
    return slim.groupBy("plan_id").applyInPandas(plan, "plan_id string, source string, name string, target double, block_chars double, until double, block long, slot long")


def streams(rows: DataFrame, seed: int) -> DataFrame:
    """Each source's rows in seeded order, with ``before``: the characters that come before a row. A two-level prefix
    sum, so no source is ordered in one task."""
    key = order_key(seed, "mix", F.col("row_id"), F.when(F.col("row_id").isNull(), F.col("n_chars")))
    run = with_prefix(rows, key, {"until": F.col("n_chars")}, by=("source",), tie="row_id")
    return run.select("row_id", "source", "n_chars", (F.col("until") - F.col("n_chars")).alias("before"))


def mix(corpus: DataFrame, plan: DataFrame, seed: int = 42, blocks: int = BLOCKS) -> DataFrame:
    """The rows of every plan: ``plan_id, source, row_id, copy, n_chars, slot, place``.

    Reading a plan's rows by (slot, place) gives the interleaved mix; ``copy`` counts from 1. A source passes
    over its rows, in seeded order, until its target is reached: a row is taken in a pass while more than
    half of it lies before the target, and no row more than ``max_repeats`` times; a short source gives all it
    may. Rows without usable text supply nothing; a plan without rows comes out empty.
    """
    return mixed_rows(*_parts(corpus, plan, seed), blocks)


def _parts(corpus: DataFrame, plan: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    rows = usable_rows(corpus)
    return streams(rows, seed), plan_targets(plan, rows)


def _copies(stream: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows of a plan's sources with how often each is used."""
    rows = stream.withColumnRenamed("source", "name").join(targets.drop("budget", "weight", "share"), "name")
    reach = (F.col("target") - F.col("before") - F.col("n_chars") / F.lit(2.0)) / F.col("size")  # passes until the row's middle is past the target
    return rows.withColumn("copies", F.least(F.col("max_repeats"), F.greatest(F.lit(0), F.floor(reach) + 1)).cast("long")).filter("copies > 0")


def mixed_rows(stream: DataFrame, targets: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    slots = schedule(targets, blocks).filter("slot is not null").select("plan_id", "name", "block", "slot", "block_chars")
    sizes = slots.groupBy("plan_id").agg(F.max("block_chars").alias("block_chars"))
    last = slots.groupBy("plan_id", "name").agg(F.max("block").alias("last_block"))
    used = _copies(stream, targets).select("plan_id", "source", "name", "row_id", "n_chars", "before", "size", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    placed = used.join(sizes, "plan_id").join(last, ["plan_id", "name"])
    at = (F.col("copy") - 1) * F.col("size") + F.col("before")
    placed = placed.withColumns({"place": at, "block": F.least(F.floor(at / F.col("block_chars")), F.col("last_block"))})
    return placed.join(slots.drop("block_chars"), ["plan_id", "name", "block"]).select("plan_id", "source", "row_id", "copy", "n_chars", "slot", "place")


def mix_shares(corpus: DataFrame, plan: DataFrame, seed: int = 42) -> DataFrame:
    """What each source really reached, of the rows that the schedule gives out (``mix``): ``plan_id, source, target_share, target_chars, actual_chars, actual_share,
    n_rows`` (rows with repeats), ``max_copies``, ``short``. The share is of the plan's actual total; null where that is 0."""
    stream, targets = _parts(corpus, plan, seed)
    used = mixed_rows(stream, targets).groupBy("plan_id", "source").agg(F.sum("n_chars").alias("actual_chars"), F.count(F.lit(1)).alias("n_rows"), F.max("copy").alias("max_copies"))
    used = used.select(F.col("plan_id").alias("p"), F.col("source").alias("s"), "actual_chars", "n_rows", "max_copies")
    out = targets.join(used, (F.col("plan_id") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")), "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("actual_chars", "n_rows", "max_copies")})
    total = F.sum("actual_chars").over(Window.partitionBy("plan_id"))
    return out.select("plan_id", "source", F.col("share").alias("target_share"), F.col("target").alias("target_chars"), "actual_chars", F.try_divide(F.col("actual_chars").cast("double"), total.cast("double")).alias("actual_share"), "n_rows", "max_copies", "short")


def short_sources(corpus: DataFrame, plan: DataFrame) -> DataFrame:
    """``plan_id, source`` of the sources whose blocks in the plan's schedule end before their target, although every
    row is used ``max_repeats`` times."""
    scheduled = schedule(plan_targets(plan, usable_rows(corpus))).groupBy("plan_id", "source")
    return scheduled.agg(F.max("until").alias("until"), F.max("target").alias("target")).filter("until < target").select("plan_id", "source")
