"""Mixing sources to target weights by a low-discrepancy schedule.

Slot ``i`` of the mix draws its source from the golden-ratio point ``frac(i * phi)`` through the
cumulative shares, so every stretch of the mix holds each source in proportion. A source's
documents are shuffled and laid end to end; the stream is cut into blocks of equal numbers of words,
and the ``k``-th slot of a source is joined to its ``k``-th block, going round again when the blocks
are used up. The slots decide what is taken; only what would go beyond the most repeats is left out.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lendscape.llm import common
from lendscape.session import Workspace

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
# A source misses its target by a few blocks at most.
BLOCK_WORDS = 32
GOLDEN = 0.6180339887498949
ROWS_PER_CELL = 2048


def source_key() -> Column:
    """Sorts by code point, null last."""
    return F.coalesce(F.concat(F.lit("="), "source"), F.lit("~"))


def shuffle_draw() -> Column:
    return common.draw(F.lit("mix"), F.col("doc_id"), F.md5(F.coalesce("text", F.lit(""))))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source key, size and the draw that shuffles."""
    return docs.select("doc_id", source_key().alias("key"), common.n_words("text").alias("size"), shuffle_draw().alias("draw"))


def targets(rows: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_REPEATS, block: int = BLOCK_WORDS) -> DataFrame:
    """One row per source: rows, words, target, blocks, and the shares of the schedule up to it.

    Sources are put in the order in which raising all targets in proportion to the weights would
    make them reach their caps. Capping one that is due raises the level of the rest, capping one that
    is not would lower it: the highest level is the right one. Holds one row per source in a task.
    """
    named = rows.groupBy("key").agg(F.count("*").alias("n_rows"), F.sum("size").alias("source_size"))
    every = Window.partitionBy()
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(every.orderBy("key")) - 1) % len(weights) + 1))
    weighed = named.withColumn("weight", turn).withColumn("cap", most * F.col("source_size").cast("double"))
    order = every.orderBy(F.col("cap") / F.col("weight"), "key").rowsBetween(Window.unboundedPreceding, -1)
    total, weight = F.sum("source_size").over(every).cast("double"), F.sum("weight").over(every)
    left = total - F.coalesce(F.sum("cap").over(order), F.lit(0.0))
    level = weighed.withColumn("level", left / (weight - F.coalesce(F.sum("weight").over(order), F.lit(0.0))))
    level = level.withColumn("level", F.max("level").over(every))
    aimed = level.withColumn("target", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.lit(0.0))))
    blocks = F.ceil(F.col("source_size") / block).cast("long")
    # The last block may be short, so a share is one of slots, not of words.
    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size") * blocks).otherwise(0.0)
    upto = every.orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return aimed.withColumns({"blocks": blocks, "due": due}).select(
        "key", "n_rows", "source_size", "target", "blocks", F.sum("due").over(every).alias("slots"),
        F.try_divide(F.sum("due").over(upto), F.sum("due").over(every)).alias("upto"),
    )


def schedule(spark: SparkSession, sources: DataFrame) -> DataFrame:
    """Slots of the mix: ``slot``, ``key`` and the rank ``k`` among the source's slots.

    ``sources`` has a row per source with ``upto``, the share up to and with it, and ``slots``, their number. A point is
    met with the sources whose share touches its cell of a grid, so no slot looks at all sources.
    """
    facts = sources.agg(F.max("slots").alias("slots"), F.count("*").alias("n")).first()
    n, grid = math.ceil(facts.slots or 0), 4 << math.ceil(math.log2(max(1, facts.n)))
    along = Window.orderBy("key")
    shares = sources.withColumn("after", F.coalesce(F.lag("upto").over(along), F.lit(0.0))).filter("after < upto")
    last = F.lead("key").over(along).isNull()
    shares = shares.withColumn("upto", F.when(last, 2.0).otherwise(F.col("upto")))
    cells = F.sequence(F.floor(F.col("after") * grid), F.least(F.floor(F.col("upto") * grid), F.lit(grid - 1)))
    touched = shares.select("key", "after", "upto", F.explode(cells).alias("at"))
    point = F.col("slot") * F.lit(GOLDEN) - F.floor(F.col("slot") * F.lit(GOLDEN))
    points = spark.range(n).select(F.col("id").alias("slot")).withColumn("point", point).withColumn("at", F.floor(F.col("point") * grid))
    dealt = points.join(touched, "at").filter("after <= point and point < upto")
    dealt = dealt.select("slot", "key", F.floor(F.col("slot") / ROWS_PER_CELL).alias("_cell"))
    return common.running_total(dealt, ["key"], "_cell", ["slot"], F.lit(1).cast("long"), "k").drop("_cell")


def mix(
    spark: SparkSession, docs: DataFrame, ws: Workspace,
    weights: Sequence[int] = WEIGHTS, most: int = MOST_REPEATS, block: int = BLOCK_WORDS,
) -> DataFrame:
    """Per document: size, its source's size and target, and the words the mix takes, repeats counted.

    Size counts words, 0 for a null text; a null source is a source of its own, the last. Documents
    without words are never taken. Repeated rows take their own places. Reruns agree: the shuffle
    is drawn from doc_id and text. Other columns are ignored.
    """
    rows = ws.store(sized(docs), "sized")
    sources = ws.store(targets(rows, weights, most, block), "sources")
    slots = ws.store(schedule(spark, sources), "slots")
    had = slots.groupBy("key").agg(F.count("*").alias("had"))
    used = F.least(F.coalesce("had", F.lit(0)), most * F.col("blocks"))
    plan = ws.store(sources.join(had, "key", "left").withColumn("used", used).drop("had", "upto", "slots"), "plan")
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n_rows") / ROWS_PER_CELL))).cast("int")
    held = rows.join(plan, "key").withColumn("_cell", F.floor(F.col("draw") / F.pow(F.lit(2.0), 52 - bits)).cast("long"))
    placed = common.running_total(held, ["key"], "_cell", ["draw", "doc_id", "size"], F.col("size"), "start").drop("_cell")
    # All blocks are taken as often as the slots go round, the first ones once more.
    rounds, begun = F.floor(F.col("used") / F.col("blocks")), F.col("used") % F.col("blocks") * block
    part = F.greatest(F.lit(0), F.least(F.col("start") + F.col("size"), begun) - F.col("start"))
    words = F.when(F.col("size") > 0, rounds * F.col("size") + part).otherwise(0).cast("long")
    counted = placed.withColumns({"taken": words, "block": F.floor(F.col("start") / block)})
    first = slots.select("key", F.col("k").alias("block"), F.col("slot").alias("first_slot"))
    out = counted.join(first, ["key", "block"], "left")
    return out.select(
        "doc_id", "size", "source_size", "target", "taken", F.when(F.col("taken") > 0, F.col("first_slot")).alias("first_slot"),
        "key", "draw", "block", "blocks",
    )


def mixture(spark: SparkSession, docs: DataFrame, ws: Workspace, slot: str | None = None, **how) -> DataFrame:
    """The documents of the mix: each as often as it is taken, none where it is not. Columns stay as they are.

    ``slot`` names a column to add, of a name that the table does not have: where the mix has this copy. In its order, every stretch of the mix holds the sources in
    proportion. A source's cut falls inside one document at most; that one counts as whole from half of its words on.
    Repeated rows share what they are taken evenly. An empty table has an empty mix.
    """
    times = F.round(F.sum(F.col("taken") / F.col("size")) / F.count("*")).cast("int")
    taken_names = docs if slot is None else docs.withColumn(slot, F.lit(0))
    identity = [common.fresh(taken_names, f"_mix_{c}") for c in ("id", "key", "draw")]
    nth, at = common.fresh(taken_names, "_mix_nth"), common.fresh(taken_names, "_mix_k")
    taken = mix(spark, docs, ws, **how).filter("taken > 0")
    named = taken.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias(identity[0]), F.col("key").alias(identity[1]),
        F.col("draw").alias(identity[2]), "taken", "size", F.col("block").alias(at), "blocks",
    )
    copies = named.groupBy(*identity).agg(times.alias("times"), F.min(at).alias(at), F.max("blocks").alias("blocks")).filter("times > 0")
    copies = copies.withColumn(nth, F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
    copies = copies.select(*identity, (F.col(nth) * F.col("blocks") + F.col(at)).alias(at))
    if slot is not None:
        slots = spark.read.parquet(ws.folder("slots")).select(F.col("key").alias(identity[1]), F.col("k").alias(at), F.col("slot").alias(slot))
        copies = copies.join(slots, [identity[1], at], "left")
    same = dict(zip(identity, (F.coalesce(F.col("doc_id").cast("string"), F.lit("")), source_key(), shuffle_draw()), strict=True))
    return docs.withColumns(same).join(copies, identity).select(*docs.columns, *([slot] if slot else []))
