"""Mixing sources to target weights by weighted fair queueing.

Every document of a source gets a virtual finish time: the source's words up to
and with it, in shuffled order, over the source's target. A source that may be
repeated goes on counting in its next pass. All entries are then sorted by
virtual time over all sources and taken until the budget is reached, so every
source reaches its target at about the same virtual time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.functions.randomness import unit_random
from spanloom.operators.ordering import sorted_totals, totals_before
from spanloom.session import cut_lineage

ROWS_PER_BUCKET = 20_000
#: Fixed by the task: weights of the sources in code-point order, repeating.
CYCLE = (3.0, 1.0, 2.0)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def cycled_weights(sources: DataFrame, source: str, cycle=CYCLE) -> DataFrame:
    """Weights by place of the source in code-point order, null last; the table has one row per source."""
    place = F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last())) - 1
    return sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (place % len(cycle) + 1).cast("int")))


def targets(sources: DataFrame, ratio: float, repeats: int) -> DataFrame:
    """Add ``target`` to (source, source_size, weight): shares of ratio × all words, none above repeats × its size.

    With the caps in order of cap / weight, the first i sources are held at
    their cap and the others share what is left by weight; i is the smallest
    number for which the next cap is high enough. One row per source, so the
    window over all of them is small.
    """
    cap = F.col("source_size") * float(repeats)
    order = Window.orderBy(F.col("__cap") / F.col("weight"), F.col("source").asc_nulls_first())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    filled = sources.withColumn("__cap", cap).withColumn("__budget", F.sum("source_size").over(everything) * ratio).withColumn(
        "__level", (F.col("__budget") - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    )
    free = F.col("__cap") >= F.col("__level") * F.col("weight")
    level = F.min(F.when(free, F.struct(F.col("__cap") / F.col("weight"), F.col("__level")))).over(everything)
    target = F.when(level.isNull(), F.col("__cap")).otherwise(F.least(F.col("__cap"), level["__level"] * F.col("weight")))
    return filled.withColumn("target", target).drop("__cap", "__level")


def mix(df: DataFrame, key: str, text: str, source: str, weights=cycled_weights, ratio: float = 1.5, repeats: int = 2,
        seed: int = 17) -> DataFrame:
    """One row per input row: ``key``, ``size``, ``source_size``, ``target`` and ``taken`` words, repeats counted.

    ``weights`` adds a positive ``weight`` to the table of sources. Documents
    are taken whole; the first that would pass the budget ends the mix, so every
    source is within one document of its target and none is taken more than
    ``repeats`` times. The order is a hash of seed and key: reruns agree. A null
    source is a source of its own, null and empty texts have size 0 and give no
    words, repeated rows count each, and an empty table gives an empty result.
    Other columns are ignored.
    """
    rows = cut_lineage(df.select(
        F.col(key).alias("__key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
        F.xxhash64(text).alias("__hash"), F.monotonically_increasing_id().alias("__line"),
    ), "mix-rows").withColumns({
        "__u": unit_random(seed, F.coalesce(F.col("__key").cast("string"), F.lit("null"))),
        "__none": F.col("source").isNull(), "__name": F.coalesce("source", F.lit("")),
    })
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = targets(weights(sizes, "source"), ratio, repeats).select(
        F.col("source").isNull().alias("__none"), F.coalesce("source", F.lit("")).alias("__name"),
        "source_size", "target", "__budget",
    )
    count = rows.count()
    buckets = max(64, count // ROWS_PER_BUCKET)
    queued = totals_before(
        rows.withColumn("__bucket", F.floor(F.col("__u") * buckets).cast("int")),
        "__bucket", ["__u", "__key", "size", "__hash", "__line"], {"__before": F.col("size")}, ["__none", "__name"],
    ).join(goals, ["__none", "__name"])
    turns = queued.withColumn("__turn", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    ahead = F.col("__before") + F.col("__turn") * F.col("source_size")
    # turns that begin beyond the target can't be reached; the first stays, so that every row is in the result
    entries = turns.where((F.col("__turn") == 0) | (ahead < F.col("target"))).withColumn(
        "__finish", F.when(F.col("target") > 0, (ahead + F.col("size")) / F.col("target")).otherwise(F.lit(0.0)))
    order = ["__finish", "__none", "__name", "__turn", "__u", "__key", "size", "__hash", "__line"]
    kept = ["__key", "size", "source_size", "target", "__line"]
    played = sorted_totals(entries.select(*dict.fromkeys([*order, *kept, "__budget"])), order, {"__start": F.col("size")})
    fits = F.col("__start") + F.col("size") <= F.col("__budget")
    return played.groupBy(*kept).agg(F.sum(F.when(fits, F.col("size")).otherwise(0)).alias("taken")).select(
        F.col("__key").alias(key), "size", "source_size", "target", "taken")
