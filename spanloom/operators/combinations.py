"""Generators of entity combinations.

A draw is a row (draw_id, anchor). Neighbour lists are at most k long, so they
travel as one array per anchor: picking members is row-local and a hot anchor
costs no group.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.functions.randomness import gumbel_key, size_from_uniform, unit_random
from spanloom.operators.ordering import bucket_count, shuffled_positions, totals_before
from spanloom.session import cut_lineage

WEIGHT_STEPS = 2**50


def with_softmax(df: DataFrame, score: Column, output: str, partition=(), temperature: float = 1.0) -> DataFrame:
    """Add exp(score/T) over its sum in the group, shifted by the group's maximum.

    Maximum and sum are aggregated on the map side and joined back, so no group
    and no whole table meets in one task. Null keys are a group.
    """
    scaled = df.withColumn("__scaled", score / F.lit(float(temperature)))
    top = _joined_back(scaled, partition, F.max("__scaled"), "__top")
    weighted = top.withColumn("__weight", F.exp(F.col("__scaled") - F.col("__top")))
    total = _joined_back(weighted, partition, F.sum("__weight"), "__total")
    return total.withColumn(output, F.col("__weight") / F.col("__total")).drop("__scaled", "__top", "__weight", "__total")


def _joined_back(df: DataFrame, partition, aggregate: Column, name: str) -> DataFrame:
    if not partition:
        return df.withColumn(name, df.agg(aggregate.alias(name)).scalar())
    keys = [f"__key{i}" for i in range(len(partition))]
    found = df.groupBy(*[F.col(c).alias(k) for c, k in zip(partition, keys, strict=True)]).agg(aggregate.alias(name))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(partition, keys, strict=True)])
    return df.join(found, same).drop(*keys)


def known_score(score: Column, name: Column, missing: float | None = None) -> Column:
    """Popularity score, or ``missing`` for names without one; without a default they fail the job."""
    if missing is not None:
        return F.coalesce(score, F.lit(float(missing)))
    return F.coalesce(
        score, F.raise_error(F.concat(F.lit("no popularity score for "), name)).cast("double")
    )


def neighbour_lists(neighbours: DataFrame, popularity: DataFrame | None = None, missing: float | None = None,
                    keys=("anchor",)) -> DataFrame:
    """One row per anchor with its (rank, name, sim, score) neighbours, nearest first."""
    if popularity is None:
        scored = neighbours.withColumn("score", F.lit(0.0))
    else:
        names = popularity.select(F.col("name").alias("neighbour"), "score")
        scored = neighbours.join(names, "neighbour", "left").withColumn(
            "score", known_score(F.col("score"), F.col("neighbour"), missing)
        )
    entry = F.struct("rank", F.col("neighbour").alias("name"), "sim", "score")
    return scored.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("near"))


def picked_order(near: Column, seed, draw: Column, temperature: float, by_popularity: bool) -> Column:
    """Neighbour names in the order in which a draw without replacement takes them."""

    def sort_entry(n):
        log_weight = -n["score"] / F.lit(float(temperature)) if by_popularity else F.lit(0.0)
        return F.struct((-gumbel_key(log_weight, seed, F.lit("pick"), draw, n["name"])).alias("o"), n["name"].alias("name"))

    return F.transform(F.array_sort(F.transform(near, sort_entry)), lambda e: e["name"])


def wanted_size(seed, draw: Column, size_weights, temperature: float, upper_bound: int | None) -> Column:
    """Number of members besides the anchor."""
    wanted = size_from_uniform(unit_random(seed, F.lit("size"), draw), size_weights, temperature) - 1
    return wanted if upper_bound is None else F.least(wanted, F.lit(upper_bound))


def combine(
    draws: DataFrame,
    lists: DataFrame,
    size_weights,
    seed=42,
    temperature_pairing: float = 1.0,
    temperature_size: float = 1.0,
    frequency_select: bool = True,
    upper_bound: int | None = None,
) -> DataFrame:
    """(draw_id, anchor, members, size): the anchor and the neighbours drawn for it."""
    draw = F.col("draw_id")
    # the size is drawn before the join and is bounded by the longest combination
    sized = draws.withColumn("__wanted", wanted_size(seed, draw, size_weights, temperature_size, upper_bound))
    near = F.coalesce(F.col("near"), F.array().cast("array<struct<rank:int,name:string,sim:double,score:double>>"))
    chosen = F.slice(picked_order(near, seed, draw, temperature_pairing, frequency_select), F.lit(1), F.col("__wanted"))
    members = F.when(F.col("__wanted") > 0, F.concat(F.array("anchor"), chosen)).otherwise(F.array("anchor"))
    return (
        sized.join(lists, "anchor", "left")
        .select("draw_id", "anchor", members.alias("members"))
        .withColumn("size", F.size("members"))
    )


def draw_weights(popularity: DataFrame, temperature: float = 1.0) -> DataFrame:
    """(name, w): whole-number weights exp(-score/T), relative to the best score; no name falls to zero."""
    best = popularity.agg(F.min("score").alias("m")).scalar()
    share = F.floor(F.exp((best - F.col("score")) / F.lit(float(temperature))) * F.lit(float(WEIGHT_STEPS)))
    return popularity.select("name", F.greatest(share, F.lit(1).cast("bigint")).cast("decimal(38,0)").alias("w"))


def stochastic_draws(
    popularity: DataFrame, n: int, seed=42, temperature: float = 1.0, buckets: int | None = None, cells: int | None = None
) -> DataFrame:
    """``n`` draws (draw_id, anchor) with replacement, p = softmax(-score/T).

    Each name owns an interval of [0, 1), of one step at least, however far its
    score is from the best. Draws and intervals meet on the cell
    of the interval: a name with a third of the weight spans a third of the
    cells, so its draws stay spread out. There are about as many cells as names.
    """
    cells, buckets = cells or max(4096, popularity.count()), buckets or bucket_count(popularity)
    whole = "decimal(38,0)"
    order = unit_random("cdf", F.col("name"))
    weighted = draw_weights(popularity, temperature).select(
        "name", "w", order.alias("__u"), F.floor(order * buckets).cast("int").alias("__bucket")
    )
    # whole numbers: the sums are the same in any order, so the intervals fit without gaps
    edges = totals_before(weighted, "__bucket", ["__u", "name"], {"lo": F.col("w")}).select(
        "name", F.col("lo").cast(whole).alias("lo"), (F.col("lo") + F.col("w")).cast(whole).alias("hi")
    )
    total = weighted.agg(F.sum("w").cast(whole).alias("t")).scalar()
    cell = lambda c: F.call_function("div", c * F.lit(cells).cast("decimal(18,0)"), F.col("total")).cast("int")
    intervals = edges.withColumn("total", total).select(
        F.col("name").alias("anchor"), "lo", "hi",
        F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi") - 1))).alias("cell"),
    )
    u = unit_random(seed, F.lit("anchor"), F.col("id"))
    aimed = popularity.sparkSession.range(n).withColumn("total", total).select(
        F.col("id").alias("draw_id"), "total",
        F.least(F.floor(u * F.col("total").cast("double")).cast(whole), F.col("total") - 1).alias("at"),
    )
    return (
        aimed.withColumn("cell", cell(F.col("at")))
        .join(intervals, "cell")
        .where("at >= lo and at < hi")
        .select("draw_id", "anchor")
    )


def balanced_draws(names: DataFrame, how_many="all", seed=42) -> DataFrame:
    """Each anchor at most once: all names, or a random subset of the given size."""
    placed = shuffled_positions(names.select("name").distinct(), seed, ["name"], name="draw_id")
    if how_many != "all":
        if not isinstance(how_many, int) or how_many < 0:
            raise ValueError("how_many must be 'all' or a number of names")
        placed = placed.where(F.col("draw_id") < how_many)
    return placed.select("draw_id", F.col("name").alias("anchor"))


def balanced_numbered_draws(names: DataFrame, n: int, seed=42) -> DataFrame:
    """Exactly ``n`` draws; every full round holds each name once, in its own order."""
    unique = names.select("name").distinct()
    count = unique.count()
    if count == 0 or n <= 0:
        return unique.select(F.lit(0).cast("bigint").alias("draw_id"), F.col("name").alias("anchor")).limit(0)
    rounds = -(-n // count)
    repeated = unique.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    placed = shuffled_positions(repeated, seed, ["name"], within=["round"])
    draw = F.col("round").cast("bigint") * count + F.col("position")
    return placed.select(draw.alias("draw_id"), F.col("name").alias("anchor")).where(F.col("draw_id") < n)


def category_draws(anchors: DataFrame, affinity: DataFrame, seed=42) -> DataFrame:
    """Category of every slot of a draw, by inverse CDF of the anchor category's row.

    ``anchors`` has (draw_id, anchor, category, wanted); ``affinity`` has
    (category, other, p). The row of a category is one sorted array.
    """
    steps = affinity.groupBy("category").agg(
        F.array_sort(F.collect_list(F.struct("other", "p"))).alias("row")
    )
    # running sums over the sorted row; the last edge stays open
    edges = F.aggregate(
        "row",
        F.array().cast("array<double>"),
        lambda acc, e: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0)) + e["p"])),
    )
    steps = steps.select("category", F.transform("row", lambda e: e["other"]).alias("others"), edges.alias("edges"))
    slots = anchors.where("wanted > 0").withColumn("slot", F.explode(F.sequence(F.lit(1), F.col("wanted"))))
    u = unit_random(seed, F.lit("slot"), F.col("draw_id"), F.col("slot"))
    place = F.least(F.size(F.filter("edges", lambda e: e <= F.col("u"))) + 1, F.size("others"))
    return (
        slots.withColumn("u", u)
        .join(steps, "category")
        .select("draw_id", "anchor", "slot", F.element_at("others", place).alias("slot_category"))
    )


def diverse_combinations(
    draws: DataFrame,
    taxonomy: DataFrame,
    neighbours: DataFrame | Callable[[DataFrame], DataFrame],
    affinity: DataFrame,
    size_weights,
    popularity: DataFrame | None = None,
    seed=42,
    temperature_pairing: float = 1.0,
    temperature_size: float = 1.0,
    upper_bound: int | None = None,
    missing: float | None = None,
) -> DataFrame:
    """(draw_id, anchor, members, size) with a category drawn for each slot.

    ``neighbours`` come from :func:`nearest_per_category`, or are a function that
    searches only the drawn (anchor, category) pairs it is given, as
    :func:`nearest_of_pairs` does. Without popularity a
    category's slots take its nearest neighbours in turn, with it they take them
    in weighted random order. The r-th slot of a category gets the r-th entry;
    a slot whose category has no entry left stays empty.
    """
    draw = F.col("draw_id")
    anchors = draws.join(taxonomy.select(F.col("name").alias("anchor"), "category"), "anchor").withColumn(
        "wanted", wanted_size(seed, draw, size_weights, temperature_size, upper_bound)
    )
    slots = category_draws(anchors, affinity, seed)
    # a draw has a handful of slots
    turn = F.row_number().over(Window.partitionBy("draw_id", "slot_category").orderBy("slot"))
    slots = slots.withColumn("turn", turn)
    if callable(neighbours):
        slots = cut_lineage(slots, "slots")
        neighbours = neighbours(slots.select("anchor", F.col("slot_category").alias("category")).distinct())
    lists = neighbour_lists(neighbours, popularity, missing, keys=("anchor", "category"))
    lists = lists.withColumnRenamed("category", "slot_category")
    ordered = (
        F.transform("near", lambda n: n["name"])
        if popularity is None
        else picked_order(F.col("near"), seed, draw, temperature_pairing, True)
    )
    filled = (
        slots.join(lists, ["anchor", "slot_category"])
        .select("draw_id", "slot", F.try_element_at(ordered, F.col("turn")).alias("member"))
        .where("member is not null")
        .groupBy("draw_id")
        .agg(F.array_sort(F.collect_list(F.struct("slot", "member"))).alias("picked"))
        .select("draw_id", F.transform("picked", lambda p: p["member"]).alias("picked"))
    )
    none = F.array().cast("array<string>")
    return (
        draws.join(filled, "draw_id", "left")
        .select("draw_id", "anchor", F.concat(F.array("anchor"), F.coalesce("picked", none)).alias("members"))
        .withColumn("size", F.size("members"))
    )


def size_histogram(combos: DataFrame, by=()) -> DataFrame:
    """Number of combinations of each size, by split if asked."""
    return combos.groupBy(*by, "size").agg(F.count("*").alias("combinations"))
