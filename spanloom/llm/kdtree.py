"""Sharding by a k-d tree over metadata, with weighted medians found by distributed histograms.

Points are groups of equal texts. Each step looks at all nodes of a level at
once: the widest dimension of a node is cut where half of its bytes (or the
share of its left shards) lie on either side. The cut is found by narrowing an
interval of positions: one aggregation per pass gives the bytes of 4,096 bins
per node, and the bin with the median becomes the node's next interval. The
nodes stay in tables, so neither the driver nor the plans grow with the shards.
Everything is DataFrame work; no text is moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.operators.ordering import totals_before
from spanloom.session import cut_lineage

BINS = 4096
#: A group of equal texts that is heavier than this part of a shard is cut into pieces by its rows' keys.
WHOLE_GROUP = 0.05
PIECES = 4096
ROWS_PER_BUCKET = 20_000


def number_axis(column: Column) -> Column:
    """A positive size as a coordinate of 31 bits, on a logarithmic scale; null counts as 1."""
    return F.floor(F.log2(F.greatest(F.coalesce(column, F.lit(1)).cast("double"), F.lit(1.0))) * (1 << 25)).cast("bigint")


def category_axis(column: Column) -> Column:
    """A category as a coordinate of 31 bits: values have no order, so a hash places them; null is 0."""
    return F.coalesce(F.shiftright(F.crc32(column.cast("string")), 1), F.lit(0).cast("bigint"))


def _position(axes: list[str]) -> Column:
    """Sort key along the ``axis`` of a node, from 1: the coordinate, then the point's own number."""
    return F.element_at(F.array(*[F.col(a) * F.lit(1 << 31) + F.col("__tie") for a in axes]), F.col("axis"))


def _widest(points: DataFrame, axes: list[str], spread: dict[str, float]) -> DataFrame:
    """One row per node of several shards: its widest ``axis``, the interval of positions, and the bytes its left side needs."""
    held = points.where("__leaves > 1").groupBy("__node", "__leaves").agg(
        F.sum("__w").alias("w"), *[F.min(a).alias(f"lo_{a}") for a in axes], *[F.max(a).alias(f"hi_{a}") for a in axes])
    widths = F.array(*[(F.col(f"hi_{a}") - F.col(f"lo_{a}")) / F.lit(spread[a]) for a in axes])
    end = lambda side: F.element_at(F.array(*[F.col(f"{side}_{a}") for a in axes]), F.col("axis"))
    return held.withColumn("axis", F.array_position(widths, F.array_max(widths)).cast("int")).select(
        "__node", "axis", F.expr("__leaves div 2").alias("left"), (end("lo") * F.lit(1 << 31)).alias("lo"),
        ((end("hi") + 1) * F.lit(1 << 31)).alias("hi"), (F.col("w") * F.expr("__leaves div 2") / F.col("__leaves")).alias("need"),
        F.lit(None).cast("bigint").alias("cut"))


def _narrowed(points: DataFrame, nodes: DataFrame, axes: list[str]) -> DataFrame:
    """Nodes with the interval of the bin that has the median, or with the ``cut`` if that is settled."""
    near = points.join(nodes, "__node").withColumn("pos", _position(axes)).where("pos BETWEEN lo AND hi")
    bin_ = F.expr(f"(pos - lo) div ((hi - lo + {BINS}) div {BINS})")
    bins = near.groupBy("__node", "need", bin_.alias("bin")).agg(
        F.sum("__w").alias("w"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    order = Window.partitionBy("__node").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # at most BINS rows
    middle = bins.withColumn("upto", F.sum("w").over(order)).withColumn("before", F.col("upto") - F.col("w")).where(
        "upto >= need AND before < need").select("__node", "first", "last", "upto", "before")
    cut = F.expr("""CASE WHEN first IS NULL THEN lo - 1
                         WHEN first = last THEN CASE WHEN upto - need <= need - before THEN first ELSE first - 1 END END""")
    return nodes.join(middle, "__node", "left").select(  # without a middle the share is zero: nothing goes left
        "__node", "axis", "left", F.coalesce("first", "lo").alias("lo"), F.coalesce("last", "hi").alias("hi"),
        (F.col("need") - F.coalesce("before", F.lit(0))).alias("need"), cut.alias("cut"))


def tree_leaves(points: DataFrame, axes: list[str], shards: int) -> DataFrame:
    """Add ``__node``, the shard from 0, to points with coordinates ``axes``, weight ``__w`` and number ``__tie``.

    A node that has k shards gives its left side k // 2 of them and the bytes in
    proportion, so any number of shards comes out even. Points with the same
    coordinate and number stay together. All nodes of a level are a small written
    table with one row each, joined to the points by whatever way its size allows.
    """
    whole = points.agg(*[(F.max(a) - F.min(a)).alias(a) for a in axes]).first()
    spread = {a: float(whole[a] or 0) or 1.0 for a in axes}
    # computed, not literal: a join on a constant would become a product
    points = points.withColumns({"__node": F.pmod("__tie", F.lit(1)).cast("int"), "__leaves": F.lit(shards)})
    for _ in range((shards - 1).bit_length()):
        nodes, settled = cut_lineage(_widest(points, axes, spread), "kd-nodes"), None
        while not nodes.isEmpty():
            tried = cut_lineage(_narrowed(points, nodes, axes), "kd-nodes")
            done, nodes = tried.where("cut IS NOT NULL"), tried.where("cut IS NULL")
            settled = done if settled is None else settled.unionByName(done)
        if settled is None:
            break
        given = points.join(settled.select("__node", "axis", "left", "cut"), "__node", "left")
        right = F.coalesce(_position(axes) > F.col("cut"), F.lit(False))
        leaves = F.when(F.col("cut").isNull(), F.col("__leaves")).when(right, F.col("__leaves") - F.col("left")).otherwise(F.col("left"))
        node = F.col("__node") + F.when(right, F.col("left")).otherwise(0)
        points = cut_lineage(given.withColumns({"__leaves": leaves.cast("int"), "__node": node.cast("int")}).select(points.columns), "kd-points")
    return points.drop("__leaves")


def kd_shards(df: DataFrame, key: str, text: str, categories: list[str], shards: int | None = None,
              target_bytes: int | None = None) -> DataFrame:
    """One row per input row: ``key``, ``size``, ``text_crc32``, ``shard`` and ``slot`` (gapless from 0 in the shard).

    Size is the UTF-8 bytes of the text plus 1. The dimensions are the size and
    the categories. Without ``shards`` their number is total bytes over
    ``target_bytes``. Equal texts are one point, placed by the smallest of their
    categories, and share a shard, unless together they weigh more than a
    twentieth of a shard: such a group is cut by its rows' keys, so that shards
    stay even. A null text has no bytes and checksum 0, null categories and keys
    are values of their own, repeated rows each get a slot, and an empty table
    gives an empty result. Other columns are ignored.
    """
    if (shards is None) == (target_bytes is None):
        raise ValueError("give either shards or target_bytes")
    body = F.coalesce(F.col(text), F.lit(""))
    rows = cut_lineage(df.select(
        F.col(key).alias("__key"), (F.octet_length(body) + 1).cast("bigint").alias("__size"),
        F.crc32(body).alias("__crc"), F.xxhash64(body).alias("__hash"),
        *[category_axis(F.col(c)).alias(f"__axis{i}") for i, c in enumerate(categories)],
    ), "kd-rows")
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("__size"), F.lit(0)).alias("bytes")).first()
    shards = shards or max(1, -(-total["bytes"] // target_bytes))
    group = ["__hash", "__crc", "__size"]
    limit = WHOLE_GROUP * total["bytes"] / shards
    # at most shards / WHOLE_GROUP groups are this heavy
    heavy = cut_lineage(rows.groupBy(*group).agg(F.sum("__size").alias("w")).where(F.col("w") > limit).select(
        *group, F.lit(True).alias("__heavy")), "kd-heavy")
    piece = F.when(F.col("__heavy"), F.pmod(F.xxhash64("__key", F.lit(9)), F.lit(PIECES))).otherwise(F.lit(0).cast("bigint"))
    rows = rows.join(heavy, group, "left").withColumn("__piece", piece).drop("__heavy")
    axes = ["__axis_size", *[f"__axis{i}" for i in range(len(categories))]]
    points = cut_lineage(rows.groupBy(*group, "__piece").agg(
        F.sum("__size").alias("__w"), *[F.min(a).alias(a) for a in axes[1:]],
    ).withColumns({
        "__axis_size": number_axis(F.col("__size")),
        "__tie": F.shiftrightunsigned(F.xxhash64(*group, "__piece"), 33),
    }), "kd-points")
    leaves = tree_leaves(points, axes, shards).select(*group, "__piece", F.col("__node").alias("__shard"))
    placed = rows.join(leaves, [*group, "__piece"])
    buckets = max(64, total["n"] // ROWS_PER_BUCKET)
    dealt = placed.withColumn("__bucket", F.pmod(F.xxhash64("__key", "__hash"), F.lit(buckets)))
    slots = totals_before(dealt, "__bucket", ["__key", "__hash"], {"__slot": F.lit(1).cast("bigint")}, ["__shard"])
    return slots.select(
        F.col("__key").alias(key), F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"),
        F.col("__shard").cast("int").alias("shard"), F.col("__slot").cast("bigint").alias("slot"),
    )
