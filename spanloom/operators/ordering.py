"""Running totals and row positions without one global window.

A plain ``sum() over (order by ...)`` moves the whole table into one task. Both
helpers here split the order into buckets, total each bucket, and add the total
of the buckets before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.functions.randomness import unit_random
from spanloom.session import cut_lineage

BUCKETS = 4096
COPIES_PER_TASK = 10_000


def bucket_count(df: DataFrame) -> int:
    """Buckets of a random order: they grow with the shuffle width, which is set for the size of the data."""
    return max(BUCKETS, 16 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def totals_before(df: DataFrame, bucket: str, order, values: dict, within=()) -> DataFrame:
    """Add, for each ``values`` entry, the sum over all rows that come earlier.

    ``bucket`` is an integer column that grows with the order, ``order`` breaks
    it down inside a bucket and must be unique there.
    """
    within = list(within)
    parts = df.groupBy(*within, bucket).agg(*[F.sum(v).alias(f"__{n}") for n, v in values.items()])
    earlier = Window.partitionBy(*within).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        *within, bucket, *[F.coalesce(F.sum(f"__{n}").over(earlier), F.lit(0)).alias(f"__{n}") for n in values]
    )
    local = Window.partitionBy(*within, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = df.select(
        "*", *[F.coalesce(F.sum(v).over(local), F.lit(0)).alias(f"__in_{n}") for n, v in values.items()]
    ).join(offsets, [*within, bucket])
    kept = [c for c in df.columns]
    return placed.select(*kept, *[(F.col(f"__{n}") + F.col(f"__in_{n}")).alias(n) for n in values])


def positions_by_number(df: DataFrame, u: Column, order, within=(), name: str = "position",
                        buckets: int | None = None) -> DataFrame:
    """0-based place of each row in the order of ``u``, evenly spread over [0, 1), then ``order``."""
    buckets = buckets or bucket_count(df)
    spread = df.withColumn("__u", u).withColumn("__bucket", F.floor(F.col("__u") * buckets).cast("int"))
    placed = totals_before(spread, "__bucket", ["__u", *order], {name: F.lit(1).cast("bigint")}, within)
    return placed.drop("__u", "__bucket")


def shuffled_positions(df: DataFrame, seed, keys, within=(), name: str = "position",
                       buckets: int | None = None) -> DataFrame:
    """0-based place of each row in the hash-random order; ``keys`` are unique in ``within``."""
    u = unit_random(seed, *[F.col(k) for k in within], *[F.col(k) for k in keys])
    return positions_by_number(df, u, list(keys), within, name, buckets)


def sorted_totals(df: DataFrame, order, values: dict) -> DataFrame:
    """Like :func:`totals_before` for any sort order.

    The range-sorted rows are written once, so the partition each row landed in
    is fixed and can serve as the bucket.
    """
    tagged = df.orderBy(*order).withColumn("__row", F.monotonically_increasing_id())
    fixed = cut_lineage(tagged).withColumn("__bucket", F.shiftright("__row", 33).cast("int"))
    return totals_before(fixed, "__bucket", ["__row"], values).drop("__row", "__bucket")


def sorted_positions(df: DataFrame, order, name: str = "position") -> DataFrame:
    """0-based place of each row in a sorted order of distinct keys."""
    return sorted_totals(df, order, {name: F.lit(1).cast("bigint")})


def top_k(df: DataFrame, partition, order, k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group; Spark limits each map task to k rows first."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def random_k(df: DataFrame, partition, k: int, seed, keys) -> DataFrame:
    """A seeded random ``k`` rows of each group."""
    u = unit_random(seed, *[F.col(c) for c in keys])
    return top_k(df.withColumn("__u", u), partition, ["__u", *keys], k, "__rn").drop("__u", "__rn")


def shuffle_rows(df: DataFrame, seed, keys=None) -> DataFrame:
    """The rows in seeded random order (range-partitioned sort).

    ``keys`` must tell the rows apart. Without them identical rows are counted
    and dealt out again with a copy number, so that copies are scattered too and
    no task sorts all of them.
    """
    if keys is not None:
        u = unit_random(seed, *[F.col(c) for c in keys])
        return df.withColumn("__u", u).orderBy("__u", *keys).drop("__u")
    columns = df.columns
    counted = df.groupBy(*columns).agg(F.count("*").alias("__n"))
    last = F.floor((F.col("__n") - 1) / COPIES_PER_TASK)
    dealt = counted.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    start = F.col("__part") * COPIES_PER_TASK
    number = F.sequence(start + 1, F.least(start + COPIES_PER_TASK, F.col("__n")))
    copies = dealt.repartition(*columns, "__part").withColumn("__copy", F.explode(number))
    u = unit_random(seed, F.xxhash64(*columns), F.col("__copy"))
    return copies.withColumn("__u", u).orderBy("__u", "__copy").select(*columns)


def head_sample(df: DataFrame, n: int) -> DataFrame:
    """First ``n`` rows, for a look at the data."""
    return df.limit(n)
