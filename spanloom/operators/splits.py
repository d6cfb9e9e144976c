"""Random splits, their checks, and merging of labelled samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.randomness import unit_random
from spanloom.operators.ordering import positions_by_number, shuffle_rows

NO_LABEL = "NO LABEL"


def rest_sizes(total: int, rest_share: float = 0.3, test_share: float = 0.5) -> dict[str, int]:
    """Train, test and dev sizes: the rest is cut off first, then halved; sizes round down."""
    rest = int(rest_share * total)
    dev = int(test_share * rest)
    return {"train": total - rest, "test": rest - dev, "dev": dev}


def share_sizes(total: int, shares: dict[str, float]) -> dict[str, int]:
    """Sizes of shares that need not sum to one; the first split takes the remainder."""
    weight = sum(shares.values())
    sizes = {name: int(total * share / weight) for name, share in shares.items()}
    first = next(iter(sizes))
    sizes[first] += total - sum(sizes.values())
    return sizes


def _digest(key: str):
    return F.sha2(F.col(key).cast("string"), 256)


def distinct_count(df: DataFrame, key: str) -> int:
    """Number of distinct keys; only digests of long texts are shuffled."""
    return df.where(F.col(key).isNotNull()).select(_digest(key).alias("d")).distinct().count()


def assign_splits(df: DataFrame, key: str, sizes: dict[str, int], seed=42, split: str = "split") -> DataFrame:
    """Add a split column; the sizes count distinct keys, copies of a key stay together.

    The distinct keys, as digests, are ranked in random order without a global
    window. Only the boundary entries (one per split) come back, and every row
    is placed by comparing its own random number with them, so a key that holds
    much of the table is never joined or grouped.
    """
    u, digest = unit_random(seed, F.col(key)), _digest(key)
    names, ends, last = list(sizes), {}, 0
    for name in names:
        last += sizes[name]
        ends[name] = last
    distinct = df.where(F.col(key).isNotNull()).select(u.alias("u"), digest.alias("digest")).distinct()
    placed = positions_by_number(distinct, F.col("u"), ["digest"])
    first_after = {r["position"]: r for r in placed.where(F.col("position").isin(list(ends.values()))).collect()}
    place = F.lit(names[-1])
    for name in reversed(names[:-1]):
        cut = first_after.get(ends[name])
        if cut is None:
            place = F.lit(name)
        else:
            before = (u < F.lit(cut["u"])) | ((u == F.lit(cut["u"])) & (digest < F.lit(cut["digest"])))
            place = F.when(before, name).otherwise(place)
    return df.withColumn(split, place)


def overlapping_keys(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys found in more than one split; empty when the split is clean."""
    digests = df.select(_digest(key).alias("__digest"), split)
    found = digests.groupBy("__digest").agg(F.min(split).alias("a"), F.max(split).alias("b")).where("a <> b")
    return df.withColumn("__digest", _digest(key)).join(found, "__digest", "left_semi").select(key).distinct()


def common_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).intersect(right.select(key))


def relabel(df: DataFrame, labels: str = "skills", value: str = NO_LABEL) -> DataFrame:
    """Give every sample the one-label list ``[value]``."""
    return df.withColumn(labels, F.array(F.lit(value)))


def require_disjoint(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """The rows as they are; a key in more than one split is an error."""
    bad = overlapping_keys(df, key, split).limit(5).collect()
    if bad:
        raise ValueError(f"in more than one split: {[str(r[key])[:80] for r in bad]}")
    return df


def wrap_label(df: DataFrame, label: str) -> DataFrame:
    return df.withColumn(label, F.array(label))


def merge_samples(positives: DataFrame, negatives: DataFrame, seed=42, keys=None) -> DataFrame:
    """All rows of both, in seeded random order; ``keys`` as for :func:`shuffle_rows`."""
    return shuffle_rows(positives.unionByName(negatives), seed, keys)
