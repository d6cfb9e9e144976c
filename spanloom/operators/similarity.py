"""Similarity summaries that never write out pairs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.vectors import cosine, squared_norm, unit
from spanloom.operators.blocks import SCALE
from spanloom.operators.neighbours import stack, vector_totals
from spanloom.session import cut_lineage

#: Vectors of a block; two blocks meet in a task.
BLOCK_BYTES = 16 << 20
#: Blocks of a table that is smaller, if each has so many rows.
LEAST_BLOCKS, LEAST_ROWS = 4, 512
#: Similarities held at a time.
PIECE_CELLS = 1 << 21


def _group_sums(df: DataFrame, keys, vector: str) -> DataFrame:
    """Per key: sum of unit vectors, row count, rows with a length."""
    units = df.select(*keys, unit(vector).alias("__u"))
    has_length = F.sum(F.when(squared_norm("__u") > 0, 1).otherwise(0))
    return vector_totals(units, keys, "__u", m=has_length)


def pair_similarity_by_label(df: DataFrame, label: str, vector: str = "embedding",
                             denominator: str = "cells") -> DataFrame:
    """(label, intra_sim): sum of cosines over pairs of a label, over n*n cells or over pairs.

    The sum over pairs is (|sum of units|^2 - number of units) / 2, so the cost
    is linear in the rows and a hot label is combined on the map side.
    """
    sums = _group_sums(df.where(F.col(label).isNotNull()), [label], vector)
    pairs = (squared_norm("total") - F.col("m")) / 2
    n = F.col("n").cast("double")
    below = n * n if denominator == "cells" else n * (n - 1) / 2
    return sums.select(label, F.when(below > 0, pairs / below).otherwise(0.0).alias("intra_sim"), "n")


def intra_label_similarity(df: DataFrame, labels: str, vector: str = "embedding", **options) -> DataFrame:
    """As above with the labels given as an array column."""
    return pair_similarity_by_label(df.select(F.explode(labels).alias("label"), vector), "label", vector, **options)


def mean_pair_similarity(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """One row: rows, pairs and the mean cosine over all pairs."""
    sums = _group_sums(df, [], vector)
    n = F.col("n").cast("double")
    pairs = n * (n - 1) / 2
    return sums.select(
        "n", pairs.cast("bigint").alias("pairs"),
        F.when(pairs > 0, (squared_norm("total") - F.col("m")) / 2 / pairs).alias("mean_sim"),
    )


def _block_count(df: DataFrame, width: int) -> int:
    """Blocks of about BLOCK_BYTES of vectors; a small table still makes some tasks."""
    rows = df.count()
    return max(1, math.ceil(rows * max(1, width) * 8 / BLOCK_BYTES), min(LEAST_BLOCKS, rows // LEAST_ROWS))


def _met_blocks(rows: DataFrame, blocks: int, count, schema: str) -> DataFrame:
    """``count(same block, left, right)`` for every pair of blocks of (id, v, block), each pair once."""
    lower = rows.withColumn("other", F.explode(F.sequence("block", F.lit(blocks - 1)))).select(
        "id", "v", F.col("block").alias("a"), F.col("other").alias("b"))
    upper = rows.withColumn("other", F.explode(F.sequence(F.lit(0), "block"))).select(
        "id", "v", F.col("other").alias("a"), F.col("block").alias("b"))

    def run(key, left, right):
        return count(key[0] == key[1], left, right)

    return lower.groupBy("a", "b").cogroup(upper.groupBy("a", "b")).applyInPandas(run, schema)


def _similarities(same: bool, left: pd.DataFrame, right: pd.DataFrame):
    """Cosines of the pairs of two blocks as whole numbers of 1 / SCALE, piece by piece; exact zeros are left out."""
    vectors, ids = stack(right["v"]).T, right["id"].to_numpy()
    step = max(1, PIECE_CELLS // max(1, len(right)))
    for start in range(0, len(left), step):
        part = left.iloc[start:start + step]
        sims = np.rint((stack(part["v"]) @ vectors) * SCALE).astype(np.int64)
        keep = sims != 0
        if same:
            keep &= part["id"].to_numpy()[:, None] < ids[None, :]
        yield sims[keep]


def _blocked(df: DataFrame, id_col: str, vector: str, block_rows: int | None) -> tuple[DataFrame, int]:
    width = df.agg(F.max(F.size(vector))).first()[0] or 0
    blocks = _block_count(df, width) if block_rows is None else max(1, math.ceil(df.count() / block_rows))
    block = F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int")
    return df.select(F.col(id_col).alias("id"), unit(vector).alias("v"), block.alias("block")), blocks


def pair_similarity_histogram(df: DataFrame, bins: int = 40, id_col: str = "id", vector: str = "embedding",
                              block_rows: int | None = None) -> DataFrame:
    """(bin, low, pairs): exact histogram over [-1, 1] of all pair cosines, exact zeros left out.

    Row blocks meet pairwise in bounded tasks that only return bin counts.
    """
    rows, blocks = _blocked(df, id_col, vector, block_rows)

    def count(same, left, right):
        counts = np.zeros(bins, dtype=np.int64)
        if len(left) and len(right):
            for sims in _similarities(same, left, right):
                # integer arithmetic: a value on an edge always falls in the upper bin
                place = np.clip((sims + SCALE) * bins // (2 * SCALE), 0, bins - 1)
                counts += np.bincount(place, minlength=bins)
        found = np.flatnonzero(counts)
        return pd.DataFrame({"bin": found.astype("int32"), "pairs": counts[found]})

    parts = _met_blocks(rows, blocks, count, "bin int, pairs bigint")
    return parts.groupBy("bin").agg(F.sum("pairs").alias("pairs")).select(
        "bin", (F.col("bin") * F.lit(2.0 / bins) - 1.0).alias("low"), "pairs"
    )


def pair_similarity_quantiles(df: DataFrame, quantiles, id_col: str = "id", vector: str = "embedding", bins: int = 4_096,
                              block_rows: int | None = None) -> DataFrame:
    """(quantile, sim): exact quantiles of all pair cosines at nine decimals, exact zeros left out.

    A quantile between two ranks lies in proportion between them. The histogram
    of the pairs is refined inside the bins that hold the wanted ranks until a
    bin is one value: some passes over the blocks, each returning bin counts of
    these few intervals. No pairs give null.
    """
    given, blocks = _blocked(df, id_col, vector, block_rows)
    rows = cut_lineage(given, "units")

    def counted(intervals: list[tuple[int, int]]) -> dict[tuple[int, int], int]:
        """Number of pairs in each bin of each interval [low, high)."""
        def count(same, left, right):
            counts = np.zeros((len(intervals), bins), dtype=np.int64)
            if len(left) and len(right):
                for sims in _similarities(same, left, right):
                    for i, (low, high) in enumerate(intervals):
                        inside = sims[(sims >= low) & (sims < high)]
                        counts[i] += np.bincount((inside - low) * bins // (high - low), minlength=bins)
            at, place = np.nonzero(counts)
            return pd.DataFrame({"i": at.astype("int32"), "bin": place.astype("int32"), "pairs": counts[at, place]})

        parts = _met_blocks(rows, blocks, count, "i int, bin int, pairs bigint").groupBy("i", "bin").agg(F.sum("pairs").alias("pairs"))
        return {(r["i"], r["bin"]): r["pairs"] for r in parts.collect()}  # at most bins for each interval

    every = (-2 * SCALE, 2 * SCALE)
    first = counted([every])
    total = sum(first.values())
    spark = df.sparkSession
    if not total:
        return spark.createDataFrame([(float(q), None) for q in quantiles], "quantile double, sim double")
    ranks = sorted({r for q in quantiles for r in (math.floor(q * (total - 1)), math.ceil(q * (total - 1)))})
    values, open_ = {}, {r: (every, 0) for r in ranks}  # interval of each rank, and pairs before it
    counts, intervals = first, [every]
    while open_:
        for rank, (interval, before) in list(open_.items()):
            i, (low, high) = intervals.index(interval), interval
            for bin_ in sorted(b for j, b in counts if j == i):
                if before + counts[i, bin_] > rank:
                    break
                before += counts[i, bin_]
            # values whose bin is this one
            inside = (low + -(-bin_ * (high - low) // bins), low + -(-(bin_ + 1) * (high - low) // bins))
            if inside[1] - inside[0] == 1:
                values[rank] = inside[0] / SCALE
                del open_[rank]
            else:
                open_[rank] = (inside, before)
        intervals = sorted({interval for interval, _ in open_.values()})
        counts = counted(intervals) if intervals else {}
    out = []
    for q in quantiles:
        place = q * (total - 1)
        low, high = values[math.floor(place)], values[math.ceil(place)]
        out.append((float(q), low + (high - low) * (place - math.floor(place))))
    return spark.createDataFrame(out, "quantile double, sim double")


def category_affinity(taxonomy: DataFrame, category: str = "category", vector: str = "embedding",
                      temperature: float = 0.1, block_rows: int | None = None) -> DataFrame:
    """(category, other, mean_sim, p): softmax over the mean cosine between categories.

    The mean over all pairs of two categories is the dot product of their unit
    vector sums over the product of their sizes; within a category only pairs
    of different members count. Blocks of sums are multiplied as matrices, in two
    rounds: the first brings each category's largest value and sum of weights
    from every block, the second gives the finished rows, so the square of the
    categories is written once, by whoever asks for it.
    """
    sums = _group_sums(taxonomy, [category], vector).withColumnRenamed(category, "category")
    sums = cut_lineage(sums.withColumn("row", F.monotonically_increasing_id()), "sums")
    width = sums.agg(F.max(F.size("total"))).first()[0] or 0
    blocks = _block_count(sums, max(width, 1)) if block_rows is None else max(1, math.ceil(sums.count() / block_rows))
    block = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    right = sums.select("row", "category", "n", "total", block.alias("b")).withColumn("a", every)

    def means(left: pd.DataFrame, other: pd.DataFrame):
        """Mean cosines of some rows with all of the other block."""
        total, size, ids = stack(other["total"]).T, other["n"].to_numpy(float), other["row"].to_numpy()
        step = max(1, PIECE_CELLS // max(1, len(other)))
        for start in range(0, len(left), step):
            part = left.iloc[start:start + step]
            n, m = part["n"].to_numpy(float)[:, None], part["m"].to_numpy(float)[:, None]
            dots = stack(part["total"]) @ total
            own = np.where(n > 1, (dots - m) / np.where(n > 1, n * (n - 1), 1), 0.0)
            yield part, np.where(part["row"].to_numpy()[:, None] == ids[None, :], own, dots / (n * size[None, :]))

    def weighed(left, other):
        out = []
        if len(left) and len(other):
            for part, mean in means(left, other):
                scaled = mean / temperature
                top = scaled.max(axis=1)
                out.append(pd.DataFrame({"row": part["row"], "top": top, "weight": np.exp(scaled - top[:, None]).sum(axis=1)}))
        return pd.concat(out) if out else pd.DataFrame({"row": [], "top": [], "weight": []})

    def finished(left, other):
        out = []
        if len(left) and len(other):
            names = other["category"].to_numpy()
            for part, mean in means(left, other):
                weight = np.exp(mean / temperature - part["top"].to_numpy()[:, None]) / part["sum"].to_numpy()[:, None]
                out.append(pd.DataFrame({
                    "category": np.repeat(part["category"].to_numpy(), len(names)), "other": np.tile(names, len(part)),
                    "mean_sim": mean.ravel(), "p": weight.ravel()}))
        return pd.concat(out) if out else pd.DataFrame({"category": [], "other": [], "mean_sim": [], "p": []})

    def against(rows: DataFrame, run, schema) -> DataFrame:
        left = rows.withColumn("a", block).withColumn("b", every)
        return left.groupBy("a", "b").cogroup(right.select(*[F.col(c).alias(c) for c in right.columns]).groupBy("a", "b")).applyInPandas(run, schema)

    parts = against(sums.select("row", "n", "m", "total"), weighed, "row bigint, top double, weight double")
    # as many entries for a row as there are blocks
    found = parts.groupBy("row").agg(F.max("top").alias("top"), F.collect_list(F.struct("top", "weight")).alias("parts"))
    whole = F.aggregate("parts", F.lit(0.0), lambda s, p: s + p["weight"] * F.exp(p["top"] - F.col("top")))
    kind = sums.schema["category"].dataType.simpleString()
    return against(sums.join(found.select("row", "top", whole.alias("sum")), "row"), finished,
                   f"category {kind}, other {kind}, mean_sim double, p double")


def sentence_label_similarity(sentences: DataFrame, taxonomy: DataFrame, label: str = "label",
                              vector: str = "embedding") -> DataFrame:
    """Add ``sim``, the cosine of a sentence and its label's entity; unknown labels give null.

    ``taxonomy`` has one row per name (merge it first).
    """
    entities = taxonomy.select(F.col("name").alias(label), F.col("embedding").alias("__entity"))
    joined = sentences.join(entities, label, "left")
    return joined.withColumn("sim", cosine(vector, "__entity")).drop("__entity")
