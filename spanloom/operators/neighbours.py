"""Exact nearest neighbours over embedding columns."""

from __future__ import annotations

import logging
import math

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.randomness import unit_random
from spanloom.functions.vectors import unit
from spanloom.operators.blocks import BROADCAST_ROWS, SCALE, best_matches, matches_in_groups
from spanloom.session import cut_lineage

LOG = logging.getLogger("spanloom.neighbours")

PIVOTS = 256
SLACK = 1e-6


def stack(vectors) -> np.ndarray:
    if isinstance(vectors, np.ndarray) and vectors.ndim == 2:
        return vectors
    vectors = pd.Series(vectors)
    return np.stack(vectors.to_numpy()).astype(np.float64) if len(vectors) else np.zeros((0, 0))


def dot_scores(left, right: np.ndarray) -> np.ndarray:
    return stack(left) @ right.T


def _angles(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(vectors @ pivots.T, -1.0, 1.0))


class Cells:
    """Right rows in the cells of their nearest pivots, and what a left row can leave out.

    By the triangle inequality on angles, no row of a cell is closer to a left
    row than its angle to the pivot less the cell's radius. Cells are put
    together in blocks of at most ``block_rows`` rows, a larger cell is cut by
    row id. Pivots, radii and row counts are a few hundred rows.
    """

    def __init__(self, right: DataFrame, cell_rows: int, block_rows: int, rows: int, pivot_count: int = PIVOTS):
        spark = right.sparkSession
        chosen = right.orderBy(unit_random("pivot", F.col("right_id")), "right_id").select("right_value")
        pivots = stack(chosen.limit(max(1, min(pivot_count, math.ceil(rows / cell_rows)))).toPandas()["right_value"])
        shared = spark.sparkContext.broadcast(pivots)

        def to_cells(batches):
            for batch in batches:
                if len(batch):
                    angles = _angles(stack(batch["right_value"]), shared.value)
                    cell = angles.argmin(axis=1)
                    yield batch.assign(cell=cell.astype("int32"), angle=angles[np.arange(len(cell)), cell])

        placed = cut_lineage(right.mapInPandas(to_cells, f"{_fields(right)}, cell int, angle double"), "cells")
        # at most one row per pivot
        cells = placed.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).toPandas()
        self.size, radius, n = len(pivots), np.full(len(pivots), -np.inf), np.zeros(len(pivots), np.int64)
        radius[cells["cell"]], n[cells["cell"]] = cells["radius"], cells["n"]
        first, parts = _packed(n, block_rows)
        holds = np.zeros((len(pivots), int((first + parts).max(initial=1))), bool)
        for cell in np.flatnonzero(n):
            holds[cell, first[cell]:first[cell] + parts[cell]] = True
        at = lambda numbers: F.element_at(F.array(*[F.lit(int(x)) for x in numbers]), F.col("cell") + 1)
        self.right = placed.withColumn("block", (at(first) + F.pmod(F.xxhash64("right_id"), at(parts))).cast("int")).drop("angle")
        self.known = spark.sparkContext.broadcast((pivots, radius, n, holds))

    def probes(self, left: DataFrame, choose, name: str) -> DataFrame:
        """Left rows with the cells that ``choose(values, lengths, angles, radius, rows, batch)`` picks, as bits, and their blocks, written once.

        How many of all (row, cell) pairs are met goes to the log.
        """
        known = self.known

        def run(batches):
            pivots, radius, n, holds = known.value
            for batch in batches:
                if len(batch):
                    vectors = stack(batch["left_value"])
                    length = np.linalg.norm(vectors, axis=1)
                    angles = _angles(vectors / np.where(length > 0, length, 1.0)[:, None], pivots)
                    needed = choose(length, angles, radius, n, batch)
                    blocks = needed.astype(np.float32) @ holds.astype(np.float32) > 0
                    yield batch.assign(cells=needed.sum(axis=1).astype("int32"), met=[row.tobytes() for row in np.packbits(needed, axis=1)],
                                       blocks=[np.flatnonzero(row).astype("int32") for row in blocks])

        found = cut_lineage(left.mapInPandas(run, f"{_fields(left)}, cells int, met binary, blocks array<int>"), name)
        if LOG.isEnabledFor(logging.INFO):
            met, rows = found.agg(F.coalesce(F.sum("cells"), F.lit(0)), F.count("*")).first()
            LOG.info("%s: %d of %d pairs of a row and a cell are met", name, met, rows * self.size)
        return found

    def blocks(self, probes: DataFrame) -> DataFrame:
        """One left row for each block that has cells it meets."""
        return probes.select("left_id", "left_value", "met", F.explode("blocks").alias("block"))


def _packed(n: np.ndarray, block_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of every cell; cells in a row share a block as long as it has room."""
    parts = np.maximum(1, -(-n // block_rows))
    first, following, room = np.zeros(len(n), np.int64), 0, 0
    for cell in np.flatnonzero(n):
        if parts[cell] == 1 and n[cell] <= room:
            first[cell], room = following - 1, room - n[cell]
        else:
            first[cell], following = following, following + parts[cell]
            room = block_rows - n[cell] if parts[cell] == 1 else 0
    return first, parts


def _fields(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)


def _reach(length: np.ndarray, least: np.ndarray, angles: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Cells that may hold a dot product of at least ``least``; only those above 0 bound an angle."""
    cut = np.where(length > 0, least / np.where(length > 0, length, 1.0), 0.0)
    limit = np.arccos(np.clip(cut, -1.0, 1.0))[:, None] + radius[None, :] + SLACK
    return ((angles <= limit) & (cut < 1.0 + SLACK)[:, None]) | ~((length > 0) & (least > -np.inf))[:, None]


def _nearest_cells(k: int):
    """The nearest cells that hold k rows together."""
    def choose(length, angles, radius, n, batch):
        order = np.argsort(angles, axis=1, kind="stable")
        before = np.cumsum(n[order], axis=1) - n[order]
        out = np.zeros(angles.shape, bool)
        np.put_along_axis(out, order, before < k, axis=1)
        return out & (n > 0)

    return choose


def angular_probes(threshold: float, pivot_count: int = PIVOTS):
    """Plan that lets a left row skip the cells which cannot hold a match above a threshold. Exact."""
    def plan(left: DataFrame, right: DataFrame, cell_rows: int, block_rows: int, rows: int, meet) -> DataFrame:
        cells = Cells(right, cell_rows, block_rows, rows, pivot_count)

        def choose(length, angles, radius, n, batch):
            return _reach(length, np.full(len(length), threshold), angles, radius) & (length > 0)[:, None] & (n > 0)

        return meet(cells.blocks(cells.probes(left, choose, "probes")), cells.right)

    return plan


def bounded_probes(k: int, skip_same: bool, pivot_count: int = PIVOTS):
    """Plan without a threshold in two passes.

    The first looks into the nearest cells that hold k rows, which gives every
    left row a bound for its k-th best score; the second meets only the other
    cells that may hold a score of at least that bound. Exact.
    """
    first = _nearest_cells(k + skip_same)

    def plan(left: DataFrame, right: DataFrame, cell_rows: int, block_rows: int, rows: int, meet) -> DataFrame:
        cells = Cells(right, cell_rows, block_rows, rows, pivot_count)
        near = cut_lineage(meet(cells.blocks(cells.probes(left, first, "nearest_cells")), cells.right), "near")
        bound = near.where(F.col("rank") == k).select("left_id", F.col("score").alias("least"))

        def choose(length, angles, radius, n, batch):
            least = batch["least"].to_numpy(float)
            least = np.where(np.isnan(least), -np.inf, least - 1.0 / SCALE)  # scores are rounded
            return _reach(length, least, angles, radius) & ~first(length, angles, radius, n, batch) & (n > 0)

        others = cells.probes(left.join(bound, "left_id", "left"), choose, "other_cells")
        return near.drop("rank").unionByName(meet(cells.blocks(others), cells.right).drop("rank"))

    return plan


def search_vectors(
    left: DataFrame,
    right: DataFrame,
    k: int,
    threshold: float | None = None,
    skip_same: bool = False,
    broadcast_rows: int = BROADCAST_ROWS,
    block_rows: int | None = None,
    grouped: bool = False,
) -> DataFrame:
    """Best k right vectors per left vector by dot product (see :func:`best_matches`).

    Give unit vectors for cosine. With a threshold of at least 0 the blocked
    plan prunes by angle, without one (or with one that a zero vector could
    pass) by the bound of a first pass. ``grouped`` right sides have a best k in
    every group, so every block is met.
    """
    if grouped:
        probes = None
    elif threshold is not None and threshold >= 0:
        probes = angular_probes(threshold)
    else:
        probes = bounded_probes(k, skip_same)
    return best_matches(
        left, right, k, dot_scores, stack, floor=threshold, skip_same=skip_same,
        broadcast_rows=broadcast_rows, block_rows=block_rows, probes=probes,
    )


def _sides(left, left_id, left_vector, right, right_id, right_vector, category=None):
    group = F.col(category) if category else F.lit(0)
    # the null test is on the raw column: it reaches the scan and the norm is computed once
    lhs = left.where(F.col(left_vector).isNotNull()).select(
        F.col(left_id).alias("left_id"), unit(left_vector).alias("left_value")
    )
    rhs = right.where(F.col(right_vector).isNotNull()).select(
        group.alias("right_group"), F.col(right_id).alias("right_id"), unit(right_vector).alias("right_value")
    )
    return lhs, rhs


def nearest(
    taxonomy: DataFrame, k: int, threshold: float | None = None, name: str = "name", vector: str = "embedding",
    **sizes,
) -> DataFrame:
    """(anchor, neighbour, sim, rank): the k most similar other names, then sim > threshold.

    Names must be unique (merge the taxonomy first; repeated names are an error). The anchor is excluded by
    name, not by being first in the list.
    """
    lhs, rhs = _sides(taxonomy, name, vector, taxonomy, name, vector)
    found = search_vectors(lhs, rhs, k, threshold, skip_same=True, **sizes)
    return found.select(
        F.col("left_id").alias("anchor"), F.col("right_id").alias("neighbour"), F.col("score").alias("sim"), "rank"
    )


def nearest_per_category(
    taxonomy: DataFrame, category: str, k: int, threshold: float | None = None, name: str = "name",
    vector: str = "embedding", **sizes,
) -> DataFrame:
    """(anchor, category, neighbour, sim, rank): the k nearest of every category."""
    lhs, rhs = _sides(taxonomy, name, vector, taxonomy, name, vector, category)
    found = search_vectors(lhs, rhs, k, threshold, skip_same=True, grouped=True, **sizes)
    return found.select(
        F.col("left_id").alias("anchor"), F.col("right_group").alias("category"),
        F.col("right_id").alias("neighbour"), F.col("score").alias("sim"), "rank",
    )


def nearest_of_pairs(
    pairs: DataFrame, taxonomy: DataFrame, category: str, k: int, threshold: float | None = None, name: str = "name",
    vector: str = "embedding", **sizes,
) -> DataFrame:
    """As :func:`nearest_per_category` for the distinct (anchor, category) ``pairs`` alone; nothing else is searched."""
    lhs, rhs = _sides(taxonomy, name, vector, taxonomy, name, vector, category)
    wanted = pairs.select(F.col("anchor").alias("left_id"), F.col("category").alias("right_group")).distinct()
    found = matches_in_groups(
        wanted.join(lhs, "left_id"), rhs.where(F.col("right_group").isNotNull()), k, dot_scores, stack, floor=threshold, skip_same=True, **sizes)
    return found.select(
        F.col("left_id").alias("anchor"), F.col("right_group").alias("category"),
        F.col("right_id").alias("neighbour"), F.col("score").alias("sim"), "rank",
    )


def nearest_entities(
    spans: DataFrame, taxonomy: DataFrame, k: int, span_id: str, span_vector: str, entity_id: str = "unique_id",
    entity_vector: str = "embedding", threshold: float | None = None, **sizes,
) -> DataFrame:
    """(span_id, entity_id, sim, rank): exactly the k most similar entities of each span."""
    lhs, rhs = _sides(spans, span_id, span_vector, taxonomy, entity_id, entity_vector)
    found = search_vectors(lhs, rhs, k, threshold, **sizes)
    return found.select(
        F.col("left_id").alias(span_id), F.col("right_id").alias(entity_id), F.col("score").alias("sim"), "rank"
    )


def nearest_references(
    combos: DataFrame, taxonomy: DataFrame, references: DataFrame, n: int, threshold: float = 0.0,
    combo_id: str = "draw_id", members: str = "members", reference_id: str = "reference_id", **sizes,
) -> DataFrame:
    """References with the highest average cosine to all members of a combination.

    The average of cosines equals the dot product with the mean unit vector, so
    one vector per combination is searched instead of one per member.
    """
    means = mean_vectors(
        combos.select(combo_id, F.explode(members).alias("name"))
        .join(taxonomy.select("name", unit("embedding").alias("__u")), "name"),
        [combo_id], "__u",
    )
    lhs = means.select(F.col(combo_id).alias("left_id"), F.col("mean_vector").alias("left_value"))
    rhs = references.select(
        F.lit(0).alias("right_group"), F.col(reference_id).alias("right_id"), unit("embedding").alias("right_value")
    )
    found = search_vectors(lhs, rhs, n, threshold, **sizes)
    return found.select(
        F.col("left_id").alias(combo_id), F.col("right_id").alias(reference_id), F.col("score").alias("sim"), "rank"
    )


def vector_totals(df: DataFrame, keys, vector: str, **extra) -> DataFrame:
    """Component-wise sum, row count and ``extra`` aggregates per key, combined on the map side."""
    summed = df.where(F.col(vector).isNotNull()).groupBy(*keys).agg(
        Summarizer.sum(array_to_vector(F.col(vector))).alias("__sum"), F.count("*").alias("n"),
        *[column.alias(name) for name, column in extra.items()],
    )
    return summed.select(*keys, vector_to_array("__sum").alias("total"), "n", *extra)


def mean_vectors(df: DataFrame, keys, vector: str) -> DataFrame:
    summed = vector_totals(df, keys, vector)
    return summed.select(*keys, F.transform("total", lambda x: x / F.col("n")).alias("mean_vector"))


def neighbours_outside(
    combos: DataFrame, taxonomy: DataFrame, k: int = 2, combo_id: str = "draw_id", members: str = "members",
    near: DataFrame | None = None, **sizes,
) -> DataFrame:
    """Words to avoid: the k nearest of every member that are not members themselves.

    ``near`` is the result of an earlier search with at least k neighbours and no threshold.
    """
    ranked = nearest(taxonomy, k, **sizes) if near is None else near.where(F.col("rank") <= k)
    near = ranked.groupBy("anchor").agg(F.collect_list("neighbour").alias("near"))
    exploded = combos.select(combo_id, members, F.explode(members).alias("anchor"))
    # members and k are both short, so the set per combination is small
    gathered = exploded.join(near, "anchor").groupBy(combo_id).agg(
        F.first(members).alias("__members"), F.flatten(F.collect_list("near")).alias("__near")
    )
    avoid = F.sort_array(F.array_distinct(F.array_except("__near", "__members")))
    return combos.select(combo_id).join(gathered.select(combo_id, avoid.alias("avoid")), combo_id, "left").select(
        combo_id, F.coalesce("avoid", F.array().cast("array<string>")).alias("avoid")
    )
