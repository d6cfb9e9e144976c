"""Hard negatives by exact inner-product search with coordinate pruning, after LEMP.

A block of vectors is cut into buckets of similar length, longest first. A
bucket keeps every coordinate of its unit vectors as a sorted list. For an anchor
and the least score that still counts, the cosine that a bucket's vector needs is
at least score / (anchor's length * bucket's longest); with that cosine the
anchor's focus coordinates (its largest) admit only a range of values each. The
ranges are cut out of the sorted lists and intersected, and what remains is
scored exactly. A bucket that would need a cosine above 1 is skipped.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.llm.common import by_key, finite, quantised
from spanloom.session import cut_lineage

#: Components of vectors in a block, and in a group of anchors: about 32 MB as doubles.
BLOCK_VALUES = 4 << 20
#: Rows of the smallest block worth a task of its own.
SMALL_BLOCK = 2048
BUCKET = 512
#: A bucket's shortest vector has at least this share of the longest one's length.
LENGTHS = 0.9
FOCUS = 5
#: Room for rounding in cosines.
SLACK = 1e-9
EXACT = float(1 << 53)


def index_rows(df: DataFrame, key: str, vector: str, label: Column) -> DataFrame:
    """``row`` (its own number), ``key``, ``label`` and ``code`` (floor(256 * x) as doubles), written once.

    Rows with a null label, a null or empty vector, or a null or non-finite component are left out.
    """
    usable = df.select(F.col(key).cast("bigint").alias("key"), label.cast("bigint").alias("label"), F.col(vector).alias("x")).where(
        F.col("label").isNotNull() & finite("x"))
    return cut_lineage(usable.select(F.monotonically_increasing_id().alias("row"), "key", "label", quantised("x").alias("code")), "lemp")


def _matrix(codes, width: int = 0) -> np.ndarray:
    """Rows of equal length; a shorter vector ends with zeros."""
    width = max([width, *map(len, codes)])
    out = np.zeros((len(codes), width))
    for i, c in enumerate(codes):
        out[i, : len(c)] = c
    return out


class Bucket:
    """Vectors of similar length; ``rows`` are their numbers in the block."""

    def __init__(self, rows: np.ndarray, codes: np.ndarray, lengths: np.ndarray):
        self.rows, self.codes = rows, codes
        self.longest = float(lengths.max())
        self.units = codes / np.where(lengths > 0, lengths, 1)[:, None]
        self.orders = np.argsort(self.units, axis=0, kind="stable")
        self.lists = np.take_along_axis(self.units, self.orders, axis=0)

    def feasible(self, unit: np.ndarray, focus: np.ndarray, cosine: float) -> np.ndarray | None:
        """Places that may have the cosine with the unit vector; None stands for all."""
        if cosine <= 0 or self.longest == 0:
            return None
        spread = np.sqrt(max(0.0, 1 - cosine * cosine) * np.maximum(0.0, 1 - unit[focus] ** 2))
        high = np.where(unit[focus] >= cosine - SLACK, 1.0, unit[focus] * cosine + spread) + SLACK
        low = np.where(-unit[focus] >= cosine - SLACK, -1.0, unit[focus] * cosine - spread) - SLACK
        ranges = [(np.searchsorted(self.lists[:, f], a), np.searchsorted(self.lists[:, f], b, "right"), f, a, b)
                  for f, a, b in zip(focus.tolist(), low.tolist(), high.tolist(), strict=True)]
        ranges.sort(key=lambda r: r[1] - r[0])
        first, last, f, _, _ = ranges[0]
        if last - first == len(self.rows):
            return None
        places = self.orders[first:last, f]
        for _, _, f, a, b in ranges[1:]:
            values = self.units[places, f]
            places = places[(values >= a) & (values <= b)]
        return places


class Block:
    """Vectors as length buckets; rows must come in the order of ties."""

    def __init__(self, codes: np.ndarray):
        lengths = np.sqrt(np.einsum("ij,ij->i", codes, codes))
        order = np.argsort(-lengths, kind="stable")
        self.buckets, self.longest, start = [], float(lengths.max(initial=0)), 0
        while start < len(order):
            near = lengths[order[start:start + BUCKET]] >= LENGTHS * lengths[order[start]]
            end = start + int(near.sum())
            rows = order[start:end]
            self.buckets.append(Bucket(rows, codes[rows], lengths[rows]))
            start = end

    def scores(self, query: np.ndarray, focus: int, least):
        """(rows, exact scores) that may reach the least score of each bucket's turn; ``least()`` is asked before each bucket."""
        length = float(np.sqrt(query @ query))
        unit = query / length if length else query
        focused = np.argsort(-np.abs(unit), kind="stable")[:focus]
        exact = length * self.longest < EXACT
        whole = None if exact else np.array([int(v) for v in query], object)
        for bucket in self.buckets:
            need, reach = least(), length * bucket.longest
            if need > 0 and need > reach * (1 + SLACK):
                return  # later buckets are shorter still
            places = bucket.feasible(unit, focused, need / reach * (1 - SLACK) if reach and need > 0 else 0.0)
            codes = bucket.codes if places is None else bucket.codes[places]
            rows = bucket.rows if places is None else bucket.rows[places]
            if exact:
                yield rows, (codes @ query).astype(np.int64)
            else:  # whole numbers of any size
                yield rows, np.array([sum(int(a) * b for a, b in zip(c, whole, strict=True)) for c in codes.tolist()], object)


def _best(rows, scores, more_rows, more_scores, k: int):
    """The k best by score, then row."""
    rows, scores = np.concatenate([rows, more_rows]), np.concatenate([scores, more_scores])
    kept = np.lexsort((rows, -scores))[:k]
    return rows[kept], scores[kept]


NOTHING = (np.empty(0, np.int64), np.empty(0, np.int64))


def _positives(k: int, focus: int):
    """The k best rows of an anchor's own label in a block."""
    names = ["anchor_row", "anchor", "label", "code", "row", "key", "score"]

    def run(group, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            width = max(max(map(len, left["code"])), max(map(len, right["code"])))
            for label, some in left.groupby("label", sort=True):
                anchors = right[right["label"] == label]
                if not len(anchors):
                    continue
                some, keys = by_key(some)
                block, rows = Block(_matrix(some["code"].tolist(), width)), some["row"].to_numpy()
                for row, key, code in anchors[["row", "key", "code"]].itertuples(index=False, name=None):
                    best = NOTHING
                    found = block.scores(_matrix([code], width)[0], focus, lambda: best[1][-1] if len(best[1]) == k else -np.inf)
                    for at, scores in found:
                        other = rows[at] != row
                        best = _best(*best, at[other], scores[other], k)
                    out += [(row, key, label, code, rows[i], keys[i], int(s)) for i, s in zip(*best, strict=True)]
        return pd.DataFrame(out, columns=names)

    return run


def _negatives(k: int, focus: int, low: int, high: int):
    """The k best rows of other labels in a block, within the range of each of an anchor's positives."""
    names = ["anchor_row", "positive_row", "anchor", "positive", "positive_score", "row", "key", "score"]

    def run(group, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            width = max(max(map(len, left["code"])), max(map(len, right["code"])))
            left, keys = by_key(left)
            block = Block(_matrix(left["code"].tolist(), width))
            rows, labels = left["row"].to_numpy(), left["label"].to_numpy()
            for row, key, label, code, positives in right[["anchor_row", "anchor", "label", "code", "positives"]].itertuples(
                    index=False, name=None):
                # 100 * score from low * positive to high * positive
                bounds = {p: (-(-low * p // 100), high * p // 100) for p in {int(p["score"]) for p in positives}}
                best = {p: NOTHING for p, (a, b) in bounds.items() if a <= b}

                def least(best=best, bounds=bounds):
                    return min(max(bounds[p][0], f[1][-1]) if len(f[1]) == k else bounds[p][0] for p, f in best.items())

                for at, scores in block.scores(_matrix([code], width)[0], focus, least) if best else ():
                    other = labels[at] != label
                    at, scores = at[other], scores[other]
                    for p, (a, b) in bounds.items():
                        if p in best:
                            fits = (scores >= a) & (scores <= b)
                            best[p] = _best(*best[p], at[fits], scores[fits], k)
                out += [(row, p["row"], key, p["key"], int(p["score"]), rows[i], keys[i], int(s))
                        for p in positives for i, s in zip(*best.get(int(p["score"]), NOTHING), strict=True)]
        return pd.DataFrame(out, columns=names)

    return run


def _met(left: DataFrame, right: DataFrame, blocks: int, groups: int, run, schema: str) -> DataFrame:
    """Every block of rows meets every group of anchors, a pair to a task; keys go through tasks as text, nulls kept."""
    left = left.withColumn("key", F.col("key").cast("string"))
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # both sides may come from one table
    dealt = lambda df, key, name, n, salt: df.withColumn(name, F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(n)).cast("int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = dealt(left, "row", "block", blocks, 1).withColumn("group", every(groups))
    right = dealt(right, right.columns[0], "group", groups, 2).withColumn("block", every(blocks))
    return left.groupBy("block", "group").cogroup(right.groupBy("block", "group")).applyInPandas(run, schema)


def hard_negatives(index: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
                   focus: int = FOCUS) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score`` and ``negative_score``.

    ``anchors`` are rows of ``index`` (from :func:`index_rows`). An anchor's
    positives are its best rows of the same label, itself left out; for each, the
    best rows of other labels whose score is between ``low`` and ``high`` percent
    of the positive's. Scores are exact inner products; ties go to the smaller
    key, null keys last; rows with equal keys count as different rows; shorter
    vectors end with zeros. A score that doesn't fit 64 bits is an error. No
    positive or no fitting negative gives no row, an empty index no rows.

    Blocks of rows meet groups of anchors, both cut by size, so a task holds one
    of each; at most ``positives`` and ``negatives`` rows per anchor and pair leave it.
    """
    wide, n = index.agg(F.coalesce(F.max(F.size("code")), F.lit(0)), F.count("*")).first()
    groups = max(1, -(-anchors.count() * wide // BLOCK_VALUES))
    per_block = max(1, BLOCK_VALUES // max(1, wide))
    tasks = index.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-n // per_block), min(-(-tasks // groups), n // SMALL_BLOCK))
    schema = "anchor_row bigint, anchor string, label bigint, code array<double>, row bigint, key string, score bigint"
    asked = anchors.select("row", F.col("key").cast("string").alias("key"), "label", "code")
    near = _met(index, asked, blocks, groups, _positives(positives, focus), schema)
    order = [F.desc("score"), F.col("key").cast("bigint").asc_nulls_last(), "row"]
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("anchor_row").orderBy(*order))).where(F.col("rank") <= positives)
    found = near.groupBy("anchor_row").agg(  # some positives to an anchor
        F.first("anchor").alias("anchor"), F.first("label").alias("label"), F.first("code").alias("code"),
        F.collect_list(F.struct("row", "key", "score")).alias("positives"))
    schema = ("anchor_row bigint, positive_row bigint, anchor string, positive string, positive_score bigint, row bigint, key string, "
              "score bigint")
    far = _met(index, cut_lineage(found, "positives"), blocks, groups, _negatives(negatives, focus, low, high), schema)
    ranked = far.withColumn("rank", F.row_number().over(Window.partitionBy("anchor_row", "positive_row").orderBy(*order)))
    return ranked.where(F.col("rank") <= negatives).select(
        F.col("anchor").cast("bigint").alias("anchor_id"), F.col("positive").cast("bigint").alias("positive_id"), "rank",
        F.col("key").cast("bigint").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
