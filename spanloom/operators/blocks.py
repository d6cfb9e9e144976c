"""Best-k search of every left row among the right rows, block by block.

The caller gives a scoring kernel that maps two small batches to a score
matrix. Only the best k per left row (and per right group) leave a task, so
pairs are never written out.

* A right side of at most ``broadcast_rows`` rows and ``BROADCAST_BYTES`` bytes
  (both counted first) is shipped to the tasks once and the left side streams past it, unshuffled.
* A larger one is written once and cut into blocks of at most about BLOCK_BYTES; left
  chunks meet right blocks in co-grouped tasks of bounded size, and a ranked
  window merges the k best of each block. Every block means a copy of the left
  rows and k results for each, so blocks asked smaller than a COPIES-th of the
  table are put together. Blocks are cut by row id, so copies of one
  vector or name spread over all of them.
* Vectors are multiplied in pieces of PIECE right rows. Once a left row has k
  matches, only scores that reach its k-th best are looked at.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.operators.ordering import BUCKETS, top_k, totals_before
from spanloom.session import cut_lineage

LOG = logging.getLogger("spanloom.blocks")

BROADCAST_ROWS = 20_000
BROADCAST_BYTES = 128 << 20
BLOCK_BYTES = 64 << 20
LEAST_BLOCK, MOST_BLOCK = 1_024, 131_072
#: Left rows that meet a block at a time; right rows of a group search's task.
CHUNK_ROWS = 65_536
#: Blocks up to which a table is cut as finely as asked.
COPIES = 4
#: Tasks that the pairs of a block and a chunk are dealt to, so that few of them share one.
MOST_TASKS = 2_000
#: Right rows multiplied at a time.
PIECE = 2_048
CELLS = 4 << 20  # scores computed at a time
SELF_ROWS = 256
SCALE = 10**9  # scores are ranked and returned rounded to 9 decimals
MISSING = np.iinfo(np.int64).min

Kernel = Callable[[pd.Series, object], np.ndarray]


def best_columns(scores: np.ndarray, blocked: np.ndarray, k: int, floor: float | None):
    """Column numbers of each row's k best scores, best first, lower column wins a tie.

    Score and column are packed into one integer, so the order is total and
    does not depend on how the rows were batched.
    """
    rounded = np.rint(scores * SCALE).astype(np.int64)
    if scores.size and np.abs(rounded).max() > 2 * SCALE:  # too large to be packed with a column
        return _best_unpacked(rounded, blocked, k, floor)
    packed = rounded * 2**32 - np.arange(scores.shape[1], dtype=np.int64)
    packed[blocked] = MISSING
    if floor is not None:
        packed[rounded <= int(np.rint(floor * SCALE))] = MISSING
    k = min(k, scores.shape[1])
    if k < scores.shape[1]:
        nearest = np.argpartition(~packed, k - 1, axis=1)[:, :k]
    else:
        nearest = np.tile(np.arange(scores.shape[1]), (scores.shape[0], 1))
    values = np.take_along_axis(packed, nearest, axis=1)
    order = np.argsort(~values, axis=1, kind="stable")
    columns = np.take_along_axis(nearest, order, axis=1)
    values = np.take_along_axis(values, order, axis=1)
    return columns, np.take_along_axis(rounded, columns, axis=1) / SCALE, values != MISSING


def _best_unpacked(rounded: np.ndarray, blocked: np.ndarray, k: int, floor: float | None):
    out = blocked.copy()
    if floor is not None:
        out |= rounded <= int(np.rint(floor * SCALE))
    columns = np.lexsort((-rounded, out), axis=1)[:, :k]  # stable: the lower column wins a tie
    return columns, np.take_along_axis(rounded, columns, axis=1) / SCALE, ~np.take_along_axis(out, columns, axis=1)


def nothing(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    none = np.array([], dtype=np.int64)
    return pd.DataFrame({
        "left_id": left["left_id"].iloc[:0].to_numpy(),
        "right_group": right["right_group"].iloc[:0].to_numpy(),
        "right_id": right["right_id"].iloc[:0].to_numpy(),
        "score": none.astype("float64"),
        "rank": none.astype("int32"),
    })


class RightSide:
    """Right rows of one task, sorted by (group, id), or by (cell, id), with what the kernel prepared."""

    def __init__(self, rows: pd.DataFrame, prepare):
        rows = rows.sort_values(["right_group", "right_id"], kind="stable").reset_index(drop=True)
        self.place = np.arange(len(rows))  # in the order of ids, which breaks ties
        cells = np.zeros(len(rows), np.int64)
        if "cell" in rows.columns:
            rows = rows.sort_values("cell", kind="stable")
            self.place, cells = rows.index.to_numpy(), rows["cell"].to_numpy()
        self.ids = rows["right_id"].to_numpy()
        groups = rows["right_group"].to_numpy()
        self.group_type = groups.dtype
        starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if len(groups) else []
        self.slices = [(groups[a], a, b) for a, b in zip(starts, [*starts[1:], len(groups)])]
        self.prepare, self.data = prepare, prepare(rows["right_value"])
        edges = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1], True]) if len(cells) else []
        self.runs = [(a, b, cells[a]) for a, b in zip(edges[:-1], edges[1:])]

    def pieces(self, first: int, last: int):
        """(start, end, cell) of at most PIECE rows of one cell."""
        for a, b, cell in self.runs:
            for start in range(max(a, first), min(b, last), PIECE):
                yield start, min(start + PIECE, b, last), cell


class Best:
    """The k best columns found so far for each row; ties go to the column whose id comes first."""

    def __init__(self, rows: int, k: int, floor: float | None, right: RightSide):
        self.k, self.floor, self.right = k, floor, right
        self.lowest = None if floor is None else int(np.rint(floor * SCALE))
        # scores are rounded: one step below may still round to the bound
        self.least = np.full(rows, -np.inf if floor is None else (self.lowest - 1) / SCALE)
        self.kept = (np.empty(0, np.int64),) * 3
        self.waiting, self.count = [], 0

    def add(self, scores: np.ndarray, rows: np.ndarray, first: int, left_ids: np.ndarray | None) -> None:
        """Scores of some rows with the columns from ``first`` on; ``left_ids`` are not matched with their own."""
        ids = self.right.ids[first:first + scores.shape[1]]
        reach = ~(scores < self.least[rows][:, None])
        if np.count_nonzero(reach) > scores.size // 8 and scores.shape[1] > self.k:
            blocked = np.zeros(scores.shape, bool)
            if left_ids is not None:
                at = np.searchsorted(ids, left_ids)
                hit = np.flatnonzero(at < len(ids))
                hit = hit[ids[at[hit]] == left_ids[hit]]
                blocked[hit, at[hit]] = True
            columns, values, found = best_columns(scores, blocked, self.k, self.floor)
            row, place = np.nonzero(found)
            column, value = columns[row, place], np.rint(values[row, place] * SCALE).astype(np.int64)
        else:
            row, column = np.nonzero(reach)
            value = np.rint(scores[row, column] * SCALE).astype(np.int64)
            keep = np.ones(len(row), bool) if self.lowest is None else value > self.lowest
            if left_ids is not None:
                keep &= ids[column] != left_ids[row]
            row, column, value = row[keep], column[keep], value[keep]
        self.waiting.append((rows[row], first + column, value))
        self.count += len(row)
        if self.count >= self.k * len(self.least):
            self._merge()

    def _merge(self) -> None:
        row, column, value = (np.concatenate(x) for x in zip(self.kept, *self.waiting))
        ranked = np.where(value == MISSING, 0, value)  # as best_columns ranks scores that are no numbers
        order = np.lexsort((self.right.place[column], -ranked, row))
        row, column, value, ranked = row[order], column[order], value[order], ranked[order]
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.empty(0, np.int64)
        rank = np.arange(len(row)) - np.repeat(starts, np.diff(np.append(starts, len(row))))
        last, keep = rank == self.k - 1, rank < self.k
        self.least[row[last]] = (ranked[last] - 1) / SCALE
        self.kept, self.rank = (row[keep], column[keep], value[keep]), rank[keep]
        self.waiting, self.count = [], 0

    def found(self):
        """Row, column, score and rank from 0, row by row."""
        self._merge()
        row, column, value = self.kept
        return row, column, value / SCALE, self.rank


def search(left: pd.DataFrame, right: RightSide, kernel: Kernel, k: int, floor, skip_same: bool,
           left_rows: int = 1024) -> Iterator[pd.DataFrame]:
    pieces = isinstance(right.data, np.ndarray)
    left_rows = left_rows if pieces else max(16, min(left_rows, CELLS // max(1, len(right.ids))))
    for start in range(0, len(left), left_rows):
        part = left.iloc[start:start + left_rows]
        left_ids = part["left_id"].to_numpy()
        found_in = []
        for group, row, column, value, place in (_in_pieces if pieces else _at_once)(part, right, kernel, k, floor, skip_same, left_ids):
            found_in.append((row, np.full(len(row), group, dtype=right.group_type), column, value, place))
        if found_in:
            row, group, column, value, place = (np.concatenate(x) for x in zip(*found_in))
            yield pd.DataFrame({
                "left_id": left_ids[row], "right_group": group, "right_id": right.ids[column], "score": value,
                "rank": (place + 1).astype("int32"),
            })


def _in_pieces(part: pd.DataFrame, right: RightSide, kernel: Kernel, k: int, floor, skip_same: bool, left_ids: np.ndarray):
    """Vectors piece by piece; a row with ``met`` meets only the cells whose bits are set."""
    vectors, every = right.prepare(part["left_value"]), np.arange(len(part))
    met = None
    if "met" in part.columns:
        met = np.unpackbits(np.frombuffer(b"".join(part["met"]), np.uint8).reshape(len(part), -1), axis=1).astype(bool)
    for group, a, b in right.slices:
        best = Best(len(part), k, floor, right)
        for first, last, cell in right.pieces(a, b):
            rows = every if met is None else np.flatnonzero(met[:, cell])
            if len(rows):
                some = vectors if len(rows) == len(vectors) else vectors[rows]
                best.add(kernel(some, right.data[first:last]), rows, first, left_ids[rows] if skip_same else None)
        yield group, *best.found()


def _at_once(part: pd.DataFrame, right: RightSide, kernel: Kernel, k: int, floor, skip_same: bool, left_ids: np.ndarray):
    scores = kernel(part["left_value"], right.data)
    for group, a, b in right.slices:
        blocked = np.zeros((len(part), b - a), dtype=bool)
        if skip_same:
            at = np.searchsorted(right.ids[a:b], left_ids)
            hit = np.flatnonzero(at < b - a)
            hit = hit[right.ids[a:b][at[hit]] == left_ids[hit]]
            blocked[hit, at[hit]] = True
        columns, values, found = best_columns(scores[:, a:b], blocked, k, floor)
        row, place = np.nonzero(found)
        yield group, row, a + columns[row, place], values[row, place], place


def best_matches(
    left: DataFrame,
    right: DataFrame,
    k: int,
    kernel: Kernel,
    prepare,
    floor: float | None = None,
    skip_same: bool = False,
    broadcast_rows: int = BROADCAST_ROWS,
    block_rows: int | None = None,
    probes=None,
    spread_left: bool = False,
) -> DataFrame:
    """(left_id, right_group, right_id, score, rank) for the k best per left row and group.

    ``left`` has (left_id, left_value), ``right`` has (right_group, right_id,
    right_value); ids are unique on their side, a repeated right id
    is an error. Scores not above ``floor`` are
    dropped. Ties go to the smaller right id. ``spread_left`` deals the left
    rows out evenly first; use it for kernels that cost far more than their
    input's bytes suggest.
    """
    spark = left.sparkSession
    schema = T.StructType([
        T.StructField("left_id", left.schema["left_id"].dataType),
        T.StructField("right_group", right.schema["right_group"].dataType),
        T.StructField("right_id", right.schema["right_id"].dataType),
        T.StructField("score", T.DoubleType()),
        T.StructField("rank", T.IntegerType()),
    ])
    rows, size, ids = measure(right)
    if ids != rows:
        raise ValueError(f"{rows - ids} right ids are repeated or null")
    small_enough = rows <= broadcast_rows and size <= BROADCAST_BYTES
    LOG.info("right side of %d rows, %d bytes: %s", rows, size, "broadcast" if small_enough else "blocked")
    if small_enough:
        small = right.toArrow().to_pandas()
        if skip_same:  # the left side is as small as the right one: give every core a share
            left = left.repartition(max(1, math.ceil(rows / SELF_ROWS)), "left_id")
        elif spread_left:
            shares = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
            left = left.repartition(shares, "left_id")
        shipped = spark.sparkContext.broadcast(small)

        def stream(batches):
            side = RightSide(shipped.value, prepare)
            for batch in batches:
                yield from search(batch, side, kernel, k, floor, skip_same)

        return left.select("left_id", "left_value").mapInPandas(stream, schema)

    right = cut_lineage(right, "right")
    fit = max(LEAST_BLOCK, min(MOST_BLOCK, BLOCK_BYTES * rows // max(1, size)))
    cell_rows = block_rows or fit
    block_rows = max(block_rows or LEAST_BLOCK, min(fit, math.ceil(rows / COPIES)))

    def meet(left_blocks: DataFrame, right_blocks: DataFrame) -> DataFrame:
        """The best k of each left row in the blocks it meets."""
        chunks = max(1, math.ceil(left.count() / max(LEAST_BLOCK, min(block_rows, CHUNK_ROWS))))
        tasks = min(MOST_TASKS, 2 * chunks * math.ceil(rows / block_rows))
        left_part = left_blocks.withColumn("chunk", F.pmod(F.xxhash64("left_id"), F.lit(chunks)).cast("int"))
        right_part = right_blocks.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

        def pair(left_rows, right_rows):
            if len(left_rows) == 0 or len(right_rows) == 0:
                return nothing(left_rows, right_rows)
            side = RightSide(right_rows, prepare)
            found = list(search(left_rows, side, kernel, k, floor, skip_same))
            return pd.concat(found, ignore_index=True) if found else nothing(left_rows, right_rows)

        met = (
            left_part.repartition(tasks, "block", "chunk").groupBy("block", "chunk")
            .cogroup(right_part.repartition(tasks, "block", "chunk").groupBy("block", "chunk"))
            .applyInPandas(pair, schema)
            .drop("rank")
        )
        return top_k(met, ["left_id", "right_group"], [F.desc("score"), "right_id"], k)

    if probes is None:
        return meet(*hash_blocks(left, right, block_rows, rows))
    found = probes(left, right, cell_rows, block_rows, rows, meet)
    return found if "rank" in found.columns else top_k(found, ["left_id", "right_group"], [F.desc("score"), "right_id"], k)


def matches_in_groups(
    left: DataFrame,
    right: DataFrame,
    k: int,
    kernel: Kernel,
    prepare,
    floor: float | None = None,
    skip_same: bool = False,
    broadcast_rows: int = BROADCAST_ROWS,
    block_rows: int | None = None,
) -> DataFrame:
    """Like :func:`best_matches` for left rows that ask for one group each: (left_id, right_group) pairs are unique.

    A pair meets the right rows of its own group only. A group larger than a
    block is cut into parts by row id; groups are laid end to end and cut into
    buckets, so a task holds at most about two blocks.
    """
    spark = left.sparkSession
    schema = T.StructType([
        T.StructField("left_id", left.schema["left_id"].dataType),
        T.StructField("right_group", right.schema["right_group"].dataType),
        T.StructField("right_id", right.schema["right_id"].dataType),
        T.StructField("score", T.DoubleType()),
        T.StructField("rank", T.IntegerType()),
    ])
    rows, size, ids = measure(right)
    if ids != rows:
        raise ValueError(f"{rows - ids} right ids are repeated or null")

    def of_groups(asked: pd.DataFrame, sides: dict, keys: list[str]):
        for group, some in asked.groupby(keys, sort=False):
            if group in sides:
                yield from search(some, sides[group], kernel, k, floor, skip_same)

    def prepared(frame: pd.DataFrame, keys: list[str]) -> dict:
        return {group: RightSide(some, prepare) for group, some in frame.groupby(keys, sort=False)}

    if rows <= broadcast_rows and size <= BROADCAST_BYTES:
        shipped = spark.sparkContext.broadcast(right.toArrow().to_pandas())

        def stream(batches):
            sides = prepared(shipped.value, ["right_group"])
            for batch in batches:
                yield from of_groups(batch, sides, ["right_group"])

        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
        return left.select("left_id", "left_value", "right_group").repartition(tasks, "left_id", "right_group").mapInPandas(stream, schema)

    right = cut_lineage(right, "right")
    block_rows = block_rows or max(LEAST_BLOCK, min(CHUNK_ROWS, BLOCK_BYTES // 2 * rows // max(1, size)))
    left = cut_lineage(left.select("left_id", "left_value", "right_group"), "asked")
    chunks = max(1, math.ceil(left.count() / max(LEAST_BLOCK, min(block_rows, CHUNK_ROWS // 2))))
    tasks = min(MOST_TASKS, 2 * chunks * math.ceil(rows / block_rows))
    sizes, bucket = cut_lineage(group_parts(right, block_rows), "groups"), part_bucket(block_rows)
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left_part = left.join(sizes, "right_group").withColumn("part", every(F.col("parts"))).withColumn("bucket", bucket).withColumn(
        "chunk", F.pmod(F.xxhash64("left_id"), F.lit(chunks)).cast("int"))
    right_part = right.join(sizes, "right_group").withColumn("part", F.pmod(F.xxhash64("right_id"), F.col("parts")).cast("int")).withColumn(
        "bucket", bucket).withColumn("chunk", every(F.lit(chunks)))

    def pair(left_rows, right_rows):
        keys = ["right_group", "part"]
        found = list(of_groups(left_rows, prepared(right_rows, keys), keys)) if len(left_rows) and len(right_rows) else []
        return pd.concat(found, ignore_index=True) if found else nothing(left_rows, right_rows)

    met = (
        left_part.drop("parts", "before", "n").repartition(tasks, "bucket", "chunk").groupBy("bucket", "chunk")
        .cogroup(right_part.drop("parts", "before", "n").repartition(tasks, "bucket", "chunk").groupBy("bucket", "chunk"))
        .applyInPandas(pair, schema)
        .drop("rank")
    )
    return top_k(met, ["left_id", "right_group"], [F.desc("score"), "right_id"], k)


def group_parts(right: DataFrame, block_rows: int) -> DataFrame:
    """(right_group, before, n, parts): rows of every group, rows of the groups before it, and parts of at most about a block."""
    counted = right.groupBy("right_group").agg(F.count("*").alias("n")).withColumn(
        "spot", F.pmod(F.xxhash64("right_group"), F.lit(BUCKETS)).cast("int"))
    return totals_before(counted, "spot", ["right_group"], {"before": F.col("n")}).select(
        "right_group", "before", "n", F.ceil(F.col("n") / F.lit(block_rows)).cast("int").alias("parts"))


def part_bucket(block_rows: int) -> Column:
    """The bucket of a group's ``part``: where its rows start, with all groups laid end to end."""
    return F.floor((F.col("before") + F.floor(F.col("n") * F.col("part") / F.col("parts"))) / F.lit(block_rows)).cast("int")


def measure(right: DataFrame) -> tuple[int, int, int]:
    """Rows, payload bytes and distinct ids (per group) of the right side, in one pass."""
    vector = isinstance(right.schema["right_value"].dataType, T.ArrayType)
    payload = F.size("right_value") * 8 if vector else F.octet_length("right_value")
    per_id = right.where(F.col("right_id").isNotNull()).groupBy("right_group", "right_id").agg(
        F.count("*").alias("n"), F.sum(payload.cast("bigint")).alias("bytes"))
    found = per_id.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count("*").alias("ids")).first()
    return found["n"], found["bytes"], found["ids"]


def hash_blocks(left: DataFrame, right: DataFrame, block_rows: int, rows: int):
    """Every left row meets every right block."""
    blocks = max(1, math.ceil(rows / block_rows))
    right_blocks = right.withColumn("block", F.pmod(F.xxhash64("right_id"), F.lit(blocks)).cast("string"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<string>"))
    return left.withColumn("block", every), right_blocks
