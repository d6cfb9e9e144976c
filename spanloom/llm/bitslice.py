"""Exact top-k inner products on a bit-sliced index.

A block of candidate rows keeps its integer components as slices: bitmap b of
component d has the rows whose shifted component has bit b set. An inner product
with a query is a sum of slices, one for every set bit of every query component,
added with carry-save adders over whole bitmaps; a negative component adds the
complement. The sum is again a stack of slices, and the best rows are picked
from the most significant slice downward; rows that tie at the border are
resolved by their order, so the result is exact.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.llm.common import by_key, finite, quantised
from spanloom.session import cut_lineage

BLOCK = 8192
QUERIES = 512
#: Components below this are kept as 64-bit numbers, in a block with larger ones all as numbers of any size.
SMALL = float(1 << 61)


def index_rows(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``row`` (its own number), ``key`` and ``code`` (floor(256 * x), as doubles) of the rows that can take part.

    Null and empty vectors and those with a null or non-finite component are
    left out; a finite component may have any size, and a key may be null.
    """
    usable = df.select(F.col(key).cast("bigint").alias("key"), F.col(vector).alias("x")).where(finite("x"))
    return usable.select(F.monotonically_increasing_id().alias("row"), "key", quantised("x").alias("code"))


def bitmaps(values: np.ndarray, bits: int) -> np.ndarray:
    """Slice b of one component: rows as bits of 64-bit words."""
    rows = -(-len(values) // 64) * 64
    planes = np.zeros((bits, rows), np.uint8)
    planes[:, : len(values)] = (values[None, :] >> np.arange(bits).astype(values.dtype)[:, None]) & 1
    return np.packbits(planes, axis=1, bitorder="little").view(np.uint64)


class SlicedBlock:
    """Slices of up to BLOCK candidate rows, which must be sorted by the order of ties."""

    def __init__(self, codes: np.ndarray):
        self.rows = len(codes)
        self.low = codes.min(axis=0)
        self.span = codes.max(axis=0) - self.low
        self.slices = [bitmaps(codes[:, d] - self.low[d], max(1, int(self.span[d]).bit_length())) for d in range(codes.shape[1])]
        every = np.zeros(self.slices[0].shape[1] * 64, np.uint8)
        every[: self.rows] = 1
        self.every = np.packbits(every, bitorder="little").view(np.uint64)

    def product(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of a number per row, and what to add to it for the inner product."""
        columns: dict[int, list[np.ndarray]] = {}
        rest = 0
        for d in np.flatnonzero(query[: len(self.slices)]):
            q, slices = int(query[d]), self.slices[d]
            rest += q * int(self.low[d])
            if q < 0:  # q * v = |q| * (top - v) - |q| * top, and top - v has the complement of each bit
                slices = ~slices
                rest += q * ((1 << len(slices)) - 1)
            size = abs(q)
            for shift in range(size.bit_length()):
                if size >> shift & 1:
                    for b in range(len(slices)):
                        columns.setdefault(b + shift, []).append(slices[b])
        sums, place = [], 0
        while place in columns or any(p > place for p in columns):
            stack = np.array(columns.pop(place, [])).reshape(-1, len(self.every))
            carry = []
            while len(stack) > 2:  # full adders turn three slices into one here and one a place higher
                third = len(stack) // 3
                a, b, c = stack[:third], stack[third: 2 * third], stack[2 * third: 3 * third]
                half = a ^ b
                carry.extend((a & b) | (half & c))
                stack = np.concatenate([half ^ c, stack[3 * third:]])
            if len(stack) == 2:
                carry.append(stack[0] & stack[1])
                stack = stack[:1] ^ stack[1:]
            sums.append(stack[0] if len(stack) else np.zeros_like(self.every))
            if carry:
                columns.setdefault(place + 1, []).extend(carry)
            place += 1
        return sums, rest

    def best(self, query: np.ndarray, k: int, left_out: int | None = None) -> list[tuple[int, int]]:
        """(row, inner product) of the k best rows; ties go to the earlier row."""
        sums, rest = self.product(query)
        sure, even = np.zeros_like(self.every), self.every.copy()
        if left_out is not None:
            even[left_out // 64] &= ~np.uint64(1 << (left_out % 64))
        for plane in reversed(sums):
            larger = sure | (even & plane)
            n = int(np.bitwise_count(larger).sum())
            if n > k:
                even &= plane
            else:
                sure = larger
                even &= ~plane
                if n == k:
                    break
        rows = self._rows(sure)
        rows += self._rows(even)[: k - len(rows)] if len(rows) < k else []
        scores = [rest + sum(int(s[r // 64] >> np.uint64(r % 64) & np.uint64(1)) << i for i, s in enumerate(sums)) for r in rows]
        return list(zip(rows, scores, strict=True))

    @staticmethod
    def _rows(bitmap: np.ndarray) -> list[int]:
        words = np.flatnonzero(bitmap)
        bits = np.unpackbits(bitmap[words].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        at, place = np.nonzero(bits)
        return (words[at] * 64 + place).tolist()


def _whole(codes: np.ndarray) -> np.ndarray:
    """Doubles without fraction as integers."""
    if not codes.size or np.abs(codes).max() < SMALL:
        return codes.astype(np.int64)
    return np.array([[int(x) for x in row] for row in codes.tolist()], object)


def _matrix(codes) -> np.ndarray:
    """Rows of equal length; a shorter vector ends with zeros."""
    width = max(map(len, codes))
    out = np.zeros((len(codes), width))
    for i, c in enumerate(codes):
        out[i, : len(c)] = c
    return _whole(out)


def _search(k: int):
    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            left, keys = by_key(left)
            rows = left["row"].to_numpy()
            own = {r: i for i, r in enumerate(rows)}
            block = SlicedBlock(_matrix(left["code"].tolist()))
            for row, query_key, code in zip(right["row"], right["key"], right["code"], strict=True):
                for at, score in block.best(_whole(np.asarray(code)[None, :])[0], k, own.get(row)):
                    out.append((row, query_key, rows[at], keys[at], score))
        return pd.DataFrame(out, columns=["query_row", "query_id", "row", "vec_id", "score"])

    return run


def top_k(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query_id``, ``rank`` from 1, ``vec_id`` and ``score`` of the k best rows of ``index`` for each query, its own row left out.

    Both sides come from :func:`index_rows` of one written table. Blocks of rows
    and blocks of queries meet in pairs, so a task holds one block of each; at
    most k rows per query leave it. Ties go to the smaller key, null last; rows
    with equal keys count as different rows. A shorter vector counts as ending in
    zeros. Fewer than k rows are all given, an empty index or no query gives no
    rows, and a score that 64 bits cannot hold is an error.
    """
    index = index.withColumn("key", F.col("key").cast("string"))  # nulls pass through tasks as text
    queries = queries.select(F.col("row").alias("row"), F.col("key").cast("string").alias("key"), F.col("code").alias("code"))
    rows, asked = index.count(), queries.count()
    blocks, groups = max(1, -(-rows // BLOCK)), max(1, -(-asked // QUERIES))
    dealt = lambda df, name, n, salt: df.withColumn(name, F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(n)).cast("int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = dealt(index, "block", blocks, 1).withColumn("group", every(groups))
    right = dealt(queries, "group", groups, 2).withColumn("block", every(blocks))
    schema = "query_row bigint, query_id string, row bigint, vec_id string, score bigint"
    found = left.groupBy("block", "group").cogroup(right.groupBy("block", "group")).applyInPandas(_search(k), schema)
    order = Window.partitionBy("query_row", "query_id").orderBy(F.desc("score"), F.col("vec_id").cast("bigint").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        F.col("query_id").cast("bigint").alias("query_id"), "rank", F.col("vec_id").cast("bigint").alias("vec_id"), "score")


def written_index(df: DataFrame, key: str, vector: str) -> DataFrame:
    """The index rows, written once so that both sides of a search see the same row numbers."""
    return cut_lineage(index_rows(df, key, vector), "sliced")
