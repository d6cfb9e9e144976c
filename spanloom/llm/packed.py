"""Blocks of documents that look hashed keys up in shards of all keys.

Rows of one block of documents are tokenised together; their distinct keys,
sorted 64-bit hashes, go to shards by the range of the hash, a few packed arrays
instead of a row per key. A shard without a key of the block gets nothing, so
there are never more messages than keys, however many blocks and shards. A shard sees all blocks' keys of its range and answers
with a number per key in the order sent, so that the block needs no keys back.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 8 << 20
#: Blocks of text for which there is one shard of keys.
BLOCKS_PER_SHARD = 2


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted distinct 64-bit keys; six bytes each where the steps between them fit, eight if not."""
    if not len(keys):
        return b""
    steps = np.diff(keys)
    if len(steps) and int(steps.max()) >> 48:
        return b"\x08" + keys.tobytes()
    return b"\x06" + keys[:1].tobytes() + steps.astype(np.uint32).tobytes() + (steps >> np.uint64(32)).astype(np.uint16).tobytes()


def unpack_keys(data) -> np.ndarray:
    data = bytes(data)
    if not data:
        return np.empty(0, np.uint64)
    if data[0] == 8:
        return np.frombuffer(data[1:], np.uint64)
    n = (len(data) - 9) // 6
    low = np.frombuffer(data, np.uint32, n, 9).astype(np.uint64)
    high = np.frombuffer(data, np.uint16, n, 9 + 4 * n).astype(np.uint64)
    keys = np.empty(n + 1, np.uint64)
    keys[0] = np.frombuffer(data, np.uint64, 1, 1)[0]
    keys[1:] = low | (high << np.uint64(32))
    return np.cumsum(keys, dtype=np.uint64)


def pack_numbers(values: np.ndarray) -> bytes:
    """Whole numbers from 0, mostly small."""
    return zlib.compress(np.ascontiguousarray(values, np.int64).tobytes(), 1)


def unpack_numbers(data) -> np.ndarray:
    return np.frombuffer(zlib.decompress(bytes(data)), np.int64)


def shard_slices(keys: np.ndarray, shards: int):
    """(shard, slice) over sorted keys, for every shard."""
    edges = np.array([(s << 64) // shards for s in range(1, shards)], np.uint64)
    at = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
    return [(s, slice(at[s], at[s + 1])) for s in range(shards)]


def text_bytes(df: DataFrame, text: str) -> int:
    return df.agg(F.sum(F.octet_length(text).cast("bigint"))).first()[0] or 0


def number_of_blocks(total: int, block_bytes: int = BLOCK_BYTES) -> tuple[int, int]:
    """Blocks and shards for so many bytes of text."""
    blocks = max(1, -(-total // block_bytes))
    return blocks, max(1, -(-blocks // BLOCKS_PER_SHARD))


def dealt(df: DataFrame, block: Column, blocks: int) -> DataFrame:
    """Rows with their ``block``, moved once; later steps by block use this exchange again."""
    return df.withColumn("block", block.cast("int")).repartition(blocks, "block")
