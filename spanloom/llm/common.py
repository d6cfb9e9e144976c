"""Helpers shared by the operators: reading, held-out rows, and word hashing in numpy."""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that end a word: space and the controls 9 to 13.
SPACE_BYTES = (9, 10, 11, 12, 13, 32)
#: Bytes hashed at a time, so that the work arrays stay at a few megabytes.
PIECE = 1 << 20
#: Text bytes that a numpy step takes together.
CHUNK = 4 << 20


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def remainder(key, modulus: int) -> Column:
    """crc32 of the key as text, modulo a number; a null key counts as empty text."""
    column = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % modulus


def shipped(spark: SparkSession, value):
    """Broadcast of a value together with the code of its class; :func:`opened` gives it back in a task."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def opened(box):
    return pickle.loads(box.value)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def utf8(text) -> Column:
    """The text's bytes; null counts as empty."""
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(column, F.lit("")).cast("binary")


def finite(vector) -> Column:
    """Whether a vector has components, all of them numbers."""
    column = F.col(vector) if isinstance(vector, str) else vector
    numbers = F.forall(column, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return column.isNotNull() & (F.size(column) > 0) & numbers


def quantised(vector, scale: int = 256) -> Column:
    """floor(scale * x) of every component, as doubles: exact whole numbers however large."""
    def whole(x):
        large = x.cast("double") * scale  # from 2**53 on every double is whole
        return F.when(F.abs(large) < float(1 << 53), F.floor(large).cast("double")).otherwise(large)

    return F.transform(F.col(vector) if isinstance(vector, str) else vector, whole)


def by_key(frame: pd.DataFrame) -> tuple[pd.DataFrame, list]:
    """Rows by key (whole numbers as text, null last), then row number, and their keys as they came."""
    keys = frame["key"].tolist()
    number = [0 if k is None else int(k) for k in keys]
    order = np.lexsort((frame["row"].to_numpy(), number, [k is None for k in keys]))
    return frame.iloc[order], [keys[i] for i in order]


def chunks(texts, limit: int = CHUNK):
    """(first, last) index ranges of consecutive texts of about ``limit`` bytes; each range has one text at least."""
    start, total = 0, 0
    for i, text in enumerate(texts):
        if i > start and total + len(text) > limit:
            yield start, i
            start, total = i, 0
        total += len(text)
    if start < len(texts):
        yield start, len(texts)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int):
    """Powers of an odd number and of its inverse modulo 2**64, kept for the next call."""
    kept = _powers.__dict__
    if len(kept.get("up", ())) < n:
        base = 0x9E3779B97F4A7C15
        inverse = pow(base, -1, 1 << 64)
        for name, number in (("up", base), ("down", inverse)):
            steps = np.full(n, number, np.uint64)
            steps[0] = 1
            kept[name] = np.cumprod(steps, dtype=np.uint64)
        kept["bytes"] = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
    return kept["up"], kept["down"], kept["bytes"]


def space_table() -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(SPACE_BYTES)] = True
    return table


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word of the texts, and each text's number of words."""
    joined = b"\n".join(texts)
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    data = np.frombuffer(joined, np.uint8)
    space = space_table()[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    hashes = np.empty(len(starts), np.uint64)
    done = 0
    while done < len(starts):
        base = starts[done]
        last = max(done + 1, int(np.searchsorted(ends, base + PIECE, "right")))
        piece = data[base:ends[last - 1]]
        up, down, codes = _powers(len(piece) + 1)
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(codes[piece] * up[: len(piece)], out=sums[1:])
        a, b = starts[done:last] - base, ends[done:last] - base
        hashes[done:last] = mixed((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        done = last
    offsets = np.concatenate(([0], np.cumsum(lengths + 1)))
    return hashes, np.diff(np.searchsorted(starts, offsets))


def grams(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` hashes."""
    if len(hashes) < width:
        return np.empty(0, np.uint64)
    total = np.zeros(len(hashes) - width + 1, np.uint64)
    for k in range(width):
        total = total * np.uint64(0x9FB21C651E98DF25) + hashes[k: k + len(total)]
    return mixed(total)
