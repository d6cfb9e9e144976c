"""Quality classifier: ridge regression on random Fourier features of document statistics, with isotonic calibration.

Statistics are standardised; cosines of random projections approximate a
Gaussian kernel on them. Every task sums the normal equations of its rows, the
sums are added up and solved on the driver (their size doesn't depend on the
data). Two half models score the labelled rows that they haven't seen, and the
share of good rows over those scores, made monotone, turns a score into a
probability.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.common import opened, remainder, shipped, utf8

FEATURES = 256
RIDGE = 1.0
BINS = 3000
LOW, HIGH = -1.0, 2.0
STATISTICS = 22


def statistics(text: bytes) -> list[float]:
    """Shape of a text: sizes, character classes, repetition of words and lines."""
    n = len(text)
    words = text.split()
    if not words:
        return [float(np.log1p(n))] + [0.0] * (STATISTICS - 1)
    count = len(words)
    classes = text.translate(_CLASSES)
    lower, upper, digit, space = (classes.count(c) for c in (b"a", b"A", b"0", b" "))
    stop, loud, other, high = (classes.count(c) for c in (b".", b"!", b"#", b"z"))
    letters = lower + upper + high
    tally = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    marked = classes.count(b"# ") + classes.count(b"! ") + classes.endswith((b"#", b"!"))
    twice = sum(map(bytes.__eq__, words, words[1:]))
    packed = len(zlib.compress(text, 1))
    return [
        float(np.log1p(n)), float(np.log1p(count)), (n - space) / count, letters / n, upper / max(letters, 1), digit / n,
        space / n, stop / count, loud / count, other / count, marked / count, high / n,
        len(tally) / count ** 0.9, max(tally.values()) / count, twice / count, sum(1 for v in tally.values() if v == 1) / len(tally),
        float(np.log1p(len(lines))), len(set(lines)) / len(lines), sum(x.rstrip().endswith(_ENDS) for x in lines) / len(lines),
        packed / n, float(np.log1p(max(map(len, tally)))), sum(v for w, v in tally.items() if len(w) == 1) / count,
    ]


_ENDS = (b".", b"!", b"?", b":", b";")


def _class_table() -> bytes:
    table = bytearray(b"#" * 256)
    for b in range(256):
        c = chr(b)
        for mark, members in (("a", "abcdefghijklmnopqrstuvwxyz"), ("A", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("0", "0123456789"),
                              (" ", " \t\n\r\v\f"), (".", ".,;:?'\"()-"), ("!", "!")):
            if c in members:
                table[b] = ord(mark)
        if b >= 0x80:
            table[b] = ord("z")
    return bytes(table)


_CLASSES = _class_table()


def _measure(batches):
    for rows in batches:
        yield rows.drop(columns="text").assign(stats=[statistics(bytes(t)) for t in rows["text"]])


def measured(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key`` and ``stats``; a null text counts as empty, whose statistics are zeros."""
    given = df.select(F.col(key), utf8(text).alias("text"))
    schema = T.StructType([given.schema[key], T.StructField("stats", T.ArrayType(T.DoubleType()))])
    return given.mapInPandas(_measure, schema)


class Fourier:
    """Standardised statistics to cosines; the random directions depend on the seed only."""

    def __init__(self, mean, scale, features: int = FEATURES, seed: int = 5):
        self.mean, self.scale = np.asarray(mean), np.asarray(scale)
        random = np.random.default_rng(seed)
        self.directions = random.normal(0, 1 / np.sqrt(len(self.mean)), (len(self.mean), features))
        self.phases = random.uniform(0, 2 * np.pi, features)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -5, 5)
        z = np.cos(x @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.column_stack([np.ones(len(z)), z])


def _stacked(column) -> np.ndarray:
    return np.stack([np.asarray(s, float) for s in column])


def _equations(fourier):
    def run(batches):
        sums = {}
        for rows in batches:
            z, y, fold = fourier(_stacked(rows["stats"])), rows["label"].to_numpy(float), rows["fold"].to_numpy()
            for f in (0, 1):
                at = fold == f
                if at.any():
                    old = sums.get(f, (0.0, 0.0))
                    sums[f] = (old[0] + z[at].T @ z[at], old[1] + z[at].T @ y[at])
        for f, (square, right) in sums.items():
            values = np.concatenate([square[np.triu_indices(len(square))], right])
            yield pd.DataFrame({"fold": f, "place": np.arange(len(values)), "value": values})

    return run


def _solved(values: np.ndarray, width: int) -> np.ndarray:
    square = np.zeros((width, width))
    upper = np.triu_indices(width)
    square[upper] = values[: len(upper[0])]
    square = square + square.T - np.diag(np.diag(square))
    penalty = RIDGE * np.eye(width)
    penalty[0, 0] = 1e-6  # the intercept is free
    return np.linalg.solve(square + penalty, values[len(upper[0]):])


def isotonic(values, weights) -> np.ndarray:
    """Weighted non-decreasing fit by pooling neighbours that are out of order."""
    pools = []  # mean, weight, entries
    for v, w in zip(values, weights, strict=True):
        pools.append([v, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            b, a = pools.pop(), pools.pop()
            pools.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.concatenate([np.full(n, v) for v, _, n in pools]) if pools else np.empty(0)


def _raw(fourier, halves):
    def run(batches):
        for rows in batches:
            z, fold = fourier(_stacked(rows["stats"])), rows["fold"].to_numpy()
            raw = np.where(fold == 0, z @ halves[1], z @ halves[0])
            bins = np.floor((np.clip(raw, LOW, HIGH) - LOW) / (HIGH - LOW) * (BINS - 1)).astype(int)
            yield pd.DataFrame({"bin": bins, "label": rows["label"].to_numpy(float)})

    return run


class QualityModel:
    """Weights of the features and the calibration curve; without labels every score is 0.5."""

    def __init__(self, fourier=None, weights=None, centres=(), levels=()):
        self.fourier, self.weights, self.centres, self.levels = fourier, weights, np.asarray(centres), np.asarray(levels)

    def scores(self, stats: np.ndarray) -> np.ndarray:
        if self.fourier is None:
            return np.full(len(stats), 0.5)
        raw = np.clip(self.fourier(stats) @ self.weights, LOW, HIGH)
        return np.clip(np.interp(raw, self.centres, self.levels), 0, 1)


def fit(stats: DataFrame, labels: DataFrame, key: str, label: str) -> QualityModel:
    """Model from all rows of ``labels`` with label 0 or 1 whose key is in ``stats``; null labels don't count."""
    known = labels.where(F.col(label).isin(0, 1)).select(F.col(key), F.col(label).cast("double").alias("label"))
    rows = known.join(stats, key).select("stats", "label", (F.shiftright(F.crc32(F.col(key).cast("string")), 8) % 2).cast("int").alias("fold"))
    at = [F.col("stats")[i] for i in range(STATISTICS)]
    moments = rows.agg(F.count("*").alias("n"), *[F.avg(c) for c in at], *[F.stddev_pop(c) for c in at]).first()
    if not moments["n"]:
        return QualityModel()
    scale = np.array(moments[1 + STATISTICS:], float)
    fourier = Fourier(moments[1: 1 + STATISTICS], np.where(scale > 1e-9, scale, 1.0))
    width = FEATURES + 1
    sums = rows.mapInPandas(_equations(fourier), "fold int, place int, value double").groupBy("fold", "place").agg(
        F.sum("value").alias("value")).toPandas()  # two folds of fixed size
    size = width * (width + 1) // 2 + width
    folds = np.zeros((2, size))
    folds[sums["fold"].to_numpy(), sums["place"].to_numpy()] = sums["value"].to_numpy()
    halves = [_solved(f, width) for f in folds]
    table = rows.mapInPandas(_raw(fourier, halves), "bin int, label double").groupBy("bin").agg(
        F.avg("label").alias("share"), F.count("*").alias("n")).toPandas().sort_values("bin")  # at most BINS rows
    centres = LOW + (table["bin"].to_numpy() + 0.5) * (HIGH - LOW) / (BINS - 1)
    return QualityModel(fourier, _solved(folds.sum(axis=0), width), centres, isotonic(table["share"], table["n"]))


def _score(model):
    def run(batches):
        fitted = opened(model)
        for rows in batches:
            yield rows.drop(columns="stats").assign(score=fitted.scores(_stacked(rows["stats"])) if len(rows) else [])

    return run


def score(stats: DataFrame, model: QualityModel, key: str) -> DataFrame:
    """``key`` and ``score`` (0 to 1, higher: likelier good) of every row, repeated and empty ones too."""
    schema = T.StructType([stats.schema[key], T.StructField("score", T.DoubleType())])
    return stats.select(key, "stats").mapInPandas(_score(shipped(stats.sparkSession, model)), schema)


def held_out(key: str) -> Column:
    return remainder(key, 3) == 1
