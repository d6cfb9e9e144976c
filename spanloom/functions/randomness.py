"""Randomness that depends on row keys only.

Every draw is a hash of the seed and the row's own keys, so a retried task, a
lost executor or another partition count gives the same rows again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX_DIGITS = 13
RANGE = float(16**HEX_DIGITS)
SMALLEST = 1e-16


def _key(part) -> Column:
    return (part if isinstance(part, Column) else F.lit(part)).cast("string")


def unit_random(seed, *keys) -> Column:
    """Uniform number in [0, 1): the first 13 hex digits of md5('seed:key:...')."""
    digest = F.md5(F.concat_ws(":", *[_key(k) for k in (seed, *keys)]))
    return F.conv(F.substring(digest, 1, HEX_DIGITS), 16, 10).cast("bigint") / F.lit(RANGE)


def gumbel_key(log_weight: Column, seed, *keys) -> Column:
    """Sorting by this key, largest first, is a weighted draw without replacement.

    Works on log weights, so very large scores cannot underflow.
    """
    u = F.greatest(unit_random(seed, *keys), F.lit(SMALLEST))
    return log_weight - F.log(-F.log(u))


def softmax(values, temperature: float = 1.0) -> list[float]:
    """Shifted softmax of a short parameter list (not of table columns)."""
    if not values:
        raise ValueError("softmax of an empty list")
    scaled = [v / temperature for v in values]
    top = max(scaled)
    weights = [math.exp(v - top) for v in scaled]
    total = sum(weights)
    return [w / total for w in weights]


def cumulative(probabilities) -> list[float]:
    out, total = [], 0.0
    for p in probabilities:
        total += p
        out.append(total)
    return out


def size_from_uniform(u: Column, size_weights, temperature: float = 1.0) -> Column:
    """Combination size 1..n by inverse CDF.

    The weights pass through softmax twice: once as given, once with the
    temperature.
    """
    steps = cumulative(softmax(softmax(size_weights), temperature))[:-1]
    size = F.lit(1)
    for edge in steps:
        size = size + F.when(u >= F.lit(edge), 1).otherwise(0)
    return size
