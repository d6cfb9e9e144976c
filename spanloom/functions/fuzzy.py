"""String ratios on a 0-100 scale, used inside tasks.

The ratio is 2 * (longest common subsequence) / (total length). The token-set
ratio compares the shared tokens with what each side adds to them.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

NOT_WORD = re.compile(r"\W")
# ASCII characters that survive normalisation
ALPHABET = " _0123456789abcdefghijklmnopqrstuvwxyz"
COLUMN_OF = {c: i for i, c in enumerate(ALPHABET)}


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine word row per character of b."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> int:
    if a == b:
        return 100
    total = len(a) + len(b)
    return round(100 * 2 * common_subsequence(a, b) / total)


def normalise(text: str) -> str:
    """ASCII letters, digits and underscores in lower case, all else a space."""
    return NOT_WORD.sub(" ", text.encode("ascii", "ignore").decode()).lower().strip()


def token_set(text: str) -> frozenset[str]:
    return frozenset(normalise(text).split())


def token_set_score(a: frozenset[str], b: frozenset[str]) -> int:
    if not a or not b:
        return 0
    shared = " ".join(sorted(a & b))
    left = f"{shared} {' '.join(sorted(a - b))}".strip()
    right = f"{shared} {' '.join(sorted(b - a))}".strip()
    best = ratio(left, right)
    if shared:
        best = max(best, ratio(shared, left), ratio(shared, right))
    return best


def token_set_ratio(a: str, b: str) -> int:
    return token_set_score(token_set(a), token_set(b))


@F.pandas_udf(IntegerType())
def ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b)], dtype="Int32")


@F.pandas_udf(IntegerType())
def token_set_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else token_set_ratio(x, y) for x, y in zip(a, b)], dtype="Int32")


def _letters(text: str) -> np.ndarray:
    counts = np.zeros(len(ALPHABET), dtype=np.int32)
    for c in text:
        counts[COLUMN_OF[c]] += 1
    return counts


class NameIndex:
    """Names of one task, ready to be scored against many spans."""

    def __init__(self, names: pd.Series):
        self.sets = [token_set(n) for n in names]
        joined = [" ".join(sorted(s)) for s in self.sets]
        self.letters = np.stack([_letters(t) for t in joined]) if joined else np.zeros((0, len(ALPHABET)), np.int32)
        self.lengths = np.array([len(t) for t in joined], dtype=np.int64)
        self.by_token: dict[str, list[int]] = {}
        for i, s in enumerate(self.sets):
            for token in s:
                self.by_token.setdefault(token, []).append(i)

    def scores(self, span: str, k: int) -> np.ndarray:
        """Score / 100 of every name that can be among the k best, -1 for the others.

        Names sharing a token are scored first. For the rest the letter counts
        bound the ratio from above: they are scored in falling order of the
        bound until it drops below the k-th best score.
        """
        tokens = token_set(span)
        out = np.full(len(self.sets), -1.0)
        if not tokens:
            return np.zeros(len(self.sets))
        near = sorted({i for t in tokens for i in self.by_token.get(t, ())})
        for i in near:
            out[i] = token_set_score(tokens, self.sets[i]) / 100
        text = " ".join(sorted(tokens))
        overlap = np.minimum(self.letters, _letters(text)).sum(axis=1)
        bound = np.rint(200 * overlap / np.maximum(self.lengths + len(text), 1)).astype(np.int64)
        bound[near] = -1
        order = np.argsort(-bound, kind="stable")
        best = sorted((round(out[i] * 100) for i in near), reverse=True)[:k]
        for i in order:
            if bound[i] < 0 or (len(best) >= k and bound[i] < best[-1]):
                break
            score = token_set_score(tokens, self.sets[i])
            out[i] = score / 100
            best = sorted([*best, score], reverse=True)[:k]
        return out


def token_set_kernel(k: int):
    def kernel(spans: pd.Series, names: NameIndex) -> np.ndarray:
        return np.stack([names.scores(s, k) for s in spans]) if len(spans) else np.zeros((0, len(names.sets)))

    return kernel
