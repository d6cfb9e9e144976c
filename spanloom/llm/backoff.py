"""Language-model scores from a weighted backoff automaton over words.

The model is a bigram model of all training texts, smoothed towards its unigrams:
p(v | u) = (c(uv) + K p(v)) / (c(u) + K). As an automaton of order 2, every word
is a state; a seen pair is an arc with its own log-probability, and the failure
arc of a state has weight log(K / (c(u) + K)) and leads to the root, whose arcs
are the unigrams. A text is traversed once from left to right, from the state of
a text end to a text end. The state after a word is the word itself, so the steps
of a block of texts are taken together as arrays.

The model is as large as the corpus has different pairs, so it is never in one
place: each block of texts asks the shards for the counts of its own words and
pairs and builds the part of the automaton that its texts can reach.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.common import chunks, mixed, utf8, word_hashes
from spanloom.llm.packed import (
    dealt, number_of_blocks, pack_keys, pack_numbers, shard_slices, text_bytes, unpack_keys, unpack_numbers,
)

#: Weight of the unigrams in the pairs after a word, in words.
STRENGTH = 1000.0
END = 0x5851F42D4C957F2D
WORDS, PAIRS = 0, 1
SENT = "block int, kind int, shard int, keys binary, counts binary"
ANSWERED = "block int, kind int, shard int, counts binary, distinct bigint, total bigint"


def _tokens(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes with an end after each text, the pair of each token with the one before, tokens per text."""
    hashes, numbers = [], []
    raw = [bytes(t).lower() for t in texts]
    for first, last in chunks(raw):
        words, n = word_hashes(raw[first:last])
        hashes.append(np.insert(words, np.cumsum(n), np.uint64(END)))
        numbers.append(n + 1)
    tokens, sizes = np.concatenate(hashes), np.concatenate(numbers)
    before = np.concatenate((np.array([END], np.uint64), tokens[:-1]))
    return tokens, mixed(before * np.uint64(0xC2B2AE3D27D4EB4F) + (tokens ^ (tokens >> np.uint64(29)))), sizes


def _asked(shards: int):
    """What a block sends: its distinct words and pairs with their counts in its training texts, none in the others."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        tokens, pairs, sizes = _tokens(rows["text"])
        trained = np.repeat(~rows["held"].to_numpy(bool), sizes)
        out = []
        for kind, codes in ((WORDS, tokens), (PAIRS, pairs)):
            keys, place = np.unique(codes, return_inverse=True)
            counts = np.bincount(place[trained], minlength=len(keys))
            for shard, part in shard_slices(keys, shards):
                if part.stop > part.start:
                    out.append((rows["block"].iloc[0], kind, shard, pack_keys(keys[part]), pack_numbers(counts[part])))
        return pd.DataFrame(out, columns=["block", "kind", "shard", "keys", "counts"])

    return run


def _answered(rows: pd.DataFrame) -> pd.DataFrame:
    """Counts over all blocks, in the order of each block's keys; number of distinct trained keys and their total."""
    keys = [unpack_keys(k) for k in rows["keys"]]
    counts = np.concatenate([unpack_numbers(c) for c in rows["counts"]])
    known, place = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.zeros(len(known), np.int64)
    np.add.at(sums, place, counts)
    parts = np.split(sums[place], np.cumsum([len(k) for k in keys])[:-1])
    return pd.DataFrame({
        "block": rows["block"], "kind": rows["kind"], "shard": rows["shard"], "counts": [pack_numbers(p) for p in parts],
        "distinct": int((sums > 0).sum()), "total": int(sums.sum()),
    })


class Automaton:
    """States and arcs that the texts of a block can reach.

    ``root`` has the log-probability of each word at the root, ``failure`` the
    weight of the failure arc of each word's state; the arcs of seen pairs get
    their weights when they are taken.
    """

    def __init__(self, words: np.ndarray, trained: int, distinct: int, strength: float):
        self.strength, self.words = strength, words
        self.chance = (words + 0.5) / (trained + 0.5 * (distinct + 1))
        self.root = np.log10(self.chance)
        self.failure = np.log10(strength / (words + strength))

    def traverse(self, states: np.ndarray, tokens: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """Weight of each step: the arc out of the state, or else the failure arc and the arc of the root."""
        steps = self.failure[states] + self.root[tokens]
        seen = np.flatnonzero(pairs > 0)
        u, v = states[seen], tokens[seen]
        steps[seen] = np.log10((pairs[seen] + self.strength * self.chance[v]) / (self.words[u] + self.strength))
        return steps


def _scored(strength: float, key_name: str):
    def run(key, rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame(columns=[key_name, "n_tokens", "n_known", "train_tokens", "base_score", "score"])
        tokens, pairs, sizes = _tokens(rows["text"])
        answers = answers.sort_values(["kind", "shard"])
        whole = answers["whole"].iloc[0]
        trained, distinct = int(whole["trained"]), int(whole["distinct"])
        counts = np.concatenate([unpack_numbers(c) for c in answers.loc[answers["kind"] == WORDS, "counts"]])
        pair_counts = np.concatenate([unpack_numbers(c) for c in answers.loc[answers["kind"] == PAIRS, "counts"]])
        keys, token = np.unique(tokens, return_inverse=True)
        _, pair = np.unique(pairs, return_inverse=True)
        automaton = Automaton(counts.astype(float), trained, distinct, strength)
        start = int(np.searchsorted(keys, np.uint64(END)))
        states = np.concatenate(([start], token[:-1]))
        edges = np.cumsum(sizes) - sizes
        return pd.DataFrame({
            key_name: rows[key_name].to_numpy(), "n_tokens": sizes, "n_known": np.add.reduceat((counts[token] > 0).astype(np.int64), edges),
            "train_tokens": trained, "base_score": np.add.reduceat(automaton.root[token], edges),
            "score": np.add.reduceat(automaton.traverse(states, token, pair_counts[pair]), edges),
        })

    return run


def score(df: DataFrame, key: str, text: str, held_out, strength: float = STRENGTH) -> DataFrame:
    """Per row: ``key``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` (log10, both).

    Tokens are words in lower-case A-Z and one end per text. The model learns
    from the rows where ``held_out`` is false and scores all, whole and however
    long. A null text counts as empty and has its end only; repeated rows count
    each; without training texts every token has the chance of an unknown one;
    an empty table gives an empty result. Other columns are ignored.
    """
    given = df.select(F.col(key), utf8(text).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    blocks, shards = number_of_blocks(text_bytes(given, "text"))
    rows = dealt(given, F.pmod(F.xxhash64(key, "text"), F.lit(blocks)), blocks)
    asked = rows.groupBy("block").applyInPandas(_asked(shards), SENT)
    answers = asked.groupBy("kind", "shard").applyInPandas(_answered, ANSWERED)
    # all rows of a shard say the same; a scalar of the same plan, so that what the blocks ask is exchanged once
    shares = answers.where(F.col("kind") == WORDS).groupBy("shard").agg(F.max("total").alias("total"), F.max("distinct").alias("distinct"))
    whole = shares.agg(F.struct(F.sum("total").alias("trained"), F.sum("distinct").alias("distinct")).alias("whole"))
    answers = answers.select("block", "kind", "shard", "counts").withColumn("whole", whole.scalar())
    schema = T.StructType([given.schema[key], *[T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known", "train_tokens")],
                           T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_scored(strength, key), schema)
