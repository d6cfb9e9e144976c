"""Language identification by prediction by partial matching over bytes.

Per language a context tree of orders 0 to 3 holds how often a byte followed its
context. The probability of a byte after its longest context is count / (total +
distinct); an unseen byte pays the escape probability distinct / (total +
distinct) and is looked up after the context one byte shorter, down to 1/256.
Counts are frozen after training, so the code length of every seen (context,
byte) pair is worked out once for all languages, and a text's exact code length
is a sum of table entries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from spanloom.functions.randomness import unit_random
from spanloom.llm.common import chunks, opened, shipped, utf8

ORDER = 3
#: Bound of the training sample: whole texts per language, those with the smallest hash of their key.
SAMPLE = 1000
CHUNK = 1 << 20
UNKNOWN = "und"


def has_letter(text: Column) -> Column:
    return F.coalesce(F.rlike(text, F.lit(r"\p{L}")), F.lit(False))


def _codes(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The (order + 1)-byte code that ends at every byte of the texts, and where each text starts.

    Each text is led by ``order`` line ends that are context only.
    """
    lead = b"\n" * order
    data = np.frombuffer(lead + lead.join(t.lower() for t in texts), np.uint8)
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    code = np.zeros(len(data), np.uint32)
    for k in range(order + 1):
        code[k:] |= data[: len(data) - k].astype(np.uint32) << np.uint32(8 * k)
    starts = np.cumsum(lengths + order) - lengths
    inside = np.ones(len(data), bool)
    for k in range(order):
        inside[starts - 1 - k] = False
    return code[inside], np.cumsum(lengths) - lengths


def _count(order: int):
    def run(batches):
        import pandas as pd

        for rows in batches:
            for lang, group in rows.groupby("lang", sort=False):
                texts = [bytes(t) for t in group["text"]]
                for first, last in chunks(texts, 4 << 20):
                    code, _ = _codes(texts[first:last], order)
                    for size in range(1, order + 2):
                        gram, n = np.unique(code & np.uint32((1 << 8 * size) - 1), return_counts=True)
                        yield pd.DataFrame({"lang": lang, "size": size, "gram": gram.astype(np.int64), "n": n.astype(np.int64)})

    return run


class Lookup:
    """Place of a 32-bit code in a sorted array, by open addressing; -1 where it isn't there."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys.astype(np.uint32)
        bits = max(8, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint32(32 - bits), np.uint32((1 << bits) - 1)
        self.slots = np.full(1 << bits, -1, np.int32)
        left, place = np.arange(len(keys)), self._hash(self.keys)
        while len(left):
            free = self.slots[place] < 0
            self.slots[place[free]] = left[free]
            lost = self.slots[place] != left
            left, place = left[lost], (place[lost] + np.uint32(1)) & self.mask

    def _hash(self, codes):
        return (codes * np.uint32(2654435761)) >> self.shift

    def find(self, codes: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(codes), -1, np.int32)
        place = self._hash(codes)
        found = self.slots[place]
        wrong = np.flatnonzero((found >= 0) & (self.keys[found] != codes))
        while len(wrong):
            place[wrong] = (place[wrong] + np.uint32(1)) & self.mask
            found[wrong] = self.slots[place[wrong]]
            wrong = wrong[(found[wrong] >= 0) & (self.keys[found[wrong]] != codes[wrong])]
        return found


class ContextTrees:
    """Frozen code lengths, in bits, of every seen gram for each language, and escape costs of every context."""

    def __init__(self, languages: list[str], counts: dict, order: int):
        """counts: {(language, gram bytes): (sorted codes, numbers)}"""
        self.languages, self.order = languages, order
        self.grams, self.bits, self.escapes = [], [], []
        none = (np.empty(0, np.int64), np.empty(0, np.int64))
        width = len(languages)
        for size in range(1, order + 2):
            seen = [counts.get((lang, size), none) for lang in languages]
            keys = np.unique(np.concatenate([codes for codes, _ in seen])) if width else none[0]
            contexts = np.unique(keys >> 8) if size > 1 else np.zeros(1, np.int64)
            total, kinds = np.zeros((len(contexts), width)), np.zeros((len(contexts), width))
            count = np.zeros((len(keys), width))
            for j, (codes, n) in enumerate(seen):
                count[np.searchsorted(keys, codes), j] = n
                at = np.searchsorted(contexts, codes >> 8 if size > 1 else np.zeros(len(codes), np.int64))
                np.add.at(total[:, j], at, n)
                np.add.at(kinds[:, j], at, 1)
            # a context that a language never saw costs it nothing: it goes on with the shorter one
            escape = np.where(kinds > 0, np.log2(np.maximum(total + kinds, 1)) - np.log2(np.maximum(kinds, 1)), 0.0)
            above = np.searchsorted(contexts, keys >> 8 if size > 1 else np.zeros(len(keys), np.int64))
            if size == 1:
                shorter = np.full((len(keys), width), 8.0)
            else:
                shorter = self.bits[-1][self.grams[-1].find((keys & ((1 << 8 * (size - 1)) - 1)).astype(np.uint32))]
            own = np.log2(np.maximum(total + kinds, 1))[above] - np.log2(np.maximum(count, 1))
            bits = np.where(count > 0, own, escape[above] + shorter)
            self.grams.append(Lookup(keys))
            self.bits.append(bits.astype(np.float32))
            self.escapes.append((Lookup(contexts), escape.astype(np.float32)))

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under each language."""
        out = np.zeros((len(texts), len(self.languages)))
        for first, last in chunks(texts, max(1, 4 * CHUNK // max(4, len(self.languages)))):
            code, starts = _codes(texts[first:last], self.order)
            if not len(code):
                continue
            cost = np.zeros((len(code), len(self.languages)), np.float32)
            left = None  # all
            for size in range(self.order + 1, 0, -1):
                part = (code if left is None else code[left]) & np.uint32((1 << 8 * size) - 1)
                found = self.grams[size - 1].find(part)
                here = found >= 0
                if left is None:
                    cost = self.bits[size - 1][found]
                    left = np.flatnonzero(~here)
                    cost[left] = 0
                    part = part[left]
                else:
                    cost[left[here]] += self.bits[size - 1][found[here]]
                    left, part = left[~here], part[~here]
                contexts, escape = self.escapes[size - 1]
                at = contexts.find(part >> np.uint32(8) if size > 1 else np.zeros(len(part), np.uint32))
                known = at >= 0
                cost[left[known]] += escape[at[known]]
            cost[left] += 8.0
            sizes = np.diff(np.append(starts, len(code)))
            held = sizes > 0
            out[first:last][held] = np.add.reduceat(cost, starts[held], axis=0, dtype=np.float64)
        return out


def train(df: DataFrame, text: str, lang: str, key: str, sample: int = SAMPLE, order: int = ORDER, seed: int = 29) -> ContextTrees:
    """Context trees from at most ``sample`` whole texts of each language of ``df``, chosen by a hash of their key.

    Rows with a null language or a text without letters don't count.
    """
    rows = df.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.col(key).alias("key")).where(
        F.col("lang").isNotNull() & has_letter(F.col("text")))
    rows = rows.withColumn("key", F.coalesce(F.col("key").cast("string"), F.lit("null"))).withColumn("hash", F.xxhash64("text"))
    one = ["lang", "key", "hash"]  # repeated rows count once
    known = rows.select(*one).distinct()
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"))
    near = known.withColumn("u", unit_random(seed, F.col("key"), F.col("hash"))).join(sizes, "lang").where(
        F.col("u") * F.col("n") < 1.5 * sample + 100)
    order_in = Window.partitionBy("lang").orderBy("u", "key", "hash")
    picked = near.withColumn("rank", F.row_number().over(order_in)).where(F.col("rank") <= sample).select(*one)
    # no more than ``sample`` keys for each language; the texts themselves stay where they are
    chosen = rows.join(F.broadcast(picked), one).dropDuplicates(one)
    counted = chosen.select("lang", utf8("text").alias("text")).mapInPandas(_count(order), "lang string, size int, gram bigint, n bigint")
    # bounded by the sample: its texts' distinct grams of up to order + 1 bytes
    table = counted.groupBy("lang", "size", "gram").agg(F.sum("n").alias("n")).toPandas().sort_values(["lang", "size", "gram"])
    counts = {k: (g["gram"].to_numpy(np.int64), g["n"].to_numpy(np.int64)) for k, g in table.groupby(["lang", "size"])}
    return ContextTrees(sorted({lang for lang, _ in counts}), counts, order)


def _predict(model):
    def run(batches):
        trees = opened(model)
        for batch in batches:
            texts, able = batch["text"].to_pylist(), np.array(batch["able"].to_pylist(), bool)
            names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            at = np.flatnonzero(able) if trees.languages else []
            if len(at):
                bits = trees.code_lengths([texts[i] for i in at])
                best = bits.argmin(axis=1)
                odds = np.exp2(np.minimum(bits.min(axis=1)[:, None] - bits, 0)).sum(axis=1)
                scores[at] = 1 / odds
                for i, b in zip(at, best, strict=True):
                    names[i] = trees.languages[b]
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(names, pa.string()), pa.array(scores)], names=["row", "lang_pred", "score"])

    return run


def predict(df: DataFrame, model: ContextTrees, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row`` (struct of the kept columns, all by default), ``lang_pred`` and ``score``.

    The language with the shortest code wins, ties go to the smaller name; the
    score is its share of the probability over all languages. A null text or one
    without a letter, empty ones included, is ``und`` with score 0, and so is
    every text if nothing was learned. Whole texts are scored, however long.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in keep or df.columns]).alias("row")
    given = df.select(row, utf8(text).alias("text"), has_letter(F.col(text)).alias("able"))
    schema = T.StructType([T.StructField("row", given.schema["row"].dataType), T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType())])
    return given.mapInArrow(_predict(shipped(df.sparkSession, model)), schema)
