"""Vectors for texts and spans."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.functions.fuzzy import ratio
from spanloom.functions.text import words
from spanloom.operators.neighbours import mean_vectors
from spanloom.session import cut_lineage

Encoder = Callable[[pd.Series], pd.Series]
CHUNK = 400
#: Texts of a part; parts are written one after another.
PART_TEXTS = 200_000


def truncated(text, max_length: int | None) -> Column:
    """The first ``max_length`` words of a text, joined by spaces; without a length, or if it is no longer, the text as it is."""
    column = F.col(text) if isinstance(text, str) else text
    if max_length is None:
        return column
    tokens = words(column)
    return F.when(F.size(tokens) > max_length, F.array_join(F.slice(tokens, 1, max_length), " ")).otherwise(column)


def embed(df: DataFrame, text: str, make_encoder: Callable[[], Encoder], output: str = "embedding",
          chunk: int = CHUNK, max_length: int | None = None) -> DataFrame:
    """Add one vector per row from any encoder.

    ``make_encoder`` runs once in each Python worker process, which keeps what
    it returns for all its tasks: a function from at most ``chunk`` texts to
    their vectors, all of one length. Texts are cut after ``max_length`` words.
    """
    def make_predict():
        encoder = make_encoder()
        return lambda texts: np.stack([np.asarray(v, np.float32) for v in encoder(pd.Series(texts, dtype=object))])

    encode = predict_batch_udf(make_predict, return_type=T.ArrayType(T.FloatType()), batch_size=chunk)
    return df.withColumn(output, encode(truncated(text, max_length)))


def hash_embed(df: DataFrame, text: str, dimensions: int = 256, output: str = "embedding") -> DataFrame:
    """Default encoder: hashed word counts of the whole text, scaled to length one, all in the JVM."""
    tokens = df.withColumn("__words", words(F.lower(text)))
    counted = HashingTF(numFeatures=dimensions, inputCol="__words", outputCol="__tf").transform(tokens)
    scaled = Normalizer(p=2.0, inputCol="__tf", outputCol="__unit").transform(counted)
    return scaled.withColumn(output, vector_to_array("__unit")).drop("__words", "__tf", "__unit")


def _written_vectors(spark, path: str, schema: T.StructType) -> DataFrame:
    """Rows of all finished parts; none if there is nothing yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def embed_to_parquet(df: DataFrame, text: str, make_encoder: Callable[[], Encoder], path: str,
                     chunk: int = CHUNK, max_length: int | None = None, part_texts: int = PART_TEXTS) -> DataFrame:
    """Embed a large table into Parquet parts and check that no row was lost; a second run embeds only what is missing.

    Each distinct text is embedded once, under its digest. The missing ones are
    dealt into parts, each written as a whole or not at all, so a job that breaks
    off loses one part at most, and new or changed texts are all that a later run
    adds.
    ``path``-manifest gets a line per part with its number of texts. Returns all
    rows of ``df`` with their ``embedding``.
    """
    spark = df.sparkSession
    digest = F.coalesce(F.sha2(text, 256), F.lit("null")).alias("__digest")
    schema = T.StructType([T.StructField("__digest", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])
    texts = df.select(digest, F.col(text).alias("__text")).groupBy("__digest").agg(F.first("__text").alias("__text"))
    todo = cut_lineage(texts.join(_written_vectors(spark, path, schema), "__digest", "left_anti"), "missing")
    parts = max(1, math.ceil(todo.count() / part_texts))
    todo = todo.withColumn("__part", F.pmod(F.xxhash64("__digest"), F.lit(parts)).cast("int"))
    for row in todo.groupBy("__part").agg(F.count("*").alias("texts")).orderBy("__part").collect():  # one row per part
        some = embed(todo.where(F.col("__part") == row["__part"]), "__text", make_encoder, chunk=chunk, max_length=max_length)
        some.select("__digest", "embedding").write.mode("append").parquet(path)
        spark.createDataFrame([(row["__part"], row["texts"])], "part int, texts long").coalesce(1).write.mode("append").json(f"{path}-manifest")
    out = df.select("*", digest).join(_written_vectors(spark, path, schema), "__digest").drop("__digest")
    asked, got = df.count(), out.count()
    if asked != got:
        raise RuntimeError(f"{got} of {asked} rows were embedded, see {path}")
    return out


def most_possible(sentence: np.ndarray, span: list[str], ids: dict[str, int], lengths: np.ndarray) -> np.ndarray:
    """Upper bound for the summed token ratios of the window at each start.

    Each span token votes for the starts at which the sentence has it in its
    place; where it has another token, lengths bound the ratio: of two tokens at
    most the shorter one is common, and of equally long ones not all.
    """
    starts = len(sentence) - len(span) + 1
    out = np.zeros(starts)
    for j, token in enumerate(span):
        here, size = lengths[j:j + starts], len(token)
        common = np.where(here == size, size - 1, np.minimum(here, size))
        bound = np.rint(200 * common / np.maximum(here + size, 1))
        out += np.where(sentence[j:j + starts] == ids.get(token, -1), 100, bound)
    return out


def best_window(sentence, span, threshold: float, per_token: bool):
    """(start, end) of the window whose tokens match best, or None; the first of equals wins.

    Only windows that may still be the best by :func:`most_possible` are scored.
    """
    width = len(span)
    if width == 0 or len(sentence) < width:
        return None
    ids: dict[str, int] = {}
    numbers = np.array([ids.setdefault(t, len(ids)) for t in sentence])
    bounds = most_possible(numbers, span, ids, np.array([len(t) for t in sentence]))
    least = threshold * width if per_token else threshold
    known: dict[tuple[str, str], int] = {}
    best, place = None, None
    for start in np.flatnonzero(bounds >= least - 1e-9).tolist():
        if best is not None and bounds[start] <= best:
            continue
        total = 0
        for j, token in enumerate(span):
            pair = (token, sentence[start + j])
            if pair not in known:
                known[pair] = ratio(*pair)
            total += known[pair]
        if (total / width if per_token else total) >= threshold and (best is None or total > best):
            best, place = total, start
    return None if place is None else (place, place + width)


def exact_window(sentence: Column, span: Column) -> Column:
    """First start, from 0, at which the sentence has the span's tokens one by one; null if there is none."""
    width = F.size(span)
    starts = F.when((width > 0) & (F.size(sentence) >= width), F.sequence(F.lit(0), F.size(sentence) - width))
    return F.array_min(F.filter(starts, lambda i: F.slice(sentence, i + 1, F.greatest(width, F.lit(0))) == span))


def locate_span(sentence_tokens: Column, span_tokens: Column, threshold: float = 95, per_token: bool = True) -> Column:
    """struct(start, end) of a span among the sentence's tokens, null if not found.

    With ``per_token`` the threshold applies to the mean token ratio, otherwise
    to the sum over the window. A window that agrees token by token can't be
    beaten, so it is found without Python; only the other rows go there.
    """
    @F.pandas_udf("start int, end int")
    def locate(sentences: pd.Series, spans: pd.Series) -> pd.DataFrame:
        found = [
            None if a is None or b is None else best_window(list(a), list(b), threshold, per_token)
            for a, b in zip(sentences, spans)
        ]
        return pd.DataFrame({
            "start": pd.array([None if f is None else f[0] for f in found], dtype="Int32"),
            "end": pd.array([None if f is None else f[1] for f in found], dtype="Int32"),
        })

    exact = exact_window(sentence_tokens, span_tokens)
    reached = exact.isNotNull() & ((F.lit(100) if per_token else 100 * F.size(span_tokens)) >= threshold)
    rest = locate(F.when(~reached, sentence_tokens), F.when(~reached, span_tokens))
    return F.when(reached, F.struct(exact.cast("int").alias("start"), (exact + F.size(span_tokens)).cast("int").alias("end"))).otherwise(rest)


def span_vectors(located: DataFrame, tokens: DataFrame, record: str = "record_id") -> DataFrame:
    """(record, span, embedding): mean of the span's token vectors, or the span's own vector.

    ``located`` has (record, span, start, end, span_embedding), ``tokens`` has
    (record, pos, embedding) with positions from 0. A span names its positions,
    so the join is on (record, pos).
    """
    places = F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("pos")
    wanted = located.where("start is not null and start < end").select(record, "span", places)
    covered = wanted.join(tokens.select(record, "pos", F.col("embedding").cast("array<double>").alias("v")), [record, "pos"])
    means = mean_vectors(covered, [record, "span"], "v")
    joined = located.join(means, [record, "span"], "left")
    vector = F.coalesce("mean_vector", F.col("span_embedding").cast("array<double>"))
    return joined.select(record, "span", vector.alias("embedding"))
