"""Text fidelity: perplexity of each text under a bigram model of a corpus.

Texts that are their own corpus move once, compressed, in blocks of a few
megabytes. A block asks shards of keys for the counts of its distinct words and
bigrams: sorted hashes in packed arrays, never a row per bigram. A shard adds up
what all blocks have counted and answers in the order asked.
"""

from __future__ import annotations

import zlib
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.session import cut_lineage

START = "<s>"
#: Bytes of text that a task counts at a time.
PIECE_BYTES = 2 << 20
#: Bytes of text that move and are looked up together, and blocks for which there is one shard of keys.
BLOCK_BYTES = 8 << 20
BLOCKS_PER_SHARD = 2
WORDS, PAIRS = 0, 1
BLOCK = "block bigint, texts binary"
SENT = "block bigint, kind int, shard int, keys binary, checks binary, counts binary, marked boolean"
ANSWERED = "block bigint, kind int, shard int, counts binary, distinct bigint, marked boolean"


def _text_sizes(batch: pa.RecordBatch) -> np.ndarray:
    return pc.fill_null(pc.binary_length(batch["__text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _pieces(batch: pa.RecordBatch, limit: int | None = None):
    """The batch in slices of about PIECE_BYTES of text, or another limit, one text at least."""
    ends, first = np.cumsum(_text_sizes(batch)), 0
    while first < len(ends):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + (limit or PIECE_BYTES), "right")))
        yield batch.slice(first, last - first)
        first = last


def _pairs(texts: pa.Array, by_text: bool):
    """(text, first word, second word, times) of the distinct bigrams of some texts, or of all of them together (text 0).

    Python's split cuts at the same characters as ``functions.text.words``.
    """
    tokens = [[START, *(t or "").split()] for t in texts.to_pylist()]
    words = pa.array([w for t in tokens for w in t], pa.string()).dictionary_encode()
    ids, width = words.indices.to_numpy().astype(np.int64), max(1, len(words.dictionary))
    text = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
    inside = text[1:] == text[:-1]
    code = ids[:-1][inside] * width + ids[1:][inside]
    if by_text:  # below 2**63: several texts of a piece have PIECE_BYTES together
        code += text[1:][inside] * width**2
    code, times = np.unique(code, return_counts=True)
    word = lambda at: words.dictionary.take(pa.array(at, pa.int64()))
    return code // width**2, word(code // width % width), word(code % width), pa.array(times, pa.int64())


def _counted(key: str):
    """Distinct bigrams of every text with their number."""
    def run(batches):
        for batch in batches:
            for some in _pieces(batch):
                text, w1, w2, times = _pairs(some["__text"], True)
                yield pa.RecordBatch.from_arrays([some[key].take(pa.array(text, pa.int64())), w1, w2, times], names=[key, "w1", "w2", "times"])

    return run


def _counted_together(batches):
    """Distinct bigrams of some texts together, with their number."""
    for batch in batches:
        for some in _pieces(batch):
            _, w1, w2, times = _pairs(some["__text"], False)
            yield pa.RecordBatch.from_arrays([w1, w2, times], names=["w1", "w2", "times"])


def text_bigrams(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, w1, w2, times): each bigram of a text once, from a start mark on, counted in its row without a shuffle.

    Written once for the passes that follow; empty texts have none.
    """
    schema = T.StructType([df.schema[key], T.StructField("w1", T.StringType()), T.StructField("w2", T.StringType()), T.StructField("times", T.LongType())])
    return cut_lineage(df.select(key, F.lower(text).alias("__text")).mapInArrow(_counted(key), schema), "bigrams")


def corpus_bigrams(df: DataFrame, text: str) -> DataFrame:
    """(w1, w2, times): bigrams of the texts, those of some texts added up before they are shuffled."""
    return df.select(F.lower(text).alias("__text")).mapInArrow(_counted_together, "w1 string, w2 string, times bigint")


def bigram_model(counted: DataFrame) -> DataFrame:
    """(w1, w2, n): corpus counts from the counts of its texts, written once."""
    return cut_lineage(counted.groupBy("w1", "w2").agg(F.sum("times").alias("n")), "model")


def _blocks(batches):
    """Texts of a task with their keys in compressed blocks of about BLOCK_BYTES, one text at least; a block is one row.

    A block's number is made of its content and place: should a lost task come
    out otherwise when it runs again, its blocks get no answers, not others'.
    """
    task = TaskContext.get()
    number, held, size = 0, [], 0

    def packed():
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            for some in held:
                stream.write_batch(some)
        texts, place = out.getvalue().to_pybytes(), f"{task.partitionId() if task else 0} {number}"
        block = int.from_bytes(blake2b(texts, digest_size=8, key=place.encode()).digest(), "little", signed=True)
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([texts], pa.binary())], names=["block", "texts"])

    for batch in batches:
        for some in _pieces(batch, BLOCK_BYTES):
            more = int(_text_sizes(some).sum())
            if held and size + more > BLOCK_BYTES:
                yield packed()
                number, held, size = number + 1, [], 0
            held, size = [*held, some], size + more
    if held:
        yield packed()


def _unpacked(texts: bytes) -> pa.Table:
    return pa.ipc.open_stream(texts).read_all()


class _Steps:
    """Bigrams of a block's texts, place by place, and the keys of its words and distinct bigrams.

    A word is known by 128 bits of a cryptographic hash, a bigram by 80 bits made
    of its words': a key, by which it is sorted and sent, and a check.
    """

    def __init__(self, texts):
        # cuts at the same characters as ``functions.text.words``, but leaves empty words at the ends
        lists = pc.utf8_split_whitespace(pc.fill_null(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts, ""))
        words, sizes = lists.flatten(), lists.value_lengths().to_numpy()
        filled = pc.not_equal(words, "")
        self.text = np.repeat(np.arange(len(sizes)), sizes)[filled.to_numpy(zero_copy_only=False)]
        coded = words.filter(filled).dictionary_encode()
        second, self.words = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
        self.marked = START in self.words  # the mark is also a word of some text
        if not self.marked:
            self.words.append(START)
        self.start = self.words.index(START)
        first = np.roll(second, 1)
        first[np.flatnonzero(np.diff(self.text, prepend=-1))] = self.start
        width = len(self.words)
        self.contexts = np.bincount(first, minlength=width)
        pairs, self.place, self.times = np.unique(first * width + second, return_inverse=True, return_counts=True)
        self.first, self.second = pairs // width, pairs % width

    def keys(self):
        """(kind, order, keys and checks in this order, counts in this order) of the words and of the bigrams; the order is by keys."""
        known = np.frombuffer(b"".join(blake2b(w.encode(), digest_size=16).digest() for w in self.words), "<u8").reshape(-1, 2)
        for kind, both, counts in ((WORDS, known, self.contexts),
                                   (PAIRS, known[self.first] * np.uint64(0x9E3779B97F4A7C15) + known[self.second], self.times)):
            order = np.argsort(both[:, 0], kind="stable")
            yield kind, order, both[order, 0], (both[order, 1] >> np.uint64(48)).astype("<u2"), counts[order]


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as the steps between them, in as many bytes each as the largest needs."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    width = max(1, (int(steps[1:].max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + steps[:1].tobytes() + steps[1:].view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpack_keys(data: bytes) -> np.ndarray:
    width, n = data[0], (len(data) - 9) // data[0]
    steps = np.zeros((n + 1, 8), np.uint8)
    steps[0] = np.frombuffer(data, np.uint8, 8, 1)
    steps[1:, :width] = np.frombuffer(data, np.uint8, n * width, 9).reshape(n, width)
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


def _pack_counts(counts: np.ndarray) -> bytes:
    kind = np.min_scalar_type(int(counts.max()))
    return bytes([kind.itemsize]) + zlib.compress(counts.astype(kind).tobytes(), 1)


def _unpack_counts(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(memoryview(data)[1:]), f"u{data[0]}").astype(np.int64)


def _asked(shards: int):
    """What a block sends to each shard that has keys of it: its words with their numbers as contexts, its bigrams with theirs."""
    edges = np.array([(s << 64) // shards for s in range(1, shards)], np.uint64)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                steps, out = _Steps(_unpacked(row["texts"])["__text"]), []
                for kind, _, keys, checks, counts in steps.keys() if len(steps.text) else ():
                    at = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
                    out += [(row["block"], kind, s, _pack_keys(keys[a:b]), checks[a:b].tobytes(), _pack_counts(counts[a:b]), steps.marked)
                            for s, (a, b) in enumerate(zip(at, at[1:])) if b > a]
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.bool_()))],
                        names=["block", "kind", "shard", "keys", "checks", "counts", "marked"])

    return run


def _answered(asked: pa.Table) -> pa.Table:
    """A shard's counts over all blocks, in the order of each block's keys, and the number of its distinct keys."""
    keys = [_unpack_keys(k) for k in asked["keys"].to_pylist()]
    sizes, keys = [len(k) for k in keys], np.concatenate(keys)
    checks = np.frombuffer(b"".join(asked["checks"].to_pylist()), "<u2")
    counts = np.concatenate([_unpack_counts(c) for c in asked["counts"].to_pylist()])
    order = np.argsort(keys, kind="stable")
    if ((keys[order][1:] == keys[order][:-1]) & (checks[order][1:] != checks[order][:-1])).any():
        order = np.lexsort((checks, keys))
    k, c = keys[order], checks[order]
    starts = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (c[1:] != c[:-1]))))
    sums = np.empty_like(counts)
    sums[order] = np.repeat(np.add.reduceat(counts[order], starts), np.diff(starts, append=len(k)))
    rows = len(asked)
    return pa.table({
        "block": asked["block"], "kind": asked["kind"], "shard": asked["shard"],
        "counts": pa.array([_pack_counts(x) for x in np.split(sums, np.cumsum(sizes)[:-1])], pa.binary()),
        "distinct": pa.array([len(starts)] * rows, pa.int64()),
        "marked": pa.array([pc.any(asked["marked"]).as_py()] * rows, pa.bool_()),
    })


def _scored(key: str, add: float):
    """(key, tokens, log) of the texts of a block that have words, from the shards' answers."""
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        texts, names = _unpacked(blocks["texts"][0].as_py()), [key, "tokens", "log"]
        if not len(answers):
            if len(_Steps(texts["__text"]).text):
                raise RuntimeError("the texts were not the same when they were read again")
            return pa.table([texts[key].slice(0, 0), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        answers = answers.sort_by([("kind", "ascending"), ("shard", "ascending")])
        steps, found = _Steps(texts["__text"]), {}
        for kind, order, *_ in steps.keys():
            found[kind] = np.empty(len(order))
            found[kind][order] = np.concatenate([_unpack_counts(c) for c in answers.filter(pc.field("kind") == kind)["counts"].to_pylist()])
        logs = np.log((found[PAIRS] + add) / (found[WORDS][steps.first] + add * answers["vocabulary"][0].as_py()))
        at = np.flatnonzero(np.diff(steps.text, prepend=-1))
        tokens = np.diff(at, append=len(steps.text))
        return pa.table([texts[key].take(pa.array(steps.text[at])), pa.array(tokens, pa.int64()), pa.array(np.add.reduceat(logs[steps.place], at))],
                        names=names)

    return run


def _own_logs(df: DataFrame, key: str, text: str, add: float) -> DataFrame:
    """(key, tokens, log) of every row with words, under the bigrams of all rows."""
    given = df.select(key, F.lower(text).alias("__text"))
    total = given.agg(F.sum(F.octet_length("__text").cast("bigint"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    rows = given.mapInArrow(_blocks, BLOCK).repartition(blocks, "block")
    asked = rows.mapInArrow(_asked(max(1, blocks // BLOCKS_PER_SHARD)), SENT)
    answers = asked.groupBy("kind", "shard").applyInArrow(_answered, ANSWERED)
    # all rows of a shard say the same; a scalar of the same plan, so that texts and keys are exchanged once
    shares = answers.where(F.col("kind") == WORDS).groupBy("shard").agg(F.max("distinct").alias("n"), F.max("marked").alias("marked"))
    vocabulary = shares.agg(F.sum("n") - F.when(F.max("marked"), 0).otherwise(1))  # every word is the second of a bigram, a mark need not be
    answers = answers.select("block", "kind", "shard", "counts").withColumn("vocabulary", vocabulary.scalar())
    schema = T.StructType([df.schema[key], T.StructField("tokens", T.LongType()), T.StructField("log", T.DoubleType())])
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scored(key, add), schema)


def ngram_perplexity(df: DataFrame, key: str, text: str, corpus: DataFrame | None = None, add: float = 1.0) -> DataFrame:
    """(key, tokens, perplexity) = exp(-mean ln p) with add-k smoothing.

    The model comes from ``corpus`` (same columns) or from the texts themselves.
    Rows of one key count as one text. Under its own texts no bigram is a row;
    under a corpus a text is cut into words once and its distinct bigrams are joined.
    """
    if corpus is None:
        logs = _own_logs(df, key, text, add)
    else:
        found = text_bigrams(df, key, text)
        model = bigram_model(corpus_bigrams(corpus, text))
        contexts = model.groupBy("w1").agg(F.sum("n").alias("context"))
        vocabulary = model.select("w2").distinct().agg(F.count("*").alias("v")).scalar()
        log_p = F.log((F.col("n") + add) / (F.col("context") + add * vocabulary))
        known = model.join(contexts, "w1").select("w1", "w2", log_p.alias("lp"))
        unseen = F.log(F.lit(add) / (F.coalesce("context", F.lit(0)) + add * vocabulary))
        scored = found.join(known, ["w1", "w2"], "left").join(contexts, "w1", "left").withColumn("lp", F.coalesce("lp", unseen))
        logs = scored.select(key, F.col("times").alias("tokens"), (F.col("times") * F.col("lp")).alias("log"))
    total = logs.groupBy(key).agg(F.sum("tokens").alias("tokens"), F.sum("log").alias("log"))
    return total.select(key, "tokens", F.exp(-F.col("log") / F.col("tokens")).alias("perplexity"))


def popularity_scores(perplexities: DataFrame, name: str = "name") -> DataFrame:
    """(name, score): mean perplexity of a name's texts; lower is more popular."""
    return perplexities.groupBy(name).agg(F.avg("perplexity").alias("score"))
