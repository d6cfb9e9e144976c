"""Removal of passages that stand earlier in the corpus, by suffix automata of reference shards.

Blocks hold documents in the order of their keys. Blocks first learn, through
sharded lookups of window hashes, which of their windows stand in an earlier
block and in which block they stand first. What stands first in a block and is
repeated is that block's reference; spans that may repeat it are sent to it. The
reference is cut into shards of bounded size, a suffix automaton is built for
each, and the spans are streamed past it for their matching statistics: wherever
the longest match that ends at a word has at least a window's length, its words
are removed. Automata compare the words themselves, so hashes only say where to
look. A reference that many spans go to is sent to several groups, by the words
of those spans.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.common import chunks, grams, utf8, word_hashes
from spanloom.llm.packed import (
    dealt, number_of_blocks, pack_keys, pack_numbers, shard_slices, text_bytes, unpack_keys, unpack_numbers,
)

#: Words of a reference shard: its automaton has at most twice as many states.
SHARD_WORDS = 100_000
#: Words of spans that one group streams.
GROUP_WORDS = 1_000_000
SENT = "block int, shard int, keys binary"
ANSWERED = "block int, shard int, firsts binary"
#: Pieces per block in which bytes are counted for the borders, texts per block that choose borders inside a key, and their bytes.
PIECES, CHOSEN, PREFIX = 512, 16, 128
SPANS = "ref int, source int, doc int, start int, n_words int, words binary, reference boolean"


def _sorted(rows: pd.DataFrame, key: str) -> pd.DataFrame:
    """Rows in document order: by key, null first, and by text where keys are equal."""
    return rows.sort_values([key, "text"], na_position="first", kind="stable").reset_index(drop=True)


def _windows(texts, window: int):
    """Hash of every window, the word it starts at, and words per text, with texts one after the other."""
    found, starts, sizes, base = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
    for first, last in chunks(texts):
        words, n = word_hashes(texts[first:last])
        whole = grams(words, window)
        ends = np.cumsum(n)
        room = np.repeat(ends, n)[: len(whole)] - np.arange(len(whole))  # words to the end of the own text
        kept = np.flatnonzero(room >= window)
        found.append(whole[kept])
        starts.append(kept + base)
        sizes.append(n)
        base += len(words)
    return np.concatenate(found), np.concatenate(starts), np.concatenate(sizes)


def _asked(key: str, window: int, shards: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = _sorted(rows, key)
        hashes, _, _ = _windows([bytes(t) for t in rows["text"]], window)
        keys = np.unique(hashes)
        out = [(rows["block"].iloc[0], s, pack_keys(keys[part])) for s, part in shard_slices(keys, shards) if part.stop > part.start]
        return pd.DataFrame(out, columns=["block", "shard", "keys"])

    return run


def _answered(rows: pd.DataFrame) -> pd.DataFrame:
    """Per key of each block: 1 + the first block that has it, 0 where no other block has it."""
    rows = rows.sort_values("block")
    keys, blocks = [unpack_keys(k) for k in rows["keys"]], rows["block"].to_numpy()
    sizes = [len(k) for k in keys]
    _, at, place, n = np.unique(np.concatenate(keys), return_index=True, return_inverse=True, return_counts=True)
    owner = np.repeat(blocks, sizes)
    first = np.where(n > 1, owner[at] + 1, 0)[place]  # blocks ascend, so the first place is the first block
    parts = np.split(first, np.cumsum(sizes)[:-1])
    return pd.DataFrame({"block": blocks, "shard": rows["shard"], "firsts": [pack_numbers(p) for p in parts]})


def _runs(targets: np.ndarray, starts: np.ndarray):
    """(first window, last window) of runs of windows that follow one another in a text and have the same target."""
    if not len(starts):
        return []
    cut = np.flatnonzero((np.diff(starts) != 1) | (np.diff(targets) != 0)) + 1
    return zip(np.concatenate(([0], cut)), np.concatenate((cut, [len(starts)])) - 1, strict=True)


def _places(key_name: str, window: int, rows: pd.DataFrame, answers: pd.DataFrame):
    """Texts of a block, and its spans as (target block, document, first word, words, reference)."""
    rows = _sorted(rows, key_name)
    block, texts = int(rows["block"].iloc[0]), [bytes(t) for t in rows["text"]]
    hashes, starts, sizes = _windows(texts, window)
    _, at, place, n = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    first = np.concatenate([unpack_numbers(f) for f in answers.sort_values("shard")["firsts"]])[place]
    here = (first == 0) | (first == block + 1)
    earliest = at[place] == np.arange(len(hashes))
    of_reference = here & earliest & ((first > 0) | (n[place] > 1))
    repeats = ~here | ~earliest
    target = np.where(here, block, first - 1)
    ends = np.cumsum(sizes)
    owner = np.searchsorted(ends, starts, "right")
    found = []
    for chosen, reference in ((of_reference, True), (repeats, False)):
        which = np.flatnonzero(chosen)
        # a text's number in the target keeps runs of neighbouring texts apart
        for a, b in _runs(target[which] * len(texts) + owner[which], starts[which]):
            doc = int(owner[which[a]])
            begin = int(starts[which[a]] - (ends[doc] - sizes[doc]))
            count = int(starts[which[b]] - starts[which[a]]) + window
            found.append((int(target[which[a]]), doc, begin, count, reference))
    return block, texts, found


def _spans(key_name: str, window: int):
    """The spans of a block: its reference, and what may repeat the reference of an earlier block or its own."""
    columns = ["ref", "source", "doc", "start", "n_words", "words", "reference"]

    def run(key, rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(answers):
            return pd.DataFrame(columns=columns)
        block, texts, found = _places(key_name, window, rows, answers)
        split, out = {}, []
        for target, doc, begin, count, reference in found:
            if doc not in split:
                split = {doc: texts[doc].split()}
            out.append((target, block, doc, begin, count, b" ".join(split[doc][begin: begin + count]), reference))
        return pd.DataFrame(out, columns=columns)

    return run


def _loads(key_name: str, window: int):
    """Words of the spans that a block sends to each reference, every occurrence counted."""
    def run(key, rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        words: dict[int, int] = {}
        if len(rows) and len(answers):
            for target, _, _, count, reference in _places(key_name, window, rows, answers)[2]:
                if not reference:
                    words[target] = words.get(target, 0) + count
        return pd.DataFrame(list(words.items()), columns=["ref", "load"])

    return run


class SuffixAutomaton:
    """All substrings of a sequence of word numbers; states keep length, suffix link and arcs."""

    def __init__(self):
        self.arcs, self.link, self.length, self.last = [{}], [-1], [0], 0

    def add(self, word: int) -> None:
        arcs, link, length = self.arcs, self.link, self.length
        new = len(arcs)
        arcs.append({})
        link.append(0)
        length.append(length[self.last] + 1)
        p = self.last
        while p >= 0 and word not in arcs[p]:
            arcs[p][word] = new
            p = link[p]
        if p >= 0:
            q = arcs[p][word]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(arcs)
                arcs.append(arcs[q].copy())
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and arcs[p].get(word) == q:
                    arcs[p][word] = copy
                    p = link[p]
                link[q] = link[new] = copy
        self.last = new

    def repeated(self, words: list[int], window: int) -> list[tuple[int, int]]:
        """Maximal spans [start, end) whose every word ends or lies in a match of at least ``window`` words."""
        arcs, link, length = self.arcs, self.link, self.length
        spans, state, size = [], 0, 0
        for i, word in enumerate(words):
            while state and word not in arcs[state]:
                state = link[state]
                size = length[state]
            nxt = arcs[state].get(word)
            if nxt is None:
                size = 0
            else:
                state, size = nxt, size + 1
            if size >= window:
                start = i - size + 1
                if spans and start <= spans[-1][1]:
                    spans[-1] = (min(start, spans[-1][0]), i + 1)
                else:
                    spans.append((start, i + 1))
        return spans


def reference_shards(texts: list[list[bytes]], window: int, limit: int = SHARD_WORDS):
    """Automata over at most about ``limit`` words each; a text cut between two shards overlaps by a window less one word."""
    numbers: dict[bytes, int] = {}
    automaton, size = SuffixAutomaton(), 0
    for words in texts:
        at = 0
        while at < len(words):
            part = words[at: at + max(window, limit - size)]
            for w in part:
                automaton.add(numbers.setdefault(w, len(numbers)))
            automaton.add(-1 - size)  # a word that no text has
            size += len(part) + 1
            done = at + len(part) >= len(words)
            at = len(words) if done else at + len(part) - window + 1
            if size >= limit:
                yield automaton, numbers
                automaton, size, numbers = SuffixAutomaton(), 0, {}
    if size:
        yield automaton, numbers


def _confirmed(window: int):
    columns = ["source", "doc", "start", "end"]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        held = rows["reference"].to_numpy(bool)
        references, streamed = rows[held].sort_values(["doc", "start"]), rows[~held]
        out = []
        if len(streamed):
            for automaton, numbers in reference_shards([bytes(w).split() for w in references["words"]], window):
                for source, doc, start, words in zip(streamed["source"], streamed["doc"], streamed["start"], streamed["words"], strict=True):
                    known = [numbers.get(w, -(1 << 60)) for w in bytes(words).split()]
                    out.extend((source, doc, start + a, start + b) for a, b in automaton.repeated(known, window))
        return pd.DataFrame(out, columns=columns)

    return run


def _kept(key_name: str, columns: list[str]):
    def run(key, rows: pd.DataFrame, spans: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame(columns=columns)
        rows = _sorted(rows, key_name)
        of = {doc: list(zip(g["start"], g["end"], strict=True)) for doc, g in spans.groupby("doc")}
        total, removed, kept, merged = [], [], [], []
        for doc, text in enumerate(rows["text"]):
            words = bytes(text).split()
            joined = []
            for a, b in sorted(of.get(doc, ())):
                if joined and a <= joined[-1][1]:
                    joined[-1] = (joined[-1][0], max(b, joined[-1][1]))
                else:
                    joined.append((a, b))
            for a, b in reversed(joined):
                del words[a:b]
            gone = sum(b - a for a, b in joined)
            total.append(len(words) + gone)
            removed.append(gone)
            kept.append(b" ".join(words))
            merged.append([{"start": int(a), "end": int(b)} for a, b in joined])
        out = rows[[key_name]].assign(n_words=total, n_removed=removed, spans=merged)
        if "kept" in columns:
            out["kept"] = kept
        out["kept_sha256"] = [hashlib.sha256(k).hexdigest() for k in kept]
        return out[columns]

    return run


def _inner_borders(df: DataFrame, key: str, text: str, parts: dict, piece: float) -> list[tuple]:
    """(key, start of a text) that cut the rows of each heavy key into about so many parts of even bytes, in the order of texts."""
    heavy = F.col(key).isNull() if None in parts else F.lit(False)
    known = [k for k in parts if k is not None]
    chosen = df.where(heavy | F.col(key).isin(known)).select(
        F.col(key).alias("key"), F.substring(text, 1, PREFIX).alias("start"), _pieces(text, piece).alias("n")).where("n > 0").collect()
    out = []
    for k, n in parts.items():
        starts = sorted((bytes(r["start"]), r["n"]) for r in chosen if r["key"] == k)
        upto = np.cumsum([w for _, w in starts])
        at = {int(np.searchsorted(upto, upto[-1] * i / n)) for i in range(1, n)} if len(starts) else ()
        out += [(k, start) for start in sorted({starts[i][0] for i in at})]
    return out


def _pieces(text: str, piece: float) -> Column:
    """Bytes of a text in pieces, up or down to a whole number by chance, so that sums are right."""
    return F.floor(F.octet_length(text) / F.lit(float(piece)) + F.rand(29)).cast("int")


def document_blocks(df: DataFrame, key: str, text: str, blocks: int, total: int) -> Column:
    """Block of a row, rising with the key and by text within a key, null first; borders are quantiles of the texts' bytes.

    A key that fills blocks of its own, or null, is cut at texts. Borders only
    say where blocks end; what is removed doesn't depend on them. Texts of one
    key that agree in their first PREFIX bytes stay together.
    """
    if blocks == 1:
        return F.lit(0)
    piece = max(1.0, total / (blocks * PIECES))
    parts = [i / blocks for i in range(1, blocks)]
    weighed = df.select(key, F.explode(F.array_repeat(F.lit(True), _pieces(text, piece))))
    found = weighed.agg(F.percentile_approx(key, parts, 10 * max(1000, blocks)).alias("b"), F.count(F.when(F.col(key).isNull(), 1)).alias("n")).first()
    borders = found["b"] or []
    heavy = {k: borders.count(k) + 1 for k in sorted(set(borders)) if borders.count(k) > 1}
    if found["n"] > PIECES:
        heavy[None] = -(-found["n"] // PIECES)
    number = F.lit(0)
    if borders:
        light = F.array(*[F.lit(b) for b in sorted(set(borders))])
        number = F.coalesce(F.size(F.filter(light, lambda b: b < F.col(key))), F.lit(0))
    for k in heavy:  # rows of the key after those of smaller keys
        number += F.when(F.col(key).isNotNull() if k is None else F.col(key) >= F.lit(k), 1).otherwise(0)
    for k, start in _inner_borders(df, key, text, heavy, total / (blocks * CHOSEN)) if heavy else ():
        later = F.col(key).isNotNull() if k is None else F.coalesce(F.col(key) > F.lit(k), F.lit(False))
        number += F.when(later | (F.col(key).eqNullSafe(F.lit(k)) & (F.col(text) >= F.lit(start))), 1).otherwise(0)
    return number


def remove_repeats(df: DataFrame, key: str, text: str, window: int = 20, with_text: bool = False) -> DataFrame:
    """Per row: ``key``, ``n_words``, ``n_removed``, removed ``spans`` [start, end) in words and ``kept_sha256``; on request ``kept``.

    A word is removed if a window of ``window`` consecutive words that covers it
    also starts earlier: in a row with a smaller key, or earlier in the same row;
    windows are those of the input. ``key`` is a number; rows of equal keys
    follow one another by text, a null key comes first. A null or empty text has
    no words and stays as it is; texts shorter than a window lose nothing;
    repeated rows lose all windows but in the first copy; very long texts are
    searched whole. An empty table gives an empty result, other columns are ignored.
    """
    given = df.select(F.col(key), utf8(text).alias("text"))
    total = text_bytes(given, "text")
    blocks, shards = number_of_blocks(total)
    rows = dealt(given, document_blocks(given, key, "text", blocks, total), blocks)
    asked = rows.groupBy("block").applyInPandas(_asked(key, window, shards), SENT)
    answers = asked.groupBy("shard").applyInPandas(_answered, ANSWERED)
    told = rows.groupBy("block").cogroup(answers.groupBy("block"))
    spans = told.applyInPandas(_spans(key, window), SPANS)
    # words of the spans that go to each reference: so many groups share them; a row for each busy reference
    loads = told.applyInPandas(_loads(key, window), "ref int, load bigint").groupBy("ref").agg(
        F.ceil(F.sum("load") / GROUP_WORDS).cast("int").alias("groups")).where("groups > 1")
    wide = spans.join(F.broadcast(loads), "ref", "left").withColumn("groups", F.coalesce("groups", F.lit(1)))
    own = F.pmod(F.xxhash64("source", "doc", "start"), F.col("groups")).cast("int")
    spread = wide.withColumn("group", F.explode(F.when(F.col("reference"), F.sequence(F.lit(0), F.col("groups") - 1)).otherwise(F.array(own))))
    confirmed = spread.drop("groups").groupBy("ref", "group").applyInPandas(_confirmed(window), "source int, doc int, start int, end int")
    columns = [key, "n_words", "n_removed", "spans", *["kept"] * with_text, "kept_sha256"]
    kinds = {"n_words": T.LongType(), "n_removed": T.LongType(), "kept": T.BinaryType(), "kept_sha256": T.StringType(),
             "spans": T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))}
    schema = T.StructType([given.schema[key] if c == key else T.StructField(c, kinds[c]) for c in columns])
    done = rows.groupBy("block").cogroup(confirmed.withColumnRenamed("source", "block").groupBy("block")).applyInPandas(_kept(key, columns), schema)
    return done.withColumn("kept", F.col("kept").cast("string")) if with_text else done
