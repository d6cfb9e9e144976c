"""Benchmark decontamination by Wu-Manber search for many word windows at once.

The patterns of one length share a shift table over blocks of two words: it says
how far the search may jump because no pattern has the block nearer to its end.
Where the jump is zero, the bucket of that last block, split by first block,
names the few patterns to compare word by word.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.common import opened, shipped, utf8
from spanloom.session import cut_lineage

#: Benchmark text searched for in one pass; a larger benchmark takes more passes.
PASS_BYTES = 2 << 20
#: Parts by hash for each pass; passes are runs of parts, cut by their bytes.
PARTS = 64
#: Passes in one stage before the rows are written, so that a task holds few tables at a time.
PASSES_PER_STAGE = 4
SPANS = "array<struct<start:int,end:int>>"


def _word_bytes() -> bytes:
    """Byte table: digits, lower-case letters and all bytes of non-ASCII characters stay, A-Z goes to lower case, the rest to space."""
    table = bytearray(b" " * 256)
    for b in range(256):
        c = chr(b)
        if b >= 0x80 or "0" <= c <= "9" or "a" <= c <= "z":
            table[b] = b
        elif "A" <= c <= "Z":
            table[b] = b + 32
    return bytes(table)


class Patterns:
    """Windows of a block of benchmark items; the search tables are built once in each worker."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.items, self.window, self.built = items, window, None

    def tables(self):
        if self.built is None:
            table, owners = _word_bytes(), {}
            for item, text in self.items:
                words = text.translate(table).split()
                width = min(self.window, len(words))
                for s in range(len(words) - width + 1 if words else 0):
                    owners.setdefault(tuple(words[s: s + width]), set()).add(item)
            by_length = {}
            for pattern, who in owners.items():
                by_length.setdefault(len(pattern), []).append((pattern, who))
            self.built = [(m, *_tables(m, found)) for m, found in sorted(by_length.items())]
        return self.built


def _tables(m: int, patterns):
    """Block width, jump without a known block, shift table, buckets."""
    width = min(2, m)
    shift, buckets = {}, {}
    for pattern, who in patterns:
        for end in range(width, m + 1):
            block = pattern[end - width: end]
            shift[block] = min(shift.get(block, m), m - end)
        buckets.setdefault(pattern[m - width:], {}).setdefault(pattern[:width], []).append((list(pattern), who))
    return width, m - width + 1, shift, buckets


def _search(words, built, spans: list, items: set) -> None:
    for m, width, free, shift, buckets in built:
        i, n = m - 1, len(words)
        while i < n:
            block = tuple(words[i - width + 1: i + 1])
            jump = shift.get(block, free)
            if jump:
                i += jump
                continue
            start = i - m + 1
            for pattern, who in buckets[block].get(tuple(words[start: start + width]), ()):
                if words[start: i + 1] == pattern:
                    spans.append((start, i + 1))
                    items |= who
            i += 1


def merged(spans) -> list[tuple[int, int]]:
    """Sorted spans with overlapping and touching ones joined."""
    out = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _scan(patterns):
    def run(batches):
        built, table = opened(patterns).tables(), _word_bytes()
        for batch in batches:
            counts, all_spans, all_items = [], [], []
            for text, old, known in zip(batch["text"], batch["spans"].to_pylist(), batch["items"].to_pylist(), strict=True):
                words = text.as_py().translate(table).split()
                spans, items = [(s["start"], s["end"]) for s in old], set(known)
                _search(words, built, spans, items)
                counts.append(len(words))
                all_spans.append([{"start": s, "end": e} for s, e in merged(spans)])
                all_items.append(sorted(items))
            done = [batch["row"], batch["text"], pa.array(counts, pa.int64()), pa.array(all_spans, batch.schema.field("spans").type),
                    pa.array(all_items, batch.schema.field("items").type)]
            yield pa.RecordBatch.from_arrays(done, names=["row", "text", "n_words", "spans", "items"])

    return run


def pass_borders(sizes: dict[int, int], parts: int) -> list[int]:
    """First part of every pass and the end: a pass takes parts until the next one's bytes would go beyond PASS_BYTES."""
    borders, taken = [0], 0
    for part, size in sorted(sizes.items()):
        if taken and taken + size > PASS_BYTES:
            borders.append(part)
            taken = 0
        taken += size
    return [*borders, parts]


def contaminated_spans(docs: DataFrame, bench: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
                       window: int = 10) -> DataFrame:
    """``row`` (struct of all input columns), ``n_words``, ``spans`` of hit words [start, end) and sorted ``items``.

    Words are runs of ASCII digits and letters, in lower case, and of non-ASCII
    characters. A pattern is ``window`` consecutive words of an item, or the
    whole of a shorter one; a document word inside any occurrence is hit. Null
    and empty texts have no words, items without words have no pattern, an item
    with a null id goes by "null", repeated items count once by their id, and
    without items nothing is hit. Very long texts are searched whole.
    """
    spark = docs.sparkSession
    given = bench.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("item"), utf8(item_text).alias("body"))
    given = cut_lineage(given.distinct(), "items")
    total = given.agg(F.sum(F.octet_length("body").cast("bigint"))).first()[0] or 0
    parts = PARTS * max(1, -(-total // PASS_BYTES))
    given = given.withColumn("part", F.pmod(F.xxhash64("item", "body"), F.lit(parts)))
    sizes = given.groupBy("part").agg(F.sum(F.octet_length("body").cast("bigint")).alias("n")).collect()
    borders = pass_borders({r["part"]: r["n"] for r in sizes}, parts)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), utf8(text).alias("text")).select(
        "row", "text", F.lit(0).cast("bigint").alias("n_words"), F.array().cast(SPANS).alias("spans"),
        F.array().cast("array<string>").alias("items"))
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema.fields])
    passes = len(borders) - 1
    for k in range(passes):
        # at most PASS_BYTES of items unless one part is larger, sent to every worker
        part = given.where((F.col("part") >= borders[k]) & (F.col("part") < borders[k + 1])).collect()
        patterns = shipped(spark, Patterns([(r["item"], bytes(r["body"])) for r in part], window))
        rows = rows.mapInArrow(_scan(patterns), schema)
        if k % PASSES_PER_STAGE == PASSES_PER_STAGE - 1 and k + 1 < passes:
            rows = cut_lineage(rows, "hits")
    return rows.drop("text")


def hit_words(spans) -> Column:
    """Number of words in merged spans."""
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
