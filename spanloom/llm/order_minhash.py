"""Near-duplicate classes by order min-hash sketches and banded alignment.

A text's runs of five words are labelled with their occurrence. For each of 24
hash functions the three smallest are taken and kept in text order: two texts
share such a sketch only if the same runs stand in the same order, so sketches
follow edit similarity, which min-hash alone does not. Texts that share a sketch
meet through a leader of that bucket, texts under different leaders only if their
lengths and words allow them to be alike, and every candidate pair is verified by an alignment of its words within a band around the diagonal.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.common import chunks, grams, mixed, utf8, word_hashes
from spanloom.session import cut_lineage

SHINGLE = 5
SAMPLED = 3
SKETCHES = 24
SIMILARITY = 0.8
#: Numbers worked on at a time, in sketches and in alignments.
CELLS = 1 << 19
FAR = 1 << 28
#: Bits for the words of a text.
BITS = 8192
#: Texts of a bucket that a task compares by their bits with as many others.
TOGETHER = 512


def word_bytes() -> bytes:
    """Byte table: digits, letters in lower case and bytes of non-ASCII characters; all else ends a word."""
    table = bytearray(b" " * 256)
    for b in range(256):
        c = chr(b)
        if b >= 0x80 or "0" <= c <= "9" or "a" <= c <= "z":
            table[b] = b
        elif "A" <= c <= "Z":
            table[b] = b + 32
    return bytes(table)


def labelled_runs(words: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """Hash of every run of words together with how often the run has stood before."""
    runs = grams(words, width)
    order = np.argsort(runs, kind="stable")
    ordered = runs[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1])) if len(runs) else np.empty(0, bool)
    first = np.maximum.accumulate(np.where(new, np.arange(len(runs)), 0))
    seen = np.empty(len(runs), np.uint64)
    seen[order] = (np.arange(len(runs)) - first).astype(np.uint64)
    return mixed(runs + seen * np.uint64(0x9E3779B97F4A7C15))


def sketches(words: np.ndarray) -> np.ndarray:
    """Order min-hash sketches of a text; none for a text of fewer words than a run."""
    runs = labelled_runs(words)
    if not len(runs):
        return np.empty(0, np.int64)
    seeds = mixed(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    taken = min(SAMPLED, len(runs))
    out = []
    step = max(1, CELLS // len(runs))
    for first in range(0, SKETCHES, step):
        some = seeds[first: first + step, None]
        values = (runs[None, :] ^ some) * (some | np.uint64(1))
        values ^= values >> np.uint64(32)
        places = np.argpartition(values, taken - 1, axis=1)[:, :taken] if taken < len(runs) else np.tile(np.arange(len(runs)), (len(some), 1))
        chosen = runs[np.sort(places, axis=1)]
        total = some[:, 0].copy()
        for k in range(taken):
            total = mixed(total * np.uint64(0x9FB21C651E98DF25) + chosen[:, k])
        out.append(total)
    return np.concatenate(out).view(np.int64)


def word_bits(words: np.ndarray) -> np.ndarray:
    """A bit for every word of a text together with how often it has stood before, among BITS."""
    marked = np.zeros(BITS, np.uint8)
    marked[(labelled_runs(words, 1) >> np.uint64(20)) % np.uint64(BITS)] = 1
    return np.packbits(marked, bitorder="little").view(np.int64)


def _marked(batches):
    for rows in batches:
        bits = [word_bits(np.frombuffer(w, np.uint32).astype(np.uint64)) for w in rows["words"]]
        yield pd.DataFrame({"node": rows["node"], "bits": bits, "used": [int(np.bitwise_count(b.view(np.uint64)).sum()) for b in bits]})


def _named(texts, table: bytes):
    """Word hashes of each text and its node, the digest of its words; a text without any word goes by its bytes."""
    raw = [bytes(t) for t in texts]
    plain = [t.translate(table) for t in raw]
    for first, last in chunks(plain):
        hashes, n = word_hashes(plain[first:last])
        for i, words in enumerate(np.split(hashes, np.cumsum(n)[:-1]), first):
            content = b"w" + words.tobytes() if len(words) else b"t" + raw[i]
            yield words, hashlib.blake2b(content, digest_size=16).digest()


def _sketched(key: str):
    def run(batches):
        table = word_bytes()
        for rows in batches:
            nodes, counts, found = [], [], []
            for words, node in _named(rows["text"], table):
                nodes.append(node)
                counts.append(len(words))
                found.append(sketches(words))
            yield pd.DataFrame({key: rows[key], "node": nodes, "n_words": counts, "sketches": found})

    return run


def _word_numbers(batches):
    """Words as 32-bit numbers, for alignment; texts of other nodes under the same key are left out."""
    table = word_bytes()
    for rows in batches:
        same = [(n, w.astype(np.uint32).tobytes()) for n, (w, found) in zip(rows["node"], _named(rows["text"], table), strict=True) if bytes(n) == found]
        yield pd.DataFrame(same, columns=["node", "words"])


def _trimmed(a: np.ndarray, b: np.ndarray):
    """Both without their common start and end."""
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    start = n if same.all() else int(same.argmin())
    a, b = a[start:], b[start:]
    n = min(len(a), len(b))
    if n:
        same = a[::-1][:n] == b[::-1][:n]
        end = n if same.all() else int(same.argmin())
        a, b = a[: len(a) - end], b[: len(b) - end]
    return a, b


def _banded(pairs, band: int) -> np.ndarray:
    """Edit distance of pairs whose lengths differ by at most ``band``, or more than the band if it is larger."""
    count, width = len(pairs), 2 * band + 1
    n = np.array([len(a) for a, _ in pairs])
    m = np.array([len(b) for _, b in pairs])
    left = np.full((count, n.max() + 1), -1, np.int64)
    right = np.full((count, n.max() + width + 1), -2, np.int64)
    for i, (a, b) in enumerate(pairs):
        left[i, : len(a)] = a
        right[i, band: band + min(len(b), right.shape[1] - band)] = b[: right.shape[1] - band]
    steps = np.arange(width)
    rows = np.repeat(np.where(steps >= band, steps - band, FAR)[None, :], count, axis=0)
    out = np.full(count, band + 1)
    live = np.arange(count)
    for i in range(n.max() + 1):
        if i:
            new = rows + (right[:, i - 1: i - 1 + width] != left[:, i - 1: i])
            new[:, :-1] = np.minimum(new[:, :-1], rows[:, 1:] + 1)
            rows = np.minimum.accumulate(new - steps, axis=1) + steps
        ended = np.flatnonzero(n[live] == i)
        if len(ended):
            out[live[ended]] = rows[ended, (m - n)[live[ended]] + band]
        if len(ended) or i % 32 == 31:
            going = (n[live] > i) & (rows.min(axis=1) <= band)
            if not going.all():
                live, rows, left, right = live[going], rows[going], left[going], right[going]
            if not len(live):
                break
    return out


def similar(pairs, similarity: float = SIMILARITY) -> np.ndarray:
    """Whether 1 - edit distance / longer length is at least ``similarity``, for pairs of word arrays.

    The band is widened until the distance lies inside it or the pair can't
    be similar any more.
    """
    allowed = np.array([int((1 - similarity) * max(len(a), len(b)) + 1e-9) for a, b in pairs])
    trimmed = [_trimmed(a, b) for a, b in pairs]
    out = np.zeros(len(pairs), bool)
    open_pairs = []
    for i, (a, b) in enumerate(trimmed):
        if abs(len(a) - len(b)) > allowed[i]:
            continue
        if not len(a) or not len(b):
            out[i] = max(len(a), len(b)) <= allowed[i]
        else:
            open_pairs.append(i)
    band = 4
    while open_pairs:
        # each pair in the widest band that it may use now
        now = [(min(band, int(allowed[i])), max(len(x) for x in trimmed[i]), i) for i in open_pairs]
        open_pairs = [i for b, _, i in now if abs(len(trimmed[i][0]) - len(trimmed[i][1])) > b]
        fit = sorted(t for t in now if abs(len(trimmed[t[2]][0]) - len(trimmed[t[2]][1])) <= t[0])
        at = 0
        while at < len(fit):
            width = fit[at][0]
            end = at + 1
            while end < len(fit) and fit[end][0] == width and (end + 1 - at) * (2 * width + 1 + 2 * fit[end][1]) <= CELLS:
                end += 1
            some = [i for _, _, i in fit[at:end]]
            for i, d in zip(some, _banded([trimmed[i] for i in some], width), strict=True):
                if d <= width:
                    out[i] = d <= allowed[i]
                elif width < allowed[i]:
                    open_pairs.append(i)
            at = end
        band *= 4
    return out


def _verified(similarity: float):
    def run(batches):
        for rows in batches:
            pairs = [(np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)) for a, b in zip(rows["words"], rows["leader_words"], strict=True)]
            good = similar(pairs, similarity)
            yield rows[["node", "leader"]].assign(good=good)

    return run


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (smallest node of its component) for all nodes of ``a``-``b`` links.

    Large-star and small-star steps, each a minimum per node and a join, until
    every node points at its root; the links are written after each round.
    """
    edges = cut_lineage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a").select(F.explode(F.array(
            F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e")).select("e.*")
        after = cut_lineage(small.where("a <> b").distinct(), "links")
        # finished when every node has one link and no root has a larger neighbour of its own
        roots = after.select(F.col("b").alias("a")).distinct()
        if after.groupBy("a").count().where("count > 1").isEmpty() and after.join(roots, "a", "left_semi").isEmpty():
            return after.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                roots.select(F.col("a").alias("node"), F.col("a").alias("root")))
        edges = after


def _placed(nodes: DataFrame) -> DataFrame:
    """Every bucket entry (bucket, node, n_words, weight) with the bucket's leader, written once.

    The weight of a text is the number of texts in all its buckets; the leader
    is the heaviest, so that a group of copies with changes in different places
    meets at the text most of them come from.
    """
    buckets = nodes.select("node", F.explode("sketches").alias("bucket"))
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("n"))
    weights = buckets.join(sizes, "bucket").groupBy("node").agg(F.sum("n").alias("weight"))
    entries = nodes.join(weights, "node").select("node", "n_words", "weight", F.explode("sketches").alias("bucket"))
    first = entries.groupBy("bucket").agg(F.min(F.struct(-F.col("weight"), "node", "n_words")).alias("l"))
    leaders = first.select("bucket", F.col("l.node").alias("leader"), F.col("l.n_words").alias("leader_n"))
    return cut_lineage(entries.join(leaders, "bucket"), "placed")


def _pairs(met: DataFrame, similarity: float) -> tuple[DataFrame, Column]:
    """Distinct pairs of a text and a leader, and whether their lengths allow them to be alike."""
    pairs = met.where("node <> leader").select(
        F.greatest("node", "leader").alias("node"), F.least("node", "leader").alias("leader"),
        F.greatest("n_words", "leader_n").alias("longer"), F.least("n_words", "leader_n").alias("shorter")).distinct()
    return pairs, F.col("longer") - F.col("shorter") <= (1 - similarity) * F.col("longer") + 1e-9


def _tried(pairs: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """Pairs (node, leader) and whether they are alike, written once."""
    texts = pairs.select("node", "leader").join(words, "node").join(
        words.select(F.col("node").alias("leader"), F.col("words").alias("leader_words")), "leader")
    return cut_lineage(texts.select("node", "leader", "words", "leader_words").mapInPandas(
        _verified(similarity), "node binary, leader binary, good boolean"), "tried")


def _crossing(similarity: float):
    """Pairs of a text and another of its bucket, in different components, that can be alike by length and by words in common.

    An edit takes one word at most from what both have. Common words share a
    bit, except for as many as share it with another word of their text. A pair
    with several buckets in common is given by the smallest of them.
    """
    columns = ["node", "n_words", "leader", "leader_n"]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            bucket = int(right["bucket"].iloc[0])
            right = right.sort_values("n_words")
            bits, n, roots = np.stack(right["bits"].to_list()), right["n_words"].to_numpy(), right["root"].to_numpy()
            spare, nodes, sketched = n - right["used"].to_numpy(), right["node"].to_numpy(), right["sketches"].to_list()
            most = right["most"].iloc[0]
            for node, size, own, used, root, mine in left[["node", "n_words", "bits", "used", "root", "sketches"]].itertuples(index=False, name=None):
                lengths = slice(*np.searchsorted(n, [int(size * similarity - 1e-9), int(size / similarity + 1e-9) + 1]))
                near = np.flatnonzero(roots[lengths] != root) + lengths.start
                longer = np.maximum(n[near], size)
                near = near[longer - np.minimum(n[near], size) <= (1 - similarity) * longer + 1e-9]
                shared = np.bitwise_count((bits[near] & np.asarray(own)).view(np.uint64)).sum(axis=1, dtype=np.int64)
                near = near[shared + np.minimum(size - used, spare[near]) >= similarity * np.maximum(n[near], size) - 1e-9]
                for i in near.tolist():
                    # both outside of the bucket's largest component: this task and its mirror image see the pair
                    if (roots[i] == most or node > nodes[i]) and min(set(mine.tolist()).intersection(sketched[i].tolist())) == bucket:
                        out.append((node, size, nodes[i], n[i]))
        return pd.DataFrame(out, columns=columns)

    return run


def _between(placed: DataFrame, nodes: DataFrame, words: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """Pairs of a bucket whose texts lie in different components and can be alike.

    One of such a pair is outside of its bucket's largest component. These
    entries meet all of the bucket; large buckets are cut on both sides, so that
    a task compares a part with a part.
    """
    rooted = placed.select("bucket", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    by_root = rooted.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    sizes = by_root.groupBy("bucket").agg(
        F.max_by("root", F.struct("n", "root")).alias("most"), F.sum("n").alias("n"), F.max("n").alias("inside")).where("inside < n")
    parts = lambda n: F.ceil(F.col(n) / TOGETHER).cast("int")
    sizes = sizes.withColumn("rows", F.ceil((F.col("n") - F.col("inside")) / TOGETHER).cast("int")).withColumn("parts", parts("n"))
    entries = cut_lineage(rooted.join(sizes.select("bucket", "most", "rows", "parts"), "bucket"), "mixed")
    marked = words.join(entries.select("node").distinct(), "node").mapInPandas(_marked, "node binary, bits array<bigint>, used int")
    entries = cut_lineage(entries.join(nodes.select("node", "n_words", "sketches"), "node").join(marked, "node"), "crossing")
    place = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = entries.where("root <> most").withColumn("row", place("rows", 1)).withColumn("part", every("parts"))
    again = entries.select(*[F.col(c).alias(c) for c in entries.columns])
    right = again.withColumn("part", place("parts", 2)).withColumn("row", every("rows"))
    keys = ["bucket", "row", "part"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        _crossing(similarity), "node binary, n_words int, leader binary, leader_n int")


def _links(placed: DataFrame, words: DataFrame, similarity: float, nodes: DataFrame | None = None) -> DataFrame:
    """Verified links (a, b): those that make one component of all alike texts that share a bucket.

    ``nodes`` has each text's sketches; without it they are the buckets that hold the text.

    First every text is compared with the leaders of its buckets. What these
    links connect needs no further comparison; texts of one bucket that are still
    in different components are then compared with each other.
    """
    if nodes is None:
        nodes = placed.groupBy("node").agg(F.max("n_words").alias("n_words"), F.collect_set("bucket").alias("sketches"))
    pairs, near = _pairs(placed, similarity)
    good = _tried(cut_lineage(pairs.where(near), "pairs"), words, similarity).where("good").select(
        F.col("node").alias("a"), F.col("leader").alias("b"))
    between, _ = _pairs(_between(placed, nodes, words, components(good), similarity), similarity)
    more = _tried(cut_lineage(between, "pairs"), words, similarity).where("good").select(
        F.col("node").alias("a"), F.col("leader").alias("b"))
    return good.unionByName(more)


def near_classes(df: DataFrame, key: str, text: str, similarity: float = SIMILARITY) -> DataFrame:
    """One row per input row: ``key`` and ``class_id``, the smallest key of its class.

    Texts are alike if the words of one become the other's with at most (1 -
    ``similarity``) × the longer's number of words inserted, deleted or replaced;
    classes are what links of alike texts connect. Words are runs of digits and
    letters, in lower case, so texts that differ in signs and case are copies. A
    null text is alone, empty texts are copies of one another, a text of fewer
    than five words only has copies, long texts are compared whole, repeated rows
    fall in one class, and an empty table gives an empty result. Null keys give
    a class with others the others' key. Other columns are ignored.
    """
    given = df.select(F.col(key), F.col(text).alias("text"))
    schema = T.StructType([given.schema[key], T.StructField("node", T.BinaryType()), T.StructField("n_words", T.IntegerType()),
                           T.StructField("sketches", T.ArrayType(T.LongType()))])
    known = given.where(F.col("text").isNotNull()).select(key, utf8("text").alias("text"))
    rows = cut_lineage(known.mapInPandas(_sketched(key), schema), "sketched")
    nodes = cut_lineage(rows.groupBy("node").agg(F.max("n_words").alias("n_words"), F.first("sketches").alias("sketches")), "nodes")
    placed = _placed(nodes)
    least = rows.groupBy("node").agg(F.min(key).alias("least"))
    in_company = placed.where("node <> leader")
    wanted = in_company.select("node").unionByName(in_company.select(F.col("leader").alias("node"))).distinct().join(least, "node")
    # one row of each node is enough: copies have the same words
    words = cut_lineage(wanted.join(known, F.col("least").eqNullSafe(F.col(key))).select("node", "text").mapInPandas(_word_numbers, "node binary, words binary").dropDuplicates(["node"]), "words")
    roots = components(_links(placed, words, similarity, nodes))
    named = roots.join(least, "node")
    classes = named.join(named.groupBy("root").agg(F.min("least").alias("class_id")), "root").select("node", "class_id")
    of_node = least.join(classes, "node", "left").select("node", F.coalesce("class_id", "least").alias("class_id"))
    return rows.select(key, "node").join(of_node, "node").select(key, "class_id").unionByName(
        given.where(F.col("text").isNull()).select(key, F.col(key).alias("class_id")))
