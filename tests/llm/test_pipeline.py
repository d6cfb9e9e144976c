import re
import zlib

import pytest

import corpus_pipeline as pipeline
from conftest import SF
from spanloom.llm import order_minhash, wumanber


# ---- the stages in plain Python, without the operators ----

def words_of(text, keep_case=False):
    cut = re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", text)
    return cut if keep_case else [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in cut]


def edit_distance(a, b, most):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i] + [most + 1] * len(b)
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            now[j] = min(before[j] + 1, now[j - 1] + 1, before[j - 1] + (x != b[j - 1]))
        if min(now) > most:
            return most + 1
        before = [v if abs(i - j) <= most else most + 1 for j, v in enumerate(now)]
    return before[-1]


def plain_near_duplicates(docs):
    """Smallest id of each class of texts alike in 80 % of the longer one's words; pairs need a run of five words in common."""
    words = {r.doc_id: words_of(r.text) for r in docs}
    runs, root = {}, {d: d for d in words}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for d, w in words.items():
        for run in {tuple(w[i:i + 5]) for i in range(len(w) - 4)}:
            runs.setdefault(run, []).append(d)
    pairs = {(a, b) for members in runs.values() for a in members for b in members if a < b}
    same = {}
    for d, w in words.items():
        pairs.add((same.setdefault(tuple(w), d), d))
    for a, b in sorted(pairs):
        x, y = words[a], words[b]
        most = int(0.2 * max(len(x), len(y)) + 1e-9)
        if a != b and find(a) != find(b) and abs(len(x) - len(y)) <= most and edit_distance(x, y, most) <= most:
            first, last = sorted((find(a), find(b)))
            root[last] = first
    return {d for d in words if find(d) == d}


def plain_decontamination(docs, items):
    windows = {}
    for item in items:
        w = words_of(item.text or "")
        n = min(10, len(w))
        for i in range(len(w) - n + 1) if w else ():
            windows.setdefault(n, set()).add(tuple(w[i:i + n]))
    clean = set()
    for r in docs:
        w = words_of(r.text)
        if not any(tuple(w[i:i + n]) in found for n, found in windows.items() for i in range(len(w) - n + 1)):
            clean.add(r.doc_id)
    return clean


def plain_mix(docs, budget_share=1.5, most=2.0):
    """Words of each document and source, and each source's target."""
    size = {r.doc_id: len(re.findall(r"[^ \t-\r]+", r.text)) for r in docs}
    by_source = {}
    for r in docs:
        by_source.setdefault(r.source, []).append(r.doc_id)
    names = sorted(by_source)
    weight = {n: [3.0, 1.0, 2.0][i % 3] for i, n in enumerate(names)}
    total = {n: sum(size[d] for d in by_source[n]) for n in names}
    budget, target, open_ = budget_share * sum(total.values()), {}, set(names)
    while open_:
        level = (budget - sum(target.values())) / sum(weight[n] for n in open_)
        full = {n for n in open_ if level * weight[n] > most * total[n]}
        if not full:
            target |= {n: level * weight[n] for n in open_}
            break
        target |= {n: most * total[n] for n in full}
        open_ -= full
    return size, total, target, by_source


def test_near_duplicates_equal_all_pairs(spark, table):
    docs = table("documents").collect()
    kept = {r.doc_id for r in pipeline.near_duplicates(spark, table("documents"), SF).collect()}
    assert kept == plain_near_duplicates(docs) and len(kept) < len(docs)


def test_decontamination_equals_sets_of_windows(spark, table):
    docs = table("documents").collect()
    kept = {r.doc_id for r in pipeline.decontamination(spark, table("documents"), SF).collect()}
    assert kept == plain_decontamination(docs, table("benchmark").collect()) and len(kept) < len(docs)


def test_mixture_takes_the_targets(spark, table):
    docs = table("documents").collect()
    size, total, target, by_source = plain_mix(docs)
    copies = {}
    for r in pipeline.mixture(spark, table("documents"), SF).collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert max(copies.values()) <= 2
    longest = max(size.values())
    for name, ids in by_source.items():
        taken = sum(size[d] * copies.get(d, 0) for d in ids)
        assert abs(taken - target[name]) <= 2 * longest
        assert taken <= 2 * total[name]


def test_shards_are_even_and_near(spark, table):
    """Leaves of a k-d tree: bytes even, checksums right, slots gapless, copies together."""
    docs = {r.doc_id: r.text.encode() for r in table("documents").collect()}
    rows = pipeline.kdtree.kd_shards(table("documents"), "doc_id", "text", ["lang", "source"], target_bytes=60_000).collect()
    count = max(1, -(-sum(len(t) + 1 for t in docs.values()) // 60_000))
    load = [0] * count
    for r in rows:
        assert (r.size, r.text_crc32) == (len(docs[r.doc_id]) + 1, zlib.crc32(docs[r.doc_id]))
        load[r.shard] += r.size
    assert max(load) - min(load) <= 2 * max(map(len, docs.values()))
    for shard in range(count):
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))


def test_run_goes_through_all_stages(spark, table):
    rows = pipeline.run(spark, SF).collect()
    assert rows[0].asDict().keys() >= {"doc_id", "size", "text_crc32", "shard", "slot"}
    assert {r.doc_id for r in rows} <= {r.doc_id for r in table("documents").collect()}


def test_pipeline_stages(spark, table):
    docs, kept = table("documents"), {}
    for name, stage in pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == table("documents").columns
        rows = after.collect()
        known = {r.doc_id: r for r in docs.collect()}
        assert rows and all(known[r.doc_id] == r for r in rows)
        kept[name] = rows
        docs = spark.createDataFrame(rows, table("documents").schema)
    classes = order_minhash.near_classes(spark.createDataFrame(kept["language_id"], docs.schema), "doc_id", "text").collect()
    assert sorted(r.doc_id for r in kept["near_duplicates"]) == sorted({r.class_id for r in classes})
    hits = {r.row.doc_id for r in wumanber.contaminated_spans(
        spark.createDataFrame(kept["near_duplicates"], docs.schema), table("benchmark")).collect() if r.spans}
    assert {r.doc_id for r in kept["decontamination"]} == {r.doc_id for r in kept["near_duplicates"]} - hits and hits
    copies = [r.doc_id for r in kept["mixing"]]
    assert max(map(copies.count, set(copies))) == 2 and set(copies) <= {r.doc_id for r in kept["decontamination"]}
    placed = pipeline.shards(spark, docs, SF).collect()
    assert sorted(r.doc_id for r in placed) == sorted(copies)


@pytest.mark.parametrize("stage", [s for _, s in pipeline.STAGES])
def test_stages_with_odd_rows(spark, table, stage):
    """Nulls, empty texts, repeated rows, an empty table and further columns."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, __copies int, size int"
    rows = [(1, "some words in here", "en", "s", 18, 1, 1), (1, "some words in here", "en", "s", 18, 1, 1), (2, None, None, None, None, 1, 1),
            (3, "", "en", "s", 0, 1, 1), (None, "other words are there", "en", None, 21, 1, 1), (4, "### 12", None, "t", 6, 1, 1),
            (5, "word " * 20_000, "en", "t", 100_000, 1, 1)]
    out = stage(spark, spark.createDataFrame(rows, schema), SF)
    assert len(out.collect()) >= 3
    if stage is not pipeline.shards:
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "__copies", "size"]
    assert stage(spark, spark.createDataFrame([], schema), SF).collect() == []
