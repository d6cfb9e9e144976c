"""Every registered query of the subpackage against its SQL, and the others against brute force on the small tables."""

import zlib

import numpy as np
import pytest

import __spark_entry__ as entries
from compare import differences
from conftest import SF
from spanloom.llm import order_minhash, queries
from spanloom.llm.common import word_hashes

WITH_SQL = sorted(n for n, (_, sql) in queries.QUERIES.items() if sql)


@pytest.mark.parametrize("name", WITH_SQL)
def test_query_equals_its_sql(spark, name):
    run, sql = queries.QUERIES[name]
    assert differences(run(spark, SF), SF, sql) is None


def test_all_are_registered():
    names = set(entries.queries())
    assert {f"op{n}_" for n in range(1, 14)} == {n.split("_")[0] + "_" for n in names if n.startswith("op")}
    assert "pipeline" in names


def documents(table):
    return table("documents").collect()


def test_shards_are_even_whole_and_gapless(spark, table):
    texts = {r.doc_id: (r.text or "").encode() for r in documents(table)}
    rows = queries.QUERIES["op9_kd_shards"][0](spark, SF).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    load = np.zeros(8)
    for r in rows:
        assert r.size == len(texts[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id])
        assert r.law == "bytes" and r.grown_shard is None
        load[r.shard] += r.size
    for shard in range(8):
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    assert load.max() - load.min() <= 2 * max(map(len, texts.values()))


def test_near_classes_equal_brute_force(spark, table):
    words = {r.doc_id: word_hashes([r.text.encode().translate(order_minhash.word_bytes())])[0] for r in documents(table)}
    runs = {d: set(order_minhash.labelled_runs(w).tolist()) for d, w in words.items()}
    root = {d: d for d in words}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(words)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            same = np.array_equal(words[a], words[b])
            if same or runs[a] & runs[b] and order_minhash.similar([(words[a].astype(np.uint32), words[b].astype(np.uint32))])[0]:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: r.class_id for r in queries.QUERIES["op3_order_minhash"][0](spark, SF).collect()}
    assert got == {d: find(d) for d in ids}
    assert len(set(got.values())) < len(got)


def test_quality_on_held_out_rows(spark):
    folder = SF.replace("0.001", "0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = queries.QUERIES["op4_quality"][0](spark, folder).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p == y for p, y in held) >= 0.9 * len(held)


def test_language_on_held_out_rows(spark, table):
    langs = {r.doc_id: r.lang for r in documents(table)}
    rows = queries.QUERIES["op8_ppm_language"][0](spark, SF).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.9 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)
