"""Operators on small rows: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random

import numpy as np
import pytest

from spanloom.llm import automata, backoff, bitslice, kdtree, mixing, order_minhash, packed, ppm, quality, warc, wumanber
from spanloom.llm.common import grams, remainder, word_hashes

WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "su", "te", "vo") for b in ("r", "s", "nd", "ll", "x")]


def text(seed, n):
    pick = random.Random(seed)
    return " ".join(pick.choice(WORDS) + str(pick.randrange(50)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Rows with every odd case, and columns that are named like the operators' own."""
    long = text(1, 30_000)
    rows = [(1, "a", "Hello   world\tagain"), (2, "b", None), (3, None, ""), (4, "a", " \n\t "), (5, "b", long),
            (6, "b", "dup dup dup"), (6, "b", "dup dup dup"), (None, "c", "no id here"), (8, "a", "Ünïcode çase ñandú"), (9, "c", "### $$$")]
    return spark.createDataFrame(
        [(*r, 1, "x", "y", 2) for r in rows],
        "doc_id long, source string, text string, size int, row string, __key string, n_words int")


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("doc_id > 1000")


# ---- words ----

def test_word_hashes_tell_words_apart():
    words, sizes = word_hashes([b"a bb\tccc", b"", b" \n", b"bb a", b"a" * 3_000_000 + b" end"])
    assert sizes.tolist() == [3, 0, 0, 2, 2]
    assert words[0] == words[4] and words[1] == words[3] and len(set(words.tolist())) == 5
    again, _ = word_hashes([b"end"])
    assert again[0] == words[-1]


def test_grams_depend_on_order():
    words, _ = word_hashes([b"a b a b"])
    assert len(set(grams(words, 2).tolist())) == 2 and len(grams(words, 5)) == 0


def test_keys_and_numbers_come_back():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64))
    dense = np.unique(np.random.default_rng(2).integers(0, 1 << 45, 5000).astype(np.uint64))
    for some in (keys, dense, keys[:1], keys[:0]):
        assert np.array_equal(packed.unpack_keys(packed.pack_keys(some)), some)
    parts = packed.shard_slices(keys, 7)
    assert [p.start for _, p in parts][1:] == [p.stop for _, p in parts][:-1] and parts[-1][1].stop == len(keys)
    assert packed.unpack_numbers(packed.pack_numbers(np.arange(9))).tolist() == list(range(9))


# ---- mixing ----

def test_mix_odd_rows(spark, odd, none):
    rows = mixing.mix(odd, "doc_id", "text", "source").collect()
    assert len(rows) == odd.count()
    sizes = {r.doc_id: r["size"] for r in rows}
    assert sizes[2] == sizes[3] == sizes[4] == 0 and sizes[5] == 30_000 and sizes[6] == 3
    assert all(r.taken % max(1, r["size"]) == 0 and r.taken <= 2 * r["size"] for r in rows)
    assert mixing.mix(none, "doc_id", "text", "source").collect() == []


def test_mix_reaches_targets_and_agrees_with_itself(spark):
    pick = random.Random(3)
    rows = [(i, f"s{min(i % 9, 3)}" if i % 11 else None, text(i, pick.randrange(1, 60))) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(df, "doc_id", "text", "source").collect()
    again = mixing.mix(df.repartition(5), "doc_id", "text", "source").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    source = {i: s for i, s, _ in rows}
    for name in set(source.values()):
        own = [r for r in got if source[r.doc_id] == name]
        assert own[0].target <= 2 * own[0].source_size + 1e-6
        assert abs(sum(r.taken for r in own) - own[0].target) <= 2 * 60
    total = sum(r["size"] for r in got)
    assert abs(sum({source[r.doc_id]: r.target for r in got}.values()) - 1.5 * total) < 1e-6 * total


# ---- bit slices ----

def brute_top(vectors, k):
    code = {i: [int(np.floor(np.float64(np.float32(x)) * 256)) for x in v] for i, v in vectors}
    out = {}
    for q in code:
        best = sorted((-sum(a * b for a, b in zip(code[q], code[c], strict=False)), c) for c in code if c != q)[:k]
        out[q] = [(c, -s) for s, c in best]
    return out


def test_top_k_equals_brute_force_with_ties(spark, monkeypatch):
    monkeypatch.setattr(bitslice, "BLOCK", 64)
    monkeypatch.setattr(bitslice, "QUERIES", 16)
    random_ = np.random.default_rng(4)
    vectors = [(i, random_.normal(0, 0.3, 8).astype(np.float32).tolist()) for i in range(200)]
    vectors += [(i, vectors[0][1]) for i in range(200, 290)]  # a large group of ties
    df = spark.createDataFrame(vectors, "vec_id long, v array<float>")
    index = bitslice.written_index(df, "vec_id", "v")
    want = brute_top(vectors, 5)
    got = {}
    for r in bitslice.top_k(index, index.where("key % 20 = 0"), 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == {q: want[q] for q in want if q % 20 == 0}


def test_top_k_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [float("nan"), 1.0]), (3, [float("inf"), 1.0]), (4, [None, 1.0]), (5, [0.5, -0.5]),
            (None, [1.0, 1.0]), (6, []), (7, [-1.0]), (5, [0.5, -0.5])]
    index = bitslice.written_index(spark.createDataFrame(rows, "vec_id long, v array<double>"), "vec_id", "v")
    got = [tuple(r) for r in bitslice.top_k(index, index.where("key = 0"), 5).orderBy("rank").collect()]
    assert got == [(0, 1, None, 65536), (0, 2, 5, 32768), (0, 3, 5, 32768), (0, 4, 7, -65536)]
    empty = index.where("key > 100")
    assert bitslice.top_k(empty, empty, 5).count() == 0


def test_top_k_of_large_components(spark):
    """No finite vector is left out; a score that 64 bits can't hold is an error."""
    rows = [(0, [70_000.0, 1.0]), (1, [70_000.0, 1.0]), (2, [-3e5, 2.5]), (3, [1e9, 0.0]), (4, [0.25, 1e-9]), (5, [0.0, 4e36])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, v array<double>, row int, key string")
    index = bitslice.written_index(df, "vec_id", "v")
    whole = {i: [int(np.floor(x * 256)) for x in v] for i, v in rows}
    for query in (1, 2, 4):
        rows_of = index if query == 4 else index.where("key < 5")
        got = [tuple(r) for r in bitslice.top_k(rows_of, index.where(f"key = {query}"), 3).orderBy("rank").collect()]
        scored = sorted((-sum(a * b for a, b in zip(whole[query], whole[c])), c) for c in whole if c != query and (c < 5 or query == 4))
        assert got == [(query, i, c, -s) for i, (s, c) in enumerate(scored[:3], 1)]
    with pytest.raises(Exception, match="(?i)too large|overflow"):
        bitslice.top_k(index, index.where("key = 5"), 3).collect()


# ---- near duplicates ----

def test_alignment_bands_equal_full_table():
    random_ = random.Random(5)

    def distance(a, b):
        before = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            now = [i]
            for j, y in enumerate(b, 1):
                now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
            before = now
        return before[-1]

    pairs = []
    for n in (0, 1, 4, 9, 30, 120):
        for changes in (0, 1, 3, 8, 25, 60):
            a = [random_.randrange(20) for _ in range(n)]
            b = list(a)
            for _ in range(changes):
                at = random_.randrange(len(b) + 1)
                if random_.random() < 0.5:
                    b.insert(at, random_.randrange(20))
                elif b:
                    del b[min(at, len(b) - 1)]
            pairs.append((np.array(a, np.uint32), np.array(b, np.uint32)))
    want = [distance(a.tolist(), b.tolist()) <= 0.2 * max(len(a), len(b)) + 1e-9 for a, b in pairs]
    assert order_minhash.similar(pairs).tolist() == want


def test_near_classes_odd_rows(spark, odd, none):
    base = text(7, 400).split()
    changed = [*base[:200], "new", *base[203:]]
    moved = [*base[200:], *base[:200]]  # the same runs in another order
    more = spark.createDataFrame(
        [(20, " ".join(base)), (21, " ".join(changed).upper()), (22, " ".join(moved)), (23, text(8, 400)), (24, ""), (25, None)],
        "doc_id long, text string")
    got = order_minhash.near_classes(odd.select("doc_id", "text", "row", "n_words").unionByName(more, allowMissingColumns=True), "doc_id", "text").collect()
    classes = {}
    for r in got:
        classes.setdefault(r.class_id, []).append(r.doc_id)
    assert len(got) == odd.count() + 6
    assert sorted(classes[20]) == [20, 21] and classes[22] == [22] and classes[23] == [23]
    assert sorted(classes[3]) == [3, 24] and classes[2] == [2] and classes[25] == [25] and classes[6] == [6, 6]
    assert classes[None] == [None] and classes[4] == [4] and classes[9] == [9]
    assert order_minhash.near_classes(none, "doc_id", "text").collect() == []


def test_near_classes_of_a_large_group(spark):
    """Every copy differs in a place of its own; leaders must bring all together."""
    base = text(9, 300).split()
    rows = [(i, " ".join([*base[:i], f"own{i}", *base[i + 1:]])) for i in range(290)]
    rows += [(1000 + i, text(1000 + i, 300) + " " + " ".join(base[:60])) for i in range(40)]  # a shared passage is not enough
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {r.doc_id: r.class_id for r in order_minhash.near_classes(df, "doc_id", "text").collect()}
    assert all(got[i] == 0 for i in range(290)) and all(got[1000 + i] == 1000 + i for i in range(40))


@pytest.mark.parametrize("together", [512, 2])
def test_links_between_texts_of_different_leaders(spark, monkeypatch, together):
    """In a bucket of many unlike texts, a is like the first leader, b like a later one; a and b are alike."""
    monkeypatch.setattr(order_minhash, "TOGETHER", together)
    first = np.arange(100, dtype=np.uint32)
    a, b, later = first.copy(), first.copy(), first.copy()
    a[:15] += 1000
    b[:30] += 1000
    later[:45] += 1000
    texts = [first, later, *[np.arange(100, dtype=np.uint32) + 10_000 * i for i in range(1, 8)], a, b]
    rows = [(1, bytes([i]), 100, 1000 - i, b"\x00", 100) for i in range(len(texts))]
    placed = spark.createDataFrame(rows, "bucket long, node binary, n_words int, weight long, leader binary, leader_n int")
    words = spark.createDataFrame([(bytes([i]), w.tobytes()) for i, w in enumerate(texts)], "node binary, words binary")
    links = {frozenset((bytes(r.a)[0], bytes(r.b)[0])) for r in order_minhash._links(placed, words, 0.8).collect()}
    assert links == {frozenset((0, 9)), frozenset((1, 10)), frozenset((9, 10))}


def test_components_of_a_chain(spark):
    links = [(bytes([i]), bytes([i + 1])) for i in range(40)] + [(b"\xf0", b"\xf1"), (b"\xf1", b"\xf0")]
    got = {r.node: r.root for r in order_minhash.components(spark.createDataFrame(links, "a binary, b binary")).collect()}
    assert all(got[bytes([i])] == b"\x00" for i in range(41)) and got[b"\xf1"] == got[b"\xf0"] == b"\xf0"


# ---- quality ----

def test_isotonic_fit():
    assert quality.isotonic([1, 3, 2, 2, 5], [1, 1, 1, 2, 1]).round(6).tolist() == [1, 2.25, 2.25, 2.25, 5]


def test_quality_odd_rows(spark, odd, none):
    stats = quality.measured(odd, "doc_id", "text")
    labels = spark.createDataFrame([(1, 1), (5, 0), (8, None), (None, 1)], "doc_id long, quality int")
    model = quality.fit(stats, labels, "doc_id", "quality")
    rows = quality.score(stats, model, "doc_id").collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    without = quality.fit(stats, labels.where("doc_id > 99"), "doc_id", "quality")
    assert {r.score for r in quality.score(stats, without, "doc_id").collect()} == {0.5}
    assert quality.score(quality.measured(none, "doc_id", "text"), model, "doc_id").collect() == []


# ---- WARC ----

def test_archive_round_trip_of_odd_pages(spark, tmp_path):
    long = "é<p>\r\n\r\nWARC/1.1\r\nWARC-Type: x\r\n\r\n" * 4000
    rows = [(1, "http://a/\r\nX: y", long), (2, None, long), (3, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"),
            (None, "u", long), (7, "u", "z" * 100), (8, "u", "z" * 100), (8, "u", "z" * 100), (7, "u", "z" * 100)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    path = str(tmp_path / "archives")
    warc.write_archives(pages, path, "page_id", "url", "html", segment_bytes=700)
    records = warc.read_records(spark, path)
    assert records.where("record_type = 'continuation'").count() > 100 and records.where("record_type = 'broken'").count() == 0
    payloads = {(r.key, bytes(r.payload).decode()) for r in warc.reassembled(records).where("record_type = 'response'").collect()}
    assert ("1", long) in payloads and ("3", "") in payloads and ("4", "") in payloads and ("5", "short") in payloads
    got = sorted((int(r.key) if r.key else 0, r.payload_bytes, r.record_type, int(r.refers_to or 0)) for r in warc.read_pages(spark, path).collect())
    size = len(long.encode())
    assert got == [(0, size, "revisit", 1), (1, size, "response", 0), (2, size, "revisit", 1), (3, 0, "response", 0), (4, 0, "response", 0),
                   (5, 5, "response", 0), (6, 5, "response", 0), (7, 100, "response", 0), (7, 100, "response", 0), (8, 100, "revisit", 7), (8, 100, "revisit", 7)]


def test_broken_messages_are_told(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", text(1, 500)), (2, "u", text(2, 500))], "page_id long, url string, html string")
    path = str(tmp_path / "archives")
    warc.write_archives(pages, path, "page_id", "url", "html", segment_bytes=700)
    records = warc.read_records(spark, path)
    lost = warc.reassembled(records.where("not (key = '1' and segment = 2)")).collect()
    assert {r.key: r.complete for r in lost} == {"1": False, "2": True}
    twice = warc.reassembled(records.unionByName(records)).collect()
    assert all(r.complete for r in twice) and len(twice) == 2
    assert warc.unchunked(b"3\r\nabc\r\n0\r\n\r\n") == b"abc" and warc.unchunked(b"9\r\nabc") is None and warc.unchunked(b"zz\r\n") is None


def test_empty_archive(spark, tmp_path):
    path = str(tmp_path / "none")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path, "page_id", "url", "html")
    assert warc.read_pages(spark, path).collect() == []


# ---- backoff automaton ----

def test_scores_equal_brute_force(spark, odd, monkeypatch):
    held = remainder("doc_id", 5) == 1
    rows = backoff.score(odd, "doc_id", "text", held, strength=7.0).collect()
    training = [r for r in odd.withColumn("h", held).collect()]
    tokens = lambda t: [w.decode() for w in (t or "").encode().lower().split()] + ["\n"]
    words, pairs = {}, {}
    for r in training:
        if not r.h:
            for u, v in zip(["\n", *tokens(r.text)], tokens(r.text), strict=False):
                words[v] = words.get(v, 0) + 1
                pairs[u, v] = pairs.get((u, v), 0) + 1
    n, distinct = sum(words.values()), len(words)
    chance = lambda w: (words.get(w, 0) + 0.5) / (n + 0.5 * (distinct + 1))
    want = []
    for r in training:
        t = tokens(r.text)
        score = sum(np.log10((pairs.get((u, v), 0) + 7 * chance(v)) / (words.get(u, 0) + 7)) for u, v in zip(["\n", *t], t, strict=False))
        want.append((r.doc_id or 0, len(t), sum(w in words for w in t), n, round(sum(np.log10(chance(w)) for w in t), 6), round(score, 6)))
    got = [(r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in rows]
    assert sorted(got) == sorted(want)


def test_scores_of_nothing(spark, none, odd):
    held = remainder("doc_id", 5) == 1
    assert backoff.score(none, "doc_id", "text", held).collect() == []
    rows = backoff.score(odd, "doc_id", "text", remainder("doc_id", 5) >= 0).collect()
    assert {r.train_tokens for r in rows} == {0} and {r.n_known for r in rows} == {0}


# ---- decontamination ----

def brute_hits(words, items, window=10):
    hit, found = set(), set()
    for item, pattern in items:
        width = min(window, len(pattern))
        for s in range(len(pattern) - width + 1 if pattern else 0):
            for i in range(len(words) - width + 1):
                if words[i:i + width] == pattern[s:s + width]:
                    hit |= set(range(i, i + width))
                    found.add(item)
    return hit, found


def test_hits_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(wumanber, "PASS_BYTES", 400)  # several passes over the documents
    few = ["the", "of", "and", "to"]
    pick = random.Random(11)
    items = [(f"i{k}", " ".join(pick.choice(few) for _ in range(n))) for k, n in enumerate((12, 10, 25, 3, 1, 40))]
    items += [("i9", ""), ("i10", None), ("i0", items[1][1]), (None, "only here")]
    docs = [(k, ", ".join(pick.choice(few) for _ in range(n))) for k, n in enumerate((0, 1, 9, 10, 60, 200))]
    docs += [(50, "x " + items[0][1].upper() + " x"), (51, None), (52, "Only-HERE"), (53, "Ünï " + items[1][1]), (53, "same id")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, spans int, items int")
    table = wumanber._word_bytes()
    cut = lambda t: (t or "").encode().translate(table).split()
    patterns = [("null" if i is None else i, cut(t)) for i, t in items]
    got = sorted((r.row.doc_id, r.n_words, sorted(p for s in r.spans for p in range(s.start, s.end)), r["items"])
                 for r in wumanber.contaminated_spans(df, bench).collect())
    want = sorted((k, len(cut(t)), sorted(brute_hits(cut(t), patterns)[0]), sorted(brute_hits(cut(t), patterns)[1])) for k, t in docs)
    assert got == want


def test_passes_are_bounded_with_repeated_items(spark, monkeypatch):
    patterns, held = wumanber.Patterns, []

    def counted(items, window):
        held.append(sum(len(body) for _, body in items))
        return patterns(items, window)

    monkeypatch.setattr(wumanber, "PASS_BYTES", 2000)
    monkeypatch.setattr(wumanber, "Patterns", counted)
    items = [("same", text(31, 12))] * 200 + [(f"i{k}", text(600 + k, 12)) for k in range(60)]
    docs = [(k, body) for k, (_, body) in enumerate(items[195:])]
    found = wumanber.contaminated_spans(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"))
    got = {r.row.doc_id: r["items"] for r in found.collect()}
    assert got == {k: [item] for k, (item, _) in enumerate(items[195:])}
    assert max(held) <= 2000 and sum(held) == sum(len(body.encode()) for _, body in set(items))


def test_no_benchmark_and_no_documents(spark, odd, none):
    bench = spark.createDataFrame([], "item_id string, text string")
    rows = wumanber.contaminated_spans(odd, bench).collect()
    assert len(rows) == odd.count() and all(r.spans == [] for r in rows)
    assert wumanber.contaminated_spans(none, bench).collect() == []


# ---- language ----

def brute_code_length(training, text_, order):
    """Code length by walking the context tree, byte by byte."""
    tree = {}
    for t in training:
        data = b"\n" * order + t.lower()
        for i in range(order, len(data)):
            for size in range(order + 1):
                tree.setdefault(data[i - size:i], {}).setdefault(data[i], 0)
                tree[data[i - size:i]][data[i]] += 1
    data, bits = b"\n" * order + text_.lower(), 0.0
    for i in range(order, len(data)):
        for size in range(order, -1, -1):
            seen = tree.get(data[i - size:i])
            if seen is None:
                continue
            total, kinds = sum(seen.values()), len(seen)
            if data[i] in seen:
                bits -= np.log2(seen[data[i]] / (total + kinds))
                break
            bits -= np.log2(kinds / (total + kinds))
        else:
            bits += 8
    return bits


def test_code_lengths_equal_a_walk_of_the_trees(spark):
    training = {"aa": ["banana band", "an ant can"], "bb": ["wörter über öl", "zu tun"]}
    rows = [(i, t, lang) for i, (lang, t) in enumerate((lang, t) for lang, some in training.items() for t in some)]
    df = spark.createDataFrame([*rows, (9, None, "aa"), (10, "123", "bb"), (11, "unknown", None)], "doc_id long, text string, lang string")
    trees = ppm.train(df, "text", "lang", "doc_id")
    texts = ["banana", "über", "x", "", "Band öl 99"]
    got = trees.code_lengths([t.encode() for t in texts])
    want = [[brute_code_length([s.encode() for s in training[lang]], t.encode(), ppm.ORDER) for lang in trees.languages] for t in texts]
    assert np.allclose(got, want, rtol=1e-5)


def test_language_odd_rows(spark, odd, none):
    df = spark.createDataFrame([(1, "hello there world", "en"), (2, "hallo schöne welt", "de")], "doc_id long, text string, lang string")
    model = ppm.train(df, "text", "lang", "doc_id")
    rows = ppm.predict(odd, model).collect()
    names = {r.row.doc_id: r.lang_pred for r in rows}
    assert len(rows) == odd.count() and names[1] == "en" and {names[i] for i in (2, 3, 4, 9)} == {"und"}
    assert all(0 <= r.score <= 1 for r in rows)
    assert ppm.predict(none, model).collect() == []
    unlearned = ppm.train(df.where("lang = 'xx'"), "text", "lang", "doc_id")
    assert {r.lang_pred for r in ppm.predict(odd, unlearned).collect()} == {"und"}


def test_training_sample_is_bounded(spark):
    df = spark.createDataFrame([(1, "same text", "en")] * 300 + [(i, f"text {i}", "de") for i in range(50)], "doc_id long, text string, lang string")
    trees = ppm.train(df, "text", "lang", "doc_id", sample=20)
    assert trees.languages == ["de", "en"]


# ---- shards ----

def test_shards_odd_rows(spark, odd, none):
    rows = kdtree.kd_shards(odd.withColumn("lang", odd["source"]), "doc_id", "text", ["lang", "source"], shards=3).collect()
    assert len(rows) == odd.count()
    for shard in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    of = {r.doc_id: r for r in rows}
    assert of[2]["size"] == of[3]["size"] == 1 and of[2].text_crc32 == of[3].text_crc32 == 0 and of[2].shard == of[3].shard
    assert kdtree.kd_shards(none, "doc_id", "text", ["source"], shards=3).collect() == []


def test_shards_keep_groups_and_cut_heavy_ones(spark):
    rows = [(i, "s", f"text number {i} " + "y" * (i % 97)) for i in range(3000)]
    rows += [(i, f"s{i}", "small copy") for i in range(3000, 3010)]
    rows += [(i, "s", "z" * 60) for i in range(4000, 6000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    for n in (1, 5, 8):
        got = kdtree.kd_shards(df, "doc_id", "text", ["source"], shards=n).collect()
        load = np.zeros(n)
        for r in got:
            load[r.shard] += r["size"]
        assert load.max() <= 1.1 * load.mean() and load.min() >= 0.9 * load.mean()
        assert len({r.shard for r in got if 3000 <= r.doc_id < 3010}) == 1
    leaves = kdtree.kd_shards(df, "doc_id", "text", ["source"], target_bytes=20_000).toPandas()
    assert leaves["shard"].nunique() == -(-leaves["size"].sum() // 20_000)


# ---- passages ----

def brute_kept(rows, window):
    seen, out = set(), []
    for key, body in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        words = (body or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            gram = tuple(words[i:i + window])
            if gram in seen:
                gone[i:i + window] = [True] * window
            seen.add(gram)
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((key or 0, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def passages():
    pick = random.Random(13)
    shared = [text(100 + k, 45) for k in range(6)]
    rows = []
    for i in range(120):
        parts = [text(1000 + i, pick.randrange(0, 60))]
        for _ in range(pick.randrange(3)):
            start = pick.randrange(20)
            parts += [" ".join(pick.choice(shared).split()[start:]), text(5000 + i, pick.randrange(5))]
        rows.append((i, " \n".join(parts)))
    rows += [(i, rows[i % 7][1]) for i in range(200, 260)]  # copies
    rows += [(300, "la " * 80), (301, "la " * 19), (302, "la " * 20), (303, None), (304, ""), (None, rows[3][1]), (305, rows[5][1]), (305, rows[5][1])]
    return rows


@pytest.mark.parametrize("block_bytes", [1 << 20, 4000])
def test_removal_equals_brute_force(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(automata, "number_of_blocks", lambda total: packed.number_of_blocks(total, block_bytes))
    monkeypatch.setattr(automata, "SHARD_WORDS", 90)  # several automata per reference
    monkeypatch.setattr(automata, "GROUP_WORDS", 50)  # several groups per reference
    rows = passages()
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, block int").repartition(4)
    done = automata.remove_repeats(df, "doc_id", "text", with_text=True).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256) for r in done) == brute_kept(rows, 20)
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in done)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in done)


def test_spans_of_a_hot_passage_are_shared_out(spark, monkeypatch):
    """One passage in every document: no group streams more than a few times its words."""
    confirmed, passage = automata._confirmed, text(77, 25)

    def limited(window):
        run = confirmed(window)

        def checked(rows):
            assert rows.loc[~rows["reference"].to_numpy(bool), "n_words"].sum() <= 1500
            return run(rows)

        return checked

    monkeypatch.setattr(automata, "number_of_blocks", lambda total: packed.number_of_blocks(total, 8000))
    monkeypatch.setattr(automata, "GROUP_WORDS", 500)
    monkeypatch.setattr(automata, "_confirmed", limited)
    rows = [(i, f"{text(3000 + i, 9)} {passage} {text(4000 + i, 9)}") for i in range(300)]
    done = automata.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in done) == brute_kept(rows, 20)


def test_document_blocks_have_even_bytes(spark):
    """Long texts at the end of the keys, one key and null with many texts: blocks follow bytes and the order of rows."""
    rows = [(i, "s" * 20) for i in range(900)] + [(i, f"{i} " + "l" * 2000) for i in range(900, 1000)]
    rows += [(500, f"{(i * 7919) % 1000:04} " + "h" * 400) for i in range(500)] + [(None, f"{(i * 7919) % 1000:04} " + "n" * 400) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", automata.utf8("text").alias("text"))
    total = packed.text_bytes(df, "text")
    placed = df.withColumn("block", automata.document_blocks(df, "doc_id", "text", 20, total)).collect()
    bytes_of = {}
    for r in placed:
        bytes_of[r.block] = bytes_of.get(r.block, 0) + len(r.text)
    assert max(bytes_of.values()) <= 2.5 * total / 20
    placed.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, bytes(r.text)))
    assert [r.block for r in placed] == sorted(r.block for r in placed)


def test_removal_with_heavy_keys(spark, monkeypatch):
    monkeypatch.setattr(automata, "number_of_blocks", lambda total: packed.number_of_blocks(total, 2000))
    rows = [(None if k % 3 else 7 + k % 2, body) for k, (_, body) in enumerate(passages())] + [(1, text(5, 40)), (9, text(5, 40))]
    done = automata.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256) for r in done) == brute_kept(rows, 20)


def test_removal_of_nothing(spark, odd, none):
    assert automata.remove_repeats(none, "doc_id", "text").collect() == []
    rows = {r.doc_id: r for r in automata.remove_repeats(odd, "doc_id", "text").collect()}
    assert rows[2].n_words == rows[3].n_words == rows[4].n_words == 0 and rows[5].n_words == 30_000 and rows[6].n_removed == 0


def test_automaton_matching_statistics():
    automaton = automata.SuffixAutomaton()
    for w in [1, 2, 3, 1, 2, 4]:
        automaton.add(w)
    assert automaton.repeated([9, 1, 2, 4, 9, 3, 1, 2, 3], 3) == [(1, 4), (5, 9)]
    assert automaton.repeated([1, 2, 3, 1, 2, 4, 4], 2) == [(0, 6)]
