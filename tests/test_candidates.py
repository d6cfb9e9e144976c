import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanloom.functions import fuzzy as Z
from spanloom.operators import candidates as K
from spanloom.operators import embedding as E
from spanloom.operators import tagging as G


def slow_common(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abc ", max_size=12), st.text("abc ", max_size=12))
def test_common_subsequence(a, b):
    assert Z.common_subsequence(a, b) == slow_common(a, b)


def test_known_ratios():
    assert Z.ratio("this is a test", "this is a test!") == 97
    assert Z.ratio("", "") == 100 and Z.ratio("a", "") == 0
    assert Z.token_set_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == 100
    assert Z.token_set_ratio("Java, Spring!", "spring java") == 100
    assert Z.token_set_ratio("!!!", "x") == 0


NAMES = ["java", "Java script", "machine learning", "deep learning", "learning to learn", "sql", "data base", "java", "!!", "zoo"]


@settings(max_examples=200, deadline=None)
@given(st.text("javscriptmlen dzo", max_size=14), st.integers(1, 6))
def test_name_index_keeps_the_best_k(span, k):
    import pandas as pd

    scores = Z.NameIndex(pd.Series(NAMES)).scores(span, k)
    got = sorted(((-round(s * 100), i) for i, s in enumerate(scores) if s >= 0))[:k]
    want = sorted((-Z.token_set_ratio(span, n), i) for i, n in enumerate(NAMES))[:k]
    assert got == want


@pytest.mark.parametrize("sizes", [{}, {"broadcast_rows": 2, "block_rows": 3}])
def test_fuzzy_entities_equal_brute_force(spark, sizes):
    rng = random.Random(7)
    names = [(i, rng.choice(NAMES) + rng.choice(["", " expert", " x"])) for i in range(60)] + [(100 + i, "java") for i in range(40)]
    spans = ["java expert", "learn", "base data", "qqq", "", "sql x"]
    tax = spark.createDataFrame(names, "unique_id long, name string")
    got = K.fuzzy_entities(spark.createDataFrame([(s,) for s in spans], "span string"), tax, 5, **sizes).collect()
    for s in spans:
        want = sorted((-Z.token_set_ratio(s, n), i) for i, n in names)[:5]
        assert sorted((-r.score, r.unique_id) for r in got if r.span == s) == want


def test_fuzzy_entities_on_a_table_equal_brute_force(spark, table):
    """The registered fuzzy query has no SQL twin: the same operator against all pairs of a small table."""
    names = [(r.p_partkey, r.p_name) for r in table("part").collect()]
    words = sorted({w for r in table("benchmark").collect() for w in r.text.lower().split()})[:150]
    tax = spark.createDataFrame(names, "unique_id long, name string")
    got = {}
    for r in K.fuzzy_entities(spark.createDataFrame([(w,) for w in words], "span string"), tax, 5).collect():
        got.setdefault(r.span, []).append((-r.score, r.unique_id))
    for w in words:
        assert sorted(got[w]) == sorted((-Z.token_set_ratio(w, n), i) for i, n in names)[:5]


def test_containment_equals_search(spark):
    texts = {1: "Java Script", 2: "Deep learning", 3: "learn SQL", 4: "é", 5: "", 6: None}
    spans = ["java", "LEARN", "a", "q", "", "sql", "é", "ript", "learning to"]
    tax = spark.createDataFrame(list(texts.items()), "unique_id long, name_definition string")
    got = K.containing_entities(spark.createDataFrame([(s,) for s in spans], "span string"), tax).collect()
    want = {(s, i) for s in spans for i, t in texts.items() if t is not None and s.lower() in t.lower()}
    assert {(r.span, r.unique_id) for r in got} == want


def taxonomy(spark):
    rows = [(1, "a", "java", "java: language", [1.0, 0.0]), (2, "a", "java ee", "java ee: platform", [0.9, 0.1]),
            (3, "b", "sql", "sql: query language", [0.0, 1.0]), (4, "b", "excel", "excel: sheets", [0.1, 0.9])]
    return spark.createDataFrame(rows, "unique_id long, level2 string, name string, name_definition string, embedding array<double>")


def test_select_candidates(spark):
    records = spark.createDataFrame([(1, ["java", "java", "exel"]), (2, [])], "record_id long, spans array<string>")
    vectors = spark.createDataFrame([(1, "java", [1.0, 0.0]), (1, "exel", [0.0, 1.0])], "record_id long, span string, embedding array<double>")
    rules = K.select_candidates(records, taxonomy(spark), 2, "rules").collect()
    assert {(r.span, r.unique_id, tuple(r.methods)) for r in rules} == {
        ("java", 1, ("exact",)), ("java", 2, ("exact",)), ("exel", 4, ("fuzzy",)), ("exel", 2, ("fuzzy",))}
    mixed = K.select_candidates(records, taxonomy(spark), 2, "mixed", span_vectors=vectors).collect()
    assert {(r.span, r.unique_id, tuple(r.methods)) for r in mixed} == {
        ("java", 1, ("exact", "vector")), ("java", 2, ("exact", "vector")),
        ("exel", 4, ("fuzzy", "vector")), ("exel", 2, ("fuzzy",)), ("exel", 3, ("vector",))}
    only = K.select_candidates(records, taxonomy(spark), 1, "embeddings", span_vectors=vectors).collect()
    assert {(r.span, r.unique_id) for r in only} == {("java", 1), ("exel", 3)}
    as_map = K.candidate_map(K.select_candidates(records, taxonomy(spark), 2, "rules")).first().candidates
    assert [c.unique_id for c in as_map["java"]] == [1, 2]
    with pytest.raises(ValueError):
        K.select_candidates(records, taxonomy(spark), 2, "other")


def test_more_exact_matches_than_k_are_sampled_with_a_seed(spark):
    tax = spark.createDataFrame([(i, "x", f"java {i}", f"java {i}") for i in range(50)], "unique_id long, level2 string, name string, name_definition string")
    spans = spark.createDataFrame([("java",)], "span string")
    a = sorted(r.unique_id for r in K.rule_entities(spans, tax, 7, seed=1).collect())
    b = sorted(r.unique_id for r in K.rule_entities(spans, tax.repartition(11), 7, seed=1).collect())
    c = sorted(r.unique_id for r in K.rule_entities(spans, tax, 7, seed=2).collect())
    assert a == b and len(a) == 7 and a != c


def test_gold_goes_first_when_missing(spark):
    df = spark.createDataFrame([(["a", "b", "c"], "c"), (["a", "b", "c"], "z"), ([], "z")], "c array<string>, g string")
    assert [r.x for r in df.select(K.with_gold(F.col("c"), F.col("g")).alias("x")).collect()] == [["a", "b", "c"], ["z", "a", "b"], ["z"]]


def support(spark):
    rows = [(f"s{i}", f"sentence {i % 4}", [1.0 * (i % 4), 1.0], f"k{i}", ["x"] if i % 5 else []) for i in range(40)]
    return spark.createDataFrame(rows, "support_id string, sentence string, embedding array<double>, skill string, spans array<string>")


def test_nearest_support_has_distinct_sentences(spark):
    records = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(30)], "record_id long, embedding array<double>")
    got = K.nearest_support(records, support(spark), 3).collect()
    assert all(len(r.spans) > 0 for r in got)
    per = {}
    for r in got:
        per.setdefault(r.record_id, []).append(r.sentence)
    assert all(len(v) == len(set(v)) <= 3 for v in per.values())
    assert len({r.support_id for r in got}) > 4


def test_random_support_is_without_replacement(spark):
    requests = spark.range(200).withColumnRenamed("id", "record_id")
    full = support(spark).withColumn("spans", F.array(F.lit("x")))
    got = K.random_support(requests, full, 5).collect()
    per = {}
    for r in got:
        per.setdefault(r.record_id, []).append(r.support_id)
    assert len(per) == 200 and all(len(v) == len(set(v)) == 5 for v in per.values())
    assert len({s for v in per.values() for s in v}) == 40
    assert K.random_support(requests, full.limit(2), 5).count() == 400


def test_locate_span(spark):
    rows = [("we use deep learning now", "deep learning"), ("deap lerning", "deep learning"), ("none here", "sql"), ("a b a b", "a b"), ("x", "")]
    df = spark.createDataFrame(rows, "s string, p string").select(
        F.split("s", " ").alias("s"), F.when(F.col("p") == "", F.array().cast("array<string>")).otherwise(F.split("p", " ")).alias("p"))
    strict = [(r.x.start, r.x.end) if r.x.start is not None else None for r in df.select(E.locate_span(F.col("s"), F.col("p")).alias("x")).collect()]
    assert strict == [(2, 4), None, None, (0, 2), None]
    loose = [(r.x.start, r.x.end) if r.x.start is not None else None
             for r in df.select(E.locate_span(F.col("s"), F.col("p"), per_token=False).alias("x")).collect()]
    assert loose[1] == (0, 2)


def test_windows_left_out_could_not_win():
    """Against scoring every window; near tokens, ties, short sentences and both thresholds."""
    import random

    from spanloom.functions.fuzzy import ratio

    pick = random.Random(6)
    stems = ["learn", "learning", "leaning", "deep", "deeper", "a", "an", "", "internationalisation", "internationalization"]
    for _ in range(1500):
        sentence = [pick.choice(stems) for _ in range(pick.randrange(12))]
        span = [pick.choice(stems) for _ in range(pick.randrange(4))]
        threshold, per_token = pick.choice([(95, True), (60, True), (0, True), (175, False), (95, False)])
        best = None
        for start in range(len(sentence) - len(span) + 1):
            total = sum(ratio(t, sentence[start + j]) for j, t in enumerate(span))
            value = total / len(span) if span and per_token else total
            if span and value >= threshold and (best is None or value > best[0]):
                best = value, (start, start + len(span))
        assert E.best_window(sentence, span, threshold, per_token) == (best and best[1])


def test_span_vectors_fall_back_to_the_span(spark):
    located = spark.createDataFrame([(1, "a b", 0, 2, [9.0, 9.0]), (1, "zzz", None, None, [5.0, 6.0])],
                                    "record_id long, span string, start int, end int, span_embedding array<double>")
    tokens = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [0.0, 1.0]), (1, 2, [7.0, 7.0])], "record_id long, pos int, embedding array<double>")
    got = {r.span: r.embedding for r in E.span_vectors(located, tokens).collect()}
    assert got == {"a b": [0.5, 0.5], "zzz": [5.0, 6.0]}


def test_embed_checks_rows_and_chunks(spark, tmp_path):
    def make():
        import pandas as pd

        def encode(texts):
            assert len(texts) <= 3
            return pd.Series([[float(len(t))] for t in texts])

        return encode

    df = spark.createDataFrame([(i, "x" * i) for i in range(20)], "i int, t string").coalesce(1)
    got = E.embed_to_parquet(df, "t", make, str(tmp_path / "v"), chunk=3)
    assert sorted((r.i, r.embedding[0]) for r in got.collect()) == [(i, float(i)) for i in range(20)]


def test_embed_again_adds_only_what_is_missing(spark, tmp_path):
    """Each distinct text is embedded once; a second run takes new and changed texts alone."""
    seen = tmp_path / "seen"
    seen.mkdir()

    def make():
        import uuid

        import pandas as pd

        def encode(texts):
            (seen / uuid.uuid4().hex).write_text("\n".join("null" if t is None else t for t in texts))
            return pd.Series([[float(len(t or "")), 1.0] for t in texts])

        return encode

    def asked():
        lines = [line for f in seen.iterdir() for line in f.read_text().split("\n")]
        for f in list(seen.iterdir()):
            f.write_text("")
        return sorted(line for line in lines if line)

    path = str(tmp_path / "v")
    rows = [(i, f"text {i % 7}") for i in range(30)] + [(40, None)]
    first = spark.createDataFrame(rows, "i int, t string")
    got = E.embed_to_parquet(first, "t", make, path, part_texts=3)
    assert sorted((r.i, r.embedding[0]) for r in got.collect()) == sorted((i, float(len(t or ""))) for i, t in rows)
    assert asked() == ["null", *[f"text {i}" for i in range(7)]]
    later = rows[:-1] + [(50, "one more"), (1, "changed")]
    got = E.embed_to_parquet(spark.createDataFrame(later, "i int, t string"), "t", make, path)
    assert got.count() == len(later) and asked() == ["changed", "one more"]
    assert E.embed_to_parquet(first, "t", make, path).count() == len(rows) and asked() == []
    manifest = spark.read.json(f"{path}-manifest")
    assert manifest.agg({"texts": "sum"}).first()[0] == 10 and manifest.count() >= 3


def test_texts_are_cut_before_they_are_embedded(spark):
    def make():
        import pandas as pd

        return lambda texts: pd.Series([[float(len(t.split()))] for t in texts])

    df = spark.createDataFrame([("a b  c d",), ("a  b",), ("",)], "t string")
    assert [r.embedding[0] for r in E.embed(df, "t", make, max_length=3).collect()] == [3.0, 2.0, 0.0]
    assert [r.c for r in df.select(E.truncated("t", 3).alias("c")).collect()] == ["a b c", "a  b", ""]


def test_hash_embedding_has_length_one(spark):
    df = spark.createDataFrame([("a b b",), ("",)], "t string")
    got = [r.embedding for r in E.hash_embed(df, "t", 16).collect()]
    assert sum(x * x for x in got[0]) == pytest.approx(1) and sum(map(abs, got[1])) == 0


def test_keyword_tags(spark):
    texts = spark.createDataFrame([(1, "We use C# and C++, not C. Machine learning; java."), (2, "machine  learning JAVA"), (3, "?!")], "id long, t string")
    terms = spark.createDataFrame([("Technologies", "C#"), ("Technologies", "C++"), ("Technologies", "C"), ("Technologies", "Machine learning"),
                                   ("Languages", "java"), ("Languages", "java")], "level1 string, level2 string")
    synonyms = spark.createDataFrame([("Java SE", "java, JAVA"), ("None", None)], "level2 string, alternative_names_clean string")
    tags = {(r.id, r.tag): r["values"] for r in G.keyword_tags(texts, "id", "t", terms, {"Technologies": synonyms}).collect()}
    assert tags == {
        (1, "Technologies"): ["C", "C#", "C++", "Java SE", "Machine learning"], (1, "Technologies_alternative_names"): ["java"],
        (1, "Languages"): ["java"], (2, "Technologies"): ["Java SE"], (2, "Technologies_alternative_names"): ["JAVA"]}
    course = G.keyword_tags(texts, "id", "t", terms, {"Technologies": synonyms}, "course")
    assert course.where("tag = 'Languages'").count() == 0
    wide = G.tag_columns(texts, "id", G.keyword_tags(texts, "id", "t", terms), ["Languages", "Technologies"]).orderBy("id").collect()
    assert wide[0].Languages == ["java"] and wide[2].Technologies == []
    assert wide[0].Technologies == ["C#", "C++", "C", "Machine learning"]
    assert G.keyword_tags(texts, "id", "t", terms.limit(0)).count() == 0


def test_terms_in_several_passes_equal_a_scan(spark, monkeypatch):
    """Nested, overlapping and repeated terms, against a look at every place; small tries make several passes."""
    import random

    from spanloom.operators import tagging as G

    pick = random.Random(4)
    letters = ["ab", "b", "C#", "c", "d+", ".x", "e"]
    gaps = [" ", ", ", "  ", ".", " (", ") "]
    texts = [(i, "".join(pick.choice(letters) + pick.choice(gaps) for _ in range(pick.randrange(12)))) for i in range(60)] + [(60, None), (61, "")]
    terms = sorted({"".join(pick.choice(letters) + (pick.choice(gaps) if j else "") for j in range(pick.randrange(1, 4), -1, -1)) for _ in range(150)} | {"ab", "b", "(", ".x"})
    df = spark.createDataFrame(texts, "id long, text string")
    entries = spark.createDataFrame([(t, n) for n, t in enumerate(terms)], "term string, number long")
    whole = {(r.id, r.place, r.term, r.number) for r in G.dictionary_hits(df, "id", "text", entries).collect()}
    monkeypatch.setattr(G, "TRIE_BYTES", 300)
    passes = G.dictionary_hits(df, "id", "text", entries)
    assert {tuple(r) for r in passes.select("id", "place", "term", "number").collect()} == whole

    import re

    atom, word = re.compile(r"\w+[#+]*|[^\w]+"), re.compile(r"\w")
    scanned = set()
    for i, text in texts:
        before = re.match(r"[^\w]*", text or "").group()
        parts = atom.findall((text or "")[len(before):])
        for number, term in enumerate(terms):
            m = re.match(r"(?s)^([^\w]*)(.*\w[#+]*)([^\w]*)$", term)
            if not m:
                continue
            lead, words, tail = m.groups()
            own = atom.findall(words)
            for at in range(0, len(parts), 2):
                if parts[at:at + len(own)] == own:
                    gap, end = parts[at - 1] if at else before, at + len(own)
                    after = parts[end] if end < len(parts) else ""
                    if (not lead or gap.endswith(lead) and (len(gap) > len(lead) or not at)) and (
                            not tail or after.startswith(tail) and (len(after) > len(tail) or end + 1 >= len(parts))):
                        scanned.add((i, at + 1, term, number))
    assert whole == scanned and len(whole) > 100


def test_terms_with_signs(spark):
    from spanloom.operators import tagging as G

    docs = spark.createDataFrame(
        [(1, ".NET and (ISC)2, C# or Yahoo!"), (2, "ASP.NET, (ISC)23 C Yahoo"), (3, "use (.NET) Yahoo!!"), (4, "xYahoo! R&D")], "id long, text string")
    terms = spark.createDataFrame([(t,) for t in (".NET", "(ISC)2", "C#", "Yahoo!", "ASP.NET", "R&D", "!!")], "term string")
    got = sorted((r.id, r.term) for r in G.term_hits(docs, "id", "text", terms).collect())
    assert got == [(1, "(ISC)2"), (1, ".NET"), (1, "C#"), (1, "Yahoo!"), (2, "ASP.NET"), (3, ".NET"), (3, "Yahoo!"), (4, "R&D")]
