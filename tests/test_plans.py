import pytest
from pyspark.sql import functions as F

from spanloom.operators import candidates as K
from spanloom.operators import requests as R
from spanloom.plans import generation as G
from spanloom.plans import matching as M


def test_generation_flow(spark, table):
    tax = table("embeddings").select(
        F.concat(F.lit("v"), "vec_id").alias("name"), "embedding", F.lit("alt").alias("alt_labels"), F.lit("text").alias("description"))
    pop = tax.select("name", F.lit(1.0).alias("score"))
    combos = G.combinations(tax, pop, 120, threshold=0.2)
    templates = spark.createDataFrame(
        [("dense", "S", "One of {skillList}", []), ("sparse", "S", "Some of {skillList}", [])],
        f"mode string, system string, instruction string, shots {R.SHOTS}")
    asked = G.generation_requests(combos, tax, templates)
    sizes = {r.draw_id: r.size for r in combos.collect()}
    assert asked.count() == sum((s <= 4) + (s >= 3) for s in sizes.values())
    answers = asked.select("request_id", F.when(F.col("draw_id") > 5, F.concat(F.lit("text "), "request_id")).alias("answer"))
    samples = G.collect_samples(asked, answers)
    assert samples.where("sentence is null").count() > 0
    split = samples.where("sentence is not null").select("sentence", "skills", F.lit("train").alias("split"))
    negatives = spark.range(50).select(F.concat(F.lit("n"), "id").alias("sentence"), F.array(F.lit("LABEL NOT PRESENT")).alias("skills"))
    excluded = spark.range(20).select(F.concat(F.lit("e"), "id").alias("sentence"), F.array(F.lit("x")).alias("skills"))
    full = G.with_negatives(split, negatives, excluded)
    counts = {r.split: r["count"] for r in full.groupBy("split").count().collect()}
    assert counts == {"train": split.count() + 35 + 14, "test": 8 + 3, "dev": 7 + 3}
    assert full.where("skills[0] = 'NO LABEL'").count() == 20


def test_matching_flow(spark):
    records = spark.createDataFrame(
        [(1, "We use Java and SQL", "job", "skills", ["java", "UNK"]), (2, "nothing", "job", "skills", ["sql"])],
        "record_id long, sentence string, data_type string, prompt_type string, skills array<string>")
    templates = spark.createDataFrame(
        [("job", "extraction", "skills", "S", "I", [])],
        f"data_type string, task string, prompt_type string, system string, instruction string, shots {R.SHOTS}")
    support = spark.createDataFrame([(1, "s1", "@@s1##", 1), (1, "s2", "s2", 2)], "record_id long, sentence string, annotated_sentence string, rank int")
    asked = {r.record_id: r.messages for r in M.extraction_requests(records, templates, M.extraction_shots(support)).collect()}
    assert [m.content for m in asked[1]] == ["S", "I", "s1", "@@s1##", "s2", "s2", "We use Java and SQL"] and len(asked[2]) == 3
    answers = spark.createDataFrame([(1, "We use @@Java## and @@SQL##"), (2, None)], "record_id long, answer string")
    spans = M.extracted(records, answers)
    assert {r.record_id: r.spans for r in spans.collect()} == {1: ["java", "sql"], 2: []}
    levels = M.extracted(records, spark.createDataFrame([(1, '{"Java": "high"}'), (2, "?")], "record_id long, answer string"), True)
    assert {r.record_id: r.spans for r in levels.collect()} == {1: ["java"], 2: []}
    tax = spark.createDataFrame(
        [(1, "a", "java", "java : a language"), (2, "a", "java ee", "java ee : more"), (3, "b", "sql", "sql : queries")],
        "unique_id long, level2 string, name string, name_definition string")
    found = K.select_candidates(spans, tax, 2, "rules")
    kinds = templates.select("data_type", "system", "instruction", "shots")
    questions = M.matching_requests(spans, found, kinds)
    assert questions.count() == 2
    shown = {r.span: [o.name for o in r.options] for r in questions.collect()}
    java = chr(65 + shown["java"].index("java"))
    chosen = spark.createDataFrame([(1, "java", java), (1, "sql", "a.")], "record_id long, span string, answer string")
    matched = M.matched_records(spans, questions, chosen)
    assert {r.record_id: r.predicted for r in matched.collect()} == {1: ["java", "sql"], 2: []}
    assert {r.record_id: [(m.span, m.unique_id, m.level2) for m in r.matches] for r in matched.collect()} == {
        1: [("java", 1, "a"), ("sql", 3, "b")], 2: []}
    s = M.scores(matched).first()
    assert (s.tp, s.fp, s.fn) == (1, 1, 1)


def test_names_of_complete_taxonomies_match(spark):
    """The name is the entity's own column, whatever the option's text looks like."""
    tax = spark.createDataFrame(
        [(1, "a", "Cooking", "Cooking: prepare food"), (2, "a", "Tools : sharp", "Tools : sharp: knives")],
        "unique_id long, level2 string, name string, name_definition string")
    records = spark.createDataFrame(
        [(1, "I do cooking", "job", ["Cooking"], ["cooking"]), (2, "I use tools", "job", ["Tools : sharp"], ["tools"])],
        "record_id long, sentence string, data_type string, skills array<string>, spans array<string>")
    kinds = spark.createDataFrame([("job", "S", "I", [])], f"data_type string, system string, instruction string, shots {R.SHOTS}")
    found = K.select_candidates(records, tax, 2, "rules")
    questions = M.matching_requests(records, found, kinds)
    answers = questions.select("record_id", "span", F.lit("A").alias("answer"))
    s = M.scores(M.matched_records(records, questions, answers)).first()
    assert (s.tp, s.fp, s.fn, s.f1) == (2, 0, 0, 1.0)


def test_kinds_without_a_template_are_errors(spark):
    kinds = spark.createDataFrame([("job", "S", "I", [])], f"data_type string, system string, instruction string, shots {R.SHOTS}")
    records = spark.createDataFrame([(1, "x", "course", ["x"])], "record_id long, sentence string, data_type string, spans array<string>")
    candidates = spark.createDataFrame([(1, "x", 1, "a", "n", "d", 1)], "record_id long, span string, unique_id long, level2 string, name string, name_definition string, rank int")
    with pytest.raises(ValueError):
        M.matching_requests(records, candidates, kinds)
    combos = spark.createDataFrame([(1, "a", ["a"], 1)], "draw_id long, anchor string, members array<string>, size int")
    modes = spark.createDataFrame([("sparse", "S", "I", [])], f"mode string, system string, instruction string, shots {R.SHOTS}")
    with pytest.raises(ValueError):
        G.generation_requests(combos, None, modes)


def test_overlapping_tables_are_errors(spark):
    split = spark.createDataFrame([(f"s{i}", ["x"], "train") for i in range(20)], "sentence string, skills array<string>, split string")
    negatives = spark.createDataFrame([(f"s{i}", ["y"]) for i in range(20)], "sentence string, skills array<string>")
    with pytest.raises(ValueError):
        G.with_negatives(split, negatives)


def test_gold_is_among_the_letters(spark):
    many = [f"o{i}" for i in range(30)]
    df = spark.createDataFrame([(many, "o28"), (many, "o3"), (many, "new"), ([], "new")], "c array<string>, g string")
    got = [r.o for r in df.select(K.with_gold(F.col("c"), F.col("g")).alias("o")).collect()]
    assert got[0] == ["o28", *[o for o in many if o != "o28"]] and got[1] == many and got[2] == ["new", *many[:-1]] and got[3] == ["new"]


def test_spans_without_vectors_have_no_vector_candidates(spark):
    tax = spark.createDataFrame([(1, "a", "x", "x", [1.0, 0.0])], "unique_id long, level2 string, name string, name_definition string, embedding array<double>")
    records = spark.createDataFrame([(1, ["a", "b"])], "record_id long, spans array<string>")
    vectors = spark.createDataFrame([(1, "a", [1.0, 0.0]), (1, "b", None)], "record_id long, span string, embedding array<double>")
    found = K.select_candidates(records, tax, 2, "embeddings", span_vectors=vectors)
    assert [(r.span, r.unique_id, r["rank"]) for r in found.collect()] == [("a", 1, 1)]
