import pytest
from pyspark.sql import functions as F

from spanloom.operators import requests as R


def test_modes(spark):
    df = spark.createDataFrame([(i,) for i in range(1, 7)], "size int")
    got = {}
    for r in R.route_modes(df).collect():
        got.setdefault(r.size, set()).add(r.mode)
    assert got == {1: {"dense"}, 2: {"dense"}, 3: {"dense", "sparse"}, 4: {"dense", "sparse"}, 5: {"sparse"}, 6: {"sparse"}}
    assert {r.mode for r in R.route_modes(df, "base").collect()} == {"base"}


def test_list_text_prints_like_python(spark):
    lists = [["a", "b"], ["it's"], ['say "x"'], ["it's \"x\""], [], ["a\\b", "c\nd"]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, x array<string>")
    got = [r.t for r in df.select("i", R.list_text(F.col("x")).alias("t")).orderBy("i").collect()]
    assert got == [str(x) for x in lists]


def test_template_is_filled_once(spark):
    values = {"a": F.lit("{b}"), "b": F.lit("B")}
    filled = R.fill_template(F.lit("{a} {b}{b} {none}. {a}"), values)
    assert spark.range(1).select(filled.alias("x")).first().x == "{b} BB . {b}"
    assert spark.range(1).select(R.fill_template(F.lit("plain"), {}).alias("x")).first().x == "plain"


@pytest.mark.parametrize("n, least, most", [(1, "1 sentence", "2"), (3, "1 sentence", "4"), (5, "3 sentences", "6")])
def test_placeholders(spark, n, least, most):
    members = F.array(*[F.lit(f"m{i}") for i in range(n)])
    values = R.placeholder_values(members, None, F.array(F.lit("x"), F.lit("y")), {"nExamples": "nine"})
    row = spark.range(1).select(*[v.alias(k) for k, v in values.items()]).first()
    assert (row.minNbSentences, row.maxNbSentences, row.nExamples, row.implicitCount) == (least, most, "nine", "two")
    assert row.wordsToAvoid == R.AVOID_INTRODUCTION + "x, y. " and row.additionalInfo == ""


def test_messages(spark):
    shots = F.array(*[F.struct(F.lit(f"q{i}").alias("question"), F.lit(f"a{i}").alias("answer")) for i in range(8)])
    built = R.build_messages(F.lit("s"), F.lit("i"), shots, F.lit("u"), R.EXTRACTION_SHOTS)
    got = [(m.role, m.content) for m in spark.range(1).select(built.alias("m")).first().m]
    assert got[:4] == [("system", "s"), ("user", "i"), ("user", "q0"), ("assistant", "a0")]
    assert len(got) == 15 and got[-1] == ("user", "u")
    plain = R.build_messages(F.lit("s"), F.lit("i"), F.lit(None).cast(R.SHOTS), F.lit("u"))
    assert len(spark.range(1).select(plain.alias("m")).first().m) == 3


def test_shots(spark):
    df = spark.createDataFrame([("Sentence: we code \nAnswer: we @@code##\n",), ("no parts",)], "t string")
    got = [r.s for r in df.select(R.parse_shot(F.col("t")).alias("s")).collect()]
    assert (got[0].question, got[0].answer) == ("we code", "we @@code##") and got[1].answer is None
    whole = df.select(R.parse_shot(F.col("t"), drop_label=False).alias("s")).first().s
    assert whole.question == "Sentence: we code "


def test_invalid_kinds_are_reported(spark):
    asked = spark.createDataFrame([("job", "a"), ("cv", "b"), ("cv", "b")], "data_type string, prompt_type string")
    known = spark.createDataFrame([("job", "a", "text")], "data_type string, prompt_type string, system string")
    keys = ["data_type", "prompt_type"]
    assert [tuple(r) for r in R.invalid_kinds(asked, known, keys).collect()] == [("cv", "b")]
    assert R.with_templates(asked, known, keys).count() == 1
    with pytest.raises(ValueError, match="cv"):
        R.require_valid_kinds(asked, known, keys)


def test_choice_and_answers(spark):
    options = [f"option {i}" for i in range(30)]
    rows = [("a", 0), (" B because", 1), ("z", 25), ("", None), (None, None), ("?", None), ("1", None)]
    df = spark.createDataFrame([(a, options) for a, _ in rows], "a string, o array<string>")
    got = [r.x for r in df.select(R.chosen_option(F.col("a"), F.col("o")).alias("x")).collect()]
    assert got == [None if i is None else f"option {i}" for _, i in rows]
    short = spark.createDataFrame([("c", ["x", "y"]), ("b", ["x", "x"])], "a string, o array<string>")
    assert [r.x for r in short.select(R.chosen_option(F.col("a"), F.col("o")).alias("x")).collect()] == [None, "x"]
    assert [r.x for r in short.select(R.chosen_place(F.col("a"), F.col("o")).alias("x")).collect()] == [None, 1]
    text = df.select(R.choice_question(F.lit("S"), F.lit("k"), F.col("o")).alias("t")).first().t
    assert text.startswith("Sentence: S \nSkill: k \nOptions: A: option 0 \nB: option 1") and text.endswith("Z: option 25")


def test_matching_shot_names_the_gold_letter(spark):
    df = spark.createDataFrame([(["x", "y", "z"], "y"), (["x"], "q")], "o array<string>, g string")
    got = [r.s.answer for r in df.select(R.matching_shot(F.lit("s"), F.lit("k"), F.col("o"), F.col("g")).alias("s")).collect()]
    assert got == ["B", None]


def test_match_answers_drops_unmatched(spark):
    asked = spark.createDataFrame([(1, "s", ["x", "y"]), (2, "t", ["x"])], "record_id long, span string, options array<string>")
    answers = spark.createDataFrame([(1, "s", "b"), (2, "t", None)], "record_id long, span string, answer string")
    assert [tuple(r) for r in R.match_answers(asked, answers).collect()] == [(1, "s", "y")]


def test_negative_plan(spark):
    df = spark.createDataFrame([("a", 500), ("b", 1), ("c", 0)], "k string, total long")
    got = {}
    for r in R.negative_plan(df, keep=["k"]).collect():
        got[r.k, r.kind] = got.get((r.k, r.kind), 0) + 1
    assert got == {("a", "TYPE-1"): 20, ("a", "TYPE-2"): 5, ("b", "TYPE-1"): 1, ("b", "TYPE-2"): 1}


def test_retry_only_touches_bad_answers(spark):
    rows = [(1, "ok", "@@x## y"), (2, "none", "x"), (3, "open", "@@x@@"), (4, "lost", None), (5, "full", "@@full##")]
    df = spark.createDataFrame(rows, "request_id long, sentence string, answer string").withColumn(
        "messages", R.build_messages(F.lit("s"), F.lit("i"), None, F.col("sentence")))
    texts = {"NO-ANNOT": "mark it", "BAD-BOUNDS": "close it", "FULL-ANNOT": "less"}
    again = {r.request_id: r for r in R.retry_requests(df, texts).collect()}
    assert set(again) == {2, 3} and len(again[2].messages) == 5
    assert again[2].messages[-1].content == "mark it\nSentence: none\n" and again[3].messages[-2].content == "@@x@@"
    assert {r.request_id for r in R.retry_requests(df, texts, check_full=True).collect()} == {2, 3, 5}
    second = spark.createDataFrame([(2, "@@none##"), (3, None)], "request_id long, answer string")
    merged = {r.request_id: r.answer for r in R.merge_passes(df, second).collect()}
    assert merged == {1: "@@x## y", 2: "@@none##", 3: None, 4: None, 5: "@@full##"}


def test_labels_and_direct_annotations(spark):
    df = spark.createDataFrame([("s", ["a", "LABEL NOT PRESENT"]), ("t", []), ("u", None)], "sentence string, skills array<string>")
    rows = R.explode_labels(df)
    assert {tuple(r) for r in rows.collect()} == {("s", "a"), ("s", "LABEL NOT PRESENT"), ("t", None), ("u", None)}
    assert [tuple(r) for r in R.direct_annotations(rows).collect()] == [("s", "LABEL NOT PRESENT", "s")]


def test_additional_info(spark):
    combos = spark.createDataFrame([(1, ["b", "a"])], "draw_id long, members array<string>")
    tax = spark.createDataFrame([("a", "A, AA", "first"), ("b", None, "second")], "name string, alt_labels string, description string")
    got = R.additional_info(combos, tax).first().additional
    assert got == "1) b : can also be referred as :  and described as : second.2) a : can also be referred as : A, AA and described as : first."


def test_list_text_escapes_control_characters(spark):
    from spanloom.functions.text import parse_list

    items = ["a\tb", "c\x01d", "e\rf\ng", "it's", 'say "x"', "back\\slash"]
    row = spark.createDataFrame([(items,)], "l array<string>").select(R.list_text(F.col("l")).alias("t")).select(
        "t", parse_list("t").alias("back")).first()
    assert row.t == repr(items) and row.back == items


def test_status_without_refine_text_is_an_error(spark):
    rows = spark.createDataFrame([("s", [("user", "x")], "nothing marked")], f"sentence string, messages {R.MESSAGES}, answer string")
    with pytest.raises(Exception, match="no refine text"):
        R.retry_requests(rows, {"BAD-BOUNDS": "close"}).collect()
