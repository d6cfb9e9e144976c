import re

import pytest
from pyspark.sql import functions as F

from spanloom.functions import text as X


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def rows(spark, values, column):
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r.x for r in df.select("i", column.alias("x")).orderBy("i").collect()]


def test_drop_short_text_is_strict(spark):
    df = spark.createDataFrame([("a b c",), ("a b c d",), ("  a\tb\nc d e ",), ("",)], "t string")
    assert [r.t for r in X.drop_short_text(df, "t", 3).collect()] == ["a b c d", "  a\tb\nc d e "]


def test_words_split_like_python(spark):
    texts = ["", "  ", "a", " a  b c\x1cd\x85e ", "É ß"]
    assert rows(spark, texts, X.words("t")) == [t.split() for t in texts]
    assert rows(spark, texts, X.word_count("t")) == [len(t.split()) for t in texts]


def test_tenth_tag_ends_a_sentence(spark):
    html = "x" + "".join(f"<t{i}>{i}" for i in range(1, 22)) + "<open\ntag>"
    count = 0

    def tag(_):
        nonlocal count
        count += 1
        return ". " if count % 10 == 0 else " "

    assert rows(spark, [html, "no tags", "<a>"], X.replace_html_tags("t")) == [re.sub("<.*?>", tag, html), "no tags", " "]


def test_clean_text(spark):
    texts = ["a\\nb", "  ...x.. ", " y\\n\\n", ""]
    want = [t.replace("\\n", ". ").strip().replace("..", ".") for t in texts]
    assert rows(spark, texts, X.clean_text("t")) == want


def test_anonymize_masks_in_order_and_knows_accents(spark):
    texts = ["John Smith", "Zoé Martin", "Éric Jones and Ann Lee", "123456789 1234567890 123456789012 1234567890123",
             "Ann Lee ann.lee@mail.example.com", "a A a"]
    want = []
    for t in texts:
        t = re.sub(r"\b[A-Z][a-z]*\s[A-Z][a-z]*\b", "REDACTED_NAME", t)
        t = re.sub(r"\b\d{10,12}\b", "REDACTED_PHONE", t)
        want.append(re.sub(r"\b[\w\.-]+@[\w\.-]+\.\w+\b", "REDACTED_EMAIL", t))
    assert rows(spark, texts, X.anonymize_text("t")) == want


def test_spans(spark):
    texts = ["none", "@@Open", "closed##", "@@##", "@@A## x @@b##", "@@a\nb##", "@@All of it##", "@@a @@b## c##"]
    want = [[x.lower() for x in re.findall("@@(.*?)##", t)] for t in texts]
    assert rows(spark, texts, X.extract_spans("t")) == want
    assert rows(spark, texts, X.annotation_status("t"))[:4] == ["NO-ANNOT", "BAD-BOUNDS", "OK", "OK"]
    assert rows(spark, texts, X.covers_whole_sentence("t")) == [False, False, False, False, False, True, True, False]


def test_annotate_nests_a_span_inside_another(spark):
    df = spark.createDataFrame([("use java and javascript", ["java", "script"])], "s string, p array<string>")
    assert df.select(X.annotate_spans("s", "p").alias("x")).first().x == "use @@java## and @@java##@@script##"


def test_levels_and_names(spark):
    named = [(f"l{i}", f"Type Level {i}") for i in range(1, 5)]
    df = spark.createDataFrame(
        [("a", "b", None, None), ("a", None, None, "d"), (None, None, None, None)], "l1 string, l2 string, l3 string, l4 string")
    assert [r.x for r in df.select(X.lowest_level(*named).alias("x")).collect()] == ["b_Type Level 2", "d_Type Level 4", None]
    assert [r.x for r in df.select(X.name_definition("l2", "l3", "l4", F.lit("D")).alias("x")).collect()] == ["b: D", None, None]
    assert rows(spark, ["a : b : c", "a: b", "x"], X.name_before_definition("t")) == ["a", "a: b", "x"]


@pytest.mark.parametrize("skill, raw, want", [
    ("java", "1. spring\n2. javax\n3. spring, , jvm", "spring, jvm"),
    ("sql", "Names: 1. db query: other", " 1. db query".replace("1. ", "")),
    ("zz", "one two three four five six seven eight nine ten, a", "a"),
    ("zz", "one two three four five six seven eight nine", "one two three four five six seven eight nine"),
])
def test_clean_alternative_names(spark, skill, raw, want):
    assert one(spark, X.clean_alternative_names(F.lit(skill), "raw"), raw=raw) == want


def test_list_text_is_parsed_without_running_it(spark):
    texts = ["['a','b']", "[\"it's\", 'x']", "[]", "['say \"x\"']", "nothing", "['caf\\xe9']", None]
    assert rows(spark, texts, X.parse_list("t")) == [["a", "b"], ["it's", "x"], [], ['say "x"'], None, ["café"], None]


def test_parse_levels(spark):
    got = rows(spark, ['{"a": "x", "b": "y"}', "{bad", "{}", ""], X.parse_levels("t"))
    assert [[(e.skill, e.level) for e in r] for r in got] == [[("a", "x"), ("b", "y")], [], [], []]


def test_cost(spark):
    cost = X.token_cost(F.col("m"), F.lit(1000), F.lit(100), {"a": (1.5e-6, 2e-6), "b": (3e-5, 6e-5)})
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "m string")
    got = [r.x for r in df.select(cost.alias("x")).collect()]
    assert got[0] == pytest.approx(0.0017) and got[1] == pytest.approx(0.036) and got[2] is None
