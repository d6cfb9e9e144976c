import pytest
from pyspark.sql import functions as F

from spanloom.operators import taxonomy as T
from spanloom.session import cut_lineage, shared_folder
from spanloom.sources import tables as S


def test_csv_without_index_and_nulls(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text('0,"two\nlines, ""quoted""","[\'a\', ""it\'s""]"\n1,,[]\n2,plain,broken\n')
    df = S.read_samples_csv(spark, str(path), ["idx", "sentence", "skills"], index="idx")
    got = {r.sentence: (r.skills, r._corrupt) for r in S.parse_list_column(df, "skills").collect()}
    assert got == {'two\nlines, "quoted"': (["a", "it's"], False), "plain": (None, True)}
    path.write_text("idx,sentence\n0,x\n")
    assert S.read_samples_csv(spark, str(path), ["idx", "sentence"], header=True).count() == 1


def test_labelled_splits(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"tokens": "x y", "labels": ["l"]}\n' * 150)
    (tmp_path / "b.csv").write_text("tokens,labels\nx,y\n")
    schema = "tokens string, labels array<string>"
    assert S.read_labelled(spark, schema, train=str(tmp_path / "a.json"))["train"].count() == 150
    assert S.read_labelled(spark, schema, debug=True, train=str(tmp_path / "a.json"))["train"].count() == 100
    assert S.read_labelled(spark, "tokens string, labels string", validation=str(tmp_path / "b.csv"))["validation"].first().labels == "y"
    with pytest.raises(ValueError, match="csv or a json"):
        S.read_labelled(spark, schema, train="x.txt")


def test_taxonomy_csv_needs_its_columns(spark, tmp_path):
    with pytest.raises(ValueError, match="Definition"):
        S.read_taxonomy_csv(spark, "x", ["unique_id"])
    header = [*S.TAXONOMY_HEADER, "extra"]
    (tmp_path / "t.csv").write_text(",".join(header) + "\n1,e,L1,L2,,L4,ex,def,z\n2,e,L1,,,,ex,def,z\n3,e,L1,L2,,,ex,,z\n")
    rows = S.read_taxonomy_csv(spark, str(tmp_path / "t.csv"), header).collect()
    assert [(r.unique_id, r.name_definition) for r in rows] == [(1, "L2: L4: def")] and len(rows[0]) == 9


def test_merge_prefers_the_earlier_table(spark):
    a = spark.createDataFrame([(5, "x"), (3, "x"), (1, "y")], "unique_id long, name string")
    b = spark.createDataFrame([(0, "x"), (7, "z")], "unique_id long, name string")
    assert {(r.unique_id, r.name) for r in T.merge_taxonomies(a, b).collect()} == {(3, "x"), (1, "y"), (7, "z")}
    assert T.distinct_sentences(spark.createDataFrame([("s", 2), ("s", 1)], "sentence string, i int"), order=["i"]).first().i == 1


def test_batches_resume(spark, tmp_path):
    path = str(tmp_path / "b")
    rows = spark.range(25).select(F.col("id").alias("draw_id"), F.lit("x").alias("v"))
    S.write_batches(rows.where("draw_id < 10 or draw_id = 12"), path, frequency=10)
    done = S.read_batches(spark, path, "draw_id long, v string, batch_id long")
    todo = S.pending(rows, done, frequency=10)
    assert sorted(r.draw_id for r in todo.collect()) == list(range(10, 25))
    S.write_batches(todo, path, frequency=10)
    done = S.read_batches(spark, path, "draw_id long, v string, batch_id long")
    assert done.count() == 25 and S.pending(rows, done, frequency=10).count() == 0


def test_splits_predictions_and_metrics(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", 'b"c\t'], "train"), (2, [], "dev")], "id long, l array<string>, split string")
    S.write_splits(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).where("split = 'dev'").count() == 1
    S.write_splits(df, str(tmp_path / "c"), "csv")
    assert spark.read.option("header", "true").csv(str(tmp_path / "c")).count() == 2
    S.write_predictions(df, str(tmp_path / "t"), "l", "l")
    assert sorted(r.gold for r in S.read_predictions(spark, str(tmp_path / "t")).collect()) == [[], ["a", 'b"c\t']]
    scores = spark.createDataFrame([(0.5,)], "f1 double")
    S.write_metrics(scores, str(tmp_path / "m"), {"run": 1})
    S.write_metrics(scores, str(tmp_path / "m"), {"run": 2})
    assert spark.read.json(str(tmp_path / "m")).count() == 2


def test_shared_folder_follows_the_setting(spark):
    folder = shared_folder(spark)
    assert folder == shared_folder(spark)
    assert cut_lineage(spark.range(10)).inputFiles()[0].replace("file://", "").startswith(folder.replace("file:", ""))
