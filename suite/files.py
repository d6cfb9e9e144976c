"""Readers and writers: every query writes whole tables and reads them back."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from spanloom.operators import embedding as E
from spanloom.operators import metrics as M
from spanloom.session import cut_lineage, shared_folder
from spanloom.sources import tables as S
from suite.combos import COMBOS_SQL, combos
from suite.common import ENTITIES_SQL, entities, joined, predictions, read
from suite.matching import SPLIT_SQL, split_disjoint
from suite.scores import PRF_SHOWN, PREDICTIONS_SQL, prf_sql
from suite.texts import COMPLETE_SQL, parts


def fresh(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def roundtrip_csv(spark, folder):
    path = fresh(spark, "samples")
    docs = read(spark, folder, "documents").select(F.col("doc_id").alias("idx"), "text", "lang")
    docs.write.options(**S.CSV_OPTIONS).csv(path)
    back = S.read_samples_csv(spark, path, ["idx", "sentence", "lang"])
    without = S.read_samples_csv(spark, path, ["idx", "sentence", "lang"], index="idx")
    total = without.agg(F.count("*").alias("n")).scalar()
    return back.select(F.col("idx").cast("bigint").alias("doc_id"), "sentence", "lang", total.alias("total"))


ROUNDTRIP_SQL = "SELECT doc_id, text AS sentence, lang, (SELECT count(*) FROM documents) AS total FROM documents"


def records_json(spark, folder):
    path = fresh(spark, "records") + ".json"
    rows = read(spark, folder, "conversations")
    rows.write.json(path)
    schema = rows.schema
    return S.read_records(spark, path, schema).unionByName(S.read_labelled(spark, schema, train=path)["train"])


RECORDS_SQL = "SELECT * FROM conversations UNION ALL SELECT * FROM conversations"


def labelled_csv(spark, folder):
    """Labelled splits read by extension: documents of both qualities through CSV files, texts with newlines and quotes included."""
    rows = read(spark, folder, "documents").join(read(spark, folder, "labels"), "doc_id").select("doc_id", "text", "quality")
    paths = {}
    for split, quality in (("train", 1), ("validation", 0)):
        paths[split] = fresh(spark, split) + ".csv"
        rows.where(F.col("quality") == quality).write.options(header="true", **S.CSV_OPTIONS).csv(paths[split])
    splits = S.read_labelled(spark, rows.schema, **paths)
    return splits["train"].select("*", F.lit("train").alias("split")).unionByName(
        splits["validation"].select("*", F.lit("validation").alias("split"))).select("doc_id", F.md5("text").alias("text_md5"), "quality", "split")


LABELLED_CSV_SQL = """SELECT doc_id, md5(text) AS text_md5, quality, CASE quality WHEN 1 THEN 'train' ELSE 'validation' END AS split
FROM documents JOIN labels USING (doc_id)"""


def taxonomy_csv(spark, folder):
    path = fresh(spark, "taxonomy")
    named = parts(spark, folder).select(*[F.col(ours).alias(theirs) for theirs, ours in S.TAXONOMY_HEADER.items()])
    named.write.options(header="true", **S.CSV_OPTIONS).csv(path)
    return S.read_taxonomy_csv(spark, path, list(S.TAXONOMY_HEADER))


def embedded_taxonomy(spark, folder):
    """Two splits that share entities, merged on the name."""
    path = fresh(spark, "entities")
    rows = entities(spark, folder).withColumn("alt_labels", F.concat(F.lit("also "), "name"))
    rows.where("level2 < '5'").write.parquet(path + "/a")
    rows.write.parquet(path + "/b")
    full, plain = S.read_embedded_taxonomy(spark, path + "/a", path + "/b")
    return full.select("unique_id", "name", "example", F.size("embedding").alias("dimensions")).join(
        plain.select("unique_id", "level2"), "unique_id")


EMBEDDED_SQL = f"""WITH {ENTITIES_SQL}
SELECT unique_id, name, 'also ' || name AS example, len(e)::INTEGER AS dimensions, level2 FROM ents
QUALIFY row_number() OVER (PARTITION BY name ORDER BY level2 >= '5', unique_id) = 1"""


def splits_csv(spark, folder):
    path = fresh(spark, "splits")
    S.write_splits(split_disjoint(spark, folder), path, "csv")
    return spark.read.schema("doc_id bigint, split string").option("header", "true").csv(path)


def checkpoint_resume(spark, folder):
    """The first round of draws is stored; the rest is still to do."""
    path = fresh(spark, "batches")
    rows = cut_lineage(combos(spark, folder), "combos")
    count = read(spark, folder, "embeddings").count()
    S.write_batches(rows.where(F.col("draw_id") < count), path, frequency=100)
    S.write_batches(rows.where(F.col("draw_id") < count), path, frequency=100)
    done = S.read_batches(spark, path, "draw_id bigint, anchor string, batch_id bigint")
    return S.pending(rows, done, frequency=100).select("draw_id", "anchor")


RESUME_SQL = f"""WITH {COMBOS_SQL}
SELECT draw_id::BIGINT AS draw_id, anchor FROM combos
WHERE draw_id // 100 >= (SELECT count(*) FROM embeddings) // 100"""


def predictions_tsv(spark, folder):
    path = fresh(spark, "predictions")
    S.write_predictions(predictions(spark, folder), path, "predicted", "gold")
    back = S.read_predictions(spark, path).select(joined("predictions").alias("predicted"), joined("gold").alias("gold"))
    return back.groupBy("predicted", "gold").agg(F.count("*").alias("n"))


TSV_SQL = f"""WITH {PREDICTIONS_SQL}
SELECT array_to_string(predicted, '|') AS predicted, array_to_string(list_sort(gold), '|') AS gold, count(*) AS n
FROM preds GROUP BY ALL"""


def metrics_json(spark, folder):
    path = fresh(spark, "metrics")
    scores = M.micro_scores(predictions(spark, folder), by=["run_id"])
    S.write_metrics(scores, path, {"support": "kNN", "candidates": "10"})
    schema = "run_id int, tp bigint, fp bigint, fn bigint, precision double, recall double, f1 double, support string, candidates int"
    back = spark.read.schema(schema).json(path)
    return back.select("run_id", "tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")],
                       "support", "candidates")


METRICS_COUNTS = """SELECT run_id, sum(len(list_intersect(predicted, gold)))::BIGINT AS tp,
    sum(len(list_filter(list_distinct(predicted), lambda x: NOT list_contains(gold, x))))::BIGINT AS fp,
    sum(len(list_filter(gold, lambda x: NOT list_contains(predicted, x))))::BIGINT AS fn FROM preds GROUP BY run_id"""
METRICS_SQL = f"WITH {PREDICTIONS_SQL}, {prf_sql(METRICS_COUNTS)} " + PRF_SHOWN.replace(
    " FROM scored", ", 'kNN' AS support, 10::INTEGER AS candidates FROM scored")


def shape_encoder():
    """A small encoder for the check: length, spaces and line ends of a text."""
    return lambda texts: pd.Series([[float(len(t)), float(t.count(" ")), float(t.count("\n"))] for t in texts])


def embed_large(spark, folder):
    """All documents embedded, by a run over one language and a second one over all that finds these texts done."""
    docs, path = read(spark, folder, "documents"), fresh(spark, "vectors")
    rows = docs.select("doc_id", "text")
    E.embed_to_parquet(docs.where("lang = 'en'").select("doc_id", "text"), "text", shape_encoder, path)
    written = E.embed_to_parquet(rows, "text", shape_encoder, path)
    at = lambda i: F.element_at("embedding", i).cast("bigint")
    return written.select("doc_id", at(1).alias("characters"), at(2).alias("spaces"), at(3).alias("lines"))


EMBED_SQL = """SELECT doc_id, length(text) AS characters, (length(text) - length(replace(text, ' ', '')))::BIGINT AS spaces,
  (length(text) - length(replace(text, chr(10), '')))::BIGINT AS lines FROM documents"""


QUERIES = {
    "roundtrip_csv": (roundtrip_csv, ROUNDTRIP_SQL),
    "records_json": (records_json, RECORDS_SQL),
    "labelled_csv": (labelled_csv, LABELLED_CSV_SQL),
    "taxonomy_csv": (taxonomy_csv, COMPLETE_SQL),
    "embedded_taxonomy": (embedded_taxonomy, EMBEDDED_SQL),
    "splits_csv": (splits_csv, SPLIT_SQL),
    "checkpoint_resume": (checkpoint_resume, RESUME_SQL),
    "predictions_tsv": (predictions_tsv, TSV_SQL),
    "metrics_json": (metrics_json, METRICS_SQL),
    "embed_large": (embed_large, EMBED_SQL),
}
