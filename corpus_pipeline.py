"""From documents to training shards: language ID, near duplicates, decontamination, mixing, sharding.

Each stage takes the rows that the one before kept and returns the columns of
``documents``; the last returns each row's place. Between stages the rows are
written to the shared folder and read again, so a lost executor costs no more
than a part of one stage.

In every stage a null or empty text, repeated rows, an empty table and further
columns have a defined result; see the stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import kdtree, mixing, order_minhash, ppm, wumanber
from spanloom.llm.common import read, remainder
from spanloom.session import cut_lineage

#: Share of the probability that the best language must have.
SURE = 0.5
SHARD_BYTES = 64 << 20
KEY = "__pipeline_key"


def with_key(docs: DataFrame) -> DataFrame:
    """``row`` (all columns) and a key: text that sorts as doc_id does, null last, with the text's hash.

    Rows that agree in it are the same document.
    """
    number = F.when(F.col("doc_id").isNull(), F.lit("~")).otherwise(F.format_string("%020d", F.col("doc_id").cast("bigint")))
    key = F.concat(number, F.lit(":"), F.hex(F.xxhash64("text")))
    return docs.select(key.alias(KEY), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model is sure of.

    Null texts, texts without a letter and unsure ones go; repeated rows stay as they are.
    """
    model = ppm.train(docs.where(remainder("doc_id", 4) != 2), "text", "lang", "doc_id")
    found = ppm.predict(docs, model, "text")
    return found.where((F.col("lang_pred") != ppm.UNKNOWN) & (F.col("score") >= SURE)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of every class of near duplicates.

    Null texts are classes of their own, empty ones are copies; of repeated rows one stays.
    """
    keyed = with_key(docs)
    classes = order_minhash.near_classes(keyed.select(KEY, "row.text"), KEY, "text")
    stays = classes.where(F.col(KEY) == F.col("class_id")).select(KEY).distinct()
    return keyed.join(stays, KEY, "left_semi").dropDuplicates([KEY]).select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item; those without words stay."""
    found = wumanber.contaminated_spans(docs, read(spark, sf_dir, "benchmark"))
    return found.where(F.size("spans") == 0).select("row.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, twice at most; documents without words are never taken."""
    keyed = with_key(docs)
    taken = mixing.mix(keyed.select(KEY, "row.text", "row.source"), KEY, "text", "source").where("taken > 0").groupBy(KEY).agg(
        F.sum(F.col("taken") / F.col("size")).cast("int").alias("copies"))
    again = F.explode(F.sequence(F.lit(1), F.col("copies")))
    return keyed.dropDuplicates([KEY]).join(taken, KEY).withColumn("copy", again).select("row.*")


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row; null texts have size 1."""
    return kdtree.kd_shards(docs, "doc_id", "text", ["lang", "source"], target_bytes=SHARD_BYTES)


STAGES = [
    ("language_id", languages),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixture),
    ("sharding", shards),
]
#: Context trees, sketches and k-d cuts have no SQL form. Tests check near duplicates and decontamination against plain
#: Python, the mix against its targets, the shards against their law; the code lengths of languages have a test of their own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return docs


QUERIES = {"pipeline": (run, ORACLE_SQL)}
