"""Readers and writers. Schemas are given, never inferred."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.functions.text import parse_list
from spanloom.operators.taxonomy import complete_taxonomy, embedded_views, merge_taxonomies

CSV_OPTIONS = {"multiLine": "true", "escape": '"', "quote": '"'}
DEBUG_ROWS = 100

# Column names of a taxonomy CSV and ours.
TAXONOMY_HEADER = {
    "unique_id": "unique_id",
    "ElementID": "element_id",
    "Type Level 1": "level1",
    "Type Level 2": "level2",
    "Type Level 3": "level3",
    "Type Level 4": "level4",
    "Example": "example",
    "Definition": "definition",
}


def strings(names) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_samples_csv(spark: SparkSession, path: str, names, index: str | None = None, header: bool = False) -> DataFrame:
    """CSV with the given column names, without its index column and without incomplete rows."""
    reader = spark.read.schema(strings(names)).options(**CSV_OPTIONS).option("header", str(header).lower())
    rows = reader.option("enforceSchema", "true").csv(path)
    return (rows.drop(index) if index else rows).na.drop()


def parse_list_column(df: DataFrame, column: str, corrupt: str = "_corrupt") -> DataFrame:
    """Turn list text into an array; rows that hold no list get null and are marked."""
    parsed = parse_list(column)
    return df.withColumn(corrupt, F.col(column).isNotNull() & parsed.isNull()).withColumn(column, parsed)


def read_records(spark: SparkSession, path: str, schema) -> DataFrame:
    """Line-delimited records."""
    return spark.read.schema(schema).json(path)


def read_labelled(spark: SparkSession, schema, debug: bool = False, **paths: str) -> dict[str, DataFrame]:
    """Splits by file extension (csv or json), for a trial run the first 100 rows of each."""
    out = {}
    for split, path in paths.items():
        kind = path.rstrip("/").rsplit(".", 1)[-1]
        if kind not in ("csv", "json"):
            raise ValueError(f"{split} should be a csv or a json file")
        reader = spark.read.schema(schema)
        df = reader.options(**CSV_OPTIONS).option("header", "true").csv(path) if kind == "csv" else reader.json(path)
        out[split] = df.limit(DEBUG_ROWS) if debug else df
    return out


def read_taxonomy_csv(spark: SparkSession, path: str, header: list[str]) -> DataFrame:
    """Taxonomy CSV with the header's columns, completed to the nine taxonomy columns."""
    missing = [c for c in TAXONOMY_HEADER if c not in header]
    if missing:
        raise ValueError(f"the taxonomy lacks {missing}")
    raw = spark.read.schema(strings(header)).options(**CSV_OPTIONS).option("header", "true").csv(path)
    renamed = raw.select(*[F.col(f"`{old}`").alias(new) for old, new in TAXONOMY_HEADER.items()])
    return complete_taxonomy(renamed.withColumn("unique_id", F.col("unique_id").cast("bigint")))


def read_embedded_taxonomy(spark: SparkSession, *paths: str) -> tuple[DataFrame, DataFrame]:
    """Merged taxonomy splits, with and without vectors."""
    return embedded_views(merge_taxonomies(*[spark.read.parquet(p) for p in paths]))


def write_splits(df: DataFrame, path: str, kind: str = "parquet", split: str = "split") -> None:
    writer = df.write.mode("overwrite").partitionBy(split)
    if kind == "csv":
        flat = [F.to_json(c).alias(c) if isinstance(df.schema[c].dataType, T.ArrayType) else F.col(c) for c in df.columns]
        writer = df.select(*flat).write.mode("overwrite").partitionBy(split).options(header="true", **CSV_OPTIONS)
    writer.format(kind).save(path)


def batch_of(draw: Column, frequency: int) -> Column:
    return F.floor(draw / F.lit(frequency)).cast("bigint")


def write_batches(df: DataFrame, path: str, draw: str = "draw_id", frequency: int = 100) -> None:
    """Write rows with the batch of ``frequency`` draws they belong to; a batch written again replaces its old rows.

    A write is one folder, however many batches it holds; :func:`read_batches`
    takes each batch from the last folder that has it.
    """
    attempt = f"{time.time_ns():020d}"
    df.withColumn("batch_id", batch_of(F.col(draw), frequency)).write.json(f"{path}/attempt={attempt}")


def read_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows written by :func:`write_batches`; ``schema`` includes batch_id."""
    rows = spark.read.schema(f"{schema}, attempt string").json(path)
    last = rows.groupBy("batch_id").agg(F.max("attempt").alias("attempt"))
    return rows.join(last, ["batch_id", "attempt"], "left_semi").drop("attempt")


def pending(requests: DataFrame, done: DataFrame, draw: str = "draw_id", frequency: int = 100) -> DataFrame:
    """Requests of batches that are missing or short of rows in ``done`` (read back with batch_id)."""
    batched = requests.withColumn("batch_id", batch_of(F.col(draw), frequency))
    asked = batched.groupBy("batch_id").agg(F.count("*").alias("n"))
    held = done.groupBy(F.col("batch_id").cast("bigint").alias("batch_id")).agg(F.count("*").alias("n"))
    finished = asked.join(held, ["batch_id", "n"], "left_semi").select("batch_id")
    return batched.join(finished, "batch_id", "left_anti").drop("batch_id")


def write_predictions(df: DataFrame, path: str, predicted: str = "predictions", gold: str = "gold") -> None:
    """Tab-separated predicted and gold label lists as JSON text."""
    flat = df.select(F.to_json(predicted).alias("predictions"), F.to_json(gold).alias("gold"))
    flat.write.mode("overwrite").options(sep="\t", header="true", quote="", escape="").csv(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(strings(["predictions", "gold"])).options(sep="\t", header="true", quote="").csv(path)
    return rows.select(*[F.from_json(c, "array<string>").alias(c) for c in ("predictions", "gold")])


def write_metrics(df: DataFrame, path: str, run: dict[str, str] | None = None) -> None:
    """Metrics as JSON; the run's arguments become partition columns."""
    run = run or {}
    named = df.select("*", *[F.lit(str(v)).alias(k) for k, v in run.items()])
    writer = named.write.mode("overwrite")
    if run:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*run)
    writer.json(path)
