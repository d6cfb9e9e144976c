"""Taxonomy tables: merging, derived columns, dictionary terms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.functions.text import name_definition

TAXONOMY_COLUMNS = (
    "unique_id", "element_id", "level1", "level2", "level3", "level4", "example", "definition", "name_definition",
)


def merge_taxonomies(*tables: DataFrame, name: str = "name", order: str = "unique_id") -> DataFrame:
    """Rows of all tables, the first row of each name kept: earlier table, then smaller id."""
    ranked = [t.withColumn("__table", F.lit(i)) for i, t in enumerate(tables)]
    both = reduce(lambda a, b: a.unionByName(b), ranked)
    w = Window.partitionBy(name).orderBy("__table", order)
    # row_number = 1 keeps one row per name in each map task before the shuffle
    return both.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", "__table")


def distinct_sentences(df: DataFrame, sentence: str = "sentence", order=()) -> DataFrame:
    """One row per sentence, so that a repeated sentence is embedded once."""
    w = Window.partitionBy(sentence).orderBy(*(order or [sentence]))
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def complete_taxonomy(raw: DataFrame) -> DataFrame:
    """Drop rows without definition or level 2, add name_definition, keep the nine columns."""
    known = raw.na.drop(subset=["definition", "level2"])
    full = known.withColumn("name_definition", name_definition("level2", "level3", "level4", "definition"))
    return full.select(*TAXONOMY_COLUMNS)


def embedded_views(taxonomy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The taxonomy with its alternative names as example, with and without vectors."""
    full = taxonomy.withColumn("example", F.col("alt_labels"))
    return full, full.drop("embedding")
