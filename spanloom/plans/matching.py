"""Extract, select candidates, match, score: each stage runs for all records at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.text import extract_spans, parse_levels, strip
from spanloom.operators import metrics as M
from spanloom.operators import requests as R
from spanloom.operators.candidates import CANDIDATE_COLUMNS

OPTION = CANDIDATE_COLUMNS

def extraction_requests(records: DataFrame, templates: DataFrame, shots: DataFrame | None = None) -> DataFrame:
    """(record_id, messages). ``records`` has (record_id, sentence, data_type, prompt_type).

    ``shots`` (record_id, shots) replaces the template's own shots.
    """
    asked = records.withColumn("task", F.lit("extraction"))
    R.require_valid_kinds(asked, templates)
    full = R.with_templates(asked, templates)
    if shots is not None:
        full = full.drop("shots").join(shots, "record_id", "left")
    chat = R.build_messages(F.col("system"), F.col("instruction"), F.col("shots"), F.col("sentence"), R.EXTRACTION_SHOTS)
    return full.select("record_id", chat.alias("messages"))


def extraction_shots(support: DataFrame) -> DataFrame:
    """(record_id, shots) from the support rows chosen for each record."""
    shot = R.extraction_shot(F.col("sentence"), F.col("annotated_sentence"))
    listed = F.array_sort(F.collect_list(F.struct("rank", shot.alias("shot"))))
    return support.groupBy("record_id").agg(listed.alias("s")).select(
        "record_id", F.transform("s", lambda e: e["shot"]).alias("shots"))


def extracted(records: DataFrame, answers: DataFrame, with_levels: bool = False) -> DataFrame:
    """Records with their spans (and levels) as the answer marked them."""
    answer = strip(F.lower("answer"))
    joined = records.join(answers, "record_id", "left")
    if with_levels:
        pairs = joined.withColumn("levels", parse_levels(answer)).drop("answer")
        return pairs.withColumn("spans", F.transform("levels", lambda e: e["skill"]))
    found = F.coalesce(extract_spans(answer), F.array().cast("array<string>"))
    return joined.withColumn("spans", found).drop("answer")


def matching_requests(records: DataFrame, candidates: DataFrame, templates: DataFrame,
                      shots: DataFrame | None = None) -> DataFrame:
    """(record_id, span, options, messages): one multiple-choice question per record and span.

    ``options`` are the candidate records in the order of their ``rank``, best
    first. ``templates`` has (data_type, system, instruction, shots) of the
    matching task; a data type without one is an error.
    """
    R.require_valid_kinds(records, templates, ["data_type"])
    listed = F.array_sort(F.collect_list(F.struct("rank", *OPTION)))
    options = candidates.groupBy("record_id", "span").agg(listed.alias("o")).select(
        "record_id", "span", F.transform("o", lambda e: F.struct(*[e[c].alias(c) for c in OPTION])).alias("options"))
    full = options.join(records.select("record_id", "sentence", "data_type"), "record_id").join(templates, "data_type")
    if shots is not None:
        full = full.drop("shots").join(shots, "record_id", "left")
    shown = F.transform("options", lambda o: o["name_definition"])
    question = R.choice_question(F.col("sentence"), F.col("span"), shown)
    chat = R.build_messages(F.col("system"), F.col("instruction"), F.col("shots"), question)
    return full.select("record_id", "span", "options", chat.alias("messages"))


def matched_records(records: DataFrame, questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Records with ``predicted`` names and ``matches`` (span and the chosen entity's record), in span order."""
    found = R.match_answers(questions, answers)
    order = records.select("record_id", F.posexplode("spans").alias("i", "span")).groupBy("record_id", "span").agg(
        F.min("i").alias("i"))
    listed = F.array_sort(F.collect_list(F.struct("i", "span", *OPTION)))
    names = found.join(order, ["record_id", "span"]).groupBy("record_id").agg(listed.alias("m"))
    matches = F.transform("m", lambda e: F.struct(*[e[c].alias(c) for c in ("span", *OPTION)]))
    joined = records.join(names, "record_id", "left").withColumn("matches", matches).drop("m")
    full = joined.withColumn("matches", F.coalesce("matches", F.array().cast(joined.schema["matches"].dataType)))
    return full.withColumn("predicted", F.transform("matches", lambda e: e["name"]))


def scores(matched: DataFrame, gold: str = "skills", by=()) -> DataFrame:
    """Recall, precision and F1 over all records, per run if asked."""
    return M.micro_scores(matched, gold, "predicted", by=by)


