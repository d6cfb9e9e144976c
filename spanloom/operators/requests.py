"""Request tables for an outside text model, and ingest of its answers.

No model is called here: a request is a row with a message list, an answer is a
row with the same id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.functions.text import annotation_status, covers_whole_sentence, needs_annotation, strip

MESSAGES = "array<struct<role:string,content:string>>"
SHOTS = "array<struct<question:string,answer:string>>"

# Size limits of the two sentence modes, placeholder defaults,
# share of each negative type, samples per negative request, options per question.
DENSE_MAX = 4
SPARSE_MIN = 3
PLACEHOLDER_DEFAULTS = {
    "typeOfAdditionalInfo": "Alternative names (you may discard this information if irrelevant)",
    "nExamples": "five",
    "implicitCount": "two",
}
NEGATIVE_SHARES = {"TYPE-1": 0.8, "TYPE-2": 0.2}
NEGATIVES_PER_REQUEST = 20
OPTION_COUNT = 26
EXTRACTION_SHOTS = 6

# Layout of an additional-information line and of a multiple-choice question.
ADDITIONAL_LINE = "%s) %s : can also be referred as : %s and described as : %s."
CHOICE_LAYOUT = "Sentence: %s \nSkill: %s \nOptions: %s"

AVOID_INTRODUCTION = "Do not use any of these terms in the text : "


def route_modes(combos: DataFrame, forced: str | None = None, size: str = "size") -> DataFrame:
    """One row per mode: up to 4 members dense, from 3 members sparse, so 3 and 4 give both."""
    if forced is not None:
        return combos.withColumn("mode", F.lit(forced))
    modes = F.array_compact(F.array(
        F.when(F.col(size) <= DENSE_MAX, "dense"), F.when(F.col(size) >= SPARSE_MIN, "sparse")
    ))
    return combos.withColumn("mode", F.explode(modes))


def list_text(items: Column) -> Column:
    """``['a', 'b']`` the way Python prints a list of strings, control characters escaped."""

    def escaped(s):
        for code in (*range(32), *range(127, 161)):
            s = F.replace(s, F.lit(chr(code)), F.lit(repr(chr(code))[1:-1]))
        return s

    def quoted(s):
        s = F.replace(s, F.lit("\\"), F.lit("\\\\"))
        s = F.when(s.rlike(r"[\x00-\x1f\x7f-\xa0]"), escaped(s)).otherwise(s)
        double = s.contains("'") & ~s.contains('"')
        return F.when(double, F.concat(F.lit('"'), s, F.lit('"'))).otherwise(
            F.concat(F.lit("'"), F.replace(s, F.lit("'"), F.lit("\\'")), F.lit("'"))
        )

    return F.concat(F.lit("["), F.array_join(F.transform(items, quoted), ", "), F.lit("]"))


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """Replace each ``{name}`` once, left to right; unknown names become empty.

    Text that comes in through a value is not searched for placeholders again.
    """
    pattern = r"\{(.+?)\}"
    names = F.regexp_extract_all(template, F.lit(pattern), 1)
    pieces = F.split(template, pattern, -1)
    filled = F.create_map(*[part for name, value in values.items() for part in (F.lit(name), value)]) if values else None
    value_of = (lambda n: F.coalesce(F.try_element_at(filled, n), F.lit(""))) if values else (lambda n: F.lit(""))
    joined = F.transform(
        pieces, lambda p, i: F.when(i == 0, p).otherwise(F.concat(value_of(F.get(names, i - 1)), p))
    )
    return F.array_join(joined, "")


def placeholder_values(members: Column, additional: Column | None = None, avoid: Column | None = None,
                       overrides: dict[str, str] | None = None,
                       avoid_introduction: str = AVOID_INTRODUCTION) -> dict[str, Column]:
    """Values of the known placeholders for a combination; ``overrides`` win."""
    size = F.size(members)
    least = F.greatest(F.lit(1), size - 2)
    empty = F.lit("")
    values = {name: F.lit(text) for name, text in PLACEHOLDER_DEFAULTS.items()}
    values["skillList"] = list_text(members)
    values["minNbSentences"] = F.concat(least.cast("string"), F.when(least == 1, " sentence").otherwise(" sentences"))
    values["maxNbSentences"] = (size + 1).cast("string")
    values["additionalInfo"] = F.coalesce(additional, empty) if additional is not None else empty
    values["wordsToAvoid"] = empty if avoid is None else F.when(
        F.size(avoid) > 0, F.concat(F.lit(avoid_introduction), F.array_join(avoid, ", "), F.lit(". "))
    ).otherwise(empty)
    values.update({name: F.lit(text) for name, text in (overrides or {}).items()})
    return values


def additional_info(combos: DataFrame, taxonomy: DataFrame, combo_id: str = "draw_id",
                    members: str = "members") -> DataFrame:
    """(combo, additional): numbered alternative names and descriptions of the members."""
    exploded = combos.select(combo_id, F.posexplode(members).alias("i", "name"))
    told = exploded.join(taxonomy.select("name", "alt_labels", "description"), "name").select(
        combo_id, "i",
        F.format_string(ADDITIONAL_LINE, (F.col("i") + 1).cast("string"), "name", F.coalesce("alt_labels", F.lit("")),
                        F.coalesce("description", F.lit(""))).alias("line"),
    )
    lines = F.array_sort(F.collect_list(F.struct("i", "line")))
    return told.groupBy(combo_id).agg(lines.alias("lines")).select(
        combo_id, F.array_join(F.transform("lines", lambda e: e["line"]), "").alias("additional")
    )


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def build_messages(system: Column, instruction: Column, shots: Column | None, user: Column,
                   max_shots: int | None = None) -> Column:
    """System, instruction, each shot as a question and an answer, then the input."""
    opening = F.array(message("system", system), message("user", instruction))
    parts = [opening]
    if shots is not None:
        kept = shots if max_shots is None else F.slice(shots, F.lit(1), F.lit(max_shots))
        turns = F.transform(kept, lambda s: F.array(message("user", s["question"]), message("assistant", s["answer"])))
        parts.append(F.coalesce(F.flatten(turns), F.array().cast(MESSAGES)))
    parts.append(F.array(message("user", user)))
    return F.concat(*parts)


def with_templates(requests: DataFrame, templates: DataFrame, keys=("data_type", "task", "prompt_type")) -> DataFrame:
    """Requests with the template of their kind."""
    return requests.join(templates, list(keys))


def invalid_kinds(requests: DataFrame, templates: DataFrame, keys=("data_type", "task", "prompt_type")) -> DataFrame:
    """Kinds asked for that have no template."""
    return requests.join(templates, list(keys), "left_anti").select(*keys).distinct()


def require_valid_kinds(requests: DataFrame, templates: DataFrame, keys=("data_type", "task", "prompt_type")) -> None:
    bad = invalid_kinds(requests, templates, keys).limit(5).collect()
    if bad:
        raise ValueError(f"no template for {[tuple(r) for r in bad]}")


def parse_shot(text: Column, drop_label: bool = True) -> Column:
    """struct(question, answer) from ``label: question\\nAnswer: answer``."""
    halves = F.split(text, "\nAnswer:", -1)
    question = strip(F.get(F.split(halves[0], ":", -1), F.lit(1))) if drop_label else halves[0]
    return F.struct(question.alias("question"), strip(F.get(halves, F.lit(1))).alias("answer"))


def option_lines(options: Column) -> Column:
    """``A: first``, ``B: second`` ... for at most 26 options."""
    kept = F.slice(options, F.lit(1), F.lit(OPTION_COUNT))
    return F.transform(kept, lambda o, i: F.concat(F.char(i + 65), F.lit(": "), o))


def choice_question(sentence: Column, span: Column, options: Column) -> Column:
    return F.format_string(CHOICE_LAYOUT, sentence, span, F.array_join(option_lines(options), " \n"))


def chosen_option(answer: Column, options: Column) -> Column:
    """Text of the option named by the answer's first letter; null for anything else."""
    letter = F.upper(F.substring(strip(F.lower(answer)), 1, 1))
    place = F.when(letter.rlike("^[A-Z]$"), F.ascii(letter) - 64)
    return F.when(place <= F.size(options), F.try_element_at(options, place))


def chosen_place(answer: Column, options: Column) -> Column:
    """1-based place of the first option with the chosen text."""
    return F.nullif(F.array_position(options, chosen_option(answer, options)), F.lit(0))


def match_answers(questions: DataFrame, answers: DataFrame, keys=("record_id", "span")) -> DataFrame:
    """(keys, name_definition), or (keys, the option's fields) where options are structs; unmatched spans leave."""
    joined = questions.join(answers, list(keys), "left")
    picked = joined.select(*keys, chosen_option(F.col("answer"), F.col("options")).alias("name_definition")).where("name_definition is not null")
    structs = isinstance(picked.schema["name_definition"].dataType, T.StructType)
    return picked.select(*keys, "name_definition.*") if structs else picked


def extraction_shot(sentence: Column, annotated: Column) -> Column:
    return F.struct(sentence.alias("question"), annotated.alias("answer"))


def matching_shot(sentence: Column, span: Column, options: Column, gold: Column) -> Column:
    """Question over the options with the gold option's letter as the answer."""
    place = F.array_position(F.slice(options, F.lit(1), F.lit(OPTION_COUNT)), gold)
    letter = F.when(place > 0, F.char(place.cast("int") + 64))
    return F.struct(choice_question(sentence, span, options).alias("question"), letter.alias("answer"))


def negative_plan(totals: DataFrame, total: str = "total", keep=(), shares: dict[str, float] | None = None,
                  per_request: int = NEGATIVES_PER_REQUEST) -> DataFrame:
    """One row per request for negatives: each type gets ceil(share * total / per_request)."""
    kinds = [F.struct(F.lit(k).alias("kind"), F.lit(float(s)).alias("share")) for k, s in (shares or NEGATIVE_SHARES).items()]
    planned = totals.select(*keep, total, F.explode(F.array(*kinds)).alias("__kind"))
    count = F.ceil(F.col("__kind.share") * F.col(total) / F.lit(float(per_request))).cast("int")
    return planned.where(count > 0).select(
        *keep, F.col("__kind.kind").alias("kind"), F.explode(F.sequence(F.lit(1), count)).alias("request_no")
    )


def explode_labels(df: DataFrame, labels: str = "skills", label: str = "skill") -> DataFrame:
    """One row per sentence and label; sentences without labels keep one row."""
    rest = [c for c in df.columns if c != labels]
    return df.select(*rest, F.explode_outer(labels).alias(label))


def attach_answers(requests: DataFrame, answers: DataFrame, key: str = "request_id") -> DataFrame:
    """Requests with their answer; a missing answer stays null."""
    return requests.join(answers, key, "left")


def direct_annotations(rows: DataFrame, label: str = "skill", sentence: str = "sentence") -> DataFrame:
    """Rows that need no request: the sentence is its own annotation."""
    return rows.where(~needs_annotation(label)).withColumn("annotated_sentence", F.col(sentence))


def retry_requests(answered: DataFrame, refine_texts: dict[str, str], sentence: str = "sentence",
                   messages: str = "messages", answer: str = "answer", check_full: bool = False) -> DataFrame:
    """Second-pass requests for badly marked answers: old messages, answer, refine text.

    Null answers are not retried here; a status without refine text fails the job. With ``check_full`` an answer that marks
    the whole sentence counts as bad, too.
    """
    status = annotation_status(answer)
    if check_full:
        status = F.when(covers_whole_sentence(answer), "FULL-ANNOT").otherwise(status)
    text = F.raise_error(F.concat(F.lit("no refine text for "), F.col("status"))).cast("string")
    for kind, refine in refine_texts.items():
        text = F.when(F.col("status") == kind, F.lit(refine)).otherwise(text)
    bad = answered.withColumn("status", status).where(F.col("status") != "OK")
    again = F.concat(text, F.lit("\nSentence: "), sentence, F.lit("\n"))
    return bad.withColumn(
        messages, F.concat(messages, F.array(message("assistant", F.col(answer)), message("user", again)))
    )


def merge_passes(first: DataFrame, second: DataFrame, key: str = "request_id", answer: str = "answer") -> DataFrame:
    """First-pass answers with those of the second pass in place of the retried ones."""
    again = second.select(key, F.col(answer).alias("__second"), F.lit(True).alias("__retried"))
    joined = first.join(again, key, "left")
    return joined.withColumn(
        answer, F.when(F.col("__retried"), F.col("__second")).otherwise(F.col(answer))
    ).drop("__second", "__retried")
