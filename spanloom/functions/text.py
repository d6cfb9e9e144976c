"""Row-local text expressions. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Marker pair and the redaction patterns with their replacements.
SPAN_PATTERN = "@@([^\n]*?)##"
NAME_PATTERN = r"(?U)\b[A-Z][a-z]*\s[A-Z][a-z]*\b"
PHONE_PATTERN = r"(?U)\b\d{10,12}\b"
EMAIL_PATTERN = r"(?U)\b[\w\.-]+@[\w\.-]+\.\w+\b"
NAME_MASK, PHONE_MASK, EMAIL_MASK = "REDACTED_NAME", "REDACTED_PHONE", "REDACTED_EMAIL"
NO_LABEL_PRESENT = "LABEL NOT PRESENT"
UNDERSPECIFIED = "UNDERSPECIFIED"
UNKNOWN = "UNK"

SPACE = r"\s\x1c-\x1f"  # with (?U): the characters Python counts as white space
TAG_PATTERN = "<[^\n]*?>"
TAGS_PER_STOP = 10
LONG_SKILL_WORDS = 10


# Price per input and output token of the known models.
MODEL_PRICES = {
    "gpt-3.5-turbo": (0.0000015, 0.000002),
    "gpt-4": (0.00003, 0.00006),
    "text-davinci-003": (0.00002, 0.00002),
}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def word_count(text) -> Column:
    """Number of whitespace-separated tokens."""
    return F.regexp_count(_col(text), F.lit(f"(?U)[^{SPACE}]+"))


def words(text) -> Column:
    """Whitespace-separated tokens."""
    return F.filter(F.split(_col(text), f"(?U)[{SPACE}]+"), lambda w: w != "")


def drop_short_text(df: DataFrame, text: str, min_length: int = 100) -> DataFrame:
    """Keep rows with strictly more than ``min_length`` tokens."""
    return df.where(word_count(text) > min_length)


def replace_html_tags(text) -> Column:
    """Each tag becomes a space, each tenth tag of the row becomes a full stop."""
    pieces = F.split(_col(text), TAG_PATTERN, -1)
    glue = lambda i: F.when(i % TAGS_PER_STOP == 0, ". ").otherwise(" ")
    joined = F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(F.concat(glue(i), p)))
    return F.array_join(joined, "")


def strip(text) -> Column:
    return F.regexp_replace(_col(text), f"(?U)^[{SPACE}]+|[{SPACE}]+\\z", "")


def clean_text(text) -> Column:
    """Literal backslash-n to a full stop, strip, then double stops to one."""
    stopped = F.replace(_col(text), F.lit("\\n"), F.lit(". "))
    return F.replace(strip(stopped), F.lit(".."), F.lit("."))


def anonymize_text(text) -> Column:
    """Mask names, then phone numbers, then e-mail addresses."""
    masked = _col(text)
    for pattern, mask in ((NAME_PATTERN, NAME_MASK), (PHONE_PATTERN, PHONE_MASK), (EMAIL_PATTERN, EMAIL_MASK)):
        masked = F.regexp_replace(masked, pattern, mask)
    return masked


def name_definition(level2, level3, level4, definition) -> Column:
    """Level 2 with the deeper levels and the definition that exist; null without level 2."""
    joined = F.concat_ws(": ", *[_col(c) for c in (level2, level3, level4, definition)])
    return F.when(_col(level2).isNotNull(), joined)


def lowest_level(*levels) -> Column:
    """Text of the deepest level present with the level's name appended.

    ``levels`` are (column, level name) pairs from level 1 downwards.
    """
    return F.coalesce(*[F.concat(_col(c), F.lit("_" + label)) for c, label in reversed(levels)])


def clean_alternative_names(skill, alternatives) -> Column:
    """One ", " list of the usable alternative names, in first-seen order."""
    flat = F.replace(_col(alternatives), F.lit("\n"), F.lit(", "))
    body = F.when(flat.contains(":"), F.split(flat, ":")[1]).otherwise(flat)
    names = F.split(F.regexp_replace(body, r"(?U)\d+\. ", ""), ", ", -1)
    kept = F.filter(
        names,
        lambda n: (n != "") & ~F.contains(n, _col(skill)) & (word_count(n) < LONG_SKILL_WORDS),
    )
    return F.array_join(F.array_distinct(kept), ", ")


def name_before_definition(text) -> Column:
    """Name part of ``name : definition``."""
    return F.split(_col(text), " : ", 2)[0]


def extract_spans(text) -> Column:
    """Marked spans in order, lower-cased, repeats kept."""
    return F.transform(F.regexp_extract_all(_col(text), F.lit(SPAN_PATTERN), 1), F.lower)


def annotate_spans(sentence, spans) -> Column:
    """Mark every occurrence of each span; a span inside an earlier one nests."""
    return F.aggregate(
        _col(spans),
        _col(sentence),
        lambda marked, span: F.replace(marked, span, F.concat(F.lit("@@"), span, F.lit("##"))),
    )


def annotation_status(annotated) -> Column:
    """OK, NO-ANNOT (no marker at all) or BAD-BOUNDS (opened, never closed)."""
    opened, closed = _col(annotated).contains("@@"), _col(annotated).contains("##")
    return (
        F.when(~opened & ~closed, "NO-ANNOT").when(opened & ~closed, "BAD-BOUNDS").otherwise("OK")
    )


def covers_whole_sentence(annotated) -> Column:
    """True when one span holds the whole trimmed sentence (the FULL-ANNOT case)."""
    inner = F.regexp_extract(strip(annotated), "^@@([\\s\\S]*)##$", 1)
    return (inner != "") & ~inner.contains("@@") & ~inner.contains("##")


def needs_annotation(label) -> Column:
    """Sentences without a label are passed on unmarked."""
    return _col(label) != NO_LABEL_PRESENT


def parse_list(text) -> Column:
    """``"['a', \\"it's\\"]"`` to an array; text that is no list gives null."""
    unescaped = _col(text)
    hex_escape = r"\\x([0-9a-fA-F]{2})"
    unescaped = F.regexp_replace(unescaped, hex_escape, r"\\u00$1")
    return F.from_json(unescaped, "array<string>", {"allowSingleQuotes": "true"})


def parse_levels(text) -> Column:
    """JSON ``{skill: level}`` to an array of (skill, level); bad JSON gives none."""
    entries = F.map_entries(F.from_json(_col(text), "map<string,string>"))
    aligned = F.transform(entries, lambda e: F.struct(e["key"].alias("skill"), e["value"].alias("level")))
    return F.coalesce(aligned, F.array().cast("array<struct<skill:string,level:string>>"))


def token_cost(model: Column, input_tokens: Column, output_tokens: Column,
               prices: dict[str, tuple[float, float]] = MODEL_PRICES) -> Column:
    """Cost of a request; ``prices`` maps model to (input, output) price per token, other models give null."""
    cost = F.lit(None).cast("double")
    for name, (price_in, price_out) in prices.items():
        cost = F.when(model == name, input_tokens * F.lit(price_in) + output_tokens * F.lit(price_out)).otherwise(cost)
    return cost
