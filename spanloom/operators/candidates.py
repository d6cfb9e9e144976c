"""Candidate entities for spans, and support examples for records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.functions.fuzzy import NameIndex, token_set_kernel
from spanloom.functions.randomness import unit_random
from spanloom.operators.blocks import best_matches
from spanloom.operators.neighbours import nearest_entities
from spanloom.operators.ordering import positions_by_number, shuffled_positions, top_k
from spanloom.operators.requests import OPTION_COUNT
from spanloom.operators.taxonomy import distinct_sentences

GRAM = 3
CANDIDATE_COLUMNS = ("unique_id", "level2", "name", "name_definition")
METHODS = ("rules", "embeddings", "mixed")
KEY_MARK = "\u0001"


def _grams(text: Column, n: Column | int) -> Column:
    width = F.lit(n) if isinstance(n, int) else n
    last = F.length(text) - width + 1
    starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, width)))


def containing_entities(spans: DataFrame, taxonomy: DataFrame, span: str = "span", entity: str = "unique_id",
                        text: str = "name_definition") -> DataFrame:
    """(span, entity) where the entity's text contains the span, ignoring case.

    Instead of comparing each span with each text, a span is looked up by its
    rarest three-letter piece in an index of the texts' pieces, and only those
    texts are searched. Spans of one and two letters are looked up whole; only
    pieces that some span has enter the index. The empty span is in every text.
    """
    texts = taxonomy.select(F.col(entity).alias("entity"), F.lower(text).alias("text")).where("text is not null")
    looked_up = spans.select(F.col(span).alias("span")).distinct().withColumn("low", F.lower("span"))
    pieces = looked_up.where("low <> ''").select(
        "span", "low", F.explode(_grams(F.col("low"), F.least(F.length("low"), F.lit(GRAM)))).alias("gram"))
    wanted = pieces.select("gram").distinct()
    index = None
    for width in range(1, GRAM + 1):
        some = texts.select("entity", F.explode(_grams(F.col("text"), width)).alias("gram")).join(
            wanted.where(F.length("gram") == width), "gram", "left_semi")
        index = some if index is None else index.unionByName(some)
    frequency = index.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = (
        pieces.join(frequency, "gram", "left")
        .groupBy("span", "low")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("rare"))
        .where("rare.n > 0")
        .select("span", "low", F.col("rare.gram").alias("gram"))
    )
    found = rarest.join(index, "gram").join(texts, "entity").where(F.contains("text", "low"))
    everywhere = texts.withColumn("low", F.substring("text", 1, 0)).join(looked_up.where("low = ''"), "low")
    columns = [F.col("span").alias(span), F.col("entity").alias(entity)]
    return found.select(*columns).unionByName(everywhere.select(*columns))


def fuzzy_entities(spans: DataFrame, taxonomy: DataFrame, k: int, span: str = "span", entity: str = "unique_id",
                   name: str = "name", **sizes) -> DataFrame:
    """(span, entity, score): the k names with the highest token-set ratio, ties by entity id.

    Each distinct name is scored once, under its smallest entity id. The k best
    names hold the k best entities, of which a name can give at most k.
    """
    named = taxonomy.where(F.col(name).isNotNull()).select(F.col(entity).alias("entity"), F.col(name).alias("name"))
    members = top_k(named, ["name"], ["entity"], k, "__rn").drop("__rn")
    first = named.groupBy("name").agg(F.min("entity").alias("right_id"))
    left = spans.select(F.col(span).alias("left_id"), F.col(span).alias("left_value")).distinct()
    right = first.select(F.lit(0).alias("right_group"), "right_id", F.col("name").alias("right_value"))
    found = best_matches(
        left, right, k, token_set_kernel(k), NameIndex, floor=-0.5, spread_left=True, **sizes
    ).select("left_id", "right_id", F.round(F.col("score") * 100).cast("int").alias("score"))
    entities = first.join(members, "name").select("right_id", "entity")
    best = top_k(found.join(entities, "right_id"), ["left_id"], [F.desc("score"), "entity"], k, "__rn")
    return best.select(F.col("left_id").alias(span), F.col("entity").alias(entity), "score")


def rule_entities(spans: DataFrame, taxonomy: DataFrame, k: int, seed=42, span: str = "span",
                  entity: str = "unique_id", **sizes) -> DataFrame:
    """(span, entity, match_type, rank): exact matches, at most a random k; else the k best fuzzy ones."""
    distinct = spans.select(span).distinct()
    u = unit_random(seed, F.col(span), F.col(entity))
    exact = top_k(containing_entities(distinct, taxonomy, span, entity).withColumn("__u", u), [span], ["__u", span, entity], k)
    rest = distinct.join(exact.select(span).distinct(), span, "left_anti")
    fuzzy = top_k(fuzzy_entities(rest, taxonomy, k, span, entity, **sizes), [span], [F.desc("score"), entity], k)
    return exact.select(span, entity, F.lit("exact").alias("match_type"), "rank").unionByName(
        fuzzy.select(span, entity, F.lit("fuzzy").alias("match_type"), "rank")
    )


def record_spans(records: DataFrame, record: str = "record_id", spans: str = "spans") -> DataFrame:
    """Distinct (record, span); records without spans have no rows."""
    return records.select(record, F.explode(F.array_distinct(spans)).alias("span"))


def select_candidates(
    records: DataFrame, taxonomy: DataFrame, k: int = 10, method: str = "rules", record: str = "record_id",
    spans: str = "spans", span_vectors: DataFrame | None = None, seed=42, **sizes,
) -> DataFrame:
    """(record, span, candidate columns, methods, rank) by rules, by vectors, or both without repeats.

    ``span_vectors`` has (record, span, embedding); a span without a vector has
    no candidates by vectors. Rules depend on the span text alone, so they run
    once per distinct span. ``rank`` orders a span's candidates from 1, those by
    rules first.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    wanted = record_spans(records, record, spans)
    branches = []
    if method != "embeddings":
        by_rule = rule_entities(wanted, taxonomy, k, seed, **sizes)
        branches.append(wanted.join(by_rule, "span").select(record, "span", "unique_id", F.col("match_type").alias("method"), "rank"))
    if method != "rules":
        if span_vectors is None:
            raise ValueError("span_vectors are needed for this method")
        key = F.concat_ws(KEY_MARK, F.col(record).cast("string"), "span")
        keyed = wanted.join(span_vectors, [record, "span"]).select(key.alias("key"), "embedding")
        near = nearest_entities(keyed, taxonomy, k, "key", "embedding", **sizes)
        parts = F.split("key", KEY_MARK, 2)
        kind = records.schema[record].dataType
        branches.append(near.select(
            parts[0].cast(kind).alias(record), parts[1].alias("span"), "unique_id", F.lit("vector").alias("method"), "rank"
        ))
    if len(branches) == 1:
        # one method: nothing to merge, and a hot span's rows may stay split over tasks
        merged = branches[0].select(record, "span", "unique_id", F.array("method").alias("methods"), "rank")
    else:
        # a candidate has at most two methods
        place = F.struct((F.col("method") == "vector").alias("late"), "rank")
        both = branches[0].unionByName(branches[1]).groupBy(record, "span", "unique_id").agg(
            F.sort_array(F.collect_set("method")).alias("methods"), F.min(place).alias("place"))
        # a span has at most 2 * k candidates
        turn = F.row_number().over(Window.partitionBy(record, "span").orderBy("place", "unique_id"))
        merged = both.select(record, "span", "unique_id", "methods", turn.alias("rank"))
    return merged.join(taxonomy.select(*CANDIDATE_COLUMNS), "unique_id").select(
        record, "span", *CANDIDATE_COLUMNS, "methods", "rank"
    )


def candidate_map(candidates: DataFrame, record: str = "record_id") -> DataFrame:
    """One row per record with a map from span to its candidate list, in entity order."""
    entry = F.struct(*CANDIDATE_COLUMNS)
    per_span = candidates.groupBy(record, "span").agg(F.array_sort(F.collect_list(entry)).alias("list"))
    return per_span.groupBy(record).agg(F.map_from_entries(F.collect_list(F.struct("span", "list"))).alias("candidates"))


def with_gold(candidates: Column, gold: Column, shown: int = OPTION_COUNT) -> Column:
    """Candidate list that holds the gold entry among the first ``shown``.

    If it is missing it goes first and the last one leaves; if it stands further
    back it moves to the front.
    """
    kept = F.slice(candidates, F.lit(1), F.greatest(F.size(candidates) - 1, F.lit(0)))
    others = F.when(F.array_contains(candidates, gold), F.array_remove(candidates, gold)).otherwise(kept)
    first = F.slice(candidates, F.lit(1), F.lit(shown))
    return F.when(F.array_contains(first, gold), candidates).otherwise(F.concat(F.array(gold), others))


def nearest_support(
    records: DataFrame, support: DataFrame, k: int, seed=42, record: str = "record_id", vector: str = "embedding",
    row_id: str = "support_id", **sizes,
) -> DataFrame:
    """(record, support columns, rank): the k nearest distinct support sentences, a random row of each.

    The rows of a sentence are numbered once and the record picks a number, so
    a sentence with very many rows is not multiplied by the records that want it.
    """
    unique = distinct_sentences(support, "sentence", [row_id])
    near = nearest_entities(records, unique, k, record, vector, row_id, "embedding", **sizes)
    digest = F.sha2("sentence", 256).alias("__digest")  # sentences themselves are no keys: only their digests move
    sentences = unique.select(row_id, digest, "sentence")
    counts = support.groupBy(digest).agg(F.count("*").alias("copies"))
    pick = F.floor(unit_random(seed, F.col(record), F.col("sentence")) * F.col("copies"))
    wanted = near.join(sentences, row_id).join(counts, "__digest").select(record, "__digest", "sim", "rank", pick.alias("place"))
    columns = [c for c in support.columns if c not in ("embedding", "sentence")]
    u = unit_random(seed, F.col("sentence"), F.col(row_id)).alias("__s")
    numbered = positions_by_number(support.select(row_id, digest, u), F.col("__s"), [row_id], ["__digest"], "place").drop("__s")
    rows = support.select("sentence", *columns)
    return wanted.join(numbered, ["__digest", "place"]).drop("__digest", "place").join(rows, row_id).where(F.size("spans") > 0)


def random_support(requests: DataFrame, support: DataFrame, k: int, seed=42, request: str = "record_id",
                   row_id: str = "support_id") -> DataFrame:
    """(request, support columns): k different random support rows per request, those with spans.

    The support rows are numbered in random order. Each request draws k
    different numbers (Floyd's method, in the row) and joins on them.
    """
    total = support.count()
    size = min(k, total)
    if size == 0:
        return requests.select(request).join(support, F.lit(False))
    numbers = F.aggregate(
        F.sequence(F.lit(total - size), F.lit(total - 1)),
        F.array().cast("array<bigint>"),
        lambda taken, j: F.concat(taken, F.array(_fresh(taken, j, seed, F.col(request)))),
    )
    wanted = requests.select(request, F.explode(numbers).alias("place"))
    numbered = shuffled_positions(support, seed, [row_id], name="place")
    return wanted.join(numbered, "place").where(F.size("spans") > 0).drop("place")


def _fresh(taken: Column, j: Column, seed, request: Column) -> Column:
    number = F.floor(unit_random(seed, F.lit("support"), request, j) * (j + 1)).cast("bigint")
    return F.when(F.array_contains(taken, number), j.cast("bigint")).otherwise(number)


def random_span(spans: Column, seed, key: Column) -> Column:
    """One seeded random span of the row."""
    place = F.floor(unit_random(seed, F.lit("span"), key) * F.size(spans)).cast("int") + 1
    return F.when(F.size(spans) > 0, F.try_element_at(spans, place))

