"""Inputs shared by the queries, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIZES = [1.0, 1.0, 1.0, 1.0, 1.0]  # combination sizes 1..5, equal weights


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "documents")


def joined(column) -> Column:
    """Array as one text, so that results compare the same in any engine."""
    return F.array_join(column, "|")


def u_sql(*parts) -> str:
    """SQL twin of ``unit_random``; parts are SQL expressions."""
    key = ", ".join(str(p) for p in parts)
    return f"(('0x' || substr(md5(concat_ws(':', {key})), 1, 13))::BIGINT::DOUBLE / 4503599627370496::DOUBLE)"


def gumbel_sql(log_weight: str, *parts) -> str:
    return f"({log_weight} - ln(-ln(greatest({u_sql(*parts)}, 1e-16::DOUBLE))))"


def size_sql(draw: str) -> str:
    """Equal weights over five sizes."""
    return f"(floor({u_sql(42, repr_sql('size'), draw)} * 5)::INTEGER + 1)"


def repr_sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# ---- embeddings as a taxonomy: name, category, vector ----

def taxonomy(spark, folder) -> DataFrame:
    return read(spark, folder, "embeddings").select(
        F.concat(F.lit("v"), "vec_id").alias("name"), F.col("label").cast("string").alias("category"), "embedding"
    )


def popularity(spark, folder) -> DataFrame:
    return read(spark, folder, "embeddings").select(
        F.concat(F.lit("v"), "vec_id").alias("name"), (10 + (F.col("vec_id") * 37) % 50).cast("double").alias("score")
    )


TAXONOMY_SQL = """tax AS (
  SELECT 'v' || vec_id AS name, label::VARCHAR AS category, embedding::DOUBLE[] AS e,
         (10 + (vec_id * 37) % 50)::DOUBLE AS score
  FROM embeddings),
sims AS (
  SELECT a.name AS anchor, b.name AS neighbour, b.category AS category, b.score AS score,
         round(list_cosine_similarity(a.e, b.e), 9) AS sim
  FROM tax a JOIN tax b ON a.name <> b.name)"""


def neighbours_sql(k: int, threshold: float, name: str = "nn") -> str:
    return f"""{TAXONOMY_SQL},
{name} AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY sim DESC, neighbour) AS rank FROM sims)
  WHERE rank <= {k} AND sim > {threshold})"""


BALANCED_DRAWS_SQL = f"""draws AS (
  SELECT round * (SELECT count(*) FROM tax) + row_number() OVER (
           PARTITION BY round ORDER BY {u_sql(42, 'round', 'name')}, name) - 1 AS draw_id, name AS anchor
  FROM tax, (SELECT unnest(range(2)) AS round))"""


def combos_sql(by_popularity: bool = True) -> str:
    """combos(draw_id, anchor, members, size) from draws and nn."""
    weight = "-nn.score" if by_popularity else "0::DOUBLE"
    key = gumbel_sql(weight, 42, "'pick'", "d.draw_id", "nn.neighbour")
    return f"""sized AS (SELECT draw_id, anchor, {size_sql('draw_id')} AS wanted FROM draws),
picks AS (
  SELECT d.draw_id, nn.neighbour, d.wanted,
         row_number() OVER (PARTITION BY d.draw_id ORDER BY {key} DESC, nn.neighbour) AS turn
  FROM sized d JOIN nn ON nn.anchor = d.anchor),
taken AS (
  SELECT draw_id, list(neighbour ORDER BY turn) AS more FROM picks WHERE turn < wanted GROUP BY draw_id),
combos AS (
  SELECT s.draw_id, s.anchor, list_concat([s.anchor], coalesce(t.more, [])) AS members
  FROM sized s LEFT JOIN taken t USING (draw_id))"""


# ---- conversations: sentences with capitalised words as spans ----

SPAN_WORD = r"\b[A-Z][a-z]{4,}"


def messages(spark, folder) -> DataFrame:
    rows = read(spark, folder, "conversations").withColumn(
        "record_id", F.concat_ws("-", "conv_id", "turn")
    )
    found = F.regexp_extract_all("text", F.lit(SPAN_WORD), 0)
    return rows.withColumn("mentions", F.array_sort(F.array_distinct(found)))


MESSAGES_SQL = r"""msgs AS (
  SELECT conv_id || '-' || turn AS record_id, conv_id, turn, role, text,
         list_sort(list_distinct(regexp_extract_all(text, '\b[A-Z][a-z]{4,}'))) AS mentions
  FROM conversations),
spans AS (
  SELECT DISTINCT record_id, lower(m) AS span FROM (SELECT record_id, unnest(mentions) AS m FROM msgs))"""


def message_spans(spark, folder) -> DataFrame:
    return messages(spark, folder).select("record_id", "text", F.transform("mentions", F.lower).alias("spans"))


# ---- benchmark passages as entities with text and vector ----

def entities(spark, folder) -> DataFrame:
    items = read(spark, folder, "benchmark")
    vectors = read(spark, folder, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding", "label")
    name = F.substring_index("text", " ", 2)
    return items.join(vectors, "item_id").select(
        F.col("item_id").alias("unique_id"), F.col("label").cast("string").alias("level2"), name.alias("name"),
        F.col("text").alias("name_definition"), "embedding",
    )


ENTITIES_SQL = """ents AS (
  SELECT b.item_id AS unique_id, e.label::VARCHAR AS level2, b.text AS name_definition,
         split_part(b.text, ' ', 1) || ' ' || split_part(b.text, ' ', 2) AS name, e.embedding::DOUBLE[] AS e
  FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id)"""


# ---- orders: gold and predicted part types ----

def predictions(spark, folder) -> DataFrame:
    """Per order: types of the parts kept (gold) and of the parts invoiced (predicted)."""
    lines = read(spark, folder, "lineitem").join(
        read(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey"
    )
    kept = F.when(F.col("l_returnflag") != "R", F.col("p_type"))
    invoiced = F.when(F.col("l_linestatus") == "F", F.struct("l_linenumber", "l_partkey", "p_type"))
    grouped = lines.groupBy(F.col("l_orderkey").alias("record_id")).agg(
        F.array_sort(F.collect_set(kept)).alias("gold"), F.array_sort(F.collect_list(invoiced)).alias("rows"),
        F.max(F.year("l_shipdate")).alias("run_id"),
    )
    return grouped.select("record_id", "run_id", "gold", F.transform("rows", lambda r: r["p_type"]).alias("predicted"))


PREDICTIONS_SQL = """preds AS (
  SELECT l_orderkey AS record_id, max(year(l_shipdate))::INTEGER AS run_id,
         coalesce(list(DISTINCT p_type) FILTER (l_returnflag <> 'R'), []) AS gold,
         coalesce(list(p_type ORDER BY l_linenumber, l_partkey) FILTER (l_linestatus = 'F'), []) AS predicted
  FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey)"""


# ---- string ratios in SQL: longest common subsequence by rows of the usual table ----

def common_sql(a: str, b: str) -> str:
    row = f"list_concat([[0]], list_transform(range(1, length({a}) + 1), lambda j: [j]))"
    step = (f"list_concat(acc, [CASE WHEN {a}[j[1]] = {b}[k[1]] THEN r[j[1]] + 1 "
            f"ELSE greatest(r[j[1] + 1], acc[len(acc)]) END])")
    start = f"[list_transform(range(0, length({a}) + 1), lambda j: 0)]"
    return (f"list_reduce(list_concat({start}, list_transform(range(1, length({b}) + 1), lambda k: [k])), "
            f"lambda r, k: list_reduce({row}, lambda acc, j: {step}))[length({a}) + 1]")


def ratio_sql(a: str, b: str) -> str:
    # halves go to the even neighbour, as in Python
    return (f"(CASE WHEN {a} = {b} THEN 100 ELSE round_even(100 * (2 * {common_sql(a, b)} / "
            f"(length({a}) + length({b}))::DOUBLE), 0) END)::INTEGER")


def token_set_sql(pairs: str, a: str, b: str, name: str) -> str:
    """CTEs that end in ``name``: the columns of ``pairs`` with ``score``, the token-set ratio of a and b."""
    tokens = lambda c: (f"list_sort(list_distinct(list_filter(string_split(lower(regexp_replace(regexp_replace({c}, "
                        r"'[^\x00-\x7F]', '', 'g'), '[^A-Za-z0-9_]', ' ', 'g')), ' '), lambda t: t <> '')))")
    return f"""{name}_t AS (SELECT *, {tokens(a)} AS ta, {tokens(b)} AS tb FROM {pairs}),
{name}_s AS (
  SELECT *, array_to_string(list_filter(ta, lambda t: list_contains(tb, t)), ' ') AS ts,
         array_to_string(list_filter(ta, lambda t: NOT list_contains(tb, t)), ' ') AS da,
         array_to_string(list_filter(tb, lambda t: NOT list_contains(ta, t)), ' ') AS db FROM {name}_t),
{name}_c AS (SELECT *, trim(ts || ' ' || da) AS ca, trim(ts || ' ' || db) AS cb FROM {name}_s),
{name} AS (
  SELECT *, CASE WHEN len(ta) = 0 OR len(tb) = 0 THEN 0
                 WHEN ts = '' THEN {ratio_sql('ca', 'cb')}
                 ELSE greatest({ratio_sql('ca', 'cb')}, {ratio_sql('ts', 'ca')}, {ratio_sql('ts', 'cb')}) END AS score
  FROM {name}_c)"""
