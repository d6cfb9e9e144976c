"""Candidates for spans, support examples, splits, requests and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions.randomness import unit_random
from spanloom.functions.text import words
from spanloom.operators import candidates as K
from spanloom.operators import embedding as E
from spanloom.operators import neighbours as N
from spanloom.operators import requests as R
from spanloom.operators import splits as P
from spanloom.operators.ordering import head_sample, random_k, shuffle_rows, sorted_positions
from spanloom.session import cut_lineage
from suite.combos import AVOID_CTE, COMBOS_SQL, combos
from suite.combos import K as COMBO_K
from suite.common import (
    ENTITIES_SQL, MESSAGES_SQL, entities, joined, message_spans, messages, read, taxonomy, token_set_sql, u_sql,
)

TOP = 5


def rule_candidates_exact(spark, folder):
    """Up to five random benchmark passages that contain a mention of a message."""
    wanted = K.record_spans(message_spans(spark, folder))
    exact = random_k(
        K.containing_entities(wanted, entities(spark, folder)), ["span"], TOP, 42, ["span", "unique_id"])
    return wanted.join(exact, "span")


EXACT_CTE = f"""{MESSAGES_SQL}, {ENTITIES_SQL},
exact AS (
  SELECT span, unique_id FROM (SELECT DISTINCT span FROM spans) s JOIN ents ON contains(lower(name_definition), span)
  QUALIFY row_number() OVER (PARTITION BY span ORDER BY {u_sql(42, 'span', 'unique_id')}, unique_id) <= {TOP})"""
EXACT_SQL = f"WITH {EXACT_CTE} SELECT record_id, span, unique_id FROM spans JOIN exact USING (span)"


def fuzzy_candidates(spark, folder):
    """Mentions no passage contains, against the part names by token-set ratio."""
    names = read(spark, folder, "part").select(F.col("p_partkey").alias("unique_id"), F.col("p_name").alias("name"))
    spans = K.record_spans(message_spans(spark, folder)).select("span").distinct()
    rest = spans.join(K.containing_entities(spans, entities(spark, folder)), "span", "left_anti")
    return K.fuzzy_entities(rest, names, TOP)


def vector_candidates(spark, folder):
    rows = read(spark, folder, "embeddings")
    return K.nearest_entities(rows, entities(spark, folder), TOP, "vec_id", "embedding")


VECTOR_CTE = f"""{ENTITIES_SQL},
near AS (
  SELECT v.vec_id, n.unique_id, round(list_cosine_similarity(v.embedding::DOUBLE[], n.e), 9) AS sim
  FROM embeddings v, ents n
  QUALIFY row_number() OVER (PARTITION BY v.vec_id ORDER BY sim DESC, n.unique_id) <= {TOP}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, unique_id)::INTEGER AS rank FROM near)"""
VECTOR_SQL = f"WITH {VECTOR_CTE} SELECT * FROM ranked"


def mention_vectors(spark, folder, wanted):
    """A mention takes the vector its hash points to."""
    vectors = read(spark, folder, "embeddings").select("vec_id", "embedding")
    total = vectors.agg(F.count("*").alias("n")).scalar()
    place = F.floor(unit_random("vector", F.col("span")) * total)
    return wanted.withColumn("vec_id", place).join(vectors, "vec_id").drop("vec_id")


def mixed(spark, folder):
    records = message_spans(spark, folder)
    taxonomy_rows = entities(spark, folder)
    vectors = mention_vectors(spark, folder, K.record_spans(records))
    return records, K.select_candidates(records, taxonomy_rows, TOP, "mixed", span_vectors=vectors)


def mixed_candidates(spark, folder):
    """Rules and vectors together; spans that no passage contains use the fuzzy rule."""
    found = mixed(spark, folder)[1]
    return found.select("record_id", "span", "unique_id", "level2", "name", joined("methods").alias("methods"))


def vector_method_candidates(spark, folder):
    records = message_spans(spark, folder)
    vectors = mention_vectors(spark, folder, K.record_spans(records))
    found = K.select_candidates(records, entities(spark, folder), TOP, "embeddings", span_vectors=vectors)
    return found.select("record_id", "span", "unique_id", "level2", "name", joined("methods").alias("methods"))


VECTOR_METHOD_SQL = f"""WITH {MESSAGES_SQL}, {ENTITIES_SQL},
pointed AS (
  SELECT DISTINCT span, floor({u_sql("'vector'", 'span')} * (SELECT count(*) FROM embeddings))::BIGINT AS vec_id FROM spans),
near AS (
  SELECT p.span, n.unique_id, n.level2, n.name, round(list_cosine_similarity(v.embedding::DOUBLE[], n.e), 9) AS sim
  FROM pointed p JOIN embeddings v USING (vec_id), ents n
  QUALIFY row_number() OVER (PARTITION BY p.span ORDER BY sim DESC, n.unique_id) <= {TOP})
SELECT record_id, span, unique_id, level2, name, 'vector' AS methods FROM spans JOIN near USING (span)"""


def gold_in_candidates(spark, folder):
    near = vector_candidates(spark, folder)
    listed = near.groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("rank", "unique_id"))).alias("c"))
    items = F.transform("c", lambda e: e["unique_id"])
    total = read(spark, folder, "benchmark").agg(F.count("*").alias("n")).scalar()
    gold = F.floor(unit_random("gold", F.col("vec_id")) * total).cast("bigint")
    out = listed.select("vec_id", gold.alias("gold"), K.with_gold(items, gold).alias("options"))
    return out.select("vec_id", "gold", joined(F.col("options").cast("array<string>")).alias("options"))


GOLD_SQL = f"""WITH {VECTOR_CTE},
lists AS (
  SELECT vec_id, list(unique_id ORDER BY rank) AS c,
         floor({u_sql("'gold'", 'vec_id')} * (SELECT count(*) FROM benchmark))::BIGINT AS gold
  FROM ranked GROUP BY vec_id)
SELECT vec_id, gold, array_to_string(CASE WHEN list_contains(c, gold) THEN c
         ELSE list_concat([gold], c[1:len(c) - 1]) END, '|') AS options FROM lists"""


def support_rows(spark, folder):
    """Benchmark passages as support sentences, one row for each capitalised word used as skill."""
    rows = entities(spark, folder).select(
        "unique_id", F.col("name_definition").alias("sentence"), "embedding",
        F.regexp_extract_all("name_definition", F.lit(r"\b[A-Z][a-z]+"), 0).alias("caps"))
    exploded = rows.select("*", F.posexplode("caps").alias("i", "skill"))
    some = F.when(F.length("skill") > 3, F.array(F.lower("skill"))).otherwise(F.array().cast("array<string>"))
    return exploded.select(
        F.concat_ws("-", "unique_id", "i").alias("support_id"), "sentence", "embedding", "skill", some.alias("spans"))


SUPPORT_CTE = rf"""{ENTITIES_SQL},
support AS (
  SELECT unique_id || '-' || (i - 1) AS support_id, sentence, e, caps[i] AS skill,
         CASE WHEN length(caps[i]) > 3 THEN [lower(caps[i])] ELSE [] END AS spans
  FROM (SELECT unique_id, name_definition AS sentence, e, caps, unnest(range(1, len(caps) + 1)) AS i
        FROM (SELECT *, regexp_extract_all(name_definition, '\b[A-Z][a-z]+') AS caps FROM ents)))"""


def few_shot_knn(spark, folder):
    found = K.nearest_support(read(spark, folder, "embeddings"), support_rows(spark, folder), 3, record="vec_id")
    return found.select("vec_id", "support_id", "skill", "sim", "rank")


FEW_SHOT_SQL = f"""WITH {SUPPORT_CTE},
firsts AS (SELECT min(support_id) AS first_id, sentence, any_value(e) AS e, count(*) AS copies FROM support GROUP BY sentence),
near AS (
  SELECT v.vec_id, f.sentence, f.copies, f.first_id, round(list_cosine_similarity(v.embedding::DOUBLE[], f.e), 9) AS sim,
         row_number() OVER (PARTITION BY v.vec_id ORDER BY sim DESC, f.first_id)::INTEGER AS rank
  FROM embeddings v, firsts f QUALIFY rank <= 3),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY sentence ORDER BY {u_sql(42, 'sentence', 'support_id')}, support_id) - 1 AS place
  FROM support)
SELECT vec_id, support_id, skill, sim, rank FROM near n JOIN numbered s
  ON s.sentence = n.sentence AND s.place = floor({u_sql(42, 'n.vec_id', 'n.sentence')} * n.copies)
WHERE len(s.spans) > 0"""


def few_shot_random(spark, folder):
    requests = messages(spark, folder).select("record_id")
    return K.random_support(requests, support_rows(spark, folder), 3).select("record_id", "support_id", "skill")


FEW_RANDOM_SQL = f"""WITH {MESSAGES_SQL}, {SUPPORT_CTE},
n AS (SELECT count(*) AS s FROM support),
a AS (SELECT record_id, s, floor({u_sql(42, "'support'", 'record_id', 's - 3')} * (s - 2))::BIGINT AS p0 FROM msgs, n),
b AS (SELECT *, floor({u_sql(42, "'support'", 'record_id', 's - 2')} * (s - 1))::BIGINT AS x1 FROM a),
c AS (SELECT *, CASE WHEN x1 = p0 THEN s - 2 ELSE x1 END AS p1,
             floor({u_sql(42, "'support'", 'record_id', 's - 1')} * s)::BIGINT AS x2 FROM b),
wanted AS (SELECT record_id, unnest([p0, p1, CASE WHEN x2 IN (p0, p1) THEN s - 1 ELSE x2 END]) AS place FROM c),
numbered AS (SELECT *, row_number() OVER (ORDER BY {u_sql(42, 'support_id')}, support_id) - 1 AS place FROM support)
SELECT record_id, support_id, skill FROM wanted JOIN numbered USING (place) WHERE len(spans) > 0"""


def sentence_tokens(spark, folder):
    """Benchmark passages as token tables; a token takes the vector its hash points to."""
    rows = read(spark, folder, "benchmark").select(
        F.col("item_id").alias("record_id"), words(F.lower("text")).alias("tokens"))
    # one span of two adjacent tokens per passage, chosen by hash
    start = F.floor(unit_random("span", F.col("record_id")) * (F.size("tokens") - 1)).cast("int") + 1
    return rows.withColumn("pair", F.slice("tokens", start, F.lit(2)))


def locate_spans(spark, folder):
    place = E.locate_span(F.col("tokens"), F.col("pair"))
    found = sentence_tokens(spark, folder).withColumn("at", place)
    return found.select("record_id", F.array_join("pair", " ").alias("span"), "at.start", "at.end")


SPACES = r"\s\x{0B}\x{1c}-\x{1f}\x{85}\p{Z}"
LOCATE_CTE = f"""toks AS (
  SELECT item_id AS record_id, t, floor({u_sql("'span'", 'item_id')} * (len(t) - 1))::BIGINT + 1 AS i
  FROM (SELECT item_id, regexp_extract_all(lower(text), '[^{SPACES}]+') AS t FROM benchmark)),
pairs AS (SELECT record_id, t, t[i] AS a, t[i + 1] AS b FROM toks),
located AS (
  SELECT record_id, t, a || ' ' || b AS span, list_min(list_filter(range(1, len(t)), lambda j: t[j] = a AND t[j + 1] = b)) - 1 AS s
  FROM pairs)"""
LOCATE_SQL = f"""WITH {LOCATE_CTE}
SELECT record_id, span, s::INTEGER AS start, (s + 2)::INTEGER AS "end" FROM located"""


def span_mean_vectors(spark, folder):
    """Mean vector of each located span, shown by its dot product with the passage's own vector."""
    rows = sentence_tokens(spark, folder)
    vectors = read(spark, folder, "embeddings").select("vec_id", "embedding")
    total = vectors.agg(F.count("*").alias("n")).scalar()
    tokens = rows.select("record_id", F.posexplode("tokens").alias("pos", "token")).withColumn(
        "vec_id", F.floor(unit_random("vector", F.col("token")) * total)).join(vectors, "vec_id")
    located = rows.withColumn("at", E.locate_span(F.col("tokens"), F.col("pair"))).select(
        "record_id", F.array_join("pair", " ").alias("span"), "at.start", "at.end"
    ).join(vectors.select(F.col("vec_id").alias("record_id"), F.col("embedding").alias("span_embedding")), "record_id")
    means = E.span_vectors(located, tokens)
    own = located.select("record_id", "span_embedding")
    from spanloom.functions.vectors import dot

    return means.join(own, "record_id").select("record_id", "span", F.round(dot("embedding", "span_embedding"), 9).alias("dot"))


SPAN_MEAN_SQL = f"""WITH {LOCATE_CTE},
inside AS (SELECT record_id, span, unnest([t[s + 1], t[s + 2]]) AS token FROM located),
pointed AS (SELECT *, floor({u_sql("'vector'", 'token')} * (SELECT count(*) FROM embeddings))::BIGINT AS vec_id FROM inside)
SELECT p.record_id, p.span, round(avg(list_dot_product(v.embedding::DOUBLE[], o.embedding::DOUBLE[])), 9) AS dot
FROM pointed p JOIN embeddings v USING (vec_id) JOIN embeddings o ON o.vec_id = p.record_id GROUP BY p.record_id, p.span"""


# ---- splits ----

def split_disjoint(spark, folder):
    docs = read(spark, folder, "documents")
    sizes = P.rest_sizes(P.distinct_count(docs, "text"))
    return P.assign_splits(docs, "text", sizes).select("doc_id", "split")


SPLIT_SQL = f"""WITH ranked AS (
  SELECT text, row_number() OVER (ORDER BY {u_sql(42, 'text')}, text) - 1 AS position FROM (SELECT DISTINCT text FROM documents)),
sizes AS (SELECT floor(0.3 * count(*))::BIGINT AS rest, count(*) AS n FROM ranked)
SELECT doc_id, CASE WHEN position < n - rest THEN 'train' WHEN position < n - rest // 2 THEN 'test' ELSE 'dev' END AS split
FROM documents JOIN ranked USING (text), sizes"""


OVERLAP_SQL = f"""WITH placed AS ({SPLIT_SQL}),
again AS (SELECT DISTINCT text FROM documents WHERE doc_id % 5 = 0)
SELECT (SELECT count(*) FROM again) AS overlapping,
       (SELECT count(DISTINCT text) FROM documents JOIN placed USING (doc_id) WHERE split = 'train' AND text IN (SELECT text FROM again)) AS shared"""


def split_overlap(spark, folder):
    """A clean split, to which every fifth document is added once more as another split."""
    docs = read(spark, folder, "documents")
    clean = P.assign_splits(docs, "text", P.rest_sizes(P.distinct_count(docs, "text")))
    P.require_disjoint(clean, "text")
    placed = clean.unionByName(docs.where("doc_id % 5 = 0").withColumn("split", F.lit("again")))
    shared = P.common_keys(placed.where("split = 'train'"), placed.where("split <> 'train'"), "text")
    return P.overlapping_keys(placed, "text").agg(F.count("*").alias("overlapping")).select(
        "overlapping", shared.agg(F.count("*").alias("c")).scalar().alias("shared"))


def merge_negatives(spark, folder):
    """Good documents keep their source as label, the others are relabelled and mixed in."""
    rows = read(spark, folder, "documents").join(read(spark, folder, "labels"), "doc_id")
    good = P.wrap_label(rows.where("quality = 1").select("doc_id", F.col("source").alias("skills")), "skills")
    bad = P.relabel(rows.where("quality = 0").select("doc_id", F.col("source").alias("skills")))
    merged = P.merge_samples(good, bad, keys=["doc_id"])
    return merged.select("doc_id", joined("skills").alias("skills"))


MERGE_SQL = """SELECT doc_id, CASE WHEN quality = 1 THEN source ELSE 'NO LABEL' END AS skills
FROM documents JOIN labels USING (doc_id)"""


def merged_order(spark, folder):
    """The same rows with their place in the shuffled order."""
    rows = read(spark, folder, "documents").join(read(spark, folder, "labels"), "doc_id")
    good = P.wrap_label(rows.where("quality = 1").select("doc_id", F.col("source").alias("skills")), "skills")
    bad = P.relabel(rows.where("quality = 0").select("doc_id", F.col("source").alias("skills")))
    ordered = P.merge_samples(good, bad, keys=["doc_id"]).withColumn("row", F.monotonically_increasing_id())
    return sorted_positions(ordered.select("doc_id", "row"), ["row"]).select("doc_id", "position")


ORDER_SQL = f"""SELECT doc_id, row_number() OVER (ORDER BY {u_sql(42, 'doc_id')}, doc_id) - 1 AS position
FROM documents JOIN labels USING (doc_id)"""


def head_rows(spark, folder):
    """The first hundred documents of a shuffled table."""
    return head_sample(shuffle_rows(read(spark, folder, "documents").select("doc_id", "source"), 7, ["doc_id"]), 100)


HEAD_SQL = f"SELECT doc_id, source FROM documents ORDER BY {u_sql(7, 'doc_id')}, doc_id LIMIT 100"


# ---- requests and answers ----

def route_modes(spark, folder):
    return R.route_modes(combos(spark, folder)).select("draw_id", "size", "mode")


ROUTE_SQL = f"""WITH {COMBOS_SQL}
SELECT draw_id::BIGINT AS draw_id, len(members)::INTEGER AS size, mode
FROM combos, (VALUES ('dense', 1, 4), ('sparse', 3, 5)) m(mode, low, high) WHERE len(members) BETWEEN low AND high"""

TEMPLATE = ("Write {nExamples} texts of {minNbSentences} to {maxNbSentences} about {skillList}. {unknown}"
            "{wordsToAvoid}{typeOfAdditionalInfo}: {additionalInfo}")


def prompt_requests(spark, folder):
    """Filled instruction and message list for each combination; one search serves lists and words to avoid."""
    tax = taxonomy(spark, folder).select(
        "name", "embedding", F.concat(F.lit("also "), "name").alias("alt_labels"),
        F.concat(F.lit("of group "), "category").alias("description"))
    near = cut_lineage(N.nearest(tax, COMBO_K), "near")
    made = cut_lineage(combos(spark, folder, near))
    full = made.join(N.neighbours_outside(made, tax, near=near), "draw_id").join(R.additional_info(made, tax), "draw_id", "left")
    values = R.placeholder_values(
        F.col("members"), F.col("additional"), F.col("avoid"), {"typeOfAdditionalInfo": "Other names"})
    filled = R.fill_template(F.lit(TEMPLATE), values)
    shots = F.lit(None).cast(R.SHOTS)
    chat = R.build_messages(F.lit("You write texts."), filled, shots, F.concat(F.lit("skills: "), R.list_text(F.col("members"))))
    flat = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(" > "), m["content"])), "\n")
    return full.select("draw_id", chat.alias("messages")).select("draw_id", flat.alias("request"))


PROMPT_SQL = f"""WITH {COMBOS_SQL}, {AVOID_CTE},
told AS (
  SELECT draw_id, string_agg(i || ') ' || name || ' : can also be referred as : also ' || name ||
           ' and described as : of group ' || category || '.', '' ORDER BY i) AS additional
  FROM (SELECT draw_id, unnest(members) AS name, unnest(range(1, len(members) + 1)) AS i FROM combos) JOIN tax USING (name)
  GROUP BY draw_id),
parts AS (
  SELECT c.draw_id, len(members) AS n, '[''' || array_to_string(members, ''', ''') || ''']' AS listed, additional,
         CASE WHEN len(avoid) > 0 THEN 'Do not use any of these terms in the text : ' || array_to_string(avoid, ', ') || '. '
              ELSE '' END AS words
  FROM combos c JOIN avoid USING (draw_id) JOIN told USING (draw_id))
SELECT draw_id::BIGINT AS draw_id, 'system > You write texts.' || chr(10) || 'user > Write five texts of ' || greatest(1, n - 2) ||
       CASE WHEN n <= 3 THEN ' sentence' ELSE ' sentences' END || ' to ' || (n + 1) || ' about ' || listed || '. ' || words ||
       'Other names: ' || additional || chr(10) || 'user > skills: ' || listed AS request
FROM parts"""


def questions(spark, folder, records=False):
    """Multiple choice of the nearest entities' names (or their records) for each vector."""
    near = vector_candidates(spark, folder).join(entities(spark, folder).select("unique_id", "name"), "unique_id")
    option = lambda e: F.struct(e["unique_id"].alias("unique_id"), e["name"].alias("name")) if records else e["name"]
    return near.groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("rank", "unique_id", "name"))).alias("c")).select(
        F.col("vec_id").alias("record_id"), F.concat(F.lit("v"), "vec_id").alias("span"),
        F.transform("c", option).alias("options"))


QUESTIONS_CTE = f"""{VECTOR_CTE},
questions AS (
  SELECT vec_id AS record_id, 'v' || vec_id AS span, list(name ORDER BY rank) AS options, list(unique_id ORDER BY rank) AS ids
  FROM ranked JOIN ents USING (unique_id) GROUP BY vec_id)"""


def mcq_requests(spark, folder):
    text = R.choice_question(F.concat(F.lit("Sentence of "), "span"), F.col("span"), F.col("options"))
    return questions(spark, folder).select("record_id", text.alias("question"))


MCQ_SQL = f"""WITH {QUESTIONS_CTE}
SELECT record_id, 'Sentence: Sentence of ' || span || ' ' || chr(10) || 'Skill: ' || span || ' ' || chr(10) || 'Options: ' ||
       array_to_string(list_transform(options, lambda o, i: chr(64 + i::INTEGER) || ': ' || o), ' ' || chr(10)) AS question
FROM questions"""

ANSWER_FORMS = ["a", " B: because", "c", "", "z", "D", "?", None]


def parse_answers(spark, folder):
    asked = questions(spark, folder, records=True)
    form = (F.floor(unit_random("answer", F.col("record_id")) * len(ANSWER_FORMS)) + 1).cast("int")
    answers = asked.select("record_id", "span", F.element_at(F.array(*[F.lit(a) for a in ANSWER_FORMS]), form).alias("answer"))
    return R.match_answers(asked, answers)


PARSE_SQL = f"""WITH {QUESTIONS_CTE},
answers AS (SELECT *, floor({u_sql("'answer'", 'record_id')} * 8)::INTEGER AS f FROM questions)
SELECT record_id, span, options[CASE f WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 4 END] AS name,
       ids[CASE f WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 4 END] AS unique_id
FROM answers WHERE f IN (0, 1, 2, 5)"""


def answered(spark, folder):
    """User turns as requests and the next turn, with some marks broken, as their answer."""
    rows = messages(spark, folder)
    asked = rows.where("role = 'user'").select(
        F.concat_ws("-", "conv_id", F.col("turn") + 1).alias("request_id"), F.col("text").alias("sentence"))
    chat = R.build_messages(F.lit("Mark the spans."), F.lit("Use @@ and ##."), None, F.col("sentence"))
    marked = F.when(F.size("mentions") > 4, F.concat(F.lit("@@"), "text", F.lit("##"))).when(
        F.size("mentions") > 2, F.concat(F.lit("@@"), F.replace("text", F.lit("##"), F.lit("")), F.lit("@@"))).when(
        F.size("mentions") > 0, F.col("text"))
    answers = rows.where("role = 'assistant'").select(F.col("record_id").alias("request_id"), marked.alias("answer"))
    return R.attach_answers(asked.withColumn("messages", chat), answers)


ANSWERED_CTE = f"""{MESSAGES_SQL},
asked AS (SELECT conv_id || '-' || (turn + 1) AS request_id, text AS sentence FROM msgs WHERE role = 'user'),
answers AS (
  SELECT record_id AS request_id, CASE WHEN len(mentions) > 4 THEN '@@' || text || '##'
           WHEN len(mentions) > 2 THEN '@@' || replace(text, '##', '') || '@@' WHEN len(mentions) > 0 THEN text END AS answer
  FROM msgs WHERE role = 'assistant'),
answered AS (SELECT * FROM asked LEFT JOIN answers USING (request_id))"""


def attach_answers(spark, folder):
    return answered(spark, folder).select("request_id", F.size("messages").alias("messages"), "answer")


ATTACH_SQL = f"WITH {ANSWERED_CTE} SELECT request_id, 3::INTEGER AS messages, answer FROM answered"

REFINE = {"NO-ANNOT": "Nothing was marked.", "BAD-BOUNDS": "Close the marks.", "FULL-ANNOT": "Mark less."}


def refine_retry(spark, folder):
    again = R.retry_requests(answered(spark, folder), REFINE, check_full=True)
    last = F.element_at("messages", -1)["content"]
    return again.select("request_id", "status", F.size("messages").alias("messages"), last.alias("last"))


REFINE_SQL = f"""WITH {ANSWERED_CTE},
inner_text AS (SELECT *, regexp_replace(regexp_replace(answer, '^[{SPACES}]+', ''), '[{SPACES}]+$', '') AS s FROM answered),
checked AS (
  SELECT *, CASE WHEN starts_with(s, '@@') AND ends_with(s, '##') AND length(s) > 4
                  AND NOT contains(s[3:length(s) - 2], '@@') AND NOT contains(s[3:length(s) - 2], '##') THEN 'FULL-ANNOT'
                 WHEN NOT contains(answer, '@@') AND NOT contains(answer, '##') THEN 'NO-ANNOT'
                 WHEN contains(answer, '@@') AND NOT contains(answer, '##') THEN 'BAD-BOUNDS'
                 WHEN answer IS NOT NULL THEN 'OK' END AS status FROM inner_text)
SELECT request_id, status, 5::INTEGER AS messages,
       CASE status WHEN 'NO-ANNOT' THEN 'Nothing was marked.' WHEN 'BAD-BOUNDS' THEN 'Close the marks.' ELSE 'Mark less.' END ||
       chr(10) || 'Sentence: ' || sentence || chr(10) AS last
FROM checked WHERE status <> 'OK'"""


def merged_passes(spark, folder):
    """Second-pass answers close what the first pass left open."""
    first = answered(spark, folder)
    again = R.retry_requests(first, REFINE, check_full=True)
    second = again.select("request_id", F.when(F.col("status") != "NO-ANNOT", F.concat(F.lit("@@fixed## "), "sentence")).alias("answer"))
    return R.merge_passes(first, second).select("request_id", "answer")


MERGED_SQL = REFINE_SQL.split("SELECT request_id, status, 5::INTEGER")[0] + """
SELECT request_id, CASE WHEN status IN ('FULL-ANNOT', 'BAD-BOUNDS') THEN '@@fixed## ' || sentence
                        WHEN status = 'NO-ANNOT' THEN NULL ELSE answer END AS answer FROM checked"""


def matching_shots(spark, folder):
    """Choice question over the candidates with the gold name forced in, and its letter."""
    gold = entities(spark, folder).select(F.col("unique_id").alias("record_id"), F.col("name").alias("gold"))
    rows = questions(spark, folder).join(gold, "record_id")
    options = K.with_gold(F.col("options"), F.col("gold"))
    shot = R.matching_shot(F.lit("A sentence."), F.col("span"), options, F.col("gold"))
    return rows.select("record_id", shot.alias("s")).select("record_id", "s.question", "s.answer")


SHOT_SQL = f"""WITH {QUESTIONS_CTE},
shots AS (
  SELECT q.record_id, q.span, n.name AS gold,
         CASE WHEN list_contains(options, n.name) THEN options ELSE list_concat([n.name], options[1:len(options) - 1]) END AS options
  FROM questions q JOIN ents n ON n.unique_id = q.record_id)
SELECT record_id, 'Sentence: A sentence. ' || chr(10) || 'Skill: ' || span || ' ' || chr(10) || 'Options: ' ||
       array_to_string(list_transform(options, lambda o, i: chr(64 + i::INTEGER) || ': ' || o), ' ' || chr(10)) AS question,
       chr(64 + list_position(options, gold)::INTEGER) AS answer
FROM shots"""


def extraction_requests(spark, folder):
    """Extraction requests: templates by kind, first six shots, unknown kinds left out."""
    rows = messages(spark, folder).select(
        "record_id", "text", F.col("role").alias("data_type"), F.lit("extraction").alias("task"), F.lit("skills").alias("prompt_type"))
    numbers = F.sequence(F.lit(1), F.lit(8))
    shot = lambda i: R.parse_shot(F.concat(F.lit("Sentence: text "), i.cast("string"), F.lit("\nAnswer: @@text## "), i.cast("string")))
    # templates for the roles that are models' customers; there is none for system
    templates = rows.where("data_type <> 'system'").select("data_type", "task", "prompt_type").distinct().select(
        "*", F.concat(F.lit("You read "), "data_type").alias("system"), F.lit("Mark all skills.").alias("instruction"),
        F.transform(numbers, shot).alias("shots"))
    full = R.with_templates(rows, templates)
    chat = R.build_messages(F.col("system"), F.col("instruction"), F.col("shots"), F.col("text"), R.EXTRACTION_SHOTS)
    flat = F.array_join(F.transform("m", lambda e: e["content"]), "|")
    return full.select("record_id", chat.alias("m")).select("record_id", F.size("m").alias("messages"), flat.alias("content"))


EXTRACTION_SQL = f"""WITH {MESSAGES_SQL},
shots AS (SELECT string_agg('text ' || i || '|@@text## ' || i, '|' ORDER BY i) AS t FROM (SELECT unnest(range(1, 7)) AS i))
SELECT record_id, 15::INTEGER AS messages, 'You read ' || role || '|Mark all skills.|' || t || '|' || text AS content
FROM msgs, shots WHERE role <> 'system'"""


def invalid_kinds(spark, folder):
    rows = read(spark, folder, "conversations").select(F.col("role").alias("data_type"))
    known = rows.where("data_type <> 'system'").distinct()
    return R.invalid_kinds(rows, known, ["data_type"])


def negative_plan(spark, folder):
    """Requests for as many negatives as each source has poor documents."""
    rows = read(spark, folder, "documents").join(read(spark, folder, "labels"), "doc_id")
    totals = rows.where("quality = 0").groupBy("source").agg((F.count("*") * 10).alias("total"))
    return R.negative_plan(totals, keep=["source"])


NEGATIVE_SQL = """WITH totals AS (
  SELECT source, count(*) * 10 AS total FROM documents JOIN labels USING (doc_id) WHERE quality = 0 GROUP BY source)
SELECT source, kind, unnest(range(1, ceil(share * total / 20.0::DOUBLE)::INTEGER + 1))::INTEGER AS request_no
FROM totals, (VALUES ('TYPE-1', 0.8::DOUBLE), ('TYPE-2', 0.2::DOUBLE)) k(kind, share)"""


def explode_labels(spark, folder):
    rows = R.explode_labels(messages(spark, folder).select("record_id", "mentions"), "mentions")
    direct = R.direct_annotations(
        rows.select("record_id", F.col("record_id").alias("sentence"), F.coalesce("skill", F.lit("LABEL NOT PRESENT")).alias("skill")))
    return rows.join(direct.select("record_id", "annotated_sentence"), "record_id", "left")


EXPLODE_SQL = f"""WITH {MESSAGES_SQL}
SELECT record_id, unnest(CASE WHEN len(mentions) = 0 THEN [NULL] ELSE mentions END) AS skill,
       CASE WHEN len(mentions) = 0 THEN record_id END AS annotated_sentence FROM msgs"""


def random_spans(spark, folder):
    """One random mention per message; messages without mentions have none."""
    rows = message_spans(spark, folder)
    return rows.select("record_id", K.random_span(F.col("spans"), 42, F.col("record_id")).alias("span"))


RANDOM_SPAN_SQL = f"""WITH {MESSAGES_SQL}
SELECT record_id, lower(mentions[floor({u_sql(42, "'span'", 'record_id')} * len(mentions))::INTEGER + 1]) AS span FROM msgs"""


def mixed_map(spark, folder):
    """Candidates of a record as one map from span to entities, written out in the order of spans."""
    records = message_spans(spark, folder)
    vectors = mention_vectors(spark, folder, K.record_spans(records))
    found = K.select_candidates(records, entities(spark, folder), TOP, "embeddings", span_vectors=vectors)
    shown = lambda e: F.concat(e["key"], F.lit("="), F.array_join(F.transform(e["value"], lambda c: F.concat(
        c["unique_id"].cast("string"), F.lit(":"), c["name"])), ","))
    entries = F.transform(F.array_sort(F.map_entries("candidates")), shown)
    return K.candidate_map(found).select("record_id", F.size("candidates").alias("spans"), joined(entries).alias("entities"))


MAP_SQL = f"""WITH found AS ({VECTOR_METHOD_SQL}),
listed AS (
  SELECT record_id, span, span || '=' || string_agg(unique_id || ':' || name, ',' ORDER BY unique_id) AS entry FROM found GROUP BY record_id, span)
SELECT record_id, count(*)::INTEGER AS spans, string_agg(entry, '|' ORDER BY span) AS entities FROM listed GROUP BY record_id"""


FUZZY_SQL = f"""WITH {MESSAGES_SQL}, {ENTITIES_SQL},
rest AS (
  SELECT DISTINCT span FROM spans WHERE NOT EXISTS (SELECT 1 FROM ents WHERE contains(lower(name_definition), span))),
names AS (SELECT DISTINCT p_name AS name FROM part),
pairs AS (SELECT span, name FROM rest, names),
{token_set_sql('pairs', 'span', 'name', 'scored')}
SELECT span, p_partkey AS unique_id, score::INTEGER AS score FROM scored JOIN part ON p_name = name
QUALIFY row_number() OVER (PARTITION BY span ORDER BY score DESC, p_partkey) <= {TOP}"""


def known_mixed_candidates(spark, folder):
    """Passages and their own capitalised words: each word has an exact match, vectors add others."""
    rows = read(spark, folder, "benchmark").select(
        F.col("item_id").alias("record_id"),
        F.transform(F.regexp_extract_all("text", F.lit(r"\b[A-Z][a-z]{4,}"), 0), F.lower).alias("spans"))
    vectors = mention_vectors(spark, folder, K.record_spans(rows))
    found = K.select_candidates(rows, entities(spark, folder), TOP, "mixed", span_vectors=vectors)
    return found.select("record_id", "span", "unique_id", "level2", "name", joined("methods").alias("methods"))


KNOWN_MIXED_SQL = rf"""WITH {ENTITIES_SQL},
spans AS (
  SELECT DISTINCT item_id AS record_id, lower(w) AS span
  FROM (SELECT item_id, unnest(regexp_extract_all(text, '\b[A-Z][a-z]{{4,}}')) AS w FROM benchmark)),
words AS (SELECT DISTINCT span FROM spans),
exact AS (
  SELECT span, unique_id, 'exact' AS method FROM words JOIN ents ON contains(lower(name_definition), span)
  QUALIFY row_number() OVER (PARTITION BY span ORDER BY {u_sql(42, 'span', 'unique_id')}, unique_id) <= {TOP}),
pointed AS (SELECT span, floor({u_sql("'vector'", 'span')} * (SELECT count(*) FROM embeddings))::BIGINT AS vec_id FROM words),
near AS (
  SELECT span, unique_id, 'vector' AS method FROM (
    SELECT p.span, n.unique_id, round(list_cosine_similarity(v.embedding::DOUBLE[], n.e), 9) AS sim
    FROM pointed p JOIN embeddings v USING (vec_id), ents n)
  QUALIFY row_number() OVER (PARTITION BY span ORDER BY sim DESC, unique_id) <= {TOP}),
found AS (SELECT * FROM exact UNION ALL SELECT * FROM near)
SELECT record_id, span, unique_id, any_value(level2) AS level2, any_value(name) AS name, string_agg(method, '|' ORDER BY method) AS methods
FROM spans JOIN found USING (span) JOIN ents USING (unique_id) GROUP BY record_id, span, unique_id"""


MIXED_SQL = f"""WITH {EXACT_CTE},
words AS (SELECT DISTINCT span FROM spans),
pairs AS (SELECT span, name FROM words, (SELECT DISTINCT name FROM ents) WHERE span NOT IN (SELECT span FROM exact)),
{token_set_sql('pairs', 'span', 'name', 'scored')},
fuzzy AS (
  SELECT span, unique_id FROM scored JOIN ents USING (name)
  QUALIFY row_number() OVER (PARTITION BY span ORDER BY score DESC, unique_id) <= {TOP}),
pointed AS (SELECT span, floor({u_sql("'vector'", 'span')} * (SELECT count(*) FROM embeddings))::BIGINT AS vec_id FROM words),
near AS (
  SELECT span, unique_id FROM (
    SELECT p.span, n.unique_id, round(list_cosine_similarity(v.embedding::DOUBLE[], n.e), 9) AS sim
    FROM pointed p JOIN embeddings v USING (vec_id), ents n)
  QUALIFY row_number() OVER (PARTITION BY span ORDER BY sim DESC, unique_id) <= {TOP}),
found AS (SELECT *, 'exact' AS method FROM exact UNION ALL SELECT *, 'fuzzy' FROM fuzzy UNION ALL SELECT *, 'vector' FROM near),
each_span AS (SELECT span, unique_id, string_agg(method, '|' ORDER BY method) AS methods FROM found GROUP BY ALL)
SELECT record_id, span, unique_id, level2, name, methods FROM spans JOIN each_span USING (span) JOIN ents USING (unique_id)"""


QUERIES = {
    "known_mixed_candidates": (known_mixed_candidates, KNOWN_MIXED_SQL),
    "random_spans": (random_spans, RANDOM_SPAN_SQL),
    "candidate_map": (mixed_map, MAP_SQL),
    "rule_candidates_exact": (rule_candidates_exact, EXACT_SQL),
    "fuzzy_candidates": (fuzzy_candidates, FUZZY_SQL),
    "vector_candidates": (vector_candidates, VECTOR_SQL),
    "vector_method_candidates": (vector_method_candidates, VECTOR_METHOD_SQL),
    "mixed_candidates": (mixed_candidates, MIXED_SQL),
    "gold_in_candidates": (gold_in_candidates, GOLD_SQL),
    "few_shot_knn": (few_shot_knn, FEW_SHOT_SQL),
    "few_shot_random": (few_shot_random, FEW_RANDOM_SQL),
    "locate_spans": (locate_spans, LOCATE_SQL),
    "span_mean_vectors": (span_mean_vectors, SPAN_MEAN_SQL),
    "split_disjoint": (split_disjoint, SPLIT_SQL),
    "split_overlap": (split_overlap, OVERLAP_SQL),
    "merge_negatives": (merge_negatives, MERGE_SQL),
    "merged_order": (merged_order, ORDER_SQL),
    "head_rows": (head_rows, HEAD_SQL),
    "route_modes": (route_modes, ROUTE_SQL),
    "prompt_requests": (prompt_requests, PROMPT_SQL),
    "mcq_requests": (mcq_requests, MCQ_SQL),
    "parse_answers": (parse_answers, PARSE_SQL),
    "attach_answers": (attach_answers, ATTACH_SQL),
    "refine_retry": (refine_retry, REFINE_SQL),
    "merged_passes": (merged_passes, MERGED_SQL),
    "matching_shots": (matching_shots, SHOT_SQL),
    "extraction_requests": (extraction_requests, EXTRACTION_SQL),
    "invalid_kinds": (invalid_kinds, "SELECT DISTINCT role AS data_type FROM conversations WHERE role = 'system'"),
    "negative_plan": (negative_plan, NEGATIVE_SQL),
    "explode_labels": (explode_labels, EXPLODE_SQL),
}
