"""Whole flows as one query each, and checks that reach cases the single operators don't."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions import text as X
from spanloom.functions.randomness import unit_random
from spanloom.operators import candidates as K
from spanloom.operators import embedding as E
from spanloom.operators import fidelity as P
from spanloom.operators import metrics as M
from spanloom.operators import neighbours as N
from spanloom.operators import requests as R
from spanloom.operators import splits as S
from spanloom.plans import generation as G
from spanloom.plans import matching as Q
from spanloom.session import cut_lineage
from suite import combos as C
from suite.common import (
    ENTITIES_SQL, MESSAGES_SQL, PREDICTIONS_SQL, entities, joined, messages, popularity, predictions, ratio_sql, read, taxonomy, u_sql,
)
from suite.matching import (
    FEW_SHOT_SQL, LOCATE_CTE, TOP, mention_vectors, sentence_tokens, support_rows,
)
from suite.scores import PRF_SHOWN, prf_sql, rounded
from suite.texts import SPACES

# ---- extract, candidates, question, answer, match, score ----

LETTERS = TOP + 1  # the last letter names no option


def _matched(spark, folder):
    """Messages whose mentions are extracted, asked for, answered by formula and matched."""
    named = entities(spark, folder).withColumn(
        "name_definition", X.name_definition("name", F.lit(None), F.lit(None), "name_definition"))
    rows = messages(spark, folder).select("record_id", F.col("text").alias("sentence"), F.col("role").alias("data_type"), "mentions")
    marked = F.array_join(F.transform("mentions", lambda m: F.concat(F.lit("@@"), m, F.lit("##"))), " ")
    records = Q.extracted(rows.drop("mentions"), rows.select("record_id", marked.alias("answer")))
    vectors = mention_vectors(spark, folder, K.record_spans(records))
    found = cut_lineage(K.select_candidates(records, named, TOP, "embeddings", span_vectors=vectors), "candidates")
    gold = found.where((F.col("rank") == 1) & (unit_random("gold", F.col("record_id"), F.col("span")) < 0.5)).groupBy("record_id").agg(
        F.array_sort(F.collect_set("name")).alias("skills"))
    records = records.join(gold, "record_id", "left").withColumn("skills", F.coalesce("skills", F.array().cast("array<string>")))
    templates = rows.select("data_type").distinct().select(
        "data_type", F.lit("S").alias("system"), F.lit("I").alias("instruction"), F.lit(None).cast(R.SHOTS).alias("shots"))
    questions = Q.matching_requests(records, found, templates)
    place = F.floor(unit_random("letter", F.col("record_id"), F.col("span")) * LETTERS).cast("int")
    answers = questions.select("record_id", "span", F.concat(F.char(place + 65), F.lit(": my choice")).alias("answer"))
    return Q.matched_records(records, questions, answers)


def match_records(spark, folder):
    """The entity record that was chosen for each span."""
    found = _matched(spark, folder).select("record_id", F.explode("matches").alias("m"))
    return found.select("record_id", "m.span", "m.unique_id", "m.level2", "m.name", F.length("m.name_definition").alias("shown"))


def match_and_score(spark, folder):
    return rounded(Q.scores(_matched(spark, folder), "skills", by=["data_type"]))


MATCHED_CTE = f"""{MESSAGES_SQL}, {ENTITIES_SQL},
pointed AS (
  SELECT DISTINCT span, floor({u_sql("'vector'", 'span')} * (SELECT count(*) FROM embeddings))::BIGINT AS vec_id FROM spans),
near AS (
  SELECT span, unique_id, level2, name, name_definition, row_number() OVER (PARTITION BY span ORDER BY sim DESC, unique_id) AS rank FROM (
    SELECT p.span, n.*, round(list_cosine_similarity(v.embedding::DOUBLE[], n.e), 9) AS sim
    FROM pointed p JOIN embeddings v USING (vec_id), ents n)),
matched AS (
  SELECT s.record_id, s.span, unique_id, level2, name, name_definition
  FROM spans s JOIN near n USING (span)
  WHERE n.rank <= {TOP} AND n.rank = floor({u_sql("'letter'", 's.record_id', 's.span')} * {LETTERS}) + 1),
golden AS (
  SELECT DISTINCT s.record_id, n.name FROM spans s JOIN near n USING (span)
  WHERE n.rank = 1 AND {u_sql("'gold'", 's.record_id', 's.span')} < 0.5)"""
MATCH_RECORDS_SQL = f"""WITH {MATCHED_CTE}
SELECT record_id, span, unique_id, level2, name, (length(name) + 2 + length(name_definition))::INTEGER AS shown FROM matched"""
_FLOW_COUNTS = """SELECT role AS run_id, sum(len(list_intersect(predicted, gold)))::BIGINT AS tp,
    sum(len(list_filter(predicted, lambda x: NOT list_contains(gold, x))))::BIGINT AS fp,
    sum(len(list_filter(gold, lambda x: NOT list_contains(predicted, x))))::BIGINT AS fn FROM lists GROUP BY role"""
MATCH_SCORE_SQL = f"""WITH {MATCHED_CTE},
lists AS (
  SELECT m.role, coalesce((SELECT list(DISTINCT name) FROM matched x WHERE x.record_id = m.record_id), []) AS predicted,
         coalesce((SELECT list(name) FROM golden g WHERE g.record_id = m.record_id), []) AS gold FROM msgs m),
{prf_sql(_FLOW_COUNTS)} {PRF_SHOWN.replace("run_id,", "run_id AS data_type,")}"""


# ---- taxonomy, combinations, requests, samples, splits ----

def generate_dataset(spark, folder):
    """Combinations to requests, answers by formula, splits, then negatives and samples of excluded entities mixed in."""
    tax = taxonomy(spark, folder).select(
        "name", "embedding", F.concat(F.lit("also "), "name").alias("alt_labels"), F.lit("text").alias("description"))
    near = G.neighbours(tax, C.K)
    made = G.combinations(tax, popularity(spark, folder), 2 * tax.count(), threshold=C.NEAR, near=near)
    templates = spark.sql("SELECT mode, 'S' AS system, 'About {skillList}' AS instruction FROM VALUES ('dense'), ('sparse') AS t(mode)")
    asked = G.generation_requests(made, tax, templates.withColumn("shots", F.lit(None).cast(R.SHOTS)), near=near)
    answers = asked.select("request_id", F.when(F.col("draw_id") % 7 > 0, F.concat(F.lit("text "), "request_id")).alias("answer"))
    samples = G.collect_samples(asked, answers).where("sentence is not null").select("sentence", "skills")
    placed = S.assign_splits(samples, "sentence", S.rest_sizes(S.distinct_count(samples, "sentence")))
    negatives = read(spark, folder, "benchmark").select(F.col("text").alias("sentence"), F.array(F.lit("LABEL NOT PRESENT")).alias("skills"))
    excluded = read(spark, folder, "part").select(
        F.concat(F.lit("about "), "p_name").alias("sentence"), F.array("p_type").alias("skills"))
    full = G.with_negatives(placed, negatives, excluded)
    return full.select("sentence", joined("skills").alias("skills"), "split")


def _split_sql(table: str) -> str:
    return f"""(SELECT t.sentence, t.skills, CASE WHEN place < n - rest THEN 'train' WHEN place < n - rest // 2 THEN 'test' ELSE 'dev' END AS split
  FROM {table} t JOIN (
    SELECT sentence, row_number() OVER (ORDER BY {u_sql(42, 'sentence')}, sha256(sentence)) - 1 AS place
    FROM (SELECT DISTINCT sentence FROM {table})) USING (sentence),
  (SELECT count(DISTINCT sentence) AS n, floor(0.3::DOUBLE * count(DISTINCT sentence))::BIGINT AS rest FROM {table}))"""


DATASET_SQL = f"""WITH {C.COMBOS_SQL},
samples AS (
  SELECT 'text ' || draw_id::BIGINT || '-' || mode AS sentence, array_to_string(members, '|') AS skills
  FROM combos, (VALUES ('dense', 1, 4), ('sparse', 3, 5)) m(mode, low, high)
  WHERE len(members) BETWEEN low AND high AND draw_id % 7 > 0),
negatives AS (SELECT text AS sentence, 'LABEL NOT PRESENT' AS skills FROM benchmark),
excluded AS (SELECT 'about ' || p_name AS sentence, 'NO LABEL' AS skills FROM part)
SELECT * FROM {_split_sql('samples')} UNION ALL SELECT * FROM {_split_sql('negatives')} UNION ALL SELECT * FROM {_split_sql('excluded')}"""


def reference_shot_texts(spark, folder):
    """Finished examples for each combination from the nearest reference texts."""
    made = C.combos(spark, folder)
    texts = read(spark, folder, "benchmark").select(
        F.col("item_id").alias("reference_id"), F.concat(F.substring_index("text", " ", 1), F.lit(" : "), "text").alias("skill_sentence"))
    found = N.nearest_references(made, taxonomy(spark, folder), C.references(spark, folder), 3, 0.05)
    shots = G.reference_shots(found, texts)
    flat = F.transform("shots", lambda s: F.concat(s["question"], F.lit("\n"), s["answer"]))
    return shots.select("draw_id", F.array_join(flat, "\n").alias("shots"))


SHOT_TEXT_SQL = f"""WITH found AS ({C.REFERENCE_SQL})
SELECT draw_id, string_agg('skills: ' || split_part(text, ' ', 1) || chr(10) || 'Job Opening : ' || text || '.', chr(10) ORDER BY rank) AS shots
FROM found JOIN benchmark ON item_id = reference_id GROUP BY draw_id"""


def extraction_support_shots(spark, folder):
    """The nearest support sentences of each vector as examples for extraction."""
    found = K.nearest_support(read(spark, folder, "embeddings"), support_rows(spark, folder), 3, record="vec_id")
    marked = found.select(F.col("vec_id").alias("record_id"), "sentence", X.annotate_spans("sentence", "spans").alias("annotated_sentence"), "rank")
    flat = F.transform("shots", lambda s: F.concat(s["question"], F.lit(" -> "), s["answer"]))
    return Q.extraction_shots(marked).select("record_id", F.array_join(flat, "\n").alias("shots"))


SUPPORT_SHOTS_SQL = f"""{FEW_SHOT_SQL.split('SELECT vec_id, support_id, skill, sim, rank')[0]}
SELECT vec_id AS record_id, string_agg(s.sentence || ' -> ' || replace(s.sentence, s.spans[1], '@@' || s.spans[1] || '##'), chr(10) ORDER BY rank) AS shots
FROM near n JOIN numbered s
  ON s.sentence = n.sentence AND s.place = floor({u_sql(42, 'n.vec_id', 'n.sentence')} * n.copies)
WHERE len(s.spans) > 0 GROUP BY vec_id"""


# ---- a gold option beyond the letters ----

MANY, LATE = 30, 29


def gold_beyond_letters(spark, folder):
    """The 29th of 30 candidates is right: it moves to the front and has a letter."""
    near = K.nearest_entities(read(spark, folder, "embeddings"), entities(spark, folder), MANY, "vec_id", "embedding")
    listed = near.groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("rank", "unique_id"))).alias("c"))
    options = F.transform("c", lambda e: F.concat(F.lit("e"), e["unique_id"].cast("string")))
    rows = listed.select("vec_id", options.alias("options")).withColumn("gold", F.element_at("options", LATE))
    shown = K.with_gold(F.col("options"), F.col("gold"))
    shot = R.matching_shot(F.lit("A sentence."), F.lit("span"), shown, F.col("gold"))
    return rows.select("vec_id", shot.alias("s")).select("vec_id", "s.question", "s.answer")


BEYOND_SQL = f"""WITH {ENTITIES_SQL},
ranked AS (
  SELECT vec_id, unique_id, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, unique_id) AS rank FROM (
    SELECT v.vec_id, n.unique_id, round(list_cosine_similarity(v.embedding::DOUBLE[], n.e), 9) AS sim FROM embeddings v, ents n)),
lists AS (SELECT vec_id, list('e' || unique_id ORDER BY rank) AS c FROM ranked WHERE rank <= {MANY} GROUP BY vec_id),
shown AS (SELECT vec_id, list_concat([c[{LATE}]], c[1:25]) AS options FROM lists)
SELECT vec_id, 'Sentence: A sentence. ' || chr(10) || 'Skill: span ' || chr(10) || 'Options: ' ||
       array_to_string(list_transform(options, lambda o, i: chr(64 + i::INTEGER) || ': ' || o), ' ' || chr(10)) AS question, 'A' AS answer
FROM shown"""


# ---- spans with a typing error, found by the mean or by the sum of token ratios ----

def locate_typos(spark, folder):
    wrong = F.transform("pair", lambda t, i: F.when(i == 1, F.concat(F.substring(t, F.lit(1), F.length(t) - 1), F.lit("q"))).otherwise(t))
    rows = sentence_tokens(spark, folder).withColumn("pair", wrong)
    mean = E.locate_span(F.col("tokens"), F.col("pair"), threshold=80)
    total = E.locate_span(F.col("tokens"), F.col("pair"), threshold=175, per_token=False)
    found = rows.withColumn("m", mean).withColumn("t", total)
    return found.select("record_id", F.array_join("pair", " ").alias("span"), F.col("m.start").alias("mean_start"), F.col("t.start").alias("sum_start"))


TYPO_SQL = f"""WITH {LOCATE_CTE.split('located AS')[0].rstrip().rstrip(',')},
wrong AS (SELECT record_id, t, a, substr(b, 1, length(b) - 1) || 'q' AS b FROM pairs),
windows AS (SELECT record_id, a, b, j, t[j] AS x, t[j + 1] AS y FROM (SELECT *, unnest(range(1, len(t))) AS j FROM wrong)),
scored AS (SELECT record_id, j - 1 AS start, {ratio_sql('x', 'a')} + {ratio_sql('y', 'b')} AS total FROM windows),
best AS (SELECT record_id, max(total) AS total, arg_min(start, (-total, start)) AS start FROM scored GROUP BY record_id)
SELECT record_id, a || ' ' || b AS span, CASE WHEN total >= 160 THEN start END::INTEGER AS mean_start,
       CASE WHEN total >= 175 THEN start END::INTEGER AS sum_start FROM wrong LEFT JOIN best USING (record_id)"""


# ---- runs, another corpus, hashed words ----

RUNS, SHARE = 5, 0.8


def resampled_runs(spark, folder):
    runs = M.resample_runs(predictions(spark, folder), "record_id", RUNS, SHARE)
    return rounded(M.summarise_runs(M.micro_scores(runs, by=["run_id"])))


_RUN_COUNTS = """SELECT run_id, sum(len(list_intersect(predicted, gold)))::BIGINT AS tp,
    sum(len(list_filter(list_distinct(predicted), lambda x: NOT list_contains(gold, x))))::BIGINT AS fp,
    sum(len(list_filter(gold, lambda x: NOT list_contains(predicted, x))))::BIGINT AS fn FROM resampled GROUP BY run_id"""
RESAMPLED_SQL = f"""WITH {PREDICTIONS_SQL},
resampled AS (
  SELECT r AS run_id, gold, predicted FROM preds, (SELECT unnest(range({RUNS})) AS r)
  WHERE {u_sql(42, "'run'", 'r', 'record_id')} < {SHARE}),
{prf_sql(_RUN_COUNTS)}
SELECT count(*) AS runs, round(avg(p), 9) AS precision_mean, round(stddev_samp(p), 9) AS precision_std, round(avg(r), 9) AS recall_mean,
       round(stddev_samp(r), 9) AS recall_std, round(avg(f), 9) AS f1_mean, round(stddev_samp(f), 9) AS f1_std FROM scored"""


BOOTSTRAPS = 40


def poisson_runs(spark, folder):
    """Bootstrap intervals of the scores: each record counts a Poisson number of times in each run."""
    counts = M.record_counts(predictions(spark, folder)).select("record_id", "tp", "fp", "fn")
    # the counts are a few small files, and each row is hashed once for every run
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    runs = M.poisson_runs(cut_lineage(counts, "counts").repartition(tasks), "record_id", BOOTSTRAPS)
    return rounded(M.run_intervals(M.total_scores(runs, by=["run_id"], weight="weight")))


_POISSON_STEPS = " + ".join(f"(u >= {edge!r}::DOUBLE)::INTEGER" for edge in M.POISSON_STEPS)
_POISSON_COUNTS = "SELECT run_id, sum(weight * t)::BIGINT AS tp, sum(weight * x)::BIGINT AS fp, sum(weight * m)::BIGINT AS fn FROM resampled GROUP BY run_id"
POISSON_SQL = f"""WITH {PREDICTIONS_SQL},
counted AS (
  SELECT record_id, len(list_intersect(predicted, gold)) AS t, len(list_filter(list_distinct(predicted), lambda x: NOT list_contains(gold, x))) AS x,
         len(list_filter(gold, lambda x: NOT list_contains(predicted, x))) AS m FROM preds),
drawn AS (SELECT r AS run_id, t, x, m, {u_sql(42, "'poisson'", 'r', 'record_id')} AS u FROM counted, (SELECT unnest(range({BOOTSTRAPS})) AS r)),
resampled AS (SELECT *, {_POISSON_STEPS} AS weight FROM drawn),
{prf_sql(_POISSON_COUNTS)},
named AS (SELECT unnest(['precision', 'recall', 'f1']) AS metric, unnest([p, r, f]) AS x FROM scored)
SELECT metric, round(quantile_cont(x, 0.025), 9) AS low, round(quantile_cont(x, 0.975), 9) AS high FROM named GROUP BY metric"""


def perplexity_by_corpus(spark, folder):
    """Messages under the bigrams of the documents, most of which they share no word with."""
    rows = messages(spark, folder).select("record_id", "text")
    corpus = read(spark, folder, "documents").select(F.col("doc_id").alias("record_id"), "text")
    scored = P.ngram_perplexity(rows, "record_id", "text", corpus)
    return scored.select("record_id", "tokens", F.round("perplexity", 4).alias("perplexity"))


def _pairs_sql(key: str, table: str) -> str:
    return f"""SELECT {key} AS k, t[i] AS w1, t[i + 1] AS w2, count(*) AS n FROM (
  SELECT {key}, t, unnest(range(1, len(t))) AS i FROM (
    SELECT {key}, list_concat(['<s>'], regexp_extract_all(lower(text), '[^{SPACES}]+')) AS t FROM {table})) GROUP BY ALL"""


CORPUS_SQL = f"""WITH {MESSAGES_SQL},
pairs AS (SELECT w1, w2, sum(n) AS n FROM ({_pairs_sql('doc_id', 'documents')}) GROUP BY ALL),
contexts AS (SELECT w1, sum(n) AS c FROM pairs GROUP BY w1),
vocab AS (SELECT count(DISTINCT w2) AS v FROM pairs),
own AS ({_pairs_sql('record_id', 'msgs')})
SELECT k AS record_id, sum(o.n)::BIGINT AS tokens,
       round(exp(-sum(o.n * ln((coalesce(p.n, 0) + 1)::DOUBLE / (coalesce(c, 0) + v)::DOUBLE)) / sum(o.n)), 4) AS perplexity
FROM own o LEFT JOIN pairs p USING (w1, w2) LEFT JOIN contexts USING (w1), vocab GROUP BY k"""


def hash_embed_weights(spark, folder):
    """Weights of a part's words, largest first: at this width no two words of the few that parts use share a place."""
    rows = read(spark, folder, "part").select("p_partkey", F.concat_ws(" ", "p_type", "p_type", "p_brand", F.lit("part")).alias("text"))
    # a small file of many rows comes in few splits, and each row is thousands of numbers wide for a moment
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    held = F.sort_array(F.array_remove("embedding", F.lit(0.0)), asc=False)  # no weight is negative
    return E.hash_embed(rows.repartition(tasks), "text", 4096).select(
        "p_partkey", joined(F.transform(held, lambda x: F.format_number(x, 6))).alias("weights"))


WEIGHTS_SQL = f"""WITH words AS (
  SELECT p_partkey, unnest(regexp_extract_all(lower(p_type || ' ' || p_type || ' ' || p_brand || ' part'), '[^{SPACES}]+')) AS w FROM part),
counts AS (SELECT p_partkey, w, count(*) AS n FROM words GROUP BY ALL),
norms AS (SELECT p_partkey, sqrt(sum(n * n)) AS length FROM counts GROUP BY p_partkey)
SELECT p_partkey, string_agg(format('{{:.6f}}', n / length), '|' ORDER BY n DESC) AS weights FROM counts JOIN norms USING (p_partkey) GROUP BY p_partkey"""


QUERIES = {
    "match_records": (match_records, MATCH_RECORDS_SQL),
    "match_and_score": (match_and_score, MATCH_SCORE_SQL),
    "generate_dataset": (generate_dataset, DATASET_SQL),
    "reference_shot_texts": (reference_shot_texts, SHOT_TEXT_SQL),
    "extraction_support_shots": (extraction_support_shots, SUPPORT_SHOTS_SQL),
    "gold_beyond_letters": (gold_beyond_letters, BEYOND_SQL),
    "locate_typos": (locate_typos, TYPO_SQL),
    "poisson_runs": (poisson_runs, POISSON_SQL),
    "resampled_runs": (resampled_runs, RESAMPLED_SQL),
    "perplexity_by_corpus": (perplexity_by_corpus, CORPUS_SQL),
    "hash_embed_weights": (hash_embed_weights, WEIGHTS_SQL),
}
