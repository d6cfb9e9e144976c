"""Metrics, label vectors and classifiers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from spanloom.functions.randomness import unit_random
from spanloom.operators import classify as Z
from spanloom.operators import metrics as M
from spanloom.operators import neighbours as N
from spanloom.session import cut_lineage, shared_folder
from spanloom.sources import tables as S
from suite.common import PREDICTIONS_SQL, joined, predictions, read, taxonomy, texts, u_sql

DIGITS = 9


def rounded(df, keep=()):
    return df.select(*[
        F.round(f.name, DIGITS).alias(f.name) if f.dataType.simpleString() == "double" and f.name not in keep else f.name
        for f in df.schema.fields])


def entity_1to1(spark, folder):
    return rounded(M.entity_one_to_one(predictions(spark, folder)))


ONE_TO_ONE_CTE = f"""{PREDICTIONS_SQL},
rows AS (SELECT unnest(gold) AS truth, predicted FROM preds),
pairs AS (
  SELECT truth, CASE WHEN list_contains(predicted, truth) THEN truth WHEN len(predicted) > 0 THEN predicted[1]
                     ELSE 'LABEL NOT PRESENT' END AS guess FROM rows),
classes AS (SELECT truth AS c FROM pairs UNION SELECT guess FROM pairs),
per AS (
  SELECT c, count(*) FILTER (truth = c AND guess = c) AS tp, count(*) FILTER (guess = c AND truth <> c) AS fp,
         count(*) FILTER (truth = c AND guess <> c) AS fn
  FROM classes, pairs GROUP BY c),
avgs AS (
  SELECT sum(tp) / (sum(tp) + sum(fn)) AS accuracy, sum(tp) / (sum(tp) + sum(fp)) AS precision_micro,
         avg(CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END) AS precision_macro,
         sum(tp) / (sum(tp) + sum(fn)) AS recall_micro,
         avg(CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END) AS recall_macro FROM per)"""
ONE_COLUMNS = """round(accuracy, 9) AS accuracy, round(precision_micro, 9) AS precision_micro,
  round(precision_macro, 9) AS precision_macro, round(recall_micro, 9) AS recall_micro, round(recall_macro, 9) AS recall_macro,
  round(2 * precision_micro * recall_micro / (precision_micro + recall_micro), 9) AS f1_micro,
  round(2 * precision_macro * recall_macro / (precision_macro + recall_macro), 9) AS f1_macro"""
ONE_TO_ONE_SQL = f"WITH {ONE_TO_ONE_CTE} SELECT {ONE_COLUMNS} FROM avgs"


def jaccard(spark, folder):
    return rounded(M.entity_many_to_many(predictions(spark, folder), by=["run_id"]))


JACCARD_CTE = """shares AS (
  SELECT run_id, CASE WHEN len(gold) = 0 AND len(predicted) = 0 THEN 1.0::DOUBLE
         ELSE len(list_intersect(gold, predicted))::DOUBLE / len(list_distinct(list_concat(gold, predicted))) END AS j FROM preds)"""
JACCARD_SQL = f"WITH {PREDICTIONS_SQL}, {JACCARD_CTE} SELECT run_id, round(avg(j), 9) AS jaccard_accuracy FROM shares GROUP BY run_id"


def entity_quality(spark, folder):
    return rounded(M.entity_quality(predictions(spark, folder)))


QUALITY_SQL = f"""WITH {ONE_TO_ONE_CTE}, {JACCARD_CTE}
SELECT {ONE_COLUMNS}, (SELECT round(avg(j), 9) FROM shares) AS jaccard_accuracy FROM avgs"""


def with_unknown(spark, folder):
    """One type counts as unknown in the gold lists."""
    gold = F.transform("gold", lambda g: F.when(g == "PROMO", "UNK").otherwise(g))
    return predictions(spark, folder).withColumn("gold", gold)


UNKNOWN_CTE = f"""{PREDICTIONS_SQL},
marked AS (
  SELECT record_id, run_id, predicted, list_transform(gold, lambda g: CASE WHEN g = 'PROMO' THEN 'UNK' ELSE g END) AS gold FROM preds)"""


def prf_sql(counts):
    return f"""counts AS ({counts}),
pr AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp)::DOUBLE END AS p,
              CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn)::DOUBLE END AS r FROM counts),
scored AS (SELECT *, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f FROM pr)"""


SET_COUNTS = """SELECT run_id, sum(len(list_intersect(predicted, gold)))::BIGINT AS tp,
    sum(len(list_filter(list_distinct(predicted), lambda x: NOT list_contains(gold, x))))::BIGINT AS fp,
    sum(len(list_filter(gold, lambda x: x <> 'UNK' AND NOT list_contains(predicted, x))))::BIGINT AS fn FROM marked GROUP BY run_id"""
SPAN_COUNTS = SET_COUNTS.replace("len(list_intersect(predicted, gold))", "len(list_filter(predicted, lambda x: list_contains(gold, x)))").replace(
    "list_filter(list_distinct(predicted), lambda x: NOT", "list_filter(predicted, lambda x: NOT")
PRF_SHOWN = "SELECT run_id, tp, fp, fn, round(p, 9) AS precision, round(r, 9) AS recall, round(f, 9) AS f1 FROM scored"


def micro_prf(spark, folder, unit="set"):
    return rounded(M.micro_scores(with_unknown(spark, folder), unit=unit, by=["run_id"]))


def runs_summary(spark, folder):
    return rounded(M.summarise_runs(M.micro_scores(with_unknown(spark, folder), by=["run_id"])))


RUNS_SQL = f"""WITH {UNKNOWN_CTE}, {prf_sql(SET_COUNTS)}
SELECT count(*) AS runs, round(avg(p), 9) AS precision_mean, round(stddev_samp(p), 9) AS precision_std, round(avg(r), 9) AS recall_mean,
       round(stddev_samp(r), 9) AS recall_std, round(avg(f), 9) AS f1_mean, round(stddev_samp(f), 9) AS f1_std FROM scored"""


# ---- multi-label vectors: source, quality and toxicity as labels of a document ----

def labelled(spark, folder):
    rows = read(spark, folder, "documents").select("doc_id", "text", "source").join(read(spark, folder, "labels"), "doc_id")
    labels = F.array_compact(F.array(
        F.col("source"), F.when(F.col("quality") == 1, "good"), F.when(F.col("toxic") == 1, "toxic")))
    return rows.select("doc_id", "text", labels.alias("labels"))


LABELLED_CTE = """labelled AS (
  SELECT doc_id, list_filter([source, CASE quality WHEN 1 THEN 'good' END, CASE toxic WHEN 1 THEN 'toxic' END],
                             lambda x: x IS NOT NULL) AS labels
  FROM documents JOIN labels USING (doc_id)),
space AS (
  SELECT label, row_number() OVER (ORDER BY label) - 1 AS label_id
  FROM (SELECT DISTINCT unnest(labels) AS label FROM labelled)),
truths AS (
  SELECT doc_id, label_id, label, list_contains(labels, label)::INTEGER AS t FROM labelled, space)"""


def label_space(spark, folder):
    return M.label_space(labelled(spark, folder))


def multi_hot(spark, folder):
    rows = labelled(spark, folder)
    hot = M.multi_hot(rows, M.label_space(rows), "doc_id")
    return hot.select("doc_id", joined(F.transform("truth", lambda t: t.cast("int").cast("string"))).alias("truth"))


HOT_SQL = f"""WITH {LABELLED_CTE}
SELECT doc_id, string_agg(t, '|' ORDER BY label_id) AS truth FROM truths GROUP BY doc_id"""


def scored(spark, folder):
    """Made-up logits: hash noise that leans towards the truth, rounded so that ties occur."""
    rows = labelled(spark, folder)
    hot = M.multi_hot(rows, M.label_space(rows), "doc_id")
    noise = lambda t, i: F.round(6 * unit_random("logit", F.col("doc_id"), i) - 5 + 3 * t, 1)
    return hot.withColumn("logits", F.transform("truth", noise))


SCORED_CTE = f"""{LABELLED_CTE},
scored AS (
  SELECT *, 1 / (1 + exp(-round(6 * {u_sql("'logit'", 'doc_id', 'label_id')} - 5 + 3 * t, 1))) AS score FROM truths)"""


def multilabel_metrics(spark, folder):
    return rounded(M.multilabel_metrics(scored(spark, folder)))


MULTILABEL_SQL = f"""WITH {SCORED_CTE},
decided AS (SELECT *, (score >= 0.15)::INTEGER AS p FROM scored),
merged AS (SELECT score, sum(t) AS pos, sum(1 - t) AS neg FROM decided GROUP BY score),
placed AS (SELECT *, sum(neg) OVER (ORDER BY score) - neg AS below FROM merged)
SELECT (SELECT round(2.0::DOUBLE * sum(p * t) / (sum(p) + sum(t)), 9) FROM decided) AS f1,
       (SELECT round(sum(pos * (below + neg / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg)), 9) FROM placed) AS roc_auc,
       (SELECT round(avg(same), 9) FROM (SELECT min((p = t)::INTEGER) AS same FROM decided GROUP BY doc_id)) AS accuracy"""


def score_predictions(spark, folder):
    hot = scored(spark, folder).withColumn("hot", M.threshold_scores("logits"))
    named = M.labels_of(hot, M.label_space(labelled(spark, folder)), "doc_id", "hot")
    return named.select("doc_id", joined("labels").alias("predicted"))


SCORE_SQL = f"""WITH {SCORED_CTE}
SELECT doc_id, coalesce(string_agg(label, '|' ORDER BY label_id) FILTER (score >= 0.15), '') AS predicted
FROM scored GROUP BY doc_id"""


def mrr(spark, folder):
    """Rank of the first neighbour of the same category among the 20 nearest."""
    tax = taxonomy(spark, folder)
    near = N.nearest(tax, 20)
    categories = tax.select("name", "category")
    pairs = near.join(categories.withColumnRenamed("name", "anchor"), "anchor").join(
        categories.select(F.col("name").alias("neighbour"), F.col("category").alias("other")), "neighbour")
    ranks = pairs.groupBy("anchor", "category").agg(F.min(F.when(F.col("category") == F.col("other"), F.col("rank"))).alias("rank"))
    return rounded(M.mean_reciprocal_rank(ranks, by=["category"]))


MRR_SQL = """WITH tax AS (SELECT vec_id, 'v' || vec_id AS name, label::VARCHAR AS category, embedding::DOUBLE[] AS e FROM embeddings),
near AS (
  SELECT a.name, a.category, b.category AS other,
         row_number() OVER (PARTITION BY a.name ORDER BY round(list_cosine_similarity(a.e, b.e), 9) DESC, b.name) AS rank
  FROM tax a JOIN tax b ON a.name <> b.name),
firsts AS (SELECT name, category, min(rank) FILTER (category = other) AS r FROM near WHERE rank <= 20 GROUP BY ALL)
SELECT category, round(avg(coalesce(1.0::DOUBLE / r, 0)), 9) AS mrr FROM firsts GROUP BY category"""


def centroid_labels(spark, folder):
    rows = read(spark, folder, "embeddings").select("vec_id", "embedding", F.array(F.col("label").cast("string")).alias("labels"))
    return rounded(Z.centroid_labels(rows, rows, "vec_id", "labels", "embedding", 3))


CENTROID_SQL = """WITH dims AS (
  SELECT label::VARCHAR AS label, i, avg(e[i] / sqrt(list_dot_product(e, e))) AS x FROM (
    SELECT label, embedding::DOUBLE[] AS e, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY ALL),
cents AS (SELECT label, list(x ORDER BY i) AS c FROM dims GROUP BY label)
SELECT vec_id, c.label, round(list_cosine_similarity(e.embedding::DOUBLE[], c.c), 9) AS score,
       row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, c.label)::INTEGER AS rank
FROM embeddings e, cents c QUALIFY rank <= 3"""


def multilabel_classifier(spark, folder):
    """Quality and toxicity of documents from their words: one row of validation scores per setting."""
    from spanloom.operators import splits as P

    rows = texts(spark, folder).select("doc_id", "text").join(read(spark, folder, "labels"), "doc_id")
    truth = F.array(F.col("quality").cast("double"), F.col("toxic").cast("double"))
    data = rows.select("doc_id", "text", truth.alias("truth"))
    total = P.distinct_count(data, "text")
    placed = P.assign_splits(data, "text", P.rest_sizes(total))
    _, runs = Z.train_best(placed.where("split = 'train'"), placed.where("split <> 'train'"), "text", "truth", 2, seeds=(0, 1))
    return spark.createDataFrame(
        [(r["run_id"], r["seed"], r["reg"], r["f1"], r["roc_auc"], r["accuracy"]) for r in runs],
        "run_id int, seed int, reg double, f1 double, roc_auc double, accuracy double")


def judged(spark, folder):
    rows = read(spark, folder, "documents").select("doc_id", "text").join(read(spark, folder, "labels"), "doc_id")
    gold = F.array_compact(F.array(F.when(F.col("quality") == 1, "quality"), F.when(F.col("toxic") == 1, "toxic")))
    return rows.select("doc_id", "text", F.array(F.col("quality").cast("double"), F.col("toxic").cast("double")).alias("truth"), gold.alias("labels"))


def classifier_predictions(spark, folder):
    """The predict-only path through files: how often each prediction stands beside each gold list."""
    space = spark.sql("SELECT * FROM VALUES ('quality', 0L), ('toxic', 1L) AS t(label, label_id)")
    data = judged(spark, folder)
    model = Z.train(data, "text", "truth", 2)
    path = f"{shared_folder(spark)}/predicted-{uuid.uuid4().hex}"
    Z.predict_to_files(model, data, space, "doc_id", "labels", path)
    back = S.read_predictions(spark, path).select(joined("predictions").alias("predicted"), joined("gold").alias("gold"))
    return back.groupBy("predicted", "gold").agg(F.count("*").alias("n"))


def classifier_logits(spark, folder):
    """Log odds of quality and toxicity of every document, also of those without labels."""
    model = Z.train(judged(spark, folder), "text", "truth", 2)
    found = model.logits(read(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.round(F.col("logits")[0], 6).alias("quality"), F.round(F.col("logits")[1], 6).alias("toxic"))


# ---- large label spaces: the words of the benchmark as labels of a document ----

def word_labels(spark, folder):
    """Every document with its distinct words that stand in the benchmark, and the numbers of these words."""
    words = lambda t: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(t), F.lit(""))), F.lit("[a-z]{4,}"), 0))
    space = M.label_space(read(spark, folder, "benchmark").select(words("text").alias("labels")))
    named = read(spark, folder, "documents").select("doc_id", F.explode(words("text")).alias("label")).join(space, "label")
    entry = F.struct("label_id", F.round(8 * unit_random("logit", F.col("doc_id"), F.col("label")) - 4, 1).alias("logit"))
    pick = lambda name, share: unit_random(name, F.col("doc_id"), F.col("label")) < share
    listed = named.groupBy("doc_id").agg(  # a document's own words
        F.collect_list(F.when(pick("gold", 0.7), F.col("label_id"))).alias("ids"),
        F.collect_list(F.when(pick("scored", 0.8), entry)).alias("scores"))
    return read(spark, folder, "documents").select("doc_id", "text").join(listed, "doc_id", "left"), space


def sparse_metrics(spark, folder):
    """Made-up scores for most of these words, all other words of the space unscored."""
    rows, space = word_labels(spark, folder)
    return rounded(M.sparse_metrics(rows, space.count()))


SPARSE_SQL = f"""WITH words AS (
  SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{{4,}}'))) AS label FROM documents),
space AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{{4,}}')) AS label FROM benchmark),
own AS (
  SELECT doc_id, label, ({u_sql("'gold'", 'doc_id', 'label')} < 0.7)::INTEGER AS t, {u_sql("'scored'", 'doc_id', 'label')} < 0.8 AS scored,
         round(8 * {u_sql("'logit'", 'doc_id', 'label')} - 4, 1) AS logit
  FROM words JOIN space USING (label)),
dense AS (
  SELECT d.doc_id, coalesce(o.t, 0) AS t, CASE WHEN o.scored THEN 1 / (1 + exp(-o.logit)) ELSE 0 END AS score
  FROM documents d CROSS JOIN space s LEFT JOIN own o ON o.doc_id = d.doc_id AND o.label = s.label),
decided AS (SELECT *, (score >= 0.15)::INTEGER AS p FROM dense),
merged AS (SELECT score, sum(t) AS pos, sum(1 - t) AS neg FROM decided GROUP BY score),
placed AS (SELECT *, sum(neg) OVER (ORDER BY score) - neg AS below FROM merged)
SELECT (SELECT round(2.0::DOUBLE * sum(p * t) / (sum(p) + sum(t)), 9) FROM decided) AS f1,
       (SELECT round(sum(pos * (below + neg / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg)), 9) FROM placed) AS roc_auc,
       (SELECT round(avg(same), 9) FROM (SELECT min((p = t)::INTEGER) AS same FROM decided GROUP BY doc_id)) AS accuracy"""


def many_labels(spark, folder):
    """All words of the benchmark as labels, fitted in the same few steps: how many each document gets, and how many are right."""
    rows, space = word_labels(spark, folder)
    features = 1 << 10
    rows = cut_lineage(rows.select("doc_id", Z.token_slots("text", features).alias("slots"), "ids"), "word_labels")
    model = Z.train(rows, "slots", "ids", space.count(), iterations=8, features=features)
    found = model.label_ids(rows, "found")
    gold = F.coalesce("ids", F.array().cast("array<bigint>"))
    return found.select("doc_id", F.size(gold).alias("n_gold"), F.size("found").alias("n_found"),
                        F.size(F.array_intersect("found", gold)).alias("n_right"))


QUERIES = {
    "classifier_predictions": (classifier_predictions, None),
    "classifier_logits": (classifier_logits, None),
    "sparse_metrics": (sparse_metrics, SPARSE_SQL),
    "many_labels": (many_labels, None),
    "entity_1to1": (entity_1to1, ONE_TO_ONE_SQL),
    "jaccard": (jaccard, JACCARD_SQL),
    "entity_quality": (entity_quality, QUALITY_SQL),
    "micro_prf": (micro_prf, f"WITH {UNKNOWN_CTE}, {prf_sql(SET_COUNTS)} {PRF_SHOWN}"),
    "micro_prf_span": (lambda s, f: micro_prf(s, f, "span"), f"WITH {UNKNOWN_CTE}, {prf_sql(SPAN_COUNTS)} {PRF_SHOWN}"),
    "runs_summary": (runs_summary, RUNS_SQL),
    "label_space": (label_space, f"WITH {LABELLED_CTE} SELECT label, label_id FROM space"),
    "multi_hot": (multi_hot, HOT_SQL),
    "multilabel_metrics": (multilabel_metrics, MULTILABEL_SQL),
    "score_predictions": (score_predictions, SCORE_SQL),
    "mrr": (mrr, MRR_SQL),
    "centroid_labels": (centroid_labels, CENTROID_SQL),
    "multilabel_classifier": (multilabel_classifier, None),
}
