"""Scores of predictions. Each takes optional ``by`` columns (runs, splits)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.randomness import unit_random
from spanloom.functions.text import NO_LABEL_PRESENT, UNDERSPECIFIED, UNKNOWN
from spanloom.operators.ordering import sorted_positions, sorted_totals

SENTINELS = (NO_LABEL_PRESENT, UNDERSPECIFIED)
#: Cumulative chances of a Poisson number with mean 1, as far as a hash of 52 bits can tell.
POISSON_STEPS = [sum(math.exp(-1) / math.factorial(i) for i in range(n + 1)) for n in range(17)]
SCORE_THRESHOLD = 0.15  # fixed value: decision threshold on the sigmoid score


def ratio_or(numerator: Column, denominator: Column, otherwise: float = 0.0) -> Column:
    return F.when(denominator != 0, numerator / denominator).otherwise(F.lit(otherwise))


def f1(precision: Column, recall: Column) -> Column:
    return ratio_or(2 * precision * recall, precision + recall)


def entity_one_to_one(predictions: DataFrame, gold: str = "gold", predicted: str = "predicted", by=()) -> DataFrame:
    """Accuracy and micro/macro precision, recall and F1 with one prediction per gold label.

    A label counts as predicted if it is among the predictions; otherwise the
    first prediction stands for it. F1 is taken from the averaged precision and
    recall.
    """
    by = list(by)
    first = F.coalesce(F.get(predicted, F.lit(0)), F.lit(NO_LABEL_PRESENT))
    pairs = predictions.select(*by, F.explode(gold).alias("truth"), predicted).where(~F.col("truth").isin(*SENTINELS))
    guess = F.when(F.array_contains(predicted, F.col("truth")), F.col("truth")).otherwise(first)
    table = pairs.select(*by, "truth", guess.alias("guess")).groupBy(*by, "truth", "guess").agg(F.count("*").alias("n"))
    zero, n = F.lit(0).cast("bigint"), F.col("n")
    row = lambda name, tp, fp, fn: F.struct(
        F.col(name).alias("class"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    outcome = F.when(F.col("truth") == F.col("guess"), F.array(row("truth", n, zero, zero))).otherwise(
        F.array(row("truth", zero, zero, n), row("guess", zero, n, zero))
    )
    per_class = (
        table.select(*by, F.explode(outcome).alias("o")).select(*by, "o.*")
        .groupBy(*by, "class").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    )
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    averaged = per_class.groupBy(*by).agg(
        ratio_or(tp, tp + fn).alias("accuracy"),
        ratio_or(tp, tp + fp).alias("precision_micro"),
        F.avg(ratio_or(F.col("tp"), F.col("tp") + F.col("fp"))).alias("precision_macro"),
        ratio_or(tp, tp + fn).alias("recall_micro"),
        F.avg(ratio_or(F.col("tp"), F.col("tp") + F.col("fn"))).alias("recall_macro"),
    )
    return averaged.select(
        "*",
        f1(F.col("precision_micro"), F.col("recall_micro")).alias("f1_micro"),
        f1(F.col("precision_macro"), F.col("recall_macro")).alias("f1_macro"),
    )


def jaccard(gold, predicted) -> Column:
    """Overlap of two label sets; two empty sets agree fully."""
    union = F.size(F.array_union(gold, predicted))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(gold, predicted)) / union)


def entity_many_to_many(predictions: DataFrame, gold: str = "gold", predicted: str = "predicted", by=()) -> DataFrame:
    return predictions.groupBy(*by).agg(F.avg(jaccard(gold, predicted)).alias("jaccard_accuracy"))


def entity_quality(predictions: DataFrame, gold: str = "gold", predicted: str = "predicted", by=()) -> DataFrame:
    """Both entity scores side by side, one row per ``by`` group (or one row)."""
    by = list(by)
    one = entity_one_to_one(predictions, gold, predicted, by)
    many = entity_many_to_many(predictions, gold, predicted, by)
    return one.join(many, by) if by else one.select("*", many.scalar().alias("jaccard_accuracy"))


def record_counts(predictions: DataFrame, gold: str = "gold", predicted: str = "predicted", unit: str = "set") -> DataFrame:
    """Add tp, fp, fn of each record; a gold ``UNK`` is never missed.

    ``unit='set'`` counts each predicted entity once per record,
    ``unit='span'`` once per span that was matched to it.
    """
    if unit not in ("set", "span"):
        raise ValueError("unit must be 'set' or 'span'")
    g, p = F.col(gold), F.col(predicted)
    known = F.array_remove(g, UNKNOWN)
    if unit == "set":
        tp, fp, fn = F.size(F.array_intersect(p, g)), F.size(F.array_except(p, g)), F.size(F.array_except(known, p))
    else:
        tp = F.size(F.filter(p, lambda x: F.array_contains(g, x)))
        fp = F.size(p) - tp
        fn = F.size(F.filter(known, lambda x: ~F.array_contains(p, x)))
    return predictions.withColumns({"tp": tp, "fp": fp, "fn": fn})


def total_scores(counts: DataFrame, by=(), weight: str | None = None) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 over all rows; with ``weight`` a row counts that often."""
    times = F.lit(1) if weight is None else F.col(weight)
    summed = counts.groupBy(*by).agg(*[F.coalesce(F.sum(F.col(c) * times), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])
    scored = summed.select(
        "*", ratio_or(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        ratio_or(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
    )
    return scored.select("*", f1(F.col("precision"), F.col("recall")).alias("f1"))


def micro_scores(predictions: DataFrame, gold: str = "gold", predicted: str = "predicted", unit: str = "set",
                 by=(), weight: str | None = None) -> DataFrame:
    """:func:`total_scores` of :func:`record_counts`."""
    return total_scores(record_counts(predictions, gold, predicted, unit), by, weight)


def resample_runs(df: DataFrame, key: str, runs: int, share: float, seed=42, run: str = "run_id") -> DataFrame:
    """Each row in a hash-random ``share`` of ``runs`` runs, numbered from 0."""
    numbered = df.drop(run).withColumn(run, F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    return numbered.where(unit_random(seed, F.lit("run"), F.col(run), F.col(key)) < share)


def poisson_runs(df: DataFrame, key: str, runs: int, seed=42, run: str = "run_id", weight: str = "weight") -> DataFrame:
    """Bootstrap without a draw: each row counts Poisson(1) times in each of ``runs`` runs, numbered from 0.

    The count is the inverse CDF at the hash of (seed, run, key), so a retried
    task gives it again; rows that count 0 times are left out.
    """
    def drawn(number: Column) -> Column:
        # the number is bound to a name first, so that it is hashed once for all steps
        u = F.array(unit_random(seed, F.lit("poisson"), number, F.col(key)))
        return F.struct(number.alias(run), F.transform(u, _poisson_number)[0].alias(weight))

    # drawn before the rows are written out for each run: a filter on the weight would draw it again
    given = df.drop(run)
    numbered = given.withColumn("__drawn", F.explode_outer(F.transform(F.sequence(F.lit(0), F.lit(runs - 1)), drawn)))
    return numbered.select(*given.columns, f"__drawn.{run}", f"__drawn.{weight}").where(F.col(weight) > 0)


def _poisson_number(x: Column) -> Column:
    """Number of steps that are not above x, lowest first."""
    number = F.when(x < POISSON_STEPS[0], 0)
    for n, edge in enumerate(POISSON_STEPS[1:], 1):
        number = number.when(x < edge, n)
    return number.otherwise(len(POISSON_STEPS))


def run_intervals(per_run: DataFrame, metrics=("precision", "recall", "f1"), level: float = 0.95) -> DataFrame:
    """(metric, low, high): the middle ``level`` of each metric over the runs, in proportion between runs."""
    tails = [(1 - level) / 2, (1 + level) / 2]
    found = per_run.agg(*[F.percentile(m, F.array(*map(F.lit, tails))).alias(m) for m in metrics])
    entries = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m)[0].alias("low"), F.col(m)[1].alias("high")) for m in metrics])
    return found.select(F.explode(entries).alias("e")).select("e.*")


def summarise_runs(per_run: DataFrame, metrics=("precision", "recall", "f1")) -> DataFrame:
    """Mean and sample deviation of each metric over the runs."""
    return per_run.agg(
        F.count("*").alias("runs"),
        *[f(m).alias(f"{m}_{n}") for m in metrics for f, n in ((F.avg, "mean"), (F.stddev_samp, "std"))],
    )


def label_space(*tables: DataFrame, labels: str = "labels") -> DataFrame:
    """(label, label_id): distinct labels of all tables, numbered in sorted order from 0."""
    both = None
    for t in tables:
        part = t.select(F.explode(labels).alias("label"))
        both = part if both is None else both.unionByName(part)
    return sorted_positions(both.where("label is not null").distinct(), ["label"], "label_id")


def unknown_labels(df: DataFrame, space: DataFrame, labels: str = "labels") -> DataFrame:
    found = df.select(F.explode(labels).alias("label")).distinct()
    return found.join(space, "label", "left_anti")


def label_ids(df: DataFrame, space: DataFrame, key: str, labels: str = "labels", output: str = "ids") -> DataFrame:
    """(key, output): sorted numbers of a row's own labels; an unknown label is an error."""
    bad = unknown_labels(df, space, labels).limit(5).collect()
    if bad:
        raise ValueError(f"labels outside the label space: {[r['label'] for r in bad]}")
    return (
        df.select(key, F.explode_outer(labels).alias("label")).join(space, "label", "left")
        .groupBy(key).agg(F.array_sort(F.collect_set("label_id")).alias(output))
    )


def multi_hot(df: DataFrame, space: DataFrame, key: str, labels: str = "labels", output: str = "truth") -> DataFrame:
    """(key, output): 0/1 vector over the label space, spread from :func:`label_ids` row by row.

    For large label spaces keep the numbers: :func:`sparse_metrics` and the classifier take them as they are.
    """
    size = space.count()
    vector = F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.array_contains("ids", i.cast("bigint")).cast("double")
    ) if size else F.array().cast("array<double>")
    return label_ids(df, space, key, labels).select(key, vector.alias(output))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def threshold_scores(logits, threshold: float = SCORE_THRESHOLD) -> Column:
    """0/1 decision per logit: sigmoid at least the threshold."""
    return F.transform(logits, lambda x: F.when(sigmoid(x) >= threshold, 1.0).otherwise(0.0))


def named_ids(df: DataFrame, space: DataFrame, key: str, ids: str, output: str = "labels") -> DataFrame:
    """(key, labels): names of label numbers, in id order; none gives an empty list."""
    named = df.select(key, F.explode_outer(ids).alias("label_id")).join(space, "label_id", "left")
    entry = F.when(F.col("label").isNotNull(), F.struct("label_id", "label"))
    listed = named.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("l"))
    return listed.select(key, F.transform("l", lambda e: e["label"]).alias(output))


def labels_of(df: DataFrame, space: DataFrame, key: str, vector: str, output: str = "labels") -> DataFrame:
    """(key, labels): names of the entries that are 1, in id order; none gives an empty list."""
    ids = F.filter(F.transform(vector, lambda v, i: F.when(v == 1.0, i.cast("bigint"))), lambda i: i.isNotNull())
    return named_ids(df.select(key, ids.alias("__ids")), space, key, "__ids", output)


def area_under_curve(scored: DataFrame, score: str = "score", truth: str = "truth") -> DataFrame:
    """One row ``roc_auc``: chance that a positive outranks a negative, ties count half.

    Rows are first merged per distinct score, so the running count works on
    distinct scores only.
    """
    return curve_of(scored.groupBy(score).agg(
        F.sum(F.col(truth).cast("bigint")).alias("pos"), F.sum(1 - F.col(truth).cast("bigint")).alias("neg")
    ), score)


def curve_of(merged: DataFrame, score: str = "score") -> DataFrame:
    """:func:`area_under_curve` of distinct scores with the numbers ``pos`` and ``neg`` of rows that have them."""
    placed = sorted_totals(merged, [score], {"neg_below": F.col("neg")})
    wins = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0))
    all_pairs = F.sum("pos").cast("double") * F.sum("neg")
    return placed.agg(F.when(all_pairs > 0, wins / all_pairs).alias("roc_auc"))


def multilabel_metrics(df: DataFrame, logits: str = "logits", truth: str = "truth",
                       threshold: float = SCORE_THRESHOLD) -> DataFrame:
    """One row: micro F1, micro ROC-AUC and share of rows with exactly the right labels."""
    decided = df.withColumn("__p", threshold_scores(logits, threshold))
    both = F.zip_with("__p", truth, lambda p, t: p * t)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    sums = decided.agg(
        F.sum(total(both)).alias("tp"), F.sum(total("__p")).alias("predicted"), F.sum(total(truth)).alias("gold"),
        F.avg((F.col("__p") == F.col(truth)).cast("double")).alias("accuracy"),
    )
    pairs = df.select(F.explode(F.arrays_zip(F.col(logits).alias("l"), F.col(truth).alias("t"))).alias("e")).select(
        sigmoid(F.col("e.l")).alias("score"), F.col("e.t").alias("truth"))
    auc = area_under_curve(pairs)
    micro = ratio_or(2 * F.col("tp"), F.col("predicted") + F.col("gold"))
    return sums.select(micro.alias("f1"), auc.scalar().alias("roc_auc"), "accuracy")


def sparse_metrics(df: DataFrame, n_labels: int, scores: str = "scores", truth: str = "ids", absent: float = -1e9,
                   threshold: float = SCORE_THRESHOLD) -> DataFrame:
    """:func:`multilabel_metrics` over sparse rows: ``scores`` as array of (label_id, logit), ``truth`` as label numbers.

    A label that a row doesn't score has the logit ``absent``. Such entries are
    counted, not written out: they are one score of the curve with a
    multiplicity, so the rows that move follow the entries present.
    """
    if 1 / (1 + math.exp(min(700.0, -absent))) >= threshold:
        raise ValueError("absent labels would be predicted")
    given = F.coalesce(F.col(scores), F.array().cast(df.schema[scores].dataType))
    gold = F.coalesce(F.array_distinct(truth), F.array().cast("array<bigint>"))
    rows = df.select(given.alias("s"), gold.alias("g"))
    chosen = F.transform(F.filter("s", lambda e: sigmoid(e["logit"]) >= threshold), lambda e: e["label_id"])
    right = F.size(F.array_intersect(chosen, "g"))
    on = F.size(F.array_intersect(F.transform("s", lambda e: e["label_id"]), "g"))
    sums = rows.agg(
        F.sum(right).alias("tp"), F.sum(F.size(chosen)).alias("predicted"), F.sum(F.size("g")).alias("gold"),
        F.avg(((right == F.size(chosen)) & (right == F.size("g"))).cast("double")).alias("accuracy"),
        F.sum(F.size("s")).alias("present"), F.sum(on).alias("on"), F.count("*").alias("n"))
    present = rows.select("g", F.explode("s").alias("e")).select(
        sigmoid(F.col("e.logit")).alias("score"), F.array_contains("g", F.col("e.label_id")).cast("bigint").alias("t"))
    merged = present.groupBy("score").agg(F.sum("t").alias("pos"), F.sum(1 - F.col("t")).alias("neg"))
    missing = F.col("n") * n_labels - F.col("present")
    implicit = sums.select(sigmoid(F.lit(float(absent))).alias("score"), (F.col("gold") - F.col("on")).alias("pos"),
                           (missing - F.col("gold") + F.col("on")).alias("neg")).where("pos + neg > 0")
    merged = merged.unionByName(implicit).groupBy("score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    micro = ratio_or(2 * F.col("tp"), F.col("predicted") + F.col("gold"))
    return sums.select(micro.alias("f1"), curve_of(merged).scalar().alias("roc_auc"), "accuracy")


def mean_reciprocal_rank(ranks: DataFrame, rank: str = "rank", by=()) -> DataFrame:
    """Mean of 1 / rank; a gold entry that was not ranked (null) counts 0."""
    return ranks.groupBy(*by).agg(F.avg(F.coalesce(1.0 / F.col(rank), F.lit(0.0))).alias("mrr"))
