import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import classify as Z
from spanloom.operators import fidelity as L
from spanloom.operators import metrics as M

ROWS = [
    (1, ["a", "b"], ["b", "c"]), (2, ["a"], []), (3, ["LABEL NOT PRESENT"], ["a"]), (4, ["UNDERSPECIFIED", "c"], ["a", "c"]),
    (5, [], []), (6, ["UNK", "d"], ["e", "e", "d"]),
]


def preds(spark):
    return spark.createDataFrame(ROWS, "record_id long, gold array<string>, predicted array<string>")


def by_hand(rows):
    pairs = []
    for _, gold, pred in rows:
        for g in gold:
            if g not in ("LABEL NOT PRESENT", "UNDERSPECIFIED"):
                pairs.append((g, g if g in pred else pred[0] if pred else "LABEL NOT PRESENT"))
    classes = sorted({x for p in pairs for x in p})
    tp = {c: sum(g == p == c for g, p in pairs) for c in classes}
    fp = {c: sum(p == c != g for g, p in pairs) for c in classes}
    fn = {c: sum(g == c != p for g, p in pairs) for c in classes}
    part = lambda a, b: a / b if b else 0.0
    pm = sum(part(tp[c], tp[c] + fp[c]) for c in classes) / len(classes)
    rm = sum(part(tp[c], tp[c] + fn[c]) for c in classes) / len(classes)
    return sum(g == p for g, p in pairs) / len(pairs), pm, rm


def test_one_to_one(spark):
    got = M.entity_one_to_one(preds(spark)).first()
    acc, pm, rm = by_hand(ROWS)
    assert got.accuracy == pytest.approx(acc) == got.precision_micro == got.recall_micro == got.f1_micro
    assert got.precision_macro == pytest.approx(pm) and got.recall_macro == pytest.approx(rm)
    assert got.f1_macro == pytest.approx(2 * pm * rm / (pm + rm))
    none = M.entity_one_to_one(preds(spark).where("record_id = 2")).first()
    assert none.accuracy == 0 and none.f1_macro == 0


def test_jaccard_and_quality(spark):
    got = M.entity_many_to_many(preds(spark)).first().jaccard_accuracy
    assert got == pytest.approx((1 / 3 + 0 + 0 + 1 / 3 + 1 + 1 / 3) / 6)
    both = M.entity_quality(preds(spark)).first()
    assert both.jaccard_accuracy == pytest.approx(got) and both.accuracy == pytest.approx(by_hand(ROWS)[0])


def test_micro_scores(spark):
    s = M.micro_scores(preds(spark)).first()
    assert (s.tp, s.fp, s.fn) == (3, 4, 4)
    sp = M.micro_scores(preds(spark), unit="span").first()
    assert (sp.tp, sp.fp, sp.fn) == (3, 5, 4)
    empty = M.micro_scores(preds(spark).where("record_id = 5")).first()
    assert (empty.precision, empty.recall, empty.f1) == (0, 0, 0)
    with pytest.raises(ValueError):
        M.micro_scores(preds(spark), unit="word")
    runs = preds(spark).withColumn("run_id", F.col("record_id") % 2)
    summary = M.summarise_runs(M.micro_scores(runs, by=["run_id"])).first()
    assert summary.runs == 2 and 0 <= summary.f1_mean <= 1


def test_poisson_bootstrap(spark):
    import math

    df = spark.range(4000).select(F.col("id").alias("record_id"))
    runs = M.poisson_runs(df, "record_id", 5)
    again = M.poisson_runs(df.repartition(7), "record_id", 5)
    assert sorted(map(tuple, runs.collect())) == sorted(map(tuple, again.collect()))
    counts = {r.weight: r["n"] for r in runs.groupBy("weight").agg(F.count("*").alias("n")).collect()}
    for k in (1, 2, 3):
        assert counts[k] == pytest.approx(20_000 * math.exp(-1) / math.factorial(k), rel=0.08)
    assert 20_000 - sum(counts.values()) == pytest.approx(20_000 * math.exp(-1), rel=0.08)
    weighted = M.poisson_runs(preds(spark), "record_id", 3)
    copies = weighted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("weight"))))
    one = M.micro_scores(weighted, by=["run_id"], weight="weight").orderBy("run_id").collect()
    assert one == M.micro_scores(copies, by=["run_id"]).orderBy("run_id").collect()
    values = spark.createDataFrame([(float(i),) for i in range(101)], "f1 double")
    found = M.run_intervals(values, ["f1"], 0.9).first()
    assert (found.metric, found.low, found.high) == ("f1", pytest.approx(5.0), pytest.approx(95.0))


def test_label_space_and_multi_hot(spark):
    a = spark.createDataFrame([(1, ["b", "a"]), (2, []), (3, ["c", "c"])], "id long, labels array<string>")
    space = M.label_space(a, a.select("labels"))
    assert sorted((r.label_id, r.label) for r in space.collect()) == [(0, "a"), (1, "b"), (2, "c")]
    hot = {r.id: r.truth for r in M.multi_hot(a, space, "id").collect()}
    assert hot == {1: [1.0, 1.0, 0.0], 2: [0.0, 0.0, 0.0], 3: [0.0, 0.0, 1.0]}
    with pytest.raises(ValueError, match="z"):
        M.multi_hot(a.unionByName(spark.createDataFrame([(4, ["z"])], a.schema)), space, "id")


def test_multilabel_metrics(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-3.0, -2.0, -1.5, 0.0, 2.0]) for _ in range(4)], [float(rng.random() < 0.4) for _ in range(4)]) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, logits array<double>, truth array<double>")
    got = M.multilabel_metrics(df).first()
    flat = [(x, t) for _, l, ts in rows for x, t in zip(l, ts)]
    pos, neg = [x for x, t in flat if t], [x for x, t in flat if not t]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    cut = [[float(1 / (1 + 2.718281828459045 ** -x) >= 0.15) for x in l] for _, l, _ in rows]
    tp = sum(p * t for c, (_, _, ts) in zip(cut, rows) for p, t in zip(c, ts))
    f1 = 2 * tp / (sum(map(sum, cut)) + len(pos))
    assert got.roc_auc == pytest.approx(auc) and got.f1 == pytest.approx(f1)
    assert got.accuracy == pytest.approx(sum(c == ts for c, (_, _, ts) in zip(cut, rows)) / 80)
    same = df.withColumn("logits", F.transform("logits", lambda x: F.lit(1.0)))
    assert M.multilabel_metrics(same).first().roc_auc == 0.5
    one_class = df.withColumn("truth", F.transform("truth", lambda x: F.lit(1.0)))
    assert M.multilabel_metrics(one_class).first().roc_auc is None


def test_threshold_and_names(spark):
    df = spark.createDataFrame([(1, [-1.8, -1.7, 5.0]), (2, [-9.0, -9.0, -9.0])], "id long, l array<double>")
    hot = df.withColumn("hot", M.threshold_scores("l"))
    assert [r.hot for r in hot.orderBy("id").collect()] == [[0.0, 1.0, 1.0], [0.0, 0.0, 0.0]]
    space = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "label string, label_id long")
    assert {r.id: r.labels for r in M.labels_of(hot, space, "id", "hot").collect()} == {1: ["b", "c"], 2: []}


def test_reciprocal_rank(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "rank int")
    assert M.mean_reciprocal_rank(df).first().mrr == pytest.approx(0.5)


def test_perplexity(spark):
    import math

    texts = ["a b a b", "a", "", "b b"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    pairs = [list(zip(["<s>", *t.split()], t.split())) for t in texts]
    every = [p for ps in pairs for p in ps]
    vocabulary = len({b for _, b in every})
    p = lambda x: (every.count(x) + 1) / (sum(a == x[0] for a, _ in every) + vocabulary)
    want = {i: math.exp(-sum(math.log(p(x)) for x in ps) / len(ps)) for i, ps in enumerate(pairs) if ps}
    got = {r.id: r.perplexity for r in L.ngram_perplexity(df, "id", "t").collect()}
    assert got == {i: pytest.approx(v) for i, v in want.items()}
    other = spark.createDataFrame([(9, "a c"), (8, "zz a")], "id long, t string")
    seen = {r.id: r.perplexity for r in L.ngram_perplexity(other, "id", "t", corpus=df).collect()}
    assert seen[9] == pytest.approx(math.exp(-(math.log(p(("<s>", "a"))) + math.log(p(("a", "c")))) / 2))
    scores = L.popularity_scores(spark.createDataFrame([("n", 1.0), ("n", 3.0)], "name string, perplexity double")).first()
    assert (scores.name, scores.score) == ("n", 2.0)


def test_classifier_learns_words(spark):
    rows = [(i, "good apple pear" if i % 2 else "bad stone", [float(i % 2), float(i % 2 == 0)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, text string, truth array<double>")
    model, runs = Z.train_best(df, df, "text", "truth", 2, regs=(0.1,), iterations=10)
    assert runs[0]["f1"] == 1.0 and runs[0]["roc_auc"] == 1.0
    scored = model.logits(df).select("id", M.threshold_scores("logits", 0.5).alias("p")).collect()
    assert all(r.p == [float(r.id % 2), float(r.id % 2 == 0)] for r in scored)
    single = Z.train(df, "text", "truth", 2, iterations=5)
    assert len(single.models) == 2


def numpy_fit(texts, truths, n_labels, reg, iterations, features):
    """The classifier's objective on dense matrices, by plain gradient steps to the end."""
    import numpy as np

    counts = np.array([np.bincount(t, minlength=features) for t in texts], float)
    idf = np.log((len(texts) + 1) / ((counts > 0).sum(axis=0) + 1))
    x = counts * idf
    length = np.sqrt((x**2).sum(axis=1, keepdims=True))
    x = np.divide(x, length, out=np.zeros_like(x), where=length > 0)
    y = np.zeros((len(texts), n_labels))
    for i, ids in enumerate(truths):
        y[i, ids] = 1
    scale = reg * x.var(axis=0)[:, None]
    odds = np.clip(y.sum(axis=0), 0.5, len(texts) - 0.5) / len(texts)
    w, b = np.zeros((features, n_labels)), np.log(odds / (1 - odds))
    for _ in range(iterations):
        errors = (1 / (1 + np.exp(-(x @ w + b))) - y) / len(texts)
        w, b = w - 2 * (x.T @ errors + scale * w), b - 2 * errors.sum(axis=0)
    return x @ w + b


@pytest.mark.parametrize("n_labels,dense,tasks", [(3, 16, 1), (3, 0, 6), (30, 0, 1), (1000, 16, 1)])
def test_labels_fitted_together_equal_numpy(spark, monkeypatch, n_labels, dense, tasks):
    """Dense and sparse products, one task or a tree of several, few labels and many."""
    import numpy as np

    monkeypatch.setattr(Z, "BLOCK_ENTRIES", 40)
    monkeypatch.setattr(Z, "TASK_PRODUCTS", 360 // tasks * n_labels)
    monkeypatch.setattr(Z, "SLAB_CELLS", 65 * 300)
    monkeypatch.setattr(Z, "FAN_IN", 3)
    monkeypatch.setattr(Z, "DENSE", dense)
    rng = random.Random(n_labels)
    words = [f"word{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(12))), sorted(rng.sample(range(n_labels), rng.randrange(3)))) for i in range(60)]
    rows += [(60, None, [0]), (61, "", None), (62, "word1 word1", [1, 1])]
    df = spark.createDataFrame(rows, "id long, text string, ids array<int>")
    jobs, steps = [], 60
    step = Z._Rows.gradient
    monkeypatch.setattr(Z._Rows, "gradient", lambda *a: jobs.append(1) or step(*a))
    model = Z.train(df, "text", "ids", n_labels, reg=0.5, iterations=steps, features=64)
    assert len(jobs) <= steps  # however many labels
    logits = {r.id: r.logits for r in model.logits(df.select("id", "text")).collect()}
    slots = [r.s for r in df.orderBy("id").select(Z.token_slots("text", 64).alias("s")).collect()]
    truths = [sorted(set(t or [])) for _, _, t in rows]
    want = numpy_fit(slots, truths, n_labels, 0.5, 6000, 64)
    got = np.array([logits[i] for i in range(63)])
    held = sorted({j for t in truths for j in t})  # the log odds of a label that no row has fall for ever
    assert np.abs(got - want)[:, held].max() < 0.05
    at = 0.3
    ids = {r.id: r.ids for r in model.label_ids(df, threshold=at).select("id", "ids").collect()}
    assert ids == {i: np.flatnonzero(1 / (1 + np.exp(-got[i])) >= at).tolist() for i in range(63)}


def test_vectors_and_numbers_give_the_same_model(spark):
    import numpy as np

    rows = [(i, f"w{i % 7} w{i % 3} x", [float(i % 2), float(i % 3 == 0)], [j for j in (0, 1) if (i % 2, i % 3 == 0)[j]]) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, text string, hot array<double>, ids array<long>")
    a, b = (Z.train(df, "text", t, 2, iterations=15, features=128) for t in ("hot", "ids"))
    assert np.allclose(a.weights, b.weights, atol=1e-9)
    with pytest.raises(ValueError, match="outside"):
        Z.train(df, "text", "hot", 1, features=128)
    with pytest.raises(ValueError, match="weights"):
        Z.train(df, "text", "ids", 1 << 12, features=1 << 14)
    with pytest.raises(ValueError, match="no rows"):
        Z.train(df.where("id < 0"), "text", "ids", 2, features=128)


def test_sparse_metrics_equal_dense_ones(spark):
    rng = random.Random(8)
    absent, n = -6.0, 30
    rows = []
    for i in range(70):
        scored = {j: rng.choice([-6.0, -3.0, -1.0, 0.5, 2.0]) for j in rng.sample(range(n), rng.randrange(6))}
        ids = rng.sample(range(n), rng.randrange(4))
        rows.append((i, [(j, x) for j, x in scored.items()], ids, [scored.get(j, absent) for j in range(n)], [float(j in ids) for j in range(n)]))
    rows.append((70, None, None, [absent] * n, [0.0] * n))
    df = spark.createDataFrame(rows, "id long, scores array<struct<label_id:long,logit:double>>, ids array<long>, logits array<double>, truth array<double>")
    sparse, dense = M.sparse_metrics(df, n, absent=absent).first(), M.multilabel_metrics(df).first()
    assert tuple(sparse) == pytest.approx(tuple(dense))
    with pytest.raises(ValueError, match="absent"):
        M.sparse_metrics(df, n, absent=0.0)
    assert M.sparse_metrics(df.where("id < 0"), n).first().roc_auc is None


def test_centroids(spark):
    df = spark.createDataFrame([(1, ["a"], [1.0, 0.0]), (2, ["a", "b"], [1.0, 1.0]), (3, ["b"], [0.0, 1.0])], "id long, labels array<string>, v array<double>")
    got = {(r.id, r.label): r["rank"] for r in Z.centroid_labels(df, df, "id", "labels", "v", 1).collect()}
    assert got == {(1, "a"): 1, (2, "a"): 1, (3, "b"): 1}


def test_bigrams_are_counted_in_bounded_pieces(spark, monkeypatch):
    """However many texts a batch has, a task holds the bigrams of a few; a corpus is added up before it is shuffled."""
    import pyarrow as pa

    texts = [f"a{i} b\u00a0c\x1cd b c" if i % 5 else None for i in range(50)]
    batch = pa.RecordBatch.from_pydict({"id": list(range(50)), "__text": texts})
    monkeypatch.setattr(L, "PIECE_BYTES", 64)
    got = list(L._counted("id")([batch]))
    assert len(got) == 10 and max(b.num_rows for b in got) <= 25
    rows = {(r["id"], r["w1"], r["w2"]): r["times"] for b in got for r in b.to_pylist()}
    assert rows == {(i, *p): 1 + (p == ("b", "c")) for i in range(50) if i % 5
                    for p in (("<s>", f"a{i}"), (f"a{i}", "b"), ("b", "c"), ("c", "d"), ("d", "b"))}
    monkeypatch.undo()
    together = [r for b in L._counted_together([batch]) for r in b.to_pylist()]
    assert {(r["w1"], r["w2"]): r["times"] for r in together}["b", "c"] == 80


def test_steps_are_cut_by_entries_too(spark, monkeypatch):
    """Two labels make few products, but the rows of a large table still go to many tasks."""
    import numpy as np

    rows = [(i, f"w{i % 7} w{i % 3} x{i}", [j for j in (0, 1) if (i % 2, i % 3 == 0)[j]]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, text string, ids array<long>")
    whole = Z.train(df, "text", "ids", 2, iterations=3, features=64)
    monkeypatch.setattr(Z, "TASK_ENTRIES", 40)
    held = Z._Rows(df, "text", "ids", 2, 64, 2, [F.lit(True)])
    assert held.tasks == 5 and held.blocks.select("part").distinct().count() == 5
    assert np.allclose(Z.train(df, "text", "ids", 2, iterations=3, features=64).weights, whole.weights, atol=1e-9)


def test_larger_tables_make_longer_tasks_not_more_gradients(spark, monkeypatch):
    """Every task of a step shuffles a whole gradient: their number follows the cores, not the rows."""
    import numpy as np

    cores = spark.sparkContext.defaultParallelism
    rows = [(i, f"w{i % 7} w{i % 3} x{i}", [j for j in (0, 1) if (i % 2, i % 3 == 0)[j]]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, text string, ids array<long>")
    whole = Z.train(df, "text", "ids", 2, iterations=3, features=64)
    for products, tasks in ((2, Z.TASKS_PER_CORE * cores), (360 // (cores + 1), 2 * cores)):
        monkeypatch.setattr(Z, "TASK_PRODUCTS", products)
        held = Z._Rows(df, "text", "ids", 2, 64, 2, [F.lit(True)])
        assert held.tasks == tasks
        assert np.allclose(Z.train(df, "text", "ids", 2, iterations=3, features=64).weights, whole.weights, atol=1e-9)


def test_slots_stand_for_their_texts(spark):
    """Rows that are fitted and predicted are tokenised once."""
    import numpy as np

    rows = [(i, f"w{i % 7} w{i % 3} x" if i else None, [j for j in (0, 1) if (i % 2, i % 3 == 0)[j]]) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, text string, ids array<long>")
    slots = df.select("id", Z.token_slots("text", 128).alias("slots"), "ids").withColumn("slots", F.when(F.col("id") > 0, F.col("slots")))
    a, b = Z.train(df, "text", "ids", 2, iterations=9, features=128), Z.train(slots, "slots", "ids", 2, iterations=9, features=128)
    assert np.allclose(a.weights, b.weights, atol=1e-9)
    found = [{r.id: r.found for r in m.label_ids(d, "found", 0.4).collect()} for m, d in ((a, df), (b, slots))]
    assert found[0] == found[1] and any(found[0].values())


def test_poisson_numbers_are_drawn_once(spark):
    """A filter on the weight must not hash each row and run a second time."""
    runs = M.poisson_runs(spark.range(3).withColumnRenamed("id", "record_id"), "record_id", 4)
    plan = runs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 1
