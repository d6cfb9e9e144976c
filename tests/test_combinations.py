import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spanloom.functions import randomness as R
from spanloom.operators import combinations as C
from spanloom.operators import neighbours as N
from spanloom.operators import ordering as O
from spanloom.operators import similarity as S
from spanloom.operators import splits as P

SIZES = [1, 1, 1, 1, 1]


@pytest.fixture(scope="module")
def tax(spark, table):
    return table("embeddings").select(
        F.concat(F.lit("v"), "vec_id").alias("name"), F.col("label").cast("string").alias("category"), "embedding").cache()


@pytest.fixture(scope="module")
def scores(tax):
    return tax.select("name", (F.length("name") * 3.0).alias("score"))


def test_uniform_numbers_do_not_depend_on_partitions(spark):
    df = spark.range(5000).withColumn("u", R.unit_random(1, F.col("id")))
    a = {r.id: r.u for r in df.repartition(1).collect()}
    b = {r.id: r.u for r in df.repartition(17).collect()}
    assert a == b and all(0 <= u < 1 for u in a.values())
    assert abs(sum(a.values()) / len(a) - 0.5) < 0.02 and len(set(a.values())) == 5000


def test_softmax_is_shifted():
    assert R.softmax([1e6, 1e6]) == [0.5, 0.5]
    assert sum(R.softmax([-1e5, 0, 3], 0.5)) == pytest.approx(1)


def test_softmax_column_has_no_underflow(spark):
    df = spark.createDataFrame([("a", -90000.0), ("a", -90001.0), ("b", 1.0)], "g string, x double")
    got = {(r.g, r.x): r.p for r in C.with_softmax(df, F.col("x"), "p", ["g"]).collect()}
    assert got["a", -90000.0] == pytest.approx(1 / (1 + math.exp(-1))) and got["b", 1.0] == 1


def test_size_weights_pass_softmax_twice(spark):
    weights = [5.0, 0.0, 0.0]
    p = R.softmax(R.softmax(weights))
    df = spark.range(20000).select(R.size_from_uniform(R.unit_random(3, F.col("id")), weights).alias("n"))
    got = Counter(r.n for r in df.collect())
    for i, share in enumerate(p, 1):
        assert abs(got[i] / 20000 - share) < 0.02


def test_balanced_rounds_hold_each_name_once(tax, scores):
    count = tax.count()
    draws = C.balanced_numbered_draws(tax, 2 * count + 7).collect()
    assert sorted(r.draw_id for r in draws) == list(range(2 * count + 7))
    for i in range(2):
        assert len({r.anchor for r in draws if r.draw_id // count == i}) == count
    first = {r.draw_id % count: r.anchor for r in draws if r.draw_id < count}
    second = {r.draw_id % count: r.anchor for r in draws if count <= r.draw_id < 2 * count}
    assert first != second


def test_balanced_draws(tax):
    assert C.balanced_draws(tax).count() == tax.count()
    some = C.balanced_draws(tax, 33).collect()
    assert len({r.anchor for r in some}) == 33 and sorted(r.draw_id for r in some) == list(range(33))
    with pytest.raises(ValueError):
        C.balanced_draws(tax, "most")


def test_stochastic_draws_follow_the_weights(spark):
    pop = spark.createDataFrame([("hot", 0.0), ("warm", 1.0), ("cold", 3.0), ("never", 9e9)], "name string, score double")
    draws = C.stochastic_draws(pop, 20000).collect()
    assert sorted(r.draw_id for r in draws) == list(range(20000))
    weights = {"hot": 1, "warm": math.exp(-1), "cold": math.exp(-3)}
    got = Counter(r.anchor for r in draws)
    for name, w in weights.items():
        assert abs(got[name] / 20000 - w / sum(weights.values())) < 0.015
    assert got["never"] == 0
    assert {(r.draw_id, r.anchor) for r in C.stochastic_draws(pop.repartition(3), 20000).collect()} == {(r.draw_id, r.anchor) for r in draws}


def test_combinations_start_with_the_anchor_and_have_no_repeats(tax, scores):
    near = N.nearest(tax, 20, 0.2)
    known = {(r.anchor, r.neighbour) for r in near.collect()}
    lists = C.neighbour_lists(near, scores)
    draws = C.balanced_numbered_draws(tax, 900)
    made = C.combine(draws, lists, SIZES).collect()
    assert len(made) == 900
    for r in made:
        assert r.members[0] == r.anchor and len(set(r.members)) == len(r.members) == r.size <= 5
        assert all((r.anchor, m) in known for m in r.members[1:])
    again = C.combine(draws.repartition(17), lists.repartition(3), SIZES).collect()
    assert {r.draw_id: r.members for r in again} == {r.draw_id: r.members for r in made}
    capped = C.combine(draws, lists, SIZES, upper_bound=1, frequency_select=False)
    assert capped.agg(F.max("size")).first()[0] == 2


def test_weighted_pick_follows_popularity(spark):
    near = spark.createDataFrame([("a", n, 0.9, i + 1) for i, n in enumerate("bcd")], "anchor string, neighbour string, sim double, rank int")
    pop = spark.createDataFrame([("b", 0.0), ("c", 1.0), ("d", 100000.0)], "name string, score double")
    draws = spark.range(20000).select(F.col("id").alias("draw_id"), F.lit("a").alias("anchor"))
    made = C.combine(draws, C.neighbour_lists(near, pop), [0, 50]).collect()
    first = Counter(r.members[1] for r in made if r.size == 2)
    share = 1 / (1 + math.exp(-1))
    assert abs(first["b"] / sum(first.values()) - share) < 0.02 and first["d"] == 0


def test_unknown_popularity_is_an_error_unless_given_a_value(spark):
    near = spark.createDataFrame([("a", "b", 0.9, 1)], "anchor string, neighbour string, sim double, rank int")
    pop = spark.createDataFrame([("a", 1.0)], "name string, score double")
    with pytest.raises(Exception, match="no popularity score for b"):
        C.neighbour_lists(near, pop).collect()
    assert C.neighbour_lists(near, pop, missing=7.0).first().near[0].score == 7.0


@pytest.mark.parametrize("weighted", [False, True])
def test_diverse_combinations(tax, scores, weighted):
    near = N.nearest_per_category(tax, "category", 5, 0.1)
    known = {(r.anchor, r.neighbour): (r.category, r["rank"]) for r in near.collect()}
    made = C.diverse_combinations(
        C.balanced_numbered_draws(tax, 600), tax, near, S.category_affinity(tax), SIZES, scores if weighted else None).collect()
    assert len(made) == 600 and max(r.size for r in made) > 3
    for r in made:
        assert r.members[0] == r.anchor and len(set(r.members)) == len(r.members)
        if not weighted:
            ranks = {}
            for m in r.members[1:]:
                ranks.setdefault(known[r.anchor, m][0], []).append(known[r.anchor, m][1])
            assert all(v == list(range(1, len(v) + 1)) for v in ranks.values())


def test_affinity_rows_sum_to_one_and_single_members_are_fine(spark):
    tax = spark.createDataFrame([("a", "x", [1.0, 0.0]), ("b", "x", [0.0, 1.0]), ("c", "y", [1.0, 1.0])], "name string, category string, embedding array<double>")
    got = {(r.category, r.other): r for r in S.category_affinity(tax).collect()}
    assert got["y", "y"].mean_sim == 0 and got["x", "x"].mean_sim == pytest.approx(0)
    assert got["x", "y"].mean_sim == pytest.approx(math.sqrt(0.5))
    assert got["x", "x"].p + got["x", "y"].p == pytest.approx(1)


def test_pair_summaries_match_all_pairs(spark):
    vectors = [("a", [1.0, 0.0]), ("a", [1.0, 1.0]), ("a", [0.0, 0.0]), ("b", [0.0, 2.0]), ("a", [1.0, 0.0])]
    df = spark.createDataFrame([(i, l, v) for i, (l, v) in enumerate(vectors)], "id long, label string, embedding array<double>")

    def cos(a, b):
        la, lb = math.hypot(*a), math.hypot(*b)
        return (a[0] * b[0] + a[1] * b[1]) / (la * lb) if la and lb else 0.0

    pairs = [cos(a[1], b[1]) for i, a in enumerate(vectors) for b in vectors[i + 1:]]
    got = S.mean_pair_similarity(df).first()
    assert got.pairs == 10 and got.mean_sim == pytest.approx(sum(pairs) / 10)
    only_a = [v for l, v in vectors if l == "a"]
    total = sum(cos(a, b) for i, a in enumerate(only_a) for b in only_a[i + 1:])
    per = {r.label: r.intra_sim for r in S.pair_similarity_by_label(df, "label").collect()}
    assert per["a"] == pytest.approx(total / 16) and per["b"] == 0
    assert {r.label: r.intra_sim for r in S.pair_similarity_by_label(df, "label", denominator="pairs").collect()}["a"] == pytest.approx(total / 6)
    for block in (2, 100):
        bins = {r.bin: r.pairs for r in S.pair_similarity_histogram(df, 4, "id", block_rows=block).collect()}
        want = Counter(min(int((p + 1) * 2), 3) for p in pairs if round(p, 9) != 0)
        assert bins == dict(want)


def test_exploded_labels_count_in_each_label(spark):
    df = spark.createDataFrame([(["a", "b"], [1.0, 0.0]), (["a"], [1.0, 0.0])], "skills array<string>, embedding array<double>")
    got = {r.label: r.intra_sim for r in S.intra_label_similarity(df, "skills").collect()}
    assert got == {"a": pytest.approx(0.25), "b": 0}


# ---- order helpers and splits ----

def test_positions_and_totals(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 3)
    placed = O.shuffled_positions(df, 5, ["id"], within=["g"], buckets=7).collect()
    for g in range(3):
        assert sorted(r.position for r in placed if r.g == g) == list(range(len([r for r in placed if r.g == g])))
    ranked = O.sorted_positions(df.select(F.concat(F.lit("k"), "id").alias("k")).repartition(5), ["k"])
    got = [r.k for r in sorted(ranked.collect(), key=lambda r: r.position)]
    assert got == sorted(got)
    sums = O.sorted_totals(df.select("id"), ["id"], {"before": F.col("id")}).collect()
    assert all(r.before == r.id * (r.id - 1) // 2 for r in sums)


def test_split_sizes_are_exact_and_disjoint(spark):
    df = spark.range(1000).select("id", F.concat(F.lit("s"), F.floor(F.col("id") / 2)).alias("s"))
    hot = df.unionByName(spark.range(700).select((F.col("id") + 5000).alias("id"), F.lit("hot").alias("s")))
    sizes = P.rest_sizes(501)
    placed = P.assign_splits(hot, "s", sizes)
    got = {r.split: r.n for r in placed.groupBy("split").agg(F.count_distinct("s").alias("n")).collect()}
    assert got == sizes and sum(sizes.values()) == 501
    assert P.overlapping_keys(placed, "s").count() == 0 and placed.count() == 1700
    assert {(r.id, r.split) for r in P.assign_splits(hot.repartition(9), "s", sizes).collect()} == {(r.id, r.split) for r in placed.collect()}
    assert P.share_sizes(8000, {"train": 0.75, "test": 0.15, "dev": 0.15}) == {"train": 5716, "test": 1142, "dev": 1142}
    whole = P.assign_splits(df, "s", {"train": 500, "test": 0})
    assert whole.select("split").distinct().collect()[0].split == "train"


def test_overlap_is_found_and_merge_keeps_rows(spark):
    df = spark.createDataFrame([("a", "train"), ("a", "test"), ("b", "test")], "s string, split string")
    assert [r.s for r in P.overlapping_keys(df, "s").collect()] == ["a"]
    pos = P.wrap_label(spark.createDataFrame([("p", "x")], "sentence string, skills string"), "skills")
    neg = P.relabel(spark.createDataFrame([("n", ["y"])], "sentence string, skills array<string>"))
    merged = P.merge_samples(pos, neg).collect()
    assert {(r.sentence, tuple(r.skills)) for r in merged} == {("p", ("x",)), ("n", ("NO LABEL",))}


def test_shuffle_scatters_copies_and_keeps_every_row(spark, monkeypatch):
    monkeypatch.setattr(O, "COPIES_PER_TASK", 7)
    df = spark.createDataFrame([("hot", ["x"])] * 60 + [(f"s{i}", ["y"]) for i in range(60)] + [(None, None)], "s string, l array<string>")
    a = [r.s for r in O.shuffle_rows(df, 1).collect()]
    assert Counter(a) == Counter(r.s for r in df.collect())
    assert a == [r.s for r in O.shuffle_rows(df.repartition(13), 1).collect()]
    assert a != [r.s for r in O.shuffle_rows(df, 2).collect()]
    places = [i for i, s in enumerate(a) if s == "hot"]
    assert max(places) - min(places) > 80
