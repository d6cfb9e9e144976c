import math

import pytest
from pyspark.sql import functions as F

from spanloom.operators import neighbours as N


def cos(a, b):
    la, lb = math.sqrt(sum(x * x for x in a)), math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b)) / (la * lb) if la and lb else 0.0


def brute(rows, k, threshold, by_category=False):
    out = set()
    for name, cat, vec in rows:
        groups = {}
        for other, ocat, ovec in rows:
            if other != name:
                groups.setdefault(ocat if by_category else 0, []).append((-round(cos(vec, ovec), 9), other))
        for group, found in groups.items():
            for rank, (neg, other) in enumerate(sorted(found)[:k], 1):
                if threshold is None or -neg > threshold:
                    out.add((name, group, other, round(-neg, 6), rank))
    return out


def awkward_rows(table):
    rows = [(f"v{r.vec_id}", f"c{r.label}", [float(x) for x in r.embedding]) for r in table("embeddings").limit(120).collect()]
    rows += [(f"copy{i}", "c0", rows[5][2]) for i in range(60)]
    rows += [("zero", "c1", [0.0] * 64), ("lonely", "only", rows[7][2])]
    return rows


@pytest.mark.parametrize("threshold", [None, 0.1, 0.3, -0.05])
@pytest.mark.parametrize("sizes", [{}, {"broadcast_rows": 3, "block_rows": 25}])
def test_nearest_equals_brute_force(spark, table, threshold, sizes):
    rows = awkward_rows(table)
    df = spark.createDataFrame(rows, "name string, category string, embedding array<double>")
    got = N.nearest(df, 5, threshold, **sizes)
    got = {(r.anchor, 0, r.neighbour, round(r.sim, 6), r["rank"]) for r in got.collect()}
    assert got == brute(rows, 5, threshold)


@pytest.mark.parametrize("sizes", [{}, {"broadcast_rows": 3, "block_rows": 25}])
def test_nearest_per_category_equals_brute_force(spark, table, sizes):
    rows = awkward_rows(table)
    df = spark.createDataFrame(rows, "name string, category string, embedding array<double>")
    got = N.nearest_per_category(df, "category", 3, 0.05, **sizes)
    got = {(r.anchor, r.category, r.neighbour, round(r.sim, 6), r["rank"]) for r in got.collect()}
    assert got == brute(rows, 3, 0.05, by_category=True)


@pytest.mark.parametrize("sizes", [{}, {"broadcast_rows": 3, "block_rows": 25}])
def test_only_the_asked_pairs_are_searched(spark, table, sizes):
    rows = awkward_rows(table)
    df = spark.createDataFrame(rows, "name string, category string, embedding array<double>")
    asked = [(a, c) for i, (a, _, _) in enumerate(rows) for c in ("c0", "c3", "only", "unknown") if i % 3 == 0] * 2
    pairs = spark.createDataFrame(asked, "anchor string, category string")
    got = N.nearest_of_pairs(pairs, df, "category", 3, 0.05, **sizes)
    got = {(r.anchor, r.category, r.neighbour, round(r.sim, 6), r["rank"]) for r in got.collect()}
    assert got == {x for x in brute(rows, 3, 0.05, by_category=True) if (x[0], x[1]) in set(asked)}


def test_second_pass_leaves_cells_out(spark, caplog):
    """Four tight clusters: each row's best k are in its own, so the second pass meets next to nothing."""
    import logging
    import random
    import re

    pick = random.Random(1)
    rows = [(f"n{i:03}", [(1.0 if j == i % 4 else 0.0) + pick.gauss(0, 0.01) for j in range(4)]) for i in range(400)]
    df = spark.createDataFrame(rows, "name string, embedding array<double>")
    with caplog.at_level(logging.INFO, "spanloom.neighbours"):
        got = N.nearest(df, 5, broadcast_rows=1, block_rows=25).collect()
    assert {(r.anchor, 0, r.neighbour, round(r.sim, 6), r["rank"]) for r in got} == brute([(n, "", v) for n, v in rows], 5, None)
    met = {m[0]: (int(m[1]), int(m[2])) for m in re.findall(r"(\w+): (\d+) of (\d+) pairs", caplog.text)}
    assert met["other_cells"][0] + met["nearest_cells"][0] < 0.5 * met["other_cells"][1]


def test_k_larger_than_table_and_threshold_is_strict(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 0.0])], "name string, embedding array<double>")
    assert N.nearest(df, 10).count() == 6
    assert N.nearest(df, 10, 0.0).count() == 2
    assert N.nearest(df, 10, 1.0).count() == 0


@pytest.mark.parametrize("sizes", [{}, {"broadcast_rows": 3, "block_rows": 20}])
def test_reference_choice_averages_over_members(spark, table, sizes):
    rows = awkward_rows(table)[:80]
    tax = spark.createDataFrame(rows, "name string, category string, embedding array<double>")
    refs = tax.withColumnRenamed("name", "reference_id")
    combos = spark.createDataFrame([(1, ["v1", "v2", "v3"]), (2, ["v9"])], "draw_id long, members array<string>")
    got = N.nearest_references(combos, tax, refs, 4, 0.1, **sizes).collect()
    vec = {n: v for n, _, v in rows}
    for draw, members in ((1, ["v1", "v2", "v3"]), (2, ["v9"])):
        mean = sorted((-round(sum(cos(vec[m], v) for m in members) / len(members), 9), n) for n, v in vec.items())[:4]
        want = [(n, round(-s, 6)) for s, n in mean if -s > 0.1]
        assert [(r.reference_id, round(r.sim, 6)) for r in sorted(got, key=lambda r: r["rank"]) if r.draw_id == draw] == want


def test_words_to_avoid(spark):
    df = spark.createDataFrame(
        [("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [0.8, 0.3]), ("d", [0.0, 1.0])], "name string, embedding array<double>")
    combos = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "b", "c", "d"])], "draw_id long, members array<string>")
    got = {r.draw_id: r.avoid for r in N.neighbours_outside(combos, df).collect()}
    assert got == {1: ["c"], 2: []}


def test_vector_totals_ignore_order(spark, table):
    df = table("embeddings").select("label", F.col("embedding").cast("array<double>").alias("v"))
    a = {r.label: r.total for r in N.vector_totals(df.repartition(1), ["label"], "v").collect()}
    b = {r.label: r.total for r in N.vector_totals(df.repartition(17), ["label"], "v").collect()}
    for label in a:
        assert a[label] == pytest.approx(b[label])


def test_small_blocks_asked_of_a_large_table_stay_few(spark, monkeypatch):
    """Blocks of 5 rows of 400 would copy each left row 80 times; they are put together."""
    import random

    from pyspark.sql import DataFrame

    pick = random.Random(2)
    rows = [(f"n{i:03}", [pick.gauss(0, 1) for _ in range(6)]) for i in range(400)]
    df = spark.createDataFrame(rows, "name string, embedding array<double>")
    copies, blocks = [], N.Cells.blocks

    def counted(self, probes) -> DataFrame:
        found = blocks(self, probes)
        copies.append(found.count())
        return found

    monkeypatch.setattr(N.Cells, "blocks", counted)
    got = N.nearest(df, 3, 0.1, broadcast_rows=0, block_rows=5).collect()
    assert {(r.anchor, 0, r.neighbour, round(r.sim, 6), r["rank"]) for r in got} == brute([(n, "", v) for n, v in rows], 3, 0.1)
    assert copies and max(copies) <= 8 * len(rows)


def test_pieces_of_a_block_equal_one_matrix():
    """Later pieces only look at scores that reach the k-th best; ties, own rows and cells stay right."""
    import numpy as np
    import pandas as pd

    from spanloom.operators import blocks as B

    pick = np.random.default_rng(3)
    vectors = np.round(pick.normal(size=(300, 4)), 1)  # ties
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1), 1e-9)[:, None]
    ids = pick.permutation(300)
    right = pd.DataFrame({"right_group": 0, "right_id": ids, "right_value": list(vectors), "cell": pick.integers(0, 5, 300)})
    left = pd.DataFrame({"left_id": ids, "left_value": list(vectors), "met": [np.packbits(np.ones(5, bool)).tobytes()] * 300})
    for piece in (1, 7, 1000):
        B.PIECE, was = piece, B.PIECE
        try:
            for floor in (None, 0.2):
                sides = B.RightSide(right, N.stack), B.RightSide(right.drop(columns="cell"), lambda v: [N.stack(v)])
                got = pd.concat(B.search(left, sides[0], N.dot_scores, 6, floor, True))
                want = pd.concat(B.search(left.drop(columns="met"), sides[1], lambda a, b: N.stack(a) @ b[0].T, 6, floor, True))
                key = ["left_id", "rank"]
                pd.testing.assert_frame_equal(got.sort_values(key).reset_index(drop=True), want.sort_values(key).reset_index(drop=True))
        finally:
            B.PIECE = was


def test_groups_share_buckets_evenly(spark):
    """A bucket of a group search holds two blocks at most, however the groups' names hash."""
    from spanloom.operators import blocks as B

    size = {f"c{i}": 12 + i % 29 for i in range(60)} | {"large": 170}
    rows = [(g, f"{g}-{i}") for g, n in size.items() for i in range(n)]
    right = spark.createDataFrame(rows, "right_group string, right_id string")
    parts = B.group_parts(right, 40).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    got = parts.withColumn("bucket", B.part_bucket(40)).groupBy("bucket").agg(F.sum(F.col("n") / F.col("parts")).alias("rows")).collect()
    assert sum(r.rows for r in got) == pytest.approx(len(rows))
    assert max(r.rows for r in got) <= 80
