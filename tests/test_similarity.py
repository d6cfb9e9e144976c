"""Similarity summaries against plain loops: blocked products and exact quantiles."""

import math
import random

import pytest

from spanloom.operators import similarity as S


def cos(a, b):
    la, lb = math.sqrt(sum(x * x for x in a)), math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b)) / (la * lb) if la and lb else 0.0


def vectors(n, seed=1):
    pick = random.Random(seed)
    rows = [(f"n{i:03}", f"c{i % 7}", [pick.gauss(0, 1) for _ in range(5)]) for i in range(n)]
    return rows + [("zero", "c1", [0.0] * 5), ("alone", "only", [1.0, 0.0, 0.0, 0.0, 0.0]), ("copy", "c2", rows[0][2]), ("unnamed", None, [1.0] * 5)]


@pytest.mark.parametrize("block_rows,bins", [(None, 4096), (20, 64), (20, 3)])
def test_quantiles_are_exact(spark, monkeypatch, block_rows, bins):
    monkeypatch.setattr(S, "PIECE_CELLS", 100)
    rows = vectors(60)
    df = spark.createDataFrame(rows, "id string, category string, embedding array<double>")
    sims = sorted(s for i, a in enumerate(rows) for b in rows[:i] if (s := round(cos(a[2], b[2]), 9)) != 0)
    wanted = [0.0, 0.01, 0.333, 0.5, 0.9, 1.0]
    got = {r["quantile"]: r.sim for r in S.pair_similarity_quantiles(df, wanted, bins=bins, block_rows=block_rows).collect()}
    for q in wanted:
        at = q * (len(sims) - 1)
        low, high = sims[math.floor(at)], sims[math.ceil(at)]
        assert got[q] == pytest.approx(low + (high - low) * (at - math.floor(at)), abs=1e-9)


def test_quantiles_without_pairs(spark):
    df = spark.createDataFrame([("a", [1.0]), ("z", [0.0])], "id string, embedding array<double>")
    assert [r.sim for r in S.pair_similarity_quantiles(df, [0.5]).collect()] == [None]
    assert [r.sim for r in S.pair_similarity_quantiles(df.where("id > 'zz'"), [0.5]).collect()] == [None]


@pytest.mark.parametrize("block_rows", [None, 3])
def test_affinity_in_blocks(spark, monkeypatch, block_rows):
    monkeypatch.setattr(S, "PIECE_CELLS", 5)
    rows = vectors(50, 2)
    df = spark.createDataFrame(rows, "name string, category string, embedding array<double>")
    groups = {}
    for name, category, v in rows:
        groups.setdefault(category, []).append((name, v))
    means = {}
    for a, left in groups.items():
        for b, right in groups.items():
            found = [cos(x, y) for n, x in left for m, y in right if n != m]
            means[a, b] = sum(found) / len(found) if found else 0.0
    got = S.category_affinity(df, temperature=0.05, block_rows=block_rows).collect()
    assert len(got) == len(means)
    for r in got:
        row = [math.exp(means[r.category, o] / 0.05) for o in groups]
        assert r.mean_sim == pytest.approx(means[r.category, r.other], abs=1e-9)
        assert r.p == pytest.approx(math.exp(means[r.category, r.other] / 0.05) / sum(row), abs=1e-9)
    assert S.category_affinity(df.where("name = 'none'")).collect() == []
