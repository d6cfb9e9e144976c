import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.operators import fidelity as L


def by_hand(rows, add=1.0):
    """Tokens and perplexity of each key; rows of one key count together."""
    pairs = [(k, list(zip([L.START, *(t or "").lower().split()], (t or "").lower().split()))) for k, t in rows]
    every = Counter(p for _, ps in pairs for p in ps)
    contexts, v = Counter(), len({b for _, b in every})
    for (a, _), n in every.items():
        contexts[a] += n
    tokens, logs = Counter(), Counter()
    for k, ps in pairs:
        tokens[k] += len(ps)
        logs[k] += sum(math.log((every[p] + add) / (contexts[p[0]] + add * v)) for p in ps)
    return {k: (n, pytest.approx(math.exp(-logs[k] / n))) for k, n in tokens.items() if n}


@pytest.mark.parametrize("marked", [False, True])
def test_texts_are_their_own_corpus_in_blocks(spark, monkeypatch, marked):
    """Many blocks and shards; null and repeated keys, texts without words, odd spaces, the start mark as a word."""
    monkeypatch.setattr(L, "BLOCK_BYTES", 200)
    monkeypatch.setattr(L, "cut_lineage", lambda *_: pytest.fail("a table with a row per bigram was written"))
    rng = random.Random(5)
    words = ["a", "B", "b", "é", "中", "of", "the", *(f"w{i}" for i in range(30)), *(["<s>"] if marked else [])]
    text = lambda: rng.choice(["", " ", " "]) + "".join(rng.choice(words) + rng.choice([" ", " ", "\x1c ", "\n\n"]) for _ in range(rng.randrange(40)))
    rows = [(i, text()) for i in range(60)] + [(3, "the b"), (None, "a b"), (None, "b <s>" if marked else "b b"), (90, None), (91, ""), (92, " 　")]
    df = spark.createDataFrame(rows, "id long, t string").repartition(3)
    for add in (1.0, 0.5):
        got = [tuple(r) for r in L.ngram_perplexity(df, "id", "t", add=add).collect()]
        want = by_hand(rows, add)
        assert len(got) == len(want) and {k: (n, p) for k, n, p in got} == want
    named = df.withColumn("id", F.concat(F.lit("k"), "id"))
    assert {r.id for r in L.ngram_perplexity(named, "id", "t").collect()} == {k if k is None else f"k{k}" for k in want}
    assert L.ngram_perplexity(df.where("id >= 90"), "id", "t").collect() == []


def test_a_bigram_costs_a_few_bytes():
    """What a block sends to the shards is packed: not a row with a key and two words for each bigram of each text."""
    rng = random.Random(6)
    texts = [" ".join(f"someword{rng.randrange(3000)}" for _ in range(300)) for _ in range(200)]
    batch = pa.RecordBatch.from_pydict({"id": list(range(200)), "__text": texts})
    blocks = list(L._blocks([batch, batch]))
    assert sum(b.num_rows for b in blocks) == 1 and len(L._unpacked(blocks[0]["texts"][0].as_py())) == 400
    sent = [r for b in L._asked(3)(blocks) for r in b.to_pylist()]
    assert len(sent) == 6
    keys = sum(len(L._unpack_keys(r["keys"])) for r in sent)
    distinct = {p for t in texts for p in zip([L.START, *t.split()], t.split())}
    assert keys == len(distinct) + 3001
    assert sum(len(r[c]) for r in sent for c in ("keys", "checks", "counts")) < 12 * keys


def test_keys_that_agree_are_told_apart_by_their_checks():
    import numpy as np

    packed = lambda kind, *keys: L._pack_keys(np.array(keys, kind))
    checks = lambda *x: np.array(x, "<u2").tobytes()
    rows = [(1, 1, 0, packed("u8", 5, 5, 9), checks(1, 2, 3), L._pack_counts(np.array([10, 20, 300])), False),
            (2, 1, 0, packed("u8", 5, 2**64 - 1), checks(2, 0), L._pack_counts(np.array([5, 70000])), False)]
    names = ["block", "kind", "shard", "keys", "checks", "counts", "marked"]
    got = L._answered(pa.table([pa.array(c) for c in zip(*rows)], names=names))
    assert [L._unpack_counts(c).tolist() for c in got["counts"].to_pylist()] == [[10, 25, 300], [25, 70000]]
    assert got["distinct"].to_pylist() == [4, 4] and got["marked"].to_pylist() == [False, False]


def test_blocks_without_answers():
    """Texts without words need none; with words they are another run's blocks, and nothing may be left out silently."""
    none = pa.table({n: pa.array([], t) for n, t in (("kind", pa.int32()), ("shard", pa.int32()), ("counts", pa.binary()), ("vocabulary", pa.int64()))})
    block = lambda *t: pa.Table.from_batches(list(L._blocks([pa.RecordBatch.from_pydict({"id": list(range(len(t))), "__text": pa.array(t, pa.string())})])))
    assert L._scored("id", 1.0)(block("", " ", None), none).num_rows == 0
    with pytest.raises(RuntimeError, match="again"):
        L._scored("id", 1.0)(block("", "a"), none)
    assert block("a b")["block"] != block("a c")["block"]
