"""Hard negatives, token counts and conversation repair against brute force, and on odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from spanloom.llm import conversation_repair as repair
from spanloom.llm import lemp, queries, token_counts

# ---- hard negatives ----


def brute_negatives(rows, anchors, positives=5, negatives=5):
    """rows: (key, label, vector) that take part."""
    codes = [[int(np.floor(float(x) * 256)) for x in v] for _, _, v in rows]
    out = []
    for i, (key, label, _) in enumerate(rows):
        if key is None or not anchors(key):
            continue
        scored = sorted((-sum(a * b for a, b in zip(codes[i], codes[j], strict=False)), r[0] is None, r[0] or 0, j)
                        for j, r in enumerate(rows) if j != i)
        for minus, _, _, p in [s for s in scored if rows[s[3]][1] == label][:positives]:
            fits = [s for s in scored if rows[s[3]][1] != label and -80 * minus <= -100 * s[0] <= -100 * minus]
            out += [(key, rows[p][0], rank, rows[s[3]][0], -minus, -s[0]) for rank, s in enumerate(fits[:negatives], 1)]
    return sorted(out, key=str)


def mined(spark, rows, anchors="key % 10 = 0"):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, label int, v array<double>, row int, key string")
    index = lemp.index_rows(df, "vec_id", "v", F.col("label"))
    return sorted((tuple(r) for r in lemp.hard_negatives(index, index.where(anchors)).collect()), key=str)


@pytest.mark.parametrize("width", [3, 16])
def test_negatives_equal_brute_force(spark, monkeypatch, width):
    monkeypatch.setattr(lemp, "SMALL_BLOCK", 64)
    monkeypatch.setattr(lemp, "BUCKET", 24)
    pick = np.random.default_rng(width)
    vectors = pick.normal(0, 1, (300, width)) * pick.lognormal(0, 1, (300, 1))
    rows = [(i, int(pick.integers(0, 4)), v.tolist()) for i, v in enumerate(vectors)]
    rows += [(300 + i, i % 2, rows[0][2]) for i in range(120)]  # many ties under two labels
    assert mined(spark, rows) == brute_negatives(rows, lambda k: k % 10 == 0)


def test_negatives_of_odd_vectors(spark):
    fine = [(0, 1, [1.0, 0.5]), (1, 1, [1.0, 0.25]), (2, 0, [0.9, 0.25]), (None, 0, [1.0, 0.0]), (4, 0, [1.0]), (4, 0, [1.0, 0.0]),
            (10, 2, [0.0, 0.0]), (11, 2, [0.0, 1.0]), (12, 0, [3e5, -2e5]), (20, 0, [-5e5, 0.0]), (13, 1, [-5e5, 1.0])]
    odd = [(5, None, [1.0, 1.0]), (6, 1, None), (7, 1, [float("nan"), 1.0]), (8, 0, [float("inf"), 1.0]), (9, 0, [None, 1.0]), (3, 0, [])]
    assert mined(spark, fine + odd) == brute_negatives(fine, lambda k: k % 10 == 0) != []
    assert mined(spark, [r for r in fine if r[1] == 1]) == []
    assert mined(spark, []) == []


def test_scores_beyond_64_bits_are_an_error(spark):
    with pytest.raises(Exception, match="(?i)overflow|too (large|big)|int64|convert"):
        mined(spark, [(0, 1, [1e12]), (1, 1, [1e12]), (2, 0, [1e12])])


def test_buckets_leave_rows_out_but_none_that_fit():
    pick = np.random.default_rng(5)
    codes = np.floor(pick.normal(0, 40, (2000, 8)) * pick.lognormal(0, 1, (2000, 1)))
    block = lemp.Block(codes)
    query = codes[7]
    exact = codes @ query
    for need in (0.3 * exact.max(), 0.8 * exact.max(), 1e12):
        found = [(i, s) for at, scores in block.scores(query, 5, lambda need=need: need) for i, s in zip(at, scores, strict=True)]
        assert {i for i, s in found if s >= need} == set(np.flatnonzero(exact >= need).tolist())
        assert all(exact[i] == s for i, s in found) and len(found) < 1500


# ---- token counts ----

@pytest.fixture(scope="module")
def model():
    public = pytest.importorskip("public_tokenizers")
    return public.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library(model):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


def odd_texts(library):
    pick = random.Random(1)
    pieces = [library.id_to_piece(i) for i in range(259, 32000)]
    letters = ["a", "e", "t", " ", "\n", "s", "in", "the", "▁", "é", "日", "1", ".", "  ", "----", "====", "\t", "П", "р", "😀", "A"]
    texts = [None, "", " ", "  a", "a  b ", "a\n\nb", "\x00a", "▁a b", "日本語", "<s>a</s>", "<0x41>", "<unk>", "a\tb", "　x", "\r\n", "a" * 5000,
             " " * 3000, "a b" * 2000, " " * 17 + "x" + " " * 9, "=" * 999, "ab" * 3000, "no" * 40_000 + " end", "𝔘𝔫𝔦 ｆｕｌｌ"]
    texts += ["".join(pick.choice(letters) for _ in range(pick.randrange(1, 60))) for _ in range(800)]
    texts += ["".join(pick.choice(pieces).replace("▁", " ") for _ in range(pick.randrange(1, 12))) for _ in range(800)]
    texts += ["".join(pick.choice("abcdefghijklmnopqrstuvwxyz=-.") for _ in range(pick.randrange(900, 2500))) for _ in range(10)]
    return texts


def test_counts_equal_the_library(spark, model, library, monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 500)
    monkeypatch.setattr(token_counts, "PIECE", 3000)
    texts = odd_texts(library) + ["same words"] * 3
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int, row string")
    got = {r.row.doc_id: r.n_tokens for r in token_counts.count_tokens(df, "text", model).collect()}
    assert got == {i: len(library.encode(t or "")) for i, t in enumerate(texts)}
    assert token_counts.count_tokens(df.where("doc_id < 0"), "text", model).collect() == []


def test_rounds_and_queue_agree(model, library, monkeypatch):
    vocabulary = token_counts.Vocabulary.from_sentencepiece(model)
    words = [token_counts.SPACE + "".join(random.Random(i).choice("aeinorst") for _ in range(i % 90 + 2)) for i in range(300)]
    rounds = vocabulary.count(words)
    monkeypatch.setattr(token_counts, "LONG", 1)
    assert vocabulary.count(words) == rounds == [len(library.encode(w[1:])) for w in words]


def test_token_query_over_documents(spark, table, library):
    texts = {r.doc_id: r.text or "" for r in table("documents").collect()}
    rows = queries.QUERIES["op12_token_counts"][0](spark, SF).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in rows} == {
        d: (len(t.encode()), n, n > 4096) for d, t in texts.items() for n in [len(library.encode(t))]}


def test_other_vocabularies_are_refused(model, tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as pb

    other = pb.ModelProto()
    with open(model, "rb") as f:
        other.ParseFromString(f.read())
    other.normalizer_spec.remove_extra_whitespaces = True
    path = tmp_path / "other.model"
    path.write_bytes(other.SerializeToString())
    with pytest.raises(ValueError, match="only byte-pair"):
        token_counts.Vocabulary.from_sentencepiece(str(path))


# ---- conversation repair ----

SPACES = " \t\n\v\f\r"
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}


def all_repairs(kinds):
    """(cost, audit) of every sequence of edits worth looking at."""
    open_ = {(0, ""): 0}
    for kind in kinds:
        more = {}
        for (state, audit), cost in open_.items():
            for n in range(3):
                extra = 3 if kind.isupper() else 0
                steps = [("D", state, 4)]
                if kind != "x":
                    steps += [("R", NEXT[state, r], 3 + extra) for r in "ua" if (state, r) in NEXT]
                    steps += [("K", NEXT[state, kind.lower()], extra)] if (state, kind.lower()) in NEXT else []
                for edit, after, price in steps:
                    key = after, audit + "I" * n + edit
                    more[key] = min(more.get(key, 1 << 30), cost + 3 * n + price)
                state = NEXT[state, "a" if state == 2 else "u"]
        least = min(more.values())
        open_ = {k: c for k, c in more.items() if c <= least + 14}
    for (state, audit), cost in open_.items():
        for n in range(3):
            if state in (0, 3):
                yield cost + 3 * n, audit + "I" * n
            state = NEXT[state, "a" if state == 2 else "u"]


def test_edits_are_the_least_of_all():
    pick = random.Random(2)
    for n in range(400):
        kinds = "".join(pick.choice(repair.KINDS if n % 2 else "suaUAx") for _ in range(pick.randrange(8)))
        assert repair.repaired(kinds) == min(all_repairs(kinds)), kinds


def plain(rows, damage):
    """The contract in plain Python, with the quadratic search replaced by one over (cost, audit) per state."""
    after, ids = {}, {r[0] for r in rows}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fate = zlib.crc32(name.encode()) % 20 if damage else 9
        text = "" if fate == 1 else text.translate(str.maketrans("", "", ".!?")) if fate == 2 else text
        kept = (turn, "user" if fate == 4 else role, text)
        after.setdefault(conv, []).extend([kept] * {0: 0, 3: 2}.get(fate, 1))
    out = {}
    for conv in ids:
        digest = lambda r, t: hashlib.sha256(f"{len(r.encode())}:{r}{t}".encode()).digest()
        mine = sorted(after.get(conv, []), key=lambda x: (x[0] is not None, x[0] or 0, x[1], digest(*x[1:])))
        seen, kinds, faults = set(), "", [0, 0, 0]
        for _, role, text in mine:
            kind = role[:1] if role[:1] in ("s", "u", "a") else "o"
            if not text.strip(SPACES):
                fault, kind = 0, "x"
            elif (role, text) in seen:
                fault, kind = 1, "x"
            elif text.rstrip(SPACES)[-1] not in ".!?":
                fault, kind = 2, kind.upper()
            else:
                fault = None
            if fault is not None:
                faults[fault] += 1
            seen.add((role, text))
            kinds += kind
        best = {0: (0, "")}
        for kind in kinds:
            more = {}
            for p, (cost, audit) in best.items():
                for q, (price, edits) in [(q, s) for (a, q), s in repair.STEPS[kind].items() if a == p]:
                    more[q] = min(more.get(q, (1 << 30, "")), (cost + price, audit + edits))
            best = more
        cost, audit = min((c + 3 * n, a + "I" * n) for q, (c, a) in best.items() for n in [[0, 2, 1, 0][q]])
        lines, rest, state = [], iter(mine), 0
        for edit in audit:
            role, text = ("user" if state != 2 else "assistant"), ""
            if edit != "I":
                _, own, text = next(rest)
                role = own if edit == "K" else role
            if edit != "D":
                lines.append(f"{role}:{text}")
                state = NEXT[state, role[:1]]
        turns = [t for t, _, _ in mine if t is not None]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *faults,
                     sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:])), cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def repaired(spark, rows, piece_rows, damage=True):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, id int, part string")
    given = (repair.damaged if damage else repair.conversations)(df.repartition(3), "conv_id", "turn", "role", "text")
    return {None if r.id == "n" else int(r.id[1:]): tuple(r)[1:] for r in repair.repair(given, piece_rows).select(
        "id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


def talk(pick, conv, n):
    texts = ["One.", "Two!\n", "three", "Four? \t", "", " \v", "Ünd so.", "six words that don't end", "long " * 400 + "."]
    return [(conv, pick.choice([None, *range(n), n * 3]), pick.choice(["user", "assistant", "user", "assistant", "system", "", None, "critic"]),
             pick.choice([*texts, None, f"text {pick.randrange(n)}."])) for _ in range(n)]


@pytest.mark.parametrize("piece_rows,damage", [(20_000, True), (7, True), (7, False)])
def test_repair_equals_plain_python(spark, piece_rows, damage):
    """One conversation has a third of all rows and lies in many pieces and tasks."""
    pick = random.Random(piece_rows)
    rows = [r for conv in [None, *range(60)] for r in talk(pick, conv, pick.randrange(1, 9))]
    rows += talk(pick, 1000, 160) + [(2000, 5, "user", "Same text.")] * 40
    got, want = repaired(spark, rows, piece_rows, damage), plain(rows, damage)
    assert got == want


def test_conversations_without_rows(spark):
    gone = next(i for i in range(100) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert repaired(spark, [(gone, 0, "user", "Hello.")], 5) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert repaired(spark, [], 5) == {}


def test_long_conversation_in_linear_space():
    """Halves meet at the least crossing however long the conversation is."""
    pick = random.Random(9)
    kinds = "".join(pick.choice(repair.KINDS) for _ in range(3000))
    cost, audit = repair.repaired(kinds)
    best = {0: (0, "")}
    for kind in kinds:
        more = {}
        for p, (c, a) in best.items():
            for q in range(4):
                if (p, q) in repair.STEPS[kind]:
                    price, edits = repair.STEPS[kind][p, q]
                    more[q] = min(more.get(q, (1 << 30, "")), (c + price, a + edits))
        best = more
    assert (cost, audit) == min((c + 3 * n, a + "I" * n) for q, (c, a) in best.items() for n in [[0, 2, 1, 0][q]])
