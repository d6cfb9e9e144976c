"""Repair of conversations into alternating turns at least cost, by Hirschberg's divide and conquer.

A conversation is repaired by editing its rows from first to last: K keeps a
row, R gives it the role that is due, D deletes it, I inserts an empty turn. The
roles emitted so far are one of four states: nothing, an opening system turn, a
user turn, an assistant turn. A stretch of rows is a 4 x 4 table of least costs
between states; forward and backward cost vectors meet in its middle, the
crossing with the ASCII-least edits before it is chosen, and both halves are
solved alone, so nothing larger than the row kinds (one letter each) is held.

At scale: rows without their texts are range-sorted, so that a long conversation
lies in several tasks as pieces. Pieces of a conversation meet as cost tables,
each learns its first and last state, and solves its own rows. Texts are
shuffled once, to be hashed in order as a stream.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.session import cut_lineage

START, SYSTEM, USER, ASSISTANT = range(4)
EMIT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
COSTS = {"K": 0, "R": 3, "D": 4, "I": 3}
TRUNCATED = 3
#: What R and I emit in each state.
DUE = "uuau"
#: Row kinds: x must be deleted; s, u, a and o (another role) as they start; upper case if truncated.
KINDS = "xsuaoSUAO"
FAR = 1 << 40
#: Rows in one piece of a conversation.
PIECE = 20_000
WORD = r"[^\x20\x09-\x0D]"

PIECES = ("id string, part int, piece int, kinds string, n_rows bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
          "first_role string, last_role string, low bigint, high bigint, first_turn bigint, last_turn bigint, turns bigint, "
          "open boolean, keys array<binary>, places array<int>")


def _inserted(state: int):
    """(state, inserts) after up to three inserted turns."""
    for n in range(4):
        yield state, n
        state = EMIT[state, DUE[state]]


def _steps(kind: str) -> dict[tuple[int, int], tuple[int, str]]:
    """Least (cost, edits) of one row of a kind from state to state, inserts before it counted."""
    role, extra = kind.lower(), TRUNCATED if kind.isupper() else 0
    best = {}
    for p in range(4):
        for state, n in _inserted(p):
            moves = [("D", state, COSTS["D"])]
            if kind != "x":
                moves.append(("R", EMIT[state, DUE[state]], COSTS["R"] + extra))
                if (state, role) in EMIT:
                    moves.append(("K", EMIT[state, role], extra))
            for edit, q, cost in moves:
                found = (cost + n * COSTS["I"], "I" * n + edit)
                best[p, q] = min(best.get((p, q), (FAR, "")), found)
    return best


STEPS = {kind: _steps(kind) for kind in KINDS}
#: Least inserts that complete a conversation from each state.
CLOSING = [min(n for q, n in _inserted(p) if q in (START, ASSISTANT)) for p in range(4)]


@lru_cache(maxsize=200_000)
def _forward_step(costs: tuple, order: tuple, kind: str):
    """Costs and order of edits (a number per state, smaller is ASCII-less) after one more row; costs less their least, and that."""
    found = []
    for q in range(4):
        # paths to different states never have the same edits, nor one the other's beginning
        options = [(costs[p] + STEPS[kind][p, q][0], order[p], STEPS[kind][p, q][1]) for p in range(4)
                   if costs[p] < FAR and (p, q) in STEPS[kind]]
        found.append(min(options, default=(FAR, 0, "")))
    ranks = sorted({f[1:] for f in found if f[0] < FAR})
    least = min(f[0] for f in found)
    return (tuple(f[0] - least if f[0] < FAR else FAR for f in found),
            tuple(ranks.index(f[1:]) if f[0] < FAR else 0 for f in found), least)


@lru_cache(maxsize=200_000)
def _backward_step(costs: tuple, kind: str):
    found = [min((STEPS[kind][p, q][0] + costs[q] for q in range(4) if (p, q) in STEPS[kind] and costs[q] < FAR), default=FAR)
             for p in range(4)]
    least = min(found)
    return tuple(c - least if c < FAR else FAR for c in found), least


def _at(state: int) -> tuple:
    return tuple(0 if q == state else FAR for q in range(4))


def forward(kinds: str, state: int) -> tuple[list[int], tuple]:
    """Least cost of the rows from a state to each state, and the order of their least edits."""
    costs, order, total = _at(state), (0, 0, 0, 0), 0
    for kind in kinds:
        costs, order, more = _forward_step(costs, order, kind)
        total += more
    return [c + total if c < FAR else FAR for c in costs], order


def backward(kinds: str, state: int) -> list[int]:
    """Least cost of the rows from each state to a state."""
    costs, total = _at(state), 0
    for kind in reversed(kinds):
        costs, more = _backward_step(costs, kind)
        total += more
    return [c + total if c < FAR else FAR for c in costs]


def least_edits(kinds: str, first: int, last: int) -> str:
    """ASCII-least of the cheapest edits that lead from the state before the rows to the state after them."""
    out, stack = [], [(0, len(kinds), first, last)]
    while stack:
        low, high, p, q = stack.pop()
        if high - low < 2:
            out.append(STEPS[kinds[low]][p, q][1] if high > low else "")
            continue
        middle = (low + high) // 2
        costs, order = forward(kinds[low:middle], p)
        rest = backward(kinds[middle:high], q)
        _, _, crossing = min((costs[s] + rest[s], order[s], s) for s in range(4) if costs[s] < FAR and rest[s] < FAR)
        stack += [(middle, high, crossing, q), (low, middle, p, crossing)]
    return "".join(out)


def last_state(costs: list[int], order) -> tuple[int, int]:
    """Cost and state after the last row of a whole conversation's cheapest repair."""
    total, _, state = min((costs[q] + CLOSING[q] * COSTS["I"], order[q], q) for q in range(4) if costs[q] < FAR)
    return total, state


@lru_cache(maxsize=100_000)
def repaired(kinds: str) -> tuple[int, str]:
    """Cost and edits of a whole conversation."""
    cost, state = last_state(*forward(kinds, START))
    return cost, least_edits(kinds, START, state) + "I" * CLOSING[state]


def _one(column) -> Column:
    """Null as one space."""
    return F.coalesce(column, F.lit(" "))


def _named(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """``id``, the conversation as text with a mark for null, ``turn``, ``role`` and ``text``."""
    key = F.when(F.col(conv).isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col(conv).cast("string")))
    return df.select(key.alias("id"), F.col(turn).cast("bigint").alias("turn"), _one(F.col(role)).alias("role"), _one(F.col(text)).alias("text"))


def conversations(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows for :func:`repair` as they are; null roles and texts are one space."""
    return _named(df, conv, turn, role, text).withColumn("gone", F.lit(False))


def damaged(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows for :func:`repair` after damage by the checksum of ``conv:turn``, in twentieths.

    0 marks a row as ``gone``, 1 empties its text, 2 takes its stops, 3 repeats
    it, 4 makes it the user's. A null counts as one space.
    """
    number = _one(F.col("turn").cast("string"))
    fate = F.crc32(F.concat(F.when(F.col("id") == "n", F.lit(" ")).otherwise(F.expr("substring(id, 2)")), F.lit(":"), number)) % 20
    return _named(df, conv, turn, role, text).withColumn("fate", fate).select(
        "id", "turn", F.when(F.col("fate") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("fate") == 1, F.lit("")).when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("fate") == 0).alias("gone"),
        F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def _digest() -> Column:
    """SHA-256 of role and text."""
    return F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))


def _slim(rows: DataFrame) -> DataFrame:
    """Rows without texts: faults that a row shows alone, and a digest of role and text."""
    end = F.regexp_extract("text", rf"({WORD})[\x20\x09-\x0D]*\z", 1)
    return rows.select(
        "id", F.col("turn").isNotNull().alias("numbered"), F.coalesce("turn", F.lit(0)).alias("turn"), "role",
        F.substring("role", 1, 1).alias("initial"), _digest().alias("digest"), (F.length(end) == 0).alias("blank"),
        (~end.isin(".", "!", "?")).alias("truncated"), "gone")


class _Piece:
    """Rows of one conversation that a task meets one after another."""

    def __init__(self, part: int, key: str, number: int, before=None):
        self.part, self.id, self.number = part, key, number
        self.kinds, self.keys, self.places = [], [], []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first_role = self.last_role = self.low = self.high = self.first_turn = self.last_turn = None
        self.seen = before.seen if before else set()

    def add(self, numbered, turn, initial, digest, blank, truncated):
        if self.kinds:
            self.illegal += self.last_role + initial not in ("su", "ua", "au")
        else:
            self.first_role = initial
        self.last_role = initial
        if numbered:
            if self.last_turn != turn:
                self.turns += 1
            if self.first_turn is None:
                self.first_turn = self.low = turn
            self.last_turn = self.high = turn
        kind = initial if initial in ("s", "u", "a") else "o"
        if blank:
            self.blank += 1
            kind = "x"
        elif digest in self.seen:
            self.duplicate += 1
            kind = "x"
        else:
            self.seen.add(digest)
            self.keys.append(digest)
            self.places.append(len(self.kinds))
            if truncated:
                self.truncated += 1
                kind = kind.upper()
        self.kinds.append(kind)

    def row(self, open_: bool):
        return (self.id, self.part, self.number, "".join(self.kinds), len(self.kinds), self.blank, self.duplicate, self.truncated,
                self.illegal, self.first_role, self.last_role, self.low, self.high, self.first_turn, self.last_turn, self.turns, open_,
                self.keys if open_ else None, self.places if open_ else None)


def _pieces(size: int):
    """One row per piece; conversations that other tasks or pieces may share are ``open`` and bring the digests they saw first."""
    names = [f.split()[0] for f in PIECES.split(", ")]

    def run(frames):
        part, piece, shared, out = None, None, True, []

        def frame():
            rows = pd.DataFrame(out, columns=names)
            for c in ("low", "high", "first_turn", "last_turn"):
                rows[c] = pd.array(rows[c].tolist(), dtype="Int64")
            out.clear()
            return rows

        for rows in frames:
            for key, numbered, turn, initial, digest, blank, truncated, gone, number in rows[
                    ["id", "numbered", "turn", "initial", "digest", "blank", "truncated", "gone", "part"]].itertuples(index=False, name=None):
                if piece is None or piece.id != key:
                    if piece:
                        out.append(piece.row(shared))
                        shared = False  # only the first conversation of a task, the last, and those of several pieces
                    part, piece = number, _Piece(number, key, 0)
                elif len(piece.kinds) >= size:
                    out.append(piece.row(True))
                    piece, shared = _Piece(part, key, piece.number + 1, piece), True
                if not gone:
                    piece.add(numbered, turn, initial, digest, blank, truncated)
            if len(out) > 2000:
                yield frame()
        if piece:
            out.append(piece.row(True))
        yield frame()

    return run


def _without(frames):
    """Rows that an earlier piece has had become deletions."""
    for rows in frames:
        kinds, less = [], []
        for k, places in zip(rows["kinds"], rows["again"], strict=True):
            letters = np.array(list(k), "U1")
            at = [] if places is None else list(places)
            less.append(sum(1 for i in at if letters[i].isupper()))
            letters[at] = "x"
            kinds.append("".join(letters.tolist()))
        n = [0 if p is None else len(p) for p in rows["again"]]
        rows["kinds"], rows["duplicate"], rows["truncated"] = kinds, rows["duplicate"] + n, rows["truncated"] - less
        yield rows.drop(columns=["again"])


def _tables(frames):
    """Least costs of each piece between all states, and the order of the edits."""
    for rows in frames:
        found = [[forward(k, p) for p in range(4)] for k in rows["kinds"]]
        rows["costs"] = [[c for costs, _ in f for c in costs] for f in found]
        rows["orders"] = [[o for _, order in f for o in order] for f in found]
        yield rows.drop(columns=["kinds"])


def _met(rows: pd.DataFrame) -> pd.DataFrame:
    """Pieces of one conversation, by their tables: totals on the first, first and last state on each."""
    rows = rows.sort_values(["part", "piece"])
    tables = [(np.reshape(c, (4, 4)).tolist(), np.reshape(o, (4, 4)).tolist()) for c, o in zip(rows["costs"], rows["orders"], strict=True)]
    costs, order, back = list(_at(START)), [0] * 4, []
    for step, ranks in tables:
        found = [min(((costs[p] + step[p][q], order[p], ranks[p][q], p) for p in range(4) if costs[p] < FAR and step[p][q] < FAR),
                     default=(FAR, 0, 0, 0)) for q in range(4)]
        kept = sorted({f[1:3] for f in found if f[0] < FAR})
        costs = [f[0] for f in found]
        order = [kept.index(f[1:3]) if f[0] < FAR else 0 for f in found]
        back.append([f[3] for f in found])
    cost, state = last_state(costs, order)
    closing, last = CLOSING[state], []
    for origins in reversed(back):
        last.append(state)
        state = origins[state]
    last.reverse()
    full = rows[rows["n_rows"] > 0]
    turns, illegal, before = 0, int(full["illegal"].sum()), None
    for first, end, n in zip(full["first_turn"], full["last_turn"], full["turns"], strict=True):
        if n:
            turns += int(n) - (before is not None and before == first)
            before = end
    for one, other in zip(full["last_role"].iloc[:-1], full["first_role"].iloc[1:], strict=True):
        illegal += one + other not in ("su", "ua", "au")
    low, high = full["low"].dropna(), full["high"].dropna()
    head = np.arange(len(rows)) == 0
    on_head = lambda v: np.where(head, v, 0)
    return pd.DataFrame({
        "id": rows["id"], "part": rows["part"], "piece": rows["piece"], "first": [START, *last[:-1]], "last": last,
        "closing": np.where(np.arange(len(rows)) == len(rows) - 1, closing, 0), "cost": on_head(cost), "illegal": on_head(illegal),
        "gaps": on_head(int(high.max()) - int(low.min()) + 1 - turns if len(low) else 0)})


def _closed(frames):
    """Whole conversations of one piece."""
    for rows in frames:
        found = [repaired(k) for k in rows["kinds"]]
        rows["cost"], rows["audit"] = [c for c, _ in found], [a for _, a in found]
        yield rows[["id", "blank", "duplicate", "truncated", "illegal", "cost", "gaps", "audit"]]


def _solved(frames):
    for rows in frames:
        rows["edits"] = [least_edits(k, p, q) + "I" * c
                         for k, p, q, c in rows[["kinds", "first", "last", "closing"]].itertuples(index=False, name=None)]
        yield rows.drop(columns=["kinds", "first", "last", "closing"])


CLOSED = "id string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, gaps bigint, audit string"


def _order(*names: str) -> list[Column]:
    return [F.col(n).asc_nulls_first() for n in names]


def audits(slim: DataFrame, piece_rows: int = PIECE) -> DataFrame:
    """One row per conversation: fault counts, gaps, cost and the edits' initials."""
    keys = _order("id", "numbered", "turn", "role", "digest")
    spread = F.xxhash64(F.monotonically_increasing_id())  # parts rows that are alike in everything
    ranged = slim.withColumn("spread", spread).repartitionByRange(*keys, F.col("spread")).sortWithinPartitions(*keys)
    pieces = cut_lineage(ranged.withColumn("part", F.spark_partition_id()).mapInPandas(_pieces(piece_rows), PIECES), "pieces")
    gaps = F.when(F.col("turns") > 0, F.col("high") - F.col("low") + 1 - F.col("turns")).otherwise(F.lit(0))
    alone = pieces.where("not open").withColumn("gaps", gaps).mapInPandas(_closed, CLOSED)

    shared = pieces.where("open")
    firsts = shared.select("id", "part", "piece", F.explode(F.arrays_zip("keys", "places")).alias("k")).select(
        "id", "part", "piece", F.col("k.keys").alias("digest"), F.col("k.places").alias("place"))
    at = F.struct("part", "piece")
    earliest = firsts.groupBy("id", "digest").agg(F.min(at).alias("earliest"), F.count("*").alias("n")).where("n > 1")
    again = firsts.join(earliest, ["id", "digest"]).where(at > F.col("earliest")).groupBy("id", "part", "piece").agg(
        F.collect_list("place").alias("again"))
    known = shared.drop("keys", "places", "open").join(again, ["id", "part", "piece"], "left")
    known = cut_lineage(known.mapInPandas(_without, PIECES.split(", open")[0]), "known_pieces")
    slight = known.mapInPandas(_tables, PIECES.replace(" kinds string,", "").split(", open")[0] + ", costs array<bigint>, orders array<int>")
    met = slight.groupBy("id").applyInPandas(
        _met, "id string, part int, piece int, first int, last int, closing int, cost bigint, illegal bigint, gaps bigint")
    solved = known.select("id", "part", "piece", "kinds", "blank", "duplicate", "truncated").join(met, ["id", "part", "piece"]).mapInPandas(
        _solved, "id string, part int, piece int, blank bigint, duplicate bigint, truncated bigint, cost bigint, illegal bigint, "
                 "gaps bigint, edits string")
    whole = solved.groupBy("id").agg(
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost", "gaps")],
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "piece", "edits"))), lambda s: s["edits"]), "").alias("audit"))
    return alone.unionByName(whole)


def _hashed(frames):
    """Digest of every repaired conversation; rows come by conversation, first its edits, then its turns in order."""
    digest = audit = key = None
    at = state = 0
    empty = True
    out = []

    def emit(role, text):
        nonlocal empty
        digest.update((b"" if empty else b"\n") + role.encode() + b":" + text.encode())
        empty = False

    def inserts(end):
        nonlocal at, state
        while at < end and audit[at] == "I":
            emit("user" if DUE[state] == "u" else "assistant", "")
            state, at = EMIT[state, DUE[state]], at + 1

    def close():
        if key is not None:
            inserts(len(audit))
            out.append((key, digest.hexdigest()))

    for rows in frames:
        for id_, edits, role, text in rows[["id", "audit", "role", "text"]].itertuples(index=False, name=None):
            if edits is not None:
                close()
                key, audit, digest, at, state, empty = id_, edits, hashlib.sha256(), 0, START, True
                continue
            inserts(len(audit))
            edit, at = audit[at], at + 1
            if edit == "R":
                role = "user" if DUE[state] == "u" else "assistant"
            if edit != "D":
                emit(role, text)
                state = EMIT[state, role[:1]]
        yield pd.DataFrame(out, columns=["id", "repaired_sha256"])
        out = []
    close()
    yield pd.DataFrame(out, columns=["id", "repaired_sha256"])


def repair(rows: DataFrame, piece_rows: int = PIECE) -> DataFrame:
    """One row per conversation of the rows of :func:`conversations` or :func:`damaged`.

    ``id``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``,
    ``cost``, ``audit`` and ``repaired_sha256``. Turns are ordered by number,
    nulls first, then by role and the SHA-256 of role and text; a copy stands
    next to its row. A conversation whose rows are all gone has zeros, an empty
    audit and the digest of the empty text. A role that starts with none of s,
    u, a (an empty one too) cannot be kept. An empty table gives an empty result.

    Texts of any length pass through whole. A conversation of any length is cut
    into pieces for the search; its repaired text is hashed as a stream by one
    task, because the digest depends on the order, and its audit is one string.
    """
    found = cut_lineage(audits(_slim(rows), piece_rows), "audits")
    body = rows.where("not gone").select(
        "id", F.lit(None).cast("string").alias("audit"), F.lit(1).alias("kind"), F.col("turn").isNotNull().alias("numbered"), "turn", "role",
        _digest().alias("digest"), "text")
    head = found.select("id", "audit", F.lit(0).alias("kind"), F.lit(False).alias("numbered"), F.lit(0).cast("bigint").alias("turn"),
                        F.lit("").alias("role"), F.lit(None).cast("binary").alias("digest"), F.lit("").alias("text"))
    stream = head.unionByName(body).repartition("id").sortWithinPartitions(*_order("id", "kind", "numbered", "turn", "role", "digest"))
    hashed = stream.select("id", "audit", "role", "text").mapInPandas(_hashed, "id string, repaired_sha256 string")
    return found.join(hashed, "id")
