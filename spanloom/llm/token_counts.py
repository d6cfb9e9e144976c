"""Token counts of a byte-pair vocabulary, by merging all words of a batch at once.

Texts are cut where no vocabulary entry reaches across; the distinct pieces of a
batch are one ragged array of symbols. A round looks up the rank of every
neighbouring pair, takes the lowest of each sequence, and joins all its
occurrences together, from left to right where they overlap. Sequences without a
pair left are done; the symbols that survive are the tokens.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.common import opened, shipped

SPACE = "▁"
#: Characters of text whose words are held together.
PIECE = 1 << 20
#: Distinct words a task remembers; when there are more, it starts anew.
REMEMBERED = 400_000
#: Sequences longer than this go through a queue of pairs instead of rounds over arrays; the result is the same.
LONG = 1024
NONE = np.iinfo(np.int64).max


class Vocabulary:
    """Merge tables of a vocabulary: which pairs of symbols join, into what, and at which rank.

    Symbols are vocabulary ids; a character that is no entry has the id ``size``, never joins and counts its UTF-8 bytes.
    """

    def __init__(self, pieces: dict[str, float]):
        """``pieces``: every entry that texts can produce, with its score; a higher score joins earlier."""
        names = sorted(pieces)
        self.size = len(names)
        number = {p: i for i, p in enumerate(names)}
        _, rank = np.unique([-pieces[p] for p in names], return_inverse=True)
        self.rank = np.append(rank, NONE)
        singles = [p for p in names if len(p) == 1]
        self.characters = np.array([ord(p) for p in singles], np.int64)
        self.character_ids = np.array([number[p] for p in singles], np.int64)
        joins = {}
        alone = np.ones(self.size + 1, bool)
        inside = set()
        for p in names:
            inside.update(zip(p, p[1:]))
            for cut in range(1, len(p)):
                left, right = number.get(p[:cut]), number.get(p[cut:])
                if left is not None and right is not None:
                    joins[left * (self.size + 1) + right] = number[p]
                    for part in (left, right):  # joining this part can bring up a pair that is due before its other occurrences
                        if self.rank[number[p]] <= self.rank[part]:
                            alone[part] = False
        #: Entries of which all occurrences may be joined together; of the others only the leftmost one.
        self.together = alone
        self.pairs = np.array(sorted(joins), np.int64)
        self.joined = np.array([joins[k] for k in self.pairs.tolist()], np.int64)
        self.inside = np.array(sorted((ord(a) << 21) | ord(b) for a, b in inside), np.int64)
        cuts = "".join(c for c in "\n\r\t" if not any(c in p for p in names if len(p) > 1))
        crossing = any(b == SPACE and a != SPACE for a, b in inside)
        #: Words: runs of spaces with what follows; if an entry has a space after another sign, whole texts.
        self.words = "(?s).+" if crossing else f"{SPACE}+[^{SPACE}{cuts}]*|[^{SPACE}{cuts}]+" + (f"|[{cuts}]" if cuts else "")

    @classmethod
    def from_sentencepiece(cls, path: str) -> Vocabulary:
        """A BPE model with byte fallback and a space put before the text, which leaves texts as they are otherwise."""
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        plain, trained = model.normalizer_spec, model.trainer_spec
        kinds = pb.ModelProto.SentencePiece
        if (trained.model_type != 2 or not trained.byte_fallback or trained.treat_whitespace_as_suffix or plain.precompiled_charsmap
                or plain.remove_extra_whitespaces or not (plain.add_dummy_prefix and plain.escape_whitespaces)
                or any(p.type == kinds.USER_DEFINED for p in model.pieces)):
            raise ValueError(f"{path}: only byte-pair models with byte fallback, unchanged texts and a leading space are supported")
        return cls({p.piece: p.score for p in model.pieces if p.type in (kinds.NORMAL, kinds.UNUSED)})

    def _join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What each pair becomes; ``size`` where it doesn't join."""
        keys = left * (self.size + 1) + right
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where(self.pairs[at] == keys, self.joined[at], self.size)

    def count(self, words: list[str]) -> list[int]:
        """Number of tokens of every (non-empty) word."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        owner = np.repeat(np.arange(len(words)), lengths)
        at = np.minimum(np.searchsorted(self.characters, codes), len(self.characters) - 1)
        known = self.characters[at] == codes
        symbols = np.where(known, self.character_ids[at], self.size)
        size = 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)
        counts = np.bincount(owner, np.where(known, 1, size), len(words)).astype(np.int64)
        if len(self.pairs) and len(codes) > 1:
            near = (codes[:-1] << 21) | codes[1:]
            place = np.minimum(np.searchsorted(self.inside, near), len(self.inside) - 1)
            cut = (self.inside[place] != near) | (owner[1:] != owner[:-1])
            sequence = np.concatenate(([0], np.cumsum(cut)))
            owners = owner[np.concatenate(([True], cut))]
            counts -= np.bincount(owners, self._joins(symbols, sequence), len(words)).astype(np.int64)
        return counts.tolist()

    def _joins(self, symbols: np.ndarray, sequence: np.ndarray) -> np.ndarray:
        """Number of joins in every sequence; ``sequence`` has the number of each symbol's."""
        lengths = np.bincount(sequence)
        done = np.zeros(len(lengths), np.int64)
        for s in np.flatnonzero(lengths > LONG).tolist():
            done[s] = self._queued(symbols[slice(*np.searchsorted(sequence, [s, s + 1]))])
        open_ = (lengths[sequence] > 1) & (lengths[sequence] <= LONG)
        symbols, sequence = symbols[open_], sequence[open_]
        while len(symbols) > 1:
            joined = self._join(symbols[:-1], symbols[1:])
            joined[sequence[1:] != sequence[:-1]] = self.size
            pairs = np.flatnonzero(joined < self.size)
            if not len(pairs):
                break
            ranks, of = self.rank[joined[pairs]], sequence[pairs]
            first = np.concatenate(([True], of[1:] != of[:-1]))
            lowest = np.minimum.reduceat(ranks, np.flatnonzero(first))[np.cumsum(first) - 1]
            pairs = pairs[ranks == lowest]
            of = sequence[pairs]
            follows = np.concatenate(([False], np.diff(pairs) == 1))
            index = np.arange(len(pairs))
            start = np.maximum.accumulate(np.where(follows, 0, index))
            leftmost = np.concatenate(([True], of[1:] != of[:-1]))
            pairs = pairs[((index - start) % 2 == 0) & (self.together[joined[pairs]] | leftmost)]
            done += np.bincount(sequence[pairs], minlength=len(done))
            symbols[pairs] = joined[pairs]
            stays = np.ones(len(symbols), bool)
            stays[pairs + 1] = False
            alive = np.zeros(len(done), bool)
            alive[of] = True
            stays &= alive[sequence]
            symbols, sequence = symbols[stays], sequence[stays]
        return done

    def _queued(self, symbols: np.ndarray) -> int:
        """Number of joins in one long sequence: pairs leave a queue by rank, then place."""
        symbols = symbols.tolist()
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        first = self._join(np.array(symbols[:-1]), np.array(symbols[1:]))
        due = np.flatnonzero(first < self.size)
        ranks = self.rank.tolist()
        queue = [(ranks[first[i]], i, symbols[i], symbols[i + 1], int(first[i])) for i in due.tolist()]
        heapq.heapify(queue)
        table = dict(zip(self.pairs.tolist(), self.joined.tolist(), strict=True))
        joins = 0
        while queue:
            _, i, left, right, made = heapq.heappop(queue)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue
            symbols[i], symbols[j] = made, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            joins += 1
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n:
                    new = table.get(symbols[a] * (self.size + 1) + symbols[b])
                    if new is not None:
                        heapq.heappush(queue, (ranks[new], a, symbols[a], symbols[b], new))
        return joins


def _words(pattern, text: str):
    """Words of a text with a space before it, a list for every PIECE characters."""
    text = SPACE + text.replace(" ", SPACE) if text else ""
    start = 0
    while start < len(text):
        end = text.find(SPACE, start + PIECE)
        while end > 0 and text[end - 1] == SPACE:  # not inside a run of spaces
            end = text.find(SPACE, end + 1)
        end = len(text) if end < 0 or pattern.pattern == "(?s).+" else end
        yield pattern.findall(text[start:end])
        start = end


def _counted(box):
    def run(batches):
        vocabulary = opened(box)
        pattern, known = re.compile(vocabulary.words), {}

        def counted(lists):
            nonlocal known
            new = set().union(*(words for _, words in lists)).difference(known)
            if len(known) + len(new) > REMEMBERED:
                known, new = {}, set().union(*(words for _, words in lists))
            if new:
                new = list(new)
                known.update(zip(new, vocabulary.count(new), strict=True))
            for i, words in lists:
                totals[i] += sum(map(known.__getitem__, words))

        for batch in batches:
            totals, held, size = [0] * batch.num_rows, [], 0
            for i, text in enumerate(batch["text"]):
                for words in _words(pattern, text.as_py() or ""):
                    held.append((i, words))
                    size += len(words)
                    if size >= PIECE // 4:
                        counted(held)
                        held, size = [], 0
            counted(held)
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(totals, pa.int64())], names=["row", "n_tokens"])

    return run


def count_tokens(df: DataFrame, text: str, model: str) -> DataFrame:
    """``row`` (struct of all input columns) and ``n_tokens`` of every whole text, without added special tokens.

    ``model`` is the path of a sentencepiece BPE file; it is read on the driver
    and its merge tables (some megabytes, bounded by the vocabulary) are
    broadcast. Null and empty texts have no tokens; control pieces written out in
    a text are ordinary text; repeated rows count each; an empty table gives an
    empty result. No shuffle: a lost task counts its rows again.
    """
    vocabulary = shipped(df.sparkSession, Vocabulary.from_sentencepiece(model))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(text).alias("text"))
    schema = T.StructType([rows.schema["row"], T.StructField("n_tokens", T.LongType())])
    return rows.mapInArrow(_counted(vocabulary), schema)
