"""Token counts by rank-synchronous merging of pre-tokens held as ragged numpy arrays.

A text is normalised by the model, then cut before every run of word marks, where no piece reaches across. The pre-tokens
of a batch that are not remembered become one ragged array of symbols (characters). In every round each sequence finds the lowest rank
among its adjacent pairs, and all sequences apply theirs at the same time; sequences without a pair that merges leave
the array. What survives is counted: one token for a piece, its UTF-8 bytes for a character without one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a normalised text looked at together, and pre-tokens that a worker remembers before it forgets them all.
STRETCH, MEMO = 1 << 20, 1_000_000
#: Symbols from which a sequence whose best pair is not safe to merge in several places is scanned instead of merged once a round.
LONG = 64
_MARK = "▁"
_NONE = np.iinfo(np.int64).max
_counters: dict[str, Counter] = {}


class Counter:
    """Counts tokens with the pieces of a sentencepiece BPE model that falls back to bytes and has no user-defined pieces."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(m.piece_size())
        if not any(map(m.is_byte, ids)):
            raise ValueError(f"{path}: counting needs a model that falls back to bytes")
        pieces = {m.id_to_piece(i): m.get_score(i) for i in ids if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))}
        symbols = {x: i for i, x in enumerate(dict.fromkeys([*pieces, *"".join(pieces)]))}
        self.n = len(symbols)
        of_score = {s: i for i, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        rank = {x: of_score[s] for x, s in pieces.items()}
        pairs, joint, unsafe = {}, set(), set()
        for x in pieces:
            joint.update(zip(x, x[1:], strict=False))
            for i in range(1, len(x)):
                if x[:i] in symbols and x[i:] in symbols:
                    pairs[symbols[x[:i]] * self.n + symbols[x[i:]]] = (rank[x], symbols[x])
                    unsafe.update(p for p in (x[:i], x[i:]) if rank.get(p, -1) >= rank[x])
        if any(a != _MARK and b == _MARK for a, b in joint):
            raise ValueError(f"{path}: a piece reaches across the start of a word")
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks, self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int64).reshape(-1, 2).T.copy()
        self.joint = np.array(sorted(symbols[a] * self.n + symbols[b] for a, b in joint), np.int64)
        #: Whether a symbol's extensions all have a higher rank, so that merging it in one place never puts off another.
        self.safe = np.ones(self.n, bool)
        self.safe[[symbols[x] for x in unsafe]] = False
        self.symbol = np.full(0x110000, -1, np.int32)
        #: Tokens of a symbol that survives, and of a character outside all pieces.
        self.size = np.ones(self.n, np.int64)
        self.bytes = np.ones(0x110000, np.int8)
        for least in (0x80, 0x800, 0x10000):
            self.bytes[least:] += 1
        for x, i in symbols.items():
            if len(x) == 1:
                self.symbol[ord(x)] = i
                self.size[i] = 1 if x in pieces else self.bytes[ord(x)]
        self.memo: dict[str, int] = {}

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair, _NONE if it does not merge, and what it merges to."""
        if not len(self.keys):
            return np.full(len(left), _NONE), left
        k = left * self.n + right
        j = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where((self.keys[j] == k) & (left >= 0) & (right >= 0), self.ranks[j], _NONE), self.merged[j]

    def _scan(self, symbols: list[int], rank: int) -> list[int]:
        """One sequence after all merges of at most a rank, leftmost first, where no pair has a lower rank at the start."""
        known: dict[tuple[int, int], tuple[int, int]] = {}

        def pair(a: int, b: int) -> tuple[int, int]:
            if (a, b) not in known:
                r, m = self._look_up(np.array([a]), np.array([b]))
                known[a, b] = int(r[0]), int(m[0])
            return known[a, b]

        out, rest = [], symbols[::-1]
        while rest:
            out.append(rest.pop())
            while True:
                left = pair(out[-2], out[-1]) if len(out) > 1 else (_NONE, 0)
                right = pair(out[-1], rest[-1]) if rest else (_NONE, 0)
                if min(left[0], right[0]) > rank:
                    break
                if left[0] <= right[0]:
                    out[-2:] = [left[1]]
                else:
                    out[-1] = right[1]
                    rest.pop()
        return out

    def merge(self, tokens: list[str]) -> np.ndarray:
        """Tokens of each of many pre-tokens."""
        text = np.frombuffer("".join(tokens).encode("utf-32-le", "surrogatepass"), "<u4")
        owner = np.repeat(np.arange(len(tokens)), [len(x) for x in tokens])
        counts = np.zeros(len(tokens), np.int64)
        symbol = self.symbol[text].astype(np.int64)
        foreign = symbol < 0
        np.add.at(counts, owner[foreign], self.bytes[text[foreign]].astype(np.int64))
        # sequences: symbols of one pre-token, cut where no piece holds the two neighbours
        k = symbol[:-1] * self.n + symbol[1:]
        j = np.minimum(np.searchsorted(self.joint, k), max(len(self.joint) - 1, 0))
        tied = (owner[:-1] == owner[1:]) & ~foreign[:-1] & ~foreign[1:] & (self.joint[j] == k if len(self.joint) else False)
        sequence = np.concatenate([[0], np.cumsum(~tied)])[: len(symbol)][~foreign]
        symbol, owner = symbol[~foreign], owner[~foreign]
        rank, to = self._ranked(symbol, sequence)
        while len(symbol):
            starts = np.flatnonzero(np.concatenate([[True], sequence[1:] != sequence[:-1]]))
            lengths = np.diff(np.append(starts, len(symbol)))
            least = np.repeat(np.minimum.reduceat(rank, starts), lengths)
            done = least == _NONE
            if done.any():
                np.add.at(counts, owner[done], self.size[symbol[done]])
                symbol, owner, sequence, rank, to, least = (x[~done] for x in (symbol, owner, sequence, rank, to, least))
                if not len(symbol):
                    break
            at = np.flatnonzero(rank == least)
            first = np.concatenate([[True], sequence[at[1:]] != sequence[at[:-1]]])
            safe = self.safe[to[at]]
            # of pairs that overlap, every other one from the left; of a rank that is not safe, the first of the sequence
            run = np.concatenate([[True], (at[1:] != at[:-1] + 1) | first[1:]])
            from_start = at - at[np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))]
            lowest = np.repeat(np.logical_and.reduceat(safe, np.flatnonzero(first)), np.diff(np.append(np.flatnonzero(first), len(at))))
            long = np.bincount(sequence - sequence[0])[sequence[at] - sequence[0]] > LONG
            scan = first & ~lowest & long
            at_now = at[np.where(lowest, from_start % 2 == 0, first & ~long)]
            keep = np.ones(len(symbol), bool)
            changed = np.zeros(len(symbol), bool)
            symbol[at_now] = to[at_now]
            changed[at_now] = True
            keep[at_now + 1] = False
            for i in at[scan]:
                lo, hi = np.searchsorted(sequence, [sequence[i], sequence[i] + 1])
                out = self._scan(symbol[lo:hi].tolist(), int(least[i]))
                symbol[lo : lo + len(out)] = out
                keep[lo + len(out) : hi] = False
                changed[lo : lo + len(out)] = True
            symbol, owner, sequence, rank, to, changed = (x[keep] for x in (symbol, owner, sequence, rank, to, changed))
            p = np.flatnonzero(changed)
            p = np.unique(np.concatenate([p, p - 1]))
            p = p[(p >= 0) & (p < len(symbol))]
            same = p[(p + 1 < len(symbol))]
            same = same[sequence[same] == sequence[same + 1]]
            rank[p] = _NONE
            rank[same], to[same] = self._look_up(symbol[same], symbol[same + 1])
        return counts

    def _ranked(self, symbol: np.ndarray, sequence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, to = np.full(len(symbol), _NONE), np.zeros(len(symbol), np.int64)
        tied = np.flatnonzero(sequence[:-1] == sequence[1:])
        rank[tied], to[tied] = self._look_up(symbol[tied], symbol[tied + 1])
        return rank, to

    def _stretches(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of a text, some at a time; those longer than a stretch stay whole."""
        text = self.model.normalize(text)
        lo = 0
        while lo < len(text):
            hi = lo + STRETCH
            while hi < len(text) and not (text[hi] == _MARK and text[hi - 1] != _MARK):
                hi = text.find(_MARK, hi + 1)
                hi = len(text) if hi < 0 else hi
            yield re.findall(f"{_MARK}*[^{_MARK}]+|{_MARK}+", text[lo:hi])
            lo = hi

    def count(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text; null counts as empty."""
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        out, waiting, new, held = [0] * len(texts), [], set(), 0

        def settle() -> None:
            nonlocal held
            some = list(new)
            memo.update(zip(some, self.merge(some).tolist(), strict=True))
            for i, stretch in waiting:
                out[i] += sum(map(memo.__getitem__, stretch))
            waiting.clear()
            new.clear()
            held = 0
            if len(memo) > MEMO:
                memo.clear()

        for i, text in enumerate(texts):
            for stretch in self._stretches(text or ""):
                waiting.append((i, stretch))
                new.update(set(stretch).difference(memo))
                held += len(stretch)
                if held > STRETCH:
                    settle()
        settle()
        return out


def counter(path: str) -> Counter:
    """The counter of a model file, once a worker."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def n_tokens(path: str, text: str = "text") -> Column:
    """Tokens of a text under a sentencepiece BPE model at a path every worker has; null counts as empty."""

    @F.pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in texts:
            yield pd.Series(counter(path).count(x.tolist()), dtype="int64")

    return count(F.coalesce(F.col(text), F.lit("")))


def count_tokens(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of docs (columns doc_id, text).

    Null and empty texts have no bytes and no tokens; texts of any length are counted whole; equal texts count alike, repeated rows and rows
    without an id give a row each; an empty table gives an empty one. Other columns are not looked at, so none can clash.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), n_tokens(path).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
