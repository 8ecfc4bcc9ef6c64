"""Token counts of a piece vocabulary (BPE with byte fallback) by
rank-synchronous array merging.

Pre-tokens of a whole batch of texts sit end to end in one integer array (a
ragged array: symbols plus the start of every sequence). In each round every
sequence finds its lowest-rank adjacent pair and merges all occurrences of that
pair at once; sequences without a pair left are taken out and their surviving
symbols counted. Ranks come from the vocabulary's scores (best score, rank 0).

Why it equals merging one pair at a time, leftmost first:

* A merge can only interact with other occurrences of the same rank by creating
  a neighbouring pair of a lower rank, which would then have to go first. Each
  round looks at the pairs that its merges create, in left-to-right order, and
  stops behind the first merge that creates a lower one.
* Texts are cut where no merge can cross: around characters that no piece of
  two or more characters holds next to each other. So a pre-token is a word
  with the space before it, and equal pre-tokens are merged once per task.
* Runs of spaces have tied scores below all other pieces; they are merged last,
  left to right, by length (``SpaceRuns``).
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustline.llm.common import replace_columns, whole_text

SPACE = "▁"  # the mark that a piece vocabulary writes for a space
CACHE_ENTRIES = 400_000  # distinct pre-tokens remembered per worker process
CACHE_CHARS = 64  # longer pre-tokens are counted but not remembered
NO_PAIR = np.iinfo(np.int32).max


class SpaceRuns:
    """Pieces left of a run of n spaces whose merges all have the same rank:
    leftmost first, so each new space merges into the piece on its left as long
    as the vocabulary has the result."""

    def __init__(self, lengths: set[int]):
        self.lengths = lengths
        self.known: dict[int, int] = {}

    def count(self, n: int) -> int:
        got = self.known.get(n)
        if got is None:
            stack: list[int] = []
            for _ in range(n):
                stack.append(1)
                while len(stack) > 1 and stack[-1] + stack[-2] in self.lengths:
                    top = stack.pop()
                    stack[-1] += top
            got = self.known[n] = len(stack)
        return got


class PieceCounter:
    """Counts tokens of texts for one vocabulary file."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, scores = [], []
        for i in range(sp.get_piece_size()):
            if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i)):
                pieces.append(sp.id_to_piece(i))
                scores.append(sp.get_score(i))
        runs = {len(p) for p in pieces if not p.strip(SPACE)}
        if any(SPACE in p.lstrip(SPACE) or (p.startswith(SPACE * 2) and p.strip(SPACE)) for p in pieces):
            raise ValueError("a piece holds a space mark after other characters")
        self.runs = SpaceRuns(runs)
        # symbols: 0 is a character without a piece, 1.. the pieces
        self.symbol = {p: k + 1 for k, p in enumerate(pieces)}
        order = sorted({s for p, s in zip(pieces, scores) if len(p) > 1 and p.strip(SPACE)}, reverse=True)
        rank_of = {s: r for r, s in enumerate(order)}
        if len(order) != sum(len(p) > 1 and bool(p.strip(SPACE)) for p in pieces):
            raise ValueError("pieces other than runs of spaces share a score")
        self.base = len(pieces) + 1
        pairs = []
        for p, s in zip(pieces, scores):
            if len(p) > 1 and p.strip(SPACE):
                for cut in range(1, len(p)):
                    a, b = self.symbol.get(p[:cut]), self.symbol.get(p[cut:])
                    if a and b:
                        pairs.append((a * self.base + b, rank_of[s], self.symbol[p]))
        pairs.sort()
        self.keys = np.array([k for k, _, _ in pairs] + [np.iinfo(np.int64).max], dtype=np.int64)
        self.ranks = np.array([r for _, r, _ in pairs] + [NO_PAIR], dtype=np.int32)
        self.merged = np.array([m for _, _, m in pairs] + [0], dtype=np.int32)
        joined = {p[i:i + 2] for p in pieces if p.strip(SPACE) for i in range(len(p) - 1)}
        self.joined = np.array(sorted(self.symbol.get(x[0], 0) * self.base + self.symbol.get(x[1], 0)
                                      for x in joined) + [np.iinfo(np.int64).max], dtype=np.int64)
        self.alone = [self.symbol.get(SPACE, 0)]
        self.spaced: dict[str, int] = {}  # word after a space -> tokens, -1-n: the space stayed alone
        self.bare: dict[str, int] = {}    # word not after a space -> tokens
        self.char: dict[str, int] = {}

    # -- merging ---------------------------------------------------------
    def _find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair in the pair table, or the sentinel's."""
        key = left.astype(np.int64) * self.base + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, at, len(self.keys) - 1)

    def merge(self, sym: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge every sequence to its end. Returns, per sequence, the number
        of surviving symbols and its first one."""
        count = np.zeros(len(starts), dtype=np.int64)
        first = np.zeros(len(starts), dtype=np.int32)
        owner = np.arange(len(starts))
        n = len(sym)
        at = np.full(n, len(self.keys) - 1)  # pair of position i with i + 1
        at[:-1] = self._find(sym[:-1], sym[1:])
        at[starts[1:] - 1] = len(self.keys) - 1
        while len(starts):
            n = len(sym)
            rank = self.ranks[at]
            lowest = np.minimum.reduceat(rank, starts)
            lengths = np.diff(starts, append=n)
            done = lowest == NO_PAIR
            if done.any():
                count[owner[done]] = lengths[done]
                first[owner[done]] = sym[starts[done]]
                live = np.repeat(~done, lengths)
                sym, at, rank = sym[live], at[live], rank[live]
                owner, lowest, lengths = owner[~done], lowest[~done], lengths[~done]
                starts = np.cumsum(lengths) - lengths
                n = len(sym)
                if not n:
                    break
            seq = np.repeat(np.arange(len(starts)), lengths)
            hit = np.flatnonzero(rank == lowest[seq])
            # of overlapping occurrences every second one goes, from the left
            fresh = np.empty(len(hit), dtype=bool)
            fresh[0] = True
            fresh[1:] = np.diff(hit) != 1
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            hit = self._before_lower(sym, at, seq, hit, lowest)
            new = self.merged[at[hit]]
            sym = sym.copy()
            sym[hit] = new
            keep = np.ones(n, dtype=bool)
            keep[hit + 1] = False
            place = np.cumsum(keep) - 1
            sym, at = sym[keep], at[keep]
            starts = place[starts]
            hit = place[hit]
            lasts = np.diff(starts, append=len(sym)) + starts - 1
            touched = np.unique(np.concatenate([hit, hit[hit > 0] - 1]))
            touched = touched[touched < len(sym) - 1]
            at[touched] = self._find(sym[touched], sym[touched + 1])
            at[lasts] = len(self.keys) - 1
        return count, first

    def _before_lower(self, sym, at, seq, hit, lowest):
        """The occurrences up to, per sequence, the first whose merge creates a
        pair of a lower rank."""
        new = self.merged[at[hit]]
        n = len(sym)
        prev, nxt = np.maximum(hit - 1, 0), np.minimum(hit + 2, n - 1)
        left = sym[prev]
        follows = np.zeros(len(hit), dtype=bool)  # the merge before it is its neighbour
        follows[1:] = hit[1:] == hit[:-1] + 2
        left = np.where(follows, np.roll(new, 1), left)
        own = lowest[seq[hit]]
        lower = ((hit > 0) & (seq[prev] == seq[hit]) & (self.ranks[self._find(left, new)] < own)) | (
            (hit + 2 < n) & (seq[nxt] == seq[hit]) & (self.ranks[self._find(new, sym[nxt])] < own))
        if not lower.any():
            return hit
        before = np.cumsum(lower) - lower  # lower merges to the left, all sequences
        s = seq[hit]
        begin = np.r_[0, np.flatnonzero(np.diff(s)) + 1]
        base = np.repeat(before[begin], np.diff(begin, append=len(hit)))
        return hit[before == base]

    # -- batches of pre-tokens --------------------------------------------
    def _count_words(self, words: list[str], spaced: bool) -> None:
        """Fill the cache for these words (each with a space before it, if
        ``spaced``)."""
        text = "".join(SPACE + w if spaced else w for w in words)
        sizes = np.array([len(w) + spaced for w in words], dtype=np.int64)
        chars = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        distinct, inverse = np.unique(chars, return_inverse=True)
        ids = np.array([self.symbol.get(chr(c), 0) for c in distinct], dtype=np.int32)
        width = np.where(distinct < 0x80, 1, np.where(distinct < 0x800, 2, np.where(distinct < 0x10000, 3, 4)))
        sym = ids[inverse]
        cost = np.where(sym == 0, width[inverse], 0)  # byte fallback
        begin = np.cumsum(sizes) - sizes
        cut = np.zeros(len(sym), dtype=bool)
        cut[begin] = True
        key = sym[:-1].astype(np.int64) * self.base + sym[1:]
        apart = (self.joined[np.searchsorted(self.joined, key)] != key) | (sym[:-1] == 0) | (sym[1:] == 0)
        cut[1:] |= apart
        starts = np.flatnonzero(cut)
        left, first = self.merge(sym, starts)
        left = np.where(sym[starts] == 0, cost[starts], left)
        at = np.searchsorted(starts, begin)
        total = np.add.reduceat(left, at)
        if spaced:
            total = np.where(first[at] == self.alone[0], -total, total)
        cache = self.spaced if spaced else self.bare
        cache.update(zip(words, total.tolist()))

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        lines = [(" " + t.replace(SPACE, " ")).split("\n") if t else [] for t in texts]
        if len(self.spaced) + len(self.bare) > CACHE_ENTRIES:
            self.spaced.clear()
            self.bare.clear()
        need_spaced: set[str] = set()
        need_bare: set[str] = set()
        parts = []
        for doc in lines:
            own = []
            for line in doc:
                items = line.split(" ")
                need_bare.add(items[0])
                need_spaced.update(items[1:])
                own.append(items)
            parts.append(own)
        need_spaced.discard("")
        need_bare.discard("")
        new_spaced = [w for w in need_spaced if w not in self.spaced]
        new_bare = [w for w in need_bare if w not in self.bare]
        if new_spaced:
            self._count_words(new_spaced, True)
        if new_bare:
            self._count_words(new_bare, False)
        out = []
        for own in parts:
            total = max(len(own) - 1, 0)  # every line break is one byte piece
            for items in own:
                if items[0]:
                    total += self.bare[items[0]]
                rest = items[1:]
                if "" in rest:
                    total += self._with_runs(rest)
                else:
                    got = [self.spaced[w] for w in rest]
                    total += sum(map(abs, got))
            out.append(total)
        for cache, new in ((self.spaced, new_spaced), (self.bare, new_bare)):
            for w in new:
                if len(w) > CACHE_CHARS:
                    cache.pop(w, None)
        return out

    def _with_runs(self, rest: list[str]) -> int:
        """Tokens of space-led items with several spaces in a row. The last
        space of a run belongs to the word behind it, unless it stayed alone
        there: then it is part of the run."""
        total = spaces = 0
        for w in rest:
            spaces += 1
            if w:
                got = self.spaced[w]
                if spaces == 1:
                    total += abs(got)
                elif got < 0:
                    total += -got - 1 + self.runs.count(spaces)
                else:
                    total += got + self.runs.count(spaces - 1)
                spaces = 0
        return total + self.runs.count(spaces)


@functools.lru_cache(maxsize=4)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def _blocks(texts: list[str], chars: int = 4_000_000):
    """Consecutive texts of about ``chars`` characters in all: bounds memory."""
    begin, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield texts[begin:k + 1]
            begin, size = k + 1, 0
    if begin < len(texts):
        yield texts[begin:]


def token_counts(df: DataFrame, model_path: str, text_col: str = "text", max_tokens: int = 4096) -> DataFrame:
    """``df`` with ``n_bytes`` (UTF-8 length), ``n_tokens`` and ``over_limit``
    (more than ``max_tokens``), without begin or end tokens.

    A narrow map: no shuffle, each text is counted whole. NULL counts as an
    empty text (0 bytes, 0 tokens); an empty table stays empty; repeated rows
    each keep their own row; input columns named like an output are replaced.
    ``model_path`` must be readable on every executor.
    """
    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        c = counter(model_path)
        return pd.Series([n for part in _blocks(texts.tolist()) for n in c.counts(part)], dtype="int64")

    text = whole_text(text_col)
    n = "_n_tokens"
    while n in df.columns:
        n = "_" + n
    counted = df.withColumn(n, count(text))
    return replace_columns(counted, {
        "n_bytes": F.octet_length(text).cast("long"),
        "n_tokens": F.col(n),
        "over_limit": F.col(n) > F.lit(max_tokens),
    }).drop(n)
