"""BPE encoding and decoding with a word-end vocabulary (tokenizers ``.json``).

A word's symbols form a doubly linked list; a priority queue holds its adjacent
pairs by (merge rank, position). The best pair is taken off the queue and
merged in the list; entries whose symbols have changed since they were queued
are stale and skipped. Decoding concatenates the vocabulary strings.

No token crosses the border of a word, so equal words are encoded once per
worker process. Texts in ASCII or Latin letters are cut into words by a plain
pattern, all others piece by piece with Unicode classes.

Supported file layout (checked on load): BPE without unknown token, NFC +
white space + lower case normaliser, split into contractions, letter runs,
single digits and symbol runs, byte-level alphabet, word-end suffix, no
post-processor and no decoder.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gustline.llm.common import col, replace_columns, whole_text

CACHE_ENTRIES = 300_000  # words per generation of a worker's memory
CACHE_CHARS = 40  # longer ones are encoded but not remembered
ROWS_IN_FLIGHT = 256  # texts whose results are held at a time
# characters that str.split() takes for white space and the vocabulary does not
SEPARATORS = regex.compile("[\x1c-\x1f]")
# Lower-case texts without these characters hold only ASCII and precomposed Latin
# letters, for which the plain patterns mean the same as the Unicode classes.
NOT_LATIN = re.compile("[^\x00-\x1b\x20-\x7f\xc0-\xd6\xd8-\xf6\xf8-\u024f]")
SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
ASCII_WORDS = re.compile(SHORT + r"|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII)
LATIN_WORDS = re.compile(SHORT + "|[a-z\xc0-\xd6\xd8-\xf6\xf8-\u024f]+|[0-9]|[^\\sa-z0-9\xc0-\xd6\xd8-\xf6\xf8-\u024f]+")
WORDS = SHORT + r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where Latin-1
    has a visible one, else the next free one from 256 on."""
    out, free = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(free))
            free += 1
    return out


class Recent(dict):
    """Results of ``make`` by key in two generations: when the younger one is
    full it becomes the older, and what isn't asked for again goes. Long keys
    are not remembered."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, key: str) -> bytes:
        got = self.older.get(key)
        if got is None:
            got = self.make(key)
            if len(key) > CACHE_CHARS:
                return got
        if len(self) >= CACHE_ENTRIES:
            self.older = dict(self)
            self.clear()
        self[key] = got
        return got


class WordBPE:
    """``library``: encode new words with the tokenizers library's own merges
    instead of ``merge`` (same ids)."""

    def __init__(self, path: str, library: bool = False):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        split, level = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}, {}])
        if (model["type"] != "BPE" or model["unk_token"] or not model["end_of_word_suffix"]
                or model["byte_fallback"] or kinds != ["NFC", "Replace", "Lowercase"]
                or split.get("type") != "Split" or split["pattern"] != {"Regex": WORDS} or not split.get("invert") or level.get("type") != "ByteLevel"
                or level.get("use_regex") or spec["decoder"] or spec["post_processor"]):
            raise ValueError(f"{path}: not a word-end BPE file of the supported layout")
        vocab = model["vocab"]
        suffix = model["end_of_word_suffix"]
        alphabet = byte_alphabet()
        self.inner = [vocab.get(c) for c in alphabet]
        self.last = [vocab.get(c + suffix) for c in alphabet]
        self.rank: dict[int, int] = {}  # pair of ids -> rank
        self.made: list[int] = []       # rank -> id of the merged symbol
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[a] << 20 | vocab[b]] = rank
            self.made.append(vocab[a + b])
        self.words = regex.compile(WORDS)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: added tokens with matching options")
        self.special_at = regex.compile("(" + "|".join(
            regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
        if max(vocab.values()) >= 1 << 20:
            raise ValueError(f"{path}: more than {1 << 20} ids")
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.strings = np.full(size, "", dtype=object)
        for s, i in [*vocab.items(), *self.special.items()]:
            self.strings[i] = s
        self.model = tokenizers.Tokenizer.from_file(path).model if library else None
        self.bytes = dict(enumerate(alphabet))
        self.word_ids = Recent(self._library_word if library else self._word)  # normalised word -> ids

    def merge(self, ids: list[int]) -> list[int]:
        """Merge a word's symbols to the end. Queue entries are rank * n +
        position; an entry is stale if the pair at its position has another
        rank by now."""
        n = len(ids)
        rank_of, made = self.rank.get, self.made
        ranks = [rank_of(a << 20 | b, -1) for a, b in zip(ids, ids[1:])]
        queue = [r * n + i for i, r in enumerate(ranks) if r >= 0]
        if not queue:
            return ids
        heapify(queue)
        ranks.append(-1)
        nxt = list(range(1, n + 1))
        prv = list(range(-1, n - 1))
        while queue:
            rank, i = divmod(heappop(queue), n)
            if ranks[i] != rank:
                continue
            j = nxt[i]
            new = ids[i] = made[rank]
            ids[j] = ranks[j] = -1
            after = nxt[i] = nxt[j]
            if after < n:
                prv[after] = i
                r = ranks[i] = rank_of(new << 20 | ids[after], -1)
                if r >= 0:
                    heappush(queue, r * n + i)
            else:
                ranks[i] = -1
            before = prv[i]
            if before >= 0:
                r = ranks[before] = rank_of(ids[before] << 20 | new, -1)
                if r >= 0:
                    heappush(queue, r * n + before)
        return [x for x in ids if x >= 0]

    def _word(self, word: str) -> bytes:
        raw = word.encode()
        inner = self.inner
        ids = [inner[b] for b in raw]
        ids[-1] = self.last[raw[-1]]
        if None in ids:
            ids = [x for x in ids if x is not None]
        return array("I", self.merge(ids)).tobytes()

    def _library_word(self, word: str) -> bytes:
        raw = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.bytes)
        return array("I", [t.id for t in self.model.tokenize(raw)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a piece of text without white space, as little-endian 32-bit."""
        if "<" in chunk and self.special_at.search(chunk):
            return b"".join([
                array("I", [self.special[p]]).tobytes() if p in self.special else self._chunk(p)
                for p in self.special_at.split(chunk) if p])
        if not chunk.isascii():
            chunk = unicodedata.normalize("NFC", chunk).replace("Σ", "σ")  # lower case without context
        chunk = chunk.lower()
        if chunk.isalpha():
            return self.word_ids[chunk]
        return b"".join(map(self.word_ids.__getitem__, self.words.findall(chunk)))

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, as little-endian 32-bit integers."""
        low = text.lower()
        if "<|" not in low:
            if low.isascii():
                return b"".join(map(self.word_ids.__getitem__, ASCII_WORDS.findall(low)))
            if not NOT_LATIN.search(low):
                return b"".join(map(self.word_ids.__getitem__, LATIN_WORDS.findall(low)))
        chunks = regex.split(r"\s+", text) if SEPARATORS.search(text) else text.split()
        return b"".join(map(self._chunk, chunks))

    def decode(self, ids: bytes) -> str:
        """The vocabulary strings of the ids, special ones included, joined by
        a space (the file names no decoder)."""
        return " ".join(self.strings[np.frombuffer(ids, dtype="<u4")].tolist())


@functools.lru_cache(maxsize=4)
def codec(path: str, library: bool = False) -> WordBPE:
    return WordBPE(path, library)


def bpe_encode(df: DataFrame, vocab_path: str, text_col: str = "text") -> DataFrame:
    """``df`` with ``ids`` (binary, little-endian unsigned 32-bit integers) and
    ``n_tokens`` of each whole text, nothing added or cut.

    A narrow map without a shuffle. NULL encodes as an empty text (no ids);
    empty tables stay empty; repeated rows each keep their row; input columns
    named like an output are replaced. ``vocab_path`` must be readable on every
    executor.
    """
    @F.pandas_udf("binary")
    def encode(texts: pd.Series) -> pd.Series:
        c = codec(vocab_path)
        return pd.Series([c.encode(t) for t in texts], dtype=object)
    out = replace_columns(df, {"ids": encode(whole_text(text_col))})
    return replace_columns(out, {"ids": F.col("ids"), "n_tokens": (F.octet_length("ids") / 4).cast("long")})


def bpe_decode(df: DataFrame, vocab_path: str, ids_col: str = "ids") -> DataFrame:
    """``df`` with ``decoded``, the text of the ids in ``ids_col`` (binary as
    ``bpe_encode`` gives it; NULL decodes as no ids). Ids outside the
    vocabulary raise an error."""
    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        c = codec(vocab_path)
        return pd.Series([c.decode(x) for x in ids], dtype=object)
    return replace_columns(df, {"decoded": decode(F.coalesce(col(ids_col), F.lit(b"")))})


def bpe_codec(df: DataFrame, vocab_path: str, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``ids``, ``n_tokens`` and ``decoded`` of each text in one pass (one Python
    process per task, a few hundred texts in flight), after the columns named in
    ``carry`` (default: all that don't clash with an output). Rows are handled
    as by ``bpe_encode`` and ``bpe_decode``."""
    new = T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()),
                        T.StructField("decoded", T.StringType())])
    kept = [c for c in (df.columns if carry is None else carry) if c.lower() not in new.names]
    schema = T.StructType([df.schema[c] for c in kept] + new.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocab_path)
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS_IN_FLIGHT):
                part = batch.slice(begin, ROWS_IN_FLIGHT)
                ids = [c.encode(t) for t in part.column(len(kept)).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()),
                     pa.array([c.decode(x) for x in ids], pa.string())], names=schema.names)

    return df.select(*[col(c) for c in kept], whole_text(text_col).alias("_whole_text")).mapInArrow(run, schema)
