"""Language identification with hyperdimensional n-gram profiles.

Every letter (and the word boundary) has a random vector of +1 and -1. An n-gram
binds its letters' vectors, each permuted (rotated) by its place, by
multiplication; a text bundles its n-grams by addition, and a language bundles
the texts known to be in it. A text gets the language whose profile has the
largest cosine with its own vector.

Bundling is a sum, so a language's profile is made from the counts of its
n-grams: tasks count, Spark adds the counts up, and each distinct n-gram is
bound once. All sums are of integers, hence the same on any partitioning.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gustline.llm.common import col, replace_columns, whole_text

DIM = 1024
N = 3
SEED = 20
UNKNOWN = "und"
CHANCE_DEVIATIONS, LEAST_GRAMS = 2.0, 50  # of ``recognised``
BLOCK_CHARS, BLOCK_TEXTS, BLOCK_GRAMS = 400_000, 128, 4096
DENSE_CODES = 1 << 23  # n-gram codes counted in a table; beyond it they are sorted


class Alphabet:
    """Numbers letters as they are met (0: anything else) and draws their
    vectors from their code points, so every process has the same ones."""

    def __init__(self, dim: int):
        self.dim = dim
        self.number = np.full(0x110000, -1, dtype=np.int32)
        self.points = [0x20]
        self.number[0x20] = 0
        self.made = np.zeros((0, dim), dtype=np.int8)

    def encode(self, points: np.ndarray) -> np.ndarray:
        out = self.number[points]
        if (out < 0).any():
            for p in np.unique(points[out < 0]).tolist():
                self.number[p] = len(self.points) if chr(p).isalpha() else 0
                if chr(p).isalpha():
                    self.points.append(p)
            out = self.number[points]
        return out

    def vectors(self) -> np.ndarray:
        if len(self.made) < len(self.points):
            new = [np.random.default_rng([SEED, p]).integers(0, 2, self.dim, dtype=np.int8) * 2 - 1
                   for p in self.points[len(self.made):]]
            self.made = np.concatenate([self.made, np.array(new, dtype=np.int8)])
        return self.made

    def bind(self, grams: np.ndarray) -> np.ndarray:
        """Vectors of n-grams given as rows of letter numbers."""
        letters = self.vectors()
        out = np.ones((len(grams), self.dim), dtype=np.int8)
        for place in range(N):
            out *= np.roll(letters, N - 1 - place, axis=1)[grams[:, place]]
        return out


@functools.lru_cache(maxsize=2)
def alphabet(dim: int) -> Alphabet:
    return Alphabet(dim)


def _codes(a: Alphabet, texts: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """(text number, n-gram code, code base) of every n-gram of some texts;
    lower case, runs of non-letters as one boundary."""
    lowered = [f" {t.lower()} " for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in lowered])
    ids = a.encode(points)
    keep = np.ones(len(ids), dtype=bool)
    keep[1:] = (ids[1:] != 0) | (ids[:-1] != 0) | (owner[1:] != owner[:-1])
    ids, owner = ids[keep], owner[keep]
    base = len(a.points)
    if len(ids) < N:
        return owner[:0], owner[:0], base
    code = ids[:len(ids) - N + 1].astype(np.int64)
    for place in range(1, N):
        code = code * base + ids[place:len(ids) - N + 1 + place]
    same = owner[:len(code)] == owner[N - 1:]
    return owner[:len(code)][same], code[same], base


def _split(code: np.ndarray, base: int) -> np.ndarray:
    """Letter numbers of n-gram codes, one row each."""
    out = np.empty((len(code), N), dtype=np.int64)
    for place in range(N - 1, -1, -1):
        out[:, place] = code % base
        code = code // base
    return out


def _distinct(code: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and, for each code, its place among them."""
    if base ** N > DENSE_CODES:
        return np.unique(code, return_inverse=True)
    held = np.bincount(code, minlength=base ** N) > 0
    return np.flatnonzero(held), (np.cumsum(held) - 1)[code]


def _blocks(texts: list[str]) -> Iterator[list[str]]:
    begin = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= BLOCK_CHARS or k + 1 - begin >= BLOCK_TEXTS:
            yield texts[begin:k + 1]
            begin, size = k + 1, 0
    if begin < len(texts):
        yield texts[begin:]


@dataclass
class Profiles:
    """Languages in alphabetical order and their bundled vectors."""
    languages: list[str]
    vectors: np.ndarray  # languages x dim, whole numbers

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        p = self.vectors.astype(np.float64)
        p = (p / np.maximum(np.sqrt((p ** 2).sum(axis=1, keepdims=True)), 1e-300)).astype(np.float32)
        a = alphabet(p.shape[1])
        langs, scores = [], []
        for block in _blocks(texts):
            owner, code, base = _codes(a, block)
            grams, at = _distinct(code, base)
            own = np.zeros((len(block), p.shape[1]), dtype=np.float32)
            for begin in range(0, len(grams), BLOCK_GRAMS):
                part = (at >= begin) & (at < begin + BLOCK_GRAMS) if len(grams) > BLOCK_GRAMS else slice(None)
                wide = min(BLOCK_GRAMS, len(grams) - begin)
                counts = np.bincount(owner[part] * wide + at[part] - begin, minlength=len(block) * wide)
                bound = a.bind(_split(grams[begin:begin + wide], base)).astype(np.float32)
                own += counts.reshape(len(block), wide).astype(np.float32) @ bound
            norm = np.sqrt((own.astype(np.float64) ** 2).sum(axis=1))
            cosine = (own @ p.T) / np.maximum(norm, 1e-300)[:, None]
            best = cosine.argmax(axis=1)
            letters = np.bincount(owner, minlength=len(block)) > 0
            langs += [self.languages[b] if some else UNKNOWN for b, some in zip(best, letters)]
            scores += [float(min(max(c, 0.0), 1.0)) if some else 0.0
                       for c, some in zip(cosine[np.arange(len(best)), best], letters)]
        return langs, scores


    def chance(self, texts: list[str], langs: list[str]) -> tuple[list[float], list[int]]:
        """The cosine that each text's letters are expected to reach with its
        language when they stand in any order, and its number of n-grams.

        Letters drawn one by one make n-gram vectors whose mean is the product
        of the permuted mean letter vectors; the cosine of a bundle of so many
        of them follows from that mean and the spread around it.
        """
        p = self.vectors.astype(np.float64)
        p /= np.maximum(np.sqrt((p ** 2).sum(axis=1, keepdims=True)), 1e-300)
        place = {lang: k for k, lang in enumerate(self.languages)}
        a, dim, out, sizes, at = alphabet(self.vectors.shape[1]), self.vectors.shape[1], [], [], 0
        for block in _blocks(texts):
            owner, code, base = _codes(a, block)
            n = np.bincount(owner, minlength=len(block))
            first = code // base ** (N - 1)
            letters = np.bincount(owner * base + first, minlength=len(block) * base).reshape(len(block), base)
            mean = letters @ a.vectors()[:base].astype(np.float64) / np.maximum(n, 1)[:, None]
            gram = np.ones((len(block), dim))
            for k in range(N):
                gram *= np.roll(mean, k, axis=1)
            size = (gram ** 2).sum(axis=1)
            expected = np.sqrt(size + (dim - size) / np.maximum(n, 1))
            for k, row in enumerate(gram):
                lang = place.get(langs[at + k])
                out.append(0.0 if lang is None else float(row @ p[lang] / max(expected[k], 1e-300)))
            sizes += n.tolist()
            at += len(block)
        return out, sizes


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", dim: int = DIM) -> Profiles:
    """Profiles learned from all rows with a language; the driver receives
    languages x ``dim`` numbers. NULL texts and texts without letters add
    nothing; without rows there are no languages."""
    names = ["lang", "gram", "n"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = alphabet(dim)
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            texts = np.array(batch.column(1).to_pylist(), dtype=object)
            for lang in sorted(set(langs)):
                for block in _blocks(texts[langs == lang].tolist()):
                    _, code, base = _codes(a, block)
                    grams, at = _distinct(code, base)
                    if len(grams):
                        point = np.array(a.points, dtype=np.uint32)[_split(grams, base)]
                        text = point.astype("<u4").tobytes().decode("utf-32-le")
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lang] * len(grams)),
                             pa.array([text[i:i + N] for i in range(0, len(text), N)]),
                             pa.array(np.bincount(at).astype(np.int64))], names=names)

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, sums = alphabet(dim), {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            points = np.frombuffer("".join(batch.column(1).to_pylist()).encode("utf-32-le"), dtype=np.uint32)
            grams, n = a.encode(points).reshape(-1, N), batch.column(2).to_numpy()
            for lang in set(langs):
                for rows in np.array_split(np.flatnonzero(langs == lang), -(-len(grams) // BLOCK_GRAMS)):
                    bound = a.bind(grams[rows]).astype(np.int64)
                    sums[lang] = sums.get(lang, 0) + n[rows] @ bound
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * dim), pa.array(np.arange(dim, dtype=np.int32)), pa.array(v.astype(np.int64))],
                names=["lang", "place", "v"])

    counts = (docs.filter(col(lang_col).isNotNull()).select(col(lang_col).cast("string").alias("lang"),
                                                           whole_text(text_col).alias("text"))
              .mapInArrow(count, "lang string, gram string, n long")
              .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    made = (counts.mapInArrow(bundle, "lang string, place int, v long")
            .groupBy("lang", "place").agg(F.sum("v").alias("v"))
            .groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "v"))).alias("v"))
            .select("lang", F.col("v.v").alias("v")).orderBy("lang").collect())
    return Profiles([r["lang"] for r in made], np.array([r["v"] for r in made], dtype=np.int64).reshape(-1, dim))


def predict(docs: DataFrame, profiles: Profiles, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (the cosine, 0 to 1). Texts that
    are NULL or have no letter are ``und`` with score 0; ties go to the language
    first in the alphabet; without profiles all are ``und``. Repeated rows each
    keep their own row; input columns named like an output are replaced."""
    @F.pandas_udf("lang string, score double")
    def identify(texts: pd.Series) -> pd.DataFrame:
        langs, scores = profiles.predict(texts.tolist())
        return pd.DataFrame({"lang": langs, "score": scores})

    got = "_language"
    while got in docs.columns:
        got = "_" + got
    out = docs.withColumn(got, identify(whole_text(text_col)))
    return replace_columns(out, {"lang_pred": F.col(got)["lang"], "score": F.col(got)["score"]}).drop(got)


def recognised(docs: DataFrame, profiles: Profiles, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows in which no language is told: NULL texts and texts
    without a letter, and those whose cosine is not above what their own
    letters reach in any order by more than ``CHANCE_DEVIATIONS`` standard deviations of
    a chance cosine. Texts of fewer than ``LEAST_GRAMS`` n-grams are too short for that and
    stay. Repeated rows share their fate; columns and their order are kept."""
    slack = CHANCE_DEVIATIONS / math.sqrt(max(profiles.vectors.shape[1], 1))

    @F.pandas_udf("boolean")
    def told(texts: pd.Series) -> pd.Series:
        some = texts.tolist()
        langs, scores = profiles.predict(some)
        chances, sizes = profiles.chance(some, langs)
        return pd.Series([lang != UNKNOWN and (n < LEAST_GRAMS or score > c + slack)
                          for lang, score, c, n in zip(langs, scores, chances, sizes)], dtype=bool)

    return docs.filter(told(whole_text(text_col)))


def held_out(id_col: Column, folds: int = 4, fold: int = 2) -> Column:
    """Whether a row is kept from learning: crc32 of the id's text, modulo
    ``folds``, is ``fold``. A NULL id is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == fold, F.lit(False))
