"""Awkward rows shared by the operator tests."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

WORDS = ["the", "of", "Straße", "naïve", "日本語", "ΑΣ", "x", "it's", "don't", "<|endoftext|>", "</s>", "🙂",
         "é", "12345", "a\x1cb", " ", "▁", "İ", "foo.bar", "==", "\t", "\n", "  ", "​"]


def texts(n: int, seed: int) -> list:
    rng = random.Random(seed)
    out = [None, "", " ", "\n", "▁", "word", "w" * 3000, " ".join(["long"] * 20000), "no letters 123 !!"]
    out += [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 40))) for _ in range(n)]
    return out


def documents(spark, values, partitions: int = 3):
    """documents with these texts; NULL text, NULL id and repeated rows added."""
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}", None if t is None else len(t)) for i, t in enumerate(values)]
    rows += [rows[-1], rows[-1], (None, "no id", "en", "s", 5), (None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(partitions)
