import random

import cases
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from gustline.llm import queries
from gustline.llm.token_counts import PieceCounter, SpaceRuns, token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_counts_equal_the_library_on_random_strings(library):
    rng = random.Random(4)
    parts = ["a", "b", "the", " ", "  ", "\n", "▁", "é", "日", "🙂", "<s>", "th", "ing", "1", "0", "\x00", "aa", "ha",
             " " * 17, "\xa0", "0x", "ab", "\t"]
    values = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    values += [" " * k for k in range(120)] + ["a" * k for k in range(80)] + ["ha" * k for k in range(80)]
    values += ["".join(chr(rng.randint(97, 102)) for _ in range(rng.randint(0, 400))) for _ in range(1000)]
    assert PieceCounter(MODEL).counts(values) == [len(x) for x in library.encode(values, num_threads=1)]


def test_space_runs_merge_leftmost_first():
    assert [SpaceRuns({1, 2, 4}).count(n) for n in range(9)] == [0, 1, 1, 2, 1, 2, 2, 3, 2]


def test_rows_nulls_repeats_and_clashing_columns(spark, library):
    docs = cases.documents(spark, cases.texts(60, 1)).withColumn("n_tokens", F.lit("mine")).withColumn(
        "_n_tokens", F.lit(7)).withColumn("N_Bytes", F.lit(1.5))
    got = token_counts(docs, MODEL, max_tokens=30).collect()
    assert len(got) == docs.count()
    for r in got:
        text = r["text"] or ""
        n = len(library.encode(text))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"], r["_n_tokens"]) == (len(text.encode()), n, n > 30, 7)
    assert token_counts(docs.limit(0), MODEL).collect() == []


def test_query_over_the_whole_table(spark, library):
    got = queries.op1_token_counts(spark, "/root/testdata/sf0.001").collect()
    want = {r["doc_id"]: r["text"] or "" for r in
            spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {k: len(library.encode(t)) for k, t in want.items()}
