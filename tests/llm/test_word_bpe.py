import hashlib
import random

import cases
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gustline.llm import queries, word_bpe
from gustline.llm.word_bpe import WordBPE, bpe_codec, bpe_decode, bpe_encode

VOCAB = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCAB)


def ids_of(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return b"".join(i.to_bytes(4, "little") for i in ids)


def test_ids_and_text_equal_the_library_on_random_strings(library):
    rng = random.Random(6)
    parts = cases.WORDS + ["'s", "'RE", "ing", "TH", "e", "́", "ﬁ", "Σ", "ß", "9", "_", "-", "<|startoftext|>", "<|",
                           "\x85", "　", "가", "अ", "\U0001d400", "K", "Å", "ẞ", "Ǆ", "ſ", "²", "½", "×", "÷", "\x7f", "ÿ", "Ÿ", "Ⱥ", "<|endoftext|>"]
    own, other = WordBPE(VOCAB), WordBPE(VOCAB, library=True)
    for _ in range(6000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        ids = own.encode(t)
        assert ids == other.encode(t) == ids_of(library, t), repr(t)
        want = library.decode([int.from_bytes(ids[k:k + 4], "little") for k in range(0, len(ids), 4)],
                              skip_special_tokens=False)
        assert own.decode(ids) == want


def test_one_very_long_word(library):
    rng = random.Random(1)
    t = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60_000))
    assert WordBPE(VOCAB).encode(t) == ids_of(library, t)


def test_rows_nulls_repeats_and_clashing_columns(spark, library):
    docs = cases.documents(spark, cases.texts(80, 5)).withColumn("ids", F.lit("mine")).withColumn("Decoded", F.lit(1))
    coded = bpe_decode(bpe_encode(docs, VOCAB), VOCAB)
    got = coded.collect()
    assert len(got) == docs.count()
    for r in got:
        ids = ids_of(library, r["text"])
        assert bytes(r["ids"]) == ids and r["n_tokens"] == len(ids) // 4
        assert r["decoded"] == library.decode(
            [int.from_bytes(ids[k:k + 4], "little") for k in range(0, len(ids), 4)], skip_special_tokens=False)
    assert bpe_decode(bpe_encode(docs.limit(0), VOCAB), VOCAB).collect() == []
    once = bpe_codec(docs, VOCAB)
    assert sorted(map(str, once.collect())) == sorted(map(str, coded.select(*once.columns).collect()))
    assert bpe_codec(docs, VOCAB, carry=["doc_id"]).columns == ["doc_id", "ids", "n_tokens", "decoded"]
    assert bpe_codec(docs.limit(0), VOCAB).collect() == []


def test_small_memory_gives_the_same_ids(library, monkeypatch):
    monkeypatch.setattr(word_bpe, "CACHE_ENTRIES", 3)
    own = WordBPE(VOCAB)
    for t in cases.texts(30, 8) * 2:
        assert own.encode(t or "") == ids_of(library, t)


def test_query_over_the_whole_table(spark, library):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in queries.op5_bpe_codec(spark, "/root/testdata/sf0.001").collect():
        assert r["ids_sha256"] == hashlib.sha256(ids_of(library, docs[r["doc_id"]])).hexdigest()
