import zlib
from collections import defaultdict

import cases
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gustline.llm import packing, queries

VOCAB = public_tokenizers.path("word_bpe_49k.json")


def whole(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids + [1]
    return b"".join(i.to_bytes(4, "little") for i in ids)


def check_layout(pieces, width):
    """Sequences are gapless from 0 and all but the last are full."""
    at = defaultdict(int)
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == at[p["sequence_id"]] and p["length"] > 0
        at[p["sequence_id"]] += p["length"]
    assert sorted(at) == list(range(len(at)))
    assert all(at[k] == width for k in range(len(at) - 1))
    assert not at or 0 < at[len(at) - 1] <= width


@pytest.mark.parametrize("width, block", [(16, 1024), (2048, 2)])
def test_pieces_put_together_are_the_documents(spark, monkeypatch, width, block):
    monkeypatch.setattr(packing, "PREFIX_BLOCK", block)
    library = Tokenizer.from_file(VOCAB)
    docs = cases.documents(spark, cases.texts(40, 9), 7).withColumn("start", F.lit("x")).withColumn("part", F.lit(0))
    pieces = packing.pack(docs, VOCAB, width).collect()
    check_layout(pieces, width)
    # repeated rows: the pieces of an id make up each of its rows once
    want = defaultdict(list)
    for r in docs.collect():
        want[r["doc_id"]].append(whole(library, r["text"]))
    total = defaultdict(int)
    for p in pieces:
        assert any(x[4 * p["start"]:4 * (p["start"] + p["length"])] == bytes(p["ids"]) and len(x) == 4 * p["doc_tokens"]
                   for x in want[p["doc_id"]])
        total[p["doc_id"]] += p["length"]
    assert dict(total) == {k: sum(map(len, v)) // 4 for k, v in want.items()}
    assert packing.pack(docs.limit(0), VOCAB, width).collect() == []


def test_query_over_the_whole_table(spark):
    library = Tokenizer.from_file(VOCAB)
    docs = {r["doc_id"]: whole(library, r["text"])
            for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    pieces = queries.op6_packing(spark, "/root/testdata/sf0.001").collect()
    check_layout(pieces, 2048)
    at = defaultdict(int)
    for p in sorted(pieces, key=lambda p: (p["doc_id"], p["start"])):
        ids = docs[p["doc_id"]]
        assert p["start"] == at[p["doc_id"]] and p["doc_tokens"] * 4 == len(ids)
        assert p["ids_crc32"] == zlib.crc32(ids[4 * p["start"]:4 * (p["start"] + p["length"])])
        at[p["doc_id"]] += p["length"]
    assert {k: 4 * n for k, n in at.items()} == {k: len(v) for k, v in docs.items()}
