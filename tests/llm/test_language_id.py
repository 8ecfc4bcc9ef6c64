import zlib

import cases
import numpy as np
from pyspark.sql import functions as F

from gustline.llm import language_id as L
from gustline.llm import queries

LINES = {"en": "the quick brown fox jumps over the lazy dog and then the other one of them",
         "de": "der schnelle braune Fuchs springt über den faulen Hund und dann noch über einen",
         "ja": "素早い茶色の狐がのろまな犬を飛び越える"}


def small(spark, more=()):
    rows = [(k, t, lang) for k, (lang, t) in enumerate(LINES.items())] * 3
    return spark.createDataFrame(rows + list(more), "doc_id long, text string, lang string")


def test_prediction_is_the_cosine_with_the_bundled_vectors(spark):
    profiles = L.fit(small(spark), dim=256)
    assert profiles.languages == ["de", "en", "ja"]
    a = L.alphabet(256)

    def plain(text):
        out = np.zeros(256)
        s = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
        number = a.encode(np.array([ord(c) for c in s], dtype=np.uint32))
        v = a.vectors().astype(float)[number]
        for i in range(len(s) - 2):
            out += np.roll(v[i], 2) * np.roll(v[i + 1], 1) * v[i + 2]
        return out
    for k, lang in enumerate(profiles.languages):
        assert (profiles.vectors[k] == 3 * plain(LINES[lang])).all()
    for text in ["the dog", "Über den Hund!", "犬", "fox 12 -- FOX"]:
        got, score = profiles.predict([text])
        cos = [plain(text) @ p / np.linalg.norm(plain(text)) / np.linalg.norm(p) for p in profiles.vectors]
        assert got[0] == profiles.languages[int(np.argmax(cos))]
        assert abs(score[0] - max(max(cos), 0)) < 1e-4


def test_rows_nulls_repeats_and_clashing_columns(spark):
    docs = cases.documents(spark, cases.texts(20, 3)).withColumn("score", F.lit("mine")).withColumn(
        "_language", F.lit(4))
    got = L.predict(docs, L.fit(small(spark))).collect()
    assert len(got) == docs.count()
    for r in got:
        none = not any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == L.UNKNOWN) == none and 0 <= r["score"] <= 1 and r["_language"] == 4
        assert not none or r["score"] == 0
    assert L.predict(docs.limit(0), L.fit(small(spark))).collect() == []


def test_without_learned_languages_all_are_unknown(spark):
    profiles = L.fit(small(spark).limit(0))
    assert {r["lang_pred"] for r in L.predict(small(spark), profiles).collect()} == {L.UNKNOWN}


def test_any_partitioning_gives_the_same_profiles(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a, b = L.fit(docs.coalesce(1)), L.fit(docs.repartition(7))
    assert a.languages == b.languages and (a.vectors == b.vectors).all()


def test_held_out_accuracy_and_folds(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op9_language_id(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    held = [r for r in got if r["held_out"] and docs[r["doc_id"]]["lang"]]
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held) / len(held) >= 0.98
