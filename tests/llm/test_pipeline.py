import os
import random
import zlib
from collections import defaultdict

import cases
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from test_secrets import plain as plain_spans
from test_simhash import plain_components

from gustline.llm import language_id, secrets, simhash


def masked(text):
    out, at = [], 0
    spans = sorted((s, e) for s, _, e in plain_spans(text, secrets.BASE + secrets.ADDED))
    for s, e in spans:
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], "[SECRET]"]
        at = e
    return "".join(out) + text[at:]


def told(text, profiles):
    """The language stage's rule, one n-gram at a time."""
    a = language_id.alphabet(profiles.vectors.shape[1])
    s = " " + " ".join("".join(c if c.isalpha() else " " for c in (text or "").lower()).split()) + " "
    if not s.strip():
        return False
    letters = a.encode(np.array([ord(c) for c in s], dtype=np.uint32))
    v = a.vectors().astype(float)[letters]
    grams = np.roll(v[:-2], 2, axis=1) * np.roll(v[1:-1], 1, axis=1) * v[2:]
    if len(grams) < language_id.LEAST_GRAMS:
        return True
    p = profiles.vectors / np.linalg.norm(profiles.vectors, axis=1, keepdims=True)
    cosines = p @ grams.sum(axis=0) / np.linalg.norm(grams.sum(axis=0))
    mean = v[:-2].mean(axis=0)
    chance = np.roll(mean, 2) * np.roll(mean, 1) * mean
    spread = np.sqrt(chance @ chance + (len(mean) - chance @ chance) / len(grams))
    return cosines.max() > p[cosines.argmax()] @ chance / spread + 2 / np.sqrt(len(mean))


def brute(rows, profiles):
    """doc_id -> token ids that the pipeline must pack."""
    kept = [(d, t) for d, t in rows if told(t, profiles)]
    comps = plain_components(kept)
    kept = [(d, t) for (d, t), (_, _, c) in zip(kept, comps) if d == c]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return {d: library.encode(masked(t), add_special_tokens=False).ids + [1] for d, t in kept}


def learned(docs):
    return language_id.fit(docs.filter(~language_id.held_out(F.col("doc_id"))))


def test_language_stage_rejects_what_is_no_language(spark):
    """Random letters, shuffled texts and unknown scripts go; held-out prose of
    the learned languages stays, all of it."""
    rng = random.Random(5)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    profiles = learned(docs)
    real = [r["text"] for r in docs.filter(language_id.held_out(F.col("doc_id"))).collect()
            if r["text"] and len(set(r["text"].split())) > 20]
    assert len(real) > 150
    letters = "abcdefghijklmnopqrstuvwxyz" + " " * 5
    junk = ["".join(rng.choice(letters) for _ in range(rng.randint(200, 3000))) for _ in range(100)]
    junk += ["".join(chr(rng.randint(0x4e00, 0x9000)) for _ in range(rng.randint(200, 3000))) for _ in range(60)]
    junk += ["".join(rng.sample(t, len(t))) for t in real[:100] if len(t) > 300]
    rows = [(i, t) for i, t in enumerate(real + junk)] + [(9001, None), (9002, "12 %"), (9003, "word"), (9004, "")]
    kept = {r["n"] for r in language_id.recognised(spark.createDataFrame(rows, "n long, text string"), profiles).collect()}
    assert all(i in kept for i in range(len(real)))
    gone = [i for i in range(len(real), len(real) + len(junk)) if i not in kept]
    assert len(gone) > 0.85 * len(junk)
    assert 9003 in kept and not {9001, 9002, 9004} & kept
    assert all((i in kept) == told(t, profiles) for i, t in rows[::7])


def test_run_removes_the_stages_that_are_used_up(spark):
    from gustline.session import shared_path

    where = shared_path(spark, "llm").replace("file:", "")
    before = set(os.listdir(where)) if os.path.isdir(where) else set()
    corpus_pipeline.run(spark, "/root/testdata/sf0.001").count()
    left = sorted(n.rsplit("-", 1)[0] for n in set(os.listdir(where)) - before if n.startswith("pipeline-"))
    assert left == ["pipeline-secret_scan"]


def test_near_duplicates_are_dropped_with_one_shuffle_of_the_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    size = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(size)
    spark.conf.set(size, "-1")
    try:
        p = simhash.keep_one(docs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(size, before)
    assert "SortMergeJoin" in p and p.count("Exchange hashpartitioning") == 2  # the texts and the kept rows' keys


def same(pieces, want):
    at = defaultdict(int)
    fill = defaultdict(int)
    for p in sorted(pieces, key=lambda p: (p["doc_id"], p["start"])):
        ids = want[p["doc_id"]]
        part = ids[p["start"]:p["start"] + p["length"]]
        assert p["start"] == at[p["doc_id"]] and p["doc_tokens"] == len(ids)
        assert p["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))
        at[p["doc_id"]] += p["length"]
        fill[p["sequence_id"]] += p["length"]
    assert dict(at) == {d: len(i) for d, i in want.items()}
    assert all(fill[k] == 2048 for k in range(len(fill) - 1))


def test_pipeline_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = brute(rows, learned(docs))
    assert 0 < len(want) < len(rows)
    same(entry.queries()["pipeline"](spark, sf).collect(), want)


def test_awkward_documents(spark, tmp_path):
    values = [None, "", "12 34", "a b c d e f g", "A b C d e f g", "password=0123456789abcdefg hello there",
              "same words again and again " * 900]
    docs = cases.documents(spark, values).filter("doc_id IS NOT NULL").dropDuplicates()
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    same(corpus_pipeline.run(spark, str(tmp_path)).collect(),
         brute([(r["doc_id"], r["text"]) for r in docs.collect()], learned(docs)))
    step = docs
    for name, f in corpus_pipeline.STAGES[:-1]:
        step = f(spark, step, str(tmp_path))
        assert step.columns == docs.columns, name
        assert all(r["n_chars"] == len(r["text"] or "") for r in step.collect() if r["text"])
    docs.limit(0).write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").collect() == []


def test_all_eleven_queries_are_registered():
    names = entry.queries()
    assert [n for n in range(1, 11) if not any(x.startswith(f"op{n}_") for x in names)] == []
    assert "pipeline" in names and [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "simhash_dedup", "secret_scan", "packing"]
