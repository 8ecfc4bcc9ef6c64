import random
import re

import cases
import numpy as np
import xxhash
from pyspark.sql import functions as F

from gustline.llm import queries
from gustline.llm import simhash as S


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """(id, text) -> (id, hex, component)"""
    fps = [plain_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                label[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [(d, f"{fps[i]:016x}", least.get(root(i))) for i, (d, _) in enumerate(rows)]


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def test_fingerprints_equal_the_plain_ones():
    for t in cases.texts(150, 3):
        want = plain_fingerprint(t)
        assert S.fingerprint(t or "") % 2 ** 64 == want


def test_components_equal_brute_force(spark):
    rng = random.Random(8)
    vocab = [f"w{k}" for k in range(400)]
    values = [None, "", "  ", "one", "Two words"]
    for _ in range(25):
        base = [rng.choice(vocab) for _ in range(rng.randint(60, 200))]
        for _ in range(rng.randint(1, 12)):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            values.append(" ".join(w) if rng.random() < 0.7 else " ".join(w).upper())
    docs = cases.documents(spark, values).withColumn("fp", F.lit(1)).withColumn("least", F.lit("x"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = order(map(tuple, S.near_duplicates(docs).collect()))
    want = order(plain_components(rows))
    assert got == want
    assert len({c for _, _, c in want}) < len(want) - 30


def test_dense_bucket_in_cells_keeps_every_link(spark, monkeypatch):
    """Fingerprints in one large bucket, dealt out in cells: same components."""
    monkeypatch.setattr(S, "CELL", 16)
    rng = np.random.default_rng(4)
    center = rng.integers(-2 ** 62, 2 ** 62, 5)
    fps = {int(c) for c in center}
    for c in center:
        for _ in range(60):
            x = int(c) % 2 ** 64
            for b in rng.choice(20, rng.integers(1, 7), replace=False):
                x ^= 1 << int(b)
            fps.add(x - 2 ** 64 if x >= 2 ** 63 else x)
    fps = sorted(fps)
    edges = S._edges(spark.createDataFrame([(f,) for f in fps], "fp long"))
    got = {r["node"]: r["root"] for r in S.connected_components(edges).collect()}
    label = {f: f for f in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if bin((a ^ b) % 2 ** 64).count("1") <= 3 and label[b] < label[a]:
                    label[a], changed = label[b], True
    assert {f: got.get(f, f) for f in fps} == label


def test_pigeonring_budget_never_drops_a_pair():
    rng = np.random.default_rng(1)
    for _ in range(300):
        x = np.zeros(1, dtype=np.uint64)
        for b in rng.choice(64, rng.integers(0, 4), replace=False):
            x |= np.uint64(1) << np.uint64(b)
        kept = [s for s in range(4) if not int(x[0]) >> 16 * s & 0xffff
                and S._within_budget(x, np.array([s]))[0]]
        assert kept


def test_chain_of_links_ends_at_the_smallest_node(spark):
    n = 300
    nodes = list(range(n))
    random.Random(3).shuffle(nodes)
    edges = spark.createDataFrame([(nodes[i], nodes[i + 1]) for i in range(n - 1)] + [(1000, 1001), (1001, 1000)],
                                  "a long, b long")
    got = {r["node"]: r["root"] for r in S.connected_components(edges).collect()}
    assert got == {**{k: 0 for k in range(1, n)}, 1001: 1000}
    assert S.connected_components(edges.limit(0)).collect() == []


def test_keep_one_row_of_each_component(spark):
    docs = cases.documents(spark, ["a b c d e f g", "x y z 1 2 3", "A b c d e f G", None, "", "x y z 1 2 3"])
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [0, 1, 3]
    assert [r["text"] for r in kept.collect() if r["doc_id"] is None] == ["no id"]
    assert S.keep_one(docs.limit(0)).collect() == []


def test_query_over_the_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    want = order(plain_components([(r["doc_id"], r["text"]) for r in docs]))
    assert order(map(tuple, queries.op3_simhash_dedup(spark, "/root/testdata/sf0.001").collect())) == want
