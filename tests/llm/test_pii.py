import hashlib
import re

import cases
from pyspark.sql import functions as F

from gustline.llm import pii as P
from gustline.llm import queries

PLAIN = (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
         re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
         re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"))
TEXTS = [
    "mail a.b+c@x-y.example.com, or @none.com or x@@y.z and foo@bar foo@bar.com@baz.org", "a@b.c@d.e.f ... %@1.2",
    "10.0.0.1 256.1.1.1 1.2.3.4.5.6.7.8 01.002.0003.4 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112 79927398713",
    "call +1 (736) 555-2678 or +49 30 1234567 or +1-2 ++44 20 7946 0958", "(736) 555-2678 phone 736 555 2678",
    "write to jane (at) example (dot) com or joe [at] example.org", "é🙂 a@b.co 日本 +33 1 23 45 67 89", "1" * 30000,
    "4111111111111111 5500 0000 0000 0004 3400-000000-00009", "x" * 5000 + "@" + "y" * 5000 + ".com", "1.1.1." * 300,
]


def plain(text):
    out = [(m.start(), 0, m.end()) for m in PLAIN[0].finditer(text)]
    out += [(m.start(), 1, m.end()) for m in PLAIN[1].finditer(text) if all(int(p) < 256 for p in m[0].split("."))]
    for m in PLAIN[2].finditer(text):
        d = [int(c) for c in m[0] if c.isdigit()]
        double = [sum(divmod(2 * n, 10)) if k % 2 else n for k, n in enumerate(reversed(d))]
        if 12 <= len(d) <= 19 and sum(double) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PLAIN[3].finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def test_base_spans_equal_the_plain_patterns():
    for t in TEXTS + [t or "" for t in cases.texts(60, 4)]:
        if len(t) < 20000:
            assert P.base_spans(t) == plain(t), t[:80]
    assert P.base_spans("1" * 200_000) == []  # no quadratic search


def test_octets_of_very_many_zeros():
    t = "a 1.1.1." + "0" * 5000 + "1 b 1.2.3." + "0" * 5000 + " c 1.1.1." + "0" * 5000 + "256 d"
    assert P.base_spans(t) == [(2, 1, 5009), (t.index("1.2"), 1, t.index(" c"))]
    assert P.base_spans("1.1.1." + "9" * 5000) == []
    P.regions(t, P.base_spans(t))


def test_field_decodes_the_best_set_of_segments():
    """Dynamic programming against all sets of non-overlapping segments."""
    r = P.Region([0, 2, 4, 6], [1, 3, 5, 7], [(0, 2, [1]), (1, 3, [2]), (2, 4, [3]), (0, 4, [4])])
    f = P.Field({(1, 0): 1.0, (2, 1): 1.8, (3, 2): 0.9, (4, 3): 1.85})
    assert f.decode(r) == [(0, 0, 3), (4, 2, 7)]
    f.weights[4, 3] = 2.0
    assert f.decode(r) == [(0, 3, 7)]


def test_remembered_looks_decode_like_gathered_candidates():
    """``added`` against the program over gathered candidates."""
    import random

    rng = random.Random(8)
    pieces = ["(736) 555-2678", "4111 1111 1111 1111", "10.0.0.256", "1 2 3 4 5 6 7 8 9", "jo (at) mail.example (dot) com", "word",
              "a@b", "x@y.example", "+49 30 1234567", "1234567", "12.04.2024 13:55", "٣٤٥ 1234567", "0" * 30, ", ", "(", "\n", "Straße5 77 88 99 00"]
    kinds = range(len(P.KINDS))
    texts = [" ".join(rng.choice(pieces) for _ in range(rng.randint(1, 14))) for _ in range(150)]
    names = sorted({f for t in texts for r in P.regions(t) for _, _, fs in r.segments for f in fs})
    f = P.Field({(n, k): rng.uniform(-1.2, 1.3) for n in names for k in kinds})
    found = 0
    for t in texts:
        base = P.base_spans(t)
        want = [s for r in P.regions(t, base) for s in f.decode(r)]
        assert f.added(t, base) == want and f.added(t) == [s for r in P.regions(t) for s in f.decode(r)], t
        found += len(want)
    assert found > 200


def test_a_megabyte_of_digits_is_searched_within_seconds(spark):
    import random
    import time

    learned = P.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    rng = random.Random(2)
    numbers = " ".join(str(rng.randint(0, 10 ** rng.randint(1, 8))) for _ in range(180_000))
    table = "\n".join(",".join(f"{rng.uniform(0, 1000):.{rng.randint(0, 4)}f}" for _ in range(10)) for _ in range(16_000))
    for text in ("1 " * 500_000, numbers, table, "7" * 1_000_000):
        began = time.process_time()
        P.find(text, learned)
        assert time.process_time() - began < 40  # seconds where a machine is not slowed down


def test_learning_raises_the_likelihood_of_the_labels():
    text = "call +1 (736) 555-2678 now"
    gold = set(P.base_spans(text))
    f, grads = P.Field(), P.defaultdict(float)
    for _ in range(30):
        for r in P.regions(text):
            f.learn(r, gold, grads, 0.5)
    assert [s for r in P.regions(text) for s in f.decode(r)] == sorted(gold)


def test_rewritten_spans_keep_their_places():
    text = "a b.c@d.example.org, +1 (736) 555-2678; 10.0.0.1 end"
    new, spans = P.rewritten(text, P.base_spans(text))
    assert [new[s:e] for s, k, e in spans if k == 1] == ["10.0.0.1"]
    assert all("@" not in new[s:e] and "at" in new[s:e] for s, k, e in spans if k == 0)
    assert all("+" not in new[s:e] and "736" in new[s:e] for s, k, e in spans if k == 3)


def test_spelt_addresses_and_numbers_without_country_are_added(spark):
    """Forms that no pattern takes, learned on a table of other documents."""
    learned = P.fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    text = "write to jo.doe22 (at) mail.example (dot) com or call (736) 555-2678 by 2024, version 12.4.0 of 1234567 rows"
    got = [(P.KINDS[k], text[s:e]) for s, k, e, base in P.find(text, learned)]
    assert got == [("email", "jo.doe22 (at) mail.example (dot) com"), ("phone", "(736) 555-2678")]


def test_base_spans_stay_and_added_ones_do_not_overlap_them(spark):
    docs = cases.documents(spark, TEXTS * 3 + cases.texts(20, 6)).withColumn("personal", F.lit(1)).withColumn(
        "h", F.lit("h"))
    learned = P.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    got = P.detect(docs, learned).collect()
    assert len(got) == docs.count()
    added = 0
    for r in got:
        text = r["text"] or ""
        base = [(s["start"], s["no"], s["end"]) for s in r["personal"] if s["base"]]
        if len(text) < 20000:
            assert base == plain(text)
        more = [s for s in r["personal"] if not s["base"]]
        added += len(more)
        assert not any(s["start"] < e and b < s["end"] for s in more for b, _, e in base)
    assert added
    assert P.detect(docs.limit(0), P.fit(docs.limit(0))).collect() == []


def test_query_over_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op8_pii(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        base = plain(docs[r["doc_id"]])
        told = [f"{P.KINDS[k]}:{s}:{e}" for s, k, e in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(told).encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(s[1] == k for s in base) for k in range(4)]
        assert set(told) <= set(r["spans"].split(",")) | {""}
