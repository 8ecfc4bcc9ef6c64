import re
from itertools import permutations
from fractions import Fraction

import cases
import pytest
from pyspark.sql import functions as F

from gustline.llm import filter_audit as A

LABELS = "doc_id long, quality int, toxic int, part string, n int"


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", text)
    return [len(words) < 100, 100 * len(set(words)) < 80 * len(words),
            100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search(r"[#$%&*|]", text))]


def brute(docs, labels):
    smallest = {}
    for d in docs:
        if d["doc_id"] is not None:
            t = d["text"] or ""
            smallest[t] = min(smallest.get(t, d["doc_id"]), d["doc_id"])
    rows = []
    for d in docs:
        t = d["text"] or ""
        copy = d["doc_id"] is not None and smallest[t] < d["doc_id"]
        own = [x for x in labels if x[0] is not None and x[0] == d["doc_id"]]
        rows.append((d["lang"] or "", fails(t) + [copy], any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out = []
    for part in {r[0] for r in rows}:
        mine, shapley, found = [r for r in rows if r[0] == part], [0] * 5, []
        for order in permutations(range(5)):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                shapley[f] += len(gone)
                found.append(("".join("ABCDE"[i] for i in order), step, len(left), len(gone),
                              sum(r[1][f] for r in mine) - len(gone), sum(r[1] == [i == f for i in range(5)] for r in mine),
                              sum(r[2] for r in gone), sum(r[3] for r in gone), f))
        out += [(part, *x[:-1], shapley[x[-1]]) for x in found]
    return sorted(out)


def words(n, distinct):
    return " ".join(f"w{i % distinct}" for i in range(n))


TEXTS = [None, "", " \n", words(99, 99), words(100, 100), words(100, 80), words(100, 79), words(300, 300).upper(),
         words(150, 150) + " $", words(120, 120) + " a|b", "A" + "b" * 9, "A" + "b" * 8, "É" * 50 + "\x85\xa0x",
         words(200, 200), words(200, 200), words(200, 200) + "\t\x0b\x0c", words(60_000, 50_000), "#", "#"]


def test_equal_to_applying_every_order(spark):
    docs = cases.documents(spark, TEXTS * 3).withColumn("mask", F.lit("x")).withColumn("h", F.lit(1))
    # ids 0..: labels on some, repeated and NULL ones too
    labels = [(i, i % 2, int(i % 3 == 0), "p", 1) for i in range(0, 50, 2)] + [(3, 1, 0, "p", 1), (3, 0, 1, "p", 1), (None, 1, 1, "p", 1), (5, None, None, "p", 1)]
    got = A.audit(docs, spark.createDataFrame(labels, LABELS)).collect()
    want = brute([r.asDict() for r in docs.collect()], labels)
    assert sorted(map(tuple, got)) == want and len({w[0] for w in want}) == 2


def test_empty_tables(spark):
    none = spark.createDataFrame([], LABELS)
    assert A.audit(cases.documents(spark, TEXTS[:2]).filter(F.lit(False)), none).collect() == []
    docs = cases.documents(spark, TEXTS)
    assert sorted(map(tuple, A.audit(docs, none).collect())) == brute([r.asDict() for r in docs.collect()], [])


@pytest.mark.parametrize("n", [2, 3, 5])
def test_least_squares_gives_the_mean_over_all_orders(n):
    worth = [Fraction((s * 37 + s * s * 11) % 101) if s else Fraction(0) for s in range(1 << n)]
    weights = A.shapley_rows(n)
    orders = list(permutations(range(n)))
    for i in range(n):
        mean = Fraction(0)
        for o in orders:
            before = sum(1 << j for j in o[:o.index(i)])
            mean += worth[before | 1 << i] - worth[before]
        assert sum(w * v for w, v in zip(weights[i], worth)) == mean / len(orders)


def test_a_large_group_of_copies(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"), F.lit("en").alias("lang"))
    got = A.audit(docs, spark.createDataFrame([(0, 1, 1, "", 0)], LABELS)).filter("filter_order = 'EABCD'").collect()
    steps = {r.step: r for r in got}
    assert steps[1].removed == 29_999 and steps[1].kept == 1 and steps[1].good_lost == 0
    assert steps[2].removed == 1 and steps[2].redundant == 29_999 and steps[2].toxic_lost == 1
